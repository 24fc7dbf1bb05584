import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quantloom.operators import tomorrow as tm
from quantloom.sources import batches as ba
from quantloom.sources.ingest import snapshot_hash
from quantloom.streaming import live as lv

DAY = date(2024, 1, 30)
SCHEMA = "strategy string, version string, signal_date date, phase string, code long, score double"


def batch(spark, *rows):
    return spark.createDataFrame([(s, v, DAY + timedelta(days=n), p, c, float(x)) for s, v, n, p, c, x in rows], SCHEMA)


def table(spark, path):
    return sorted((r.strategy, r.version, (r.signal_date - DAY).days, r.phase, r.code, r.score) for r in spark.read.schema(SCHEMA).parquet(path).collect())


def test_a_batch_replaces_just_itself(spark, tmp_path):
    path = str(tmp_path / "signals")
    first = [("a", "v1", 0, "close", 1, 5), ("a", "v1", 0, "close", 2, 6), ("a", "v1", 0, "noon", 1, 7), ("a", "v1", 3, "close", 1, 8), ("b", "v1", 0, "close", 1, 9)]
    assert [tuple(r) for r in ba.save_batches(path, batch(spark, *first)).orderBy("strategy").collect()] == [("a", 4, 0), ("b", 1, 0)]
    second = [("a", "v2", 0, "close", 3, 1)]
    for replaced in (2, 1):  # the second time it replaces itself
        assert [tuple(r) for r in ba.save_batches(path, batch(spark, *second)).collect()] == [("a", 1, replaced)]
        assert table(spark, path) == sorted(second + first[2:])
    replay = [("a", "Replay-7", 0, "close", 3, 2)]
    ba.save_batches(path, batch(spark, *replay))
    ba.save_batches(path, batch(spark, *replay))
    assert table(spark, path) == sorted(second + first[2:] + replay)
    ba.save_batches(path, batch(spark, ("a", "v3", 0, "close", 4, 3)))
    assert ("a", "Replay-7", 0, "close", 3, 2.0) in table(spark, path) and ("a", "v2", 0, "close", 3, 1.0) not in table(spark, path)


@pytest.mark.parametrize("bad", [
    [("a", "v2", 0, "close", 3, 1), ("a", "v2", 0, "close", 3, 2)], [("a", "v2", 0, "close", 3, 1), ("a", "v3", 0, "close", 4, 2)], [("a", None, 0, "close", 3, 1)],
])
def test_a_refused_batch_leaves_the_table_as_it_was(spark, tmp_path, bad):
    path = str(tmp_path / "signals")
    ba.save_batches(path, batch(spark, ("a", "v1", 0, "close", 1, 5)))
    with pytest.raises(ValueError):
        ba.save_batches(path, batch(spark, *bad))
    assert table(spark, path) == [("a", "v1", 0, "close", 1, 5.0)]


def test_a_batch_that_fails_while_written_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "signals")
    ba.save_batches(path, batch(spark, ("a", "v1", 0, "close", 1, 5)))
    broken = batch(spark, ("a", "v2", 0, "close", 2, 5)).withColumn("score", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        ba.save_batches(path, broken)
    assert table(spark, path) == [("a", "v1", 0, "close", 1, 5.0)]


def quotes(spark, *rows):
    return spark.createDataFrame(rows, "trade_date date, code string, id long, price double, turnover double")


def test_snapshots_are_immutable(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [(DAY, f"{i:06d}", i, i / 100, 5.0) for i in (1, 2, 1030, 5000)] + [(DAY + timedelta(days=1), "000001", 1, 3.0, None)]
    first = ba.save_snapshot(store, "s1", quotes(spark, *rows), None, ba.REAL).orderBy("trade_date").collect()
    assert [(r.rows, r.valid_rows, r.sample_type, r.status) for r in first] == [(4, 4, "unknown", "saved"), (1, 1, "unknown", "saved")]
    assert {r.status for r in ba.save_snapshot(store, "s1", quotes(spark, *rows[::-1])).collect()} == {"already_saved"}
    for other in (rows[1:], [*rows, (DAY, "000009", 9, 1.0, 1.0)], [(DAY, "000001", 1, 0.02, 5.0), *rows[1:]], rows[:-1]):
        with pytest.raises(ValueError, match="other content"):
            ba.save_snapshot(store, "s1", quotes(spark, *other))
    assert spark.read.parquet(f"{store}/rows/s1").count() == 5
    assert ba.save_snapshot(store, "s2", quotes(spark, *rows[1:]), "2024-01-30 14:30:00", ba.REAL).first().sample_type == ba.REAL
    with pytest.raises(ValueError):
        ba.save_snapshot(store, "s3", quotes(spark))
    assert snapshot_hash(quotes(spark)).count() == 0


def feed_rows(rng):
    rows, signals = [], 0
    for code in range(6):
        for i in range(40):
            if rng.random() < 0.8:
                close = rng.uniform(90, 110)
                rows.append((code, DAY + timedelta(days=i), False, None, close + rng.random(), close - rng.random(), close))
            for _ in range(rng.choice([0, 0, 1, 2])):
                signals += 1
                rows.append((code, DAY + timedelta(days=i), True, signals, None, None, None))
    return rows


def brute_labels(rows):
    out = []
    for code, day, is_signal, signal, *_ in rows:
        if is_signal:
            bars = sorted(r for r in rows if r[0] == code and not r[2])
            before, after = [b for b in bars if b[1] <= day], [b for b in bars if b[1] > day][:5]
            if before and len(after) == 5:
                e = before[-1][6]
                out.append((signal, code, e, after[4][1], *((after[k][6] / e - 1) * 100 for k in (0, 2, 4)), (max(b[4] for b in after) / e - 1) * 100, (min(b[5] for b in after) / e - 1) * 100))
    return sorted(out)


def test_labels_are_the_same_whole_and_with_restarts(spark, tmp_path):
    rows = feed_rows(random.Random(3))
    want = brute_labels(rows)
    schema = "code long, day date, is_signal boolean, signal_id long, high double, low double, close double"
    for name, cuts in (("whole", [0, 99]), ("parts", [0, 7, 8, 21, 30, 99])):
        path, out = str(tmp_path / name), None
        for low, high in zip(cuts, cuts[1:]):
            part = [r for r in rows if low <= (r[1] - DAY).days < high]
            spark.createDataFrame(part, schema).write.mode("append").parquet(f"{path}/feed")
            for _ in range(2):  # the second time there is nothing new
                out = lv.resume(lv.label_as_bars_come(spark.readStream.schema(schema).parquet(f"{path}/feed")), path)
        got = sorted(tuple(r) for r in out.collect())
        assert [g[:2] + g[3:4] for g in got] == [w[:2] + w[3:4] for w in want]
        assert all(a == pytest.approx(b, abs=1e-9) for g, w in zip(got, want) for a, b in zip(g[4:], w[4:]))


def test_hysteresis_is_the_same_whole_streamed_and_with_restarts(spark, tmp_path):
    rng, rows = random.Random(5), []
    for h in ("x", "y"):
        for n in range(12):
            rows += [(h, n, c, p + 1) for p, c in enumerate(rng.sample(range(15), 12))]
    df = spark.createDataFrame(rows, "horizon string, round long, code long, place long")
    want = sorted(tuple(r) for r in lv.stable_top_batch(df, 3, 6).collect())
    held = {}
    for h, n, ranked in ((h, n, [c for a, b, c, _ in rows if (a, b) == (h, n)]) for h in ("x", "y") for n in range(12)):
        stay = [c for c in ranked[:6] if c in held.get(h, {})][:3]
        new = [c for c in ranked if c not in stay][: 3 - len(stay)]
        held[h] = {c: held.get(h, {}).get(c, 0) + 1 for c in stay + new}
        assert sorted((h, n, c, k, c in new) for c, k in held[h].items()) == [w for w in want if w[:2] == (h, n)]
    for name, cuts in (("whole", [0, 99]), ("parts", [0, 4, 5, 99])):
        path, out = str(tmp_path / name), None
        for low, high in zip(cuts, cuts[1:]):
            df.where((F.col("round") >= low) & (F.col("round") < high)).write.mode("append").parquet(f"{path}/feed")
            out = lv.resume(lv.stable_top(spark.readStream.schema(df.schema).parquet(f"{path}/feed"), 3, 6), path)
        assert sorted(tuple(r) for r in out.collect()) == want


def test_stale(spark):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 10:00:11")], "code long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {(r.code, r.age_s, r.stale) for r in lv.stale(df, "2024-01-01 10:00:20", 10.0).collect()} == {(1, 20.0, True), (2, 9.0, False)}


# The next-day strategy

NUMBERS = {"pct_chg": 2.0, "volume_ratio": 1.5, "turnover_rate": 5.0, "amplitude": 4.0, "speed": 0.5, "price": 10.0, "high": 10.1, "low": 9.7, "open": 9.8, "turnover": 1e9, "ret_5d": 3.0, "ret_10d": 4.0, "ret_20d": 5.0, "ma20_gap": 2.0, "vol_amount_5d": 1.2, "volatility_20d": 2.0, "breakout_20d": 1.0, "ma_bull_aligned": 1.0, "sixty_day_pct": 10.0, "ytd_pct": 12.0}


def stock(code, industry="i", theme=None, day="d", ready=1, level="risk_on", market="main", **given):
    return (day, code, industry, theme, market, level, ready, *({**NUMBERS, **given}).values())


def stocks(spark, rows):
    return spark.createDataFrame(rows, "day string, code long, industry string, theme string, market string, level string, factor_ready int, " + ", ".join(f"{c} double" for c in NUMBERS))


def shown(spark, rows, coverage=90.0, breadth=60.0, **kw):
    b = spark.createDataFrame([("d", coverage, breadth)], "day string, coverage_pct double, breadth20_pct double")
    return {r.code: r for r in tm.tomorrow_candidates(stocks(spark, rows), b, "day", "code", 5e7, **kw).collect()}


def test_ladder_names_the_first_rule_that_fails(spark):
    cases = [
        ({}, None), ({"pct_chg": 0.5}, "change"), ({"pct_chg": 5.8}, "change"), ({"volume_ratio": 0.8}, "volume_ratio"), ({"volume_ratio": 5.0, "amplitude": 20.0}, "volume_ratio"), ({"turnover_rate": 1.0}, "turnover_rate_low"), ({"turnover_rate": 0.0}, None),
        ({"turnover_rate": 20.0}, "turnover_rate_high"), ({"amplitude": 12.0}, "amplitude"), ({"price": 9.75}, "weak_close"), ({"speed": 4.3}, "speed"), ({"turnover": 4e7}, "turnover"), ({"ma20_gap": -11.0}, "history"), ({"ma20_gap": -11.0, "ready": 0}, None), ({"pct_chg": 8.0, "market": "star"}, None),
    ]
    got = {r.code: r for r in tm.tomorrow_scores(stocks(spark, [stock(i, **c) for i, (c, _) in enumerate(cases)]), ["day"], ("day", "code"), 5e7).collect()}
    assert [got[i].reject for i in range(len(cases))] == [want for _, want in cases]
    assert got[1].backup_reject is None and got[5].backup_reject is None and got[2].backup_reject == "change"


def test_penalty_parts(spark):
    rows = [stock(1, pct_chg=5.0, price=9.85), stock(2, pct_chg=2.0, price=9.72, speed=3.0), stock(3, volume_ratio=1.0, ret_20d=-13.0, ma20_gap=-7.0, volatility_20d=7.0)]
    parts = {r.code: r.risk_penalty_parts for r in tm.tomorrow_scores(stocks(spark, rows), ["day"], ("day", "code"), 5e7).collect()}
    assert {"mid_gain_weak_close", "weak_tail_close"} <= parts[1].keys() and parts[1]["mid_gain_weak_close"] == pytest.approx(7 / (1 + 2.718281828459045 ** (-3 * (0.6 - 0.375))), abs=1e-6)
    assert "mid_gain_weak_close" not in parts[2] and {"weak_tail_close", "late_chase_speed"} <= parts[2].keys()
    assert {k: parts[3][k] for k in ("weak_volume_ratio", "history_downtrend", "ma20_break", "history_volatility")} == {"weak_volume_ratio": 4.0, "history_downtrend": 8.0, "ma20_break": 6.0, "history_volatility": 3.0}
    early = tm.tomorrow_scores(stocks(spark, rows), ["day"], ("day", "code"), 5e7, provisional=True).where("code = 1").first()
    assert not {"mid_gain_weak_close", "weak_tail_close"} & early.risk_penalty_parts.keys() and early.tail_setup_score == 50.0


def many(n, **given):
    return [stock(i, industry=f"i{i}", theme=f"t{i % 3}", pct_chg=1.5 + i / 20, ret_5d=3 + i / 10, turnover=1e9 + i * 1e7, **given) for i in range(n)]


def test_primary_rows_are_two_a_theme_and_five_at_most(spark):
    got = shown(spark, many(12))
    assert len(got) == 8 and {r.source for r in got.values()} == {"strict"} and sorted(r.place for r in got.values()) == list(range(1, 9))
    primary = [r.code % 3 for r in got.values() if r.tier == "primary_watch"]
    assert 0 < len(primary) <= 5 and max(primary.count(t) for t in range(3)) <= 2
    assert all(r.tier == "backup_watch" for r in shown(spark, many(12), breadth=40.0).values())  # weak breadth: none is primary
    assert {r.tier for r in shown(spark, many(12), provisional=True).values()} == {"intraday_watch"}


def test_floors_follow_breadth_and_then_level(spark):
    floors = [(90.0, 60.0, "risk_off", 60.0), (90.0, 50.0, "risk_on", 68.0), (90.0, 40.0, "risk_on", 78.0), (10.0, 90.0, "risk_on", 60.0), (10.0, 90.0, "balanced", 66.0), (10.0, 90.0, "risk_off", 72.0), (10.0, 90.0, "other", 70.0)]
    rows = spark.createDataFrame([(c, b, lv_, i) for i, (c, b, lv_, _) in enumerate(floors)], "coverage_pct double, breadth20_pct double, level string, i int")
    assert [r.f for r in rows.select("i", tm.display_floor().alias("f")).orderBy("i").collect()] == [f[3] for f in floors]


def test_backup_list_where_no_row_is_strict(spark):
    rows = many(6, volume_ratio=0.7)  # below the strict floor of 0.9, above the backup's
    got = shown(spark, rows, breadth=60.0)
    assert got and {r.source for r in got.values()} == {"backup"} and {r.tier for r in got.values()} == {"backup_watch"} and all(r.score >= 45 for r in got.values())
    assert not shown(spark, [stock(i, amplitude=15.0) for i in range(4)])


def test_caps_of_theme_and_industry(spark):
    rows = [stock(i, industry="same" if i < 4 else f"i{i}", theme="t" if i < 9 else f"t{i}", pct_chg=1.5 + i / 20) for i in range(12)]
    got = shown(spark, rows)
    assert sum(c < 4 for c in got) <= 2 and sum(c < 9 for c in got) <= 5 and len(got) == 8

"""Row contracts on small tables, against values worked out by hand."""

import datetime as dt
import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quantloom.operators import contracts as ct
from quantloom.operators import scoring as sc
from quantloom.operators.portfolio import paired_days, random_portfolios


def test_sample_types_and_primary_signals(spark):
    d = spark.createDataFrame([(" LIVE ",), ("replay",), ("close_forward",), ("x",), (None,)], "t string")
    assert [r[0] for r in d.select(ct.sample_type(F.col("t"))).collect()] == ["real_forward", "daily_proxy_replay", "close_forward", "unknown", "unknown"]
    rows = [("tomorrow_picks", 10, None, None), ("tomorrow_picks", 11, "", True), ("tomorrow_picks", 99, "primary_watch", None), ("swing", 50, None, None), ("swing", 1, "backup", None), ("swing", 1, "primary_watch", False)]
    d = spark.createDataFrame(rows, "s string, r int, t string, a boolean")
    assert [r[0] for r in d.select(ct.is_primary(*[F.col(c) for c in "srta"])).collect()] == [True, False, True, True, False, False]


def test_outcome_ready(spark):
    rows = [(True, None, None, None), (None, 5, None, None), (None, 2, "stop_loss", 2), (None, 2, "stop_loss", 3), (None, 2, "hold_to_term", 2), (None, None, "", 1)]
    d = spark.createDataFrame(rows, "c boolean, f int, e string, x int")
    assert [r[0] for r in d.select(ct.outcome_ready(*[F.col(c) for c in "cfex"], 5)).collect()] == [True, True, True, False, False, False]


def test_phases_and_thresholds(spark):
    times = ["09:29", "09:30", "09:40", "10:29", "10:30", "11:20", "11:21", "13:00", "14:00", "14:01"]
    d = spark.createDataFrame([(dt.datetime(2024, 1, 2, *map(int, t.split(":"))),) for t in times], "ts timestamp")
    got = [tuple(r[0]) for r in d.select(ct.execution_phase(F.col("ts"))).collect()]
    assert got == [(False, "backup_only"), (False, "open_observe"), (True, "main_execution"), (True, "main_execution"), (True, "late_execution"), (True, "late_execution"), (False, "backup_only"), (False, "afternoon_observe"), (False, "afternoon_observe"), (False, "backup_only")]
    rows = [("risk_on", 13.0, 20.0, -9.0), ("risk_off", 1.0, 1.0, 0.0), (None, None, 12.0, 5.0), ("other", 8.0, 7.0, None)]
    d = spark.createDataFrame(rows, "level string, volatility_20d double, turnover_rate double, order_imbalance double")
    assert [r[0] for r in d.select(ct.backup_threshold(F.col("level"), 60.0)).collect()] == [53.0, 42.5, 46.0, 45.0]
    assert d.select(ct.backup_threshold(F.col("level"), 45.0)).first()[0] == 44.9


def test_attached_columns_do_not_overwrite(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "code int, industry string")
    f = spark.createDataFrame([(1, "z", 9.0)], "code int, industry string, quality double")
    assert [tuple(r) for r in ct.attach_missing(d, f, "code").orderBy("code").collect()] == [(1, "a", 9.0), (2, "b", None)]
    hot, ind, mood = spark.createDataFrame([(1, 20)], "code int, hot_rank int"), spark.createDataFrame([("a", 1.5)], "industry string, industry_pct double"), spark.createDataFrame([], "code int, sentiment_score double")
    got = ct.attach_lookups(d, hot, ind, mood).orderBy("code").select("hot_rank_score", "industry_pct", "sentiment_score").collect()
    assert [tuple(r) for r in got] == [(100.0, 1.5, 50.0), (50.0, 0.0, 50.0)]


def test_direction_falls_back_on_what_is_there(spark):
    d = spark.createDataFrame([(80.0, None, None, None, None), (None, 60.0, 40.0, 20.0, 10.0)], "s double, q double, c double, a double, r double")
    got = [r[0] for r in d.select(ct.direction_score(*[F.col(c) for c in "sqcar"])).collect()]
    assert got == pytest.approx([80 * 0.72 + 50 * 0.18 + 5, 50 * 0.3 + 60 * 0.24 + 40 * 0.18 + 20 * 0.18 + 9])


def test_expected_return_is_that_of_the_peers(spark):
    rows = [(i, 7, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 7 - 3), -float(i % 4), 50.0 + i, 10.0) for i in range(40)]
    train = spark.createDataFrame(rows, "train_id int, code int, signal_date date, net_return double, max_drawdown double, score double, price double")
    q = spark.createDataFrame([(1, 7, 50.0, 10.0), (2, 8, 50.0, 10.0)], "query_id int, code int, score double, price double")
    got = ct.expected_return(q, train, "code", {"score": (10.0, 1.0), "price": (2.0, 0.5)}, least_shared=2, half_life=30).collect()
    assert len(got) == 1 and got[0]["peers"] == 20 and got[0]["confidence"] == "shadow"
    w = [0.5 ** ((19 - i) / 30) for i in range(20)]
    r = [float(i % 7 - 3) for i in range(20)]
    mean = sum(a * b for a, b in zip(w, r)) / sum(w)
    assert got[0]["expected"] == pytest.approx(mean) and got[0]["p_win"] == pytest.approx(sum(a for a, b in zip(w, r) if b > 0) / sum(w))
    assert got[0]["uncertainty"] == pytest.approx(math.sqrt(sum(a * (b - mean) ** 2 for a, b in zip(w, r)) / sum(w)) / math.sqrt(sum(w)))
    total, low = 0.0, None
    for v, a in sorted(zip(r, w)):
        total += a
        if total >= 0.1 * sum(w):
            low = v
            break
    assert got[0]["downside_p10"] == low


def test_expected_return_of_more_rows_than_the_least(spark):
    """The nearest 35 % of 100 rows; a third feature that is missing on some leaves them too little to compare."""
    rng = random.Random(2)
    rows = [(i, 1, dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(90)), rng.gauss(0, 3), -rng.random(), rng.uniform(0, 100), rng.uniform(5, 15), None if i % 9 == 4 else rng.random()) for i in range(112)]
    train = spark.createDataFrame(rows, "train_id int, code int, signal_date date, net_return double, max_drawdown double, score double, price double, rate double").repartition(4)
    queries = [(1, 1, 50.0, 10.0, 0.5), (2, 1, 5.0, 6.0, 0.9), (3, 1, 5.0, 6.0, None)]
    f = {"score": (100.0, 1.8), "price": (10.0, 1.0), "rate": (1.0, 0.5)}
    got = {r["query_id"]: r for r in ct.expected_return(spark.createDataFrame(queries, "query_id int, code int, score double, price double, rate double"), train, "code", f).collect()}
    assert sorted(got) == [1, 2]
    for i, _, *v in queries[:2]:
        near = sorted((round(sum(((a - b) / s) ** 2 * w for a, b, (s, w) in zip(v, r[5:], f.values())) / 3.3, 9), r[0], r) for r in rows if r[7] is not None)[:35]
        peers = [r for _, _, r in near]
        w = [0.5 ** ((max(r[2] for r in peers) - r[2]).days / 60) for r in peers]
        mean = sum(a * r[3] for a, r in zip(w, peers)) / sum(w)
        assert got[i]["peers"] == 35 and got[i]["expected"] == pytest.approx(mean) and got[i]["expected_drawdown"] == pytest.approx(sum(a * r[4] for a, r in zip(w, peers)) / sum(w))
        total = 0.0
        for a, r in sorted(zip(w, peers), key=lambda x: x[1][3]):
            total += a
            if total >= 0.1 * sum(w):
                break
        assert got[i]["downside_p10"] == pytest.approx(r[3]) and got[i]["uncertainty"] == pytest.approx(math.sqrt(sum(a * (r[3] - mean) ** 2 for a, r in zip(w, peers)) / sum(w)) / math.sqrt(max(1, sum(w))))


def test_paired_increments(spark):
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for i in range(40) for s, v in (("a", float(i % 5)), ("b", i % 5 + 1.0 + (i % 3) * 0.1))]
    p = paired_days(spark.createDataFrame(rows, "s string, d date, r double"), "s", "d", "r", "a", "b").withColumn("s", F.lit("b"))
    got = ct.paired_increment(p, "s", "d", 200).first()
    assert got["n"] == 40 and got["low"] <= got["mean"] <= got["high"] and got["low"] > 1 and got["p_value"] == pytest.approx(1 / 201)


def test_gates_feeds_and_registry(spark):
    c = spark.createDataFrame([("a", 99.5), ("b", 98.5)], "field string, coverage_pct double")
    got = {r["gate"]: (r["least_pct"], r["passed"], r["eligible"]) for r in ct.coverage_gates(c, {"base_quote": ("a", "b"), "hard_filter_execution": ("a", "b")}).collect()}
    assert got == {"base_quote": (98.5, True, 2), "hard_filter_execution": (98.5, False, 1), "optional_research": (None, False, 0)}
    with pytest.raises(ValueError, match="price"):
        ct.conform_spot(c, {}, ("field", "price"), ())
    feed = spark.createDataFrame([(" ", "sh600001", "d", "0.5"), ("12", None, None, None), (None, "", None, None)], "code string, ts_code string, date string, ratio string")
    got = [tuple(r) for r in ct.conform_events(feed, ("code", "ts_code"), ("date",), ("pct", "ratio")).collect()]
    assert got == [("600001", "d", 0.5, 0.5), ("000012", None, None, None)]
    shape = "experiment_id string, experiment_family string, hypothesis string, primary_metric string, sample_type string, baseline_id string, production_baseline_id string, trial_count int, candidate_parameters array<string>"
    e = spark.createDataFrame([("1", "f", "h", "m", "real", None, "v", 1, ["p"]), ("2", " ", "h", "m", "close", "u", "v", 1, ["p", "q"]), ("3", "f", "h", "m", "legacy", "v", "v", None, None)], shape)
    assert {r[0]: r[1] for r in ct.experiment_violations(e).collect()} == {"2": ["experiment_family", "sample_type", "baseline_id", "trial_count"], "3": ["candidate_parameters", "trial_count"]}


def test_missing_numbers_count_as_nought(spark):
    names = ["pct_chg", "volume_ratio", "turnover_rate", "amplitude", "speed", "price", "open", "high", "low", "sixty_day_pct", "ytd_pct"]
    shape = ", ".join(f"{n} double" for n in names) + ", market string"
    both = spark.createDataFrame([(*[None] * len(names), "main"), (*[0.0] * len(names), "main")], shape)
    a, b = both.select(sc.tail_setup_score(), sc.execution_score(), sc.not_overextended(), *sc.penalty_parts("tomorrow").values()).collect()
    assert tuple(a) == tuple(b)


def test_random_portfolios_pick_different_candidates(spark):
    rows = [("d", i, float(i)) for i in range(6)] + [("e", 1, 4.0), ("e", 2, 6.0)]
    got = {r["date"]: r for r in random_portfolios(spark.createDataFrame(rows, "date string, code int, r double"), "date", "r", 5, 400).collect()}
    assert got["e"]["random_mean"] == 5.0 and got["e"]["p5"] == 5.0
    # Five of six: the mean of all less one, so one of six values, each about as often.
    assert 2.0 <= got["d"]["p5"] <= got["d"]["p95"] <= 3.0 and abs(got["d"]["random_mean"] - 2.5) < 0.05


def test_expected_return_where_the_sample_misses(spark, monkeypatch):
    """Brackets guessed from a handful of rows miss the share's end on some queries, which are then counted on all rows."""
    rng = random.Random(7)
    rows = [(i, 1, dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(90)), rng.gauss(0, 3), 0.0, rng.uniform(0, 100), rng.uniform(5, 15)) for i in range(400)]
    train = spark.createDataFrame(rows, "train_id int, code int, signal_date date, net_return double, max_drawdown double, score double, price double")
    asks = [(k, 1, rng.uniform(0, 100), rng.uniform(5, 15)) for k in range(12)]
    q, f = spark.createDataFrame(asks, "query_id int, code int, score double, price double"), {"score": (10.0, 1.0), "price": (2.0, 0.5)}
    monkeypatch.setattr(ct.pr, "SAMPLE", 4)
    got = {r["query_id"]: r for r in ct.expected_return(q, train, "code", f, least_shared=2).collect()}
    for k, _, score, price in asks:
        near = sorted((round((((score - r[5]) / 10) ** 2 + ((price - r[6]) / 2) ** 2 * 0.5) / 1.5, 9), r[0], r) for r in rows)[:140]
        w = [0.5 ** ((max(r[2] for *_, r in near) - r[2]).days / 60) for *_, r in near]
        assert got[k]["peers"] == 140 and got[k]["expected"] == pytest.approx(sum(a * r[3] for a, (*_, r) in zip(w, near)) / sum(w))


def test_random_portfolios_carry_no_copy_of_a_date(spark):
    """A row for each draw held all of a date's returns, a thousand copies at once in a task."""
    rng = random.Random(3)
    rows = [("d", rng.randrange(40), None if i % 9 == 0 else rng.gauss(0, 1)) for i in range(60)] + [(None, i, float(i)) for i in range(7)]
    out = random_portfolios(spark.createDataFrame(rows, "date string, code int, r double"), "date", "r", 3, 50)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["date"]: r for r in out.collect()}
    for day in ("d", None):
        mine = [r for _, _, r in sorted((r for r in rows if r[0] == day), key=lambda r: (r[1], r[2] is not None, r[2] or 0.0))]
        means = []
        for draw in range(50):
            at = []
            for j in range(3):
                top = len(mine) - 3 + j
                t = int(hashlib.md5(":".join(["20260712", *([day] if day else []), str(draw), str(j)]).encode()).hexdigest()[:8], 16) % (top + 1)
                at.append(top if t in at else t)
            some = [mine[a] for a in at if mine[a] is not None]
            means += [sum(some) / len(some)] if some else []
        assert got[day]["random_mean"] == pytest.approx(sum(means) / len(means)) and got[day]["p50"] == pytest.approx(statistics.median(means))

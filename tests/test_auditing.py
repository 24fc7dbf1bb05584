import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quantloom.operators import audit as au
from quantloom.operators import merging as mg
from quantloom.operators import outcomes as oc
from quantloom.operators import replay as rp

DAY = date(2024, 1, 1)
BAR = "code long, trade_date date, open double, high double, low double, close double, volume double, turnover double"
SIGNAL = "signal_id long, code long, signal_date date, branch string, price_at_signal double, holding_days int, limit_pct double, delisted boolean"


def bars(spark, code, *closes, start=0, **at):
    """Bars of one code; at: day -> (open, high, low, close)."""
    rows = []
    for i, c in enumerate(closes):
        o, h, lo, c = at.get(f"d{i}", (c, c, c, c))
        rows.append((code, DAY + timedelta(days=start + i), *map(float, (o, h, lo, c)), 1.0, 1.0))
    return rows


def outcome(spark, rows, branch, day=1, price=None, hold=1, limit=10.0, delisted=False, today="2024-03-01"):
    s = spark.createDataFrame([(1, 7, DAY + timedelta(days=day), branch, price, hold, limit, delisted)], SIGNAL)
    return oc.entry_outcomes(s, spark.createDataFrame(rows, BAR), today).first()


def test_close_auction_sells_at_the_next_close(spark):
    r = outcome(spark, bars(spark, 7, 10, 10.0, 11.0, 12.0, 13.0, 9.0), "close_auction")
    assert (r.state, r.reason, r.entry_price, r.exit_price, r.exit_days, r.position) == ("settled", "next_close", 10.0, 11.0, 1, "closed")
    assert r.exit_return == pytest.approx(10) and r.return_3d == pytest.approx(30) and r.return_5d == r.return_20d == pytest.approx(-10)  # the last close there is
    assert r.max_gain_3d == pytest.approx(30) and r.hit_3pct and r.hit_5pct


def test_sealed_limit_down_waits_for_the_first_free_open(spark):
    rows = bars(spark, 7, 10, 10.0, 9.0, 8.1, 7.5, d4=(7.7, 7.9, 7.4, 7.5))
    r = outcome(spark, rows, "close_auction")
    assert (r.reason, r.exit_price, r.exit_days) == ("limit_down_delayed_to_open", 7.7, 3)
    r = outcome(spark, rows[:4], "close_auction")
    assert (r.state, r.reason, r.position, r.exit_price) == ("pending", "limit_down_exit_pending", "exit_pending", None)


def test_what_could_not_be_bought(spark):
    up = bars(spark, 7, 10, 11.0, 12.0)
    assert outcome(spark, up, "close_auction").reason == "limit_up_unfilled" and outcome(spark, up, "close_auction").position == "not_entered"
    assert outcome(spark, up, "close_auction", limit=20.0).state == "settled"
    opened = bars(spark, 7, 10, 11.0, 12.0, d1=(10.5, 11.0, 10.4, 11.0))
    assert outcome(spark, opened, "close_auction").state == "settled"
    assert outcome(spark, opened, "post_1430", price=10.95).reason == "limit_up_unfilled" and outcome(spark, opened, "post_1430", price=10.94).state == "settled"
    assert outcome(spark, opened, "post_1430").reason == "invalid_entry_price" and outcome(spark, opened, "post_1430", price=0.0).state == "unfilled"


def test_what_cannot_be_known_yet(spark):
    rows = bars(spark, 7, 10, 10.0)
    assert (outcome(spark, rows, "close_auction", today="2024-01-05").state, outcome(spark, rows, "close_auction").state) == ("pending", "unknown")  # 30 days make it stale
    assert outcome(spark, rows, "close_auction", day=5).reason == "signal_day_bar_missing"
    assert [outcome(spark, rows, "today", day=5, price=1.0, today=t).state for t in ("2024-01-10", "2024-03-01")] == ["pending", "unknown"]
    held = bars(spark, 7, 10, 10.0, 10.1, 10.2)
    assert (r := outcome(spark, held, "post_1430", price=10.0, hold=5)).reason == "insufficient_future" and r.position == "open_position" and r.return_3d is None


def test_post_1430_exits(spark):
    held = bars(spark, 7, 10, 10.0, 10.1, 10.2)
    r = outcome(spark, held, "post_1430", price=10.0, hold=5, delisted=True)
    assert (r.state, r.reason, r.exit_price, r.exit_days, r.survivorship_corrected) == ("settled", "delisted_last_tradable", 10.2, 2, True)
    assert outcome(spark, held, "post_1430", price=10.0, hold=2).reason == "hold_to_term"
    r = outcome(spark, bars(spark, 7, 10, 10.0, 10.0, d2=(10.0, 10.9, 9.9, 10.5)), "post_1430", price=10.0, hold=5)
    assert (r.reason, r.exit_price, r.exit_days) == ("take_profit", pytest.approx(10.8), 1)
    r = outcome(spark, bars(spark, 7, 10, 10.0, 9.0), "post_1430", price=10.0, hold=5)
    assert (r.state, r.reason, r.position) == ("pending", "exit_unfilled", "exit_pending")


def test_today_is_an_observation(spark):
    r = outcome(spark, bars(spark, 7, 10, 10.0, 11.0), "today", price=9.8)
    assert (r.state, r.exit_days, r.exit_price, r.position, r.return_1d, r.hit_3pct) == ("settled", 0, 10.0, "observation_closed", None, None)
    assert r.exit_return == pytest.approx((10 / 9.8 - 1) * 100) and outcome(spark, bars(spark, 7, 10, 10.0), "today").reason == "reference_or_close_invalid"


# Audit

CUT = datetime(2024, 1, 1, 14, 30)


def evidence(spark, **change):
    before = CUT - timedelta(minutes=1)
    row = {"candidate_id": 1, "cutoff": CUT, "source_times": {"quote_observed_at": before, "market_data_cutoff": CUT}, "announcements": [before], "feature_times": {"m.a": before}, "features": {"m.a": 1.0}, "missing": {"m.a": False}, "point_in_time_valid": True, "reasons": ["ok"]} | change
    schema = "candidate_id long, cutoff timestamp, source_times map<string,timestamp>, announcements array<timestamp>, feature_times map<string,timestamp>, features map<string,double>, missing map<string,boolean>, point_in_time_valid boolean, reasons array<string>"
    return sorted((r.type, r.field) for r in au.evidence_violations(spark.createDataFrame([tuple(row.values())], schema)).collect())


def test_evidence_is_held_against_the_cut_off(spark):
    after = CUT + timedelta(seconds=1)
    assert evidence(spark) == []
    assert evidence(spark, source_times={"quote_observed_at": after}) == [("timestamp_not_visible", "market_data_cutoff"), ("timestamp_not_visible", "quote_observed_at")]
    assert evidence(spark, source_times={"quote_observed_at": CUT, "market_data_cutoff": CUT, "event_loaded_at": after}) == [("timestamp_not_visible", "event_loaded_at")]
    assert evidence(spark, announcements=[after, CUT]) == [("future_announcement", "2024-01-01 14:30:01")]
    assert evidence(spark, features={"m.a": 1.0, "m.b": 2.0}) == [("feature_timestamp_not_visible", "m.b"), ("missing_mask_absent", "m.b")]
    assert evidence(spark, features={"m.b": 2.0}, missing={"m.b": True}) == []
    assert evidence(spark, feature_times={"m.a": after}) == [("feature_timestamp_not_visible", "m.a")]
    assert evidence(spark, point_in_time_valid=None, reasons=None, source_times=None) == [("eligibility_reason_missing", ""), ("point_in_time_invalid", ""), ("timestamp_not_visible", "market_data_cutoff"), ("timestamp_not_visible", "quote_observed_at")]
    assert len(evidence(spark, cutoff=None)) == 4


RECORD = {
    "candidate_id": 1, "signal_id": 5, "state": "settled", "entry_price": 10.0, "exit_price": 11.0, "gross": 10.0, "net": 9.5, "fee_pct": 0.25, "slippage_pct": 0.2, "impact_pct": 0.05, "base_total": 0.5, "exp_fee_pct": 0.25, "exp_slippage_pct": 0.2, "exp_impact_pct": 0.05, "raw_entry": 10.0, "exit_low": 10.5, "exit_high": 11.0,
    "order_quantity": 100.0, "filled_quantity": 100.0, "exit_quantity": 100.0, "unfilled_quantity": 0.0, "unfilled_entry_quantity": 0.0, "unfilled_exit_quantity": 0.0, "batch_policy": "p", "record_policy": "p", "promotion_eligible": True, "delisting": "not_applicable", "benchmarks": {k: (1.0, [0.5, 1.5, None]) for k in ("market", "industry", "style")},
}
UNFILLED = {"state": "unfilled", "exit_price": None, "gross": None, "net": None, "filled_quantity": 0.0, "exit_quantity": 0.0, "unfilled_quantity": 100.0, "unfilled_entry_quantity": 100.0}


@pytest.mark.parametrize("change, want", [
    ({}, []), ({"gross": 10.002}, ["return_not_reproducible"]), ({"gross": 10.0005, "net": 9.5005}, []), ({"net": None}, ["return_inputs_missing"]), ({"raw_entry": 10.01}, ["entry_fill_not_in_raw_prices"]), ({"exit_low": 11.1, "exit_high": 11.2}, ["exit_fill_not_in_raw_prices"]), ({"exit_low": None}, ["exit_fill_not_in_raw_prices"]),
    ({"impact_pct": 0.06}, ["execution_cost_not_reproducible"]), ({"exit_quantity": 90.0}, ["settled_quantity_not_conserved"]), ({"record_policy": None}, ["execution_policy_version_mismatch"]), ({"signal_id": None}, ["selected_candidate_without_signal"]), ({"state": "lost"}, ["label_status_missing"]), ({"state": None}, ["label_status_missing"]),
    (UNFILLED, []), (UNFILLED | {"unfilled_entry_quantity": 40.0}, ["unfilled_quantity_not_conserved"]), (UNFILLED | {"filled_quantity": 100.0, "unfilled_entry_quantity": 0.0, "unfilled_exit_quantity": 100.0}, []), (UNFILLED | {"state": "unknown", "promotion_eligible": False}, []), ({"state": "unknown"}, ["unknown_has_fabricated_return_or_promotion"]),
    (UNFILLED | {"delisting": "liquidated_last_tradable"}, ["delisting_liquidation_not_settled"]),
    ({"benchmarks": {"market": (1.2, [0.5, 1.5]), "industry": (None, [1.0])}}, ["benchmark_missing", "benchmark_not_reproducible", "benchmark_unavailable"]), ({"benchmarks": None}, ["benchmark_missing"] * 3),
])
def test_execution_records_follow_from_what_they_hold(spark, change, want):
    kinds = {"candidate_id": "long", "signal_id": "long", "state": "string", "batch_policy": "string", "record_policy": "string", "promotion_eligible": "boolean", "delisting": "string", "benchmarks": "map<string,struct<return_pct:double,constituents:array<double>>>"}
    df = spark.createDataFrame([tuple((RECORD | change).values())], ", ".join(f"{k} {kinds.get(k, 'double')}" for k in RECORD))
    assert sorted(r.type for r in au.execution_violations(df).collect()) == sorted(want)


def test_counts_are_conserved_between_levels(spark):
    batches = spark.createDataFrame([("a", 2, 3, 2), ("b", 1, 1, 1), ("c", 0, 0, 0)], "k string, saved_count long, candidate_count long, selected_count long")
    candidates = spark.createDataFrame([("a", True, True), ("a", True, True), ("a", False, False), ("b", False, True)], "k string, eligible boolean, selected boolean")
    signals = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    records = spark.createDataFrame([("a", "settled"), ("a", "pending"), ("b", "settled")], "k string, state string")
    got = {r.k: r.conserved for r in au.batch_conservation(batches, candidates, signals, records, ["k"]).collect()}
    assert got == {"a": True, "b": False, "c": True}
    lost = au.batch_conservation(batches, candidates, signals, records.where("state <> 'pending'"), ["k"])
    assert not lost.where("k = 'a'").first().conserved


# Merge and replay


def test_merge_is_the_fold_in_order_of_arrival(spark):
    rng, rows = random.Random(4), []
    for code in range(40):
        for n in range(rng.randrange(1, 6)):
            rows.append((code, rng.choice(["today_term", "tomorrow_picks", "candidate_pool", "other"]), n, rng.choice([10.0, 20.0, 30.0]), rng.choice([1.0, 2.0]), rng.choice([None, "", "x", "y", "z"]), rng.choice([None, 0.0, 5.0, 6.0])))
    rows += [(None, "other", 0, 1.0, 1.0, "lost", 1.0)]
    best = {}
    for code, src, n, score, value, name, price in rows:
        if code is None:
            continue
        item = ({"today_term": 3, "tomorrow_picks": 3}.get(src, 1), score, value), src, {"name": (name, src), "price": (price, src)}
        if code not in best:
            best[code] = item
            continue
        a, b = (item, best[code]) if item[0] > best[code][0] else (best[code], item)
        best[code] = a[0], a[1], {k: v if v[0] not in (None, "", 0.0) else b[2][k] for k, v in a[2].items()}
    df = spark.createDataFrame(rows, "code long, source string, n int, score double, value_score double, name string, price double")
    got = mg.merge_sources(df, ["name", "price"], arrival=["n"]).collect()
    assert len(got) == 40
    for r in got:
        _, src, fields = best[r.code]
        want = {k: v if v not in ("", 0.0) else None for k, (v, _) in fields.items()}
        assert (r.source, r.name, r.price) == (src, want["name"], want["price"])
        assert r.provenance == {k: fields[k][1] for k, v in want.items() if v is not None}


def test_watch_list_order(spark):
    df = spark.createDataFrame([(1, 0.5, 0.1, 0.1, 5.0), (2, 0.9, None, 0.1, 1.0), (3, 0.5, 0.1, 0.1, 2.0), (4, 0.5, 0.2, 0.0, None), (5, 0.5, 0.1, 0.1, None)], "code long, potential double, valuation double, leader double, risk double")
    assert [r.code for r in mg.watch_list(df, 4).collect()] == [2, 4, 3, 1] and mg.watch_list(df, 0).count() == 0


@pytest.fixture(scope="module")
def replayed(spark):
    rng, rows = random.Random(6), []
    for code, n in ((1, 60), (2, 33), (3, 32), (4, 60)):
        close = 10.0
        for i in range(n):
            before, close = close, close * (1 + rng.uniform(0.004, 0.03))
            rows.append((code, DAY + timedelta(days=i), before, close * 1.002, before * 0.999, close, 1e6 * rng.uniform(1, 1.4), 1e9))
    names = spark.createDataFrame([(1, "600001", "a"), (2, "600002", "b"), (3, "600003", "c"), (4, "600004", "*ST d")], "code long, symbol string, name string")
    b = spark.createDataFrame(rows, BAR)
    return b, names, rp.replay_rows(b, names, 1e6, top_n=2).cache()


def test_replay_guards(spark, replayed):
    b, names, rows = replayed
    got = {(r.code, (r.trade_date - DAY).days) for r in rows.collect()}
    assert got and {c for c, _ in got} <= {1, 2} and all(29 <= d <= 56 for _, d in got)  # 30 bars up to the date, 3 after it; 4 is under special treatment
    assert all(d == 29 for c, d in got if c == 2)
    cut = DAY + timedelta(days=45)
    early = rp.replay_rows(b.where(F.col("trade_date") <= cut), names, 1e6, top_n=2)
    until = F.col("trade_date") <= cut - timedelta(days=3)
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, rows.where(until).collect()))  # nothing later is seen


def test_replay_adds_nothing_twice(spark, replayed, tmp_path):
    table, rows = str(tmp_path / "replay"), replayed[2]
    dates = sorted({r.trade_date for r in rows.collect()})
    first = rp.backfill(table, rows, 3).first()
    assert first.saved == rows.where(F.col("trade_date") >= dates[-3]).count() and first.replaced == 0
    assert rp.backfill(table, rows, None).first().saved == rows.count() - first.saved
    assert rp.backfill(table, rows).count() == 0 and spark.read.parquet(table).count() == rows.count()

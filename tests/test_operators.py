"""Literal cases of single operators."""

import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quantloom.functions import scalars as sca
from quantloom.operators import backtest as bt
from quantloom.operators import crosssection as cs
from quantloom.operators import execution as ex
from quantloom.operators import factors as fx
from quantloom.operators import filters as ft
from quantloom.operators import joins as jn
from quantloom.operators import policies as po
from quantloom.operators import portfolio as pf
from quantloom.operators import risk_events as rk
from quantloom.operators import stats as st
from quantloom.operators import validation as va
from quantloom.plans import rules
from quantloom.sources import ingest as ig

BAR = "signal_id long, entry_price double, step int, trade_date date, open double, high double, low double, close double, prev_close double, turnover double"


def future(spark, *rows, entry=10.0):
    """(open, high, low, close, prev_close) by day."""
    return spark.createDataFrame([(1, entry, i, date(2024, 1, 1 + i), *map(float, r), 0.0) for i, r in enumerate(rows)], BAR)


def exit_of(spark, policy, *rows):
    return ex.simulate_exits(future(spark, *rows), policy).first()


@pytest.mark.parametrize(
    ("policy", "rows", "reason", "ret"),
    [
        (ex.ExitPolicy(holding_days=3), [(10, 10.2, 9.4, 9.8, 10)], "stop_loss", -5.0),
        (ex.ExitPolicy(holding_days=3), [(10.3, 10.9, 10.1, 10.5, 10)], "take_profit", 8.0),
        (ex.ExitPolicy(holding_days=3, stop_loss_pct=0, take_profit_pct=0), [(10.3, 10.7, 10.2, 10.5, 10), (10.6, 10.8, 10.2, 10.4, 10.5)], "trailing_stop", 2.72),
        (ex.ExitPolicy(holding_days=3), [(9.2, 9.6, 9.1, 9.3, 10)], "stop_loss", -8.0),
        (ex.ExitPolicy(holding_days=1), [(9, 9, 9, 9, 10), (8.8, 9.2, 8.7, 9.1, 9)], "stop_loss_limit_down_delayed", -12.0),
        (ex.ExitPolicy(holding_days=1), [(9, 9, 9, 9, 10), (8.1, 8.1, 8.1, 8.1, 9), (8.0, 8.4, 7.9, 8.2, 8.1)], "stop_loss_limit_down_delayed", -20.0),
        (ex.ExitPolicy(holding_days=1), [(9, 9, 9, 9, 10)], "stop_loss_limit_down_unfilled", -10.0),
        (ex.ExitPolicy(holding_days=2), [(10, 10.1, 9.9, 10, 10), (10, 10.3, 9.9, 10.2, 10)], "hold_to_term", 2.0),
        (ex.ExitPolicy(holding_days=2), [(10, 11, 9.0, 10, 10)], "stop_loss", -5.0),  # stop before target
    ],
)
def test_exits(spark, policy, rows, reason, ret):
    got = exit_of(spark, policy, *rows)
    assert got["exit_reason"] == reason and got["exit_return"] == pytest.approx(ret)


def trend(spark, n, step=0.1, code=1):
    d0 = date(2024, 1, 1)
    rows = [(code, d0 + timedelta(days=i), *[10 + step * i] * 4, 100.0 + i, 1000.0 + i) for i in range(n)]
    return spark.createDataFrame(rows, "code long, trade_date date, open double, high double, low double, close double, volume double, turnover double")


def test_factors_see_only_the_past(spark):
    b = trend(spark, 90)
    full = {r["trade_date"]: r for r in fx.with_factors(b).collect()}
    cut = date(2024, 1, 1) + timedelta(days=70)
    part = {r["trade_date"]: r for r in fx.with_factors(b.where(F.col("trade_date") <= F.lit(cut))).collect()}
    assert part and all(full[d] == part[d] for d in part)
    last = full[max(full)]
    assert last["ma_bull_aligned"] == 1.0 and last["breakout_20d"] == 1.0 and last["ret_5d"] == pytest.approx((18.9 / 18.4 - 1) * 100)
    short = {r["trade_date"]: r for r in fx.with_factors(b, lookback=30).collect()}[max(full)]
    assert short["ma60_gap"] == 0.0 and short["ma_bull_aligned"] == 0.0 and short["coverage"] == 1.0


def test_streaks(spark):
    closes = [10, 11, 12, 12, 11, 10, 9, 10]
    rows = [(1, date(2024, 1, 1 + i), float(c)) for i, c in enumerate(closes)]
    got = [(r["up_days"], r["down_days"]) for r in fx.with_streaks(spark.createDataFrame(rows, "code long, trade_date date, close double")).orderBy("trade_date").collect()]
    assert got == [(0, 0), (1, 0), (2, 0), (0, 0), (0, 1), (0, 2), (0, 3), (1, 0)]


def quotes(spark, *rows):
    return spark.createDataFrame([(c, n, float(p), float(pct), float(t), 10.0, 9.0) for c, n, p, pct, t in rows], "code string, name string, price double, pct_chg double, turnover double, high double, low double")


def test_filters(spark):
    q = quotes(spark, ("688001", "a", 10, 1, 1e8), ("300001", "b", 10, 9.5, 1e8), ("430001", "c", 10, 1, 1e8), ("600001", "*ST d", 10, 1, 1e8), ("600002", "e", 10, 9.2, 1e8), ("600003", "f", 10, 6.5, 1e8), ("600004", "g", 10, 1, 1e6), ("600005", "h", 10, 18.5, 1e8))
    assert {r["code"] for r in ft.candidates(q).collect()} == {"688001", "300001", "600003"}
    report = {r["reason"]: r["n"] for r in ft.filter_report(q, []).collect()}
    assert report == {"passed": 3, "unsupported_code": 1, "special_treatment": 1, "buyable_gain": 1, "min_turnover": 1, "max_gain": 1} and sum(report.values()) == q.count()


def test_scalars(spark):
    raw = ["1,234.5", "12%", "-", "", "nan", None, "inf", "x", "7"]
    d = spark.createDataFrame([(x,) for x in raw], "x string")
    assert [r[0] for r in d.select(sca.coerce_number(F.col("x"))).collect()] == [1234.5, 12.0, 0, 0, 0, 0, 0, 0, 7.0]
    assert [r[0] for r in d.select(sca.coerce_number(F.col("x"), None)).collect()][2:8] == [None] * 6
    codes = spark.createDataFrame([("1",), ("600001.SH",), ("sh600001",)], "c string")
    assert [r[0] for r in codes.select(sca.normalize_code(F.col("c"))).collect()] == ["000001", "600001", "600001"]


def test_percentiles(spark):
    rows = [("d", 1, 5.0, True), ("d", 2, 7.0, True), ("d", 3, 7.0, True), ("d", 4, 100.0, False), ("d", 5, None, False), ("e", 6, 3.0, True)]
    d = spark.createDataFrame(rows, "day string, id int, v double, ready boolean")
    got = {r["id"]: r["v_pct"] for r in cs.percentile_scores(d, ["day"], ["v"], F.col("ready")).collect()}
    assert got == {1: pytest.approx(100 / 3), 2: 100, 3: 100, 4: 100, 5: pytest.approx(100 / 3), 6: 50}


def test_rank_ic(spark):
    rows = [(f"c{i}", d, float(s), r) for d in ("a", "b") for i, (s, r) in enumerate([(10, -1.0), (20, 0.5), (30, 2.0)])]
    ic = va.daily_rank_ic(spark.createDataFrame(rows, "code string, day string, f double, r double"), ["f"], "r", "day").collect()
    assert [(r["n"], round(r["ic"], 9)) for r in ic] == [(3, 1.0)] * 2
    flat = va.daily_rank_ic(spark.createDataFrame([(f"c{i}", "a", 1.0, float(i)) for i in range(4)], "code string, day string, f double, r double"), ["f"], "r", "day").collect()
    assert [r["ic"] for r in flat] == [0.0]


def test_fdr(spark):
    e = spark.createDataFrame([("A", "f", 3, [0.001]), ("B", "f", 2, [0.05, 0.9])], "experiment_id string, experiment_family string, trial_count int, p_values array<double>")
    got = st.experiment_fdr(e, 0.1).collect()
    assert len(got) == 5 and sum(r["reported"] for r in got) == 3 and {r["experiment_id"] for r in got if r["rejected"]} == {"A"}
    adjusted = [r["adjusted_p"] for r in sorted(got, key=lambda r: r["bh_rank"])]
    assert adjusted == sorted(adjusted)


def test_paired_series_and_sharpe(spark):
    rows = [("a", date(2024, 1, 1 + i), x) for i, x in enumerate([0.1, -0.2, 0.3, 0.2, 0.0, 0.4])]
    rows += [("b", d, x + 0.25) for _, d, x in rows]
    d = spark.createDataFrame(rows, "s string, day date, r double")
    p = pf.paired_days(d, "s", "day", "r", "a", "b")
    assert [round(r["increment"], 9) for r in p.collect()] == [0.25] * 6
    low = st.bootstrap_interval(p.withColumn("s", F.lit("x")), "s", "day", "increment", 40).first()
    assert low["low"] == pytest.approx(0.25) and low["high"] == pytest.approx(0.25)
    assert st.bootstrap_p_value(d.where("s = 'b'"), "s", "day", "r", 40).first()["p_value"] < 0.2
    same = spark.createDataFrame([("x", 0.2)] * 5, "s string, r double")
    assert st.deflated_sharpe(same, ["s"], "r").first()["passed"]


def test_nav(spark):
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate([10.0, -50.0, 20.0, -100.0, 30.0])], "s string, i int, r double")
    got = [(round(r["nav"], 6), round(r["drawdown"], 6)) for r in st.net_asset_value(d, ["s"], "i", "r").orderBy("i").collect()]
    assert got == [(1.1, 0.0), (0.55, -50.0), (0.66, -40.0), (0.0, -100.0), (0.0, -100.0)]


def test_calibration_is_monotone(spark):
    rows = [("s", float(i), bool((i * 7) % 10 < i / 10)) for i in range(100)]
    got = [r["probability"] for r in st.isotonic_buckets(spark.createDataFrame(rows, "g string, score double, win boolean"), ["g"], "score", "win").orderBy("bucket").collect()]
    assert got == sorted(got) and len(got) == 5


def test_caps(spark):
    rows = [("d", i, 100.0 - i, "AB"[i % 2], "xyz"[i % 3]) for i in range(12)]
    q = spark.createDataFrame(rows, "day string, id int, s double, theme string, industry string")
    assert [r["id"] for r in cs.capped(q, ["day"], "industry", [F.desc("s")], 1, 10).orderBy("place").collect()] == [0, 1, 2]
    picked = cs.two_caps(q.withColumn("o", -F.col("s")), ["day"], ["o", "id"], "theme", "industry", 2, 1).orderBy("place").collect()
    assert [r["id"] for r in picked] == [0, 1, 2]
    w = pf.capped_weights(q, ["day"], "s", "theme", 0.2, 0.5, 0.9).collect()
    assert max(r["weight"] for r in w) <= 0.2 + 1e-9 and sum(r["weight"] for r in w) <= 0.9 + 1e-9
    for t in "AB":
        assert sum(r["weight"] for r in w if r["theme"] == t) <= 0.5 + 1e-9


def test_as_of_takes_the_last_known(spark):
    left = spark.createDataFrame([(1, "a", datetime(2024, 1, 2)), (2, "a", datetime(2023, 1, 1)), (3, "b", datetime(2024, 1, 1))], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", datetime(2024, 1, 1), 5), ("a", datetime(2024, 1, 2), 6), ("a", datetime(2024, 1, 3), 7)], "k string, t timestamp, v int")
    assert {r["id"]: r["v"] for r in jn.as_of(left, right, "k", "t", "t", ["v"]).collect()} == {1: 6, 2: None, 3: None}


def test_blacklist_and_sentiment(spark):
    items = spark.createDataFrame([("1", "low", 3.0, False, None, date(2024, 1, 1)), ("1", "critical", 9.0, True, date(2024, 2, 1), date(2024, 1, 1)), ("2", "high", 5.0, False, date(2023, 1, 1), date(2024, 1, 1))], "code string, level string, penalty double, hard boolean, expires date, as_of date")
    assert [tuple(r) for r in rk.merge_blacklist(items).collect()] == [("1", 12.0, "critical", True, 2)]
    news = spark.createDataFrame([("1", "big order won", 1.0), ("2", "lawsuit filed", None), ("3", None, 1.0)], "code string, content string, hours double")
    got = {r["code"]: r for r in rk.news_sentiment(news, {"order": 7.0, "lawsuit": -8.0}, ("lawsuit",), "code", "hours").collect()}
    assert got["1"]["score"] > 50 > got["2"]["score"] and got["2"]["risk_words"] == "lawsuit" and got["3"]["score"] == 50


def test_adjusted_bars_and_upsert(spark):
    s = "code string, trade_date string, open double, high double, low double, close double, volume double, turnover double"
    raw = spark.createDataFrame([("a", "1", 10.0, 10.0, 10.0, 10.0, 1.0, 1.0), ("a", "2", 9.0, 9.0, 9.0, 9.0, 1.0, 1.0)], s)
    adj = spark.createDataFrame([("a", "1", 5.0, 5.0, 5.0, 5.0, 1.0, 1.0), ("b", "1", 7.0, 7.0, 7.0, 7.0, 1.0, 1.0)], s)
    got = {(r["code"], r["trade_date"]): (r["close"], r["adj_close"], r["adj_factor"]) for r in ig.adjusted_bars(raw, adj).collect()}
    assert got == {("a", "1"): (10, 5, 0.5), ("a", "2"): (9, 9, 1), ("b", "1"): (7, 7, 1)}
    up = ig.upsert(raw.select("code", "trade_date", "close"), raw.limit(1).select("code", "trade_date", F.lit(3.0).alias("close")), ["code", "trade_date"], "trade_date")
    assert sorted(r["close"] for r in up.collect()) == [3.0, 9.0]


def test_walk_forward_purges(spark):
    d = spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i),) for i in range(60)], "trade_date date")
    got = bt.walk_forward(d, 2, 10, 5).groupBy("fold", "part").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).collect()
    by = {(r["fold"], r["part"]): (r["a"], r["b"]) for r in got}
    assert all((by[f, "test"][0] - by[f, "train"][1]).days == 6 for f in (0, 1))


def test_sign_test_of_any_number_of_throws(spark):
    cases = [(1, 0), (1, 1), (7, 4), (31, 16), (150, 75), (400, 190), (400, 210), (400, 400), (401, 230), (3000, 1600), (100_001, 50_300)]
    df = spark.createDataFrame([*cases, (5, None)], "n long, k long")
    got = {(r["n"], r["k"]): r["tail"] for r in po.binomial_tail(df, "n", "k").collect()}
    for n, k in cases:
        term = total = math.comb(n, k)
        for i in range(k, n):
            term = term * (n - i) // (i + 1)
            total += term
            if not term:
                break
        assert math.isclose(got[n, k], total / 2**n if n < 1000 else float(total * 10**18 >> n) / 1e18, rel_tol=1e-9, abs_tol=1e-15)
    assert got[5, None] is None


def test_sign_test_query_takes_all_signals_of_a_code(spark, monkeypatch):
    rows = [("hot", "settled", 0.1 if i % 5 < 3 else -0.1) for i in range(500)] + [("few", "settled", 0.1)] * 3
    monkeypatch.setattr(rules, "_outcomes", lambda s, d: s.createDataFrame(rows, "code string, state string, net_return double"))
    got = {r["code"]: (r["n"], r["k"], r["tail"]) for r in rules.q9_sign_test(spark, "").collect()}
    assert got["few"] == (3, 3, 0.125) and got["hot"] == (500, 300, round(sum(math.comb(500, i) for i in range(300, 501)) / 2**500, 6))

"""Queries on signals, exits, costs, outcomes, backtests and validation metrics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import execution as ex
from ..operators import factors as fx
from ..operators import stats as st
from ..operators import validation as va
from ..sources import tables as tb
from .market import rounded
from .views import with_views

OUT = ["entry_price", "next_open_return", "return_1d", "return_3d", "return_5d", "max_gain", "max_drawdown", "exit_return", "total_pct", "net_return"]


def _signals(spark, d):
    return tb.signals(spark, d)


def _outcomes(spark, d):
    return ex.outcomes(_signals(spark, d), tb.bars(spark, d))


def _ahead(spark, d):
    b = tb.bars(spark, d)
    return ex.forward_bars(ex.signal_index(_signals(spark, d), b), b, 5, 10)


def _future(spark, d):
    return ex.with_future(_signals(spark, d).select("signal_id", "code", "signal_date"), tb.bars(spark, d), 15)


def j11_forward_bars(spark, d):
    """The 15 bars after each signal."""
    return rounded(_ahead(spark, d).select("signal_id", F.col("step").cast("bigint").alias("step"), "trade_date", "close", "prev_close"), "close", "prev_close")


def x16_costs(spark, d):
    """Cost components of every bar under three scenarios."""
    c = ex.cost_scenarios(ex.with_costs(tb.bars(spark, d).select("code", "trade_date", "turnover")))
    return rounded(c, "slippage_pct", "impact_pct", "total_pct")


def x16_quantities(spark, d):
    """Whole lots for the target weight at the close."""
    return ex.with_order_quantity(tb.bars(spark, d).select("code", "trade_date", "close"), "close")


def x17_exits(spark, d):
    """Stop, take-profit, trailing stop or term for every signal."""
    e = ex.with_exit(_future(spark, d)).where("exit is not null").select("signal_id", "exit.*")
    return rounded(e.select("signal_id", "exit_price", "exit_reason", "exit_days"), "exit_price")


def x18_outcomes(spark, d):
    """Labelled signals."""
    return rounded(_outcomes(spark, d), *OUT)


def x20_rolling_backtest(spark, d):
    """Equity of the rolling top-10 backtest over the last 80 dates."""
    return rounded(bt.rolling_backtest(tb.bars(spark, d)), "period_return", "avg_cost", "nav", "drawdown")


def x20_backtest_metrics(spark, d):
    """Its metrics."""
    m = bt.backtest_metrics(bt.rolling_backtest(tb.bars(spark, d)))
    return rounded(m, "avg_period_return", "win_rate", "total_return", "max_drawdown", "best_period", "worst_period")


def x21_weight_search(spark, d):
    """Objective of five weight vectors in one job."""
    cols = ["ret_5d", "ret_20d", "ma20_gap"]
    rows = [("base", 0.2, 0.25, 0.14), ("short", 0.4, 0.1, 0.14), ("long", 0.1, 0.5, 0.14), ("trend", 0.1, 0.1, 0.5), ("reversal", -0.4, 0.0, 0.0)]
    weights = spark.createDataFrame(rows, "candidate string, ret_5d double, ret_20d double, ma20_gap double")
    b = tb.bars(spark, d)
    f = fx.with_factors(b).select("code", "trade_date", *cols)
    t = bt.trades(b).select("code", "trade_date", "net_return").join(f, ["code", "trade_date"])
    return rounded(bt.candidate_weights_objective(t, weights, cols, 3), "avg_return", "win_rate", "q25")


def x32_exit_policies(spark, d):
    """Three exit policies on the same signals."""
    out, policies = _future(spark, d), (ex.ExitPolicy("tight", 3, 2.0, 4.0, 2.0), ex.ExitPolicy("default"), ex.ExitPolicy("loose", 5, 9.0, 15.0, 8.0))
    for p in policies:
        out = ex.with_exit(out, p).withColumnRenamed("exit", p.name)
    out = out.select(F.explode(F.array(*[F.struct(F.lit(p.name).alias("policy"), F.col(p.name).alias("exit")) for p in policies])).alias("x")).where("x.exit is not null").select("x.policy", "x.exit.*")
    g = out.groupBy("policy", "exit_reason").agg(F.count("*").alias("n"), F.avg("exit_return").alias("avg_return"), F.min("exit_return").alias("worst"))
    return rounded(g, "avg_return", "worst")


def w15_walk_forward(spark, d):
    """Dates of train and test in four purged folds."""
    return bt.walk_forward(tb.bars(spark, d)).groupBy("fold", "part").agg(F.count("*").alias("days"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))


def _samples(spark, d):
    b = tb.bars(spark, d)
    return bt.trades(b).select("code", "trade_date", "net_return").join(fx.with_factors(b).select("code", "trade_date", "ret_5d", "ma20_gap", "volatility_20d", "breakout_20d"), ["code", "trade_date"])


def a4_daily_ic(spark, d):
    """Rank IC by date and factor."""
    return rounded(va.daily_rank_ic(_samples(spark, d), ["ret_5d", "ma20_gap", "volatility_20d", "breakout_20d"], "net_return", "trade_date"), "ic", digits=5)


def a5_ic_summary(spark, d):
    """IC summary by factor."""
    g = va.ic_summary(va.daily_rank_ic(_samples(spark, d), ["ret_5d", "ma20_gap", "volatility_20d"], "net_return", "trade_date"), "trade_date")
    return rounded(g, "ic_mean", "icir", "positive_rate", "ic_20", "ic_60", "ic_120", digits=5)


def a7_strategy_metrics(spark, d):
    """Primary and backup measures by strategy."""
    return rounded(va.strategy_metrics(_outcomes(spark, d), 2), "primary_avg_net", "primary_win_low", "backup_avg_net", "backup_win_low")


def a8_daily_metrics(spark, d):
    """Measures by signal date."""
    g = va.daily_metrics(_outcomes(spark, d), ["signal_date"])
    return rounded(g, *[c for c in g.columns if c not in ("signal_date", "sample_count")])


def a10_top_k(spark, d):
    """Sensitivity to K."""
    return rounded(va.top_k_sensitivity(_outcomes(spark, d), (1, 2, 3)), "avg_daily_net", "win_rate", "max_drawdown", digits=5)


def a12_status_counts(spark, d):
    """Signals by state and strategy."""
    return rounded(va.status_counts(_outcomes(spark, d)), "coverage_pct")


def a15_score_buckets(spark, d):
    """Outcomes by score bucket."""
    return rounded(va.score_buckets(_outcomes(spark, d)), "win_rate", "avg_net", "avg_drawdown")


def a16_meta_labels(spark, d):
    """Win confidence and label of each settled signal."""
    return rounded(va.meta_labels(_outcomes(spark, d)), "confidence")


def a17_calibration(spark, d):
    """Monotone win probability by score bucket and strategy."""
    o = _outcomes(spark, d).where("state = 'settled'").withColumn("win", F.col("net_return") > 0)
    return rounded(st.isotonic_buckets(o, ["strategy"], "score", "win"), "win_rate", "probability", "low", "high")


def a18_stress(spark, d):
    """Three scenarios of bad weeks."""
    s = spark.createDataFrame([("a", date(1996, 1, 1), date(1996, 3, 31)), ("a", date(1996, 3, 1), date(1996, 4, 30)), ("b", date(1997, 6, 1), date(1997, 9, 30)), ("c", date(2000, 1, 1), date(2000, 12, 31))], "scenario string, from_date date, to_date date")
    return rounded(va.stress_test(_outcomes(spark, d), s), "win_rate", "avg_net", "worst", "total")


def a23_ranked_groups(spark, d):
    """Daily top five by factor against the day's median."""
    return rounded(va.ranked_group_metrics(_samples(spark, d), "trade_date", "ret_5d", "net_return"), "avg_return", "avg_excess", "win_rate", "excess_win_rate", "median_return", "q25_return", "sortino")


def a24_time_weighted(spark, d):
    """Time-weighted win rate by strategy."""
    o = _outcomes(spark, d).where("state = 'settled'")
    return rounded(va.time_weighted_win_rate(o, ["strategy"], "signal_date", "net_return", "2001-12-31"), "win_rate", "weighted_return")


def a33_gates(spark, d):
    """Promotion status by strategy."""
    return va.promotion_gates(va.strategy_metrics(_outcomes(spark, d), 2), 300, 60)


def q1_intervals(spark, d):
    """Mean intervals of net returns."""
    return rounded(st.mean_interval(_outcomes(spark, d).where("state = 'settled'"), ["strategy"], "net_return"), "mean", "low", "high")


def _daily(spark, d):
    o = _outcomes(spark, d).where("state = 'settled'")
    return o.groupBy("strategy", "signal_date").agg(F.avg("net_return").alias("r"))


def q2_bootstrap(spark, d):
    """Block-bootstrap interval of the daily mean by strategy."""
    return rounded(st.bootstrap_interval(_daily(spark, d), "strategy", "signal_date", "r", 1000), "low", "high")


def q3_bootstrap_p(spark, d):
    """Bootstrap p-value of a positive mean."""
    return rounded(st.bootstrap_p_value(_daily(spark, d), "strategy", "signal_date", "r", 1000), "observed", "p_value")


def q4_fdr(spark, d):
    """Benjamini-Hochberg over codes' sign tests, by market half."""
    o = _outcomes(spark, d).where("state = 'settled'").groupBy("code").agg(F.count("*").alias("n"), F.avg((F.col("net_return") > 0).cast("double")).alias("w"))
    p = o.withColumn("p", F.round(st.normal_cdf((0.5 - F.col("w")) * 2 * F.sqrt("n")), 9)).withColumn("half", F.col("code") % 2)
    return rounded(st.benjamini_hochberg(p, ["half"], "p", ["code"]).select("half", "code", "p", "bh_rank", "adjusted_p", "rejected"), "adjusted_p")


def q6_deflated_sharpe(spark, d):
    """Deflated Sharpe ratio of daily returns by strategy, five trials."""
    return rounded(st.deflated_sharpe(_daily(spark, d), ["strategy"], "r", 5), "mean", "sharpe", "skewness", "kurtosis", "z", "probability", digits=5)


def w8_nav(spark, d):
    """Net asset value and drawdown by strategy."""
    return rounded(st.net_asset_value(_daily(spark, d), ["strategy"], "signal_date", "r"), "r", "nav", "peak", "drawdown", digits=5)


def w14_weighted_quantile(spark, d):
    """Turnover-weighted median close by code."""
    return rounded(st.weighted_quantile(tb.bars(spark, d), ["code"], "close", "volume", 0.5), "quantile")


QUERIES = [j11_forward_bars, x16_costs, x16_quantities, x17_exits, x18_outcomes, x20_rolling_backtest, x20_backtest_metrics, x21_weight_search, x32_exit_policies, w15_walk_forward, a4_daily_ic, a5_ic_summary, a7_strategy_metrics, a8_daily_metrics, a10_top_k, a12_status_counts, a15_score_buckets, a16_meta_labels, a17_calibration, a18_stress, a23_ranked_groups, a24_time_weighted, a33_gates, q1_intervals, q2_bootstrap, q3_bootstrap_p, q4_fdr, q6_deflated_sharpe, w8_nav, w14_weighted_quantile]


def _r(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


_SLIP = "CASE WHEN turnover >= 1e9 THEN 0.05::DOUBLE WHEN turnover >= 3e8 THEN 0.12::DOUBLE WHEN turnover >= 1e8 THEN 0.25::DOUBLE ELSE 0.45::DOUBLE END"
_IMPACT = "CASE WHEN turnover > 0 THEN least(5.0::DOUBLE, 0.1::DOUBLE * sqrt(200000.0::DOUBLE / turnover) * 100) ELSE 0 END"
_TRADES = f"""
, tr AS (SELECT f.code, f.trade_date, f.bar_no, f.ret_5d * 0.20::DOUBLE + f.ret_10d * 0.22::DOUBLE + f.ret_20d * 0.25::DOUBLE + f.ma20_gap * 0.14::DOUBLE + f.vol_amount_5d * 2.0::DOUBLE + f.breakout_20d * 4.0::DOUBLE + f.volatility_20d * -0.35::DOUBLE AS signal,
  (x.ex / f.close - 1) * 100 - (0.25::DOUBLE + {_SLIP}) AS net_return, 0.25::DOUBLE + {_SLIP} AS cost_pct
  FROM factors f JOIN (SELECT code, trade_date, lead(close, 3) OVER (PARTITION BY code ORDER BY trade_date) AS ex FROM bars) x USING (code, trade_date) WHERE f.bar_no > 30 AND x.ex > 0)"""
_EQUITY = _TRADES + """
, pick AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY signal DESC, code) AS rank FROM tr WHERE trade_date IN (SELECT DISTINCT trade_date FROM tr ORDER BY 1 DESC LIMIT 80) QUALIFY rank <= 10),
day AS (SELECT trade_date, count(*) AS holdings, avg(net_return) AS period_return, avg(cost_pct) AS avg_cost FROM pick GROUP BY trade_date),
nav AS (SELECT *, exp(sum(ln(1 + period_return / 100)) OVER (ORDER BY trade_date)) AS nav FROM day),
eq AS (SELECT *, least(0, (nav / greatest(1, max(nav) OVER (ORDER BY trade_date)) - 1) * 100) AS drawdown FROM nav)"""
_SAMPLES = _TRADES + ", sm AS (SELECT tr.code, tr.trade_date, net_return, ret_5d, ma20_gap, volatility_20d, breakout_20d FROM tr JOIN factors USING (code, trade_date))"
# tr uses 30 bars and the factors of the samples 120; for the columns used here both are the same.
_IC = _SAMPLES + """
, lg AS (SELECT * FROM (UNPIVOT (SELECT trade_date, net_return AS r, ret_5d, ma20_gap, volatility_20d, breakout_20d FROM sm) ON ret_5d, ma20_gap, volatility_20d, breakout_20d INTO NAME factor VALUE v) WHERE abs(v) > 1e-12),
rk AS (SELECT *, rank() OVER (PARTITION BY factor, trade_date ORDER BY v) + (count(*) OVER (PARTITION BY factor, trade_date, v) - 1) / 2 AS a, rank() OVER (PARTITION BY factor, trade_date ORDER BY r) + (count(*) OVER (PARTITION BY factor, trade_date, r) - 1) / 2 AS b FROM lg),
ic AS (SELECT factor, trade_date, count(*) AS n, CASE WHEN min(a) = max(a) OR min(b) = max(b) THEN 0 ELSE corr(a, b) END AS ic FROM rk GROUP BY factor, trade_date HAVING count(*) >= 3)"""
_DAILY = ", day AS (SELECT strategy, signal_date, avg(net_return) AS r FROM settled GROUP BY ALL)"

ORACLES = {
    "q2_bootstrap": with_views(["settled"], """, d AS (SELECT strategy, signal_date, avg(net_return) AS r FROM settled GROUP BY ALL),
v AS (SELECT strategy, avg(r) AS observed, list(r ORDER BY signal_date) AS v, count(*) AS n, greatest(1, CAST(round(sqrt(count(*))) AS BIGINT)) AS width FROM d WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
b AS (SELECT *, unnest(range(0, CAST(ceil(n / width) AS BIGINT))) AS b FROM v, (SELECT unnest(range(1000)) AS draw)),
s AS (SELECT *, ('0x' || substr(md5('20260713:' || strategy || ':' || draw || ':' || b), 1, 8))::BIGINT % (n - width + 1) AS start FROM b),
m AS (SELECT strategy, draw, any_value(observed) AS observed, sum(list_sum(v[start + 1 : start + least(width, n - b * width)])) / any_value(n) AS m FROM s GROUP BY ALL)
SELECT strategy, round(list_sort(list(m))[26], 6) AS low, round(list_sort(list(m))[976], 6) AS high FROM m GROUP BY 1"""),
    "q3_bootstrap_p": with_views(["settled"], """, d AS (SELECT strategy, signal_date, avg(net_return) AS r FROM settled GROUP BY ALL),
v AS (SELECT strategy, avg(r) AS observed, list(r ORDER BY signal_date) AS v, count(*) AS n, greatest(1, CAST(round(sqrt(count(*))) AS BIGINT)) AS width FROM d WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
b AS (SELECT *, unnest(range(0, CAST(ceil(n / width) AS BIGINT))) AS b FROM v, (SELECT unnest(range(1000)) AS draw)),
s AS (SELECT *, ('0x' || substr(md5('20260714:' || strategy || ':' || draw || ':' || b), 1, 8))::BIGINT % (n - width + 1) AS start FROM b),
m AS (SELECT strategy, draw, any_value(observed) AS observed, sum(list_sum(v[start + 1 : start + least(width, n - b * width)])) / any_value(n) AS m FROM s GROUP BY ALL)
SELECT strategy, round(any_value(observed), 6) AS observed, round(CASE WHEN any_value(observed) <= 0 THEN 1.0::DOUBLE ELSE (count(*) FILTER (m - observed >= observed) + 1) / 1001.0::DOUBLE END, 6) AS p_value FROM m GROUP BY 1"""),
    "j11_forward_bars": with_views(["ahead"], f"SELECT signal_id, step, trade_date, {_r('close', 'prev_close')} FROM ahead"),
    "x16_costs": with_views(["bars"], f"SELECT code, trade_date, turnover, s AS scenario, 0.25::DOUBLE AS fee_pct, round({_SLIP} * m, 6) AS slippage_pct, round({_IMPACT} * m, 6) AS impact_pct, round(0.25::DOUBLE + {_SLIP} * m + {_IMPACT} * m, 6) AS total_pct FROM bars, (VALUES ('low', 0.5::DOUBLE), ('base', 1.0::DOUBLE), ('high', 2.0::DOUBLE)) t(s, m)"),
    "x16_quantities": with_views(["bars"], "SELECT code, trade_date, close, 200000.0::DOUBLE AS target_notional, CAST(floor(200000.0::DOUBLE / close / 100) * 100 AS BIGINT) AS order_quantity FROM bars"),
    "x17_exits": with_views(["exits"], f"SELECT signal_id, {_r('exit_price')}, exit_reason, exit_days FROM exits"),
    "x18_outcomes": with_views(["outcomes"], f"SELECT signal_id, strategy, signal_date, code, rank, score, state, {_r('entry_price', 'next_open_return', 'return_1d', 'return_3d', 'return_5d', 'max_gain', 'max_drawdown')}, hit_3pct, hit_5pct, CASE WHEN state = 'settled' THEN exit_reason END AS exit_reason, CASE WHEN state = 'settled' THEN exit_days END AS exit_days, CASE WHEN state = 'settled' THEN round(exit_return, 6) END AS exit_return, round(total_pct, 6) AS total_pct, CASE WHEN state = 'settled' THEN round(exit_return - total_pct, 6) END AS net_return FROM outcomes"),
    "x20_rolling_backtest": with_views(["factors"], _EQUITY + f" SELECT trade_date, holdings, {_r('period_return', 'avg_cost', 'nav', 'drawdown')} FROM eq", 30),
    "x20_backtest_metrics": with_views(["factors"], _EQUITY + " SELECT count(*) AS period_count, round(avg(period_return), 6) AS avg_period_return, round(avg(CASE WHEN period_return > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS win_rate, round((arg_max(nav, trade_date) - 1) * 100, 6) AS total_return, round(min(drawdown), 6) AS max_drawdown, round(max(period_return), 6) AS best_period, round(min(period_return), 6) AS worst_period FROM eq", 30),
    "x21_weight_search": with_views(["factors"], _TRADES + """
, w(candidate, a, b, c) AS (VALUES ('base', 0.2::DOUBLE, 0.25::DOUBLE, 0.14::DOUBLE), ('short', 0.4::DOUBLE, 0.1::DOUBLE, 0.14::DOUBLE), ('long', 0.1::DOUBLE, 0.5::DOUBLE, 0.14::DOUBLE), ('trend', 0.1::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE), ('reversal', -0.4::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE)),
sc AS (SELECT candidate, trade_date, net_return, row_number() OVER (PARTITION BY candidate, trade_date ORDER BY 0.0::DOUBLE + ret_5d * a + ret_20d * b + ma20_gap * c DESC, tr.code) AS rank FROM tr JOIN factors USING (code, trade_date), w),
dy AS (SELECT candidate, trade_date, avg(net_return) AS r FROM sc WHERE rank <= 3 GROUP BY ALL)
SELECT candidate, count(*) AS days, round(avg(r), 6) AS avg_return, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS win_rate, round(quantile_cont(r, 0.25), 6) AS q25 FROM dy GROUP BY candidate"""),
    "w15_walk_forward": with_views(["bars"], """
, dd AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM bars)),
ff AS (SELECT *, n - (4 - fold) * 20 + 1 AS st FROM dd, (SELECT unnest(range(4)) AS fold))
SELECT fold, part, count(*) AS days, min(trade_date) AS first, max(trade_date) AS last FROM (SELECT *, CASE WHEN i >= st AND i < st + 20 THEN 'test' WHEN i < st - 5 THEN 'train' END AS part FROM ff) WHERE part IS NOT NULL GROUP BY ALL"""),
    "a4_daily_ic": with_views(["factors"], _IC + " SELECT factor, trade_date, n, round(ic, 5) AS ic FROM ic"),
    "a5_ic_summary": with_views(["factors"], _IC + """
, ag AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY trade_date DESC) AS age FROM ic WHERE factor <> 'breakout_20d')
SELECT factor, count(*) AS daily_count, CAST(sum(n) AS BIGINT) AS sample_count, round(avg(ic), 5) AS ic_mean, round(coalesce(avg(ic) / CASE WHEN stddev_samp(ic) > 1e-12 THEN stddev_samp(ic) END, 0), 5) AS icir, round(avg(CASE WHEN round(ic, 9) > 0 THEN 1.0::DOUBLE ELSE 0 END), 5) AS positive_rate,
  round(avg(ic) FILTER (age <= 20), 5) AS ic_20, round(avg(ic) FILTER (age <= 60), 5) AS ic_60, round(avg(ic) FILTER (age <= 120), 5) AS ic_120 FROM ag GROUP BY factor"""),
    "a7_strategy_metrics": with_views(["settled"], """
, g AS (SELECT strategy, count(*) FILTER (rank <= 2) AS np, count(*) FILTER (rank <= 2 AND net_return > 0) AS wp, avg(net_return) FILTER (rank <= 2) AS ap, count(DISTINCT signal_date) FILTER (rank <= 2) AS dp,
  count(*) FILTER (rank > 2) AS nb, count(*) FILTER (rank > 2 AND net_return > 0) AS wb, avg(net_return) FILTER (rank > 2) AS ab, count(DISTINCT signal_date) FILTER (rank > 2) AS db FROM settled GROUP BY strategy)
SELECT strategy, np AS primary_count, round(ap, 6) AS primary_avg_net, round(CASE WHEN np > 0 THEN greatest(0, (wp / np + 1.96::DOUBLE * 1.96 / (2 * np) - 1.96 * sqrt((wp / np * (1 - wp / np) + 1.96::DOUBLE * 1.96 / (4 * np)) / np)) / (1 + 1.96::DOUBLE * 1.96 / np)) * 100 END, 6) AS primary_win_low, dp AS primary_days,
  nb AS backup_count, round(ab, 6) AS backup_avg_net, round(CASE WHEN nb > 0 THEN greatest(0, (wb / nb + 1.96::DOUBLE * 1.96 / (2 * nb) - 1.96 * sqrt((wb / nb * (1 - wb / nb) + 1.96::DOUBLE * 1.96 / (4 * nb)) / nb)) / (1 + 1.96::DOUBLE * 1.96 / nb)) * 100 END, 6) AS backup_win_low, db AS backup_days FROM g"""),
    "a8_daily_metrics": with_views(["settled"], """
SELECT signal_date, count(*) AS sample_count, round(avg(return_1d), 6) AS avg_next_close, round(avg(CASE WHEN return_1d IS NULL THEN NULL WHEN return_1d > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS win_rate_next_close, round(avg(CASE WHEN hit_3pct THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS hit_3pct_rate,
  round(avg(CASE WHEN hit_5pct THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS hit_5pct_rate, round(avg(return_3d), 6) AS avg_hold_3d, round(avg(exit_return), 6) AS avg_exit_return, round(avg(net_return), 6) AS avg_net_return, round(avg(CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS win_rate_net, round(min(max_drawdown), 6) AS worst_drawdown
FROM settled GROUP BY signal_date"""),
    "a10_top_k": with_views(["outcomes"], """
, x AS (SELECT strategy, k, signal_date, count(DISTINCT rank) FILTER (state = 'settled') AS have, avg(exit_return - total_pct) FILTER (state = 'settled') AS r FROM outcomes, (VALUES (1), (2), (3)) t(k) WHERE rank <= k GROUP BY ALL),
f AS (SELECT *, exp(sum(ln(1 + r / 100)) OVER (PARTITION BY strategy, k ORDER BY signal_date)) AS nav FROM x WHERE have = k),
g AS (SELECT *, least(0, (nav / greatest(1, max(nav) OVER (PARTITION BY strategy, k ORDER BY signal_date)) - 1) * 100) AS dd FROM f),
s AS (SELECT strategy, k, count(*) AS incomplete_days FROM x WHERE have < k GROUP BY ALL)
SELECT strategy, CAST(k AS BIGINT) AS k, count(*) AS day_count, round(avg(r), 5) AS avg_daily_net, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 5) AS win_rate, round(min(dd), 5) AS max_drawdown, coalesce(any_value(incomplete_days), 0) AS incomplete_days
FROM g LEFT JOIN s USING (strategy, k) GROUP BY strategy, k"""),
    "a12_status_counts": with_views(["outcomes"], "SELECT strategy, count(*) AS signals, count(*) FILTER (state = 'settled') AS settled, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'no_bars') AS no_bars, round(count(*) FILTER (state = 'settled') / count(*) * 100, 6) AS coverage_pct FROM outcomes GROUP BY strategy"),
    "a15_score_buckets": with_views(["settled"], """
SELECT CASE WHEN score < 45 THEN 45.0::DOUBLE WHEN score < 55 THEN 55 WHEN score < 65 THEN 65 WHEN score < 75 THEN 75 WHEN score < 101 THEN 101 END AS bucket_below, count(*) AS n, round(avg(CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS win_rate, round(avg(net_return), 6) AS avg_net, round(avg(max_drawdown), 6) AS avg_drawdown
FROM settled WHERE score < 101 GROUP BY 1"""),
    "a16_meta_labels": with_views(["settled"], """
, o AS (SELECT *, CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0 END AS win, least(3, CAST(floor(score / 25.0::DOUBLE) AS BIGINT)) AS sb, least(rank, 10) AS rb FROM settled),
c AS (SELECT signal_id, strategy, 0.30::DOUBLE * avg(win) OVER (PARTITION BY strategy) + 0.35::DOUBLE * avg(win) OVER (PARTITION BY strategy, sb) + 0.35::DOUBLE * avg(win) OVER (PARTITION BY strategy, rb) AS p FROM o)
SELECT signal_id, strategy, round(p, 6) AS confidence, CASE WHEN p >= 0.5 THEN 'full' WHEN p >= 0.4 THEN 'reduced' ELSE 'skip' END AS label FROM c"""),
    "a17_calibration": with_views(["settled"], """
, o AS (SELECT *, (rank() OVER (PARTITION BY strategy ORDER BY score) - 1) * 5 // count(*) OVER (PARTITION BY strategy) AS b FROM settled),
q AS (SELECT strategy, b, count(*) AS n, sum(CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0 END) AS wins, min(score) AS low, max(score) AS high FROM o GROUP BY ALL),
r AS (SELECT x.strategy, x.b AS a, z.b AS z, (SELECT sum(wins) / sum(n) FROM q y WHERE y.strategy = x.strategy AND y.b BETWEEN x.b AND z.b) AS av FROM q x JOIN q z ON x.strategy = z.strategy AND x.b <= z.b),
m AS (SELECT q.strategy, q.b, r.a, min(av) AS m FROM q JOIN r ON q.strategy = r.strategy AND r.a <= q.b AND q.b <= r.z GROUP BY ALL)
SELECT q.strategy, CAST(q.b AS BIGINT) AS bucket, round(low, 6) AS low, round(high, 6) AS high, n, round(wins / n, 6) AS win_rate, round(greatest(0.01, least(0.99, max(m.m))), 6) AS probability FROM q JOIN m ON q.strategy = m.strategy AND q.b = m.b GROUP BY q.strategy, q.b, low, high, n, wins"""),
    "a18_stress": with_views(["settled"], """
, z(scenario, f, t) AS (VALUES ('a', DATE '1996-01-01', DATE '1996-03-31'), ('a', DATE '1996-03-01', DATE '1996-04-30'), ('b', DATE '1997-06-01', DATE '1997-09-30'), ('c', DATE '2000-01-01', DATE '2000-12-31')),
o AS (SELECT DISTINCT scenario, signal_id, net_return FROM settled JOIN z ON signal_date BETWEEN f AND t),
g AS (SELECT scenario, count(*) AS n, avg(CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS wr, avg(net_return) AS av, min(net_return) AS worst, sum(net_return) AS total FROM o GROUP BY scenario)
SELECT scenario, n, round(wr, 6) AS win_rate, round(av, 6) AS avg_net, round(worst, 6) AS worst, round(total, 6) AS total, total = min(total) OVER () AS is_worst FROM g"""),
    "a23_ranked_groups": with_views(["factors"], _SAMPLES + """
, k AS (SELECT *, median(net_return) OVER (PARTITION BY trade_date) AS md, row_number() OVER (PARTITION BY trade_date ORDER BY ret_5d DESC, code) AS rk FROM sm)
SELECT count(*) AS n, count(DISTINCT trade_date) AS days, round(avg(net_return), 6) AS avg_return, round(avg(net_return - md), 6) AS avg_excess, round(avg(CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS win_rate, round(avg(CASE WHEN net_return - md > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS excess_win_rate,
  round(median(net_return), 6) AS median_return, round(quantile_cont(net_return, 0.25), 6) AS q25_return, round(avg(net_return) / nullif(sqrt(avg(CASE WHEN net_return < 0 THEN net_return * net_return ELSE 0 END)), 0), 6) AS sortino FROM k WHERE rk <= 5"""),
    "a24_time_weighted": with_views(["settled"], "SELECT strategy, count(*) AS n, round(sum(w * CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0 END) / sum(w) * 100, 6) AS win_rate, round(sum(w * net_return) / sum(w), 6) AS weighted_return FROM (SELECT *, pow(0.5::DOUBLE, greatest(0, date_diff('day', signal_date, DATE '2001-12-31')) / 60.0::DOUBLE) AS w FROM settled) GROUP BY strategy"),
    "a33_gates": with_views(["settled"], """
, g AS (SELECT strategy, count(*) FILTER (rank <= 2) AS np, avg(net_return) FILTER (rank <= 2) AS ap, count(DISTINCT signal_date) FILTER (rank <= 2) AS dp FROM settled GROUP BY strategy),
f AS (SELECT strategy, list_filter([CASE WHEN np < 300 THEN 'samples' END, CASE WHEN dp < 60 THEN 'days' END, CASE WHEN coalesce(ap, -1e9) <= 0 THEN 'net_return' END], lambda x: x IS NOT NULL) AS f FROM g)
SELECT strategy, array_to_string(f, ',') AS blockers, CASE WHEN len(f) = 0 THEN 'ready' ELSE f[1] END AS status, CASE len(f) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS position_scale FROM f"""),
    "q1_intervals": with_views(["settled"], "SELECT strategy, count(net_return) AS n, round(avg(net_return), 6) AS mean, round(avg(net_return) - 1.96::DOUBLE * stddev_samp(net_return) / sqrt(count(*)), 6) AS low, round(avg(net_return) + 1.96::DOUBLE * stddev_samp(net_return) / sqrt(count(*)), 6) AS high FROM settled GROUP BY strategy"),
    "q6_deflated_sharpe": with_views(["settled"], _DAILY + """
, m AS (SELECT *, avg(r) OVER (PARTITION BY strategy) AS mu, stddev_samp(r) OVER (PARTITION BY strategy) AS sd FROM day),
g AS (SELECT strategy, count(*) AS n, any_value(mu) AS mu, any_value(mu) / any_value(sd) AS sh, avg(pow((r - mu) / sd, 3)) AS sk, avg(pow((r - mu) / sd, 4)) AS ku FROM m GROUP BY strategy),
z AS (SELECT *, (sh - 1.192594001014789::DOUBLE / sqrt(n - 1)) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - sk * sh + (ku - 1) / 4 * sh * sh)) AS z FROM g),
c AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM z),
p AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) AS up FROM c)
SELECT strategy, n, round(mu, 5) AS mean, round(sh, 5) AS sharpe, round(sk, 5) AS skewness, round(ku, 5) AS kurtosis, round(z, 5) AS z, round(CASE WHEN z >= 0 THEN 1 - up ELSE up END, 5) AS probability, CASE WHEN z >= 0 THEN 1 - up ELSE up END >= 0.95 AS passed FROM p"""),
    "w8_nav": with_views(["settled"], _DAILY + """
, v AS (SELECT *, exp(sum(ln(1 + r / 100)) OVER (PARTITION BY strategy ORDER BY signal_date)) AS nav FROM day), k AS (SELECT *, greatest(1, max(nav) OVER (PARTITION BY strategy ORDER BY signal_date)) AS peak FROM v)
SELECT strategy, signal_date, round(r, 5) AS r, round(nav, 5) AS nav, round(peak, 5) AS peak, round(least(0, (nav / peak - 1) * 100), 5) AS drawdown FROM k"""),
    "w14_weighted_quantile": with_views(["bars"], "SELECT code, round(min(close), 6) AS quantile FROM (SELECT *, sum(volume) OVER (PARTITION BY code ORDER BY close) AS c, sum(volume) OVER (PARTITION BY code) AS t FROM bars) WHERE c >= 0.5 * t GROUP BY code"),
    "q4_fdr": with_views(["settled"], """
, o AS (SELECT code, count(*) AS n, avg(CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0 END) AS w FROM settled GROUP BY code), z AS (SELECT code, (0.5::DOUBLE - w) * 2 * sqrt(n) AS z FROM o), c AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM z),
u AS (SELECT code, z, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) AS up FROM c),
p AS (SELECT code % 2 AS half, code, round(CASE WHEN z >= 0 THEN 1 - up ELSE up END, 9) AS p FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY half ORDER BY p, code) AS bh_rank, count(*) OVER (PARTITION BY half) AS m FROM p)
SELECT half, code, p, bh_rank, round(least(1, min(p * m / bh_rank) OVER (PARTITION BY half ORDER BY bh_rank DESC)), 6) AS adjusted_p, bh_rank <= coalesce(max(CASE WHEN p <= 0.1 * bh_rank / m THEN bh_rank END) OVER (PARTITION BY half), 0) AS rejected FROM r"""),
}

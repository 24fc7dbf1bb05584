"""Queries on bars, factors, cross-sections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crosssection as cs
from ..operators import factors as fx
from ..operators import filters as ft
from ..sources import tables as tb
from .views import with_views

FLOOR = 3e4  # turnover floor scaled to these tables
FACTOR_LIST = ", ".join(f"round({c}, 6) AS {c}" for c in fx.FACTORS)


def rounded(df, *columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def s8_bars(spark, d):
    """Daily bars."""
    return tb.bars(spark, d)


def w2_factors(spark, d):
    """All rolling factors, 120 bars of look-back."""
    f = fx.with_factors(tb.bars(spark, d))
    return rounded(f.select("code", "trade_date", *fx.FACTORS), *fx.FACTORS)


def w2_factors_window30(spark, d):
    """The same with 30 bars: 60-day factors are unavailable."""
    f = fx.with_factors(tb.bars(spark, d), lookback=30)
    return rounded(f.select("code", "trade_date", "ma60_gap", "ma_bull_aligned", "ma20_gap", "ret_20d"), "ma60_gap", "ma20_gap", "ret_20d")


def w3_shape_factors(spark, d):
    """Wicks, position, amplitude and streaks."""
    f = fx.with_shape_factors(tb.bars(spark, d))
    return rounded(f.select("code", "trade_date", *fx.SHAPE_FACTORS, "up_days", "down_days"), *fx.SHAPE_FACTORS)


def w5_trend_factors(spark, d):
    """Long-trend factors."""
    f = fx.with_trend_factors(tb.bars(spark, d)).select("code", "trade_date", "trend_ret_60d", "trend_ma20_gap", "trend_ma60_gap", "drawdown_60d", "risk_adjusted_momentum", "uptrend", "downtrend")
    return rounded(f, "trend_ret_60d", "trend_ma20_gap", "trend_ma60_gap", "drawdown_60d", "risk_adjusted_momentum")


def s23_latest_factors(spark, d):
    """The newest factor row of each code."""
    f = fx.with_factors(tb.bars(spark, d)).select("code", F.struct("trade_date", *fx.FACTORS).alias("x"))
    return rounded(f.groupBy("code").agg(F.max_by("x", "x.trade_date").alias("x")).select("code", "x.*"), *fx.FACTORS)


def w1_percentiles(spark, d):
    """Percentile scores of three factors by date."""
    f = fx.with_factors(tb.bars(spark, d)).select("code", "trade_date", "ret_5d", "ma20_gap", "volatility_20d")
    p = cs.percentile_scores(f, ["trade_date"], ["ret_5d", "ma20_gap", "volatility_20d"], inverse=("volatility_20d",))
    return rounded(p.select("code", "trade_date", "ret_5d_pct", "ma20_gap_pct", "volatility_20d_pct"), "ret_5d_pct", "ma20_gap_pct", "volatility_20d_pct")


def a1_market_regime(spark, d):
    """Breadth, score and level of every date."""
    g = cs.market_regime(tb.quotes(spark, d))
    return rounded(g, "breadth_pct", "strong_pct", "weak_pct", "avg_pct_chg", "median_pct_chg", "avg_amplitude", "avg_turnover", "score")


def a2_history_breadth(spark, d):
    """Breadth against MA20."""
    return rounded(cs.history_breadth(fx.with_factors(tb.bars(spark, d))), "coverage_pct", "breadth20_pct", "median_ret5", "median_ret20")


def a3_market_leaders(spark, d):
    """Markets of each date by median change."""
    q = tb.quotes(spark, d).withColumn("market", ft.market_type(F.col("code")))
    return rounded(cs.market_leaders(q), "breadth_pct", "median_pct_chg")


def f2_candidates(spark, d):
    """Quotes that pass the hard filters."""
    return rounded(ft.candidates(tb.quotes(spark, d), FLOOR).select("trade_date", "code", "market", "price", "pct_chg"), "price", "pct_chg")


def f3_filter_report(spark, d):
    """Waterfall of the filters by date."""
    return ft.filter_report(tb.quotes(spark, d), ["trade_date"], FLOOR)


def f4_filter_failures(spark, d):
    """All failing rules of each rejected quote."""
    q = tb.quotes(spark, d).withColumn("failures", F.concat_ws(",", ft.failures(FLOOR)))
    return q.where("failures <> ''").select("trade_date", "code", "failures")


def f14_price_limits(spark, d):
    """Days on which a quote could not be bought or sold."""
    up, down = ft.tradable()
    q = tb.quotes(spark, d).withColumn("unbuyable", up).withColumn("unsellable", down)
    return q.groupBy("code").agg(F.count("*").alias("days"), F.sum(F.col("unbuyable").cast("bigint")).alias("unbuyable_days"), F.sum(F.col("unsellable").cast("bigint")).alias("unsellable_days"))


def s10_summary(spark, d):
    """Counts and date range of the bars."""
    return tb.bars(spark, d).agg(F.count("*").alias("bars"), F.countDistinct("code").alias("codes"), F.countDistinct("trade_date").alias("days"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def a19_field_coverage(spark, d):
    """Coverage of quote fields."""
    return rounded(cs.field_coverage(tb.quotes(spark, d), ["price", "prev_close", "industry", "pct_chg"]), "coverage_pct")


def w10_industry_cap(spark, d):
    """Three a date of an industry, ten in all, by turnover."""
    q = cs.capped(tb.quotes(spark, d), ["trade_date"], "industry", [F.desc("turnover"), F.col("id")], 1, 3)
    return q.select("trade_date", "id", "industry", "place")


def w9_round_robin(spark, d):
    """Industries in turn, by turnover."""
    q = cs.round_robin(tb.quotes(spark, d), ["trade_date"], "industry", [F.desc("turnover"), F.col("id")], 5)
    return q.select("trade_date", "id", "industry", "place")


def l3_latest_dates(spark, d):
    """Bars of the latest 20 distinct dates."""
    b = tb.bars(spark, d)
    days = b.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(20)
    return b.join(F.broadcast(days), "trade_date", "left_semi").select("code", "trade_date", "close", "turnover")


QUERIES = [s8_bars, w2_factors, w2_factors_window30, w3_shape_factors, w5_trend_factors, s23_latest_factors, w1_percentiles, a1_market_regime, a2_history_breadth, a3_market_leaders, f2_candidates, f3_filter_report, f4_filter_failures, f14_price_limits, s10_summary, a19_field_coverage, w10_industry_cap, w9_round_robin, l3_latest_dates]

_MARKET = "CASE WHEN substr(code, 1, 3) IN ('688', '689') THEN 'star' WHEN substr(code, 1, 3) IN ('300', '301') THEN 'chinext' ELSE 'main' END"
_RULES = [
    ("unsupported_code", "substr(code, 1, 3) IN ('600','601','603','605','000','001','002','003','300','301','688')"), ("special_treatment", "NOT regexp_matches(name, '(?i)ST|退')"), ("positive_price", "price > 0"), ("min_turnover", "turnover >= 3e4"), ("deep_drop", "pct_chg > -8"), ("max_gain", "pct_chg <= 12"),
    ("buyable_gain", f"pct_chg <= CASE WHEN {_MARKET} = 'main' THEN 6.5 ELSE 10 END"), ("one_word_limit", "NOT (high > 0 AND high = low AND pct_chg > 8)"),
]
_PASS = " AND ".join(f"({c})" for _, c in _RULES)
_FIRST = "CASE " + " ".join(f"WHEN NOT ({c}) THEN '{k}'" for k, c in _RULES) + " ELSE 'passed' END"
_ALL = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({c}) THEN '{k}' END" for k, c in _RULES) + ")"


def _pct(c: str, inverse: bool = False) -> str:
    s = f"100.0::DOUBLE * count(*) OVER (PARTITION BY trade_date ORDER BY {c} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY trade_date)"
    s = f"100 - {s}" if inverse else s
    return f"round(CASE WHEN count(*) OVER (PARTITION BY trade_date) < 2 OR min({c}) OVER (PARTITION BY trade_date) = max({c}) OVER (PARTITION BY trade_date) THEN 50 ELSE {s} END, 6) AS {c}_pct"


_W = "WINDOW w AS (PARTITION BY code ORDER BY trade_date)"
ORACLES = {
    "s8_bars": with_views(["bars"], "SELECT * FROM bars"),
    "w2_factors": with_views(["factors"], f"SELECT code, trade_date, {FACTOR_LIST} FROM factors"),
    "w2_factors_window30": with_views(["factors"], "SELECT code, trade_date, round(ma60_gap, 6) AS ma60_gap, ma_bull_aligned, round(ma20_gap, 6) AS ma20_gap, round(ret_20d, 6) AS ret_20d FROM factors", 30),
    "w3_shape_factors": with_views(["bars"], f"""
, a AS (SELECT *, max(high) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS h20, min(low) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l20,
        (high - low) / lag(close) OVER w * 100 AS amp, coalesce(sign(close - lag(close) OVER w), 0) AS dir FROM bars {_W}),
i AS (SELECT *, avg(amp) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS amp5, CASE WHEN lag(dir) OVER w = dir THEN 0 ELSE 1 END AS fresh FROM a {_W}),
s AS (SELECT *, sum(fresh) OVER (w ROWS UNBOUNDED PRECEDING) AS island FROM i {_W}),
r AS (SELECT *, row_number() OVER (PARTITION BY code, island ORDER BY trade_date) AS run FROM s)
SELECT code, trade_date, round((close / ((high + low + close) / 3) - 1) * 100, 6) AS close_vs_typical_price,
  round(CASE WHEN high > low THEN (high - greatest(open, close)) / (high - low) ELSE 0 END, 6) AS upper_wick_ratio, round(CASE WHEN high > low THEN (least(open, close) - low) / (high - low) ELSE 0 END, 6) AS lower_wick_ratio,
  round(CASE WHEN h20 > l20 THEN (close - l20) / (h20 - l20) * 100 ELSE 50 END, 6) AS price_position_20d, round(coalesce(amp5, 0), 6) AS amplitude_5d_mean,
  CAST(CASE WHEN dir > 0 THEN run ELSE 0 END AS BIGINT) AS up_days, CAST(CASE WHEN dir < 0 THEN run ELSE 0 END AS BIGINT) AS down_days FROM r"""),
    "w5_trend_factors": with_views(["bars"], f"""
, a AS (SELECT *, row_number() OVER w AS bar_no, close / lag(close) OVER w - 1 AS r1, lag(close, 20) OVER w AS p20, lag(close, 60) OVER w AS p60, avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m20,
        avg(close) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m60, max(close) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS peak FROM bars {_W}),
b AS (SELECT *, stddev_samp(r1) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd FROM a {_W})
SELECT code, trade_date, round(coalesce((close / p60 - 1) * 100, 0), 6) AS trend_ret_60d, round((close / m20 - 1) * 100, 6) AS trend_ma20_gap, round(CASE WHEN bar_no >= 60 THEN (close / m60 - 1) * 100 ELSE 0 END, 6) AS trend_ma60_gap,
  round((close / peak - 1) * 100, 6) AS drawdown_60d, round(coalesce((close / p20 - 1) * 100 / nullif(sd * 100, 0), 0), 6) AS risk_adjusted_momentum, (close / m20 - 1) * 100 > 0 AND round(m20 - m60, 9) > 0 AS uptrend, (close / m20 - 1) * 100 < 0 AND round(m20 - m60, 9) < 0 AS downtrend
FROM b WHERE bar_no >= 25"""),
    "s23_latest_factors": with_views(["factors"], f"SELECT code, trade_date, {FACTOR_LIST} FROM factors QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1"),
    "w1_percentiles": with_views(["factors"], f"SELECT code, trade_date, {_pct('ret_5d')}, {_pct('ma20_gap')}, {_pct('volatility_20d', True)} FROM factors"),
    "a1_market_regime": with_views(["quotes"], """
, g AS (SELECT trade_date, count(*) AS sample_count, count(*) FILTER (pct_chg > 0) AS up_count, count(*) FILTER (pct_chg < 0) AS down_count, count(*) FILTER (pct_chg >= 9.5) AS limit_up_count, count(*) FILTER (pct_chg <= -9.5) AS limit_down_count,
  avg(CASE WHEN pct_chg > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS breadth_pct, avg(CASE WHEN pct_chg >= 3 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS strong_pct, avg(CASE WHEN pct_chg <= -3 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS weak_pct,
  avg(pct_chg) AS avg_pct_chg, median(pct_chg) AS median_pct_chg, avg(amplitude) AS avg_amplitude, avg(turnover) AS avg_turnover FROM quotes GROUP BY trade_date),
s AS (SELECT *, greatest(0, least(100, 50 + median_pct_chg * 7.5::DOUBLE + (breadth_pct - 50) * 0.55::DOUBLE + (strong_pct - weak_pct) * 0.35::DOUBLE - greatest(0, avg_amplitude - 7) * 2.4::DOUBLE)) AS sc FROM g)
SELECT trade_date, sample_count, up_count, down_count, limit_up_count, limit_down_count, round(breadth_pct, 6) AS breadth_pct, round(strong_pct, 6) AS strong_pct, round(weak_pct, 6) AS weak_pct, round(avg_pct_chg, 6) AS avg_pct_chg,
  round(median_pct_chg, 6) AS median_pct_chg, round(avg_amplitude, 6) AS avg_amplitude, round(avg_turnover, 6) AS avg_turnover, round(sc, 6) AS score, CASE WHEN sc >= 68 THEN 'risk_on' WHEN sc <= 42 THEN 'risk_off' ELSE 'balanced' END AS level FROM s"""),
    "a2_history_breadth": with_views(["factors"], """
SELECT trade_date, count(*) FILTER (abs(ma20_gap) > 1e-12) AS ready_count, round(avg(CASE WHEN abs(ma20_gap) > 1e-12 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS coverage_pct,
  round(coalesce(avg(CASE WHEN ma20_gap > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (abs(ma20_gap) > 1e-12) * 100, 0), 6) AS breadth20_pct, round(coalesce(median(ret_5d) FILTER (abs(ma20_gap) > 1e-12), 0), 6) AS median_ret5,
  round(coalesce(median(ret_20d) FILTER (abs(ma20_gap) > 1e-12), 0), 6) AS median_ret20 FROM factors GROUP BY trade_date"""),
    "a3_market_leaders": with_views(["quotes"], f"""
, g AS (SELECT trade_date, market, avg(CASE WHEN pct_chg > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS b, median(pct_chg) AS m, count(*) AS count FROM (SELECT *, {_MARKET} AS market FROM quotes) GROUP BY ALL)
SELECT trade_date, market, round(b, 6) AS breadth_pct, round(m, 6) AS median_pct_chg, count, row_number() OVER (PARTITION BY trade_date ORDER BY m DESC, b DESC, market) AS place FROM g"""),
    "f2_candidates": with_views(["quotes"], f"SELECT trade_date, code, {_MARKET} AS market, round(price, 6) AS price, round(pct_chg, 6) AS pct_chg FROM quotes WHERE {_PASS}"),
    "f3_filter_report": with_views(["quotes"], f"SELECT trade_date, {_FIRST} AS reason, count(*) AS n FROM quotes GROUP BY ALL"),
    "f4_filter_failures": with_views(["quotes"], f"SELECT * FROM (SELECT trade_date, code, {_ALL} AS failures FROM quotes) WHERE failures <> ''"),
    "f14_price_limits": with_views(["quotes"], f"""
, l AS (SELECT *, CASE WHEN {_MARKET} = 'main' THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END AS lim FROM quotes)
SELECT code, count(*) AS days, count(*) FILTER (prev_close > 0 AND open >= prev_close * (1 + lim / 100) * 0.995::DOUBLE AND low >= prev_close * (1 + lim / 100) * 0.995::DOUBLE) AS unbuyable_days,
  count(*) FILTER (prev_close > 0 AND high <= prev_close * (1 - lim / 100) * 1.01::DOUBLE AND low <= prev_close * (1 - lim / 100) * 1.005::DOUBLE AND price <= prev_close * (1 - lim / 100) * 1.01::DOUBLE) AS unsellable_days FROM l GROUP BY code"""),
    "s10_summary": with_views(["bars"], "SELECT count(*) AS bars, count(DISTINCT code) AS codes, count(DISTINCT trade_date) AS days, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars"),
    "a19_field_coverage": with_views(["quotes"], " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS present, count(*) AS total, round(count({c}) / count(*) * 100, 6) AS coverage_pct FROM quotes" for c in ("price", "prev_close", "industry", "pct_chg"))),
    "w10_industry_cap": with_views(["quotes"], """
, a AS (SELECT *, row_number() OVER (PARTITION BY trade_date, industry ORDER BY turnover DESC, id) AS seat FROM quotes)
SELECT trade_date, id, industry, row_number() OVER (PARTITION BY trade_date ORDER BY turnover DESC, id) AS place FROM a WHERE seat <= 1 QUALIFY place <= 3"""),
    "w9_round_robin": with_views(["quotes"], """
, a AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY turnover DESC, id) AS rk FROM quotes),
b AS (SELECT *, row_number() OVER (PARTITION BY trade_date, industry ORDER BY rk) AS seat, min(rk) OVER (PARTITION BY trade_date, industry) AS best FROM a)
SELECT trade_date, id, industry, row_number() OVER (PARTITION BY trade_date ORDER BY seat, best) AS place FROM b QUALIFY place <= 5"""),
    "l3_latest_dates": with_views(["bars"], "SELECT code, trade_date, close, turnover FROM bars WHERE trade_date IN (SELECT DISTINCT trade_date FROM bars ORDER BY 1 DESC LIMIT 20)"),
}

"""Queries on scores and on the live side; the streams run over what is there and are compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import crosssection as cs
from ..operators import factors as fx
from ..operators import scoring as sc
from ..operators import strategies as st
from ..operators import tomorrow as tm
from ..sources import tables as tb
from ..streaming import live as lv
from .market import FLOOR, rounded
from .views import with_views


def _rows(spark, d, more=()):
    """Quotes with factors, regime and stand-ins for the fields that the tables lack: lines are shuffled once by code, rows once by date."""
    kept = ("ret_3d", "ret_5d", "ret_10d", "ret_20d", "ma5_gap", "ma20_gap", "vol_amount_5d", "volatility_20d", "breakout_20d", "vol_ma5_ratio", *more)
    q = tb.quotes(spark, d, fx.with_factors(tb.bars(spark, d), least_bars=None), ("bar_no", *kept))
    j = cs.with_market_level(q).where("bar_no >= 6 and price > 0 and trade_date is not null").drop("bar_no").withColumnRenamed("vol_ma5_ratio", "volume_ratio")
    prefix = F.substring(tb.code_text(F.col("id")), 1, 3)
    j = j.withColumn("market", F.when(prefix == "688", "star").when(prefix == "300", "chinext").otherwise("main"))
    return j.withColumn("turnover_rate", F.col("volume") / 4).withColumn("speed", F.col("pct_chg") / 4).withColumn("sixty_day_pct", F.col("ret_20d") * 3).withColumn("ytd_pct", F.col("ret_20d") * 5)


def x7_step_scores(spark, d):
    """Step scores of every quote."""
    x = _rows(spark, d).select("id", "trade_date", sc.close_location(F.col("price"), F.col("high"), F.col("low")).alias("location"), sc.execution_score().alias("execution"), sc.not_overextended().alias("not_overextended"), sc.overheat_damp().alias("damp"), sc.tail_setup_score().alias("tail_setup"), sc.regime_bonus("short", FLOOR).alias("bonus"), sc.hot_rank_score(F.col("id") * 3).alias("hot"))
    return rounded(x, "location", "not_overextended", "damp", "tail_setup", "bonus")


def x8_penalties(spark, d):
    """Smooth penalties of the swing strategy."""
    p = sc.with_penalty(_rows(spark, d), "swing")
    return rounded(p.select("id", "trade_date", "risk_penalty", F.col("risk_penalty_parts")["volatility"].alias("volatility_part")), "risk_penalty", "volatility_part")


def x3_today_scores(spark, d):
    """Today's score from percentile components, penalty and regime."""
    x = cs.percentile_scores(_rows(spark, d), ["trade_date"], ["pct_chg", "speed", "volume_ratio", "ret_3d", "ret_5d", "vol_amount_5d", "turnover_rate", "turnover"], key=("id", "trade_date"))
    m = F.col("pct_chg_pct") * 0.28 + F.col("speed_pct") * 0.24 + F.col("volume_ratio_pct") * 0.18 + F.col("ret_3d_pct") * 0.12 + F.col("ret_5d_pct") * 0.10 + F.col("vol_amount_5d_pct") * 0.08
    x = sc.with_penalty(x.withColumn("momentum_score", m).withColumn("liquidity_score", F.col("turnover_rate_pct") * 0.45 + F.col("turnover_pct") * 0.55).withColumn("industry_score", F.lit(50.0)).withColumn("sentiment_score", F.lit(50.0)), "swing")
    x = x.withColumn("risk_guard_score", F.greatest(F.lit(0.0), 100 - F.col("risk_penalty") * 3.2)).withColumn("regime_bonus", sc.regime_bonus("short", FLOOR))
    return rounded(sc.with_final_score(x, "today").select("id", "trade_date", "base_score", "score"), "base_score", "score")


def x5_swing_candidates(spark, d):
    """Scores of every row of the swing universe, and who is shown in which tier."""
    # Every third code's history counts as too short, so that the two kinds of rows stand side by side on every date.
    x = _rows(spark, d).withColumn("factor_ready", ((F.abs("ma20_gap") > 1e-12) & (F.col("id") % 3 != 0)).cast("int"))
    x = st.swing_candidates(x, ["trade_date"], ("id", "trade_date"), FLOOR)
    return rounded(x.select("id", "trade_date", "momentum_score", "trend_score", "base_score", "score", "degraded", "place", "tier"), "momentum_score", "trend_score", "base_score", "score")


TOMORROW_NUMBERS = ("open", "high", "low", "price", "pct_chg", "amplitude", "turnover", "turnover_rate", "volume_ratio", "speed", "sixty_day_pct", "ytd_pct", "ret_5d", "ret_10d", "ret_20d", "ma20_gap", "vol_amount_5d", "volatility_20d", "breakout_20d")


def _tomorrow_rows(spark, d):
    """Rows of the next-day strategy: every fifth code's history too short, themes from the nations' regions, calmer turnover rates."""
    x = _rows(spark, d, ("ma_bull_aligned",)).withColumn("factor_ready", ((F.abs("ma20_gap") > 1e-12) & (F.col("id") % 5 != 0)).cast("int")).withColumn("turnover_rate", F.col("volume") / 8).withColumn("speed", F.col("pct_chg") / 6)
    region = tb.read(spark, d, "nation").select(F.col("n_name").alias("industry"), F.when(F.col("n_regionkey") != 3, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("theme"))
    return x.join(region, "industry").select("id", "trade_date", "industry", "theme", "level", "market", "factor_ready", "ma_bull_aligned", *TOMORROW_NUMBERS)


def x4_tomorrow_scores(spark, d):
    """Reject reasons, components, penalty and both scores of every row of the next-day strategy."""
    x = tm.tomorrow_scores(_tomorrow_rows(spark, d), ["trade_date"], ("id", "trade_date"), FLOOR)
    return rounded(x.select("id", "trade_date", "reject", "backup_reject", "liquidity_score", "momentum_score", "trend_score", "historical_edge_score", "tail_setup_score", "risk_penalty", "score", "backup_score"), "liquidity_score", "momentum_score", "trend_score", "historical_edge_score", "risk_penalty", digits=5)


def x4_tomorrow_candidates(spark, d):
    """Who is shown for the next day, in which tier, and what keeps the others from being primary."""
    breadth = cs.history_breadth(fx.with_factors(tb.bars(spark, d)))
    return tm.tomorrow_candidates(_tomorrow_rows(spark, d), breadth, "trade_date", "id", FLOOR)


def x11_ensemble(spark, d):
    """Blend of five model scores on orders."""
    o = tb.read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 101).cast("double").alias("price_volume"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_custkey") % 90).cast("double")).alias("expected_return"), F.lit(None).cast("double").alias("event"), (F.col("o_custkey") % 130).cast("double").alias("probability"), (F.col("o_orderkey") % 7 * 10).cast("double").alias("meta"))
    return rounded(sc.ensemble(o).select("o_orderkey", "ensemble_score", "dispersion", "agreement"), "ensemble_score", "agreement")


def x12_merge_external(spark, d):
    """Local scores blended with external ones, and the ranking."""
    s = tb.signals(spark, d).select("strategy", "signal_date", F.col("signal_id").alias("code"), "score", (F.col("code") % 7).cast("double").alias("risk_penalty"))
    e = s.where("code % 3 = 0").select("strategy", "signal_date", "code", (100 - F.col("score")).alias("score"), (F.col("code") % 40).cast("double").alias("penalty"), (F.col("code") % 5 == 0).alias("veto"))
    return rounded(sc.merge_external(s, e, ["strategy", "signal_date", "code"]).select("code", "final_score", "veto", "place"), "final_score")


def t1_latest_quotes(spark, d):
    """Newest tick of each code, streamed."""
    return lv.drain(lv.latest_quotes(lv.tick_stream(spark, d)), "latest")


def t3_freeze(spark, d):
    """Ticks before and after 14:50, streamed."""
    return lv.drain(lv.frozen(lv.tick_stream(spark, d), "14:50"), "freeze")


def t4_phases(spark, d):
    """Ticks by phase, streamed."""
    return lv.drain(lv.phases(lv.tick_stream(spark, d)), "phases")


def t5_breadth(spark, d):
    """Hourly breadth, streamed."""
    return rounded(lv.drain(lv.tumbling(lv.tick_stream(spark, d)), "breadth"), "avg_price", "breadth_pct")


def t9_sliding(spark, d):
    """Two-hour windows every half hour, streamed."""
    return rounded(lv.drain(lv.tumbling(lv.tick_stream(spark, d), "2 hours", "30 minutes"), "sliding"), "avg_price", "breadth_pct")


def t9_sessions(spark, d):
    """Sessions by code, streamed."""
    return lv.drain(lv.sessions(lv.tick_stream(spark, d), "6 hours"), "sessions")


def t7_changes(spark, d):
    """Changes pushed once, streamed."""
    return lv.drain(lv.changes(lv.tick_stream(spark, d), "40 days"), "changes", "append")


def w12_stable_top(spark, d):
    """Top-ten membership with hysteresis over days, by kind of tick."""
    t = tb.ticks(spark, d).groupBy(F.col("kind").alias("horizon"), F.dayofyear("ts").cast("bigint").alias("round"), "code").agg(F.count("*").alias("n"))
    r = t.withColumn("place", F.row_number().over(Window.partitionBy("horizon", "round").orderBy(F.desc("n"), "code")).cast("bigint"))
    return lv.stable_top_batch(r.select("horizon", "round", "code", "place"), 3, 6)


QUERIES = [x7_step_scores, x8_penalties, x3_today_scores, x5_swing_candidates, x4_tomorrow_scores, x4_tomorrow_candidates, x11_ensemble, x12_merge_external, t1_latest_quotes, t3_freeze, t4_phases, t5_breadth, t9_sliding, t9_sessions, t7_changes, w12_stable_top]

_RX = """
, reg AS (SELECT trade_date, CASE WHEN sc >= 68 THEN 'risk_on' WHEN sc <= 42 THEN 'risk_off' ELSE 'balanced' END AS level FROM (
  SELECT trade_date, greatest(0, least(100, 50 + median(pct_chg) * 7.5::DOUBLE + (avg(CASE WHEN pct_chg > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100 - 50) * 0.55::DOUBLE
    + (avg(CASE WHEN pct_chg >= 3 THEN 1.0::DOUBLE ELSE 0 END) * 100 - avg(CASE WHEN pct_chg <= -3 THEN 1.0::DOUBLE ELSE 0 END) * 100) * 0.35::DOUBLE - greatest(0, avg(amplitude) - 7) * 2.4::DOUBLE)) AS sc FROM quotes GROUP BY trade_date)),
rx AS (SELECT q.*, CASE WHEN substr(q.code, 1, 3) IN ('688', '300') THEN 10.0::DOUBLE ELSE 6.5::DOUBLE END AS up, level, f.ret_3d, f.ret_5d, f.ret_10d, f.ret_20d, f.ma5_gap, f.ma20_gap, f.vol_amount_5d, f.volatility_20d, f.breakout_20d, f.vol_ma5_ratio AS volume_ratio,
  q.volume / 4 AS turnover_rate, q.pct_chg / 4 AS speed, f.ret_20d * 3 AS sixty, f.ret_20d * 5 AS ytd FROM quotes q JOIN factors f ON f.code = q.id AND f.trade_date = q.trade_date JOIN reg ON reg.trade_date = q.trade_date)"""
_LOC = "CASE WHEN price > 0 AND high > low AND low > 0 THEN (price - low) / (high - low) ELSE 0.5 END"
_NOX = "greatest(0, least(100, 86 - (CASE WHEN sixty > 45 THEN least(30, (sixty - 45) * 0.8::DOUBLE) ELSE 0 END + CASE WHEN ytd > 80 THEN least(35, (ytd - 80) * 0.6::DOUBLE) ELSE 0 END + CASE WHEN amplitude > 10 THEN 8 ELSE 0 END + CASE WHEN sixty < -20 THEN 16 ELSE 0 END)))"
_BONUS = """CASE level WHEN 'risk_on' THEN CASE WHEN pct_chg > 0 THEN 1.8::DOUBLE ELSE 0 END + CASE WHEN volume_ratio BETWEEN 1.1 AND 4.5 THEN 1.6::DOUBLE ELSE 0 END + CASE WHEN turnover >= 1.2e5 THEN 1.2::DOUBLE ELSE 0 END - CASE WHEN amplitude > 11 THEN 1.5::DOUBLE ELSE 0 END
  WHEN 'risk_off' THEN -(CASE WHEN sixty < -12 THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN pct_chg > 4 THEN 4.5::DOUBLE ELSE 0 END + CASE WHEN volume_ratio > 4.5 THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN amplitude > 9 THEN 2.5::DOUBLE ELSE 0 END)
  ELSE CASE WHEN volume_ratio BETWEEN 1.0 AND 3.5 THEN 0.8::DOUBLE ELSE 0 END - CASE WHEN amplitude > 12 THEN 1.2::DOUBLE ELSE 0 END END"""


def _pen(c, t, m, s):
    return f"CASE WHEN {m}::DOUBLE / (1 + exp(-greatest(-50, least(50, ({c} - {t}::DOUBLE) * {s}::DOUBLE)))) >= 0.25 THEN {m}::DOUBLE / (1 + exp(-greatest(-50, least(50, ({c} - {t}::DOUBLE) * {s}::DOUBLE)))) ELSE 0 END"




def _p(c):
    return f"(CASE WHEN count(*) OVER t < 2 OR min({c}) OVER t = max({c}) OVER t THEN 50 ELSE 100.0::DOUBLE * count(*) OVER (PARTITION BY trade_date ORDER BY {c} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER t END)"


_HISTORY = ("sixty", "ytd", "ret_3d", "ret_5d", "ret_10d", "ret_20d", "ma5_gap", "ma20_gap", "vol_amount_5d", "breakout_20d", "volatility_20d")


def _ready_p(c):
    """A ready row's percentile among the ready rows of its date."""
    return f"(CASE WHEN count(*) FILTER (ready) OVER t < 2 OR min({c}) FILTER (ready) OVER t = max({c}) FILTER (ready) OVER t THEN 50 ELSE 100.0::DOUBLE * count(*) FILTER (ready) OVER (PARTITION BY trade_date ORDER BY {c} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) FILTER (ready) OVER t END)"


_LEVELS = {"momentum": (1.12, 0.82, 0.96), "trend": (1.08, 0.94, 1.0), "quality": (0.92, 1.16, 1.04), "liquidity": (1.0, 1.08, 1.0)}  # risk_on, risk_off, balanced


def _tilt(v, key):
    return _by_level(v, *_LEVELS[key])


def _past(c, instead=None, lower=False):
    def score(x):
        q = _ready_p(x) if x in _HISTORY else _p(x)
        some = "FILTER (ready) " if x in _HISTORY else ""
        return f"(CASE WHEN count(*) {some}OVER t < 2 OR min({x}) {some}OVER t = max({x}) {some}OVER t THEN 50 ELSE 100 - {q} END)" if lower else q

    signal = f"count(*) FILTER (ready) OVER t >= 2 AND max(abs({c})) FILTER (ready) OVER t > 1e-9"
    return f"(CASE WHEN NOT ready THEN 50 WHEN {signal} THEN {score(c)} ELSE {score(instead) if instead else 50} END)"


def _by_level(v, on, off, balanced):
    return f"greatest(0, least(100, 50 + ({v} - 50) * CASE level WHEN 'risk_on' THEN {on}::DOUBLE WHEN 'risk_off' THEN {off}::DOUBLE ELSE {balanced}::DOUBLE END))"


_SWING_PENALTY = " + ".join(_pen(*x) for x in (("pct_chg", 7.0, 6.0, 2.0), ("volume_ratio", 5.5, 7.0, 2.0), ("turnover_rate", 18.0, 6.0, 1.0), ("volatility_20d", 7.0, 7.0, 1.4), ("ma5_gap", 18.0, 5.0, 0.45)))
_SWING_BONUS = """CASE level WHEN 'risk_on' THEN CASE WHEN pct_chg > 0 THEN 1.8::DOUBLE ELSE 0 END + CASE WHEN volume_ratio BETWEEN 1.1 AND 4.5 THEN 1.6::DOUBLE ELSE 0 END + CASE WHEN turnover >= 1.2e5 THEN 1.2::DOUBLE ELSE 0 END - CASE WHEN amplitude > 11 THEN 1.5::DOUBLE ELSE 0 END
  WHEN 'risk_off' THEN -(CASE WHEN sixty < -12 THEN 2.5::DOUBLE ELSE 0 END) ELSE CASE WHEN volume_ratio BETWEEN 1.0 AND 3.5 THEN 0.8::DOUBLE ELSE 0 END - CASE WHEN amplitude > 12 THEN 1.2::DOUBLE ELSE 0 END END"""
def _signed(c, lower=False):
    """A historical part of the next-day strategy."""
    q = _ready_p(c)
    if lower:
        q = f"(CASE WHEN count(*) FILTER (ready) OVER t < 2 OR min({c}) FILTER (ready) OVER t = max({c}) FILTER (ready) OVER t THEN 50 ELSE 100 - {q} END)"
    return f"(CASE WHEN ready AND count(*) FILTER (ready) OVER t >= 2 AND max(abs({c})) FILTER (ready) OVER t > 1e-9 THEN {q} ELSE 50 END)"


def _ladder(change, volume, rate, location, backup):
    weak = f"WHEN loc < {location}::DOUBLE THEN 'weak_close' WHEN pct_chg >= CASE WHEN up = 10 THEN 17.6::DOUBLE ELSE 8.8::DOUBLE END AND turnover < 6e4 AND trate < 8 THEN 'near_limit_up'"
    pace = "WHEN speed > 4.2 OR speed < -2.2 THEN 'speed'"
    middle = f"{pace} {weak}" if backup else f"{weak} {pace}"
    return (f"CASE WHEN pct_chg <= {change}::DOUBLE OR pct_chg >= up * 0.88::DOUBLE THEN 'change' WHEN volume_ratio < {volume}::DOUBLE OR volume_ratio >= 5 THEN 'volume_ratio' WHEN trate > 0 AND trate < {rate}::DOUBLE THEN 'turnover_rate_low' WHEN trate >= 20 THEN 'turnover_rate_high' "
            f"WHEN amplitude >= 12 THEN 'amplitude' {middle} WHEN turnover < 3e4 THEN 'turnover' WHEN ready AND (ret_20d < -18 OR ma20_gap < -10 OR volatility_20d > 10) THEN 'history' END")  # fmt: skip


def _below(c, t, m, s):
    return f"CASE WHEN {m}::DOUBLE / (1 + exp(-greatest(-50, least(50, ({c} - {t}::DOUBLE) * -{s}::DOUBLE)))) >= 0.25 THEN {m}::DOUBLE / (1 + exp(-greatest(-50, least(50, ({c} - {t}::DOUBLE) * -{s}::DOUBLE)))) ELSE 0 END"


_RANGED = "price > 0 AND high > low AND low > 0"
_TM_PENALTY = " + ".join(["0.0::DOUBLE", _pen("(pct_chg - up * 0.78::DOUBLE)", 0.0, 12.0, 3.0), _pen("amplitude", 10.0, 10.0, 1.5), _pen("trate", 16.0, 9.0, 1.0), _pen("volume_ratio", 4.5, 10.0, 2.0),
  f"CASE WHEN {_RANGED} AND pct_chg >= 4.5 AND pct_chg < 7 AND loc < 0.6 THEN {_below('loc', 0.6, 7.0, 3.0)} ELSE 0 END", f"CASE WHEN {_RANGED} AND loc < 0.45 THEN {_below('loc', 0.4, 10.0, 4.0)} ELSE 0 END",
  "CASE WHEN open > 0 AND price > 0 THEN CASE WHEN gain > 6 THEN 8 WHEN gain < -1 THEN 6 ELSE 0 END ELSE 0 END", "CASE WHEN volume_ratio < 1.05 THEN 4 ELSE 0 END", _pen("speed", 2.1, 7.0, 2.0), _below("speed", -2.1, 7.0, 2.0),
  "CASE WHEN ready THEN CASE WHEN ret_20d < -12 THEN 8 WHEN ret_20d < -6 THEN 4 ELSE 0 END + CASE WHEN ma20_gap < -6 THEN 6 ELSE 0 END + CASE WHEN volatility_20d > 8 THEN 7 WHEN volatility_20d > 6 THEN 3 ELSE 0 END ELSE 0 END"])
_TM_BONUS = _BONUS
_TAIL = """greatest(0, least(100, 52.0::DOUBLE + CASE WHEN pct_chg >= 1.1 AND pct_chg <= least(up * 0.78::DOUBLE, 5.5) THEN 20 WHEN pct_chg >= 0.6 AND pct_chg < 1.1 THEN 10 WHEN pct_chg >= 0.4 AND pct_chg < 0.6 THEN 2 WHEN pct_chg > up * 0.86::DOUBLE THEN -22 WHEN pct_chg <= 0 THEN -20 ELSE 0 END
    + CASE WHEN volume_ratio BETWEEN 1.1 AND 3.2 THEN 16 WHEN volume_ratio BETWEEN 3.2 AND 4.5 THEN 6 WHEN volume_ratio BETWEEN 0.8 AND 1.1 THEN -4 WHEN volume_ratio >= 4.5 THEN -14 ELSE 0 END
    + CASE WHEN trate BETWEEN 2 AND 10 THEN 9 WHEN trate BETWEEN 10 AND 15 THEN 4 WHEN trate >= 15 THEN -10 ELSE 0 END
    + CASE WHEN loc >= 0.72 THEN 16 WHEN loc >= 0.60 THEN 6 WHEN loc >= 0.52 THEN 2 WHEN loc < 0.30 THEN -28 WHEN loc < 0.45 THEN -16 ELSE 0 END
    + CASE WHEN open > 0 AND price > 0 THEN CASE WHEN gain BETWEEN 0.3 AND 4.8 THEN 10 WHEN gain < 0 THEN -10 WHEN gain > 6 THEN -14 ELSE 0 END ELSE 0 END
    + CASE WHEN amplitude > 0 AND amplitude <= 6.8 THEN 10 WHEN amplitude <= 9 THEN 4 WHEN amplitude >= 11 THEN -12 ELSE 0 END
    + CASE WHEN speed >= 0 AND speed <= 1.6 THEN 8 WHEN speed > 1.6 AND speed <= 2.4 THEN 2 WHEN speed >= -1.2 AND speed < 0 THEN -4 WHEN speed > 2.4 THEN -10 ELSE -7 END))"""
_TM = _RX + f"""
, x0 AS (SELECT rx.* EXCLUDE (speed, turnover_rate), rx.volume / 8 AS trate, rx.pct_chg / 6 AS speed, f.ma_bull_aligned AS bull, abs(rx.ma20_gap) > 1e-12 AND rx.id % 5 <> 0 AS ready, CASE WHEN n_regionkey <> 3 THEN 'r' || n_regionkey END AS theme
  FROM rx JOIN factors f ON f.code = rx.id AND f.trade_date = rx.trade_date JOIN nation ON n_name = rx.industry),
x1 AS (SELECT *, {_LOC} AS loc, (price / nullif(open, 0) - 1) * 100 AS gain FROM x0),
c0 AS (SELECT *, {_p('pct_chg')} * 0.34::DOUBLE + {_p('speed')} * 0.24::DOUBLE + {_p('volume_ratio')} * 0.24::DOUBLE + {_signed('sixty')} * 0.18::DOUBLE AS mom, {_p('pct_chg')} * 0.30::DOUBLE + {_p('speed')} * 0.20::DOUBLE + {_p('volume_ratio')} * 0.22::DOUBLE + {_signed('sixty')} * 0.28::DOUBLE AS bmom,
  {_signed('sixty')} * 0.55::DOUBLE + {_signed('ytd')} * 0.25::DOUBLE + (CASE WHEN max(abs(amplitude)) OVER t > 1e-9 AND count(*) OVER t >= 2 AND min(amplitude) OVER t < max(amplitude) OVER t THEN 100 - {_p('amplitude')} ELSE 50 END) * 0.20::DOUBLE AS trend,
  {_p('turnover')} * 0.58::DOUBLE + {_p('trate')} * 0.42::DOUBLE AS liq,
  CASE WHEN ready THEN greatest(0, least(100, {_signed('ret_5d')} * 0.18::DOUBLE + {_signed('ret_10d')} * 0.18::DOUBLE + {_signed('ret_20d')} * 0.20::DOUBLE + {_signed('ma20_gap')} * 0.14::DOUBLE + {_signed('vol_amount_5d')} * 0.12::DOUBLE + {_signed('volatility_20d', True)} * 0.12::DOUBLE
    + CASE WHEN breakout_20d <> 0 THEN 72 ELSE 50 END * 0.04::DOUBLE + CASE WHEN bull <> 0 THEN 68 ELSE 50 END * 0.02::DOUBLE)) ELSE 50 END AS edge,
  CASE WHEN pct_chg <= 0 THEN 45.0::DOUBLE WHEN pct_chg <= up * 0.55::DOUBLE THEN 88 WHEN pct_chg <= up * 0.78::DOUBLE THEN 76 ELSE 58 END AS exe, {_TAIL} AS tail, {_TM_PENALTY} AS pen, {_TM_BONUS} AS bonus, 0.6::DOUBLE + 0.4::DOUBLE * {_NOX} / 100 AS damp,
  {_ladder(0.6, 0.9, 1.5, 0.25, False)} AS reject, {_ladder(-1.0, 0.65, 0.8, 0.15, True)} AS backup_reject FROM x1 WINDOW t AS (PARTITION BY trade_date)),
c1 AS (SELECT *, {_tilt('liq', 'liquidity')} * 0.30::DOUBLE + {_tilt('exe', 'quality')} * 0.15::DOUBLE + {_tilt('tail', 'quality')} * 0.15::DOUBLE + {_tilt('edge', 'quality')} * 0.20::DOUBLE AS rest, {_tilt('mom', 'momentum')} * 0.20::DOUBLE AS m1, {_tilt('bmom', 'momentum')} * 0.20::DOUBLE AS m2 FROM c0),
c2 AS (SELECT *, round(greatest(0, least(100, (rest + m1 - pen + bonus) * damp)), 2) AS score, round(greatest(0, least(100, greatest(0, least(100, (rest + m2 - pen - 6 + bonus) * damp)) - 4)), 2) AS backup_score FROM c1)"""
_WIN = "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg(value), 6) AS avg_price, round(avg(CASE WHEN value > 10 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS breadth_pct FROM {src} GROUP BY s"
ORACLES = {
    "x7_step_scores": with_views(["factors", "quotes"], _RX + f"""
, g AS (SELECT *, {_LOC} AS loc, (price / nullif(open, 0) - 1) * 100 AS gain FROM rx)
SELECT id, trade_date, round(loc, 6) AS location, CASE WHEN pct_chg <= 0 THEN 45.0::DOUBLE WHEN pct_chg <= up * 0.55::DOUBLE THEN 88 WHEN pct_chg <= up * 0.78::DOUBLE THEN 76 ELSE 58 END AS execution, round({_NOX}, 6) AS not_overextended, round(0.6::DOUBLE + 0.4::DOUBLE * {_NOX} / 100, 6) AS damp,
  round(greatest(0, least(100, 52.0::DOUBLE + CASE WHEN pct_chg >= 1.1 AND pct_chg <= least(up * 0.78::DOUBLE, 5.5) THEN 20 WHEN pct_chg >= 0.6 AND pct_chg < 1.1 THEN 10 WHEN pct_chg >= 0.4 AND pct_chg < 0.6 THEN 2 WHEN pct_chg > up * 0.86::DOUBLE THEN -22 WHEN pct_chg <= 0 THEN -20 ELSE 0 END
    + CASE WHEN volume_ratio BETWEEN 1.1 AND 3.2 THEN 16 WHEN volume_ratio BETWEEN 3.2 AND 4.5 THEN 6 WHEN volume_ratio BETWEEN 0.8 AND 1.1 THEN -4 WHEN volume_ratio >= 4.5 THEN -14 ELSE 0 END
    + CASE WHEN turnover_rate BETWEEN 2 AND 10 THEN 9 WHEN turnover_rate BETWEEN 10 AND 15 THEN 4 WHEN turnover_rate >= 15 THEN -10 ELSE 0 END
    + CASE WHEN loc >= 0.72 THEN 16 WHEN loc >= 0.60 THEN 6 WHEN loc >= 0.52 THEN 2 WHEN loc < 0.30 THEN -28 WHEN loc < 0.45 THEN -16 ELSE 0 END
    + CASE WHEN open > 0 AND price > 0 THEN CASE WHEN gain BETWEEN 0.3 AND 4.8 THEN 10 WHEN gain < 0 THEN -10 WHEN gain > 6 THEN -14 ELSE 0 END ELSE 0 END
    + CASE WHEN amplitude > 0 AND amplitude <= 6.8 THEN 10 WHEN amplitude <= 9 THEN 4 WHEN amplitude >= 11 THEN -12 ELSE 0 END
    + CASE WHEN speed >= 0 AND speed <= 1.6 THEN 8 WHEN speed > 1.6 AND speed <= 2.4 THEN 2 WHEN speed >= -1.2 AND speed < 0 THEN -4 WHEN speed > 2.4 THEN -10 ELSE -7 END)), 6) AS tail_setup,
  round({_BONUS}, 6) AS bonus, CASE WHEN id = 0 THEN 50.0::DOUBLE WHEN id * 3 <= 20 THEN 100 WHEN id * 3 <= 50 THEN 88 WHEN id * 3 <= 100 THEN 76 WHEN id * 3 <= 200 THEN 62 ELSE 52 END AS hot FROM g"""),
    "x8_penalties": with_views(["factors", "quotes"], _RX + f"SELECT id, trade_date, round({_SWING_PENALTY}, 6) AS risk_penalty, round(nullif({_pen('volatility_20d', 7.0, 7.0, 1.4)}, 0), 6) AS volatility_part FROM rx"),
    "x3_today_scores": with_views(["factors", "quotes"], _RX + f"""
, c AS (SELECT *, {_SWING_PENALTY} AS pen, {_p('pct_chg')} * 0.28::DOUBLE + {_p('speed')} * 0.24::DOUBLE + {_p('volume_ratio')} * 0.18::DOUBLE + {_p('ret_3d')} * 0.12::DOUBLE + {_p('ret_5d')} * 0.10::DOUBLE + {_p('vol_amount_5d')} * 0.08::DOUBLE AS mom,
  {_p('turnover_rate')} * 0.45::DOUBLE + {_p('turnover')} * 0.55::DOUBLE AS liq FROM rx WINDOW t AS (PARTITION BY trade_date)),
b AS (SELECT *, {_tilt('mom', 'momentum')} * 0.35::DOUBLE + {_tilt('liq', 'liquidity')} * 0.25::DOUBLE + 50 * 0.10::DOUBLE + 50 * 0.20::DOUBLE + {_tilt('greatest(0, 100 - pen * 3.2::DOUBLE)', 'quality')} * 0.10::DOUBLE AS base FROM c)
SELECT id, trade_date, round(base, 6) AS base_score, round(greatest(0, least(100, (base - pen + {_BONUS}) * (0.6::DOUBLE + 0.4::DOUBLE * {_NOX} / 100))), 6) AS score FROM b"""),
    "x5_swing_candidates": with_views(["factors", "quotes"], _RX + f"""
, u AS (SELECT *, abs(ma20_gap) > 1e-12 AND id % 3 <> 0 AS ready FROM rx WHERE pct_chg <= 8 AND sixty <= 85 AND ytd <= 130 AND sixty >= -18),
c AS (SELECT *, {_past('ret_5d', 'pct_chg')} * 0.24::DOUBLE + {_past('ret_10d', 'sixty')} * 0.22::DOUBLE + {_past('ma5_gap', 'pct_chg')} * 0.16::DOUBLE + {_past('vol_amount_5d', 'volume_ratio')} * 0.18::DOUBLE + {_past('breakout_20d')} * 0.08::DOUBLE + {_p('volume_ratio')} * 0.12::DOUBLE AS mom,
  {_past('ret_20d', 'sixty')} * 0.30::DOUBLE + {_past('sixty')} * 0.26::DOUBLE + {_past('ma20_gap', 'sixty')} * 0.22::DOUBLE + {_past('ytd')} * 0.10::DOUBLE + {_past('volatility_20d', 'amplitude', True)} * 0.12::DOUBLE AS trend,
  {_p('turnover')} * 0.62::DOUBLE + {_p('turnover_rate')} * 0.38::DOUBLE AS liq, CASE WHEN pct_chg <= 0 THEN 45.0::DOUBLE WHEN pct_chg <= up * 0.55::DOUBLE THEN 88 WHEN pct_chg <= up * 0.78::DOUBLE THEN 76 ELSE 58 END AS exe,
  avg(CASE WHEN ready THEN 1.0::DOUBLE ELSE 0 END) OVER t < 0.3 AS degraded FROM u WINDOW t AS (PARTITION BY trade_date)),
b AS (SELECT *, {_by_level('mom', 1.12, 0.82, 0.96)} * 0.30::DOUBLE + {_by_level('trend', 1.08, 0.94, 1.0)} * 0.25::DOUBLE + {_by_level('liq', 1.0, 1.08, 1.0)} * 0.20::DOUBLE + {_by_level('exe', 0.92, 1.16, 1.04)} * 0.15::DOUBLE + {_by_level(_NOX, 0.92, 1.16, 1.04)} * 0.10::DOUBLE AS base FROM c),
s AS (SELECT *, round(greatest(0, least(100, (base - ({_SWING_PENALTY}) + {_SWING_BONUS}) * (0.6::DOUBLE + 0.4::DOUBLE * {_NOX} / 100))), 6) AS final FROM b),
o AS (SELECT *, final >= 60 AND row_number() OVER (PARTITION BY trade_date, industry ORDER BY final DESC, id) <= 2 AS ok FROM s),
q AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY ok DESC, final DESC, id) AS pos FROM o),
z AS (SELECT *, ok AND pos <= CASE WHEN degraded THEN 8 ELSE 30 END AS shown FROM q)
SELECT id, trade_date, round(mom, 6) AS momentum_score, round(trend, 6) AS trend_score, round(base, 6) AS base_score, final AS score, degraded, CASE WHEN shown THEN pos END AS place, CASE WHEN shown THEN CASE WHEN degraded THEN 'backup_watch' ELSE 'primary_watch' END END AS tier FROM z"""),
    "x4_tomorrow_scores": with_views(["factors", "quotes"], _TM + " SELECT id, trade_date, reject, backup_reject, round(liq, 5) AS liquidity_score, round(mom, 5) AS momentum_score, round(trend, 5) AS trend_score, round(edge, 5) AS historical_edge_score, tail AS tail_setup_score, round(pen, 5) AS risk_penalty, score, backup_score FROM c2"),
    "x4_tomorrow_candidates": with_views(["factors", "quotes"], _TM + """
, hb AS (SELECT trade_date, avg(CASE WHEN abs(ma20_gap) > 1e-12 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS cov, coalesce(avg(CASE WHEN ma20_gap > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (abs(ma20_gap) > 1e-12) * 100, 0) AS br FROM factors GROUP BY trade_date),
g AS (SELECT c2.*, cov, br, coalesce(theme, industry) AS th, CASE WHEN cov >= 25 THEN CASE WHEN br > 55 THEN 60.0::DOUBLE WHEN br > 45 THEN 68 ELSE 78 END ELSE CASE level WHEN 'risk_on' THEN 60.0::DOUBLE WHEN 'balanced' THEN 66 WHEN 'risk_off' THEN 72 ELSE 70 END END AS floor FROM c2 JOIN hb USING (trade_date)),
s0 AS (SELECT *, reject IS NULL AND score >= floor AS strict FROM g), s1 AS (SELECT *, max(strict) OVER (PARTITION BY trade_date) AS has FROM s0),
s2 AS (SELECT *, CASE WHEN strict THEN 'strict' WHEN NOT has AND backup_reject IS NULL AND backup_score >= 45 THEN 'backup' END AS source, CASE WHEN strict THEN score ELSE backup_score END AS sc FROM s1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY sc DESC, id) AS pos FROM s2 WHERE source IS NOT NULL),
walk AS (
  SELECT trade_date, 0::BIGINT AS pos, []::VARCHAR[] AS ths, []::VARCHAR[] AS inds, []::BIGINT[] AS ids FROM (SELECT DISTINCT trade_date FROM s3)
  UNION ALL
  SELECT trade_date, np, CASE WHEN ok THEN list_append(ths, th) ELSE ths END, CASE WHEN ok THEN list_append(inds, industry) ELSE inds END, CASE WHEN ok THEN list_append(ids, id) ELSE ids END
  FROM (SELECT w.*, s.th, s.industry, s.id, s.pos AS np, len(list_filter(w.ths, lambda x: x = s.th)) < 5 AND len(list_filter(w.inds, lambda x: x = s.industry)) < 2 AND len(w.ids) < 8 AS ok FROM walk w JOIN s3 s ON s.trade_date = w.trade_date AND s.pos = w.pos + 1)),
fin AS (SELECT trade_date, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS place FROM (SELECT trade_date, arg_max(ids, pos) AS ids FROM walk GROUP BY trade_date)),
sh AS (SELECT s3.*, place, edge >= 78 AND tail >= 72 AND pen <= 9 AS strong FROM fin JOIN s3 USING (trade_date, id)),
bl AS (SELECT *, list_filter([CASE WHEN sc < greatest(floor, 68) THEN 'score' END, CASE WHEN round(pen, 2) > 12 THEN 'penalty' END, CASE WHEN round(damp, 4) < 0.72 THEN 'overheated' END, CASE WHEN sixty > 90 AND NOT strong THEN 'sixty_day_gain' END, CASE WHEN ytd > 130 AND NOT strong THEN 'year_gain' END], lambda x: x IS NOT NULL) AS b FROM sh),
fr AS (SELECT *, source = 'strict' AND len(b) = 0 AS free, count(*) FILTER (source = 'strict') OVER (PARTITION BY trade_date) AS ns FROM bl),
se AS (SELECT *, free AND row_number() OVER (PARTITION BY trade_date, th, free ORDER BY place) <= 2 AS seated FROM fr),
ra AS (SELECT *, row_number() OVER (PARTITION BY trade_date, seated ORDER BY place) AS rk, CASE WHEN cov >= 25 THEN CASE WHEN br <= 45 THEN 0 WHEN br <= 55 THEN least(ns, 3) ELSE least(ns, 5) END ELSE CASE level WHEN 'risk_off' THEN 0 WHEN 'balanced' THEN least(ns, 3) ELSE least(ns, 5) END END AS lim FROM se)
SELECT trade_date, id, source, sc AS score, floor, place, CASE WHEN seated AND rk <= lim THEN 'primary_watch' ELSE 'backup_watch' END AS tier, array_to_string(b, ',') AS blockers FROM ra""").replace("WITH bars", "WITH RECURSIVE bars", 1),
    "x11_ensemble": "WITH s AS (SELECT o_orderkey, (o_orderkey % 101)::DOUBLE AS a, CASE WHEN o_orderkey % 3 <> 0 THEN least(100, (o_custkey % 90))::DOUBLE ELSE 50 END AS b, 50.0::DOUBLE AS c, least(100, o_custkey % 130)::DOUBLE AS d, (o_orderkey % 7 * 10)::DOUBLE AS e FROM orders), t AS (SELECT *, least(100, a) AS a1 FROM s) SELECT o_orderkey, round(a1 * 0.35::DOUBLE + b * 0.25::DOUBLE + c * 0.20::DOUBLE + d * 0.10::DOUBLE + e * 0.10::DOUBLE, 6) AS ensemble_score, greatest(a1, b, c, d, e) - least(a1, b, c, d, e) AS dispersion, round(1 - (greatest(a1, b, c, d, e) - least(a1, b, c, d, e)) / 100, 6) AS agreement FROM t",
    "x12_merge_external": with_views(["signals"], """
, m AS (SELECT strategy, signal_date, signal_id AS code, score, greatest(0, least(100, CASE WHEN signal_id % 3 = 0 THEN score * 0.75::DOUBLE + (100 - score) * 0.25::DOUBLE - least(30, code % 7 + signal_id % 40) ELSE score END)) AS f, signal_id % 3 = 0 AND signal_id % 5 = 0 AS veto FROM signals)
SELECT code, round(f, 6) AS final_score, veto, row_number() OVER (PARTITION BY strategy, signal_date ORDER BY veto, f DESC, score DESC, code) AS place FROM m"""),
    "t1_latest_quotes": "SELECT user_id AS code, event_id, value AS price, event_type AS kind FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "t3_freeze": "SELECT strftime(ts, '%H:%M') >= '14:50' AS late, count(*) AS n FROM events GROUP BY 1",
    "t4_phases": "WITH e AS (SELECT event_id, strftime(ts, '%H:%M') AS t FROM events) SELECT CASE WHEN t < '09:30' THEN 'before' WHEN t < '10:30' THEN 'opening' WHEN t < '11:20' THEN 'morning' WHEN t < '13:00' THEN 'noon' WHEN t < '14:00' THEN 'afternoon' ELSE 'closing' END AS phase, count(*) AS n, max(event_id) AS last_event FROM e GROUP BY 1",
    "t5_breadth": _WIN.format(src="(SELECT value, date_trunc('hour', ts) AS s FROM events)"),
    "t9_sliding": _WIN.format(src="(SELECT value, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS s FROM events, (VALUES (0), (1), (2), (3)) t(k))"),
    "t9_sessions": "WITH e AS (SELECT user_id AS code, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY code ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT code, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY code, k",
    "t7_changes": "SELECT event_id, user_id AS code, event_type AS kind FROM events",
}

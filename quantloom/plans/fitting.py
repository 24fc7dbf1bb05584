"""Queries on fitting: weight searches, the challenger ladder, expanding-window models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import crosssection as cs
from ..operators import models as mo
from ..sources import tables as tb
from .market import rounded
from .views import with_views

SCORES = ("momentum_score", "trend_score", "stability_score", "liquidity_score")
WEIGHTS = {"momentum_score": 0.35, "trend_score": 0.30, "stability_score": 0.20, "liquidity_score": 0.15}
RAW = ("ret_5d", "ma20_gap", "volatility_20d", "vol_ma5_ratio")


def _bounded(c):
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def _samples(spark, d):
    """Trades to term with four component scores and their weighted sum."""
    t = bt.trades(tb.bars(spark, d), keep=RAW).select("code", "trade_date", "net_return", *RAW)
    t = t.select(
        "code", "trade_date", "net_return", _bounded(50 + 4 * F.col("ret_5d")).alias("momentum_score"), _bounded(50 + 5 * F.col("ma20_gap")).alias("trend_score"),
        _bounded(100 - 10 * F.col("volatility_20d")).alias("stability_score"), _bounded(50 * F.col("vol_ma5_ratio")).alias("liquidity_score"),
    )
    score = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return t.withColumn("score", score)


def x21_momentum(spark, d):
    """Momentum against reversal weights of the linear signal, and the tilt that follows."""
    cols = list(bt.SIGNAL_WEIGHTS)
    t = bt.trades(tb.bars(spark, d), keep=tuple(cols)).select("code", "trade_date", "net_return", *cols)
    reversal = {c: -abs(w) if c in ("ret_5d", "ret_10d", "ret_20d") else w for c, w in bt.SIGNAL_WEIGHTS.items()}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), bt.linear_signal(w).alias("_v")) for n, w in (("momentum", bt.SIGNAL_WEIGHTS), ("reversal", reversal))]))
    x = mo.with_excess(t, ["trade_date"]).withColumn("_e", each).select("trade_date", "code", "net_return", "excess", "_e.*")
    o = mo.objectives(mo.top_rows(x, ["variant"], F.round("_v", 9), 10), ["variant"])
    edge = F.max(F.when(F.col("variant") == "reversal", F.col("objective"))) - F.max(F.when(F.col("variant") == "momentum", F.col("objective")))
    tilt = o.agg(edge.alias("edge")).select(F.when(F.col("edge") > 1e-9, F.round(F.least(F.lit(0.6), 0.2 + F.col("edge") / 100), 3)).otherwise(0.0).alias("suggested_tilt"))
    return rounded(o.crossJoin(F.broadcast(tilt)), "sortino", "decay", "objective", digits=4)  # one row beside two


def x21_weight_fit(spark, d):
    """Coordinate search of the component weights: over all dates and for each market regime, side by side."""
    regime = cs.market_regime(tb.quotes(spark, d)).select("trade_date", "level")
    s = _samples(spark, d).join(regime, "trade_date").withColumn("grp", F.array(F.lit("all"), F.col("level")))
    return mo.coordinate_search(s, SCORES, WEIGHTS, k=5)


def x21_walk_forward(spark, d):
    """Weights fitted on each fold's past against the current ones on its future."""
    return rounded(mo.walk_forward_search(_samples(spark, d), SCORES, WEIGHTS, k=5), "improvement")


def x23_interaction_terms(spark, d):
    """Pairs of components that each fold's training dates select."""
    s = mo.with_excess(_samples(spark, d), ["trade_date"])
    return mo.interaction_terms(s.join(F.broadcast(mo.expanding_folds(s, 4, 5).where("part = 'train'")), "trade_date"), SCORES)


def x23_ladder(spark, d):
    """The interaction challenger's way up the promotion ladder."""
    return rounded(mo.interaction_ladder(_samples(spark, d), SCORES, k=5), "p_value", "dsr_probability", digits=5)


def _walk(spark, d):
    s = _samples(spark, d)
    s = s.select("trade_date", "code", "net_return", *[((F.col(c) - 50) / 50).alias(c) for c in SCORES], (F.col("score") / 100).alias("local_score"), (F.col("score") >= 50).alias("production_selected"))
    return mo.walk_forward_models(s, (*SCORES, "local_score"), ("local_score",))


def x24_walk_forward(spark, d):
    """Out-of-sample probability, expected return and rank key of every sample after the first 60 days."""
    w = _walk(spark, d)
    keys = [c for c in w.columns if c.endswith(("probability", "expected_return", "rank_key"))]
    return rounded(w.select("trade_date", "code", "net_return", *keys), "net_return", *keys)


def x24_counterfactual(spark, d):
    """What the challenger would have earned each day against the production choice and the ablation."""
    return mo.counterfactual_days(_walk(spark, d), "production_selected", "local_score", 5)


QUERIES = [x21_momentum, x21_weight_fit, x21_walk_forward, x23_interaction_terms, x23_ladder, x24_walk_forward, x24_counterfactual]

_SLIP = "CASE WHEN turnover >= 1e9 THEN 0.05::DOUBLE WHEN turnover >= 3e8 THEN 0.12::DOUBLE WHEN turnover >= 1e8 THEN 0.25::DOUBLE ELSE 0.45::DOUBLE END"
_TRADES = f"""
, tr AS (SELECT f.*, (x.ex / f.close - 1) * 100 - (0.25::DOUBLE + {_SLIP}) AS net_return
  FROM factors f JOIN (SELECT code, trade_date, lead(close, 3) OVER (PARTITION BY code ORDER BY trade_date) AS ex FROM bars) x USING (code, trade_date) WHERE f.bar_no > 30 AND x.ex > 0)"""
_SM = _TRADES + """
, s0 AS (SELECT code, trade_date, net_return, greatest(0, least(100, 50 + 4 * ret_5d)) AS m, greatest(0, least(100, 50 + 5 * ma20_gap)) AS t, greatest(0, least(100, 100 - 10 * volatility_20d)) AS s, greatest(0, least(100, 50 * vol_ma5_ratio)) AS l FROM tr),
sm AS (SELECT *, m * 0.35::DOUBLE + t * 0.30::DOUBLE + s * 0.20::DOUBLE + l * 0.15::DOUBLE AS score, net_return - median(net_return) OVER (PARTITION BY trade_date) AS excess FROM s0)"""
# by: the groups; src: the rows chosen
_OBJECTIVE = """
SELECT {by}, n, win_rate, avg_excess, avg_return, sortino, decay, round((win_rate + 2 * avg_excess + 0.5::DOUBLE * sortino) * decay, 6) AS objective FROM (
  SELECT *, CASE WHEN sp > 1e-8 THEN round(avg_excess / sp, 6) ELSE 0 END AS sortino, round(greatest(0.75, least(1.25, 1 + greatest(-20, least(20, t30 - t60)) / 100)), 6) AS decay FROM (
    SELECT *, CASE WHEN losses >= 2 THEN sd WHEN avg_excess < 0 THEN -avg_excess * 2 ELSE 2.0::DOUBLE END AS sp FROM (
      SELECT {by}, count(*) AS n, round(avg(CASE WHEN excess > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 2) AS win_rate, round(avg(excess), 4) AS avg_excess, round(avg(net_return), 4) AS avg_return,
        count(*) FILTER (round(net_return, 4) < 0) AS losses, stddev_samp(round(net_return, 4)) FILTER (round(net_return, 4) < 0) AS sd,
        sum(CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0 END * pow(0.5::DOUBLE, age / 60)) / sum(pow(0.5::DOUBLE, age / 60)) * 100 AS t60, sum(CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0 END * pow(0.5::DOUBLE, age / 30)) / sum(pow(0.5::DOUBLE, age / 30)) * 100 AS t30
      FROM (SELECT *, date_diff('day', trade_date, max(trade_date) OVER (PARTITION BY {by})) AS age FROM {src}) GROUP BY {by})))"""
_FOLDS = """
, d0 AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS nd FROM (SELECT DISTINCT trade_date FROM sm)),
fo AS (SELECT fold, trade_date, CASE WHEN i >= st AND i < st + sz THEN 'test' WHEN i < st - 5 THEN 'train' END AS part FROM (
  SELECT *, nd // 5 AS sz, nd - (nd // 5) * (4 - fold + 1) AS st FROM d0, (SELECT unnest(range(1, 5)) AS fold))),
fs AS (SELECT sm.*, fold, part FROM sm JOIN fo USING (trade_date) WHERE part IS NOT NULL),
px AS (SELECT *, greatest(-1, least(1, (m - 50) / 50)) AS um, greatest(-1, least(1, (t - 50) / 50)) AS ut, greatest(-1, least(1, (s - 50) / 50)) AS us, greatest(-1, least(1, (l - 50) / 50)) AS ul FROM fs),
pr AS (SELECT fold, part, trade_date, code, net_return, excess, score, unnest([{{'at': 0, 'pair': 'momentum_score*trend_score', 'x': um * ut}}, {{'at': 1, 'pair': 'momentum_score*stability_score', 'x': um * us}}, {{'at': 2, 'pair': 'momentum_score*liquidity_score', 'x': um * ul}},
  {{'at': 3, 'pair': 'trend_score*stability_score', 'x': ut * us}}, {{'at': 4, 'pair': 'trend_score*liquidity_score', 'x': ut * ul}}, {{'at': 5, 'pair': 'stability_score*liquidity_score', 'x': us * ul}}], recursive := true) FROM px),
te AS (SELECT fold, pair, "at", count(*) AS n, covar_pop(x, excess) AS c, var_pop(x) AS vx, var_pop(excess) AS vy FROM pr WHERE part = 'train' GROUP BY ALL),
tm AS (SELECT fold, pair, round(greatest(-5, least(5, c / vx)), 6) AS coefficient, round(c / sqrt(vx * vy), 6) AS correlation, n FROM te WHERE n >= 20 AND vx > 1e-10 AND vy > 1e-10 AND abs(c / sqrt(vx * vy)) >= 0.02
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(abs(c / sqrt(vx * vy)), 6) DESC, "at") <= 8)""".replace("{{", "{").replace("}}", "}")  # fmt: skip
_REVERSAL = "ret_5d * {s}0.20::DOUBLE + ret_10d * {s}0.22::DOUBLE + ret_20d * {s}0.25::DOUBLE + ma20_gap * 0.14::DOUBLE + vol_amount_5d * 2.0::DOUBLE + breakout_20d * 4.0::DOUBLE + volatility_20d * -0.35::DOUBLE"

ORACLES = {
    "x21_momentum": with_views(["factors"], _TRADES + f"""
, e AS (SELECT code, trade_date, net_return, net_return - median(net_return) OVER (PARTITION BY trade_date) AS excess, unnest([{{'variant': 'momentum', 'v': round({_REVERSAL.format(s='')}, 9)}}, {{'variant': 'reversal', 'v': round({_REVERSAL.format(s='-')}, 9)}}], recursive := true) FROM tr),
top AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY variant, trade_date ORDER BY v DESC, code) <= 10),
o AS ({_OBJECTIVE.format(by='variant', src='top')}),
g AS (SELECT max(objective) FILTER (variant = 'reversal') - max(objective) FILTER (variant = 'momentum') AS edge FROM o)
SELECT variant, n, win_rate, avg_excess, avg_return, round(sortino, 4) AS sortino, round(decay, 4) AS decay, round(objective, 4) AS objective, CASE WHEN edge > 1e-9 THEN round(least(0.6, 0.2 + edge / 100), 3) ELSE 0 END AS suggested_tilt FROM o, g""", 30),
    "x23_interaction_terms": with_views(["factors"], _SM + _FOLDS + "\nSELECT fold, pair, coefficient, correlation, n FROM tm", 30),
    "x23_ladder": with_views(["factors"], _SM + _FOLDS + f"""
, dl AS (SELECT p.fold, p.trade_date, p.code, any_value(net_return) AS net_return, any_value(excess) AS excess, any_value(score) AS score, sum(coalesce(coefficient, 0) * x * 6) AS delta FROM pr p LEFT JOIN tm ON tm.fold = p.fold AND tm.pair = p.pair WHERE part = 'test' GROUP BY p.fold, p.trade_date, p.code),
v AS (SELECT fold, trade_date, code, net_return, excess, unnest([{{'variant': 'baseline', 'rs': score}}, {{'variant': 'interaction', 'rs': greatest(0, least(100, score + greatest(-12, least(12, delta))))}}], recursive := true) FROM dl),
top AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY fold, variant, trade_date ORDER BY rs DESC, code) <= 5),
o AS ({_OBJECTIVE.format(by='fold, variant', src='top')}),
f AS (SELECT c.variant, count(*) AS folds, round(avg(b.objective), 4) AS baseline_oos, round(avg(c.objective), 4) AS challenger_oos, count(*) FILTER (round(c.objective - b.objective, 4) > 0) AS positive_folds,
  round(avg(c.avg_return - b.avg_return) - CASE WHEN count(*) > 1 THEN 1.96::DOUBLE * stddev_samp(c.avg_return - b.avg_return) / sqrt(count(*)) ELSE 0 END, 4) AS ci_low FROM o c JOIN o b ON b.fold = c.fold AND b.variant = 'baseline' WHERE c.variant <> 'baseline' GROUP BY c.variant),
dy AS (SELECT variant, trade_date, avg(net_return) AS r FROM top GROUP BY ALL),
ic AS (SELECT c.variant, c.trade_date, round(c.r - b.r, 6) AS inc FROM dy c JOIN dy b ON b.trade_date = c.trade_date AND b.variant = 'baseline' WHERE c.variant <> 'baseline'),
bv AS (SELECT variant, avg(inc) AS observed, list(inc ORDER BY trade_date) AS v, count(*) AS n, greatest(1, CAST(round(sqrt(count(*))) AS BIGINT)) AS width FROM ic GROUP BY 1 HAVING count(*) >= 2),
bb AS (SELECT *, unnest(range(0, CAST(ceil(n / width) AS BIGINT))) AS b FROM bv, (SELECT unnest(range(1000)) AS draw)),
bs AS (SELECT *, ('0x' || substr(md5('20260714:' || variant || ':' || draw || ':' || b), 1, 8))::BIGINT % (n - width + 1) AS start FROM bb),
bm AS (SELECT variant, draw, any_value(observed) AS observed, sum(list_sum(v[start + 1 : start + least(width, n - b * width)])) / any_value(n) AS m FROM bs GROUP BY ALL),
bp AS (SELECT variant, CASE WHEN any_value(observed) <= 0 THEN 1.0::DOUBLE ELSE (count(*) FILTER (m - observed >= observed) + 1) / 1001.0::DOUBLE END AS p_value FROM bm GROUP BY 1),
sm1 AS (SELECT *, avg(inc) OVER (PARTITION BY variant) AS mu, stddev_samp(inc) OVER (PARTITION BY variant) AS sd FROM ic),
sg AS (SELECT variant, count(*) AS n, any_value(mu) / any_value(sd) AS sh, avg(pow((inc - mu) / sd, 3)) AS sk, avg(pow((inc - mu) / sd, 4)) AS ku FROM sm1 GROUP BY variant),
sz AS (SELECT *, sh * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - sk * sh + (ku - 1) / 4 * sh * sh)) AS z FROM sg), st AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM sz),
sp AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) AS up FROM st),
sd1 AS (SELECT variant, CASE WHEN z >= 0 THEN 1 - up ELSE up END AS dsr FROM sp)
SELECT f.variant, folds, baseline_oos, challenger_oos, round(challenger_oos - baseline_oos, 4) AS improvement, positive_folds, round(p_value, 5) AS p_value, p_value <= 0.1 AS fdr_passed, ci_low, round(dsr, 5) AS dsr_probability,
  CASE WHEN NOT (challenger_oos > baseline_oos + 0.05 AND positive_folds > folds // 2) THEN 'shadow_only' WHEN NOT p_value <= 0.1 THEN 'fdr_blocked' WHEN ci_low < 0 THEN 'ci_blocked' WHEN dsr < 0.95 THEN 'dsr_blocked' ELSE 'oos_passed' END AS status
FROM f JOIN bp USING (variant) JOIN sd1 USING (variant)""", 30),
}

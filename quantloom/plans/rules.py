"""Queries on labels, gates, audits, selection and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import style_bucket
from ..operators import crosssection as cs
from ..operators import policies as po
from ..operators import validation as va
from ..sources import ingest as ig
from ..sources import tables as tb
from .market import rounded
from .trading import _outcomes, _samples
from .views import with_views

THEMES = [("circle", ("ring", "bolt")), ("gear", ("gear", "widget"))]


def f8_themes(spark, d):
    """Theme of each part by keywords of its name."""
    p = tb.read(spark, d, "part")
    return p.select("p_partkey", po.first_theme(F.concat_ws(" ", "p_name", "p_type"), THEMES, F.col("p_brand")).alias("theme"), po.keyword_score(F.col("p_name"), ("red", "ring", "small"), 50.0, 15.0, 80.0).alias("score"))


def f10_style(spark, d):
    """Style bucket of suppliers by size."""
    return tb.read(spark, d, "supplier").select("s_suppkey", style_bucket(F.col("s_acctbal") * 1e7).alias("style"))


def f16_regime_gate(spark, d):
    """Quotes that pass the score floor and slots of their date's regime."""
    r = cs.market_regime(tb.quotes(spark, d))
    q = tb.quotes(spark, d).select("trade_date", "id", F.round("pct_chg", 9).alias("pct_chg"))
    g = po.gate_by_regime(q, r, "trade_date", {"risk_on": 0.0, "balanced": 1.0, "risk_off": 3.0}, {"risk_on": 3, "balanced": 2, "risk_off": 1}, "pct_chg", [F.desc("pct_chg"), F.col("id")])
    return g.select("trade_date", "id", "level", "gate_place", "reasons", "eligible")


def f15_tiers(spark, d):
    """Executable signals; primary ones where a day has tiers."""
    s = tb.signals(spark, d).withColumn("execution_allowed", F.when(F.col("signal_id") % 5 != 0, F.col("signal_id") % 7 != 0)).withColumn("tier", F.when(F.dayofmonth("signal_date") % 3 == 0, F.when(F.col("rank") == 1, "primary_watch").otherwise("backup_watch")))
    return po.tier_filter(s, ["strategy", "signal_date"]).select("signal_id", "tier")


def w18_backup_fill(spark, d):
    """Backup quotes for each date by theme and industry not yet held."""
    q = tb.quotes(spark, d).withColumn("theme", F.substring("code", 1, 3)).withColumn("n", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("turnover"), "id")))
    b = po.fill_backup(q.where("n <= 1"), q.where("n > 1"), ["trade_date"], [F.desc("turnover"), F.col("id")], 2)
    return b.select("trade_date", "id", "place")


def w19_quota_pool(spark, d):
    """Two by turnover, one by fall, one by rise."""
    q = tb.quotes(spark, d).select("trade_date", "id", "turnover", F.round("pct_chg", 9).alias("pct_chg"))
    p = po.quota_pool(q, ["trade_date"], "id", [([F.desc("turnover"), F.col("id")], 2), ([F.col("pct_chg"), F.col("id")], 1), ([F.desc("pct_chg"), F.col("id")], 1)])
    return p.select("trade_date", "id", "stage")


def a21_cost_distribution(spark, d):
    """Distribution of costs by strategy."""
    return rounded(po.distribution(_outcomes(spark, d), ["strategy"], "total_pct"), "mean", "min", "p50", "p95", "max")


def q10_quantiles(spark, d):
    """Three kinds of quartile of the closes by code."""
    return rounded(po.index_quantiles(tb.bars(spark, d), ["code"], "close", 0.25), "floor_index", "round_index", "linear")


def q9_sign_test(spark, d):
    """Sign-test tail of wins by code."""
    o = _outcomes(spark, d).where("state = 'settled'").groupBy("code").agg(F.count("*").alias("n"), F.sum((F.col("net_return") > 0).cast("bigint")).alias("k"))
    return rounded(po.binomial_tail(o, "n", "k"), "tail")


def a29_consensus(spark, d):
    """Appearances and verdict by code."""
    s = tb.signals(spark, d).where("rank = 1").withColumn("observation_only", F.col("signal_id") % 4 == 0)
    return rounded(po.verdict(po.consensus(s, "code"), F.lit(-2.0)), "avg_score", "avg_observed", "direction")


def u3_set_changes(spark, d):
    """New, kept and dropped codes from one signal day to the next."""
    return po.set_changes(tb.signals(spark, d), "strategy", "signal_date", "code")


def a32_violations(spark, d):
    """Broken rules over line items."""
    li = tb.read(spark, d, "lineitem")
    v = po.violations(li, ["l_returnflag"], {"discount": F.col("l_discount") > 0.08, "tax": F.col("l_tax") < 0.01, "quantity": F.col("l_quantity") >= 50})
    return v.groupBy("l_returnflag", "violation").agg(F.count("*").alias("n"))


def a20_mask_coverage(spark, d):
    """Field coverage by scope from a map of missing flags."""
    q = tb.quotes(spark, d).select("id", F.create_map(F.lit("prev_close"), F.col("prev_close").isNull(), F.lit("change"), F.col("pct_chg") == 0).alias("mask"), (F.col("turnover") > 5e4).alias("big"))
    return rounded(po.mask_coverage(q, "mask", {"all": F.lit(True), "big": F.col("big")}), "coverage_pct")


def x22_pair_slopes(spark, d):
    """Interaction of factor pairs with the return."""
    return rounded(po.pair_slopes(_samples(spark, d), "trade_date", ["ret_5d", "ma20_gap", "volatility_20d"], "net_return"), "corr", "slope", digits=5)


def x41_linear(spark, d):
    """Capped linear and logistic score of the samples."""
    s = po.linear_score(_samples(spark, d), {"ret_5d": 0.02, "ma20_gap": -0.05}, 0.1, 0.3)
    return rounded(s.select("code", "trade_date", "increment", "probability"), "increment", "probability")


def x35_rerank(spark, d):
    """Re-ranking only where all rows have a prediction."""
    s = tb.signals(spark, d).withColumn("prediction", F.when(F.col("signal_id") % 3 != 0, F.round(F.col("score") / 7, 6))).withColumn("uncertainty", F.round(F.col("signal_id") % 11 / 2.0, 6))
    return po.rank_if_all_ready(s, ["strategy", "signal_date"]).select("signal_id", "place")


def a6_pooled_ic(spark, d):
    """Rank IC over all rows at once."""
    g = va.pooled_rank_ic(_samples(spark, d), ["ret_5d", "ma20_gap"], "net_return")
    return rounded(g, "ic", digits=5)


def a9_phases(spark, d):
    """Outcomes by third of the month."""
    o = _outcomes(spark, d).withColumn("phase", F.when(F.dayofmonth("signal_date") <= 10, "early").when(F.dayofmonth("signal_date") <= 20, "middle").otherwise("late"))
    g = o.groupBy("phase").agg(F.count("*").alias("n"), F.countDistinct("signal_date").alias("days"), F.avg("net_return").alias("avg_net"))
    return rounded(g, "avg_net")


def a34_signal_dates(spark, d):
    """Signals by date and strategy: counts, best score."""
    return tb.signals(spark, d).groupBy("signal_date", "strategy").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def a38_signal_codes(spark, d):
    """Top 50 codes by number of signals: latest date and best rank."""
    g = tb.signals(spark, d).groupBy("code").agg(F.count("*").alias("n"), F.max("signal_date").alias("latest"), F.min("rank").alias("best_rank"))
    return g.orderBy(F.desc("n"), "code").limit(50)


def a37_batches(spark, d):
    """Up, down, pending by strategy and month."""
    o = _outcomes(spark, d).withColumn("batch", F.date_format("signal_date", "yyyy-MM"))
    n = {"up": F.col("net_return") > 0, "down": F.col("net_return") <= 0, "pending": F.col("state") == "pending", "skipped": F.col("state") == "no_bars"}
    return o.groupBy("strategy", "batch").agg(*[F.sum(F.coalesce(c.cast("bigint"), F.lit(0))).alias(k) for k, c in n.items()])


def j5_overlay(spark, d):
    """Quotes overlaid by a newer feed."""
    q = tb.quotes(spark, d).groupBy("id").agg(F.max_by(F.struct("price", "volume"), "trade_date").alias("x")).select("id", "x.price", "x.volume")
    n = tb.ticks(spark, d).where("kind = 'click'").select(F.col("code").alias("id"), "price", F.lit(None).cast("double").alias("volume"), "ts")
    return rounded(ig.overlay(q, n, "id", ["price", "volume"], "ts"), "price", "volume")


def j1_factor_lookup(spark, d):
    """Signals with the factors of their day, zeros where there are none."""
    from ..operators.factors import with_factors

    f = with_factors(tb.bars(spark, d)).select("code", F.col("trade_date").alias("signal_date"), "ret_5d", "ma20_gap")
    j = tb.signals(spark, d).join(f, ["code", "signal_date"], "left").fillna(0.0, ["ret_5d", "ma20_gap"])
    return rounded(j.select("signal_id", "ret_5d", "ma20_gap"), "ret_5d", "ma20_gap")


def j17_audit(spark, d):
    """Orders left joined with lines and customers: what is missing."""
    o, li, c = tb.read(spark, d, "orders"), tb.read(spark, d, "lineitem"), tb.read(spark, d, "customer")
    n = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    j = o.join(n, "o_orderkey", "left").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.sum(F.col("lines").isNull().cast("bigint")).alias("without_lines"), F.sum(F.coalesce("lines", F.lit(0))).alias("lines"))


def l1_top_n(spark, d):
    """The hundred dearest orders."""
    return tb.read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


def u2_common_dates(spark, d):
    """Dates on which strategies 1 and 2 both have a signal."""
    s = tb.signals(spark, d)
    return s.where("strategy = '1'").select("signal_date").intersect(s.where("strategy = '2'").select("signal_date"))


def x28_index_returns(spark, d):
    """Equal-weight index of all codes and its five-day forward return."""
    q = tb.quotes(spark, d).groupBy("trade_date").agg(F.avg("pct_chg").alias("r"), F.count("*").alias("codes"))
    w = Window.partitionBy(F.lit(0)).orderBy("trade_date")  # one row a date
    i = q.withColumn("level", F.exp(F.sum(F.log(1 + F.col("r") / 100)).over(w)))
    i = i.withColumn("forward_5d", (F.lead("level", 5).over(w) / F.col("level") - 1) * 100)
    return rounded(i.select("trade_date", "codes", "level", "forward_5d"), "level", "forward_5d", digits=5)


QUERIES = [f8_themes, f10_style, f16_regime_gate, f15_tiers, w18_backup_fill, w19_quota_pool, a21_cost_distribution, q10_quantiles, q9_sign_test, a29_consensus, u3_set_changes, a32_violations, a20_mask_coverage, x22_pair_slopes, x41_linear, x35_rerank, a6_pooled_ic, a9_phases, a34_signal_dates, a38_signal_codes, a37_batches, j5_overlay, j1_factor_lookup, j17_audit, l1_top_n, u2_common_dates, x28_index_returns]

from .trading import _IC, _SAMPLES  # noqa: E402

_LEVELS = """
, lv AS (SELECT trade_date, CASE WHEN sc >= 68 THEN 'risk_on' WHEN sc <= 42 THEN 'risk_off' ELSE 'balanced' END AS level FROM (
  SELECT trade_date, greatest(0, least(100, 50 + median(pct_chg) * 7.5::DOUBLE + (avg(CASE WHEN pct_chg > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100 - 50) * 0.55::DOUBLE
    + (avg(CASE WHEN pct_chg >= 3 THEN 1.0::DOUBLE ELSE 0 END) * 100 - avg(CASE WHEN pct_chg <= -3 THEN 1.0::DOUBLE ELSE 0 END) * 100) * 0.35::DOUBLE - greatest(0, avg(amplitude) - 7) * 2.4::DOUBLE)) AS sc FROM quotes GROUP BY trade_date))"""
ORACLES = {
    "f8_themes": "SELECT p_partkey, CASE WHEN regexp_matches(upper(p_name || ' ' || p_type), 'RING|BOLT') THEN 'circle' WHEN regexp_matches(upper(p_name || ' ' || p_type), 'GEAR|WIDGET') THEN 'gear' ELSE p_brand END AS theme, least(80.0::DOUBLE, 50 + 15 * (contains(upper(p_name), 'RED')::INT + contains(upper(p_name), 'RING')::INT + contains(upper(p_name), 'SMALL')::INT)) AS score FROM part",
    "f10_style": "SELECT s_suppkey, CASE WHEN s_acctbal * 1e7 >= 1e11 THEN 'large' WHEN s_acctbal * 1e7 >= 2e10 THEN 'mid' WHEN s_acctbal > 0 THEN 'small' ELSE 'unknown' END AS style FROM supplier",
    "f16_regime_gate": with_views(["quotes"], _LEVELS + """
, j AS (SELECT q.trade_date, id, round(pct_chg, 9) AS p, level, CASE level WHEN 'risk_on' THEN 0 WHEN 'balanced' THEN 1 ELSE 3 END AS fl, CASE level WHEN 'risk_on' THEN 3 WHEN 'balanced' THEN 2 ELSE 1 END AS sl FROM quotes q JOIN lv USING (trade_date)),
g AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY p >= fl DESC, p DESC, id) AS gate_place FROM j)
SELECT trade_date, id, level, gate_place, concat_ws(',', CASE WHEN p < fl THEN 'score' END, CASE WHEN gate_place > sl THEN 'slots' END) AS reasons, p >= fl AND gate_place <= sl AS eligible FROM g"""),
    "f15_tiers": with_views(["signals"], """
, s AS (SELECT signal_id, strategy, signal_date, CASE WHEN day(signal_date) % 3 = 0 THEN CASE WHEN rank = 1 THEN 'primary_watch' ELSE 'backup_watch' END END AS tier FROM signals WHERE signal_id % 5 = 0 OR signal_id % 7 <> 0)
SELECT signal_id, tier FROM s QUALIFY NOT bool_or(tier IS NOT NULL) OVER (PARTITION BY strategy, signal_date) OR tier = 'primary_watch'"""),
    "w18_backup_fill": with_views(["quotes"], """
, n AS (SELECT *, substr(code, 1, 3) AS theme, row_number() OVER (PARTITION BY trade_date ORDER BY turnover DESC, id) AS n FROM quotes)
SELECT b.trade_date, b.id, row_number() OVER (PARTITION BY b.trade_date ORDER BY p.theme = b.theme, p.industry = b.industry, b.turnover DESC, b.id) AS place FROM n b JOIN n p ON p.trade_date = b.trade_date AND p.n = 1 WHERE b.n > 1 QUALIFY place <= 2"""),
    "w19_quota_pool": with_views(["quotes"], """
, q AS (SELECT trade_date, id, round(pct_chg, 9) AS p, row_number() OVER (PARTITION BY trade_date ORDER BY turnover DESC, id) AS a FROM quotes), r AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY p, id) AS b FROM q WHERE a > 2),
s AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY p DESC, id) AS c FROM r WHERE b > 1)
SELECT trade_date, id, CAST(0 AS BIGINT) AS stage FROM q WHERE a <= 2 UNION ALL SELECT trade_date, id, 1 FROM r WHERE b = 1 UNION ALL SELECT trade_date, id, 2 FROM s WHERE c = 1"""),
    "a21_cost_distribution": with_views(["outcomes"], "SELECT strategy, count(total_pct) AS n, round(avg(total_pct), 6) AS mean, round(min(total_pct), 6) AS min, round(quantile_cont(total_pct, 0.5), 6) AS p50, round(quantile_cont(total_pct, 0.95), 6) AS p95, round(max(total_pct), 6) AS max FROM (SELECT strategy, CASE WHEN entry_price IS NOT NULL THEN total_pct ELSE 0.7 END AS total_pct FROM outcomes) GROUP BY strategy"),
    "q10_quantiles": with_views(["bars"], ", g AS (SELECT code, list_sort(list(close)) AS v, quantile_cont(close, 0.25) AS linear FROM bars GROUP BY code) SELECT code, round(v[1 + least(len(v) - 1, CAST(floor(len(v) * 0.25) AS BIGINT))], 6) AS floor_index, round(v[1 + CAST(round((len(v) - 1) * 0.25::DOUBLE) AS BIGINT)], 6) AS round_index, round(linear, 6) AS linear FROM g"),
    "q9_sign_test": with_views(["settled"], """
, o AS (SELECT code, count(*) AS n, count(*) FILTER (net_return > 0) AS k FROM settled GROUP BY code)
SELECT code, n, k, round(least(1, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM (SELECT unnest(range(0, (SELECT max(n) + 1 FROM o))) AS i) WHERE i BETWEEN k AND n)), 6) AS tail FROM o"""),
    "a29_consensus": with_views(["signals"], """
, c AS (SELECT code, count(*) AS appearances, array_to_string(list_sort(list(DISTINCT strategy)), ',') AS strategies, avg(score) FILTER (signal_id % 4 <> 0) AS a, avg(score) FILTER (signal_id % 4 = 0) AS b FROM signals WHERE rank = 1 GROUP BY code),
v AS (SELECT *, coalesce(a, b) + least(10, (appearances - 1) * 4) - 2 AS direction FROM c)
SELECT code, appearances, strategies, round(a, 6) AS avg_score, round(b, 6) AS avg_observed, round(direction, 6) AS direction, CASE WHEN direction >= 60 THEN 'up' WHEN direction <= 40 THEN 'down' ELSE 'neutral' END AS verdict FROM v"""),
    "u3_set_changes": with_views(["signals"], """
, m AS (SELECT DISTINCT strategy, code, signal_date, dense_rank() OVER (PARTITION BY strategy ORDER BY signal_date) AS i FROM signals), dd AS (SELECT DISTINCT strategy, signal_date, i FROM m)
SELECT dd.strategy, dd.signal_date, count(*) FILTER (w IS NULL) AS new, count(*) FILTER (n IS NOT NULL AND w IS NOT NULL) AS kept, count(*) FILTER (n IS NULL) AS dropped
FROM (SELECT coalesce(a.strategy, b.strategy) AS strategy, coalesce(a.i, b.i + 1) AS i, a.code AS n, b.code AS w FROM m a FULL JOIN m b ON a.strategy = b.strategy AND a.i = b.i + 1 AND a.code = b.code) x JOIN dd ON dd.strategy = x.strategy AND dd.i = x.i GROUP BY ALL"""),
    "a32_violations": "SELECT l_returnflag, v AS violation, count(*) AS n FROM (SELECT l_returnflag, unnest([CASE WHEN l_discount > 0.08::DOUBLE THEN 'discount' END, CASE WHEN l_tax < 0.01::DOUBLE THEN 'tax' END, CASE WHEN l_quantity >= 50 THEN 'quantity' END]) AS v FROM lineitem) WHERE v IS NOT NULL GROUP BY ALL",
    "a20_mask_coverage": with_views(["quotes"], ", s AS (SELECT 'all' AS scope, * FROM quotes UNION ALL SELECT 'big', * FROM quotes WHERE turnover > 5e4) SELECT scope, 'prev_close' AS field, count(prev_close) AS present, count(*) AS total, round(count(prev_close) / count(*) * 100, 6) AS coverage_pct FROM s GROUP BY scope UNION ALL SELECT scope, 'change', count(*) FILTER (pct_chg <> 0), count(*), round(count(*) FILTER (pct_chg <> 0) / count(*) * 100, 6) FROM s GROUP BY scope"),
    "x22_pair_slopes": with_views(["factors"], _SAMPLES + """
, d AS (SELECT *, net_return - avg(net_return) OVER (PARTITION BY trade_date) AS r FROM sm), p AS (SELECT 'ret_5d*ma20_gap' AS pair, ret_5d * ma20_gap AS v, r FROM d UNION ALL SELECT 'ret_5d*volatility_20d', ret_5d * volatility_20d, r FROM d UNION ALL SELECT 'ma20_gap*volatility_20d', ma20_gap * volatility_20d, r FROM d)
SELECT pair, count(*) AS n, round(covar_pop(v, r) / sqrt(var_pop(v) * var_pop(r)), 5) AS corr, round(covar_pop(v, r) / var_pop(v), 5) AS slope FROM p GROUP BY pair"""),
    "x41_linear": with_views(["factors"], _SAMPLES + ", z AS (SELECT *, 0.1::DOUBLE + ret_5d * 0.02::DOUBLE + ma20_gap * -0.05::DOUBLE AS z FROM sm) SELECT code, trade_date, round(greatest(-0.3, least(0.3, z)), 6) AS increment, round(1 / (1 + exp(-z)), 6) AS probability FROM z"),
    "x35_rerank": with_views(["signals"], """
, p AS (SELECT *, CASE WHEN signal_id % 3 <> 0 THEN round(score / 7, 6) END AS p, round(signal_id % 11 / 2.0::DOUBLE, 6) AS u FROM signals)
SELECT signal_id, CASE WHEN bool_and(p IS NOT NULL) OVER (PARTITION BY strategy, signal_date) THEN row_number() OVER (PARTITION BY strategy, signal_date ORDER BY p - 0.25::DOUBLE * u DESC NULLS LAST, rank) ELSE row_number() OVER (PARTITION BY strategy, signal_date ORDER BY rank) END AS place FROM p"""),
    "a6_pooled_ic": with_views(["factors"], _IC.replace("SELECT trade_date, net_return AS r", "SELECT 'all' AS trade_date, net_return AS r") + " SELECT factor, trade_date AS pool, n, round(ic, 5) AS ic FROM ic WHERE factor IN ('ret_5d', 'ma20_gap')"),
    "a9_phases": with_views(["outcomes"], "SELECT CASE WHEN day(signal_date) <= 10 THEN 'early' WHEN day(signal_date) <= 20 THEN 'middle' ELSE 'late' END AS phase, count(*) AS n, count(DISTINCT signal_date) AS days, round(avg(exit_return - total_pct) FILTER (state = 'settled'), 6) AS avg_net FROM outcomes GROUP BY 1"),
    "a34_signal_dates": with_views(["signals"], "SELECT signal_date, strategy, count(*) AS n, max(score) AS best FROM signals GROUP BY ALL"),
    "a38_signal_codes": with_views(["signals"], "SELECT code, count(*) AS n, max(signal_date) AS latest, min(rank) AS best_rank FROM signals GROUP BY code ORDER BY n DESC, code LIMIT 50"),
    "a37_batches": with_views(["outcomes"], "SELECT strategy, strftime(signal_date, '%Y-%m') AS batch, count(*) FILTER (state = 'settled' AND exit_return - total_pct > 0) AS up, count(*) FILTER (state = 'settled' AND exit_return - total_pct <= 0) AS down, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'no_bars') AS skipped FROM outcomes GROUP BY ALL"),
    "j5_overlay": with_views(["quotes"], ", q AS (SELECT id, price, volume FROM quotes QUALIFY row_number() OVER (PARTITION BY id ORDER BY trade_date DESC) = 1), n AS (SELECT user_id, value FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1) SELECT id, round(coalesce(value, price), 6) AS price, round(volume, 6) AS volume FROM q LEFT JOIN n ON id = user_id"),
    "j1_factor_lookup": with_views(["factors", "signals"], "SELECT signal_id, round(coalesce(ret_5d, 0), 6) AS ret_5d, round(coalesce(ma20_gap, 0), 6) AS ma20_gap FROM signals s LEFT JOIN factors f ON f.code = s.code AND f.trade_date = s.signal_date"),
    "j17_audit": "WITH n AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) SELECT c_mktsegment, count(*) AS orders, count(*) FILTER (lines IS NULL) AS without_lines, CAST(sum(coalesce(lines, 0)) AS BIGINT) AS lines FROM orders LEFT JOIN n ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1",
    "l1_top_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "u2_common_dates": with_views(["signals"], "SELECT signal_date FROM signals WHERE strategy = '1' INTERSECT SELECT signal_date FROM signals WHERE strategy = '2'"),
    "x28_index_returns": with_views(["quotes"], ", q AS (SELECT trade_date, avg(pct_chg) AS r, count(*) AS codes FROM quotes GROUP BY 1), i AS (SELECT *, exp(sum(ln(1 + r / 100)) OVER (ORDER BY trade_date)) AS level FROM q) SELECT trade_date, codes, round(level, 5) AS level, round((lead(level, 5) OVER (ORDER BY trade_date) / level - 1) * 100, 5) AS forward_5d FROM i"),
}

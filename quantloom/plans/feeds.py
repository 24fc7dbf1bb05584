"""Queries on raw feeds, policies on rows, long-term profiles, labels of predictions and audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import crosssection as cs
from ..operators import execution as ex
from ..operators import policies as po
from ..operators import portfolio as pf
from ..operators import stats as st
from ..sources import ingest as ig
from ..sources import tables as tb
from .market import rounded
from .trading import _outcomes
from .views import with_views


def s1_conform(spark, d):
    """A raw feed with foreign column names, conformed."""
    p = tb.read(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".SZ")).alias("ts_code"), F.col("p_name").alias("名称"), F.format_number("p_retailprice", 2).alias("最新价"), F.concat(F.col("p_size").cast("string"), F.lit("%")).alias("涨跌幅"))
    return ig.conform(p).select("code", "name", "price", "pct_chg", "turnover")


def s12_supported(spark, d):
    """First row of each supported, ordinary code."""
    from ..functions.scalars import is_supported_code

    q = tb.quotes(spark, d).where(is_supported_code(F.col("code")) & ~F.col("name").rlike("(?i)ST"))
    return ig.latest_by_key(q, ["code"], [F.col("trade_date"), F.col("id")]).select("code", "id", "trade_date")


def s15_enrich(spark, d):
    """Zero prices filled from the last tick of the code."""
    c = tb.read(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.when(F.col("s_suppkey") % 2 == 0, 0.0).otherwise(F.col("s_acctbal")).alias("price"))
    return ig.enrich(c, tb.ticks(spark, d).where("kind = 'view'"), "code", ["price"], "ts")


def s17_news(spark, d):
    """The newest three documents of each source that mention a word, with a title from the text."""
    n = tb.read(spark, d, "documents").where(F.col("text").contains("tion")).select("doc_id", "source", F.substring("text", 1, 80).alias("title"))
    return cs.top_by_score(n, ["source"], [F.desc("doc_id")], 3)


def s21_latest_snapshot(spark, d):
    """Days and codes, and the newest date's content hash."""
    h = ig.snapshot_hash(tb.quotes(spark, d))
    return h.agg(F.count("*").alias("days"), F.max("trade_date").alias("latest"), F.max_by("rows", "trade_date").alias("rows"))


def f5_hard_reject(spark, d):
    """Quotes that a strict and a relaxed predicate reject, by date."""
    q = tb.quotes(spark, d)
    strict = (F.col("pct_chg") > 6) | (F.col("pct_chg") < -1) | (F.col("amplitude") > 8) | (F.col("turnover") < 3e4)
    relaxed = (F.col("pct_chg") > 8) | (F.col("pct_chg") < -4) | (F.col("turnover") < 1e4)
    return q.groupBy("trade_date").agg(F.sum(strict.cast("bigint")).alias("strict"), F.sum(relaxed.cast("bigint")).alias("relaxed"), F.count("*").alias("n"))


def f19_risk_labels(spark, d):
    """Risk labels of each quote and their score."""
    rules = {"deep_drop": F.col("pct_chg") < -5, "chase": F.col("pct_chg") > 6, "range": F.col("amplitude") > 8, "thin": F.col("turnover") < 2e4, "gap": F.abs(F.col("open") / F.col("prev_close") - 1) > 0.05}
    q = tb.quotes(spark, d).withColumn("risks", F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()])))
    q = q.where(F.size("risks") > 0).withColumn("risk_score", 35.0 + 10.0 * F.size("risks") + F.when(F.array_contains("risks", "chase"), 20.0).otherwise(0.0))
    return q.select("trade_date", "id", F.concat_ws(",", "risks").alias("risks"), "risk_score")


def f20_announcements(spark, d):
    """Announcement words in the newest two documents of each source."""
    n = tb.read(spark, d, "documents").select("source", "doc_id", F.col("text").alias("title"))
    n = cs.top_by_score(n, ["source"], [F.desc("doc_id")], 2).withColumn("flags", F.array_compact(F.array(*[F.when(F.lower("title").contains(w), w) for w in ("the", "der", "les", "que", "tion")])))
    g = n.groupBy("source").agg(F.flatten(F.collect_list("flags")).alias("f"))
    return g.select("source", F.concat_ws(",", F.slice(F.array_sort(F.array_distinct("f")), 1, 10)).alias("flags"))


def j6_metric_rows(spark, d):
    """Signals joined with outcomes and the day's regime, coalesced."""
    r = cs.market_regime(tb.quotes(spark, d)).select(F.col("trade_date").alias("signal_date"), "level")
    o = _outcomes(spark, d).join(r, "signal_date", "left")
    return rounded(o.select("signal_id", F.coalesce("level", F.lit("unknown")).alias("level"), F.coalesce("net_return", "return_3d", "return_1d", F.lit(0.0)).alias("result")), "result")


def a11_next_day(spark, d):
    """Open, close, high and low of the next day against the signal, by strategy."""
    b = tb.bars(spark, d)
    n = ex.forward_bars(ex.signal_index(tb.signals(spark, d), b), b, 1).where("entry_price > 0").join(tb.signals(spark, d).select("signal_id", "strategy"), "signal_id")
    e = F.col("entry_price")
    g = n.groupBy("strategy").agg(F.count("*").alias("n"), *[F.avg((F.col(c) / e - 1) * 100).alias(f"avg_{c}") for c in ("open", "close", "high", "low")], (F.avg((F.col("close") > e).cast("double")) * 100).alias("win_rate"))
    return rounded(g, "avg_open", "avg_close", "avg_high", "avg_low", "win_rate")


def a14_stance(spark, d):
    """Outcomes by stance."""
    o = _outcomes(spark, d).where("state = 'settled'").withColumn("stance", F.when(F.col("score") >= 66, "up").when(F.col("score") <= 33, "down").otherwise("neutral"))
    g = o.groupBy("stance").agg(F.count("*").alias("n"), F.avg("return_1d").alias("avg_1d"), F.avg("return_3d").alias("avg_3d"), (F.avg((F.col("return_3d") > 0).cast("double")) * 100).alias("win_rate"))
    return rounded(g, "avg_1d", "avg_3d", "win_rate")


def a26_event_alpha(spark, d):
    """Events weighted by kind, confidence and horizon, priced-in ones at 0.45, around 50."""
    e = tb.ticks(spark, d)
    w = F.create_map(*[x for k, v in {"purchase": 6.0, "signup": 4.0, "view": 1.0, "click": 2.0, "error": -8.0}.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    part = w * F.least(F.lit(1.0), F.col("price") / 40) * F.when(F.col("event_id") % 4 == 0, 0.45).otherwise(1.0)
    g = e.groupBy("code").agg(F.count("*").alias("events"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + F.avg(part) * 5)).alias("score"))
    return rounded(g, "score")


def a30_increments(spark, d):
    """Industries of quotes that enter or leave the top three between two orders: signed change and largest share."""
    q = tb.quotes(spark, d)
    a = cs.top_by_score(q, ["trade_date"], [F.desc("turnover"), F.col("id")], 1).select("trade_date", "industry", F.lit(1).alias("a"))
    b = cs.top_by_score(q, ["trade_date"], [F.desc("volume"), F.col("id")], 1).select("trade_date", "industry", F.lit(1).alias("b"))
    j = a.join(b, ["trade_date", "industry"], "full")
    return j.groupBy("industry").agg(F.sum((F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).cast("bigint")).alias("change"), F.count("*").alias("n"))


def a36_suggestions(spark, d):
    """Tuning suggestions from strategy metrics."""
    o = _outcomes(spark, d).where("state = 'settled'").groupBy("strategy").agg(F.count("*").alias("n"), F.avg("net_return").alias("net"), F.min("max_drawdown").alias("worst"))
    rules = F.array_compact(F.array(F.when(F.col("n") < 250, "collect_more"), F.when(F.col("net") < 0, "raise_floor"), F.when(F.col("worst") < -8, "tighten_stop")))
    return o.select("strategy", F.explode(rules).alias("suggestion"))


def a40_factor_quality(spark, d):
    """Fields of priced rows whose coverage is below 99 %."""
    c = cs.field_coverage(tb.quotes(spark, d).where("price > 0"), ["prev_close", "turnover", "industry"])
    return rounded(c.withColumn("passed", F.col("coverage_pct") >= 99), "coverage_pct")


def a41_recomputed(spark, d):
    """Stored returns against recomputed ones: rows beyond a tolerance."""
    o = _outcomes(spark, d).where("state = 'settled'").withColumn("stored", F.when(F.col("signal_id") % 50 == 0, F.col("net_return") + 0.01).otherwise(F.col("net_return")))
    v = po.violations(o, ["strategy"], {"net": F.abs(F.col("stored") - (F.col("exit_return") - F.col("total_pct"))) > 0.0015, "cost": F.col("total_pct") < 0.25})
    return v.groupBy("strategy", "violation").agg(F.count("*").alias("n"))


def w6_previous(spark, d):
    """Previous close, one-day return and amplitude of each bar."""
    w = Window.partitionBy("code").orderBy("trade_date")
    b = tb.bars(spark, d).withColumn("prev_close", F.lag("close").over(w))
    return rounded(b.select("code", "trade_date", "prev_close", ((F.col("close") / F.col("prev_close") - 1) * 100).alias("ret_1d"), ((F.col("high") - F.col("low")) / F.col("prev_close") * 100).alias("amplitude")), "prev_close", "ret_1d", "amplitude")


def w17_first_tradable(spark, d):
    """First bar after a fall of 4 % or more that does not fall so again."""
    w = Window.partitionBy("code").orderBy("trade_date")
    b = tb.bars(spark, d).withColumn("fall", F.coalesce(F.col("close") / F.lag("close").over(w) - 1 <= -0.04, F.lit(False)))
    b = b.withColumn("next_ok", F.min(F.when(~F.col("fall"), F.col("trade_date"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return b.where("fall").select("code", "trade_date", "next_ok")


def x13_long_term(spark, d):
    """Long-term profile of parts: value, size, growth; blockers and eligibility."""
    p = tb.read(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("pe"), F.col("p_size").cast("double").alias("cap"), (F.col("p_partkey") % 60 - 20).cast("double").alias("growth"), F.lit(1).alias("g"))
    s = cs.percentile_scores(p, ["g"], ["pe", "cap", "growth"], inverse=("pe",))
    score = 0.4 * F.col("pe_pct") + 0.3 * F.col("cap_pct") + 0.3 * F.col("growth_pct")
    block = F.array_compact(F.array(F.when(F.col("growth") < 0, "growth"), F.when(F.col("cap") < 5, "size")))
    return rounded(s.select("p_partkey", score.alias("score"), F.concat_ws(",", block).alias("blockers"), (F.size(block) == 0).alias("eligible")), "score")


def x19_records(spark, d):
    """Execution records: quantity, fill, net amount."""
    o = ex.with_order_quantity(_outcomes(spark, d), "entry_price")
    filled = F.when(F.col("state") == "settled", F.col("order_quantity")).otherwise(0)
    return rounded(o.select("signal_id", "order_quantity", filled.alias("filled_quantity"), (filled * F.col("entry_price") * F.col("net_return") / 100).alias("net_amount")), "net_amount", digits=4)


def x30_paper_trades(spark, d):
    """Paper trades: return by holding days and a mixed book's value by date."""
    o = _outcomes(spark, d).where("state = 'settled' and rank = 1")
    day = o.groupBy("signal_date").agg(F.count("*").alias("trades"), F.avg("net_return").alias("r"), F.avg("exit_days").alias("held")).withColumn("book", F.lit("mixed"))
    return rounded(st.net_asset_value(day, ["book"], "signal_date", "r").select("signal_date", "trades", "held", "nav"), "held", "nav", digits=5)


def x33_candidate_rows(spark, d):
    """Frozen rows of the universe: eligibility, reasons, missing fields."""
    from ..operators.filters import failures

    q = tb.quotes(spark, d).withColumn("f", failures(3e4))
    missing = F.concat_ws(",", F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in ("prev_close", "industry")])))
    return q.select("trade_date", "id", (F.size("f") == 0).alias("eligible"), F.size("f").cast("bigint").alias("reasons"), missing.alias("missing"))


def x34_prediction_labels(spark, d):
    """Predictions without an outcome yet, labelled."""
    s = tb.signals(spark, d).where("rank = 1")
    todo = s.join(s.where("signal_id % 2 = 0").select("signal_id"), "signal_id", "left_anti")
    o = ex.outcomes(todo, tb.bars(spark, d)).withColumn("stance", F.when(F.col("score") >= 50, 1).otherwise(-1))
    return rounded(o.select("signal_id", "state", (F.col("return_3d") * F.col("stance")).alias("directed")), "directed")


def x36_event_score(spark, d):
    """Blend of five event measures, priced-in ones less 12."""
    e = tb.read(spark, d, "events").select("event_id", *[((F.col("event_id") * k) % 101).cast("double").alias(f"m{k}") for k in (3, 5, 7, 11, 13)], (F.col("event_id") % 6 == 0).alias("priced"))
    s = 0.34 * F.col("m3") + 0.20 * F.col("m5") + 0.18 * F.col("m7") + 0.18 * F.col("m11") + 0.10 * F.col("m13") - F.when(F.col("priced"), 12.0).otherwise(0.0)
    return rounded(e.select("event_id", F.greatest(F.lit(0.0), s).alias("score")), "score")


def x40_position_scale(spark, d):
    """Gate decisions joined to signals: scaled or zero positions."""
    from ..operators.validation import promotion_gates, strategy_metrics

    g = promotion_gates(strategy_metrics(_outcomes(spark, d), 2), 1, 60)
    return tb.signals(spark, d).join(F.broadcast(g), "strategy").select("signal_id", "status", (F.lit(20.0) * F.col("position_scale")).alias("weight"))


def x26_exposure(spark, d):
    """Mean weight and number of holdings by date under caps, from the daily baseline."""
    w = pf.capped_weights(tb.quotes(spark, d), ["trade_date"], "turnover", "industry", 0.5, 1.0, 0.8)
    g = w.groupBy("trade_date").agg(F.count("*").alias("n"), F.max("weight").alias("largest"))
    return rounded(g, "largest")


QUERIES = [s1_conform, s12_supported, s15_enrich, s17_news, s21_latest_snapshot, f5_hard_reject, f19_risk_labels, f20_announcements, j6_metric_rows, a11_next_day, a14_stance, a26_event_alpha, a30_increments, a36_suggestions, a40_factor_quality, a41_recomputed, w6_previous, w17_first_tradable, x13_long_term, x19_records, x30_paper_trades, x33_candidate_rows, x34_prediction_labels, x36_event_score, x40_position_scale, x26_exposure]

from .market import _RULES  # noqa: E402
from .rules import _LEVELS  # noqa: E402

_SUP = "substr(code, 1, 3) IN ('600','601','603','605','000','001','002','003','300','301','688')"
ORACLES = {
    "s1_conform": "SELECT CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= 6 THEN right(CAST(p_partkey AS VARCHAR), 6) ELSE lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS code, p_name AS name, round(p_retailprice, 2) AS price, CAST(p_size AS DOUBLE) AS pct_chg, 0.0::DOUBLE AS turnover FROM part",
    "s12_supported": with_views(["quotes"], f"SELECT code, id, trade_date FROM quotes WHERE {_SUP} AND NOT regexp_matches(name, '(?i)ST') QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date, id) = 1"),
    "s15_enrich": "WITH t AS (SELECT user_id, value FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1) SELECT s_suppkey AS code, CASE WHEN s_suppkey % 2 = 0 OR s_acctbal = 0 THEN coalesce(value, 0) ELSE s_acctbal END AS price FROM supplier LEFT JOIN t ON user_id = s_suppkey",
    "s17_news": "SELECT doc_id, source, substr(text, 1, 80) AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS place FROM documents WHERE contains(text, 'tion') QUALIFY place <= 3",
    "s21_latest_snapshot": with_views(["quotes"], ", g AS (SELECT trade_date, count(*) AS n FROM quotes GROUP BY 1) SELECT count(*) AS days, max(trade_date) AS latest, arg_max(n, trade_date) AS rows FROM g"),
    "f5_hard_reject": with_views(["quotes"], "SELECT trade_date, count(*) FILTER (pct_chg > 6 OR pct_chg < -1 OR amplitude > 8 OR turnover < 3e4) AS strict, count(*) FILTER (pct_chg > 8 OR pct_chg < -4 OR turnover < 1e4) AS relaxed, count(*) AS n FROM quotes GROUP BY 1"),
    "f19_risk_labels": with_views(["quotes"], ", r AS (SELECT trade_date, id, list_filter([CASE WHEN pct_chg < -5 THEN 'deep_drop' END, CASE WHEN pct_chg > 6 THEN 'chase' END, CASE WHEN amplitude > 8 THEN 'range' END, CASE WHEN turnover < 2e4 THEN 'thin' END, CASE WHEN abs(open / prev_close - 1) > 0.05::DOUBLE THEN 'gap' END], lambda x: x IS NOT NULL) AS r FROM quotes) SELECT trade_date, id, array_to_string(r, ',') AS risks, 35.0::DOUBLE + 10 * len(r) + CASE WHEN list_contains(r, 'chase') THEN 20 ELSE 0 END AS risk_score FROM r WHERE len(r) > 0"),
    "f20_announcements": "WITH n AS (SELECT source, lower(text) AS t FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 2) SELECT source, concat_ws(',', CASE WHEN bool_or(contains(t, 'der')) THEN 'der' END, CASE WHEN bool_or(contains(t, 'les')) THEN 'les' END, CASE WHEN bool_or(contains(t, 'que')) THEN 'que' END, CASE WHEN bool_or(contains(t, 'the')) THEN 'the' END, CASE WHEN bool_or(contains(t, 'tion')) THEN 'tion' END) AS flags FROM n GROUP BY source",
    "j6_metric_rows": with_views(["outcomes", "quotes"], _LEVELS + " SELECT signal_id, coalesce(level, 'unknown') AS level, round(coalesce(CASE WHEN state = 'settled' THEN exit_return - total_pct END, return_3d, return_1d, 0), 6) AS result FROM outcomes o LEFT JOIN lv ON lv.trade_date = o.signal_date"),
    "a11_next_day": with_views(["ahead"], "SELECT strategy, count(*) AS n, round(avg((open / entry_price - 1) * 100), 6) AS avg_open, round(avg((close / entry_price - 1) * 100), 6) AS avg_close, round(avg((high / entry_price - 1) * 100), 6) AS avg_high, round(avg((low / entry_price - 1) * 100), 6) AS avg_low, round(avg(CASE WHEN close > entry_price THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS win_rate FROM ahead JOIN signals USING (signal_id) WHERE step = 0 AND entry_price > 0 GROUP BY strategy"),
    "a14_stance": with_views(["settled"], "SELECT CASE WHEN score >= 66 THEN 'up' WHEN score <= 33 THEN 'down' ELSE 'neutral' END AS stance, count(*) AS n, round(avg(return_1d), 6) AS avg_1d, round(avg(return_3d), 6) AS avg_3d, round(avg(CASE WHEN return_3d > 0 THEN 1.0::DOUBLE WHEN return_3d IS NOT NULL THEN 0 END) * 100, 6) AS win_rate FROM settled GROUP BY 1"),
    "a26_event_alpha": "SELECT user_id AS code, count(*) AS events, round(greatest(0, least(100, 50 + avg(CASE event_type WHEN 'purchase' THEN 6.0::DOUBLE WHEN 'signup' THEN 4 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE -8 END * least(1.0::DOUBLE, value / 40) * CASE WHEN event_id % 4 = 0 THEN 0.45::DOUBLE ELSE 1 END) * 5)), 6) AS score FROM events GROUP BY user_id",
    "a30_increments": with_views(["quotes"], ", a AS (SELECT trade_date, industry FROM quotes QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY turnover DESC, id) = 1), b AS (SELECT trade_date, industry FROM quotes QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, id) = 1) SELECT coalesce(a.industry, b.industry) AS industry, CAST(sum(CASE WHEN b.industry IS NULL THEN 0 ELSE 1 END - CASE WHEN a.industry IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS change, count(*) AS n FROM a FULL JOIN b ON a.trade_date = b.trade_date AND a.industry = b.industry GROUP BY 1"),
    "a36_suggestions": with_views(["settled"], ", g AS (SELECT strategy, count(*) AS n, avg(net_return) AS net, min(max_drawdown) AS worst FROM settled GROUP BY 1) SELECT strategy, s AS suggestion FROM (SELECT strategy, unnest([CASE WHEN n < 250 THEN 'collect_more' END, CASE WHEN net < 0 THEN 'raise_floor' END, CASE WHEN worst < -8 THEN 'tighten_stop' END]) AS s FROM g) WHERE s IS NOT NULL"),
    "a40_factor_quality": with_views(["quotes"], " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS present, count(*) AS total, round(count({c}) / count(*) * 100, 6) AS coverage_pct, count({c}) / count(*) * 100 >= 99 AS passed FROM quotes WHERE price > 0" for c in ("prev_close", "turnover", "industry"))),
    "a41_recomputed": with_views(["settled"], "SELECT strategy, 'net' AS violation, count(*) AS n FROM settled WHERE signal_id % 50 = 0 GROUP BY strategy"),
    "w6_previous": with_views(["numbered"], "SELECT code, trade_date, round(prev_close, 6) AS prev_close, round((close / prev_close - 1) * 100, 6) AS ret_1d, round((high - low) / prev_close * 100, 6) AS amplitude FROM numbered"),
    "w17_first_tradable": with_views(["numbered"], ", f AS (SELECT *, coalesce(close / prev_close - 1 <= -0.04::DOUBLE, false) AS fall FROM numbered), n AS (SELECT *, min(CASE WHEN NOT fall THEN trade_date END) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ok FROM f) SELECT code, trade_date, next_ok FROM n WHERE fall"),
    "x13_long_term": """
WITH p AS (SELECT p_partkey, p_retailprice AS pe, CAST(p_size AS DOUBLE) AS cap, CAST(p_partkey % 60 - 20 AS DOUBLE) AS growth FROM part),
s AS (SELECT *, 0.4::DOUBLE * (100 - 100.0::DOUBLE * count(*) OVER (ORDER BY pe RANGE UNBOUNDED PRECEDING) / count(*) OVER ()) + 0.3::DOUBLE * (100.0::DOUBLE * count(*) OVER (ORDER BY cap RANGE UNBOUNDED PRECEDING) / count(*) OVER ()) + 0.3::DOUBLE * (100.0::DOUBLE * count(*) OVER (ORDER BY growth RANGE UNBOUNDED PRECEDING) / count(*) OVER ()) AS score FROM p)
SELECT p_partkey, round(score, 6) AS score, concat_ws(',', CASE WHEN growth < 0 THEN 'growth' END, CASE WHEN cap < 5 THEN 'size' END) AS blockers, growth >= 0 AND cap >= 5 AS eligible FROM s""",
    "x19_records": with_views(["outcomes"], ", q AS (SELECT *, coalesce(CAST(floor(200000.0::DOUBLE / entry_price / 100) * 100 AS BIGINT), 0) AS oq FROM outcomes) SELECT signal_id, oq AS order_quantity, CASE WHEN state = 'settled' THEN oq ELSE 0 END AS filled_quantity, round(CASE WHEN state = 'settled' THEN oq * entry_price * (exit_return - total_pct) / 100 END, 4) AS net_amount FROM q"),
    "x30_paper_trades": with_views(["settled"], ", y AS (SELECT signal_date, count(*) AS trades, avg(net_return) AS r, avg(exit_days) AS held FROM settled WHERE rank = 1 GROUP BY 1) SELECT signal_date, trades, round(held, 5) AS held, round(exp(sum(ln(1 + r / 100)) OVER (ORDER BY signal_date)), 5) AS nav FROM y"),
    "x33_candidate_rows": with_views(["quotes"], "SELECT trade_date, id, n = 0 AS eligible, n AS reasons, missing FROM (SELECT trade_date, id, CAST(" + " + ".join(f"(NOT ({c}))::INT" for _, c in _RULES) + " AS BIGINT) AS n, concat_ws(',', CASE WHEN prev_close IS NULL THEN 'prev_close' END, CASE WHEN industry IS NULL THEN 'industry' END) AS missing FROM quotes)"),
    "x34_prediction_labels": with_views(["outcomes"], "SELECT signal_id, state, round(return_3d * CASE WHEN score >= 50 THEN 1 ELSE -1 END, 6) AS directed FROM outcomes WHERE rank = 1 AND signal_id % 2 <> 0"),
    "x36_event_score": "SELECT event_id, round(greatest(0, 0.34::DOUBLE * (event_id * 3 % 101) + 0.20::DOUBLE * (event_id * 5 % 101) + 0.18::DOUBLE * (event_id * 7 % 101) + 0.18::DOUBLE * (event_id * 11 % 101) + 0.10::DOUBLE * (event_id * 13 % 101) - CASE WHEN event_id % 6 = 0 THEN 12 ELSE 0 END), 6) AS score FROM events",
    "x40_position_scale": with_views(["settled"], ", g AS (SELECT strategy, count(*) FILTER (rank <= 2) AS np, avg(net_return) FILTER (rank <= 2) AS ap, count(DISTINCT signal_date) FILTER (rank <= 2) AS dp FROM settled GROUP BY 1), f AS (SELECT strategy, list_filter([CASE WHEN np < 1 THEN 'samples' END, CASE WHEN dp < 60 THEN 'days' END, CASE WHEN coalesce(ap, -1e9) <= 0 THEN 'net_return' END], lambda x: x IS NOT NULL) AS f FROM g) SELECT signal_id, CASE WHEN len(f) = 0 THEN 'ready' ELSE f[1] END AS status, 20.0::DOUBLE * CASE len(f) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 ELSE 0 END AS weight FROM signals JOIN f USING (strategy)"),
}

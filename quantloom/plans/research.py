"""Queries on ingestion, point-in-time joins, risk events and portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import crosssection as cs
from ..operators import joins as jn
from ..operators import portfolio as pf
from ..operators import risk_events as rk
from ..sources import ingest as ig
from ..sources import tables as tb
from .market import rounded
from .trading import _outcomes
from .views import with_views

POSITIVE, NEGATIVE, RISK = {"tion": 3.0, "ing": 4.0}, {"ous": -5.0, "worth": -9.0, "und": -6.0}, ("worth", "und")


def s2_clean_numbers(spark, d):
    """Numbers written as text, cleaned."""
    from ..functions.scalars import coerce_number

    e = tb.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "-").when(F.col("event_id") % 5 == 1, F.concat(F.format_number("value", 2), F.lit("%"))).when(F.col("event_id") % 5 == 2, "nan").otherwise(F.col("value").cast("string")).alias("raw"))
    return e.select("event_id", F.round(coerce_number(F.col("raw")), 6).alias("value"))


def s3_codes(spark, d):
    """Codes normalised to six digits, with market and support flag."""
    from ..functions.scalars import is_supported_code, market_type, normalize_code

    p = tb.read(spark, d, "part").select("p_partkey", normalize_code(F.concat((F.col("p_partkey") * 37).cast("string"), F.lit(".SZ"))).alias("code"))
    return p.select("p_partkey", "code", market_type(F.col("code")).alias("market"), is_supported_code(F.col("code")).alias("supported"))


def s5_adjusted_bars(spark, d):
    """Raw bars of two thirds of the codes aligned with adjusted ones."""
    b = tb.bars(spark, d).select("code", "trade_date", "open", "high", "low", "close", "volume", "turnover")
    f = F.when(F.dayofmonth("trade_date") > 15, 0.5).otherwise(1.0)
    adj = b.where(F.dayofweek("trade_date") != 3).select("code", "trade_date", *[(F.col(c) * f).alias(c) for c in ("open", "high", "low", "close")], "volume", "turnover")
    return rounded(ig.adjusted_bars(b.where("code % 3 <> 1"), adj).select("code", "trade_date", "close", "adj_close", "adj_factor"), "close", "adj_close")


def s6_upsert(spark, d):
    """Last write wins on the order key."""
    o = tb.read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("updated"), F.col("o_totalprice").alias("value"))
    new = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 8 == 0, F.date_add("updated", 1)).otherwise(F.date_sub("updated", 1)).alias("updated"), (-F.col("value")).alias("value"))
    return ig.upsert(o, new, ["o_orderkey"], "updated")


def s8_last_bars(spark, d):
    """The last 30 bars of each code."""
    return ig.last_bars(tb.bars(spark, d), 30).select("code", "trade_date", "close")


def s11_work_list(spark, d):
    """Codes behind a date."""
    c = tb.read(spark, d, "supplier").select(F.col("s_suppkey").alias("code"))
    return ig.work_list(c, tb.bars(spark, d), "2001-10-20")


def s13_coverage_gate(spark, d):
    """Quote coverage of a batch."""
    return ig.coverage_gate(tb.quotes(spark, d), 100)


def s16_merge_fundamentals(spark, d):
    """Three sources of fundamentals, later ones stronger where not null."""
    p = tb.read(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_size").cast("double").alias("roe"), F.col("p_retailprice").alias("pe"))
    a = p.where("code % 2 = 0")
    b = p.where("code % 3 = 0").select("code", F.when(F.col("code") % 4 == 0, F.col("roe") + 100).alias("roe"), (F.col("pe") + 1).alias("pe"))
    c = p.where("code % 5 = 0").select("code", F.lit(None).cast("double").alias("roe"), F.when(F.col("code") % 10 == 0, F.col("pe") + 2).alias("pe"))
    return ig.merge_by_priority([a, b, c], "code", ["roe", "pe"])


def s22_universe(spark, d):
    """Universe rows of every date."""
    return ig.snapshot_rows(tb.quotes(spark, d), "close")


def s20_snapshot_hash(spark, d):
    """Content hash of each date's snapshot."""
    return ig.snapshot_hash(tb.quotes(spark, d))


def s27_fingerprint(spark, d):
    """Content fingerprint of the bars by code."""
    return ig.fingerprint(tb.bars(spark, d), ["code"])


def s28_prune(spark, d):
    """Line items whose order's priority is allowed, counted."""
    o, li = tb.read(spark, d, "orders"), tb.read(spark, d, "lineitem")
    kept, children = ig.prune(o.withColumnRenamed("o_orderkey", "l_orderkey"), li, "o_orderpriority", ["1-URGENT", "2-HIGH"], "l_orderkey")
    return kept.agg(F.count("*").alias("orders")).join(children.agg(F.count("*").alias("lines")), F.lit(True))


def j9_as_of(spark, d):
    """The newest tick of its code at or before each purchase."""
    t = tb.ticks(spark, d)
    left = t.where("kind = 'purchase'").select("event_id", "code", "ts")
    right = t.where("kind = 'view'").select("code", F.col("ts").alias("seen"), F.col("price").alias("view_price"), F.col("event_id").alias("view_id"))
    return jn.as_of(left, right, "code", "ts", "seen", ["view_price", "view_id"]).select("event_id", "code", "view_price", "view_id")


def j10_point_in_time(spark, d):
    """Facts known at the signal, and the rest by reason."""
    s = tb.signals(spark, d).where("rank = 1").select("signal_id", "code", "signal_date")
    f = tb.read(spark, d, "customer").join(tb.read(spark, d, "supplier").select(F.count("*").alias("n")), F.lit(True)).select((F.col("c_custkey") % F.col("n")).alias("code"), "c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.expr("date_add(date'1995-01-01', cast(c_custkey * 13 % 2400 as int))")).alias("published"))
    known, late = jn.point_in_time(s, f, "code", "signal_date", "published")
    return late.unionByName(known.agg(F.lit("known").alias("reason"), F.count("*").alias("n")))


def j12_cycle_returns(spark, d):
    """Return of a ten-day cycle that opens on a bar's day."""
    b = tb.bars(spark, d)
    e = tb.signals(spark, d).select("signal_id", "code", F.col("signal_date").alias("entry_date"), F.date_add("signal_date", 10).alias("exit_date"))
    return rounded(jn.cycle_returns(e, b).select("signal_id", "last_date", "cycle_return"), "cycle_return")


def j14_anti(spark, d):
    """Signals on days without a bar of their code."""
    return tb.signals(spark, d).join(tb.bars(spark, d).select("code", F.col("trade_date").alias("signal_date")), ["code", "signal_date"], "left_anti").groupBy("strategy").agg(F.count("*").alias("n"))


def j16_nearest(spark, d):
    """Five nearest parts of the same brand."""
    p = tb.read(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    q = p.where("p_partkey % 10 = 0").withColumnRenamed("p_partkey", "query_id")
    t = p.where("p_partkey % 10 <> 0").withColumnRenamed("p_partkey", "train_id")
    return rounded(jn.nearest(q, t, "p_brand", {"size": (10.0, 1.0), "price": (100.0, 2.0)}, 5), "distance")


def j19_latest_signals(spark, d):
    """Signals of each strategy's newest date."""
    s = tb.signals(spark, d)
    last = s.groupBy("strategy").agg(F.max("signal_date").alias("signal_date"))
    return s.join(F.broadcast(last), ["strategy", "signal_date"]).select("strategy", "signal_date", "signal_id", "rank")


def a25_event_risk(spark, d):
    """Event flags of three feeds merged by supplier."""
    li = tb.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("code")).agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("r"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"))
    s = li.select("code", F.round(F.col("r") * 100, 6).alias("returned"), F.round(F.col("disc") * 1000, 6).alias("discount"), F.round(F.col("tax") * 1000, 6).alias("tax"))
    flags = rk.flag_rows(s, "unlock", "returned", 32.0, 34.0).unionByName(rk.flag_rows(s, "pledge", "discount", 49.5, 50.5)).unionByName(rk.flag_rows(s, "report", "tax", 39.5, 40.5))
    return rk.event_risk(flags)


def a27_sentiment(spark, d):
    """Sentiment of documents by source."""
    n = tb.read(spark, d, "documents").select("source", F.col("text").alias("content"), F.when(F.col("doc_id") % 6 != 0, (F.col("doc_id") % 100).cast("double")).alias("hours"))
    return rounded(rk.news_sentiment(n, POSITIVE | NEGATIVE, RISK, "source", "hours"), "score")


def a28_blacklist(spark, d):
    """Blacklist items merged by code."""
    o = tb.read(spark, d, "orders")
    i = o.select((F.col("o_custkey") % 50).alias("code"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("critical")), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("level"), (F.col("o_orderkey") % 10).cast("double").alias("penalty"), (F.col("o_orderkey") % 97 == 0).alias("hard"), F.when(F.col("o_orderkey") % 3 != 0, F.to_date("o_orderdate")).alias("expires"), F.lit("1998-01-01").cast("date").alias("as_of"))
    return rk.merge_blacklist(i)


def x26_daily_portfolios(spark, d):
    """Top-two portfolio by strategy and date."""
    return rounded(pf.top_k_portfolios(_outcomes(spark, d), 2), "net_return_pct")


def x27_random_portfolios(spark, d):
    """A thousand random portfolios of five a date."""
    t = bt.trades(tb.bars(spark, d)).select("code", "trade_date", "net_return")
    return rounded(pf.random_portfolios(t, "trade_date", "net_return"), "random_mean", "p5", "p50", "p95")


def x25_capped_weights(spark, d):
    """Capped weights of each date's quotes by turnover, industry as theme."""
    w = pf.capped_weights(tb.quotes(spark, d), ["trade_date"], "turnover", "industry", 0.3, 0.5, 0.9)
    return rounded(w.select("trade_date", "id", "weight"), "weight")


def w16_turnover(spark, d):
    """Turnover of a turnover-weighted top three."""
    q = cs.top_by_score(tb.quotes(spark, d), ["trade_date"], [F.desc("turnover"), F.col("id")], 3)
    w = q.select(F.lit("a").alias("book"), "trade_date", F.col("id").alias("code"), F.lit(0.25).alias("weight"))
    return rounded(pf.turnover(w, "book", "trade_date"), "turnover")


def x29_paired(spark, d):
    """Daily increments of strategy 2 over strategy 1."""
    o = _outcomes(spark, d).where("state = 'settled'").groupBy("strategy", "signal_date").agg(F.avg("net_return").alias("r"))
    return rounded(pf.paired_days(o, "strategy", "signal_date", "r", "1", "2"), "base", "challenger", "increment")


def a31_benchmark(spark, d):
    """Market and industry mean change of each quote's date."""
    return rounded(pf.peer_benchmark(tb.quotes(spark, d).select("trade_date", "id", "industry", "pct_chg"), ["trade_date"], {"industry": "industry"}, "pct_chg"), "pct_chg", "market_return", "industry_return")


def w11_two_caps(spark, d):
    """Greedy selection under a market and an industry cap."""
    q = tb.quotes(spark, d).withColumn("theme", F.substring("code", 1, 3)).withColumn("order", -F.col("turnover"))
    g = cs.two_caps(q, ["trade_date"], ["order", "id"], "theme", "industry", 1, 1)
    return g.select("trade_date", "id", "place")


def x9_fundamental_scores(spark, d):
    """Quality and value of parts by brand."""
    p = tb.read(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 7 == 0, 0.0).otherwise(F.col("p_size").cast("double")).alias("roe"), (F.col("p_partkey") % 13).cast("double").alias("gross_margin"), (F.col("p_partkey") % 5).cast("double").alias("debt_ratio"), (F.col("p_retailprice") - 950).alias("pe_dynamic"), (F.col("p_partkey") % 17).cast("double").alias("pb"))
    return rounded(cs.fundamental_scores(p, ["p_brand"]).select("p_partkey", "quality_score", "value_score"), "quality_score", "value_score")


QUERIES = [s2_clean_numbers, s3_codes, s5_adjusted_bars, s6_upsert, s8_last_bars, s11_work_list, s13_coverage_gate, s16_merge_fundamentals, s22_universe, s20_snapshot_hash, s27_fingerprint, s28_prune, j9_as_of, j10_point_in_time, j12_cycle_returns, j14_anti, j16_nearest, j19_latest_signals, a25_event_risk, a27_sentiment, a28_blacklist, x26_daily_portfolios, x27_random_portfolios, x25_capped_weights, w16_turnover, x29_paired, a31_benchmark, w11_two_caps, x9_fundamental_scores]

_RAW = " + ".join(f"CASE WHEN contains(text, '{w}') THEN {v}::DOUBLE ELSE 0 END" for w, v in (POSITIVE | NEGATIVE).items())


def _member_pct(c: str, member: str, inverse: bool) -> str:
    n = f"count(*) FILTER ({member}) OVER b"
    lo, hi = f"min({c}) FILTER ({member}) OVER b", f"max({c}) FILTER ({member}) OVER b"
    low = f"(SELECT count(*) FROM p z WHERE z.p_brand = p.p_brand AND {member.replace(c, 'z.' + c)} AND z.{c} <= p.{c})"
    s = f"100.0::DOUBLE * {low} / {n}"
    return f"CASE WHEN {n} < 2 OR {lo} = {hi} THEN 50 ELSE {'100 - ' if inverse else ''}{s} END"


ORACLES = {
    "s2_clean_numbers": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN round(value, 2) WHEN 2 THEN 0 ELSE round(value, 6) END AS value FROM events",
    "s3_codes": "WITH c AS (SELECT p_partkey, CASE WHEN length(CAST(p_partkey * 37 AS VARCHAR)) >= 6 THEN right(CAST(p_partkey * 37 AS VARCHAR), 6) ELSE lpad(CAST(p_partkey * 37 AS VARCHAR), 6, '0') END AS code FROM part) SELECT p_partkey, code, CASE WHEN substr(code, 1, 3) IN ('688', '689') THEN 'star' WHEN substr(code, 1, 3) IN ('300', '301') THEN 'chinext' ELSE 'main' END AS market, substr(code, 1, 3) IN ('600','601','603','605','000','001','002','003','300','301','688') AS supported FROM c",
    "s5_adjusted_bars": with_views(["bars"], """
, a AS (SELECT code, trade_date, close * CASE WHEN day(trade_date) > 15 THEN 0.5::DOUBLE ELSE 1 END AS c FROM bars WHERE dayofweek(trade_date) <> 2),
r AS (SELECT code, trade_date, close FROM bars WHERE code % 3 <> 1 UNION ALL SELECT code, trade_date, c FROM a WHERE code % 3 = 1)
SELECT r.code, r.trade_date, round(close, 6) AS close, round(coalesce(c, close), 6) AS adj_close, round(coalesce(c, close) / close, 8) AS adj_factor FROM r LEFT JOIN a USING (code, trade_date)"""),
    "s6_upsert": """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS updated, o_totalprice AS value FROM orders),
b AS (SELECT *, 0 AS fresh FROM o UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN updated + 1 ELSE updated - 1 END, -value, 1 FROM o WHERE o_orderkey % 4 = 0)
SELECT o_orderkey, updated, value FROM b QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY updated DESC, fresh DESC) = 1""",
    "s8_last_bars": with_views(["bars"], "SELECT code, trade_date, close FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) <= 30"),
    "s11_work_list": with_views(["bars"], "SELECT s_suppkey AS code, latest FROM supplier LEFT JOIN (SELECT code, max(trade_date) AS latest FROM bars GROUP BY code) b ON b.code = s_suppkey WHERE latest IS NULL OR latest < DATE '2001-10-20'"),
    "s13_coverage_gate": with_views(["quotes"], "SELECT CAST(100 AS BIGINT) AS expected, count(DISTINCT code) AS actual, CAST(98 AS BIGINT) AS required, count(DISTINCT code) >= 98 AS passed FROM quotes WHERE regexp_full_match(code, '[0-9]{6}')"),
    "s16_merge_fundamentals": """
WITH p AS (SELECT p_partkey AS code, CAST(p_size AS DOUBLE) AS roe, p_retailprice AS pe FROM part)
SELECT code, coalesce(CASE WHEN code % 3 = 0 AND code % 4 = 0 THEN roe + 100 END, CASE WHEN code % 2 = 0 THEN roe END) AS roe,
  coalesce(CASE WHEN code % 10 = 0 THEN pe + 2 END, CASE WHEN code % 3 = 0 THEN pe + 1 END, CASE WHEN code % 2 = 0 THEN pe END) AS pe FROM p WHERE code % 2 = 0 OR code % 3 = 0 OR code % 5 = 0""",
    "s22_universe": with_views(["quotes"], "SELECT 'close' AS snapshot_id, trade_date, code, regexp_matches(name, '(?i)ST') AS is_st, contains(name, '退') AS is_delisting, CASE WHEN price > 0 THEN 'trading' ELSE 'suspended' END AS status FROM quotes QUALIFY row_number() OVER (PARTITION BY trade_date, code ORDER BY id) = 1"),
    "j9_as_of": "SELECT p.event_id, p.user_id AS code, v.value AS view_price, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts",
    "j10_point_in_time": with_views(["signals"], """
, f AS (SELECT c_custkey % (SELECT count(*) FROM supplier) AS code, CASE WHEN c_custkey % 7 <> 0 THEN DATE '1995-01-01' + CAST(c_custkey * 13 % 2400 AS INT) END AS published FROM customer)
SELECT CASE WHEN published IS NULL THEN 'missing_time' WHEN published > signal_date THEN 'future' ELSE 'known' END AS reason, count(*) AS n FROM signals JOIN f USING (code) WHERE rank = 1 GROUP BY 1"""),
    "j12_cycle_returns": with_views(["bars", "signals"], """
, e AS (SELECT signal_id, s.code, signal_date, b.open AS eo FROM signals s LEFT JOIN bars b ON b.code = s.code AND b.trade_date = s.signal_date)
SELECT e.signal_id, l.trade_date AS last_date, round(CASE WHEN eo IS NOT NULL AND l.trade_date >= signal_date THEN (l.close / eo - 1) * 100 END, 6) AS cycle_return FROM e ASOF LEFT JOIN bars l ON e.code = l.code AND e.signal_date + 10 >= l.trade_date"""),
    "j14_anti": with_views(["bars", "signals"], "SELECT strategy, count(*) AS n FROM signals s WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.code = s.code AND b.trade_date = s.signal_date) GROUP BY strategy"),
    "j16_nearest": """
WITH j AS (SELECT q.p_partkey AS query_id, t.p_partkey AS train_id, (pow((q.p_size - t.p_size) / 10.0::DOUBLE, 2) * 1 + pow((q.p_retailprice - t.p_retailprice) / 100.0::DOUBLE, 2) * 2) / 3 AS distance FROM part q JOIN part t USING (p_brand) WHERE q.p_partkey % 10 = 0 AND t.p_partkey % 10 <> 0)
SELECT query_id, train_id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), train_id) AS near, round(distance, 6) AS distance FROM j QUALIFY near <= 5""",
    "j19_latest_signals": with_views(["signals"], "SELECT strategy, signal_date, signal_id, rank FROM signals s WHERE signal_date = (SELECT max(signal_date) FROM signals t WHERE t.strategy = s.strategy)"),
    "a25_event_risk": """
WITH s AS (SELECT l_suppkey AS code, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS r, round(avg(l_discount) * 1000, 6) AS d, round(avg(l_tax) * 1000, 6) AS t FROM lineitem GROUP BY 1),
f AS (SELECT code, 'unlock' AS flag, CASE WHEN r >= 34 THEN 'high' WHEN r >= 32 THEN 'medium' END AS level FROM s UNION ALL SELECT code, 'pledge', CASE WHEN d >= 50.5 THEN 'high' WHEN d >= 49.5 THEN 'medium' END FROM s UNION ALL SELECT code, 'report', CASE WHEN t >= 40.5 THEN 'high' WHEN t >= 39.5 THEN 'medium' END FROM s),
g AS (SELECT code, least(30.0::DOUBLE, sum(CASE level WHEN 'high' THEN 18.0::DOUBLE WHEN 'medium' THEN 9 ELSE 4 END)) AS penalty, count(*) FILTER (level = 'high') AS high_count, string_agg(flag, ',' ORDER BY flag) AS flags FROM f WHERE level IS NOT NULL GROUP BY code)
SELECT *, CASE WHEN penalty >= 24 OR high_count >= 2 THEN 'high' WHEN penalty >= 8 THEN 'medium' ELSE 'low' END AS level FROM g""",
    "a27_sentiment": f"""
WITH n AS (SELECT source, {_RAW} AS raw, CASE WHEN doc_id % 6 = 0 THEN 0.35::DOUBLE WHEN doc_id % 100 <= 2 THEN 1.0 WHEN doc_id % 100 <= 8 THEN 0.75 WHEN doc_id % 100 <= 24 THEN 0.45 WHEN doc_id % 100 <= 72 THEN 0.2 ELSE 0.08 END AS w, contains(text, 'worth') AS a, contains(text, 'und') AS b FROM documents)
SELECT source, count(*) AS news_count, count(*) FILTER (raw <> 0) AS triggered, concat_ws(',', CASE WHEN bool_or(b) THEN 'und' END, CASE WHEN bool_or(a) THEN 'worth' END) AS risk_words, round(greatest(0, least(100, 50 + sum(raw * w) / greatest(sum(CASE WHEN raw <> 0 THEN w ELSE 0.15 END), 1) * 3)), 6) AS score FROM n GROUP BY source""",
    "a28_blacklist": """
WITH i AS (SELECT o_custkey % 50 AS code, o_orderkey % 4 AS lv, (o_orderkey % 10)::DOUBLE AS penalty, o_orderkey % 97 = 0 AS hard FROM orders WHERE o_orderkey % 3 = 0 OR CAST(o_orderdate AS DATE) >= DATE '1998-01-01')
SELECT code, sum(penalty) AS penalty, ['low', 'medium', 'high', 'critical'][max(lv) + 1] AS level, bool_or(hard) AS hard, count(*) AS items FROM i GROUP BY code""",
    "x26_daily_portfolios": with_views(["outcomes"], "SELECT strategy, signal_date, count(*) AS holdings, count(*) FILTER (state = 'settled') AS filled, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'no_bars') AS unfilled, max(rank) AS worst_rank, CASE WHEN count(*) FILTER (state = 'pending') > 0 THEN 'unknown' ELSE 'settled' END AS status, CASE WHEN count(*) FILTER (state = 'pending') = 0 THEN round(sum(CASE WHEN state = 'settled' THEN exit_return - total_pct ELSE 0 END) / count(*), 6) END AS net_return_pct FROM outcomes WHERE rank <= 2 GROUP BY strategy, signal_date"),
    "x27_random_portfolios": with_views(["factors"], """
, t AS (SELECT f.code, f.trade_date, (x.ex / f.close - 1) * 100 - 0.7::DOUBLE AS r FROM factors f JOIN (SELECT code, trade_date, lead(close, 3) OVER (PARTITION BY code ORDER BY trade_date) AS ex FROM bars) x USING (code, trade_date) WHERE f.bar_no > 30 AND x.ex > 0),
g AS (SELECT trade_date, list(r ORDER BY code) AS v, count(*) AS n FROM t GROUP BY 1),
d0 AS (SELECT *, ('0x' || substr(md5('20260712:' || trade_date || ':' || draw || ':0'), 1, 8))::BIGINT % greatest(n - 4 + 0, 1) AS t0 FROM g, (SELECT unnest(range(1000)) AS draw)),
e0 AS (SELECT *, CASE WHEN n < 5 THEN 0 ELSE t0 END AS p0 FROM d0),
d1 AS (SELECT *, ('0x' || substr(md5('20260712:' || trade_date || ':' || draw || ':1'), 1, 8))::BIGINT % greatest(n - 4 + 1, 1) AS t1 FROM e0),
e1 AS (SELECT *, CASE WHEN n < 5 THEN 1 WHEN t1 IN (p0) THEN n - 5 + 1 ELSE t1 END AS p1 FROM d1),
d2 AS (SELECT *, ('0x' || substr(md5('20260712:' || trade_date || ':' || draw || ':2'), 1, 8))::BIGINT % greatest(n - 4 + 2, 1) AS t2 FROM e1),
e2 AS (SELECT *, CASE WHEN n < 5 THEN 2 WHEN t2 IN (p0, p1) THEN n - 5 + 2 ELSE t2 END AS p2 FROM d2),
d3 AS (SELECT *, ('0x' || substr(md5('20260712:' || trade_date || ':' || draw || ':3'), 1, 8))::BIGINT % greatest(n - 4 + 3, 1) AS t3 FROM e2),
e3 AS (SELECT *, CASE WHEN n < 5 THEN 3 WHEN t3 IN (p0, p1, p2) THEN n - 5 + 3 ELSE t3 END AS p3 FROM d3),
d4 AS (SELECT *, ('0x' || substr(md5('20260712:' || trade_date || ':' || draw || ':4'), 1, 8))::BIGINT % greatest(n - 4 + 4, 1) AS t4 FROM e3),
e4 AS (SELECT *, CASE WHEN n < 5 THEN 4 WHEN t4 IN (p0, p1, p2, p3) THEN n - 5 + 4 ELSE t4 END AS p4 FROM d4),
m AS (SELECT trade_date, list_avg(list_filter([v[p0 + 1], v[p1 + 1], v[p2 + 1], v[p3 + 1], v[p4 + 1]], lambda x: x IS NOT NULL)) AS m FROM e4)
SELECT trade_date, round(avg(m), 6) AS random_mean, round(quantile_cont(m, 0.05), 6) AS p5, round(quantile_cont(m, 0.5), 6) AS p50, round(quantile_cont(m, 0.95), 6) AS p95 FROM m GROUP BY trade_date"""),
    "w16_turnover": with_views(["quotes"], """
, k AS (SELECT trade_date, id, dense_rank() OVER (ORDER BY trade_date) AS i FROM (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY turnover DESC, id) <= 3)),
c AS (SELECT coalesce(a.i, b.i + 1) AS i, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS moved, sum(coalesce(a.w, 0)) AS sw, sum(coalesce(b.w, 0)) AS so FROM (SELECT *, 0.25::DOUBLE AS w FROM k) a FULL JOIN (SELECT *, 0.25::DOUBLE AS w FROM k) b ON a.id = b.id AND a.i = b.i + 1 GROUP BY 1)
SELECT 'a' AS book, trade_date, round((moved + abs(sw - so)) / 2, 6) AS turnover FROM c JOIN (SELECT DISTINCT trade_date, i FROM k) USING (i)"""),
    "x29_paired": with_views(["settled"], ", y AS (SELECT signal_date, avg(net_return) FILTER (strategy = '1') AS a, avg(net_return) FILTER (strategy = '2') AS b FROM settled GROUP BY 1) SELECT signal_date, round(a, 6) AS base, round(b, 6) AS challenger, round(b - a, 6) AS increment FROM y WHERE a IS NOT NULL AND b IS NOT NULL"),
    "a31_benchmark": with_views(["quotes"], "SELECT trade_date, id, industry, round(pct_chg, 6) AS pct_chg, round(avg(pct_chg) OVER (PARTITION BY trade_date), 6) AS market_return, round(avg(pct_chg) OVER (PARTITION BY trade_date, industry), 6) AS industry_return FROM quotes"),
    "s28_prune": "SELECT (SELECT count(*) FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS orders, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))) AS lines",
    "x9_fundamental_scores": f"""
WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN 0.0::DOUBLE ELSE CAST(p_size AS DOUBLE) END AS roe, CAST(p_partkey % 13 AS DOUBLE) AS gross_margin, CAST(p_partkey % 5 AS DOUBLE) AS debt_ratio, p_retailprice - 950 AS pe_dynamic, CAST(p_partkey % 17 AS DOUBLE) AS pb FROM part),
s AS (SELECT p_partkey, roe, gross_margin, debt_ratio, pe_dynamic, pb, {_member_pct('roe', 'roe <> 0', False)} AS a, {_member_pct('gross_margin', 'gross_margin <> 0', False)} AS b2, {_member_pct('debt_ratio', 'debt_ratio <> 0', True)} AS c, {_member_pct('pe_dynamic', 'pe_dynamic > 0', True)} AS d, {_member_pct('pb', 'pb > 0', True)} AS e FROM p WINDOW b AS (PARTITION BY p_brand))
SELECT p_partkey, round(CASE WHEN roe <> 0 THEN a ELSE 50 END * 0.45::DOUBLE + CASE WHEN gross_margin <> 0 THEN b2 ELSE 50 END * 0.35::DOUBLE + CASE WHEN debt_ratio <> 0 THEN c ELSE 50 END * 0.20::DOUBLE, 6) AS quality_score, round(CASE WHEN pe_dynamic > 0 AND pb > 0 THEN d * 0.55::DOUBLE + e * 0.45::DOUBLE ELSE 50 END, 6) AS value_score FROM s""",
}

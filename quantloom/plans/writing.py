"""Queries on the write side and on streams that stop and go on."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import batches as ba
from ..sources import ingest as ig
from ..sources import tables as tb
from ..sources.shared import shared_path, written
from ..streaming import live as lv
from .market import rounded
from .views import with_views


def _first_of_code(spark, d):
    """Signals with each code once a strategy and date."""
    s = ig.latest_by_key(tb.signals(spark, d), ["strategy", "signal_date", "code"], [F.col("rank")])
    return s.select("strategy", F.lit("v1").alias("version"), "signal_date", F.lit("close").alias("phase"), "code", "score")


def s26_save_batches(spark, d):
    """Every signal saved, then a new version of some dates, then a replay, then the new version again: what the table holds."""
    table, first = shared_path(spark, "signal-batches"), written(_first_of_code(spark, d), "signals-once")
    ba.save_batches(table, first)
    again = first.where("strategy in ('1', '2') and signal_date >= date'1997-01-01'").select("strategy", F.lit("v2").alias("version"), "signal_date", "phase", "code", (F.col("score") + 100).alias("score"))
    ba.save_batches(table, again.where("code % 3 <> 0"))
    ba.save_batches(table, first.where("strategy = '1' and signal_date < date'1993-01-01'").withColumn("version", F.lit("replay-1")))
    counts = ba.save_batches(table, again.where("code % 3 <> 0"))
    held = spark.read.parquet(table).groupBy(F.col("strategy").cast("string").alias("strategy"), "version").agg(F.count("*").alias("n"), F.sum(F.col("score").cast("decimal(18,2)")).cast("double").alias("score"), F.min("signal_date").alias("first"), F.max("signal_date").alias("last"))
    return held.join(counts, "strategy", "left").select("strategy", "version", "n", "score", "first", "last", "saved", "replaced")


def s20_snapshot_store(spark, d):
    """Quotes stored as a snapshot, twice: the manifest of the second time, which wrote nothing."""
    store, q = shared_path(spark, "snapshots"), tb.quotes(spark, d)
    ba.save_snapshot(store, "close", q, None, ba.REAL)
    return ba.save_snapshot(store, "close", q.withColumn("name", F.upper("name")), "2024-01-01", ba.REAL)


def _feed(spark, d):
    """Bars and signals in one table, by day."""
    b = tb.bars(spark, d).select("code", F.col("trade_date").alias("day"), F.lit(False).alias("is_signal"), F.lit(None).cast("long").alias("signal_id"), "high", "low", "close")
    s = tb.signals(spark, d).select("code", F.col("signal_date").alias("day"), F.lit(True).alias("is_signal"), "signal_id", *[F.lit(None).cast("double").alias(c) for c in ("high", "low", "close")])
    return b.unionByName(s)


def _in_parts(feed, order: str, cuts: list, path: str, run):
    """Write feed in parts between the cuts, running the stream after each: a stop and a restart between all of them."""
    spark, bounds, out = feed.sparkSession, [None, *cuts, None], None
    for low, high in zip(bounds, bounds[1:]):
        part = feed if low is None else feed.where(F.col(order) >= low)
        part = part if high is None else part.where(F.col(order) < high)
        part.write.mode("append").parquet(f"{path}/feed")
        out = run(spark.readStream.schema(feed.schema).parquet(f"{path}/feed"))
    return out


def t8_labels(spark, d):
    """Signals labelled as bars come in three parts; the stream is stopped and started again between them."""
    path = shared_path(spark, "labels")
    out = _in_parts(_feed(spark, d), "day", [F.lit("1994-06-01").cast("date"), F.lit("1996-09-15").cast("date")], path, lambda s: lv.resume(lv.label_as_bars_come(s), path))
    return rounded(out, "entry_price", "return_1d", "return_3d", "return_5d", "max_gain", "max_drawdown")


def _ranked(spark, d):
    t = tb.ticks(spark, d).groupBy(F.col("kind").alias("horizon"), F.dayofyear("ts").cast("bigint").alias("round"), "code").agg(F.count("*").alias("n"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("horizon", "round").orderBy(F.desc("n"), "code")).cast("bigint")).select("horizon", "round", "code", "place")


def t6_stable_top(spark, d):
    """Top-three membership with hysteresis as a stream, stopped and started again between three parts of the rounds."""
    path = shared_path(spark, "stable-top")
    return _in_parts(_ranked(spark, d), "round", [9, 17], path, lambda s: lv.resume(lv.stable_top(s, 3, 6), path))


def t2_stale(spark, d):
    """Newest tick of each code, streamed, and whether it is older than an hour at a given time."""
    s = tb.ticks(spark, d).agg(F.max("ts").alias("ts")).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t")).first()["t"]
    ticks = lv.tick_stream(spark, d).groupBy("code").agg(F.max("ts").alias("ts"))
    return lv.stale(lv.drain(ticks, "stale"), s or "2000-01-01 00:00:00", 3600.0).select("code", F.floor("age_s").alias("age_s"), "stale")


QUERIES = [s26_save_batches, s20_snapshot_store, t8_labels, t6_stable_top, t2_stale]

_HASH = """
, rh AS (SELECT trade_date, id, sha256(concat_ws('|', code, CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(turnover AS DECIMAL(18,2)) AS VARCHAR))) AS h, price FROM quotes),
lf AS (SELECT trade_date, id // 1024 AS r, sha256(string_agg(h, ',' ORDER BY id)) AS h, count(*) AS n, count(*) FILTER (price > 0) AS v FROM rh GROUP BY ALL)
SELECT trade_date, sha256(string_agg(h, ',' ORDER BY r)) AS content_hash, CAST(sum(n) AS BIGINT) AS rows{more} FROM lf GROUP BY trade_date"""
# Members of each round by the one before: those held within the first six stay, the first ones fill up to three.
STABLE_TOP = """
WITH RECURSIVE t AS (SELECT event_type AS horizon, CAST(dayofyear(ts) AS BIGINT) AS round, user_id AS code, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT horizon, round, list(code ORDER BY n DESC, code) AS ranked, row_number() OVER (PARTITION BY horizon ORDER BY round) AS k FROM t GROUP BY horizon, round),
w AS (
  SELECT horizon, 0::BIGINT AS k, 0::BIGINT AS round, []::BIGINT[] AS held, []::BIGINT[] AS streaks, []::BOOLEAN[] AS fresh FROM (SELECT DISTINCT horizon FROM r)
  UNION ALL
  SELECT horizon, k, round, mem, list_transform(mem, lambda c: CASE WHEN list_contains(held, c) THEN streaks[list_position(held, c)] ELSE 0 END + 1), list_transform(mem, lambda c: NOT list_contains(stay, c)) FROM (
    SELECT *, list_concat(stay, list_filter(ranked, lambda c: NOT list_contains(stay, c))[1:greatest(0, 3 - len(stay))]) AS mem FROM (
      SELECT w.horizon, r.k, r.round, r.ranked, w.held, w.streaks, list_filter(r.ranked[1:6], lambda c: list_contains(w.held, c))[1:3] AS stay FROM w JOIN r ON r.horizon = w.horizon AND r.k = w.k + 1)))
SELECT horizon, round, unnest(held) AS code, CAST(unnest(streaks) AS BIGINT) AS streak, unnest(fresh) AS is_new FROM w WHERE k > 0"""

ORACLES = {
    "s26_save_batches": with_views(["signals"], """
, f AS (SELECT strategy, signal_date, code, score FROM signals QUALIFY row_number() OVER (PARTITION BY strategy, signal_date, code ORDER BY rank) = 1),
a AS (SELECT *, strategy IN ('1', '2') AND signal_date >= DATE '1997-01-01' AS late FROM f),
b AS (SELECT DISTINCT strategy, signal_date FROM a WHERE late AND code % 3 <> 0),
h AS (SELECT strategy, 'v1' AS version, signal_date, score FROM f ANTI JOIN b USING (strategy, signal_date)
  UNION ALL SELECT strategy, 'v2', signal_date, score + 100 FROM a WHERE late AND code % 3 <> 0 UNION ALL SELECT strategy, 'replay-1', signal_date, score FROM f WHERE strategy = '1' AND signal_date < DATE '1993-01-01'),
c AS (SELECT strategy, count(*) AS saved FROM a WHERE late AND code % 3 <> 0 GROUP BY strategy)
SELECT strategy, version, count(*) AS n, CAST(sum(CAST(score AS DECIMAL(18,2))) AS DOUBLE) AS score, min(signal_date) AS first, max(signal_date) AS last, any_value(saved) AS saved, any_value(saved) AS replaced FROM h LEFT JOIN c USING (strategy) GROUP BY strategy, version"""),
    "s20_snapshot_hash": with_views(["quotes"], _HASH.format(more="")),
    "s20_snapshot_store": with_views(["quotes"], _HASH.format(more=", CAST(sum(v) AS BIGINT) AS valid_rows, 'unknown' AS sample_type, 'already_saved' AS status")),
    "t8_labels": with_views(["ahead"], """
SELECT signal_id, code, round(any_value(entry_price), 6) AS entry_price, max(trade_date) AS labelled_on, round(max(CASE WHEN step = 0 THEN (close / entry_price - 1) * 100 END), 6) AS return_1d, round(max(CASE WHEN step = 2 THEN (close / entry_price - 1) * 100 END), 6) AS return_3d,
  round(max(CASE WHEN step = 4 THEN (close / entry_price - 1) * 100 END), 6) AS return_5d, round((max(high) / any_value(entry_price) - 1) * 100, 6) AS max_gain, round((min(low) / any_value(entry_price) - 1) * 100, 6) AS max_drawdown
FROM ahead WHERE step < 5 AND entry_price > 0 GROUP BY signal_id, code HAVING count(*) = 5"""),
    "t6_stable_top": STABLE_TOP,
    "w12_stable_top": STABLE_TOP,
    "t2_stale": "WITH m AS (SELECT max(ts) AS t FROM events), l AS (SELECT user_id AS code, max(ts) AS ts FROM events GROUP BY 1) SELECT code, CAST(floor(epoch(date_trunc('second', t)) - epoch(ts)) AS BIGINT) AS age_s, epoch(date_trunc('second', t)) - epoch(ts) > 3600 AS stale FROM l, m",
}

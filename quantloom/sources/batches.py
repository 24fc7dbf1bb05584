"""The write side: signal batches that replace just themselves, and snapshots that cannot be rewritten."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import snapshot_hash
from .shared import written

BATCH = ["strategy", "signal_date", "slot", "phase"]
REAL, UNKNOWN = "real_forward", "unknown"


def stored(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The table under path, or None if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _refuse(bad: DataFrame, what: str) -> None:
    if row := bad.limit(1).collect():
        raise ValueError(f"{what}: {row[0].asDict()}")


def save_batches(table: str, rows: DataFrame) -> DataFrame:
    """rows(strategy, version, signal_date, phase, code, ...) into the table under `table` -> strategy, saved, replaced.

    A batch is what one (strategy, date, version, phase) has. A live batch replaces the batch of its strategy, date and phase,
    whatever version that had; a version whose name holds 'replay' replaces its own only and leaves live ones alone. Other
    batches stay as they are, and saving the same rows again changes nothing. Null keys, a code twice in a batch, and two live
    versions of one batch are refused before anything is published.

    The table is laid out by strategy and month. The months that the new rows touch are merged beside the table, then
    published as one dynamic overwrite of just these partitions: a job that fails before its commit leaves them as they were.
    """
    spark, key = rows.sparkSession, ["strategy", "version", "signal_date", "phase", "code"]
    slot = F.when(F.lower("version").contains("replay"), F.col("version")).otherwise("live")
    month = F.date_format("signal_date", "yyyy-MM")
    new = written(rows.withColumn("slot", slot).withColumn("month", month), "batch-staged")
    _refuse(new.where(" or ".join(f"{c} is null" for c in key)).select(*key), "a key without a value")
    _refuse(new.groupBy(*BATCH, "code").count().where("count > 1"), "a code twice in a batch")
    _refuse(new.groupBy(*BATCH).agg(F.min("version").alias("one"), F.max("version").alias("other")).where("one <> other"), "two versions of a batch")
    parts = new.select("strategy", "month").distinct()
    keys = new.select(*BATCH).distinct()
    old = stored(spark, table, new.schema)
    counts = new.groupBy("strategy").agg(F.count("*").alias("saved"))
    merged = new
    if old is not None:
        touched = old.join(parts, ["strategy", "month"], "left_semi")
        gone = touched.join(keys, BATCH, "left_semi").groupBy("strategy").agg(F.count("*").alias("replaced"))
        counts = counts.join(gone, "strategy", "left").select("strategy", "saved", F.coalesce("replaced", F.lit(0)).cast("bigint").alias("replaced"))
        merged = touched.join(keys, BATCH, "left_anti").select(*new.columns).unionByName(new)
    else:
        counts = counts.withColumn("replaced", F.lit(0).cast("bigint"))
    counts = written(counts, "batch-counts")
    merged = written(merged, "batch-merged")
    merged.hint("rebalance", "strategy", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy", "month").parquet(table)
    return counts


def save_snapshot(store: str, snapshot_id: str, quotes: DataFrame, source_timestamp: str | None = None, sample_type: str = UNKNOWN) -> DataFrame:
    """quotes(trade_date, code, id, price, turnover, ...) as snapshot `snapshot_id` -> its manifest: a row for each date with status
    (saved or already_saved), content_hash, rows, valid_rows, sample_type.

    A snapshot is immutable: the same id with other content is refused, with the same content nothing is written. A live label
    without the source's own time becomes unknown. The manifest is written after the rows, so rows without one are a write
    that broke off, which the next save replaces.
    """
    spark = quotes.sparkSession
    if not snapshot_id.strip():
        raise ValueError("snapshot_id is required")
    if sample_type == REAL and not (source_timestamp or "").strip():
        sample_type = UNKNOWN
    kept = written(quotes, "snapshot-staged")
    tree = snapshot_hash(kept).join(kept.groupBy("trade_date").agg(F.sum((F.coalesce(F.col("price"), F.lit(0.0)) > 0).cast("bigint")).alias("valid_rows")), "trade_date").withColumn("sample_type", F.lit(sample_type))
    tree = written(tree, "snapshot-tree")
    if not tree.limit(1).count():
        raise ValueError("a snapshot without rows")
    have = stored(spark, f"{store}/manifest/{snapshot_id}", tree.schema)
    if have is not None:
        key = ["trade_date", "content_hash"]
        other = have.select(*key).exceptAll(tree.select(*key)).unionByName(tree.select(*key).exceptAll(have.select(*key)))
        _refuse(other, f"snapshot {snapshot_id} exists with other content")
        return have.withColumn("status", F.lit("already_saved"))
    kept.write.mode("overwrite").parquet(f"{store}/rows/{snapshot_id}")
    tree.write.mode("errorifexists").parquet(f"{store}/manifest/{snapshot_id}")
    return tree.withColumn("status", F.lit("saved"))

"""Signals with what is stored about them: status rows, backfill lists and the training set of live weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BATCH = ["strategy", "version", "signal_date", "phase"]


def status_rows(signals: DataFrame, outcomes: DataFrame, skips: DataFrame, records: DataFrame, batches: DataFrame) -> DataFrame:
    """signals(signal_id, strategy, version, signal_date, phase, rank) left joined with outcomes(signal_id, baseline, future_days),
    skips(signal_id), records(signal_id, promotion_eligible) and batches(the batch key, candidate_count, sample_type).

    -> the signals with has_outcome, has_skip, baseline, future_days (1 without an outcome), promotion_eligible (what the record
    says where the batch kept its candidates, else true) and sample_type. Joins by signal_id share one partitioning.
    """
    o = outcomes.select("signal_id", F.lit(True).alias("_o"), "baseline", "future_days")
    k = skips.select("signal_id").distinct().withColumn("_k", F.lit(True))
    j = signals.join(o, "signal_id", "left").join(k, "signal_id", "left").join(records.select("signal_id", F.col("promotion_eligible").alias("_e")), "signal_id", "left")
    j = j.join(batches.select(*BATCH, "candidate_count", F.col("sample_type").alias("_t")), BATCH, "left")
    no = F.lit(False)
    return j.select(
        *signals.columns, F.coalesce("_o", no).alias("has_outcome"), F.coalesce("_k", no).alias("has_skip"), F.coalesce("baseline", F.lit("")).alias("baseline"), F.coalesce("future_days", F.lit(1)).cast("bigint").alias("future_days"),
        F.when(F.coalesce("candidate_count", F.lit(0)) > 0, F.coalesce("_e", no)).otherwise(True).alias("promotion_eligible"), F.coalesce("_t", F.lit("unknown")).alias("sample_type"),
    )


def status_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of status rows: signals, labelled, skipped, pending (neither), eligible among the labelled, and distinct labelled days."""
    def n(c):
        return F.sum(c.cast("bigint"))

    o, k = F.col("has_outcome"), F.col("has_skip")
    return rows.groupBy(*by).agg(F.count("*").alias("signals"), n(o).alias("labelled"), n(~o & k).alias("skipped"), n(~o & ~k).alias("pending"), n(o & F.col("promotion_eligible")).alias("eligible"), F.countDistinct(F.when(o, F.col("signal_date"))).alias("labelled_days"))


def weight_samples(rows: DataFrame, outcomes: DataFrame, versions: DataFrame, days: int = 120) -> DataFrame:
    """The training set of live weights: status rows with an outcome under the current version and baseline of their strategy
    (versions: strategy, version, baseline), fit for promotion, of the strategy's newest `days` dates that have any.

    outcomes(signal_id, primary_return, next_open_return, max_drawdown, exit_return, exit_reason, exit_days); missing numbers
    count as 0, a missing exit as the primary return. versions is a row a strategy.
    """
    current = rows.where("has_outcome and promotion_eligible").join(F.broadcast(versions.select("strategy", "version", "baseline")), ["strategy", "version", "baseline"], "left_semi")
    o = outcomes.select("signal_id", F.coalesce("primary_return", F.lit(0.0)).alias("primary_return"), F.coalesce("next_open_return", F.lit(0.0)).alias("next_open_return"), F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"), F.coalesce("exit_return", "primary_return", F.lit(0.0)).alias("exit_return"), F.coalesce("exit_reason", F.lit("")).alias("exit_reason"), F.coalesce("exit_days", F.lit(0)).cast("bigint").alias("exit_days"))
    dates = current.select("strategy", "signal_date").distinct()  # a row a strategy and date
    newest = dates.withColumn("_n", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("signal_date")))).where(F.col("_n") <= days).drop("_n")
    return current.join(newest, ["strategy", "signal_date"], "left_semi").join(o, "signal_id").select("signal_id", "strategy", "version", "signal_date", "rank", *o.columns[1:])

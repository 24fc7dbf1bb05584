"""The engine's tables as views of the star schema: bars, quotes, signals, fundamentals, ticks, news.

Bars come from lineitem: code is the supplier, the price a synthetic 100 to 110 drawn from the extended price, open and
close the first and last line of the day. One shuffle of narrow lines by code and one sort make them, and what is ordered by code
afterwards needs no shuffle of its own; sums of money go through decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import pct_change


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, trade_date, open, high, low, close, volume, turnover."""
    line = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("code"),
        F.to_date("l_shipdate").alias("trade_date"),
        (F.lit(100.0) + (F.round(F.col("l_extendedprice") * 100).cast("bigint") % 1000) / 100.0).alias("px"),
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_quantity").cast("decimal(18,2)").alias("qty"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "px")
    return line.repartition("code").groupBy("code", "trade_date").agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"),
        F.sum("qty").cast("double").alias("volume"), F.sum("amount").cast("double").alias("turnover"),
    )


def code_text(code):
    """A six-digit code with an exchange prefix, so that every market and an unsupported board occur."""
    prefix = F.element_at(F.array(F.lit("600"), F.lit("300"), F.lit("688"), F.lit("430"), F.lit("000")), (code % 5 + 1).cast("int"))
    return F.concat(prefix, F.lpad((code % 1000).cast("string"), 3, "0"))


def quotes(spark: SparkSession, sf_dir: str, made: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """A cross-section for every date: the day's bar with change and amplitude against the previous close. made: bars that are there,
    with columns, more, to carry along."""
    w = Window.partitionBy("code").orderBy("trade_date")
    b = (bars(spark, sf_dir) if made is None else made).withColumn("prev_close", F.lag("close").over(w))
    who = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("code"), F.col("n_name").alias("industry"), F.when(F.col("s_suppkey") % 17 == 3, F.concat(F.lit("*ST "), "s_name")).otherwise(F.col("s_name")).alias("name"), F.col("s_acctbal").alias("cap"))
    return b.join(who, "code").select(
        F.col("code").alias("id"), code_text(F.col("code")).alias("code"), "name", "industry", "trade_date", "open", "high", "low", F.col("close").alias("price"), "prev_close", "volume", "turnover", "cap",
        F.coalesce(pct_change(F.col("close"), F.col("prev_close")), F.lit(0.0)).alias("pct_chg"),
        F.coalesce((F.col("high") - F.col("low")) / F.col("prev_close") * 100, F.lit(0.0)).alias("amplitude"), *more,
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal_id, strategy, signal_date, code, score, rank: orders as signals of their priority's strategy."""
    n = read(spark, sf_dir, "supplier").count()
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("signal_id"), F.substring("o_orderpriority", 1, 1).alias("strategy"), F.to_date("o_orderdate").alias("signal_date"), (F.col("o_custkey") % n).alias("code"), (F.round(F.col("o_totalprice") * 100).cast("bigint") % 10000 / 100.0).alias("score"))
    w = Window.partitionBy("strategy", "signal_date").orderBy(F.desc("score"), "signal_id")
    return o.withColumn("rank", F.row_number().over(w).cast("bigint"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, ts, kind, price, event_id from events."""
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("code"), "ts", F.col("event_type").alias("kind"), F.col("value").alias("price"))

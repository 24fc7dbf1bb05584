"""Event risk, news sentiment and blacklists, aggregated by code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
PENALTY = {"high": 18.0, "medium": 9.0, "low": 4.0}
MAX_PENALTY, HARD_PENALTY = 30.0, 24.0
AGE_STEPS = ((2, 1.0), (8, 0.75), (24, 0.45), (72, 0.2))  # hours, weight; then 0.08, unknown 0.35
LEVELS = ("none", "low", "medium", "high", "critical")


def flag_rows(feed: DataFrame, kind: str, value: str, warn: float, high: float) -> DataFrame:
    """Feed rows over a threshold -> (code, flag, level)."""
    level = F.when(F.col(value) >= high, "high").when(F.col(value) >= warn, "medium")
    return feed.select("code", F.lit(kind).alias("flag"), level.alias("level")).where("level is not null")


def event_risk(flags: DataFrame) -> DataFrame:
    """Flag rows -> by code: penalty (capped), level, flags."""
    points = F.create_map(*[x for k, v in PENALTY.items() for x in (F.lit(k), F.lit(v))])[F.col("level")]
    g = flags.groupBy("code").agg(F.least(F.lit(MAX_PENALTY), F.sum(points)).alias("penalty"), F.sum((F.col("level") == "high").cast("bigint")).alias("high_count"), F.concat_ws(",", F.array_sort(F.collect_list("flag"))).alias("flags"))
    return g.withColumn("level", F.when((F.col("penalty") >= HARD_PENALTY) | (F.col("high_count") >= 2), "high").when(F.col("penalty") >= 8, "medium").otherwise("low"))


def attach_event_risk(df: DataFrame, risk: DataFrame, hard: bool = False) -> DataFrame:
    """df with penalty and level (0 and none); with `hard`, codes at level high go."""
    j = df.join(risk.select("code", F.col("penalty").alias("event_penalty"), F.col("level").alias("event_level")), "code", "left")
    j = j.withColumn("event_penalty", F.coalesce("event_penalty", F.lit(0.0))).withColumn("event_level", F.coalesce("event_level", F.lit("none")))
    return j.where("event_level <> 'high'") if hard else j


def age_weight(hours):
    out = F.lit(0.08)
    for h, w in reversed(AGE_STEPS):
        out = F.when(hours <= h, w).otherwise(out)
    return F.when(hours.isNull(), 0.35).otherwise(out)


def news_sentiment(news: DataFrame, lexicon: dict[str, float], risk_words: tuple[str, ...], key: str, hours: str) -> DataFrame:
    """news(key, content, hours) -> by key: score 50 + 3 * weighted mean, clamped; triggers; risk words.

    The lexicon is a handful of words held in expressions, so the scan needs no join.
    """
    text = F.coalesce(F.col("content"), F.lit(""))
    hits = {w: text.contains(w) for w in lexicon}
    raw = sum((F.when(hits[w], float(v)).otherwise(0.0) for w, v in lexicon.items()), F.lit(0.0))
    d = news.withColumn("_raw", raw).withColumn("_w", age_weight(F.col(hours)))
    d = d.withColumn("_risk", F.array_compact(F.array(*[F.when(hits[w], w) for w in risk_words])))
    g = d.groupBy(key).agg(F.count("*").alias("news_count"), F.sum(F.col("_raw") * F.col("_w")).alias("_t"), F.sum(F.when(F.col("_raw") != 0, F.col("_w")).otherwise(0.15)).alias("_n"), F.sum((F.col("_raw") != 0).cast("bigint")).alias("triggered"), F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_list("_risk"))))).alias("risk_words"))
    return g.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + F.col("_t") / F.greatest(F.col("_n"), F.lit(1.0)) * 3))).drop("_t", "_n")


def merge_blacklist(items: DataFrame) -> DataFrame:
    """items(code, level, penalty, hard, expires, as_of) -> by code: summed penalty, highest level, any hard flag; expired ones go."""
    live = items.where(F.col("expires").isNull() | (F.col("expires") >= F.col("as_of")))
    order = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    return live.groupBy("code").agg(F.sum("penalty").alias("penalty"), F.max_by("level", order).alias("level"), F.bool_or("hard").alias("hard"), F.count("*").alias("items"))

"""Judging strategies: information coefficients, daily and top-K metrics, buckets, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import nonzero
from ..sources.shared import written
from .stats import net_asset_value, wilson_low


def average_rank(by: list[str], c: str) -> Column:
    """Ranks with ties averaged."""
    w, tie = Window.partitionBy(*by).orderBy(c), Window.partitionBy(*by, c)
    return F.rank().over(w) + (F.count("*").over(tie) - 1) / 2


def _long(samples: DataFrame, factors: list[str], ret: str, date: str) -> DataFrame:
    return samples.select(date, F.col(ret).alias("r"), F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("v")) for f in factors])).alias("x")).select("x.factor", date, "x.v", "r").where((F.abs("v") > 1e-12) & F.col("r").isNotNull())


def _rank_correlation(k: DataFrame, by: list[str], least: int) -> DataFrame:
    g = k.groupBy(*by).agg(F.count("*").alias("n"), F.avg("a").alias("ma"), F.avg(F.col("a") * F.col("b")).alias("mab"), F.avg(F.col("a") * F.col("a")).alias("maa"), F.avg(F.col("b") * F.col("b")).alias("mbb"))
    va, vb = F.col("maa") - F.col("ma") * F.col("ma"), F.col("mbb") - F.col("ma") * F.col("ma")
    ic = F.when((va > 1e-9) & (vb > 1e-9), (F.col("mab") - F.col("ma") * F.col("ma")) / F.sqrt(nonzero(va * vb))).otherwise(0.0)
    return g.where(F.col("n") >= least).select(*by, "n", ic.alias("ic"))


def daily_rank_ic(samples: DataFrame, factors: list[str], ret: str, date: str, least: int = 3) -> DataFrame:
    """Spearman correlation of each factor with the return for each date. Values of 0 are missing; a constant side gives 0 and the
    day counts. Factors go to long form, so that one pass serves them all."""
    by = ["factor", date]
    long = _long(samples, factors, ret, date)
    return _rank_correlation(long.withColumn("a", average_rank(by, "v")).withColumn("b", average_rank(by, "r")), by, least)


def spread_ranks(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """by, c, rank: the average rank of each value among its group's rows, whatever the group's size.

    Values are counted and cut into ranges, a range is added up by itself, and the ranges' totals, a row each, give their offsets.
    """
    n = df.groupBy(*by, c).agg(F.count("*").alias("_m"))
    cut = written(n.repartitionByRange(*by, c).withColumn("_p", F.spark_partition_id()), "rank-ranges")
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = cut.groupBy(*by, "_p").agg(F.sum("_m").alias("_t")).select(*by, "_p", before.alias("_before"))  # a row a range
    inside = F.coalesce(F.sum("_m").over(Window.partitionBy(*by, "_p").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("_in", inside).join(F.broadcast(totals), [*by, "_p"]).select(*by, c, (F.col("_before") + F.col("_in") + (F.col("_m") + 1) / 2).alias("rank"))


def pooled_rank_ic(samples: DataFrame, factors: list[str], ret: str, least: int = 3) -> DataFrame:
    """daily_rank_ic of all rows as one day, pool 'all': no group is sorted in one task; ranks come by equality joins on values."""
    long = written(_long(samples.withColumn("pool", F.lit("all")), factors, ret, "pool"), "pooled-samples")
    by = ["factor", "pool"]
    k = long.join(spread_ranks(long, by, "v").withColumnRenamed("rank", "a"), [*by, "v"]).join(spread_ranks(long, by, "r").withColumnRenamed("rank", "b"), [*by, "r"])
    return _rank_correlation(k, by, least)


def ic_summary(daily: DataFrame, date: str, windows: tuple[int, ...] = (20, 60, 120)) -> DataFrame:
    """Mean, ratio to the sample deviation, share of positive days, counts, and the mean over the last days of each window."""
    d = daily.withColumn("_age", F.row_number().over(Window.partitionBy("factor").orderBy(F.desc(date))))
    sd = F.stddev_samp("ic")
    g = d.groupBy("factor").agg(F.count("*").alias("daily_count"), F.sum("n").alias("sample_count"), F.avg("ic").alias("ic_mean"), F.coalesce(F.avg("ic") / F.when(sd > 1e-12, sd), F.lit(0.0)).alias("icir"), F.avg((F.round("ic", 9) > 0).cast("double")).alias("positive_rate"), *[F.avg(F.when(F.col("_age") <= w, F.col("ic"))).alias(f"ic_{w}") for w in windows])
    return g


def daily_metrics(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Settled outcomes -> counts, averages and win rates by group."""
    o = outcomes.where("state = 'settled'")

    def rate(c: Column) -> Column:
        return F.avg(c.cast("double")) * 100

    return o.groupBy(*by).agg(
        F.count("*").alias("sample_count"), F.avg("return_1d").alias("avg_next_close"), rate(F.col("return_1d") > 0).alias("win_rate_next_close"), rate(F.col("hit_3pct")).alias("hit_3pct_rate"), rate(F.col("hit_5pct")).alias("hit_5pct_rate"),
        F.avg("return_3d").alias("avg_hold_3d"), F.avg("exit_return").alias("avg_exit_return"), F.avg("net_return").alias("avg_net_return"), rate(F.col("net_return") > 0).alias("win_rate_net"), F.min("max_drawdown").alias("worst_drawdown"),
    )


def strategy_metrics(outcomes: DataFrame, primary_rank: int = 5) -> DataFrame:
    """By strategy, primary (rank up to primary_rank) against backup in one aggregation with conditional cuts."""
    o = outcomes.where("state = 'settled'")
    out = []
    for name, cut in (("primary", F.col("rank") <= primary_rank), ("backup", F.col("rank") > primary_rank)):
        wins, n = F.sum(F.when(cut, (F.col("net_return") > 0).cast("bigint")).otherwise(0)), F.sum(cut.cast("bigint"))
        out += [n.alias(f"{name}_count"), F.avg(F.when(cut, F.col("net_return"))).alias(f"{name}_avg_net"), wilson_low(wins, n).alias(f"{name}_win_low"), F.countDistinct(F.when(cut, F.col("signal_date"))).alias(f"{name}_days")]
    return o.groupBy("strategy").agg(*out)


def status_counts(outcomes: DataFrame) -> DataFrame:
    """Exclusive counts by strategy and the settled share of all."""
    g = outcomes.groupBy("strategy").agg(F.count("*").alias("signals"), *[F.sum((F.col("state") == s).cast("bigint")).alias(s) for s in ("settled", "pending", "no_bars")])
    return g.withColumn("coverage_pct", F.col("settled") / F.col("signals") * 100)


def top_k_sensitivity(outcomes: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """For each K: only days on which ranks 1..K are all settled; average, win rate and worst drawdown of the daily means."""
    x = outcomes.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    settled = F.col("state") == "settled"
    day = x.groupBy("strategy", "k", "signal_date").agg(F.countDistinct(F.when(settled, F.col("rank"))).alias("have"), F.avg(F.when(settled, F.col("net_return"))).alias("r"))
    full = day.where(F.col("have") == F.col("k"))
    short = day.where(F.col("have") < F.col("k")).groupBy("strategy", "k").agg(F.count("*").alias("incomplete_days"))
    nav = net_asset_value(full, ["strategy", "k"], "signal_date", "r")
    g = nav.groupBy("strategy", "k").agg(F.count("*").alias("day_count"), F.avg("r").alias("avg_daily_net"), (F.avg((F.col("r") > 0).cast("double")) * 100).alias("win_rate"), F.min("drawdown").alias("max_drawdown"))
    return g.join(short, ["strategy", "k"], "left").withColumn("incomplete_days", F.coalesce("incomplete_days", F.lit(0)).cast("bigint")).withColumn("k", F.col("k").cast("bigint"))


def score_buckets(outcomes: DataFrame, edges: tuple[float, ...] = (45, 55, 65, 75, 101)) -> DataFrame:
    """Outcomes by score bucket: count, win rate, averages."""
    b = F.lit(None).cast("double")
    for e in sorted(edges, reverse=True):
        b = F.when(F.col("score") < e, float(e)).otherwise(b)
    o = outcomes.where("state = 'settled'").withColumn("bucket_below", b).where("bucket_below is not null")
    return o.groupBy("bucket_below").agg(F.count("*").alias("n"), (F.avg((F.col("net_return") > 0).cast("double")) * 100).alias("win_rate"), F.avg("net_return").alias("avg_net"), F.avg("max_drawdown").alias("avg_drawdown"))


def stress_test(outcomes: DataFrame, scenarios: DataFrame) -> DataFrame:
    """scenarios(scenario, from_date, to_date), a few rows: settled outcomes in any of a scenario's ranges; worst scenario flagged.

    Ranges are exploded to days, so the join is by equality; a day counts once however many ranges hold it.
    """
    days = scenarios.select("scenario", F.explode(F.sequence("from_date", "to_date")).alias("signal_date")).distinct()
    o = outcomes.where("state = 'settled'").join(F.broadcast(days), "signal_date")
    g = o.groupBy("scenario").agg(F.count("*").alias("n"), (F.avg((F.col("net_return") > 0).cast("double")) * 100).alias("win_rate"), F.avg("net_return").alias("avg_net"), F.min("net_return").alias("worst"), F.sum("net_return").alias("total"))
    return g.withColumn("is_worst", F.col("total") == F.min("total").over(Window.partitionBy(F.lit(0))))


def ranked_group_metrics(samples: DataFrame, date: str, score: str, ret: str, k: int = 5) -> DataFrame:
    """Top k of each date against the date's median: absolute and excess win rate, average, median, lower quartile, downside ratio."""
    d = samples.withColumn("_m", F.percentile(ret, F.lit(0.5)).over(Window.partitionBy(date))).withColumn("_r", F.row_number().over(Window.partitionBy(date).orderBy(F.desc(score), "code"))).where(F.col("_r") <= k)
    r, x = F.col(ret), F.col(ret) - F.col("_m")
    down = F.sqrt(F.avg(F.when(r < 0, r * r).otherwise(0.0)))
    return d.agg(F.count("*").alias("n"), F.countDistinct(date).alias("days"), F.avg(r).alias("avg_return"), F.avg(x).alias("avg_excess"), (F.avg((r > 0).cast("double")) * 100).alias("win_rate"), (F.avg((x > 0).cast("double")) * 100).alias("excess_win_rate"), F.percentile(r, F.lit(0.5)).alias("median_return"), F.percentile(r, F.lit(0.25)).alias("q25_return"), (F.avg(r) / nonzero(down)).alias("sortino"))


def time_weighted_win_rate(samples: DataFrame, by: list[str], date: str, ret: str, as_of: str, half_life: float = 60.0) -> DataFrame:
    """Win rate with weights 0.5 ^ (age / half_life)."""
    w = F.pow(F.lit(0.5), F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), F.col(date))) / half_life)
    return samples.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(w * (F.col(ret) > 0).cast("double")) / F.sum(w) * 100).alias("win_rate"), (F.sum(w * F.col(ret)) / F.sum(w)).alias("weighted_return"))


def meta_labels(outcomes: DataFrame, buckets: int = 4) -> DataFrame:
    """Win probability by score bucket and by rank bucket, blended (.30 prior, .35, .35) and turned into full, reduced or skip."""
    o = outcomes.where("state = 'settled'").withColumn("win", (F.col("net_return") > 0).cast("double"))
    o = o.withColumn("score_bucket", F.least(F.lit(buckets - 1), F.floor(F.col("score") / (100 / buckets))).cast("bigint")).withColumn("rank_bucket", F.least(F.col("rank"), F.lit(10)))
    a = o.groupBy("strategy", "score_bucket").agg(F.avg("win").alias("p_score"))
    b = o.groupBy("strategy", "rank_bucket").agg(F.avg("win").alias("p_rank"))
    c = o.groupBy("strategy").agg(F.avg("win").alias("p_all"))
    d = o.join(F.broadcast(a), ["strategy", "score_bucket"]).join(F.broadcast(b), ["strategy", "rank_bucket"]).join(F.broadcast(c), "strategy")
    p = 0.30 * F.col("p_all") + 0.35 * F.col("p_score") + 0.35 * F.col("p_rank")
    d = d.withColumn("confidence", p)
    return d.select("signal_id", "strategy", "confidence", F.when(F.col("confidence") >= 0.5, "full").when(F.col("confidence") >= 0.4, "reduced").otherwise("skip").alias("label"))


def promotion_gates(metrics: DataFrame, samples: int = 300, days: int = 60, least_net: float = 0.0) -> DataFrame:
    """Gate ladder over strategy metrics: status by the first failing gate, all blockers, position scale."""
    fails = F.array_compact(F.array(F.when(F.col("primary_count") < samples, "samples"), F.when(F.col("primary_days") < days, "days"), F.when(F.coalesce("primary_avg_net", F.lit(-1e9)) <= least_net, "net_return")))
    d = metrics.withColumn("_f", fails)
    return d.select("strategy", F.concat_ws(",", "_f").alias("blockers"), F.when(F.size("_f") == 0, "ready").otherwise(F.get("_f", F.lit(0))).alias("status"), F.when(F.size("_f") == 0, 1.0).when(F.size("_f") == 1, 0.5).otherwise(0.0).alias("position_scale"))

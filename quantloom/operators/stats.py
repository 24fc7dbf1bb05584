"""Statistics over many series at once: intervals, block bootstrap, false discovery rate, deflated Sharpe ratio."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import nonzero


def mean_interval(df: DataFrame, by: list[str], value: str, z: float = 1.96) -> DataFrame:
    """n, mean, low, high: mean -+ z * s / sqrt(n), null bounds below two values."""
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    margin = z * F.col("sd") / F.sqrt("n")
    return g.select(*by, "n", "mean", F.when(F.col("n") >= 2, F.col("mean") - margin).alias("low"), F.when(F.col("n") >= 2, F.col("mean") + margin).alias("high"))


def wilson_low(wins: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of a share, in percent; null for none."""
    m = nonzero(n)
    p = wins / m
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * m)) / m)
    return F.when(m > 0, F.greatest(F.lit(0.0), (p + z * z / (2 * m) - spread) / (1 + z * z / m)) * 100)


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, key: list[str], q: float = 0.1) -> DataFrame:
    """df -> with bh_rank, adjusted_p and rejected by group; rows with a null or impossible p are left out."""
    d = df.where((F.col(p) >= 0) & (F.col(p) <= 1))
    order = Window.partitionBy(*by).orderBy(p, *key)
    d = d.withColumn("bh_rank", F.row_number().over(order).cast("bigint")).withColumn("_m", F.count("*").over(Window.partitionBy(*by)))
    up = Window.partitionBy(*by).orderBy(F.desc("bh_rank"))
    d = d.withColumn("adjusted_p", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("bh_rank")).over(up)))
    last = F.max(F.when(F.col(p) <= q * F.col("bh_rank") / F.col("_m"), F.col("bh_rank"))).over(Window.partitionBy(*by))
    return d.withColumn("rejected", F.col("bh_rank") <= F.coalesce(last, F.lit(0))).drop("_m")


def experiment_fdr(experiments: DataFrame, q: float = 0.1) -> DataFrame:
    """experiments(experiment_id, experiment_family, trial_count, p_values) -> a row for each declared trial, BH over the family.

    Trials beyond those reported count with p = 1.
    """
    declared = F.greatest(F.lit(1), F.coalesce("trial_count", F.greatest(F.size("p_values"), F.lit(1))))
    t = experiments.select("experiment_id", "experiment_family", "p_values", F.explode(F.sequence(F.lit(0), declared - 1)).alias("trial"))
    t = t.select("experiment_id", "experiment_family", F.col("trial").cast("bigint").alias("trial"), F.coalesce(F.get("p_values", F.col("trial")), F.lit(1.0)).alias("p_value"), (F.col("trial") < F.size("p_values")).alias("reported"))
    return benjamini_hochberg(t, ["experiment_family"], "p_value", ["experiment_id", "trial"], q)


def hash_draw(*parts: Column) -> Column:
    """A number from 0 to 2^32 - 1 that any engine can repeat: the first 8 hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("bigint")


def block_bootstrap(df: DataFrame, series: str, order: str, value: str, draws: int = 200, seed: int = 20260713) -> DataFrame:
    """Means of moving-block resamples: series, draw, mean. Blocks of round(sqrt n) consecutive values, cut to n values.

    Series are first daily rows; a draw's block starts come from a hash of (seed, series, draw, block). Values are looked up by
    position in the series' own array, so the resampling itself needs no join.
    """
    d = df.where(F.col(value).isNotNull()).groupBy(series).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_s"))
    d = d.withColumn("_v", F.transform("_s", lambda x: x[value])).withColumn("n", F.size("_v")).where("n >= 2").withColumn("width", F.greatest(F.lit(1), F.round(F.sqrt("n")).cast("int")))
    d = d.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    starts = F.col("n") - F.col("width") + 1
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("width")).cast("int") - 1), lambda b: F.slice("_v", (hash_draw(F.lit(seed), F.col(series), F.col("draw"), b) % starts).cast("int") + 1, F.col("width")))
    d = d.withColumn("_pick", F.slice(F.flatten(blocks), 1, F.col("n")))
    return d.select(series, F.col("draw").cast("bigint").alias("draw"), (F.aggregate("_pick", F.lit(0.0), lambda a, x: a + x) / F.col("n")).alias("mean"))


def bootstrap_interval(df: DataFrame, series: str, order: str, value: str, draws: int = 200, seed: int = 20260713) -> DataFrame:
    """2.5 % and 97.5 % index quantiles of the block bootstrap, by series."""
    b = block_bootstrap(df, series, order, value, draws, seed).groupBy(series).agg(F.array_sort(F.collect_list("mean")).alias("m"))
    return b.select(series, F.get("m", F.lit(int(draws * 0.025))).alias("low"), F.get("m", F.lit(min(draws - 1, int(draws * 0.975)))).alias("high"))


def bootstrap_p_value(df: DataFrame, series: str, order: str, value: str, draws: int = 200, seed: int = 20260714) -> DataFrame:
    """One-sided p of a positive mean: (draws of the centred series at or above it + 1) / (draws + 1); 1 for a mean <= 0."""
    m = df.where(F.col(value).isNotNull()).withColumn("_mean", F.avg(value).over(Window.partitionBy(series)))
    seen = m.groupBy(series).agg(F.avg(value).alias("observed"))
    b = block_bootstrap(m.withColumn("_c", F.col(value) - F.col("_mean")), series, order, "_c", draws, seed).join(seen, series)
    p = b.groupBy(series).agg(F.first("observed").alias("observed"), F.sum((F.col("mean") >= F.col("observed")).cast("bigint")).alias("above"))
    return p.select(series, "observed", F.when(F.col("observed") <= 0, 1.0).otherwise((F.col("above") + 1) / F.lit(draws + 1.0)).alias("p_value"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by Zelen and Severo's rational approximation (error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def expected_max_z(trials: int) -> float:
    """Expected maximum of `trials` standard normal draws."""
    from statistics import NormalDist

    if trials <= 1:
        return 0.0
    gamma, inv = 0.5772156649015329, NormalDist().inv_cdf
    return (1 - gamma) * inv(1 - 1 / trials) + gamma * inv(1 - 1 / (trials * math.e))


def deflated_sharpe(df: DataFrame, by: list[str], value: str, trials: int = 1, threshold: float = 0.95) -> DataFrame:
    """Sharpe ratio, biased skewness and kurtosis, z and probability by series; two passes of aggregation, no collected arrays."""
    w = Window.partitionBy(*by)
    d = df.where(F.col(value).isNotNull()).withColumn("_m", F.avg(value).over(w)).withColumn("_s", F.stddev_samp(value).over(w))
    u = (F.col(value) - F.col("_m")) / nonzero(F.col("_s"))
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.first("_m").alias("mean"), F.first("_s").alias("sd"), F.avg(F.pow(u, 3.0)).alias("skewness"), F.avg(F.pow(u, 4.0)).alias("kurtosis"))
    sharpe = F.col("mean") / nonzero(F.col("sd"))
    g = g.withColumn("sharpe", sharpe)
    variance = F.greatest(F.lit(1e-12), 1 - F.col("skewness") * F.col("sharpe") + (F.col("kurtosis") - 1) / 4 * F.col("sharpe") * F.col("sharpe"))
    z = (F.col("sharpe") - expected_max_z(trials) / F.sqrt(F.col("n") - 1)) * F.sqrt(F.col("n") - 1) / F.sqrt(variance)
    g = g.withColumn("z", F.when((F.col("n") >= 3) & (F.col("sd") > 0), z))
    prob = F.when(F.col("n") < 3, F.lit(None).cast("double")).when(F.col("sd") > 0, normal_cdf(F.col("z"))).otherwise(F.when(F.col("mean") > 0, 1.0).otherwise(0.0))
    return g.withColumn("probability", prob).select(*by, "n", "mean", "sharpe", "skewness", "kurtosis", "z", "probability", F.coalesce(F.col("probability") >= threshold, F.lit(False)).alias("passed"))


def net_asset_value(daily: DataFrame, by: list[str], order: str, ret: str) -> DataFrame:
    """daily -> with nav, peak (from 1) and drawdown in percent; a loss of everything stays at 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    growth = F.greatest(F.lit(0.0), 1 + F.col(ret) / 100)
    gone = F.max((growth <= 0).cast("int")).over(w) == 1
    nav = F.when(gone, 0.0).otherwise(F.exp(F.sum(F.log(F.when(growth > 0, growth))).over(w)))
    d = daily.withColumn("nav", nav)
    d = d.withColumn("peak", F.greatest(F.lit(1.0), F.max("nav").over(w)))
    return d.withColumn("drawdown", F.least(F.lit(0.0), (F.col("nav") / F.col("peak") - 1) * 100))


def weighted_quantile(df: DataFrame, by: list[str], value: str, weight: str, q: float) -> DataFrame:
    """The first value at which the cumulative weight reaches q of the total, by group."""
    w = Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_c", F.sum(weight).over(w)).withColumn("_t", F.sum(weight).over(Window.partitionBy(*by)))
    return d.where(F.col("_c") >= q * F.col("_t")).groupBy(*by).agg(F.min(value).alias("quantile"))


def isotonic_buckets(df: DataFrame, by: list[str], score: str, win: str, buckets: int = 5) -> DataFrame:
    """Score calibration: equal-count buckets (ties together), win rate of each, pooled to be monotone.

    The pooled value of bucket i is the maximum over a <= i of the minimum over b >= i of the weighted mean of a..b; the self join
    is over a handful of buckets in each group.
    """
    g = Window.partitionBy(*by)
    below = F.rank().over(g.orderBy(score)) - 1
    d = df.withColumn("_b", F.floor(below * buckets / F.count("*").over(g)))
    b = d.groupBy(*by, "_b").agg(F.count("*").alias("n"), F.sum(F.col(win).cast("double")).alias("wins"), F.min(score).alias("low"), F.max(score).alias("high"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("cn", F.sum("n").over(w)).withColumn("cw", F.sum("wins").over(w))
    a = b.select(*by, F.col("_b").alias("_a"), (F.col("cn") - F.col("n")).alias("n0"), (F.col("cw") - F.col("wins")).alias("w0"))
    z = b.select(*by, F.col("_b").alias("_z"), F.col("cn").alias("n1"), F.col("cw").alias("w1"))
    runs = a.join(z, by).where("_a <= _z").withColumn("avg", (F.col("w1") - F.col("w0")) / (F.col("n1") - F.col("n0")))
    inner = b.select(*by, "_b").join(runs, by).where("_a <= _b and _b <= _z").groupBy(*by, "_b", "_a").agg(F.min("avg").alias("m"))
    fit = inner.groupBy(*by, "_b").agg(F.max("m").alias("fit"))
    return b.join(fit, [*by, "_b"]).select(*by, F.col("_b").cast("bigint").alias("bucket"), "low", "high", "n", (F.col("wins") / F.col("n")).alias("win_rate"), F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("fit"))).alias("probability"))

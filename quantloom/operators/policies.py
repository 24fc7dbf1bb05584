"""Rules that label, gate, audit and select rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import nonzero


def first_theme(text: Column, themes: list[tuple[str, tuple[str, ...]]], fallback: Column) -> Column:
    """The first theme of which a keyword occurs in the upper-cased text; else the fallback."""
    t, out = F.upper(text), fallback
    for theme, keys in reversed(themes):
        hit = F.lit(False)
        for k in keys:
            hit = hit | t.contains(k.upper())
        out = F.when(hit, theme).otherwise(out)
    return out


def keyword_score(text: Column, keys: tuple[str, ...], base: float, each: float, most: float) -> Column:
    n = sum((F.upper(text).contains(k.upper()).cast("int") for k in keys), F.lit(0))
    return F.least(F.lit(most), F.lit(base) + n * each)


def gate_by_regime(df: DataFrame, regime: DataFrame, on: str, floors: dict[str, float], slots: dict[str, int], score: str, order: list[Column]) -> DataFrame:
    """df with its date's floor and slot count: eligible where the score reaches the floor and the place is within the slots; reasons."""
    r = regime.select(on, "level").withColumn("floor", _by_level(floors)).withColumn("slots", _by_level(slots))
    j = df.join(r, on)
    ok = F.col(score) >= F.col("floor")
    j = j.withColumn("_ok", ok).withColumn("gate_place", F.row_number().over(Window.partitionBy(on).orderBy(F.desc("_ok"), *order)).cast("bigint"))
    reasons = F.array_compact(F.array(F.when(~F.col("_ok"), "score"), F.when(F.col("gate_place") > F.col("slots"), "slots")))
    return j.withColumn("reasons", F.concat_ws(",", reasons)).withColumn("eligible", F.size(reasons) == 0).drop("_ok")


def _by_level(values: dict) -> Column:
    out = F.lit(None)
    for level, v in values.items():
        out = F.when(F.col("level") == level, v).otherwise(out)
    return out


def tier_filter(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows that may be executed; if any of a group has a tier, only its primary ones."""
    d = df.where(F.coalesce("execution_allowed", F.lit(True)))
    tiered = F.max(F.col("tier").isNotNull()).over(Window.partitionBy(*by))
    return d.withColumn("_t", tiered).where(~F.col("_t") | (F.col("tier") == "primary_watch")).drop("_t")


def fill_backup(primary: DataFrame, backup: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """Backup rows to fill from: of a theme that primary lacks first, then of an industry that it lacks, then by score."""
    t = primary.select(*by, "theme").distinct().withColumn("_t", F.lit(1))
    i = primary.select(*by, "industry").distinct().withColumn("_i", F.lit(1))
    j = backup.join(t, [*by, "theme"], "left").join(i, [*by, "industry"], "left")
    w = Window.partitionBy(*by).orderBy(F.coalesce("_t", F.lit(0)), F.coalesce("_i", F.lit(0)), *order)
    return j.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= n).drop("_t", "_i")


def quota_pool(df: DataFrame, by: list[str], key: str, stages: list[tuple[list[Column], int]]) -> DataFrame:
    """Rows taken by quotas in turn, none twice: each stage takes its first rows in its own order among those not yet taken."""
    rest, out = df, None
    for n, (order, quota) in enumerate(stages):
        got = rest.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= quota).drop("_n").withColumn("stage", F.lit(n).cast("bigint"))
        out = got if out is None else out.unionByName(got)
        rest = rest.join(got.select(*by, key), [*by, key], "left_anti")
    return out


def distribution(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """Count, mean, minimum, linear p50 and p95, maximum."""
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.percentile(c, F.lit(0.5)).alias("p50"), F.percentile(c, F.lit(0.95)).alias("p95"), F.max(c).alias("max"))


def index_quantiles(df: DataFrame, by: list[str], c: str, q: float) -> DataFrame:
    """Floor-index, rounded-index and linear quantile of small groups."""
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list(c)).alias("v"), F.percentile(c, F.lit(q)).alias("linear"))
    last = F.size("v") - 1
    return g.select(*by, F.get("v", F.least(last, F.floor(F.size("v") * q).cast("int"))).alias("floor_index"), F.get("v", F.round(last * q).cast("int")).alias("round_index"), "linear")


def _stirling_error(x: np.ndarray) -> np.ndarray:
    """log x! less Stirling's formula; from a table up to 15, where the series is too short."""
    table = np.array([0.0] + [math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 16)])
    y = np.maximum(x, 1.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    return np.where(x < 16, table[np.minimum(x, 15).astype(int)], series)


def fair_tail(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Chance of k or more heads in n fair throws, for any n: the first term beyond the middle, times the sum of the ratios
    that follow it, which falls below double precision after some multiple of sqrt(n) terms."""
    n, k = np.asarray(n, float), np.asarray(k, float)
    upper = 2 * k > n
    m = np.where(upper, k, n - k + 1)  # P(X >= k) = 1 - P(X >= n - k + 1)
    inside = (m <= n) & (k > 0)
    m = np.where(inside, m, n)
    rest = n - m
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (m - rest) / np.maximum(n, 1)
        deviance = np.where(rest > 0, m * np.log1p(d) + rest * np.log1p(-d), n * math.log(2))
        log_first = np.where(rest > 0, _stirling_error(n) - _stirling_error(m) - _stirling_error(rest) - deviance + 0.5 * np.log(n / (2 * math.pi * m * np.maximum(rest, 1))), -n * math.log(2))
    total, term, i = np.ones_like(n), np.ones_like(n), m.copy()
    while (go := term > 1e-17 * total).any():
        term = np.where(go & (i < n), term * (n - i) / (i + 1), 0.0)
        total, i = total + term, i + 1
    beyond = np.where(inside, np.minimum(1.0, np.exp(log_first) * total), 0.0)
    return np.where(k <= 0, 1.0, np.where(upper, beyond, 1 - beyond))


def binomial_tail(df: DataFrame, n: str, k: str) -> DataFrame:
    """df with the chance of k or more heads in n fair throws, for any n; null where n or k is."""

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        out[known] = fair_tail(a[known].to_numpy(float), b[known].to_numpy(float))
        return pd.Series(out).where(known, None)

    return df.withColumn("tail", tail(F.col(n).cast("long"), F.col(k).cast("long")))


def consensus(df: DataFrame, key: str) -> DataFrame:
    """By code: appearances, strategies, averages over rows that may be traded and over those only observed."""
    seen = F.col("observation_only")
    return df.groupBy(key).agg(F.count("*").alias("appearances"), F.concat_ws(",", F.array_sort(F.collect_set("strategy"))).alias("strategies"), F.avg(F.when(~seen, F.col("score"))).alias("avg_score"), F.avg(F.when(seen, F.col("score"))).alias("avg_observed"))


def verdict(df: DataFrame, tilt: Column) -> DataFrame:
    """Consensus rows -> direction: mean score, four points for each further appearance (at most ten), regime tilt; up, down, neutral."""
    d = df.withColumn("direction", F.coalesce("avg_score", "avg_observed") + F.least(F.lit(10.0), (F.col("appearances") - 1) * 4.0) + tilt)
    return d.withColumn("verdict", F.when(F.col("direction") >= 60, "up").when(F.col("direction") <= 40, "down").otherwise("neutral"))


def set_changes(df: DataFrame, by: str, date: str, key: str) -> DataFrame:
    """Members of consecutive dates' sets: new, kept and dropped counts."""
    days = df.select(by, date).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(date)))
    m = df.join(days, [by, date]).select(by, "_i", key).distinct()
    a, b = m.withColumn("now", F.lit(1)), m.select(by, (F.col("_i") + 1).alias("_i"), key).withColumn("was", F.lit(1))
    j = a.join(b, [by, "_i", key], "full").join(days, [by, "_i"])
    n = {"new": F.col("was").isNull(), "kept": F.col("now").isNotNull() & F.col("was").isNotNull(), "dropped": F.col("now").isNull()}
    return j.groupBy(by, date).agg(*[F.sum(c.cast("bigint")).alias(k) for k, c in n.items()])


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), k) for k, c in rules.items()]))
    return df.select(*key, F.explode(found).alias("violation"))


def mask_coverage(df: DataFrame, mask: str, scopes: dict[str, Column]) -> DataFrame:
    """df(mask: map of field to missing?) -> coverage of each field in each scope; a field that a row's map lacks is missing."""
    each = F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in scopes.items()])))
    s = df.withColumn("scope", each)
    total = s.groupBy("scope").agg(F.count("*").alias("total"))
    here = s.select("scope", F.explode(mask).alias("field", "missing")).groupBy("scope", "field").agg(F.sum((~F.col("missing")).cast("bigint")).alias("present"))
    return here.join(F.broadcast(total), "scope").withColumn("coverage_pct", F.col("present") / F.col("total") * 100)


def pair_slopes(samples: DataFrame, date: str, factors: list[str], ret: str) -> DataFrame:
    """For each pair of factors: correlation and slope of their product with the return, less the day's mean; constant products are
    skipped. One pass over long rows, a pair each."""
    d = samples.withColumn("_r", F.col(ret) - F.avg(ret).over(Window.partitionBy(date)))
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    x = d.select("_r", F.explode(F.array(*[F.struct(F.lit(f"{a}*{b}").alias("pair"), (F.col(a) * F.col(b)).alias("v")) for a, b in pairs])).alias("p")).select("p.pair", "p.v", "_r")
    g = x.groupBy("pair").agg(F.count("*").alias("n"), F.covar_pop("v", "_r").alias("c"), F.var_pop("v").alias("vv"), F.var_pop("_r").alias("vr"))
    g = g.where((F.col("vv") > 1e-12) & (F.col("vr") > 1e-12))
    return g.select("pair", "n", (F.col("c") / F.sqrt(nonzero(F.col("vv") * F.col("vr")))).alias("corr"), (F.col("c") / nonzero(F.col("vv"))).alias("slope"))


def linear_score(df: DataFrame, coefficients: dict[str, float], intercept: float, cap: float) -> DataFrame:
    """df with a linear increment capped at +-cap and its logistic."""
    z = sum((F.col(c) * w for c, w in coefficients.items()), F.lit(intercept))
    return df.withColumn("increment", F.greatest(F.lit(-cap), F.least(F.lit(cap), z))).withColumn("probability", 1 / (1 + F.exp(-z)))


def rank_if_all_ready(df: DataFrame, by: list[str]) -> DataFrame:
    """Place by prediction less a quarter of its uncertainty only where every row of the cross-section has one; else as it was."""
    w = Window.partitionBy(*by)
    ready = F.min(F.col("prediction").isNotNull()).over(w)
    a = F.row_number().over(w.orderBy(F.desc(F.col("prediction") - 0.25 * F.col("uncertainty")), "rank"))
    b = F.row_number().over(w.orderBy("rank"))
    return df.withColumn("_a", a).withColumn("_b", b).withColumn("_ready", ready).withColumn("place", F.when(F.col("_ready"), F.col("_a")).otherwise(F.col("_b")).cast("bigint")).drop("_a", "_b", "_ready")

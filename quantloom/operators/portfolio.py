"""Portfolios for all dates at once: daily baselines, random baselines, caps, turnover, comparison."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window


def top_k_portfolios(outcomes: DataFrame, k: int = 5) -> DataFrame:
    """Equal-weight top k by strategy and date: filled, pending and unfilled counts; a pending holding makes the day unknown;
    unfilled ones stay in the denominator with 0."""
    o = outcomes.where(F.col("rank") <= k)
    n = F.count("*")
    g = o.groupBy("strategy", "signal_date").agg(n.alias("holdings"), F.sum((F.col("state") == "settled").cast("bigint")).alias("filled"), F.sum((F.col("state") == "pending").cast("bigint")).alias("pending"), F.sum((F.col("state") == "no_bars").cast("bigint")).alias("unfilled"), (F.sum(F.when(F.col("state") == "settled", F.col("net_return")).otherwise(0.0)) / n).alias("net"), F.max("rank").alias("worst_rank"))
    return g.withColumn("status", F.when(F.col("pending") > 0, "unknown").otherwise("settled")).withColumn("net_return_pct", F.when(F.col("pending") == 0, F.col("net"))).drop("net")


def _places(n: int, draws: int, k: int, seed: int, day: str | None) -> list[np.ndarray]:
    """The places of each pick, an array over the draws; the hashes are those of stats.hash_draw."""
    if n < k:
        return [np.full(draws, j) for j in range(n)]
    start, out = f"{seed}:" if day is None else f"{seed}:{day}:", []
    for j in range(k):
        hashed = np.array([int(hashlib.md5(f"{start}{draw}:{j}".encode()).hexdigest()[:8], 16) for draw in range(draws)])
        at, top = hashed % (n - k + j + 1), n - k + j
        taken = np.any([at == p for p in out], axis=0) if out else np.zeros(draws, bool)
        out.append(np.where(taken, top, at))
    return out


def random_portfolios(samples: DataFrame, date: str, ret: str, k: int = 5, draws: int = 1000, seed: int = 20260712) -> DataFrame:
    """Seeded random portfolios of k candidates by date: mean, p5, p50, p95 of their averages; of all, where a date has fewer.

    A draw picks k places among a date's candidates in the order of their codes, without repetition: the j-th from the first n - k + j + 1
    by a hash of (seed, date, draw, j), or the last of these if that place is taken. A date's returns are one plain array that all of
    its draws look into: none of them carries a copy. The work goes with draws times k beside one sort of the candidates.
    """

    def one(table: pa.Table) -> pa.Table:
        day, values = table.column("_day")[0].as_py(), table.column(ret).cast(pa.float64())
        missing, v = values.is_null().to_numpy(), values.fill_null(0.0).to_numpy()
        code = pc.rank(table.column("code"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((v, ~missing, code))  # as an array of (code, return) sorts: missing ones first, undefined ones last
        v, there = v[order], ~missing[order]
        places = _places(len(v), draws, k, seed, day)
        total, count = np.zeros(draws), np.zeros(draws, np.int64)
        for at in places:
            ok = there[at]
            total, count = total + np.where(ok, v[at], 0.0), count + ok
        m = pa.array(np.divide(total, count, out=np.zeros(draws), where=count > 0), mask=count == 0)
        return pa.table([table.column(date).take(pa.array(np.zeros(draws, np.int64))), m], names=[date, "m"])

    d = samples.select(F.col(date), "code", ret, F.col(date).cast("string").alias("_day"))
    m = d.groupBy(date).applyInArrow(one, StructType([samples.schema[date], StructField("m", DoubleType())]))
    return m.groupBy(date).agg(F.avg("m").alias("random_mean"), F.percentile("m", F.lit(0.05)).alias("p5"), F.percentile("m", F.lit(0.5)).alias("p50"), F.percentile("m", F.lit(0.95)).alias("p95"))


def capped_weights(rows: DataFrame, by: list[str], raw: str, theme: str, single_cap: float = 0.2, theme_cap: float = 0.4, gross: float = 0.8, rounds: int = 8) -> DataFrame:
    """rows -> with weight: raw weights scaled to `gross`, then cut to the caps with the rest spilled over those below, a fixed number
    of rounds of windows; what no round can place stays in cash."""
    g, t = Window.partitionBy(*by), Window.partitionBy(*by, theme)
    d = rows.withColumn("weight", F.coalesce(gross * F.col(raw) / F.sum(raw).over(g), F.lit(0.0)))
    for _ in range(rounds):
        d = d.withColumn("weight", F.least(F.lit(single_cap), F.col("weight")))
        d = d.withColumn("_t", F.sum("weight").over(t))
        d = d.withColumn("weight", F.when(F.col("_t") > theme_cap, F.col("weight") * theme_cap / F.col("_t")).otherwise(F.col("weight")))
        d = d.withColumn("_open", F.when((F.col("weight") < single_cap - 1e-9) & (F.sum("weight").over(t) < theme_cap - 1e-9), F.col("weight")).otherwise(0.0))
        d = d.withColumn("_spill", gross - F.sum("weight").over(g)).withColumn("_o", F.sum("_open").over(g))
        d = d.withColumn("weight", F.col("weight") + F.when((F.col("_spill") > 1e-12) & (F.col("_o") > 0), F.col("_spill") * F.col("_open") / F.col("_o")).otherwise(0.0))
    d = d.withColumn("weight", F.least(F.lit(single_cap), F.col("weight"))).withColumn("_t", F.sum("weight").over(t))
    return d.withColumn("weight", F.when(F.col("_t") > theme_cap, F.col("weight") * theme_cap / F.col("_t")).otherwise(F.col("weight"))).select(*rows.columns, "weight")


def turnover(weights: DataFrame, by: str, date: str) -> DataFrame:
    """Half the absolute change of weights, cash included, from one date of the series to the next."""
    dates = weights.select(by, date).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(date)))
    w = weights.join(dates, [by, date]).select(by, "_i", "code", "weight")
    both = w.select(by, "_i", "code", "weight", F.lit(0.0).alias("old")).unionByName(w.select(by, (F.col("_i") + 1).alias("_i"), "code", F.lit(0.0).alias("weight"), F.col("weight").alias("old")))
    c = both.groupBy(by, "_i", "code").agg(F.sum("weight").alias("w"), F.sum("old").alias("o"))
    g = c.groupBy(by, "_i").agg(F.sum(F.abs(F.col("w") - F.col("o"))).alias("moved"), F.sum("w").alias("sw"), F.sum("o").alias("so"))
    return g.join(dates, [by, "_i"]).select(by, date, ((F.col("moved") + F.abs(F.col("sw") - F.col("so"))) / 2).alias("turnover"))


def paired_days(daily: DataFrame, series: str, date: str, value: str, base: str, challenger: str) -> DataFrame:
    """Dates that both series have: their values and the increment."""
    p = daily.where(F.col(series).isin(base, challenger)).groupBy(date).agg(F.avg(F.when(F.col(series) == base, F.col(value))).alias("base"), F.avg(F.when(F.col(series) == challenger, F.col(value))).alias("challenger"))
    return p.where("base is not null and challenger is not null").withColumn("increment", F.col("challenger") - F.col("base"))


def peer_benchmark(rows: DataFrame, by: list[str], levels: dict[str, str], ret: str) -> DataFrame:
    """Equal-weight mean of each level's group, the row itself included: market first, then each level's column."""
    d = rows.withColumn("market_return", F.avg(ret).over(Window.partitionBy(*by)))
    for name, c in levels.items():
        d = d.withColumn(f"{name}_return", F.avg(ret).over(Window.partitionBy(*by, c)))
    return d

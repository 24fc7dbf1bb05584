"""Operators on one date's cross-section, for all dates at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.scalars import clamp


def percentile_scores(df: DataFrame, by: list[str], columns: list[str], member: Column | None = None, inverse: tuple[str, ...] = (), key: tuple[str, ...] = ()) -> DataFrame:
    """df -> with <column>_pct for each column: 100 * share of the group's members at or below the value.

    Members are the rows for which `member` holds; other rows are scored against them, after clamping to their range. A group
    with fewer than two members, or with equal ones, scores 50. `inverse` columns score 100 minus that. Rows are shuffled once,
    by group, and sorted there for each column: none is copied and nothing is joined back. `key`, the columns that tell rows
    apart, is not needed for that; rows that repeat a key are all scored.
    """
    member = F.lit(True) if member is None else member
    g = Window.partitionBy(*by)
    d = df.withColumn("_member", member)
    value = {c: F.col(c).cast("double") for c in columns}
    mine = {c: F.when(F.col("_member"), v) for c, v in value.items()}
    d = d.withColumns({f"_{k}_{c}": f(m).over(g) for c, m in mine.items() for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))})
    for c, v in value.items():
        n, lo, hi = (F.col(f"_{k}_{c}") for k in ("n", "lo", "hi"))
        d = d.withColumn("_u", F.least(F.greatest(F.coalesce(v, lo), lo), hi))
        below = F.count(mine[c]).over(g.orderBy("_u").rangeBetween(Window.unboundedPreceding, 0))
        share = below / n * 100
        d = d.withColumn(f"{c}_pct", F.when((n < 2) | (lo == hi), 50.0).otherwise(clamp(100 - share if c in inverse else share, 0, 100)))
    return d.drop("_u", "_member", *[f"_{k}_{c}" for c in columns for k in ("n", "lo", "hi")])


def _shares(values: np.ndarray, missing: np.ndarray, among: np.ndarray, inverse: bool) -> np.ndarray:
    """Of one group what percentile_scores gives each value; among: the members' values."""
    if len(among) < 2:
        return np.full(len(values), 50.0)
    s = np.sort(among)
    if s[0] == s[-1] or np.isnan(s[0]):
        return np.full(len(values), 50.0)
    least = np.searchsorted(s, s[0], "right")  # what lies below the members, or is missing, counts as their lowest
    below = np.where(missing, least, np.maximum(np.searchsorted(s, values, "right"), least))
    share = below / len(s) * 100
    return np.clip(100 - share if inverse else share, 0.0, 100.0)


def percentiles_at_once(df: DataFrame, by: list[str], columns: list[str], members: dict[str, str], inverse: tuple[str, ...] = ()) -> DataFrame:
    """What percentile_scores gives, for columns that are compared among different rows: members names a column's boolean column.

    A group's columns are sorted one by one as plain arrays, not as rows: a sort of whole rows for each column takes all their width
    to disk where a task's rows outgrow its memory. One shuffle, by group; every column of df goes along, so give those that are used.
    """

    def one(table: pa.Table) -> pa.Table:
        chosen = {m: table.column(m).fill_null(False).to_numpy() for m in set(members.values())}
        for c in columns:
            v = table.column(c).cast(pa.float64())
            missing = v.is_null().to_numpy()
            values = v.fill_null(0.0).to_numpy()
            among = ~missing & chosen[members[c]] if c in members else ~missing
            table = table.append_column(f"{c}_pct", pa.array(_shares(values, missing, values[among], c in inverse)))
        return table

    schema = StructType([*df.schema.fields, *(StructField(f"{c}_pct", DoubleType()) for c in columns)])
    return df.groupBy(*by).applyInArrow(one, schema)


SHARES = ("breadth_pct", "strong_pct", "weak_pct")


def _regime_parts() -> dict[str, Column]:
    """Aggregates of a date's quotes (pct_chg, amplitude, turnover); those of SHARES are still to be taken times 100."""
    p = F.col("pct_chg")

    def share(c: Column) -> Column:
        return F.avg(c.cast("double"))

    return {
        "sample_count": F.count("*"), "up_count": F.sum((p > 0).cast("bigint")), "down_count": F.sum((p < 0).cast("bigint")),
        "limit_up_count": F.sum((p >= 9.5).cast("bigint")), "limit_down_count": F.sum((p <= -9.5).cast("bigint")),
        "breadth_pct": share(p > 0), "strong_pct": share(p >= 3), "weak_pct": share(p <= -3),
        "avg_pct_chg": F.avg(p), "median_pct_chg": F.expr("percentile(pct_chg, 0.5)"), "avg_amplitude": F.avg("amplitude"), "avg_turnover": F.avg("turnover"),
    }


def _regime_score(part: Callable[[str], Column]) -> Column:
    return clamp(50 + part("median_pct_chg") * 7.5 + (part("breadth_pct") - 50) * 0.55 + (part("strong_pct") - part("weak_pct")) * 0.35 - F.greatest(F.lit(0.0), part("avg_amplitude") - 7) * 2.4, 0, 100)


def _regime_level(score: Column) -> Column:
    return F.when(score >= 68, "risk_on").when(score <= 42, "risk_off").otherwise("balanced")


def market_regime(quotes: DataFrame, date: str = "trade_date") -> DataFrame:
    """quotes(date, pct_chg, amplitude, turnover) -> a row for each date: breadth, extremes, averages, score and level."""
    g = quotes.groupBy(date).agg(*[(c * 100 if k in SHARES else c).alias(k) for k, c in _regime_parts().items()])
    g = g.withColumn("score", _regime_score(F.col))
    return g.withColumn("level", _regime_level(F.col("score")))


def with_market_level(quotes: DataFrame, date: str = "trade_date") -> DataFrame:
    """quotes -> with the level that market_regime gives their date, found in the date's partition: quotes are made once, not once more
    for a join with their own aggregate. Rows without a date have none."""
    w, parts = Window.partitionBy(date), _regime_parts()
    used = ("median_pct_chg", "breadth_pct", "strong_pct", "weak_pct", "avg_amplitude")
    d = quotes.withColumns({f"_{k}": parts[k].over(w) * 100 if k in SHARES else parts[k].over(w) for k in used})
    return d.withColumn("level", _regime_level(_regime_score(lambda k: F.col(f"_{k}")))).drop(*[f"_{k}" for k in used])


def history_breadth(df: DataFrame, date: str = "trade_date") -> DataFrame:
    """Factor rows -> by date: share above MA20 among ready rows, coverage, median 5- and 20-day returns."""
    ready = F.abs("ma20_gap") > 1e-12
    return df.groupBy(date).agg(
        F.sum(ready.cast("bigint")).alias("ready_count"), (F.avg(ready.cast("double")) * 100).alias("coverage_pct"),
        F.coalesce(F.avg(F.when(ready, (F.col("ma20_gap") > 0).cast("double"))) * 100, F.lit(0.0)).alias("breadth20_pct"),
        F.coalesce(F.percentile(F.when(ready, F.col("ret_5d")), F.lit(0.5)), F.lit(0.0)).alias("median_ret5"),
        F.coalesce(F.percentile(F.when(ready, F.col("ret_20d")), F.lit(0.5)), F.lit(0.0)).alias("median_ret20"),
    )


def market_leaders(quotes: DataFrame, date: str = "trade_date", k: int = 3) -> DataFrame:
    """Markets of a date by median change, then breadth: the first k."""
    g = quotes.groupBy(date, "market").agg((F.avg((F.col("pct_chg") > 0).cast("double")) * 100).alias("breadth_pct"), F.expr("percentile(pct_chg, 0.5)").alias("median_pct_chg"), F.count("*").alias("count"))
    w = Window.partitionBy(date).orderBy(F.desc("median_pct_chg"), F.desc("breadth_pct"), "market")
    return g.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)


def field_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: non-missing count and share, in one aggregation."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    return one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in columns])).alias("x")).select("x.field", "x.present", F.col("_n").alias("total"), F.coalesce(F.col("x.present") / F.when(F.col("_n") > 0, F.col("_n")) * 100, F.lit(0.0)).alias("coverage_pct"))


def optional_factor_score(df: DataFrame, by: list[str], factor: str, fallback: str) -> DataFrame:
    """<factor>_pct where the factor is non-zero anywhere in the group, else the fallback's where that is, else 50."""
    d = percentile_scores(df, by, [factor, fallback])
    w = Window.partitionBy(*by)

    def has(c: str) -> Column:
        return F.max(F.abs(c)).over(w) > 1e-9

    return d.withColumn(f"{factor}_score", F.when(has(factor), F.col(f"{factor}_pct")).when(has(fallback), F.col(f"{fallback}_pct")).otherwise(50.0)).drop(f"{factor}_pct", f"{fallback}_pct")


def fundamental_scores(df: DataFrame, by: list[str]) -> DataFrame:
    """Quality (.45 roe, .35 gross margin, .20 inverse debt) and value (.55 pe, .45 pb, inverse, positives only); missing scores 50."""
    d = df
    for c in ("roe", "gross_margin", "debt_ratio"):
        d = percentile_scores(d, by, [c], F.abs(c) > 1e-12, inverse=("debt_ratio",)).withColumn(f"{c}_pct", F.when(F.abs(c) > 1e-12, F.col(f"{c}_pct")).otherwise(50.0))
    for c in ("pe_dynamic", "pb"):
        d = percentile_scores(d, by, [c], F.col(c) > 0, inverse=(c,))
    quality = F.col("roe_pct") * 0.45 + F.col("gross_margin_pct") * 0.35 + F.col("debt_ratio_pct") * 0.20
    value = F.when((F.col("pe_dynamic") > 0) & (F.col("pb") > 0), F.col("pe_dynamic_pct") * 0.55 + F.col("pb_pct") * 0.45).otherwise(50.0)
    return d.select(*df.columns, quality.alias("quality_score"), value.alias("value_score"))


def top_by_score(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k of each group in a total order, with place from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).where(F.col("place") <= k)


def capped(df: DataFrame, by: list[str], cap_key: str, order: list, cap: int, limit: int) -> DataFrame:
    """At most `cap` of each cap_key in order, then the first `limit`."""
    inner = df.withColumn("_seat", F.row_number().over(Window.partitionBy(*by, cap_key).orderBy(*order))).where(F.col("_seat") <= cap).drop("_seat")
    return top_by_score(inner, by, order, limit)


def round_robin(df: DataFrame, by: list[str], theme: str, order: list, limit: int, cap: int | None = None) -> DataFrame:
    """The best of every theme, themes in the order of their best; then the second best of each; and so on."""
    d = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    d = d.withColumn("_seat", F.row_number().over(Window.partitionBy(*by, theme).orderBy("_rank"))).withColumn("_first", F.min("_rank").over(Window.partitionBy(*by, theme)))
    if cap:
        d = d.where(F.col("_seat") <= cap)
    return top_by_score(d, by, [F.col("_seat"), F.col("_first")], limit).drop("_rank", "_seat", "_first")


def two_caps(df: DataFrame, by: list[str], order: list[str], theme: str, industry: str, theme_cap: int, industry_cap: int, limit: int | None = None) -> DataFrame:
    """Greedy in falling order: a row is skipped if its theme is full, else if its industry is; skipped rows fill neither.

    What a row does depends on all before it, so a group is folded once, in order, over an array with two maps as state. Only
    the first min(caps) rows of each pair of theme and industry go into it: a later one could be taken only if all of these
    were, and then one of its keys is full. So the array grows with the pairs, not with the rows. limit: rows kept at most.
    """
    df, every = df.withColumn("_seat", F.row_number().over(Window.partitionBy(*by, theme, industry).orderBy(*order))).where(F.col("_seat") <= min(theme_cap, industry_cap)).drop("_seat"), df
    keys = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order], F.col(theme).alias("_t"), F.col(industry).alias("_i"))))
    state = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("t"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("i"), F.array().cast("array<string>").alias("kept"))

    def plus(m: Column, k: Column) -> Column:
        n = F.coalesce(F.try_element_at(m, k), F.lit(0)) + 1
        return F.map_concat(F.map_filter(m, lambda a, _: a != k), F.map_from_arrays(F.array(k), F.array(n)))

    def step(s: Column, r: Column) -> Column:
        ok = (F.coalesce(F.try_element_at(s["t"], r["_t"]), F.lit(0)) < theme_cap) & (F.coalesce(F.try_element_at(s["i"], r["_i"]), F.lit(0)) < industry_cap)
        return F.struct(F.when(ok, plus(s["t"], r["_t"])).otherwise(s["t"]).alias("t"), F.when(ok, plus(s["i"], r["_i"])).otherwise(s["i"]).alias("i"), F.when(ok, F.concat(s["kept"], F.array(r[order[-1]].cast("string")))).otherwise(s["kept"]).alias("kept"))

    g = df.groupBy(*by).agg(keys.alias("_rows")).withColumn("_kept", F.aggregate("_rows", state, step)["kept"])
    kept = g.select(*by, F.posexplode("_kept").alias("_at", "_id")).select(*by, (F.col("_at") + 1).cast("bigint").alias("place"), "_id")
    kept = kept.where(F.col("place") <= limit) if limit is not None else kept
    return every.withColumn("_id", F.col(order[-1]).cast("string")).join(kept, [*by, "_id"]).drop("_id")

"""Field-wise merge of rows of several sources: the best source of a code, each gap filled from the next, with its provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How much a source counts; any other 1.
SOURCE_BONUS = {"today_term": 3.0, "tomorrow_picks": 3.0, "swing_picks": 3.0}


def present(c: str, kind: str) -> Column:
    """Whether a field holds something: not null, not empty, not 0."""
    v = F.col(c)
    return v.isNotNull() & ((v != "") if kind == "string" else (v != 0) if kind not in ("boolean", "date", "timestamp") else F.lit(True))


def merge_sources(rows: DataFrame, fields: list[str], code: str = "code", source: str = "source", arrival: list[str] | None = None, score: str = "score", value: str = "value_score") -> DataFrame:
    """rows(code, source, arrival, score, value, <fields>) -> code, source (the best one), <fields>, provenance (field -> source).

    A row outranks another by its source's bonus, then score, then value; rows come in the order of `arrival`, and one takes
    over if it outranks all before it, so of equals the first stays. A field is that of the first row that has it: those that
    took over, the last of these first, then the others as they came. (Ranks are of a row's own fields, filled gaps aside.)
    Rows without a code are left out. Ranks are a running maximum by code; the fields one pre-aggregated pass.
    """
    order = arrival or [source]
    kinds = dict(rows.dtypes)
    bonus = F.lit(1.0)
    for k, v in SOURCE_BONUS.items():
        bonus = F.when(F.col(source) == k, v).otherwise(bonus)
    rank = F.struct(bonus.alias("b"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    w = Window.partitionBy(code).orderBy(*order)
    d = rows.where(F.col(code).isNotNull() & (F.col(code).cast("string") != "")).withColumn("_rank", rank).withColumn("_n", F.row_number().over(w))
    before = F.max("_rank").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_place", F.when(before.isNull() | (F.col("_rank") > before), -F.col("_n")).otherwise(F.col("_n")))
    firsts = [F.min_by(F.struct(F.col(f).alias("v"), F.col(source).alias("s")), F.when(present(f, kinds[f]), F.col("_place"))).alias(f) for f in fields]
    g = d.groupBy(code).agg(F.min_by(source, "_place").alias(source), *firsts)
    origin = F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f"{f}.s"))]), lambda _, s: s.isNotNull())
    return g.select(code, source, *[F.col(f"{f}.v").alias(f) for f in fields], origin.alias("provenance"))


def watch_list(scored: DataFrame, top_n: int, code: str = "code") -> DataFrame:
    """The first top_n by potential, valuation and leader score, falling, then by rising risk (missing counts as 100), then code."""
    keys = [F.desc(F.coalesce(F.col(c), F.lit(0.0))) for c in ("potential", "valuation", "leader")]
    return scored.orderBy(*keys, F.coalesce(F.col("risk"), F.lit(100.0)), code).limit(max(0, top_n))

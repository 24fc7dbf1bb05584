"""Time joins: point in time, as-of, intervals, anti joins, nearest neighbours."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, columns: list[str]) -> DataFrame:
    """left with the columns of the newest right row of its key at or before its time; nulls if there is none.

    Union, one sort by key and time, and a running last value: no range join, no product of rows by key.
    """
    r = right.select(F.col(key).alias("_k"), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(*columns).alias("_r"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"))
    a = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return r.unionByName(a).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1").select("_l.*", *[F.col(f"_m.{c}").alias(f"asof_{c}" if c in left.columns else c) for c in columns])


def point_in_time(signals: DataFrame, facts: DataFrame, key: str, cutoff: str, published: str) -> tuple[DataFrame, DataFrame]:
    """(facts published by the signal's cut-off, counts of the others by reason)."""
    j = signals.join(facts, key)
    reason = F.when(F.col(published).isNull(), "missing_time").when(F.col(published) > F.col(cutoff), "future")
    j = j.withColumn("_reason", reason)
    return j.where("_reason is null").drop("_reason"), j.where("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))


def cycle_returns(entries: DataFrame, bars: DataFrame) -> DataFrame:
    """entries(code, entry_date, exit_date) -> return from the open of the entry day to the last close by the exit; null unless the
    first bar in the range is on the entry day. Two equality joins, the second on the as-of day."""
    opens = bars.select("code", F.col("trade_date").alias("entry_date"), F.col("open").alias("entry_open"))
    e = entries.join(opens, ["code", "entry_date"], "left")
    last = as_of(e, bars.select("code", F.col("trade_date").alias("last_date"), F.col("close").alias("exit_close"), "trade_date"), "code", "exit_date", "trade_date", ["last_date", "exit_close"])
    ok = F.col("entry_open").isNotNull() & (F.col("last_date") >= F.col("entry_date"))
    return last.withColumn("cycle_return", F.when(ok, (F.col("exit_close") / F.col("entry_open") - 1) * 100))


def nearest(queries: DataFrame, train: DataFrame, block: str, features: dict[str, tuple[float, float]], k: int, least_shared: int = 2) -> DataFrame:
    """The k nearest training rows of each query within its block: scaled weighted squared distance over the features that both
    have. features: name -> (scale, weight), weights above 0. Ties of distances rounded to 9 digits go to the smaller train_id.

    Rows with equal features are one point, of which the k smallest ids can count. Points that have all features lie in a grid
    of cells by block; a query point meets the cells around its own, and is done when its k-th distance is less than the way
    to the first cell it has not met. The others go on with cells twice as wide, until a cell spans the block. Points that lack
    a feature but have enough are compared with all of their block.
    """
    names = list(features)

    def enough(df: DataFrame) -> DataFrame:
        return df.where(F.col(block).isNotNull() & (sum((F.col(f).isNotNull().cast("int") for f in names), F.lit(0)) >= least_shared))

    def whole(prefix: str = "") -> Column:
        out = F.lit(True)
        for f in names:
            out = out & F.col(prefix + f).isNotNull() & ~F.isnan(prefix + f) & (F.abs(prefix + f) < 1e150)
        return out

    def cast(df: DataFrame, key: str) -> DataFrame:
        return enough(df.select(block, key, *[F.col(f).cast("double").alias(f) for f in names])).withColumns({f: F.col(f) + 0.0 for f in names})

    same = Window.partitionBy(block, *names).orderBy("train_id")
    q, t = cast(queries, "query_id"), cast(train, "train_id").withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k).drop("_n")
    t = written(t.groupBy(block, *names).agg(F.collect_list("train_id").alias("_ids")).withColumnsRenamed({f: f"_{f}" for f in names}), "nearest-train")
    points = written(q.select(block, *names).distinct().withColumn("_q", F.monotonically_increasing_id()), "nearest-queries")
    both = {f: F.col(f).isNotNull() & F.col(f"_{f}").isNotNull() for f in names}
    d = sum((F.when(both[f], F.pow((F.col(f) - F.col(f"_{f}")) / s, 2.0) * w).otherwise(0.0) for f, (s, w) in features.items()), F.lit(0.0))
    used = sum((F.when(both[f], w).otherwise(0.0) for f, (_, w) in features.items()), F.lit(0.0))
    shared = sum((both[f].cast("int") for f in names), F.lit(0))
    order = Window.partitionBy("_q").orderBy(F.round("distance", 9), "train_id")

    def first_k(pairs: DataFrame) -> DataFrame:
        near = pairs.withColumn("distance", d / F.when(used > 0, used)).where((shared >= least_shared) & F.col("distance").isNotNull())
        near = near.select("_q", "distance", F.explode("_ids").alias("train_id"))
        return near.withColumn("near", F.row_number().over(order).cast("bigint")).where(F.col("near") <= k).select("_q", "train_id", "near", "distance")

    # The rest: points that lack a feature on either side, against whole blocks.
    grid_t, rest_t = t.where(whole("_")), t.where(~whole("_"))
    grid_q, rest_q = points.where(whole()), points.where(~whole())
    plain = rest_q.join(t, block) if not rest_q.isEmpty() else None
    beside = written(first_k(grid_q.join(rest_t, block)), "nearest-beside") if not rest_t.isEmpty() else None

    # A point's place in the grid: features as far as a distance of 1 takes them; the unit of a block holds about k points.
    axis = {f: w**0.5 / s for f, (s, w) in features.items()}
    span = grid_t.groupBy(block).agg(F.count("*").alias("_points"), *[F.min(f"_{f}").alias(f"_lo_{f}") for f in names], *[F.max(f"_{f}").alias(f"_hi_{f}") for f in names], *[F.percentile_approx(f"_{f}", F.array(F.lit(0.05), F.lit(0.95))).alias(f"_mid_{f}") for f in names])
    wide = [(F.col(f"_hi_{f}") - F.col(f"_lo_{f}")) * a for f, a in axis.items()]
    volume, dims = F.lit(1.0), F.lit(0)
    for x in [(F.col(f"_mid_{f}")[1] - F.col(f"_mid_{f}")[0]) * a for f, a in axis.items()]:  # without outliers
        volume, dims = volume * F.when(x > 0, x).otherwise(1.0), dims + (x > 0).cast("int")
    unit = F.when(dims > 0, F.pow(volume * k / F.col("_points"), 1.0 / dims)).otherwise(1.0)
    span = span.select(block, F.greatest(unit, F.greatest(*wide, F.lit(0.0)) * 1e-6).alias("_unit"), F.greatest(*wide, F.lit(0.0)).alias("_wide"), *[F.col(f"_lo_{f}") for f in names])  # a row a block
    span = written(span, "nearest-span")
    open_, grid_t, level, total = written(grid_q.join(span, block), "nearest-open"), grid_t.join(span.drop("_wide"), block), 0, sum(w for _, w in features.values())
    done = [x for x in (None if beside is None else beside.join(grid_q.join(span, block, "left_anti"), "_q", "left_semi"), None if plain is None else first_k(plain)) if x is not None]
    while not open_.isEmpty():
        size = F.col("_unit") * float(2**level)
        cell = {f: F.floor((F.col(f) - F.col(f"_lo_{f}")) * a / size) for f, a in axis.items()}
        # A query beyond the block's edge looks from the edge: what it has not met is at least as far.
        mine = open_.withColumns({f"_c{i}": F.least(F.greatest(c, F.lit(-1)), F.floor(F.col("_wide") / size) + 1) for i, c in enumerate(cell.values())})
        for i in range(len(names)):
            mine = mine.withColumn(f"_k{i}", F.explode(F.sequence(F.col(f"_c{i}") - 1, F.col(f"_c{i}") + 1)))
        theirs = grid_t.select(block, "_ids", *[f"_{f}" for f in names], *[F.floor((F.col(f"_{f}") - F.col(f"_lo_{f}")) * a / size).alias(f"_k{i}") for i, (f, a) in enumerate(axis.items())])
        found = first_k(mine.join(theirs, [block, *[f"_k{i}" for i in range(len(names))]]))
        if beside is not None:
            more = found.unionByName(beside.join(open_.select("_q"), "_q", "left_semi")).drop("near")
            found = more.withColumn("near", F.row_number().over(order).cast("bigint")).where(F.col("near") <= k)
        found = written(found, "nearest-found")
        kth = found.groupBy("_q").agg(F.count("*").alias("_have"), F.max("distance").alias("_kth"))
        seen = (F.col("_wide") < size) | ((F.col("_have") >= k) & (F.col("_kth") + 1e-8 < size * size * (1 - 1e-9) / total))
        judged = open_.join(kth, "_q", "left").withColumn("_done", F.coalesce(seen, F.lit(False))).select("_q", "_done")
        judged = written(judged, "nearest-judged")
        done.append(found.join(judged.where("_done"), "_q", "left_semi"))
        open_, level = written(open_.join(judged.where("not _done"), "_q", "left_semi"), "nearest-open"), level + 1
    out = first_k(points.limit(0).join(t, block))
    for x in done:
        out = out.unionByName(x)
    of = points.join(q.withColumnsRenamed({block: "_block", **{f: f"_{f}" for f in names}}), (F.col(block) == F.col("_block")) & reduce(and_, [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in names]))
    return out.join(of.select("_q", "query_id"), "_q").select("query_id", "train_id", "near", "distance")

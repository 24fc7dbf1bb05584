"""The live side on Structured Streaming: ticks as a file stream, latest quotes, windows, hysteresis, change detection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared_path

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, code, ts, kind, price as a stream."""
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    return s.select("event_id", F.col("user_id").alias("code"), "ts", F.col("event_type").alias("kind"), F.col("value").alias("price"))


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return its result: the last batch of a complete stream, all batches of an append one.

    Each batch is written under its own number, so a batch that runs again after a failure replaces its own rows.
    """
    spark = stream.sparkSession
    path = shared_path(spark, name)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={0 if mode == 'complete' else n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)


def latest_quotes(ticks: DataFrame) -> DataFrame:
    """The newest tick of each code; a late tick does not replace a newer one."""
    return ticks.groupBy("code").agg(F.max(F.struct("ts", "event_id", "price", "kind")).alias("x")).select("code", "x.event_id", "x.price", "x.kind")


def stale(latest: DataFrame, now: str, seconds: float) -> DataFrame:
    """Latest rows with their age against a given time and whether that is too old."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col("ts").cast("double")
    return latest.withColumn("age_s", age).withColumn("stale", F.col("age_s") > seconds)


def frozen(ticks: DataFrame, cutoff: str) -> DataFrame:
    """Ticks by whether they came at or after the day's cut-off (HH:mm)."""
    return ticks.withColumn("late", F.date_format("ts", "HH:mm") >= cutoff).groupBy("late").agg(F.count("*").alias("n"))


def phases(ticks: DataFrame) -> DataFrame:
    """Ticks by phase of the day."""
    t = F.date_format("ts", "HH:mm")
    p = F.when(t < "09:30", "before").when(t < "10:30", "opening").when(t < "11:20", "morning").when(t < "13:00", "noon").when(t < "14:00", "afternoon").otherwise("closing")
    return ticks.groupBy(p.alias("phase")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


def tumbling(ticks: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean price and breadth (share of prices above 10) by event-time window; `slide` makes the windows overlap."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = ticks.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.avg("price").alias("avg_price"), (F.avg((F.col("price") > 10).cast("double")) * 100).alias("breadth_pct"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "avg_price", "breadth_pct")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions of a code: ticks no further apart than the gap."""
    g = ticks.withWatermark("ts", late).groupBy("code", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("code", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def changes(ticks: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each (code, kind, ts) once within the watermark: what a push would send."""
    return ticks.withWatermark("ts", within).dropDuplicatesWithinWatermark(["code", "kind", "ts"]).select("event_id", "code", "kind")


def hysteresis(keep: int = 10, buffer: int = 20) -> Callable:
    """State update for one horizon: codes kept while among the first `buffer`, filled to `keep`; with streaks."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["round", "place"])
        out = []
        for n, g in rows.groupby("round"):
            ranked = g["code"].tolist()
            top = set(ranked[:buffer])
            stay = [c for c in ranked if c in held and c in top][:keep]
            new = [c for c in ranked if c not in stay][: max(0, keep - len(stay))]
            held = {c: held.get(c, 0) + 1 for c in [*stay, *new]}
            out.append(pd.DataFrame({"horizon": key[0], "round": n, "code": list(held), "streak": list(held.values()), "is_new": [c in new for c in held]}))
        state.update((list(held), list(held.values())))
        yield pd.concat(out)

    return update


def stable_top(ranked: DataFrame, keep: int = 10, buffer: int = 20) -> DataFrame:
    """Stream of (horizon, round, code, place) -> members after each round: horizon, round, code, streak, is_new. A round must come
    whole in one batch; rows beyond the first `buffer` places are dropped before the shuffle."""
    ranked = ranked.where(F.col("place") <= max(keep, buffer))
    return ranked.groupBy("horizon").applyInPandasWithState(hysteresis(keep, buffer), "horizon string, round long, code long, streak long, is_new boolean", "codes array<long>, streaks array<long>", "append", GroupStateTimeout.NoTimeout)


def stable_top_batch(ranked: DataFrame, keep: int = 10, buffer: int = 20) -> DataFrame:
    """The same over a finished table: one group a horizon, rounds in order.

    No row beyond the first `buffer` places of a round matters: members stay only within these, and those that fill up to
    keep <= buffer come from the first `keep`. So a group has `buffer` rows a round.
    """
    ranked = ranked.where(F.col("place") <= max(keep, buffer))

    class Fresh:
        exists = False

        def update(self, _):
            pass

    step = hysteresis(keep, buffer)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return next(step(key, iter([pdf]), Fresh()))

    return ranked.groupBy("horizon").applyInPandas(run, "horizon string, round long, code long, streak long, is_new boolean")


LABEL = "signal_id long, code long, entry_price double, labelled_on date, return_1d double, return_3d double, return_5d double, max_gain double, max_drawdown double"
_PENDING = "last double, ids array<long>, entries array<double>, bars array<long>, r1 array<double>, r3 array<double>, highs array<double>, lows array<double>"


def labelling(days: int = 5) -> Callable:
    """State update of one code: its last close and its pending signals, each with the bars it has seen so far."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *held = state.get if state.exists else (None, *([] for _ in range(7)))
        pending = {s: [e, n, r1, r3, h, lo] for s, e, n, r1, r3, h, lo in zip(*held, strict=True)}
        rows, out = pd.concat(list(batches)).sort_values(["day", "is_signal", "signal_id"], na_position="first"), []
        for day, is_signal, signal, high, low, close in rows[["day", "is_signal", "signal_id", "high", "low", "close"]].itertuples(index=False):
            if is_signal:
                if last is not None:
                    pending[int(signal)] = [last, 0, 0.0, 0.0, float("-inf"), float("inf")]
                continue
            last = float(close)
            for s in list(pending):
                p = pending[s]
                p[1] += 1
                gain = (last / p[0] - 1) * 100
                p[2], p[3] = gain if p[1] == 1 else p[2], gain if p[1] == 3 else p[3]
                p[4], p[5] = max(p[4], float(high)), min(p[5], float(low))
                if p[1] == days:
                    out.append((s, key[0], p[0], day, p[2], p[3], gain, (p[4] / p[0] - 1) * 100, (p[5] / p[0] - 1) * 100))
                    del pending[s]
        cols = list(zip(*pending.values(), strict=True)) if pending else [()] * 6
        state.update((last, list(pending), *map(list, cols)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LABEL.split(", ")])

    return update


def label_as_bars_come(feed: DataFrame) -> DataFrame:
    """A stream of (code, day, is_signal, signal_id, high, low, close), bars and signals in one -> a label for each signal, once, on its
    fifth bar: returns from the last close at or before the signal, best and worst price.

    Days must not go back from batch to batch. A code's state is its last close and its pending signals, so nothing is read
    again and the plan is the same for every batch.
    """
    return feed.groupBy("code").applyInPandasWithState(labelling(), LABEL, _PENDING, "append", GroupStateTimeout.NoTimeout)


def resume(stream: DataFrame, path: str) -> DataFrame:
    """Run an append stream over what is new since its last run under `path` and return all its rows so far.

    A batch is written under its own number: one that broke off is replaced when it runs again, none is there twice.
    """
    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")

    stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)

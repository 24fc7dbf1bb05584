"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, native DataFrame functions only.

Every shard has `vnodes` points on a ring of 2^32 places; a key goes to the shard of the first point at or after its own
place, and while that shard is full to the next points clockwise. A shard holds at most floor or ceiling of rows/shards
rows, the first (rows mod shards) shards holding one more, so counts are at most one apart whatever the keys.

All keys between two neighbouring points (an arc) walk the same way, so only the arcs' row counts need be known to settle
every overflow: a table of shards * vnodes counts, bounded by the parameters, is played through clockwise on the driver.
Each arc then has a few runs (from, to, shard, first slot) and a row's rank within its arc picks its run. The rows take
one shuffle by arc, without their text. Arcs are many and the places are a hash of the key, so no arc is hot.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RING = 1 << 32
VNODES = 128


def ring_points(shards: int, vnodes: int = VNODES) -> tuple[list[int], list[int]]:
    """Sorted places of all virtual nodes, and the shard of each."""
    both = sorted((int(md5(f"shard-{s}/{v}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for v in range(vnodes))
    return [p for p, _ in both], [s for _, s in both]


def ring_runs(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Row counts by arc -> (arc, from_rank, to_rank, shard, first_slot), to_rank exclusive.

    Step d of the walk offers what every arc still holds to the point d places on, arcs in ring order; a full shard
    takes nothing. Every row is placed within one turn, since the capacities add up to the row count.
    """
    total, n = sum(counts.values()), len(owners)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, left, runs = [0] * shards, dict(sorted((a, c) for a, c in counts.items() if c)), []
    done = dict.fromkeys(left, 0)
    for d in range(n):
        for a in list(left):
            s = owners[(a + d) % n]
            if take := min(left[a], room[s] - used[s]):
                runs.append((a, done[a], done[a] + take, s, used[s]))
                used[s], done[a], left[a] = used[s] + take, done[a] + take, left[a] - take
                if not left[a]:
                    del left[a]
        if not left:
            break
    return runs


def assign_shards(docs: DataFrame, shards: int = 24, vnodes: int = VNODES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of docs.

    law is `rows`: counts of two shards are at most one apart. size: UTF-8 bytes of the text plus 8 (a null text has 0
    bytes, and the CRC of no bytes, 0). slot is gapless from 0 within a shard. grown_shard is null under this law. A null
    doc_id is a key like any other; rows that repeat a doc_id are placed one by one. Other columns are not looked at.
    """
    spark = docs.sparkSession
    points, owners = ring_points(shards, vnodes)
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("long")
    # The arc of a place: points are cut into 2^12 equal sectors; a sector names its first arc, the few points in it the rest.
    sectors = [bisect_left(points, s << 20) for s in range(1 << 12)]
    inside = [[p for p in points if p >> 20 == s] for s in range(1 << 12)]
    table = spark.createDataFrame([(s, sectors[s], inside[s]) for s in range(1 << 12)], "sector int, base int, inside array<bigint>")

    def with_arc(df: DataFrame) -> DataFrame:
        near = df.withColumn("place", place).withColumn("sector", F.shiftright("place", 20).cast("int")).join(F.broadcast(table), "sector")
        arc = (F.col("base") + F.size(F.filter("inside", lambda p: p < F.col("place")))) % len(points)
        return near.withColumn("arc", arc.cast("int")).drop("sector", "base", "inside")

    counts = {r["arc"]: r["n"] for r in with_arc(docs.select("doc_id")).groupBy("arc").agg(F.count("*").alias("n")).collect()}
    runs: dict[int, list] = {}
    for a, lo, hi, s, slot in ring_runs(counts, owners, shards):
        runs.setdefault(a, []).append((lo, hi, s, slot))
    plan = spark.createDataFrame(list(runs.items()), "arc int, runs array<struct<lo:bigint,hi:bigint,shard:int,slot:bigint>>")

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = with_arc(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")))
    order = Window.partitionBy("arc").orderBy("place", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(F.broadcast(plan), "arc")
    run = F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0]
    return ranked.withColumn("run", run).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("run.shard").alias("shard"), (F.col("run.slot") + F.col("rank") - F.col("run.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

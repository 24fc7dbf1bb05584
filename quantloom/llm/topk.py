"""Exact top-k inner products by no-random-access aggregation (NRA).

Candidates lie in blocks. In a block every dimension has a list of its values in falling order; a query reads a list
from the top if its own component is positive and from the bottom if it is negative, so its contributions fall as it
reads. After each step of a few entries of all lists, a candidate's score has a lower bound (what was read, plus the
least that each unread list can give) and an upper bound (what was read, plus the list's current entry for each unread
list). A query stops when no candidate outside its k best lower bounds, read or not, has an upper bound that reaches
the k-th lower bound; then the members' entries that were not yet read resolve their scores. Until then no list is probed
out of order. Queries go through blocks in blocks too: a unit of work is a bounded matrix whatever the
input, units are dealt evenly, and of each only k rows a query go on to the last ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

CANDIDATES = 1024  # in a block
QUERIES = 1024  # in a block
PARTS = (0.125, 0.375, 1.0)  # shares of the lists after which bounds are compared


def nra_block(x: np.ndarray, xid: np.ndarray, q: np.ndarray, qid: np.ndarray, k: int, parts: tuple[float, ...] = PARTS) -> tuple[np.ndarray, ...]:
    """x: (candidates, dims), q: (queries, dims), whole numbers as float64. The k best of the block for each query, its own
    id left out: query (its row in q), candidate's id, its row in x, score. Ties to the smaller id.

    What was read and what is unread of a list are masks over its entries, so the sums of all queries are matrix products.
    """
    n, dims = x.shape
    order = np.argsort(-x, axis=0, kind="stable")  # the lists: candidates by falling value, one list a column
    low, high, every = x.min(axis=0), x.max(axis=0), np.arange(dims)
    down, up = np.zeros((dims, n)), np.zeros((dims, n))  # entries read from the top and from the bottom
    out, active, k, lo = ([], [], [], []), np.arange(len(q)), min(k, n), 0
    for part in parts:
        hi = max(lo, min(n, int(np.ceil(part * n))))
        for d in range(dims):
            down[d, order[lo:hi, d]] = 1
            up[d, order[n - hi : n - lo, d]] = 1
        lo = hi
        pos, neg = np.maximum(q[active], 0), np.minimum(q[active], 0)
        read = pos @ (x.T * down) + neg @ (x.T * up)
        own = xid[None, :] == qid[active][:, None]
        if hi == n:  # all is read
            read[own] = -np.inf
            for r, a in enumerate(active):
                cut = np.partition(read[r], n - k)[n - k]
                near = np.flatnonzero(read[r] >= cut)
                keep = near[np.lexsort((xid[near], -read[r][near]))[:k]]
                _emit(out, a, xid[keep], keep, read[r][keep])
            break
        # An unread entry gives at least what the list's far end gives, at most what its current entry gives.
        lower = read + (pos * low) @ (1 - down) + (neg * high) @ (1 - up)
        upper = read + (pos * x[order[hi - 1, every], every]) @ (1 - down) + (neg * x[order[n - hi, every], every]) @ (1 - up)
        lower[own] = upper[own] = -np.inf
        best = np.argpartition(lower, n - k, axis=1)[:, n - k :]
        floor = np.take_along_axis(lower, best, axis=1).min(axis=1)
        np.put_along_axis(upper, best, -np.inf, axis=1)
        # An outsider whose upper bound only equals the floor may win by its id: reading goes on.
        stop = (upper.max(axis=1) < floor) & np.isfinite(floor)
        for r in np.flatnonzero(stop):
            _emit(out, active[r], xid[best[r]], best[r], x[best[r]] @ q[active[r]])
        active = active[~stop]
        if not len(active):
            break
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


def _emit(out: tuple[list, ...], query: int, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
    keep = np.isfinite(scores)
    for o, x in zip(out, (np.full(len(ids), query), ids, rows, scores), strict=True):
        o.append(x[keep])


def _matrix(vectors: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(v, np.float64) for v in vectors]
    width = max(map(len, rows))
    return np.array([np.pad(r, (0, width - len(r))) for r in rows])


def _quantise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids, vs = [], []
        for i, v in zip(b["vec_id"], b["embedding"], strict=True):
            if v is not None and len(v):
                f = np.floor(256 * np.asarray(v, np.float64))
                if np.isfinite(f).all():
                    ids.append(i)
                    vs.append(f.tobytes())
        yield pd.DataFrame({"vec_id": np.array(ids, np.int64), "v": vs})


def _unit(k: int):
    def done(held: list[pd.DataFrame]):
        g = pd.concat(held)
        qs, xs = g[g["is_query"]], g[~g["is_query"]]
        if len(qs) and len(xs):
            both = _matrix(qs["v"].tolist() + xs["v"].tolist())
            q, i, r, s = nra_block(both[len(qs) :], xs["vec_id"].to_numpy(), both[: len(qs)], qs["vec_id"].to_numpy(), k)
            q, r = q.astype(np.int64), r.astype(np.int64)
            own = {"query_id": qs["vec_id"].to_numpy()[q], "query_key": qs["key"].to_numpy()[q]}
            yield pd.DataFrame({**own, "vec_id": i.astype(np.int64), "times": xs["times"].to_numpy()[r], "score": s.astype(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None
        for b in batches:
            for u, g in b.groupby("unit", sort=False):
                if u != key and held:
                    yield from done(held)
                    held = []
                held.append(g)
                key = u
        if held:
            yield from done(held)

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank (from 1), vec_id, score: the k largest inner products of each query.

    Components become floor(256 * x). Queries are the rows whose vec_id is divisible by `every`; candidates all rows but
    those with the query's own id; ties to the smaller vec_id. Vectors that are null, empty or hold a null or non-finite
    component (or one that overflows when scaled) take no part, nor do rows without vec_id. Missing trailing components
    count as 0. Scores are exact while they stay below 2^53. Rows that repeat a vec_id are candidates one by one, equal ones
    too; as queries, equal rows are answered once and different ones each with ranks of its own.
    """
    spark = vectors.sparkSession
    own = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    ready = own.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    table = materialize(ready.mapInPandas(_quantise, "vec_id long, v binary").groupBy("vec_id", "v").agg(F.count("*").alias("times"), F.xxhash64(F.col("v")).alias("key")), "topk-vectors")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    size = table.agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q")).first()
    nc, nq = max(1, -(-size["n"] // candidates)), max(1, -(-(size["q"] or 0) // queries))
    c = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(nc))
    d = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(nq))
    row = ["vec_id", "v", "times", "key"]
    left = table.select(*row, F.lit(False).alias("is_query"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(nq - 1)), lambda j: c * nq + j)).alias("unit"))
    right = table.where(is_query).select(*row, F.lit(True).alias("is_query"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(nc - 1)), lambda i: i * nq + d)).alias("unit"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    best = left.unionByName(right).repartition(parts, "unit").sortWithinPartitions("unit").mapInPandas(_unit(k), "query_id long, query_key long, vec_id long, times long, score long")
    w = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    # No more than k of equal rows are needed.
    each = best.select("query_id", "query_key", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.least("times", F.lit(k)).cast("int"))))
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

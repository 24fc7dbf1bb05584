"""Queries against all rows of their block, in units of bounded size: a packed slice of rows by a packed chunk of queries.

Spark deals the units; a task orders a slice's rows into tiles of near rows, takes whole tiles that lie on one side of a query's
limit at once, and compares in numpy only the pairs of the tiles that the limit goes through. What it gives back is one matrix of
counts or sums for some queries and a slice, or the few rows that are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, LongType, StructField, StructType

from ..sources.shared import broadcast_if_small, written

ROWS, QUERIES, TILE = 262_144, 65_536, 16
LEAF, TOGETHER, PAIRS = 64, 1_024, 1_024  # rows of a tile, queries of a matrix, tiles compared at once
SAMPLE = 16_384  # rows of a block that a query's first bracket is guessed from
NONE = 8_191  # bin of pairs that do not count
SHIFT = 18  # of a float32 this leaves the exponent and five bits: 32 bins for each doubling of the distance
CUTS = 256
SUMS = 6  # n, w, wr, wwin, wdd, wrr


def packed(df: DataFrame, block: str, key: str, rows: int, name: str) -> DataFrame:
    """df -> block and, as arrays named after the columns with name_ before them, about `rows` rows at once."""
    d = written(df, f"peer-{name}")
    most = d.groupBy(block).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    d = d.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(-(-most // rows)))).groupBy(block, "_slice").agg(F.collect_list(F.struct(*[c for c in df.columns if c != block])).alias("_x"))
    return written(d.select(block, *[F.col(f"_x.{c}").alias(f"{name}_{c}") for c in df.columns if c != block]), f"peer-{name}-packed")


def _apart(xs: list[np.ndarray], ys: list[np.ndarray], features: list[tuple[float, float]], least_shared: int) -> np.ndarray:
    """Scaled weighted squared distances in units of 1e-9 of arrays that broadcast; -1 where fewer than least_shared features are in both."""
    over, weights, shared = 0.0, 0.0, 0
    for x, y, (scale, weight) in zip(xs, ys, features, strict=True):
        has, of = np.isfinite(x), np.isfinite(y)
        both = has if of.all() else has & of  # a column where only queries lack the feature
        d = np.where(has, x, 0.0) - np.where(of, y, 0.0)
        d /= scale
        d *= d
        d *= both * weight
        over += d
        weights, shared = weights + both * weight, shared + both.astype(int)
    ok = (shared >= least_shared) & (weights > 0)
    over /= np.where(ok, weights, 1.0)
    over *= 1e9
    over += 0.5
    return np.where(ok, np.floor(over, out=over), -1.0)


def distances(q: list[np.ndarray], t: list[np.ndarray], features: list[tuple[float, float]], least_shared: int) -> np.ndarray:
    """Of every query to every row, (queries, rows)."""
    return _apart([x[:, None] for x in q], [y[None, :] for y in t], features, least_shared)


def bin_of(d: np.ndarray) -> np.ndarray:
    return np.where(d < 0, NONE, np.maximum(d, 0).astype(np.float32).view(np.int32) >> SHIFT)


def ends_of(edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a bin starts and where the next one does."""
    start, end = ((edge + k).astype(np.int32) << SHIFT for k in (0, 1))
    return start.view(np.float32).astype(float), end.view(np.float32).astype(float)


def part_of(d: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of CUTS equal parts from start to end a distance between them lies in."""
    return np.clip(np.floor((d - start) / (end - start) * CUTS), 0, CUTS - 1).astype(np.int64)


def cut_of(d: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Which of CUTS equal parts of the bin `edge` a distance of that bin lies in."""
    return part_of(d, *ends_of(edge))


def _counted(ids: np.ndarray, key: np.ndarray, width: int) -> pd.DataFrame:
    """key: by query, -1 where nothing is to be counted."""
    at, k = np.nonzero(key >= 0)[0], key[key >= 0]
    n = np.bincount(at * width + k, minlength=1)
    some = np.flatnonzero(n)
    return pd.DataFrame({"query_id": ids[some // width], "bin": some % width, "n": n[some]})


class Tiles:
    """A slice's rows in tiles of at most LEAF that lie near each other in the features `used`; rows that lack one make tiles of their own."""

    def __init__(self, ys: list[np.ndarray], used: list[int], features: list[tuple[float, float]]):
        whole = np.all([np.isfinite(ys[k]) for k in used], axis=0)
        scaled = [ys[k] * (np.sqrt(features[k][1]) / features[k][0]) for k in used]
        todo, leaves = [np.flatnonzero(whole)] if whole.any() else [], []
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                leaves.append(at)
                continue
            x = max((s[at] for s in scaled), key=np.ptp)
            cut = np.argpartition(x, len(at) // 2)
            todo += [at[cut[: len(at) // 2]], at[cut[len(at) // 2 :]]]
        self.firm, loose = len(leaves), np.flatnonzero(~whole)
        leaves += [loose[i : i + LEAF] for i in range(0, len(loose), LEAF)]
        self.at = np.full((len(leaves), LEAF), -1)
        for i, at in enumerate(leaves):
            self.at[i, : len(at)] = at
        self.n = (self.at >= 0).sum(axis=1)
        self.tile = np.zeros(len(whole), np.int64)
        self.tile[self.at[self.at >= 0]] = np.nonzero(self.at >= 0)[0]
        self.used, self.features, self.ys = used, features, [y[self.at] for y in ys]
        firm = self.at[: self.firm] >= 0
        self.low, self.high = ([f(np.where(firm, self.ys[k][: self.firm], end), axis=1, initial=end) for k in used] for f, end in ((np.min, np.inf), (np.max, -np.inf)))

    def sides(self, xs: list[np.ndarray], below: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, tiles): all of whose rows are nearer than `below`, and those that may hold rows from `below` to `above`."""
        near, far, weights = np.zeros((2, len(below), self.firm)), None, 0.0
        near, far = near
        for k, low, high in zip(self.used, self.low, self.high, strict=True):
            (scale, weight), x = self.features[k], xs[k][:, None]
            a, b = low[None, :] - x, x - high[None, :]
            for gap, into in ((np.maximum(np.maximum(a, b), 0.0), near), (np.minimum(a, b, out=a), far)):
                gap *= np.sqrt(weight) / scale
                gap *= gap
                into += gap
            weights += weight
        nearer = np.zeros((len(below), len(self.at)), bool)
        through = np.ones_like(nearer)
        if self.firm:
            # Wider by more than rounding can make of it: what is unsure is compared.
            nearer[:, : self.firm] = far / weights * 1e9 * (1 + 1e-9) + 2 < below[:, None]
            through[:, : self.firm] = ~nearer[:, : self.firm] & (near / weights * 1e9 * (1 - 1e-9) - 2 <= above[:, None])
        return nearer, through


    def apart(self, xs: list[np.ndarray], tiles: np.ndarray) -> np.ndarray:
        """What _apart gives, to the last bit, where all features used are there."""
        over, weights = 0.0, 0.0
        for k in self.used:
            scale, weight = self.features[k]
            d = xs[k] - self.ys[k][tiles]
            d /= scale
            d *= d
            d *= weight
            over, weights = over + d, weights + weight
        over /= weights
        over *= 1e9
        over += 0.5
        return np.floor(over, out=over)


class Slice:
    """A slice's rows, with tiles for each set of features that queries have."""

    def __init__(self, ys: list[np.ndarray], ids: np.ndarray, features: list[tuple[float, float]], least_shared: int):
        self.ys, self.ids, self.features, self.least, self.tiles, self.parts, self.rows = ys, ids, features, least_shared, {}, {}, None

    def part(self, name: int, chosen: np.ndarray) -> Slice:
        """Some of the rows as a slice, with the places that they have here."""
        if name not in self.parts:
            rows = np.flatnonzero(chosen)
            self.parts[name] = Slice([y[rows] for y in self.ys], self.ids[rows], self.features, self.least)
            self.parts[name].rows = rows
        return self.parts[name]

    def alike(self, xs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, Tiles]]:
        """Queries that have the same features, a few at once, and the tiles for them."""
        has = np.stack([np.isfinite(x) for x in xs])
        code = (has * (1 << np.arange(len(xs)))[:, None]).sum(axis=0)
        for c in np.unique(code):
            used = [k for k in range(len(xs)) if c >> k & 1]
            if used and len(used) >= self.least and sum(self.features[k][1] for k in used) > 0:
                if c not in self.tiles:
                    self.tiles[c] = Tiles(self.ys, used, self.features)
                some = np.flatnonzero(code == c)
                for i in range(0, len(some), 256):
                    yield some[i : i + 256], self.tiles[c]

    def pairs(self, xs: list[np.ndarray], tiles: Tiles, through: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Query, tile, rows (-1: none) and distances (-1: not to be compared) of the tiles marked, some at once."""
        for firm in (True, False):
            a, b = np.nonzero(through[:, : tiles.firm] if firm else through[:, tiles.firm :])
            for i in range(0, len(a), PAIRS):
                q, t = a[i : i + PAIRS], b[i : i + PAIRS] + (0 if firm else tiles.firm)
                if firm:
                    d = tiles.apart([x[q, None] for x in xs], t)
                else:
                    d = _apart([x[q, None] for x in xs], [y[t] for y in tiles.ys], self.features, self.least)
                rows = tiles.at[t]
                yield q, t, rows, np.where(rows >= 0, d, -1.0)

    def counts(self, xs: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """By query: rows compared, rows nearer than low, and those from low to below high in CUTS parts."""
        out = np.zeros((len(low), 2 + CUTS), np.int64)
        for some, tiles in self.alike(xs):
            x, lo, hi = [v[some] for v in xs], low[some], high[some]
            nearer, through = tiles.sides(x, lo, hi)
            out[some, 0], out[some, 1] = tiles.n[: tiles.firm].sum(), nearer @ tiles.n
            for q, t, _, d in self.pairs(x, tiles, through):
                ok = d >= 0
                here = some[q[0] : q[-1] + 1]  # queries ascend
                if t[0] >= tiles.firm:
                    np.add.at(out[:, 0], some[q], ok.sum(axis=1))
                np.add.at(out[:, 1], some[q], (ok & (d < lo[q, None])).sum(axis=1))
                a, b = np.nonzero(ok & (d >= lo[q, None]) & (d < hi[q, None]))
                part = part_of(d[a, b], lo[q[a]], hi[q[a]])
                out[here, 2:] += np.bincount((q[a] - q[0]) * CUTS + part, minlength=len(here) * CUTS).reshape(-1, CUTS)
        return out

    def last(self, xs: list[np.ndarray], low: np.ndarray, high: np.ndarray, cut: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, distance and id of the rows in the part `cut` of low to high, of each query the first `left` of the slice."""
        found = []
        for some, tiles in self.alike(xs):
            x, lo, hi, c = [v[some] for v in xs], low[some], high[some], cut[some]
            width = (hi - lo) / CUTS
            _, through = tiles.sides(x, lo + width * c - 1e-9 * hi, lo + width * (c + 1) + 1e-9 * hi)
            for q, _, rows, d in self.pairs(x, tiles, through):
                a, b = np.nonzero((d >= lo[q, None]) & (d < hi[q, None]))
                own = part_of(d[a, b], lo[q[a]], hi[q[a]]) == c[q[a]]
                found.append((some[q[a[own]]], d[a[own], b[own]], self.ids[rows[a[own], b[own]]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        q, d, ids = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.lexsort((ids, d, q))
        q, d, ids = q[order], d[order], ids[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        keep = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q))) < left[q]
        return q[keep], d[keep], ids[keep]

    def near(self, xs: list[np.ndarray], limit: np.ndarray, last: np.ndarray, columns: np.ndarray, key: np.ndarray, w: np.ndarray, width: int, age: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows up to (limit, last) by query: sums of `columns`, then of w by key, and the least age."""
        n = columns.shape[1]
        out, least = np.zeros((len(limit), n + width)), np.full(len(limit), np.inf)
        for some, tiles in self.alike(xs):
            x, lim, end = [v[some] for v in xs], limit[some], last[some]
            held = np.zeros((len(tiles.at), n + width))
            for j in range(n):
                held[:, j] = np.bincount(tiles.tile, columns[:, j], len(held))
            held[:, n:] = np.bincount(tiles.tile * width + key, w, len(held) * width).reshape(-1, width)
            young = np.full(len(held), np.inf)
            np.minimum.at(young, tiles.tile, age)
            nearer, through = tiles.sides(x, lim, lim)
            out[some] = nearer.astype(float) @ held
            least[some] = np.where(nearer, young[None, :], np.inf).min(axis=1, initial=np.inf)
            for q, _, rows, d in self.pairs(x, tiles, through):
                a, b = np.nonzero((d >= 0) & ((d < lim[q, None]) | ((d == lim[q, None]) & (self.ids[rows] <= end[q, None]))))
                if len(a):
                    who, row, here = q[a] - q[0], rows[a, b], some[q[0] : q[-1] + 1]  # queries ascend
                    for j in range(n):
                        out[here, j] += np.bincount(who, columns[row, j], len(here))
                    out[here, n:] += np.bincount(who * width + key[row], w[row], len(here) * width).reshape(-1, width)
                    np.minimum.at(least, some[q[a]], age[row])
        return out, least


def fine_bins(r: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which of CUTS * CUTS parts of the sorted marks a return lies in, ascending."""
    return np.searchsorted(marks, r, side="left") * (CUTS * CUTS - 1) // max(1, len(marks))


def _units(t: DataFrame, q: DataFrame, block: str, features: dict[str, tuple[float, float]], run, schema) -> DataFrame:
    spark = t.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, min(4 * t.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return t.repartition(tasks).join(broadcast_if_small(q, QUERIES * 8 * (len(features) + 8)), block).drop(block).mapInPandas(run, schema)


def compared(t: DataFrame, q: DataFrame, block: str, features: dict[str, tuple[float, float]], least_shared: int, kind: DataType, step: str, marks: np.ndarray | None = None) -> DataFrame:
    """Packed rows and packed queries of the same block -> by step:

      bins    query_id, bin, n of all pairs; every pair is compared
      counts  unit, ids, m: a matrix for some queries and a slice, see Slice.counts; q has the bins low and high that it goes from and to
      last    query_id, distance, train_id, see Slice.last; q has low, high, cut and left
      sums    unit, ids, m: least age, sums and weights by coarse bin of returns of the rows up to (limit, last)
      finer   unit, ids, m: before, goal and weights by finer bin of the returns in the coarse bin `own`
      lows    query_id, r, w: weights by return of those in the finest bin `own`
    """
    long, double = LongType(), DoubleType()
    matrix = StructType([StructField("unit", kind), StructField("ids", ArrayType(kind)), StructField("m", BinaryType())])
    rows = {"bins": (("bin", long), ("n", long)), "last": (("distance", double), ("train_id", long)), "lows": (("r", double), ("w", double))}
    schema = matrix if step in ("counts", "sums", "finer") else StructType([StructField("query_id", kind)] + [StructField(*c) for c in rows[step]])
    fs, kept = list(features.values()), []

    def slice_of(row: dict) -> Slice:
        """The row's slice; tiles are made once for neighbouring units of a slice."""
        ids = np.asarray(row["t_train_id"])
        if not (kept and np.array_equal(kept[0].ids, ids)):
            kept[:] = [Slice([np.asarray(row[f"t_{f}"], float) for f in features], ids, fs, least_shared)]
        return kept[0]

    def unit(row: dict) -> Iterator[pd.DataFrame]:
        every, qs = np.asarray(row["q_query_id"]), [np.asarray(row[f"q_{f}"], float) for f in features]
        if step == "bins":
            ts = [np.asarray(row[f"t_{f}"], float) for f in features]
            for i in range(0, len(every), TILE):
                key = bin_of(distances([x[i : i + TILE] for x in qs], ts, fs, least_shared))
                yield _counted(every[i : i + TILE], np.where(key == NONE, -1, key), NONE)
            return
        s = slice_of(row)
        if step in ("sums", "finer", "lows"):
            r, w, dd, age = (np.asarray(row[f"t_{c}"], float) for c in ("r", "w", "dd", "age"))
            fine = fine_bins(r, marks)
        for i in range(0, len(every), TOGETHER):
            m = slice(i, i + TOGETHER)
            xs, ids, of = [x[m] for x in qs], every[m], {c: np.asarray(row[f"q_{c}"])[m] for c in ("low", "high", "cut", "left", "limit", "last", "own", "before", "goal") if f"q_{c}" in row}
            low, high = (ends_of(of[c].astype(np.int64))[k] if c in of else None for k, c in enumerate(("low", "high")))
            whole = {"unit": [ids[0]], "ids": [ids]}
            if step == "counts":
                yield pd.DataFrame({**whole, "m": [s.counts(xs, low, high).tobytes()]})
            elif step == "last":
                at, d, train = s.last(xs, low, high, of["cut"], of["left"])
                yield pd.DataFrame({"query_id": ids[at], "distance": d, "train_id": train})
            elif step == "sums":
                columns = np.stack([np.ones(len(r)), w, w * r, w * (r > 0), w * dd, w * r * r], axis=1)
                sums, least = s.near(xs, of["limit"], of["last"], columns, fine // CUTS, w, CUTS, age)
                yield pd.DataFrame({**whole, "m": [np.column_stack([least, sums]).tobytes()]})
            else:
                total = np.zeros((len(ids), CUTS))
                for own in np.unique(of["own"]):
                    mine, part = np.flatnonzero(of["own"] == own), s.part(own, fine // CUTS == own if step == "finer" else fine == own)
                    values, key = (None, fine[part.rows] % CUTS) if step == "finer" else np.unique(r[part.rows], return_inverse=True)
                    if len(key):
                        got, _ = part.near([x[mine] for x in xs], of["limit"][mine], of["last"][mine], np.zeros((len(key), 0)), key, w[part.rows], CUTS if values is None else len(values), age[part.rows])
                        if values is None:
                            total[mine] = got
                        else:
                            a, b = np.nonzero(got)
                            yield pd.DataFrame({"query_id": ids[mine[a]], "r": values[b], "w": got[a, b]})
                if step == "finer":
                    yield pd.DataFrame({**whole, "m": [np.column_stack([of["before"], of["goal"], total]).tobytes()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                for out in unit(row):
                    if len(out):
                        yield out

    return _units(t, q, block, features, run, schema)


def _total(rows: pd.DataFrame, kind: type) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(rows["ids"].iloc[0])
    out = np.zeros((len(ids), len(rows["m"].iloc[0]) // 8 // len(ids)), kind)
    for m in rows["m"]:
        out += np.frombuffer(m, kind).reshape(out.shape)
    return ids, out


def cut_by_counts(counts: DataFrame, kind: DataType, share: float, least: int) -> DataFrame:
    """The step counts -> query_id, cut, left, hit: the part that the share ends in and how many of its rows are wanted; hit false
    where it ends outside of the bracket. Queries with fewer than `least` rows to compare with have no row."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        ids, m = _total(rows, np.int64)
        wanted = np.maximum(least, np.floor(m[:, 0] * share)).astype(np.int64) - m[:, 1]
        upto = np.cumsum(m[:, 2:], axis=1)
        hit = (wanted > 0) & (wanted <= upto[:, -1])
        cut = np.where(hit, (upto < wanted[:, None]).sum(axis=1), 0)
        left = wanted - np.where(cut > 0, np.take_along_axis(upto, np.maximum(cut - 1, 0)[:, None], 1)[:, 0], 0)
        return pd.DataFrame({"query_id": ids, "cut": cut, "left": left, "hit": hit})[m[:, 0] >= least]

    return counts.groupBy("unit").applyInPandas(one, StructType([StructField("query_id", kind), *StructType.fromDDL("cut long, left long, hit boolean").fields]))


def _tenth(by_bin: np.ndarray, before: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first bin that reaches the goal, the last with a weight if rounding lets none, and the weight before it."""
    upto = before[:, None] + np.cumsum(by_bin, axis=1)
    there = (by_bin > 0) & (upto >= goal[:, None] * (1 - 1e-12))
    end = by_bin.shape[1] - 1 - np.argmax(by_bin[:, ::-1] > 0, axis=1)
    at = np.where(there.any(axis=1), np.argmax(there, axis=1), end)
    return at, np.take_along_axis(upto, at[:, None], 1)[:, 0] - np.take_along_axis(by_bin, at[:, None], 1)[:, 0]


def summed(sums: DataFrame, kind: DataType) -> DataFrame:
    """The step sums -> query_id, age, peers, w, wr, wwin, wdd, wrr, goal (a tenth of w), own (coarse bin that it lies in), before."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        ids, m = _total(rows, float)
        age = np.min([np.frombuffer(x, float).reshape(m.shape)[:, 0] for x in rows["m"]], axis=0)
        by_bin, goal = m[:, 1 + SUMS :], m[:, 1 + SUMS :].sum(axis=1) * 0.10
        own, before = _tenth(by_bin, np.zeros(len(ids)), goal)
        out = pd.DataFrame({"query_id": ids, "age": age, **dict(zip(("peers", "w", "wr", "wwin", "wdd", "wrr"), m[:, 1 : 1 + SUMS].T, strict=True)), "goal": goal, "own": own, "before": before})[m[:, 1] > 0]
        return out.astype({"age": np.int64, "peers": np.int64})

    return sums.groupBy("unit").applyInPandas(one, StructType([StructField("query_id", kind), *StructType.fromDDL("age long, peers long, w double, wr double, wwin double, wdd double, wrr double, goal double, own long, before double").fields]))


def narrowed(finer: DataFrame, kind: DataType) -> DataFrame:
    """The step finer -> query_id, fine, before: the finer bin, within the coarse one, that the goal lies in, and the weight before it."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        ids, m = _total(rows, float)
        before, goal = np.frombuffer(rows["m"].iloc[0], float).reshape(m.shape)[:, :2].T
        fine, upto = _tenth(m[:, 2:], before, goal)
        return pd.DataFrame({"query_id": ids, "fine": fine, "before": upto})

    return finer.groupBy("unit").applyInPandas(one, StructType([StructField("query_id", kind), *StructType.fromDDL("fine long, before double").fields]))

"""Sparse suffix-array deduplication: passages that repeat across documents.

Suffixes are kept only at content-selected positions: the minimiser (least k-gram hash) of every window of `window`
k-grams. Equal passages select equal positions, so a passage of at least `least_words` words has in all its copies a
common position in its first `window` words, with `least_words - window + 1` words or more to its right.

Shape of the job: (1) One pass gives every kept suffix three hashes: of the words that it surely shares (its key), of the
`least_words` from it on, and of as many that begin `window - 1` before it. Equal texts are one document, folded within
the tasks. (2) Only keys that occur in two texts go on; a long hash that occurs in two texts is a repeated passage by
itself. A suffix with both in the middle of a repetition: it needs no more, and such are most of what copies bring; of those
with equal contexts two of different texts go on, as partners of others. (3) With the others they are the sparse suffix array. Their words on either side are read, and they are sorted over the whole cluster by
range, on key, right context, left context reversed and identity, and once more with the left context before the right,
which brings the longest matches to the left together. In both orders each suffix is compared with its nearest neighbours
of other texts, and the match is extended left and right. Identity in the order means that even a passage of a third of
all documents is spread over many tasks. What lies at the borders of partitions, the first and last run of one text and
the row beside it, is a shorter suffix array of the same kind: it is sorted and compared again, until it fits one task.
(4) The nearest neighbours tell how far any match of a suffix can reach to the right and to the left. A passage within this
reach that no neighbour has shown would be shared with a partner that is nearest in neither order: such passages, few as
they are, are hashed, and looked up among the suffixes of the same key. (5) Passages of at least least_words merge into spans for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, WordHashes, broadcast_if_small, materialize, mix, words

LEAST_WORDS = 50
WINDOW = 25
GRAM = 8
ROWS = 100_000  # of sorted suffixes in a task
_FOLDED = 100_000  # texts that a task remembers so as not to go through an equal one again
_ODD = 0x9E3779B97F4A7C15


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as they are asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.concatenate([np.ones(1, U64), np.cumprod(np.full(2 * n, x, U64))]) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


class Runs:
    """Hashes of runs of words, of any length, from one running sum."""

    def __init__(self, h: np.ndarray, powers: Powers):
        self.up, down = powers.to(len(h) + 1)
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(h * down[: len(h)], dtype=U64)])

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[at + length] - self.sums[at]) * self.up[at] + U64(length))


def minimisers(runs: Runs, n: int, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Of n words: positions of the least k-gram hash (the first, if equal) of every window of `window` k-grams."""
    if n < gram:
        return np.zeros(0, np.int64)
    least = runs.of(np.arange(n - gram + 1), gram)
    at, width = np.arange(len(least)), 1
    if len(least) <= window:
        return np.array([int(least.argmin())])
    while width < window:  # the least of windows twice as wide, or as wide as asked for
        step = min(width, window - width)
        lower = least[step:] < least[:-step]
        least, at, width = np.where(lower, least[step:], least[:-step]), np.where(lower, at[step:], at[:-step]), width + step
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if (at[1:] >= at[:-1]).all() else np.unique(at)


def _anchors(least: int, window: int, gram: int):
    front = window - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, powers, seen = WordHashes(), Powers(), {}
        for b in batches:
            out = []
            for doc, cid, text in zip(b["doc_id"], b["cid"], b["text"], strict=True):
                if cid not in seen:
                    if len(seen) >= _FOLDED:
                        seen.clear()
                    h = known.of(words(text))
                    seen[cid] = n = len(h)
                    runs = Runs(h, powers)
                    p = minimisers(runs, n, window, gram)
                    p = p[p + least - front <= n]
                    # Where a window of least words does not fit, a hash that nothing else has.
                    none = mix(p.astype(U64) * U64(_ODD) ^ np.int64(cid).view(U64))
                    right, left = none.copy(), mix(none)
                    ok = p + least <= n
                    right[ok] = runs.of(p[ok], least)
                    ok = p >= front
                    left[ok] = runs.of(p[ok] - front, least)
                    out.append((np.full(len(p), cid), np.full(len(p), doc), p, runs.of(p, least - front), right, left))
                out.append(([cid], [doc], [-1], np.array([seen[cid]], U64), np.zeros(1, U64), np.zeros(1, U64)))
            cid, doc, pos, *hashes = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pd.DataFrame({"cid": cid, "doc_id": doc, "pos": pos} | {k: x.view(np.int64) for k, x in zip(("key", "right", "left"), hashes, strict=True)})

    return run


def _contexts(least: int, window: int):
    front = window - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            out, held = [], 0
            for cid, doc, text, at, keys in zip(b["cid"], b["doc_id"], b["text"], b["positions"], b["keys"], strict=True):
                h = (known.of(words(text)) >> U64(32)).astype(">u4")
                at = np.asarray(at, np.int64)
                n = len(h)
                line = np.concatenate([np.zeros(front, ">u4"), h, np.zeros(front, ">u4")])
                right = line[front + at[:, None] + (least - front) + np.arange(front)]
                left = line[front + at[:, None] - 1 - np.arange(front)]
                out.append(pd.DataFrame({"cid": cid, "doc_id": doc, "pos": at, "key": keys, "right": [r.tobytes() for r in right], "left": [x.tobytes() for x in left], "n_right": np.minimum(least, n - at), "n_left": np.minimum(front, at)}))
                held += len(at)
                if held > 20_000:
                    yield pd.concat(out)
                    out, held = [], 0
            if out:
                yield pd.concat(out)

    return run


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the rows of a and b."""
    same = a == b
    return np.where(same.all(axis=1), a.shape[1], (~same).argmax(axis=1)) if a.shape[1] else np.zeros(len(a), np.int64)


def _run_starts(cid: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where runs of rows of one text and key begin."""
    return np.flatnonzero(np.concatenate([[True], (cid[1:] != cid[:-1]) | (key[1:] != key[:-1])]))


def compare(g: pd.DataFrame, least: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows sorted as suffixes -> cid, doc_id, start, stop of the matches with each row's nearest neighbours of other texts; and
    cid, pos, reach_right, reach_left, shown: how far these agree with the row, and as bits of a number which passages of
    `least` words are among the matches (bit x: the one that begins x words before the row)."""
    cid, doc, pos, key = (g[c].to_numpy(np.int64) for c in ("cid", "doc_id", "pos", "key"))
    right = np.frombuffer(b"".join(g["right"]), np.uint32).reshape(len(g), -1)
    left = np.frombuffer(b"".join(g["left"]), np.uint32).reshape(len(g), -1)
    nr, nl = g["n_right"].to_numpy(np.int64), g["n_left"].to_numpy(np.int64)
    sure = least - right.shape[1]  # words to the right that an equal key stands for
    new = _run_starts(cid, key)
    run = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(cid))))
    before, after = new[run] - 1, np.append(new, len(cid))[run + 1]
    out, front = [], right.shape[1]
    reach, shown = np.zeros((len(g), 2), np.int64), np.zeros(len(g), np.int64)
    for other in (before, after):
        i = np.flatnonzero((other >= 0) & (other < len(cid)))
        i = i[(key[i] == key[other[i]]) & (cid[i] != cid[other[i]])]
        j = other[i]
        r = np.minimum(sure + _common(right[i], right[j]), np.minimum(nr[i], nr[j]))
        x = np.minimum(_common(left[i], left[j]), np.minimum(nl[i], nl[j]))
        reach[i] = np.maximum(reach[i], np.stack([r, x], axis=1))
        ok = r + x >= least
        i, r, x = i[ok], r[ok], x[ok]
        shown[i] |= (np.int64(1) << (np.minimum(x, front) + 1)) - (np.int64(1) << np.maximum(least - r, 0))
        out.append(pd.DataFrame({"cid": cid[i], "doc_id": doc[i], "start": pos[i] - x, "stop": pos[i] + r}))
    some = np.flatnonzero(reach[:, 0])
    return pd.concat(out).drop_duplicates(), pd.DataFrame({"cid": cid[some], "pos": pos[some], "reach_right": reach[some, 0], "reach_left": reach[some, 1], "shown": shown[some]})


def borders(g: pd.DataFrame) -> pd.DataFrame:
    """Of rows sorted as suffixes, those whose nearest neighbours may lie in another partition, and those that may be such
    neighbours: the first and last run of one text and key, each with the row on its inner side."""
    new = _run_starts(g["cid"].to_numpy(), g["key"].to_numpy())
    if len(new) < 3:
        return g
    return g.iloc[np.unique(np.concatenate([np.arange(new[1] + 1), np.arange(new[-1] - 1, len(g))]))]


_SUFFIX = "cid long, doc_id long, pos long, key long, right binary, left binary, n_right int, n_left int"
_NAMES = [x.split()[0] for x in _SUFFIX.split(", ")]
_REACH = ["reach_right", "reach_left", "shown"]


def _neighbours(least: int, last: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if rows:
            g = pd.concat(rows, ignore_index=True)
            columns = ["start", "stop", *_REACH, *_NAMES]
            for x in compare(g, least):
                yield x.reindex(columns=columns)
            if not last:
                yield borders(g).reindex(columns=columns)

    return run


def _matches(suffixes: DataFrame, n: int, least: int, by: list[str], name: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """suffixes, n of them, sorted and compared; their borders too, level by level. -> cid, doc_id, start, stop; and what the
    neighbours show, cid, pos, reach_right, reach_left, shown, a row for each suffix and level."""
    parts, hits, reach, level = max(int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows)), None, None, 0
    while True:
        last = parts == 1 or not n
        dealt = suffixes.coalesce(1) if last else suffixes.repartitionByRange(parts, *by)
        found = materialize(dealt.sortWithinPartitions(*by).mapInPandas(_neighbours(least, last), f"start long, stop long, reach_right long, reach_left long, shown long, {_SUFFIX}"), f"{name}-{level}")
        got = found.where("start is not null").select("cid", "doc_id", "start", "stop")
        hits = got if hits is None else hits.unionByName(got)
        got = found.where("reach_right is not null").select("cid", "pos", *_REACH)
        reach = got if reach is None else reach.unionByName(got)
        if last:
            return hits, reach
        suffixes, before = found.where("start is null and reach_right is null").select(*_NAMES), n
        n, level = suffixes.count(), level + 1
        # Borders are a few rows for each partition; where they do not shrink, runs of one text fill whole partitions.
        parts = 1 if 2 * n > before else -(-n // rows)


def _windows(least: int):
    """Suffixes with `wanted` and `gap` (bits of passages) -> a hash of each passage wanted, its text and place, and whether it is a gap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cid, doc, pos, key, right, left, nr, nl, wanted, gap in zip(*(b[c] for c in [*_NAMES, "wanted", "gap"]), strict=True):
                front = len(right) // 4
                for x in range(front + 1):
                    if wanted >> x & 1 and nl >= x and nr >= least - x:
                        h = xxhash.xxh64_intdigest(b"%d %d " % (key, x) + left[: 4 * x] + right[: 4 * (front - x)])
                        out.append((h - (1 << 64) if h >> 63 else h, cid, doc, pos - x, bool(gap >> x & 1)))
            yield pd.DataFrame(out, columns=["h", "cid", "doc_id", "start", "gap"])

    return run


def _between(array: DataFrame, reach: DataFrame, least: int, front: int) -> DataFrame:
    """Passages that are within a suffix's reach on both sides but not shown by a neighbour, and stand in another text: cid, doc_id,
    start, stop. Such a passage is told by key, place and the words on either side of the suffix, so no text is read again."""
    best = reach.groupBy("cid", "pos").agg(F.max("reach_right").alias("r"), F.max("reach_left").alias("x"), F.bit_or("shown").alias("shown"))
    low, high = F.greatest(F.lit(0), least - F.col("r")), F.least(F.lit(front), F.col("x"))
    best = best.withColumn("low", low.cast("int")).withColumn("high", high.cast("int")).where("low <= high")
    gaps = best.select("cid", "pos", F.expr("(shiftleft(1L, high + 1) - shiftleft(1L, low)) & ~shown").alias("gap")).where("gap <> 0")
    gaps = materialize(gaps.join(array.select("cid", "pos", "key"), ["cid", "pos"]), "suffix-gaps")
    keys = broadcast_if_small(materialize(gaps.groupBy("key").agg(F.bit_or("gap").alias("wanted")), "suffix-gap-keys"), 24)
    rows = array.join(keys, "key").join(broadcast_if_small(gaps.select("cid", "pos", "gap"), 32), ["cid", "pos"], "left")
    rows = rows.select(*_NAMES, "wanted", F.coalesce("gap", F.lit(0)).alias("gap"))
    found = materialize(rows.mapInPandas(_windows(least), "h long, cid long, doc_id long, start long, gap boolean"), "suffix-windows")
    both = materialize(found.groupBy("h").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("h"), "suffix-windows-twice")
    return found.where("gap").join(broadcast_if_small(both, 16), "h").select("cid", "doc_id", "start", (F.col("start") + least).alias("stop"))


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, window: int = WINDOW, gram: int = GRAM, rows: int = ROWS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, start_word, end_word (exclusive), n_words: the spans of at least least_words words that
    also stand in another document.

    Words are runs of bytes other than 20 and 09-0D, A-Z lower-cased. Null texts, short texts and rows without doc_id have no
    span. Equal rows are one document. Rows that repeat a doc_id with different texts are different documents: each has its
    own spans, in its own words. Texts are told apart by a 64-bit hash. Every passage of least_words words that two texts
    share is in a span, and nothing else. Empty docs give an empty result; other columns are not looked at. rows: of a task,
    in sorting; it changes no result. window is 62 at most.
    """
    front = window - 1
    if window > 62:
        raise ValueError("window must be 62 at most")
    if least_words - front < gram:
        raise ValueError("least_words must be at least window + gram - 1")
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("cid"), "text")
    anchors = materialize(own.mapInPandas(_anchors(least_words, window, gram), "cid long, doc_id long, pos long, key long, right long, left long"), "suffix-anchors")

    # Texts of two documents or more are repeated as wholes.
    texts, suffixes = anchors.where("pos < 0").select("cid", "doc_id", F.col("key").alias("n")), anchors.where("pos >= 0")
    copied = texts.groupBy("cid").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("cid")
    copied = broadcast_if_small(materialize(copied, "suffix-copied"), 16)
    wholes = texts.where(F.col("n") >= least_words).join(copied, "cid").select("cid", "doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"))

    def in_two_texts(hashes: DataFrame, name: str) -> DataFrame:
        """Written first: a join right above an aggregation has no shuffle of its own that Spark could split at a hot key."""
        return materialize(hashes.groupBy("h").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("h"), name)

    shared = in_two_texts(suffixes.select(F.col("key").alias("h"), "cid"), "suffix-shared")
    kept = materialize(suffixes.join(broadcast_if_small(shared.withColumnRenamed("h", "key"), 24), "key"), "suffix-kept")
    twice = in_two_texts(kept.select("cid", F.explode(F.array("right", "left")).alias("h")), "suffix-twice")
    size = twice.count()
    for side in ("right", "left"):
        kept = kept.join(broadcast_if_small(twice.select(F.col("h").alias(side), F.lit(True).alias(f"has_{side}")), 24, size), side, "left")
    kept = materialize(kept.select("cid", "doc_id", "pos", "key", "right", "left", *[F.coalesce(f"has_{s}", F.lit(False)).alias(f"has_{s}") for s in ("right", "left")]), "suffix-sides")
    hits = kept.where("has_right").select("cid", "doc_id", F.col("pos").alias("start"), (F.col("pos") + least_words).alias("stop"))
    hits = hits.unionByName(kept.where("has_left").select("cid", "doc_id", (F.col("pos") - front).alias("start"), (F.col("pos") - front + least_words).alias("stop")))

    # The suffix array: what is not known to be inside a repetition on both sides, and for each pair of contexts of what is, two
    # suffixes of different texts, so that those at the ends of shorter matches meet them. One row of each text reads its words again.
    me = F.struct("cid", "doc_id", "pos", "key")
    inside = kept.where("has_right and has_left").groupBy("key", "right", "left").agg(F.min(me).alias("a"), F.max(me).alias("b"))
    inside = inside.select(F.explode(F.array("a", "b")).alias("s")).select("s.cid", "s.doc_id", "s.pos", "s.key")
    at = kept.where("not (has_right and has_left)").select("cid", "doc_id", "pos", "key").unionByName(inside).groupBy("cid").agg(F.min("doc_id").alias("doc"), F.sort_array(F.collect_set(F.struct("pos", "key"))).alias("at"))
    at = materialize(at.select(F.col("cid").alias("_cid"), "doc", F.col("at.pos").alias("positions"), F.col("at.key").alias("keys")), "suffix-positions")
    size = at.agg(F.sum(F.size("keys")).alias("n"), F.count("*").alias("docs")).first()
    n = size["n"] or 0
    again = own.join(broadcast_if_small(at, 1, 16 * n + 64 * size["docs"]), (F.col("doc_id") == F.col("doc")) & (F.col("cid") == F.col("_cid")))
    array = materialize(again.select("cid", "doc_id", "text", "positions", "keys").mapInPandas(_contexts(least_words, window), _SUFFIX), "suffix-array")
    reach = None
    for first, second in (("right", "left"), ("left", "right")):
        got, seen = _matches(array, n, least_words, ["key", first, second, "cid", "pos"], f"suffix-{first}", rows)
        hits, reach = hits.unionByName(got), seen if reach is None else reach.unionByName(seen)
    hits = hits.unionByName(_between(array, reach, least_words, front))

    hits = hits.distinct().join(copied, "cid", "left_anti").unionByName(wholes.distinct())
    w = Window.partitionBy("cid", "doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > F.col("reach"), 1).otherwise(0)).over(w)
    spans = hits.withColumn("reach", reach).withColumn("island", island).groupBy("cid", "doc_id", "island").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"))
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))

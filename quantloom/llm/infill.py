"""Fill-in-middle transformation with a piecewise-linear learned rank index.

A map over Arrow batches, without a shuffle. The line boundaries of all texts of a block, laid end to end, are one rising
sequence of offsets. Greedy segments are fitted to it, each as long as one line stays within a stated error of every
offset; what the segments predict less than the true offset is stored as a small residual. A cut at any rank is then the
prediction plus the residual, and exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ERROR = 64  # no offset lies further from its segment's line
BLOCK_BYTES = 1 << 22  # texts that share one index
_LOOK = 1 << 14  # offsets tried at once when a segment is fitted


class RankIndex:
    """rank -> offset for a strictly rising sequence of offsets: segments (first rank, its offset, slope) and residuals."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        first, slope, at, n = [], [], 0, len(offsets)
        look = 64
        while at < n:
            low, high, end, best = 0.0, np.inf, at + 1, 0.0
            while end < n:  # the cone of slopes through (at, offsets[at]) that stay within the error narrows from rank to rank
                stop = min(n, end + look)
                run = np.arange(end - at, stop - at, dtype=np.float64)
                rise = (offsets[end:stop] - offsets[at]).astype(np.float64)
                lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
                highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
                fits = int(np.searchsorted(lows > highs, True))
                if fits:
                    low, high = lows[fits - 1], highs[fits - 1]
                    best, end = (low + high) / 2, end + fits
                if fits < len(run):
                    look = 64
                    break
                look = min(2 * look, _LOOK)
            first.append(at)
            slope.append(best)
            at = end
        self.first, self.slope = np.array(first, np.int64), np.array(slope, np.float64)
        self.base = offsets[self.first] if n else np.empty(0, np.int64)
        self.residual = np.empty(0, np.int64)
        rest = offsets - self.predict(np.arange(n))
        kind = np.int16 if error < 1 << 14 else np.int64
        if n and np.abs(rest).max() > error + 1:
            raise AssertionError("a segment left its error bound")
        self.residual = rest.astype(kind)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, ranks, side="right") - 1
        return self.base[s] + np.rint(self.slope[s] * (ranks - self.first[s])).astype(np.int64)

    def cut(self, ranks: np.ndarray) -> np.ndarray:
        return self.predict(ranks) + self.residual[ranks]


def line_ends(raw: np.ndarray) -> np.ndarray:
    """Byte offsets of a text's boundaries: 0, after every newline, and the end of a last line without one."""
    ends = np.flatnonzero(raw == 10) + 1
    last = [len(raw)] if len(raw) and (not len(ends) or ends[-1] != len(raw)) else []
    return np.concatenate([[0], ends, last]).astype(np.int64)


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the hex SHA-256 of seed:doc_id (no digits for a null id), as integers."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4]) for i in (0, 4, 8, 12))


def _characters(raw: bytes) -> int:
    """Code points of UTF-8."""
    return len(raw.decode("utf-8", "surrogatepass"))


def transform_block(ids: list[int | None], texts: list[bytes], seed: int, rate: int, spm_share: int, error: int) -> dict[str, list]:
    """Columns n, form, prefix_chars, middle_chars, output of a block of texts, whose boundaries share one index."""
    out = {k: [] for k in ("n", "form", "prefix_chars", "middle_chars", "output")}
    bounds = [line_ends(np.frombuffer(t, np.uint8)) for t in texts]
    start = np.cumsum([0, *(len(t) + 1 for t in texts)])  # one byte between texts keeps the sequence rising
    rank = np.cumsum([0, *map(len, bounds)])
    index = RankIndex(np.concatenate([b + s for b, s in zip(bounds, start)]) if bounds else np.empty(0, np.int64), error)
    drawn = [draws(seed, i) for i in ids]
    wanted = np.array([sorted(h % len(b) for h in d[:2]) for d, b in zip(drawn, bounds)], np.int64).reshape(-1, 2)
    cuts = index.cut(wanted + rank[:-1, None]) - start[:-1, None]
    marks = [m.encode() for m in SENTINELS]
    p, s, m = marks
    for t, b, (_, _, h3, h4), (i, j) in zip(texts, bounds, drawn, cuts.tolist()):
        out["n"].append(len(b) - 1)
        if not t or h3 % 100 >= rate or any(x in t for x in marks):
            for k, v in (("form", "plain"), ("prefix_chars", None), ("middle_chars", None), ("output", t)):
                out[k].append(v)
            continue
        spm = h4 % 100 < spm_share
        out["form"].append("spm" if spm else "psm")
        out["prefix_chars"].append(_characters(t[:i]))
        out["middle_chars"].append(_characters(t[i:j]))
        out["output"].append(s + t[j:] + p + t[:i] + m + t[i:j] if spm else p + t[:i] + s + t[j:] + m + t[i:j])
    return out


def blocks(sizes: list[int], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most this many bytes together (a longer text is a range of its own)."""
    at, held = 0, 0
    for k, n in enumerate(sizes):
        if k > at and held + n > most:
            yield at, k
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_share: int = 50, error: int = ERROR) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n, form, prefix_chars, middle_chars, output: one row for each row of docs.

    A text of n lines is cut at two of its n + 1 boundaries, drawn by the hash of seed and doc_id: prefix, middle, suffix.
    rate of 100 texts are reordered, spm_share of 100 of those suffix first. Empty and null texts (n = 0, output empty),
    texts not drawn and texts that hold a sentinel stay plain, with null lengths; so every output can be turned back by
    restored(). Lengths are in code points. A null doc_id draws as the empty string; rows that repeat a doc_id draw alike.
    Other columns of docs are not looked at; an empty table gives an empty result.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).cast(pa.binary())
            lengths = [len(x.as_buffer()) if x.is_valid else 0 for x in sizes]
            for i, j in blocks(lengths):
                ids = b.column(0).slice(i, j - i)
                texts = [x.as_py() or b"" for x in sizes.slice(i, j - i)]
                got = transform_block(ids.to_pylist(), texts, seed, rate, spm_share, error)
                cols = [pa.array(got[k], kind) for k, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([ids, *cols, pa.array(got["output"], pa.binary()).cast(pa.string())], ["doc_id", *kinds, "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A form's three sentinels stand in it once each, for plain texts alone hold others."""
    after_prefix, after_suffix, middle = F.substring_index(output, PREFIX, -1), F.substring_index(output, SUFFIX, -1), F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(after_prefix, SUFFIX, 1), middle, F.substring_index(after_suffix, MIDDLE, 1))
    spm = F.concat(F.substring_index(after_prefix, MIDDLE, 1), middle, F.substring_index(after_suffix, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

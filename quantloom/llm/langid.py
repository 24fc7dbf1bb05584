"""Language ID by segmentation-marginalised unigrams.

A text's probability under a language is the sum over all its segmentations into pieces of a fixed public vocabulary,
each segmentation being worth the product of its pieces' probabilities; a forward pass sums them. Pieces do not cross
white space (a word starts with the vocabulary's word mark), so the forward sums of the words multiply, and equal words of
a task share one pass. Characters outside the vocabulary are pieces of their own with a fixed small probability. Piece
probabilities of each language come from expectation-maximisation over the same sums, on a bounded sample of labelled
texts; predictions cover every text whole.

Words of up to SHORT characters go through the pass in plain numbers, many of one length at once; longer ones, of any
length, in logarithms, so that nothing underflows and no word is cut.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, reserved, text_key

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TRAIN_DOCS = 400  # labelled documents of each language that the model is fitted on, about
EM_ROUNDS = 3
SHORT = 24  # characters; at 1e-12 or more each, the product stays within a double
LEAST = 1e-12  # of a piece's probability
UNKNOWN = 1e-6  # probability of a character outside the vocabulary
MARK = "▁"
CACHE = 100_000  # words kept by a task
TOGETHER = 1_000_000  # characters of texts looked at together
AT_ONCE = 8_000  # short words in a lattice
LONG_AT_ONCE = 200_000  # characters of long words in a pass
_LETTER = regex.compile(r"\p{L}")


def load_vocabulary(path: str = VOCABULARY) -> dict[str, int]:
    """piece -> id: the ordinary pieces of a public sentencepiece model, lower-cased (byte and control pieces are left out)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = sorted({sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))} - {""})
    return {p: i for i, p in enumerate(pieces)}


def marked(text: str) -> list[str]:
    """The words of a text, with the mark that the vocabulary puts before a word."""
    return [MARK + w for w in text.lower().split()]


_BASE = np.uint64(0x9E3779B97F4A7C15)


class PieceIndex:
    """Pieces by length and 64-bit polynomial hash, to look up a place in many words at once."""

    def __init__(self, vocabulary: dict[str, int]):
        groups: dict[int, list[tuple[str, int]]] = {}
        for piece, i in vocabulary.items():
            groups.setdefault(len(piece), []).append((piece, i))
        self.size, self.tables = len(vocabulary), {}
        for n, g in sorted(groups.items()):
            h = prefix_hashes(letters([w for w, _ in g]))[:, n]
            order = np.argsort(h)
            self.tables[n] = (h[order], np.array([i for _, i in g], np.int64)[order])


def letters(ws: list[str]) -> np.ndarray:
    """Code points of equally long words, a row each."""
    return np.frombuffer("".join(ws).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(ws), -1).astype(np.uint64)


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + codes[:, j] + np.uint64(1)
    return out


class Lattice:
    """All pieces of equally long words: edges[i, j] = (words that have a piece from i to j, its id); unknown characters apart."""

    def __init__(self, ws: list[str], index: PieceIndex):
        self.n, self.words, self.edges, self.unknown = len(ws[0]), len(ws), {}, {}
        h = prefix_hashes(letters(ws)).T.copy()
        power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(self.n, _BASE))])
        for j in range(1, self.n + 1):
            for k, (keys, ids) in index.tables.items():
                if k > j:
                    break
                sub = h[j] - h[j - k] * power[k]
                at = np.minimum(np.searchsorted(keys, sub), len(keys) - 1)
                found = keys[at] == sub
                got = np.flatnonzero(found)
                if len(got):
                    self.edges[j - k, j] = (got, ids[at[got]])
                if k == 1:
                    self.unknown[j] = np.flatnonzero(~found)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """p: (pieces, languages). Sums over all segmentations of each prefix: (length + 1, words, languages)."""
        a = np.zeros((self.n + 1, self.words, p.shape[1]))
        a[0] = 1
        for j in range(1, self.n + 1):
            u = self.unknown.get(j, slice(None))
            a[j, u] += a[j - 1, u] * UNKNOWN
            for i in range(j):
                if (i, j) in self.edges:
                    got, ids = self.edges[i, j]
                    a[j, got] += a[i, got] * p[ids]
        return a

    def totals(self, p: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over all segmentations: (words, languages)."""
        return np.log(self.forward(p)[-1])

    def seen(self, count: np.ndarray, pieces: int) -> np.ndarray:
        """Occurrences of the pieces, whatever the segmentation."""
        out = np.zeros((pieces, count.shape[1]))
        for got, ids in self.edges.values():
            for k in range(count.shape[1]):
                out[:, k] += np.bincount(ids, count[got, k], pieces)
        return out

    def expected(self, p: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected piece counts, (pieces, languages); count: (words, languages)."""
        a = self.forward(p)
        b = np.zeros_like(a)
        b[self.n] = 1
        for j in range(self.n, 0, -1):
            u = self.unknown.get(j, slice(None))
            b[j - 1, u] += b[j, u] * UNKNOWN
            for i in range(j):
                if (i, j) in self.edges:
                    got, ids = self.edges[i, j]
                    b[i, got] += b[j, got] * p[ids]
        out, scale = np.zeros(p.shape), count / a[self.n]
        for (i, j), (got, ids) in self.edges.items():
            e = a[i, got] * p[ids] * b[j, got] * scale[got]
            for k in range(p.shape[1]):
                out[:, k] += np.bincount(ids, e[:, k], len(out))
        return out


class LongWords:
    """Words of any lengths, padded to the longest: ids[k - 1][w, j] is the piece of length k that ends at j of word w, or -1."""

    def __init__(self, ws: list[str], index: PieceIndex):
        self.sizes, self.n = np.array([len(w) for w in ws]), max(map(len, ws))
        h = prefix_hashes(letters([w.ljust(self.n, "\0") for w in ws]))
        most = min(self.n, max(index.tables))
        powers, self.ids = np.cumprod(np.full(most, _BASE)), []
        for k, power in enumerate(powers, 1):
            at = np.full((len(ws), self.n + 1), -1, np.int32)
            if k in index.tables:
                keys, ids = index.tables[k]
                sub = h[:, k:] - h[:, :-k] * power
                seat = np.minimum(np.searchsorted(keys, sub), len(keys) - 1)
                at[:, k:] = np.where(keys[seat] == sub, ids[seat], -1)
            self.ids.append(at)

    def _worth(self, p: np.ndarray) -> np.ndarray:
        """Log-probabilities by piece; the last two rows are an unknown character and no piece at all."""
        return np.vstack([np.log(p), np.full((1, p.shape[1]), np.log(UNKNOWN)), np.full((1, p.shape[1]), -np.inf)])

    def _steps(self, j: int, pieces: int) -> np.ndarray:
        """Rows of _worth for the pieces that end at j: (lengths, words)."""
        at = np.stack([x[:, j] for x in self.ids[:j]])
        out = np.where(at < 0, pieces + 1, at)
        out[0] = np.where(at[0] < 0, pieces, at[0])
        return out

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over all segmentations of each prefix: (length + 1, words, languages)."""
        worth = self._worth(p)
        a = np.full((self.n + 1, len(self.sizes), p.shape[1]), -np.inf)
        a[0] = 0
        for j in range(1, self.n + 1):
            rows = self._steps(j, len(p))
            a[j] = np.logaddexp.reduce(a[j - len(rows) : j][::-1] + worth[rows], axis=0)
        return a

    def totals(self, p: np.ndarray) -> np.ndarray:
        return self.forward(p)[self.sizes, np.arange(len(self.sizes))]

    def expected(self, p: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected piece counts, (pieces, languages); count: (words, languages)."""
        worth, a = self._worth(p), self.forward(p)
        total = a[self.sizes, np.arange(len(self.sizes))]
        b, out = np.full_like(a, -np.inf), np.zeros((len(worth), p.shape[1]))
        b[self.sizes, np.arange(len(self.sizes))] = 0
        for j in range(self.n, 0, -1):
            rows = self._steps(j, len(p))
            for k, r in enumerate(rows, 1):
                part = b[j] + worth[r]
                e = np.exp(a[j - k] + part - total) * count
                for x in range(p.shape[1]):
                    out[:, x] += np.bincount(r, e[:, x], len(out))
                b[j - k] = np.logaddexp(b[j - k], part)
        return out[: len(p)]

    def seen(self, count: np.ndarray, pieces: int) -> np.ndarray:
        """Occurrences of the pieces, whatever the segmentation."""
        out = np.zeros((pieces, count.shape[1]))
        for at in self.ids:
            w, j = np.nonzero((at >= 0) & (np.arange(self.n + 1) <= self.sizes[:, None]))
            for x in range(count.shape[1]):
                out[:, x] += np.bincount(at[w, j], count[w, x], pieces)
        return out


def grouped(ws) -> Iterator[list[str]]:
    """Short words by length; long ones in the order of their lengths, a bounded number of characters at once."""
    groups: dict[int, list[str]] = {}
    for w in ws:
        groups.setdefault(len(w), []).append(w)
    held: list[str] = []
    for n in sorted(groups):
        if n <= SHORT:
            yield from (groups[n][i : i + AT_ONCE] for i in range(0, len(groups[n]), AT_ONCE))
            continue
        for w in groups[n]:
            if held and (len(held) + 1) * n > LONG_AT_ONCE:
                yield held
                held = []
            held.append(w)
    if held:
        yield held


def lattice(ws: list[str], index: PieceIndex) -> Lattice | LongWords:
    return Lattice(ws, index) if len(ws[-1]) <= SHORT else LongWords(ws, index)


def fit(counts: dict[str, np.ndarray], vocabulary: dict[str, int], languages: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """counts: word -> count by language. Piece probabilities (pieces, languages)."""
    index = PieceIndex(vocabulary)
    groups = [(lattice(g, index), np.array([counts[w] for w in g], float)) for g in grouped(sorted(counts))]
    # Start: pieces as frequent as their occurrences, whatever the segmentation.
    p = _shares(sum((lat.seen(c, len(vocabulary)) for lat, c in groups), np.full((len(vocabulary), languages), 0.01)))
    for _ in range(rounds):
        p = _shares(sum((lat.expected(p, c) for lat, c in groups), np.full(p.shape, 0.01)))
    return p


def _shares(counts: np.ndarray) -> np.ndarray:
    return np.maximum(counts / counts.sum(axis=0), LEAST)


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, vocabulary_path: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """docs(doc_id, text, lang): the languages and their piece probabilities. docs holds what may be learned from."""
    known = docs.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((0, 0))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(train_docs / sizes[k]))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, g in b.groupby("lang"):
                c = Counter(w for t in g["text"] for w in marked(t))
                yield pd.DataFrame({"lang": lang, "word": list(c), "n": list(c.values())})

    rows = sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    at, counts = {k: i for i, k in enumerate(languages)}, {}
    for b in rows.to_batches(max_chunksize=10_000):  # as objects, all rows at once would be most of what the driver holds
        for lang, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            counts.setdefault(word, np.zeros(len(languages)))[at[lang]] += n
    return languages, fit(counts, load_vocabulary(vocabulary_path), len(languages))


def predict(docs: DataFrame, languages: list[str], p: np.ndarray, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score. score: the posterior under equal priors; ties to the smaller name.

    doc_id comes back as text, whatever its type: pandas would turn a batch of numbers with a null into doubles. A text that
    is null or has no letter (Unicode category L) is `und` with score 0, and so is every text if there is no language to
    predict. The vocabulary is read where this is called and sent along with the model.
    """
    model = docs.sparkSession.sparkContext.broadcast((load_vocabulary(vocabulary_path) if languages else {}, p.astype(np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, p = model.value
        index = PieceIndex(vocabulary) if languages else None
        row, table = {}, np.zeros((0, len(languages)))
        for b in batches:
            texts, names, scores, start = b["text"].tolist(), [], [], 0
            while start < len(texts):
                stop, held, parts = start, 0, []
                while stop < len(texts) and held < TOGETHER:
                    t = texts[stop]
                    parts.append(marked(t) if languages and isinstance(t, str) and _LETTER.search(t) else None)
                    held, stop = held + len(t or ""), stop + 1
                new = set().union(*[x for x in parts if x]) - row.keys()
                if len(row) + len(new) > CACHE:
                    row, table, new = {}, table[:0], set().union(*[x for x in parts if x])
                logs = [table]
                for g in grouped(new):
                    at = len(row)
                    row.update(zip(g, range(at, at + len(g)), strict=True))
                    logs.append(lattice(g, index).totals(p))
                table = np.concatenate(logs)
                for ws in parts:
                    if not ws:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    total = table[np.fromiter(map(row.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                    best = int(total.argmax())
                    names.append(languages[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
                start = stop
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": names, "score": scores})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, lang_pred string, score double")


def held_out() -> Column:
    """crc32 of doc_id as text, mod 5, is 0: never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, held_out, lang_pred, score: one row for each row of docs.

    Learned from the rows that are not held out (a null doc_id is not held out and not learned from); predicted from the
    text alone. Empty docs give an empty result; other columns are not looked at.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    languages, p = train(own.where(~held_out() & F.col("doc_id").isNotNull()), train_docs, vocabulary_path)
    return predict(own, languages, p, vocabulary_path).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score")


def accept_identified(docs: DataFrame, least_score: float = 0.5, train_docs: int = TRAIN_DOCS, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """docs whose language is identified with at least least_score; columns as given.

    The language is a matter of the text alone, so rows go by their text: those that repeat a doc_id are judged one by one,
    and those without doc_id stay if their text does. Null texts and texts without letters go. Empty docs stay empty.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    languages, p = train(own.where(~held_out() & F.col("doc_id").isNotNull()), train_docs, vocabulary_path)
    named = predict(own.select(text_key("text").alias("doc_id"), "text"), languages, p, vocabulary_path)
    key = reserved(docs, "bad")
    bad = materialize(named.where((F.col("lang_pred") == "und") | (F.col("score") < least_score)).select(F.col("doc_id").alias(key)).distinct(), "langid-rejected")
    return docs.join(broadcast_if_small(bad, 64), text_key("text") == F.col(key), "left_anti")

"""LM scoring by cross-entropy difference.

Two bigram models over the pieces of a fixed public vocabulary, one of a target corpus and one of the whole collection as
background, share that vocabulary, their smoothing and their list of bigrams: every pair of neighbouring pieces that the
collection holds. A text's score is the difference of its losses per piece, target minus background; low scores are like
the target. Nothing is cut from the models, so a text's score does not depend on how much else there is but by the counts.

A model is a distribution over the V pieces after every context v (a piece, or the start of a text):

    p(w | v) = (n(v w) + PRIOR p(w)) / (n(v) + PRIOR)        p(w) = (n(w) + ALPHA) / (n + ALPHA V)

The background holds every text and the target its own, so a text that is scored has been counted, once, by both or by one.

Shape of the job: (1) pairs are counted within the tasks, inside words by distinct word, then over the cluster, and
written: a table that grows with the collection, to V^2 rows at most. Words of the model, at most V + 1, are sums over it.
(2) The most frequent pairs, as many as HOT_PAIRS allows, go to the tasks as sorted arrays; texts are read again and
summed up there. (3) What a text has of any other pair leaves as rows (text, pair, n) and is joined with the rest of the
model. Where all pairs are hot there are no such rows and a text's row is final as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PRIOR = 50.0  # weight of the unigrams within a context, in pieces
ALPHA = 0.5  # added to every piece's count
HOT_PAIRS = 2_000_000  # pairs that are sent to the tasks, 24 bytes each
_KNOWN = 100_000  # words kept by a task
_HELD = 200_000  # words of texts looked at together


def load_model(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Pieces:
    """Words as runs of piece ids, each word split once: pairs inside a word are a matter of the word alone."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.split = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.split.get_piece_size()
        self.base = self.size + 1  # one more context: the start of a text
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.length = self.first = self.last = self.at = np.zeros(0, np.int64)
        self.inner = np.zeros(0, np.int64)  # pairs inside the words, word after word; word i's begin at at[i]

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        """The words of the texts as places in the arrays. Places hold until the next call."""
        new = set(chain.from_iterable(texts)) - self.index.keys()
        if len(self.index) + len(new) > _KNOWN:
            self.clear()
            new = set(chain.from_iterable(texts))
        if new:
            rows = [r or [self.split.unk_id()] for r in self.split.encode([w.decode("utf-8", "replace") for w in new])]
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            n = np.array([len(r) for r in rows])
            flat = np.fromiter(chain.from_iterable(rows), np.int64, n.sum())
            end = np.cumsum(n)
            within = np.ones(len(flat), bool)
            within[end - n] = False
            pairs = (np.concatenate([[0], flat[:-1]]) * self.base + flat)[within]
            for name, more in (("length", n), ("first", flat[end - n]), ("last", flat[end - 1]), ("at", len(self.inner) + np.cumsum(n - 1) - (n - 1)), ("inner", pairs)):
                setattr(self, name, np.concatenate([getattr(self, name), more]))
        return np.fromiter(map(self.index.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))

    def between(self, seq: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The pair that leads into each word: the last piece before it, or the start of its text, and its first piece."""
        before = np.concatenate([[0], self.last[seq[:-1]]])
        before[np.cumsum(sizes) - sizes] = self.size
        return before * self.base + self.first[seq]


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[list[bytes]]]]:
    """Rows in groups of about _HELD words, with their words."""
    for b in batches:
        start, held, texts = 0, 0, []
        for i, t in enumerate(b["text"], 1):
            texts.append(words(t))
            held += len(texts[-1])
            if held >= _HELD:
                yield b.iloc[start:i], texts
                start, held, texts = i, 0, []
        if texts:
            yield b.iloc[start:], texts


def _count(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(model.value)
        for b, texts in _together(batches):
            some = [i for i, t in enumerate(texts) if t]
            if not some:
                continue
            texts, target = [texts[i] for i in some], b["is_target"].to_numpy(bool)[some]
            sizes = np.array([len(t) for t in texts])
            seq = pieces.of(texts)
            mine = np.repeat(target, sizes).astype(float)
            every, good = np.bincount(seq, minlength=len(pieces.at)), np.bincount(seq, mine, len(pieces.at))
            inside = np.repeat(np.arange(len(pieces.at)), pieces.length - 1)
            gram, at = np.unique(np.concatenate([pieces.between(seq, sizes), pieces.inner]), return_inverse=True)
            n, n_target = (np.bincount(at, np.concatenate(x), len(gram)).astype(np.int64) for x in ((np.ones(len(seq)), every[inside]), (mine, good[inside])))
            got = n > 0
            yield pd.DataFrame({"gram": gram[got], "n_b": n[got], "n_t": n_target[got]})

    return run


def _score(model, hot):
    """Texts -> a row of (n_tokens, sums of the hot pairs' log-probabilities) and rows of (gram, n) for the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, (keys, worth, all_hot) = Pieces(model.value), hot.value

        def look(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(keys):
                return np.zeros((len(gram), 2)), np.zeros(len(gram), bool)
            at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            found = keys[at] == gram
            return np.where(found[:, None], worth[at], 0.0), found

        for b, texts in _together(batches):
            sizes = np.array([len(t) for t in texts])
            seq, of = pieces.of(texts), np.repeat(np.arange(len(texts)), sizes)
            lead = pieces.between(seq, sizes[sizes > 0]) if len(seq) else seq
            used = np.unique(seq)  # only the words of these texts are looked up inside
            n_in = pieces.length[used] - 1
            start = np.cumsum(n_in) - n_in
            inner = pieces.inner[np.repeat(pieces.at[used] - start, n_in) + np.arange(n_in.sum())]
            (w_lead, hot_lead), (w_in, hot_in) = look(lead), look(inner)
            owner = np.repeat(np.arange(len(used)), n_in)
            seat = np.searchsorted(used, seq)
            sums = [np.bincount(of, w_lead[:, s] + np.bincount(owner, w_in[:, s], len(used))[seat], len(texts)) for s in (0, 1)]
            n = np.bincount(of, pieces.length[seq], len(texts)).astype(np.int64)
            ids = b[["doc_id", "key"]].reset_index(drop=True)
            yield ids.assign(gram=-1, n=n, s_t=sums[0], s_b=sums[1])
            if not all_hot:
                cold = np.bincount(owner, ~hot_in, len(used)).astype(np.int64)
                occ = np.flatnonzero(cold[seat])  # words with a cold pair inside, each time that they stand
                inner, first = inner[~hot_in], np.cumsum(cold) - cold
                many = cold[seat[occ]]
                deep = inner[np.repeat(first[seat[occ]] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                gram = np.concatenate([lead[~hot_lead], deep])
                text = np.concatenate([of[~hot_lead], np.repeat(of[occ], many)])
                order = np.lexsort((gram, text))
                gram, text = gram[order], text[order]
                new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])])) if len(gram) else np.zeros(0, np.int64)
                if len(new):
                    yield ids.iloc[text[new]].assign(gram=gram[new], n=np.diff(np.append(new, len(gram))), s_t=0.0, s_b=0.0)

    return run


def pair_model(docs: DataFrame, model, size: int) -> DataFrame:
    """docs(text, is_target) -> gram, n_b, and the log-probabilities l_t, l_b of the pair's second piece after its first."""
    counted = docs.mapInPandas(_count(model), "gram long, n_b long, n_t long").groupBy("gram").agg(F.sum("n_b").alias("n_b"), F.sum("n_t").alias("n_t"))
    pairs = materialize(counted, "xent-pairs").withColumn("w1", (F.col("gram") / (size + 1)).cast("long")).withColumn("w2", F.col("gram") % (size + 1))
    total = pairs.agg(*[F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(s) for s in "bt"]).first()
    # At most a row for each piece of the vocabulary, and one for the start.
    sums = {w: F.broadcast(pairs.groupBy(w).agg(*[F.sum(f"n_{s}").alias(f"{w}_{s}") for s in "bt"])) for w in ("w1", "w2")}

    def worth(s: str) -> Column:
        p = (F.col(f"w2_{s}") + ALPHA) / (total[s] + ALPHA * size)
        return F.log((F.col(f"n_{s}") + PRIOR * p) / (F.col(f"w1_{s}") + PRIOR))

    return materialize(pairs.join(sums["w1"], "w1").join(sums["w2"], "w2").select("gram", "n_b", *[worth(s).alias(f"l_{s}") for s in "tb"]), "xent-model")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, hot_pairs: int = HOT_PAIRS, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, text), target_ids(doc_id) -> doc_id, n_tokens, loss_target, loss_background, score; a row for a row.

    Tokens are the vocabulary's pieces of the words, A-Z lower-cased. Losses are natural logarithms per token. Null texts
    and texts without words have 0 tokens and null losses. Without target documents the target model is uniform. Repeated
    ids in target_ids count once. Empty docs give an empty result. Other columns are not looked at. hot_pairs bounds what is
    broadcast and changes no score. Ids pass through pandas as text. The vocabulary is read where this is called and sent to the tasks.
    """
    spark = docs.sparkSession
    ids = materialize(target_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_target")).distinct(), "xent-target")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = own.join(broadcast_if_small(ids, 16), F.col("doc_id") == F.col("_target"), "left").select("text", F.col("_target").isNotNull().alias("is_target"))
    file = spark.sparkContext.broadcast(load_model(vocabulary_path))
    size = Pieces(file.value).size
    model = pair_model(marked, file, size)

    # Pairs by falling count, whole powers of two at once, as long as they stay within hot_pairs.
    tiers = model.groupBy(F.floor(F.log2("n_b")).alias("tier")).count().collect()
    least, left = 64, hot_pairs
    for tier, n in sorted(tiers, reverse=True):
        if n > left:
            break
        least, left = tier, left - n
    is_hot = F.floor(F.log2("n_b")) >= least
    hot = model.where(is_hot).select("gram", "l_t", "l_b").toPandas().sort_values("gram")
    all_hot = len(hot) == sum(n for _, n in tiers)
    sent = spark.sparkContext.broadcast((hot["gram"].to_numpy(np.int64), hot[["l_t", "l_b"]].to_numpy(float), all_hot))

    keyed = own.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    rows = keyed.mapInPandas(_score(file, sent), "doc_id string, key long, gram long, n long, s_t double, s_b double")
    if not all_hot:
        # A text's own row, with gram -1, finds nothing in the model; rows that are equal are summed and then dealt out again.
        cold = broadcast_if_small(model.where(~is_hot).select("gram", "l_t", "l_b"), 40)
        own_row = F.col("gram") == -1
        rows = rows.join(cold, "gram", "left").groupBy("doc_id", "key").agg(
            F.sum(own_row.cast("int")).alias("times"), F.max(F.when(own_row, F.col("n"))).alias("n"),
            *[F.sum(F.col(f"s_{s}") + F.coalesce(F.col("n") * F.col(f"l_{s}"), F.lit(0.0))).alias(f"s_{s}") for s in "tb"],
        ).select("doc_id", "n", *[(F.col(f"s_{s}") / F.col("times")).alias(f"s_{s}") for s in "tb"], F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    loss = {s: F.when(F.col("n") > 0, -F.col(f"s_{s}") / F.col("n")) for s in "tb"}
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n").alias("n_tokens"), loss["t"].alias("loss_target"), loss["b"].alias("loss_background"), (loss["t"] - loss["b"]).alias("score"))

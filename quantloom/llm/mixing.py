"""Soft-membership mixing of domains to target weights.

A softmax classifier on the words, word beginnings and shape of a text, fitted on a bounded sample of the labelled table,
predicts for every document its posteriors over the labelled domains. What a feature says does not depend on how long the
text around it is: features are present or not, and only those go in whose numbers differ between the domains of the sample
by more than chance does. Rates r >= 0, one for each document, are then fitted by least squares so that the expected tokens
of each domain, sum of r * tokens * posterior, meet target weights times the collection's tokens: minimise

    1/2 sum_i (tokens_i / N) (r_i - 1)^2  +  1/2 sum_d ((E_d(r) - T_d) / N)^2 / slack_d      over r >= 0

where slack_d goes with the square of the domain's share (at most MOST_SLACK), so that a rare domain counts by the part of it that is too
much or too little, as a common one does. Projected gradient on the rates: with u_d = (E_d - T_d) / N / slack_d, a step takes
every r_i to max(0, r_i - length * (r_i - 1 + p_i . u)). A rate is what the steps so far make of 1, so a step is its length
and one u for each domain, no rate is stored, and a task makes a document's rate anew from the list of steps. Lengths are
spectral (Barzilai and Borwein's), some multiples of it tried in the same job; an objective that rises above the last few
is not accepted. A round is one Spark job that adds up E and three squares over all documents; what goes through the
driver is a few numbers for each length. The slack is lowered, from where the rates are, until every domain is within
TOLERANCE of its target, relative to its share or target, whichever is larger. Where posteriors are soft on every document,
only rates of 0 nearly everywhere and of hundreds for a few would get there: the slack is lowered only while the mean square
of the rates stays below SPREAD times what the targets need with sure posteriors. What is then left is returned, flagged in
the rows and warned of.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, reserved

TRAIN_DOCS = 4000  # labelled documents that the classifier is fitted on, about
DOMAIN_DOCS = 200  # of each domain at least, about, or all that there are
LEAST_Z = 6.0  # of a feature's number in some domain of the sample, in standard deviations from what chance gives
LEAST_DOCS = 3  # that hold a feature
EPOCHS, RATE, DECAY = 200, 0.2, 1e-4
ROUNDS = 60
TOLERANCE = 0.02
SLACKS = (1.0, 0.1, 0.01, 1e-3, 1e-4)  # times the square of a domain's share
MOST_SLACK = 0.02  # of any domain
SPREAD = 2.0
MULTIPLES = (1.0, 0.3, 0.1, 0.03, 3.0, 10.0)  # of the spectral length, tried in one job
MEMORY, SETTLED = 6, 1e-5  # objectives that a new one is held against; relative change of the last four that ends a slack
TARGETS = {"clean": 0.90, "low": 0.10, "toxic": 0.0}
AROUND = b".,;:!?\"'()[]{}<>|*#$%&"  # set apart from a word
BEGINNINGS = (4, 6, 8)  # bytes


def word_features(word: bytes) -> list[int]:
    """Hashes of a word without what surrounds it, of its beginnings, and of what surrounds it."""
    core = word.strip(AROUND)
    out = [zlib.crc32(core)] if core else []
    out += [zlib.crc32(b"^" + core[:n]) for n in BEGINNINGS if len(core) > n]
    if len(core) < len(word):
        out.append(zlib.crc32(b"~" + word.replace(core, b"", 1)))
    return out


class WordFeatures(dict):
    """word -> its features; of those in `wanted` only, as their places there. Emptied when it grows past its bound."""

    BOUND = 100_000

    def __init__(self, wanted: dict[int, int] | None = None):
        self.wanted = wanted

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.BOUND:
            self.clear()
        f = word_features(word)
        out = self[word] = tuple(f if self.wanted is None else (self.wanted[x] for x in f if x in self.wanted))
        return out

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """The number of a text's words and its distinct features: those of its words, and in tenths the shares of its words
        that are new, in capitals, and the same as the one before."""
        raw = text.encode("utf-8", "surrogatepass").split() if text else []
        low = [w.lower() for w in raw]
        kinds = set(low)
        every = set(chain.from_iterable(map(self.__getitem__, kinds)))
        if raw:
            shape = zip((b"new", b"upper", b"again"), (len(kinds), sum(map(bytes.isupper, raw)), sum(map(eq, low, low[1:]))), strict=True)
            marks = [zlib.crc32(b"=%s%d" % (k, 10 * n // len(raw))) for k, n in shape]
            every.update(marks if self.wanted is None else (self.wanted[x] for x in marks if x in self.wanted))
        return len(raw), np.fromiter(every, np.int64, len(every))


def telling(rows: np.ndarray, features: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """Sorted hashes of the features whose number of documents differs between the classes by more than chance does."""
    every, held = np.zeros(0, features.dtype), []
    which = y.astype(np.int16)[rows]
    for c in range(classes):  # one class after the other, and no place for each occurrence: this runs on the driver
        own = features[which == c]
        own.sort()
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
        held.append((own[starts], np.diff(starts, append=len(own)).astype(np.int32)))
        every = np.union1d(every, held[-1][0])
    seen = np.zeros((len(every), classes), np.int32)
    for c, (kinds, number) in enumerate(held):
        seen[np.searchsorted(every, kinds), c] = number
    some = seen.sum(axis=1) >= LEAST_DOCS
    kinds, seen = every[some], seen[some].astype(float)
    n, share = seen.sum(axis=1, keepdims=True), np.bincount(y, minlength=classes) / len(y)
    z = (seen - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-12))
    return kinds[np.abs(z).max(axis=1, initial=0.0) >= LEAST_Z]


def fit_softmax(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_features: int, classes: int) -> np.ndarray:
    """Weights (features + 1, classes), the last row a bias, by gradient descent with steps that shrink by feature."""
    w = np.zeros((n_features + 1, classes))
    squares, truth, n = np.full_like(w, 1e-8), np.eye(classes)[y], len(y)
    for _ in range(EPOCHS):
        z = np.stack([np.bincount(rows, w[cols, c], n) for c in range(classes)], axis=1) + w[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        e = p / p.sum(axis=1, keepdims=True) - truth
        g = np.stack([np.bincount(cols, e[rows, c], n_features) for c in range(classes)], axis=1)
        g = np.vstack([g, e.sum(axis=0)]) / n + DECAY * w
        squares += g * g
        w -= RATE * g / np.sqrt(squares)
    return w


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """docs(doc_id, text), labels(doc_id, quality, toxic) -> domains, features and weights. Domains: toxic; else clean or low by
    quality. What reaches the driver are the distinct features of the sample's documents."""
    nothing = [], np.zeros(0, np.int64), np.zeros((1, 0))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), domain.alias("domain")).where("domain is not null").groupBy("_id").agg(F.min("domain").alias("domain"))
    known = materialize(known.join(docs.select(F.col("doc_id").alias("_id")), "_id", "left_semi"), "mixing-labels")
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    if not counts:
        return nothing
    drawn = {d: min(1.0, max(train_docs / sum(counts.values()), DOMAIN_DOCS / n)) for d, n in counts.items()}
    share = F.create_map(*[F.lit(x) for d, s in drawn.items() for x in (d, int(s * (1 << 30)))])[F.col("domain")]
    sample = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("text", "domain")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordFeatures()
        for b in batches:
            yield pd.DataFrame({"domain": b["domain"], "f": [seen.of(t)[1].astype(np.uint32).tobytes() for t in b["text"]]})

    # As bytes: a number of an array would be an object on the driver.
    got = texts.mapInPandas(run, "domain string, f binary").collect()
    if not got:
        return nothing
    domains = sorted({r["domain"] for r in got})
    y = np.array([domains.index(r["domain"]) for r in got])
    rows = np.repeat(np.arange(len(got), dtype=np.int32), [len(r["f"]) // 4 for r in got])
    flat = np.frombuffer(b"".join(r["f"] for r in got), np.uint32)
    del got
    features = telling(rows, flat, y, len(domains))  # a few hundred or thousand
    at = np.searchsorted(features, flat)
    ok = at < len(features)
    ok[ok] = features[at[ok]] == flat[ok]
    weights = fit_softmax(rows[ok], at[ok], y, len(features), len(domains))
    weights[-1] -= np.log([drawn[d] for d in domains])  # a domain drawn more often is that much rarer in the table
    return domains, features, weights


def posteriors(docs: DataFrame, domains: list[str], features: np.ndarray, weights: np.ndarray) -> DataFrame:
    """docs(doc_id, text) -> doc_id as text (pandas would turn a batch of numbers with a null into doubles), n_tokens, p: array of
    posteriors in the order of domains; texts without words get the posteriors of the bias."""
    model = docs.sparkSession.sparkContext.broadcast((features, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, w = model.value
        seen = WordFeatures({int(f): i for i, f in enumerate(features)})
        for b in batches:
            n, p = [], []
            for t in b["text"]:
                size, cols = seen.of(t)
                z = w[cols].sum(axis=0) + w[-1]
                e = np.exp(z - z.max()) if len(z) else z
                n.append(size)
                p.append(e / e.sum() if len(e) else e)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": n, "p": p})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id string, n_tokens long, p array<double>")


def rates_after(p: np.ndarray, steps: list[tuple[float, np.ndarray]]) -> np.ndarray:
    """What projected-gradient steps (length, u) make of rates of 1."""
    r = np.ones(len(p))
    for length, u in steps:
        r = np.maximum(0.0, r - length * (r - 1 + p @ u))
    return r


def fit_rates(table: DataFrame, targets: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[list[tuple[float, np.ndarray]], np.ndarray]:
    """table(n_tokens, p) -> the steps, which determine every document's rate, and what is left of each domain's share less its
    target, relative to the larger of the two. rounds: of one slack at most."""
    k = len(targets)
    total = table.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    if not total:
        return [], np.zeros(k)
    width = 3 + k

    def sums(steps: list, u: np.ndarray, lengths: list[float]) -> np.ndarray:
        """For each length of a next step: the rates' squared distance from 1, mean square, squared way, and E."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((len(lengths), width))
            for b in batches:
                if len(b):
                    p, w = b.iloc[:, 1:].to_numpy(float), b["n_tokens"].to_numpy(float) / total
                    r = rates_after(p, steps)
                    slope = r - 1 + p @ u
                    for i, length in enumerate(lengths):
                        q = np.maximum(0.0, r - length * slope)
                        out[i] += np.concatenate([[w @ (q - 1) ** 2, w @ q**2, w @ (q - r) ** 2], (w * q) @ p])
            yield pd.DataFrame([out.ravel()], columns=names)

        names = [f"v{i}" for i in range(len(lengths) * width)]
        # A column for each domain: lists would be stacked row by row in every round.
        rows = table.select("n_tokens", *[F.col("p")[d].alias(f"p{d}") for d in range(k)]).mapInPandas(run, ", ".join(f"{c} double" for c in names))
        return np.array(rows.agg(*[F.sum(c).alias(c) for c in names]).first(), float).reshape(len(lengths), width)

    steps: list[tuple[float, np.ndarray]] = []
    square, spread, _, *e = sums(steps, np.zeros(k), [0.0])[0]
    e = np.array(e)
    most = SPREAD * max(1.0, (targets**2 / np.maximum(e, 1e-12)).sum())
    scale = np.maximum(np.maximum(e, targets), 1e-12)  # every rate is 1 here, and e the shares
    shares, kept = e, (0, e)
    for slack in SLACKS:
        soft = np.minimum(MOST_SLACK, slack * scale**2)
        u, seen = (e - targets) / soft, [0.5 * square + 0.5 * ((e - targets) ** 2 / soft).sum()]
        length = 1 / (1 + (shares / soft).sum())  # no curvature is greater
        for _ in range(rounds):
            lengths = [length * m for m in MULTIPLES]
            found = sums(steps, u, lengths)
            values = 0.5 * found[:, 0] + 0.5 * ((found[:, 3:] - targets) ** 2 / soft).sum(axis=1)
            best = 0 if values[0] <= max(seen[-MEMORY:]) else int(np.argmin(values))
            steps.append((lengths[best], u))
            square, spread, way = found[best, :3]
            moved = way + (found[best, 3:] - e) @ ((found[best, 3:] - targets) / soft - u)
            e = found[best, 3:]
            u = (e - targets) / soft
            seen.append(values[best])
            if way <= 1e-18 or moved <= 0 or (len(seen) > 4 and np.ptp(seen[-4:]) <= SETTLED * max(1.0, abs(seen[-1]))):
                break
            length = way / moved
        if spread > most:
            break
        kept = len(steps), e
        if np.abs((e - targets) / scale).max() <= tolerance:
            break
    return steps[: kept[0]], (kept[1] - targets) / scale


def _stack(p: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in p]) if len(p) else np.zeros((0, 0))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality, toxic) -> doc_id, n_tokens, p_clean, p_low, p_toxic (one for each target
    domain), rate, met: a row for a row of docs. met tells on every row whether all domains are within tolerance of their targets.

    Targets of domains without a labelled document are shared out over the others in proportion. Null texts and texts
    without words have 0 tokens, do not count in the totals and get a rate by their posteriors. Without labels every rate
    is 1 and posteriors are null. A document labelled twice has its alphabetically first domain. Rows without doc_id get a
    rate too. Empty docs give an empty result.
    """
    targets = targets or TARGETS
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    domains, features, weights = train(own, labels, train_docs)
    if not domains:
        empty = [F.lit(None).cast("double").alias(f"p_{d}") for d in sorted(targets)]
        return posteriors(own, [], features, weights).select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", *empty, F.lit(1.0).alias("rate"), F.lit(False).alias("met"))
    goal = np.array([targets.get(d, 0.0) for d in domains])
    goal = goal / goal.sum() if goal.sum() else np.full(len(domains), 1 / len(domains))
    table = materialize(posteriors(own, domains, features, weights), "mixing-posteriors")
    steps, left = fit_rates(table, goal, rounds, tolerance)
    met = bool(np.abs(left).max() <= tolerance)
    if not met:
        warnings.warn("targets are missed, relative to share or target: " + ", ".join(f"{d} {x:+.3f}" for d, x in zip(domains, left, strict=True)), stacklevel=2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(rate=rates_after(_stack(b["p"]), steps) if len(b) else [])

    out = table.mapInPandas(run, "doc_id string, n_tokens long, p array<double>, rate double")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", *[(F.col("p")[domains.index(d)] if d in domains else F.lit(None).cast("double")).alias(f"p_{d}") for d in sorted(targets)], "rate", F.lit(met).alias("met"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs, every row as often as its rate says: the whole part, and once more with the fraction's chance, drawn from a hash of
    doc_id. Columns as given. Rows without doc_id stay once; rows that repeat a doc_id are each drawn alike, at the highest of
    their rates."""
    key, times, copy = (reserved(docs, n) for n in ("id", "times", "copy"))
    rates = mixing_rates(docs, labels, targets).where("doc_id is not null").groupBy("doc_id").agg(F.max("rate").alias("rate"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    other = materialize(rates.select(F.col("doc_id").alias(key), F.floor(F.col("rate") + draw).cast("int").alias(times)).where(F.col(times) != 1), "mixing-times")
    joined = docs.join(broadcast_if_small(other, 24), F.col("doc_id") == F.col(key), "left")
    copies = F.array_repeat(F.lit(0), F.coalesce(times, F.lit(1)))
    return joined.withColumn(copy, F.explode(copies)).select(*[F.col(f"`{c}`") for c in docs.columns])

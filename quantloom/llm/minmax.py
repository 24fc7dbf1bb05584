"""MinHash near-duplicates with min-max hashing.

Every permutation of the shingle hashes gives two signature values, its minimum and its maximum, so a signature of 2k
values costs k hash evaluations. Bands of four values propose candidates; candidates are confirmed on full shingle sets.

Shape of the job: (1) one pass over the texts gives a digest of each shingle set and its band keys; equal sets fold into
one class before anything else, with a pre-aggregated minimum. (2) Buckets link every class to the bucket's smallest
one; components of those links are candidate clusters. (3) A second pass makes the sets of clustered classes only; a
cluster beyond a block's size is cut into blocks by size class and salt, and every pair of blocks that could hold a link
is one bounded unit of work. A unit emits a spanning forest of its links, never all pairs. (4) Components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, broadcast_if_small, materialize, mix, reserved, shingle_hashes, text_key, words
from .components import connected_components

PERMUTATIONS = 40  # hash evaluations for each shingle; twice as many signature values
BAND_VALUES = 4  # 20 bands of 4: a pair at similarity 0.80 is missed with probability 3e-5, at 0.85 with 4e-7
BLOCK_DOCS = 128  # bounds of a block: documents, and shingles in all
BLOCK_SHINGLES = 1 << 18
_CHUNK = 1 << 19  # shingles hashed at once


def signature_bands(sets: list[np.ndarray], permutations: int = PERMUTATIONS, band_values: int = BAND_VALUES) -> np.ndarray:
    """Band keys (one row for each set, none empty): minima and maxima under each permutation, hashed four by four."""
    rng = np.random.default_rng(20240607)
    mul = rng.integers(1, 1 << 63, permutations, dtype=np.uint64) * U64(2) + U64(1)
    add = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    sig = np.empty((len(sets), 2 * permutations), U64)
    for j in range(permutations):
        v = flat * mul[j] + add[j]
        sig[:, 2 * j], sig[:, 2 * j + 1] = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
    bands = sig.reshape(len(sets), -1, band_values)
    key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2])
    for i in range(band_values):
        key = mix(key + bands[:, :, i])
    return key


def set_digests(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Two 64-bit sums over each set; equal for equal sets."""
    return tuple([int(mix(s ^ U64(salt)).sum(dtype=U64).view(np.int64)) if len(s) else 0 for s in sets] for salt in (0, 0x5851F42D4C957F2D))


def _features(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            ids, out, sets, held = b["doc_id"].to_numpy(), [], [], 0

            def flush(upto: int):
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = signature_bands([sets[i] for i in full]).view(np.int64) if full else None
                bands = [np.empty(0, np.int64)] * len(sets)
                for r, i in enumerate(full):
                    bands[i] = keys[r]
                a, c = set_digests(sets)
                return pd.DataFrame({"doc_id": ids[upto - len(sets) : upto], "n_shingles": [len(s) for s in sets], "set_a": a, "set_b": c, "bands": bands})

            for n, text in enumerate(b["text"], 1):
                sets.append(np.unique(shingle_hashes(known.of(words(text)), k)))
                held += len(sets[-1])
                if held >= _CHUNK:
                    out, sets, held = [*out, flush(n)], [], 0
            if sets:
                out.append(flush(len(b)))
            yield from out

    return run


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            sets = [np.unique(shingle_hashes(known.of(words(t)), k)) for t in b["text"]]
            a, c = set_digests(sets)
            yield pd.DataFrame({"doc_id": b["doc_id"], "set_a": a, "set_b": c, "n_shingles": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    return run


def links_within(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Matrix of links (100 * intersection >= percent * union) between sets; if side has two values, across them only."""
    size = np.array([len(s) for s in sets])
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = df[col] > 1
    row, col = row[shared], (np.cumsum(df > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    step = 4096
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        i, j = np.searchsorted(col, [lo, lo + step])
        m = np.zeros((len(sets), min(step, int(col[-1]) + 1 - lo)), np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        inter += m @ m.T
    inter = inter.astype(np.int64)
    linked = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    if side.min() != side.max():
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    return linked


def _forest(ids: np.ndarray, linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the linked sets."""
    seen, src, dst = np.zeros(len(ids), bool), [], []
    for root in np.flatnonzero(linked.any(axis=1)):
        if seen[root]:
            continue
        seen[root], front = True, [root]
        while front:
            x = front.pop()
            for y in np.flatnonzero(linked[x] & ~seen):
                seen[y] = True
                src.append(int(ids[x]))
                dst.append(int(ids[y]))
                front.append(y)
    return src, dst


def _confirm(percent: int):
    def unit(rows: list[pd.DataFrame]):
        g = pd.concat(rows) if len(rows) > 1 else rows[0]
        if len(g) > 1:
            ids = g["doc_id"].to_numpy()
            linked = links_within([np.frombuffer(x, U64) for x in g["shingles"]], g["side"].to_numpy(), percent)
            src, dst = _forest(ids, linked)
            yield pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None
        for b in batches:
            for k, g in b.groupby("unit", sort=False):
                if k != key and held:
                    yield from unit(held)
                    held = []
                held.append(g)
                key = k
        if held:
            yield from unit(held)

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, shingle_words: int = 5) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Links: 100 * intersection >= percent * union of distinct word shingles. Null texts and texts without words have an
    empty set and stand alone, as do rows without doc_id (component_id null, kept true). Rows that repeat a doc_id are one
    document with several texts: each text is compared, and their groups are one component. Other columns of docs are not looked at. Empty docs give an empty result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = materialize(src.where("doc_id is not null").mapInPandas(_features(shingle_words), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "minmax-features")
    key = ["set_a", "set_b", "n_shingles"]
    full = feats.where("n_shingles > 0")
    classes = materialize(full.groupBy(*key).agg(F.min(F.struct("doc_id", "bands")).alias("m")).select(*key, F.col("m.doc_id").alias("rep"), F.col("m.bands").alias("bands")), "minmax-classes")

    slots = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "value"))
    heads = slots.groupBy("band", "value").agg(F.min("rep").alias("head"), F.count("*").alias("members")).where("members > 1").select("band", "value", "head")
    starred = slots.join(heads, ["band", "value"]).where("rep <> head").select(F.col("rep").alias("src"), F.col("head").alias("dst")).distinct()
    clusters = connected_components(starred, "minmax-candidates")

    # Members of clusters with the blocks that they fall into: one for a small cluster, else by size class and salt.
    log = float(np.log(100 / percent))
    sized = clusters.join(classes.select(F.col("rep").alias("node"), *key), "node").select("node", F.col("label").alias("cluster"), *key, F.floor(F.log("n_shingles") / log + 1e-9).cast("int").alias("band"))
    load = sized.groupBy("cluster", "band").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    total = load.groupBy("cluster").agg(F.sum("docs").alias("all_docs"), F.sum("shingles").alias("all_shingles"), F.map_from_entries(F.collect_list(F.struct("band", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")))).alias("blocks"))
    small = (F.col("all_docs") <= BLOCK_DOCS) & (F.col("all_shingles") <= BLOCK_SHINGLES)
    members = sized.join(total, "cluster")
    mine = F.coalesce(F.col("blocks")[F.col("band")], F.lit(1))
    salt = F.pmod(F.xxhash64("node", F.lit(7)), mine).cast("int")
    members = members.select("node", *key, "cluster", "band", "blocks", salt.alias("salt"), small.alias("small"))

    def cell(a, i, b, j):
        return F.concat_ws(".", "cluster", a, i, b, j)

    def up_to(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    own = F.transform(up_to(F.col("blocks")[F.col("band")]), lambda j: F.struct(cell(F.col("band"), F.least("salt", j), F.col("band"), F.greatest("salt", j)).alias("unit"), F.when(j < F.col("salt"), 1).otherwise(0).alias("side")))
    above = F.transform(up_to(F.coalesce(F.col("blocks")[F.col("band") + 1], F.lit(0))), lambda j: F.struct(cell(F.col("band"), F.col("salt"), F.col("band") + 1, j).alias("unit"), F.lit(0).alias("side")))
    below = F.transform(up_to(F.coalesce(F.col("blocks")[F.col("band") - 1], F.lit(0))), lambda j: F.struct(cell(F.col("band") - 1, j, F.col("band"), F.col("salt")).alias("unit"), F.lit(1).alias("side")))
    units = F.when(F.col("small"), F.array(F.struct(F.col("cluster").cast("string").alias("unit"), F.lit(0).alias("side")))).otherwise(F.concat(own, above, below))
    placed = materialize(members.select(F.col("node").alias("doc_id"), *key, units.alias("units")), "minmax-units")

    # A representative's id may stand before several texts: the one of the class is told by its set.
    texts = src.join(broadcast_if_small(placed.select("doc_id").distinct(), 16, placed.count()), "doc_id").select("doc_id", "text")
    sets = texts.mapInPandas(_sets(shingle_words), "doc_id long, set_a long, set_b long, n_shingles long, shingles binary").dropDuplicates(["doc_id", *key])
    work = sets.join(placed, ["doc_id", *key]).select("doc_id", "shingles", F.explode("units").alias("u")).select("doc_id", "shingles", F.col("u.unit").alias("unit"), F.col("u.side").alias("side"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    links = work.repartition(parts, "unit").sortWithinPartitions("unit").mapInPandas(_confirm(percent), "src long, dst long")
    # Texts of one doc_id that are in several classes tie these together.
    twice = broadcast_if_small(materialize(full.groupBy("doc_id").count().where("count > 1").select("doc_id"), "minmax-twice"), 16)
    texts_of = materialize(full.join(twice, "doc_id").join(classes.select(*key, "rep"), key).select("doc_id", "rep").distinct(), "minmax-namesakes")
    tied = texts_of.join(texts_of.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id").where("rep <> least").select(F.col("rep").alias("src"), F.col("least").alias("dst"))
    groups = connected_components(links.unionByName(tied), "minmax-links")

    named = classes.select(*key, "rep").join(groups.select(F.col("node").alias("rep"), "label"), "rep", "left").select(*key, F.coalesce("label", "rep").alias("component_id"))
    linked = full.select("doc_id", *key).join(named, key).select("doc_id", "n_shingles", "component_id")
    alone = feats.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    nameless = src.where("doc_id is null").mapInPandas(_features(shingle_words), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = linked.unionByName(alone).unionByName(nameless)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each_group(docs: DataFrame, percent: int = 80, shingle_words: int = 5) -> DataFrame:
    """docs without the near-duplicates: of each component the row with the smallest doc_id stays. Columns as given.

    Rows that repeat a doc_id with another text are documents of their own here, so that none goes for its namesake's
    sake; in the order of ids they stand behind all others (but for one text of each id). Of rows that repeat a doc_id and
    its text one stays, settled by a hash of the row; rows without doc_id stay all. Empty docs stay empty.
    """
    key, node = reserved(docs, "gone"), reserved(docs, "node")
    twice = materialize(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(node)).count().where("count > 1").select(F.col(node).alias(f"{key}_i")), "minmax-repeated")
    if not twice.limit(1).count():
        gone = near_duplicates(docs, percent, shingle_words).where("not kept").select(F.col("doc_id").alias(key)).distinct()
        return docs.join(broadcast_if_small(materialize(gone, "minmax-gone"), 16), F.col("doc_id") == F.col(key), "left_anti")
    twice, text = broadcast_if_small(twice, 16), reserved(docs, "text_key")
    docs_t = docs.withColumn(text, text_key("text"))
    texts = docs_t.join(twice, F.col("doc_id") == F.col(f"{key}_i"), "left_semi").select(F.col("doc_id").cast("long").alias("i"), F.col(text).alias("t")).distinct()
    texts = materialize(texts, "minmax-repeated-texts")
    more = texts.join(texts.groupBy("i").agg(F.min("t").alias("first")), "i").where("t <> first")
    more = materialize(more.select(F.col("i").alias(key), F.col("t").alias(f"{key}_t"), (F.lit(1 << 62) + F.monotonically_increasing_id()).alias(f"{key}_n")), "minmax-surrogates")
    named = docs_t.join(broadcast_if_small(more, 96), (F.col("doc_id") == F.col(key)) & (F.col(text) == F.col(f"{key}_t")), "left")
    named = named.withColumn(node, F.coalesce(f"{key}_n", F.col("doc_id").cast("long"))).drop(key, f"{key}_t", f"{key}_n")
    gone = near_duplicates(named.select(F.col(node).alias("doc_id"), "text"), percent, shingle_words).where("not kept").select(F.col("doc_id").alias(key)).distinct()
    left = named.join(broadcast_if_small(materialize(gone, "minmax-gone"), 16), F.col(node) == F.col(key), "left_anti")
    every, plain = [F.col(f"`{c}`") for c in docs.columns], [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    again = left.join(twice, F.col("doc_id") == F.col(f"{key}_i"), "left_semi").groupBy(node, text).agg(F.min_by(F.struct(*every), F.xxhash64(*plain)).alias("row"))
    return left.join(twice, F.col("doc_id") == F.col(f"{key}_i"), "left_anti").select(*every).unionByName(again.select("row.*"))

"""Benchmark decontamination: size-partitioned MinHash containment search, native DataFrame functions only.

A benchmark item is short and a document may be long, so their Jaccard similarity says little; containment of the item's
shingles in the document is what counts. Documents are partitioned by the size of their shingle set and every partition
has its own sketch length: one-permutation MinHash with the first power of two of bins at or above OVERSAMPLE times the
set size, the bin being the hash's leading bits. An item is sketched once for every sketch length in use. A shingle that
both share is then the minimum of its bin in the document with a probability near one whatever the document's length, so
one equal (sketch length, minimum) is enough to propose the pair, and the chance that none of m shared shingles shows is
(1 - p)^m. Items too short for that (fewer than five shingles at a containment of 0.8) are looked up in documents' whole sets, which is exact;
the others keep their sketches beside them. Proposed pairs are verified by exact shingle containment.

Tokens are maximal runs of letters and digits, lower-cased, so that punctuation and case do not hide a passage. A
shingle is `shingle_words` tokens; a text with fewer has its whole sequence as one; a text without tokens has none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, reserved, text_key

CONTAINMENT = 0.8
MISS = 1e-6  # the largest chance that a pair at the threshold is not proposed
OVERSAMPLES = (4, 16)  # tried in turn; beyond them the whole set is looked at


def tokens(text: str = "text") -> Column:
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def with_shingles(df: DataFrame, k: int) -> DataFrame:
    """df(..., _tokens) -> df(..., _set): sorted distinct 64-bit shingle hashes."""
    w = F.col("_tokens")
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    whole = F.array(F.xxhash64(w))
    hashes = F.when(F.size(w) >= k, runs).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("_set", F.array_sort(F.array_distinct(hashes))).drop("_tokens")


def each_hash(df: DataFrame, hashes: Column, *keep: str) -> DataFrame:
    """A row for each hash. Outer, then filtered on the row: for an inner explode Spark infers a filter on the array's size
    and pushes it below the projections, where the tokens would be split anew for every shingle."""
    return df.select(*keep, F.explode_outer(hashes).alias("h")).where("h is not null")


def sketch(sets: Column, bits: Column) -> Column:
    """The smallest hash of every bin of a sorted set; the bin is the leading `bits` bits."""
    shift = F.lit(64) - bits
    return F.filter(sets, lambda x, i: (i == 0) | (F.call_function("shiftright", x, shift) != F.call_function("shiftright", F.get(sets, i - 1), shift)))


def oversample_for(smallest: int, containment: float = CONTAINMENT) -> int | None:
    """The sketch length, as a multiple of the set size, at which the smallest item is missed rarely enough."""
    shared = math.ceil(containment * smallest - 1e-9)
    for o in OVERSAMPLES:
        seen = o * (1 - math.exp(-1 / o))
        if shared > 0 and (1 - seen) ** shared <= MISS:
            return o
    return None


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, shingle_words: int = 5) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> doc_id, item_id, item_shingles, shared, containment of every pair found.

    Null or empty texts on either side are in no pair; rows without an id are left out; repeated rows of a doc_id or an
    item_id count once, with the union of their shingles. Empty tables give no pairs. Other columns are not looked at.
    """
    q = with_shingles(items.where("item_id is not null").select("item_id", tokens().alias("_tokens")), shingle_words)
    q = each_hash(q, F.col("_set"), "item_id").distinct()
    q = materialize(q.groupBy("item_id").agg(F.array_sort(F.collect_list("h")).alias("_set"), F.count("*").alias("item_shingles")), "decontam-items")
    short = next(m for m in range(1, 1000) if oversample_for(m, containment))
    brief = F.col("item_shingles") < short
    facts = q.agg(F.min(F.when(~brief, F.col("item_shingles"))).alias("least"), F.sum(brief.cast("int")).alias("brief"), F.sum("item_shingles").alias("all")).first()
    over = oversample_for(facts["least"] or short, containment)

    sets = with_shingles(docs.where("doc_id is not null").select("doc_id", tokens().alias("_tokens")), shingle_words)
    bits = F.greatest(F.lit(3), F.ceil(F.log2(F.greatest(F.size("_set"), F.lit(1)) * over)).cast("int"))
    keys = each_hash(sets.select("doc_id", "_set", bits.alias("bits")), sketch(F.col("_set"), F.col("bits")), "doc_id", "bits")
    item_keys = each_hash(q.where(~brief).select("_set", F.explode(F.sequence(F.lit(3), F.lit(40))).alias("bits")), sketch(F.col("_set"), F.col("bits")), "bits").distinct()
    # A semi join first: it needs no item ids, so a passage common to many items does not multiply a document's rows.
    item_keys = materialize(item_keys, "decontam-sketches")
    hits = keys.join(broadcast_if_small(item_keys, 32), ["bits", "h"], "left_semi").select("doc_id", "h")
    named = each_hash(q, F.col("_set"), "item_id")
    if facts["brief"]:
        few = each_hash(q.where(brief), F.col("_set")).distinct()
        hits = hits.unionByName(each_hash(sets, F.col("_set"), "doc_id").join(broadcast_if_small(few, 32), "h", "left_semi").select("doc_id", "h"))
    proposed = hits.distinct().join(broadcast_if_small(named, 32, facts["all"] or 0), "h").select("doc_id", "item_id").distinct()
    proposed = materialize(proposed.groupBy("doc_id").agg(F.collect_set("item_id").alias("_items")).withColumnRenamed("doc_id", "_doc"), "decontam-pairs")

    # The proposed documents once more, whole: exact containment of the items proposed for each.
    width = proposed.agg(F.sum(F.size("_items") * 8 + 32).alias("bytes")).first()["bytes"] or 0
    again = docs.select("doc_id", "text").join(broadcast_if_small(proposed, 1, width), F.col("doc_id") == F.col("_doc"))
    full = with_shingles(again.select("doc_id", "_items", tokens().alias("_tokens")), shingle_words)
    full = each_hash(full, F.col("_set"), "doc_id", "_items")
    shared = full.join(broadcast_if_small(named, 32, facts["all"] or 0), "h").where(F.array_contains("_items", F.col("item_id"))).select("doc_id", "item_id", "h").distinct()
    counts = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    out = counts.join(broadcast_if_small(q.select("item_id", "item_shingles"), 32), "item_id").withColumn("containment", F.col("shared") / F.col("item_shingles"))
    return out.where(F.col("shared") >= F.ceil(F.col("item_shingles") * containment - 1e-9)).select("doc_id", "item_id", "item_shingles", "shared", "containment")


def without_contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """docs without those whose text is in a pair of contaminated(); columns as given. Rows are judged by their texts, also those
    without doc_id and those that repeat one; equal texts are looked at as one document."""
    key = reserved(docs, "bad")
    texts = docs.select(text_key("text").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bad = materialize(contaminated(texts, items, containment).select(F.col("doc_id").alias(key)).distinct(), "decontam-gone")
    return docs.join(broadcast_if_small(bad, 64), text_key("text") == F.col(key), "left_anti")

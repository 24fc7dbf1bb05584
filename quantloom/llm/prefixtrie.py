"""The prefix trie of conversations by fixed-length block hashing.

Every turn has a digest that holds its position, and a prefix's digest is the xor of its turns' digests: so prefixes add up
in any order, by blocks of eight turns first. (1) Turns are numbered and digested; texts stay behind. (2) Conversations
are rebuilt by a join with their donors' first turns. (3) Each block of a conversation gets the digests of the prefix before
and after it; conversations that agree on both, at one block number, fold into a class with a pre-aggregated count. (4) A
class that is alone behind its prefix is a chain: its turns are nodes as they stand. Only where several classes share the
prefix do siblings diverge, and only there turns of the classes' representatives are grouped one by one. (5) Sums over a
subtree are sums over the members of its top, so they are made the same way, by class and then by node, without a walk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

BLOCK = 8  # turns of a block
SPAN = 4096  # turn numbers, or blocks, of one conversation that one window task takes
GROUP, LONGEST = 5, 8  # conversations that share a donor; most turns that a donor gives
IDS = 8192  # conversation ids in one piece of a node's list
_NO_TURN = -(1 << 53)  # span of rows without a turn, before all others
_NODE = ["depth", "p1", "p2"]


def given_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from its donor."""
    return (F.crc32(conv.cast("string").cast("binary")) % (LONGEST + 1)).cast("long")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos from 1, digest (a, b), bytes of the text; spans of a conversation are numbered apart and then added up."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hexed = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    src = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), hexed.alias("hex"), F.octet_length(text).cast("long").alias("bytes"))
    src = src.withColumn("span", F.coalesce(F.floor(F.col("turn") / SPAN).cast("long"), F.lit(_NO_TURN)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = src.groupBy("conv", "span").agg(F.count("*").alias("n")).select("conv", "span", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("conv", "span").orderBy(F.col("turn").asc_nulls_first(), "hex"))
    half = [F.conv(F.substring("hex", at, 15), 16, 10).cast("long") for at in (1, 16)]
    return src.join(spans, ["conv", "span"]).select("conv", (F.col("before") + place).alias("pos"), half[0].alias("a"), half[1].alias("b"), "bytes")


def rebuilt_turns(turns: DataFrame, members: DataFrame) -> DataFrame:
    """conv, pos, digest (x1, x2) with the position in it, bytes: the donor's first turns, then the conversation's own."""
    own_donor = F.pmod("conv", F.lit(GROUP)) == 0
    own = turns.join(members, "conv").where(own_donor | (F.col("pos") > F.col("h"))).withColumn("pos", F.when(own_donor, F.col("pos")).otherwise(F.col("pos") - F.col("h") + F.col("given")))
    heirs = F.explode(F.array(*[F.try_add("conv", F.lit(k)) for k in range(1, GROUP)]))
    first = turns.where(own_donor & (F.col("pos") <= LONGEST)).select(heirs.alias("conv"), "pos", "a", "b", "bytes").where(F.col("pos") <= given_turns(F.col("conv")))
    first = first.join(members.select("conv"), "conv", "left_semi")
    both = own.select("conv", "pos", "a", "b", "bytes").unionByName(first)
    return both.select("conv", "pos", F.xxhash64("a", "b", "pos").alias("x1"), F.xxhash64("pos", "b", "a", F.lit(1)).alias("x2"), "bytes")


def _xor(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.bitwiseXOR(b)


def _so_far(of, keys: list[str], order: str, last: int) -> Column:
    return F.coalesce(of.over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, last)), F.lit(0).cast("long"))


def prefix_blocks(turns: DataFrame) -> DataFrame:
    """conv, blk, turns in it, digests of the prefix before (s1, s2) and after (e1, e2) it, bytes before it and in it."""
    blk = F.floor((F.col("pos") - 1) / BLOCK).cast("long")
    sums = [F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("bytes").alias("bytes")]
    blocks = materialize(turns.groupBy("conv", blk.alias("blk")).agg(*sums, F.count("*").alias("turns")).withColumn("span", F.floor(F.col("blk") / SPAN).cast("long")), "trie-blocks")
    spans = blocks.groupBy("conv", "span").agg(*sums)
    carried = spans.select("conv", "span", *[_so_far(f(c), ["conv"], "span", -1).alias(to) for f, c, to in ((F.bit_xor, "x1", "c1"), (F.bit_xor, "x2", "c2"), (F.sum, "bytes", "cb"))])
    at = ["conv", "span"]
    s1, s2 = _xor("c1", _so_far(F.bit_xor("x1"), at, "blk", -1)), _xor("c2", _so_far(F.bit_xor("x2"), at, "blk", -1))
    out = blocks.join(carried, at).select("conv", "blk", "turns", s1.alias("s1"), s2.alias("s2"), "x1", "x2", (F.col("cb") + _so_far(F.sum("bytes"), at, "blk", -1)).alias("before"), "bytes")
    return out.select("conv", "blk", "turns", "s1", "s2", _xor("s1", "x1").alias("e1"), _xor("s2", "x2").alias("e2"), "before", "bytes")


_CLASS = ["blk", "s1", "s2", "e1", "e2", "turns"]


def _class_turns(turns: DataFrame, blocks: DataFrame) -> DataFrame:
    """Turns of one representative of each class, as nodes of its path; chain tells that no other class shares its start."""
    classes = materialize(blocks.groupBy(*_CLASS).agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.min("before").alias("before")), "trie-classes")
    alone = classes.groupBy("blk", "s1", "s2").agg(F.count("*").alias("classes"), F.min("conv").alias("conv")).where("classes = 1").select("conv", "blk", F.lit(True).alias("chain"))
    chosen = classes.join(alone, ["conv", "blk"], "left").select("conv", "blk", "s1", "s2", "n", "before", F.coalesce("chain", F.lit(False)).alias("chain"))
    path = turns.withColumn("blk", F.floor((F.col("pos") - 1) / BLOCK).cast("long")).join(chosen, ["conv", "blk"])
    at = ["conv", "blk"]
    upto = [[_xor(s, _so_far(F.bit_xor(x), at, "pos", last)) for s, x in (("s1", "x1"), ("s2", "x2"))] for last in (0, -1)]
    return path.select(
        "conv", "blk", "chain", "n", F.col("pos").alias("depth"), upto[0][0].alias("p1"), upto[0][1].alias("p2"), upto[1][0].alias("q1"), upto[1][1].alias("q2"),
        "bytes", (F.col("before") + _so_far(F.sum("bytes"), at, "pos", -1)).alias("before"),
    )


def _nodes(path: DataFrame, folds: list[Column], plain: list[Column]) -> DataFrame:
    """A row for each node: turns of chains as they are, others folded by prefix."""
    return path.where("chain").select(*_NODE, *plain).unionByName(path.where("not chain").groupBy(*_NODE).agg(*folds))


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of lists, a list's pieces in a row and in order -> one SHA-256 for each list; a digest is carried from piece to piece."""
    key, state = None, None

    def row():
        return pa.RecordBatch.from_pylist([dict(zip(_NODE, key), ends_sha256=state.hexdigest())], pa.schema([*[(c, pa.int64()) for c in _NODE], ("ends_sha256", pa.string())]))

    for b in batches:
        done = []
        for *k, ids in zip(*(b.column(c).to_pylist() for c in [*_NODE, "ids"])):
            if k != key:
                if key is not None:
                    done.append(row())
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield from done
    if key is not None:
        yield row()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> a row for each node of the trie of the rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Turns stand in the order of turn, null first; equal ones in the order of the SHA-256 of role and text, so repeated rows
    are turns of their own. Null roles and texts are empty; rows without conv_id are no conversation's. A conversation c
    takes the first h turns of the smallest of its five, c - pmod(c, 5), as they stood (none if that is absent). Other
    columns are not looked at. An empty table has no root and gives an empty result.
    """
    spark = conversations.sparkSession
    turns = materialize(numbered_turns(conversations), "trie-turns")
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("len"))
    donor = F.try_subtract("conv", F.pmod("conv", F.lit(GROUP)))
    given = F.least("h", F.coalesce("donor_len", F.lit(0)))
    members = sizes.select("conv", given_turns(F.col("conv")).alias("h"), donor.alias("donor"))
    members = materialize(members.join(sizes.select(F.col("conv").alias("donor"), F.col("len").alias("donor_len")), "donor", "left").select("conv", "h", given.alias("given")), "trie-members")
    turns = materialize(rebuilt_turns(turns, members), "trie-rebuilt")
    blocks = materialize(prefix_blocks(turns), "trie-prefixes")
    path = materialize(_class_turns(turns, blocks), "trie-path")

    zero = F.lit(0).cast("long")
    root = members.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).where("n > 0").select(*[zero.alias(c) for c in [*_NODE, "q1", "q2", "bytes", "before"]], "n", "conv")
    kept = ["q1", "q2", "bytes", "before", "n", "conv"]
    folds = [*[F.min(c).alias(c) for c in ("q1", "q2", "bytes", "before")], F.sum("n").alias("n"), F.min("conv").alias("conv")]
    nodes = materialize(_nodes(path, folds, [F.col(c) for c in kept]).unionByName(root.select(*_NODE, *kept)), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-nodes-2")

    # apart: bytes of a conversation's turns that a smaller conversation has too; leaf: it is the smallest member of a childless node.
    owned = nodes.groupBy("conv").agg(F.min("before").alias("apart"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    whole = blocks.groupBy("conv").agg(F.sum("bytes").alias("bytes"), F.sum("turns").alias("depth"), F.max(F.struct("blk", "e1", "e2")).alias("end"))
    each = members.select("conv").join(whole, "conv", "left").join(owned, "conv", "left")
    each = materialize(each.select("conv", F.coalesce("depth", zero).alias("depth"), F.coalesce("end.e1", zero).alias("p1"), F.coalesce("end.e2", zero).alias("p2"), F.coalesce("apart", "bytes", zero).alias("apart"), F.coalesce("leaf", zero).alias("leaf")), "trie-each")

    sums = [F.sum("apart").alias("apart"), F.sum("leaf").alias("n_leaves")]
    top = F.min(F.struct("conv", F.col("apart").alias("own"))).alias("top")
    classes = blocks.select("conv", *_CLASS).join(each.select("conv", "apart", "leaf"), "conv").groupBy(*_CLASS).agg(*sums, top)
    classes = classes.select(F.col("top.conv").alias("conv"), "blk", "apart", "n_leaves", F.col("top.own").alias("own"))
    through = path.select("conv", "blk", "chain", *_NODE).join(classes, ["conv", "blk"])
    up = _nodes(through, [F.sum("apart").alias("apart"), F.sum("n_leaves").alias("n_leaves"), F.min(F.struct("conv", "own")).alias("top")], [F.col("apart"), F.col("n_leaves"), F.struct("conv", "own").alias("top")])
    up = up.unionByName(each.agg(*sums, top).where("top is not null").select(*[zero.alias(c) for c in _NODE], "apart", "n_leaves", "top"))

    piece = each.groupBy(*_NODE, F.floor(F.col("conv") / IDS).cast("long").alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ends = piece.repartition(parts, *_NODE).sortWithinPartitions(*_NODE, "piece").mapInArrow(_hash_lists, "depth long, p1 long, p2 long, ends_sha256 string")

    every = materialize(nodes.join(up, _NODE).join(ends, _NODE, "left"), "trie-sums")
    parents = broadcast_if_small(nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent_conv_id")), 48)
    saved = F.col("apart") - F.col("top.own") - (F.col("n") - 1) * F.col("before")
    return every.join(parents, ["depth", "q1", "q2"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )

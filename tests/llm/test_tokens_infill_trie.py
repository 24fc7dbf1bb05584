import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quantloom.llm import queries
from quantloom.llm.infill import RankIndex, blocks, fill_in_middle, restored, transform_block
from quantloom.llm.prefixtrie import prefix_trie
from quantloom.llm.tokencount import VOCABULARY, Counts, byte_batches, pieces, segments, token_counts
from pyspark.sql import functions as F

BIG = (1 << 53) + 1


# Token counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_pieces_and_segments_count_like_the_whole_text(library):
    rng = random.Random(5)
    letters = [*"ab'st 1,.\n \t\r　\xa0é中文。<|>​\x1c\x85_\x00", "<|endoftext|>", " 're", "\n\n", "  ", "🙂"]
    known = Counts(VOCABULARY, bound=2000)  # emptied again and again
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        want = len(library.encode(text, add_special_tokens=False))
        assert "".join(pieces(text)) == text and "".join(segments(text, 7)) == text
        assert known.of(text) == want == sum(known.of(s) for s in segments(text, 7)), repr(text)


def test_batches_are_balanced_by_bytes():
    rng = random.Random(6)
    texts = ["é" * rng.randrange(1, 50) for _ in range(500)] + ["x" * 5000]
    cut = list(byte_batches(texts, 1000))
    assert sorted(t for b in cut for t in b) == sorted(texts)
    assert all(len(b) == 1 or sum(len(t.encode()) for t in b) <= 1000 for b in cut)


def test_token_counts(spark, library):
    rng = random.Random(7)
    long = " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 9))) for _ in range(300_000))
    rows = [(1, "Hello there.\nSecond line"), (BIG, "a"), (None, "no id"), (2, None), (3, ""), (4, long), (5, "x" * 20_000), (1, "Hello there.\nSecond line"), (6, "say <|endoftext|> now")]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, n_tokens int, n_bytes string")
    got = sorted(map(tuple, token_counts(docs).collect()), key=str)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows]
    assert got == sorted([(*w, w[2] > 512) for w in want], key=str)
    assert token_counts(docs.limit(0)).count() == 0


def test_token_counts_of_the_table(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in queries.op11_token_counts(spark, sf).collect()} == want


# Fill-in-middle


def test_rank_index_is_exact_and_error_bounded():
    rng = np.random.default_rng(3)
    for steps in ([], [1], rng.integers(1, 200, 5000), np.r_[np.ones(40_000, int), rng.integers(1, 10**6, 300), np.ones(10, int)]):
        offsets = np.cumsum(np.asarray(steps, np.int64))
        for error in (0, 1, 64):
            index = RankIndex(offsets, error)
            assert (index.cut(np.arange(len(offsets))) == offsets).all()
            assert not len(offsets) or np.abs(index.residual).max() <= error + 1
    assert len(RankIndex(np.arange(100_000), 64).first) == 1


def brute_infill(doc_id, text, rate=100):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    i, j = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:i]), "".join(lines[i:j]), "".join(lines[j:])
    return len(lines), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def infill_rows():
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["a", "é", "\n", "🙂x", "<", "<S", ">", "P>", " "]) for _ in range(rng.randrange(80)))) for i in range(400)]
    return [*rows, (500, "\n"), (501, "\n\n\nx"), (502, ""), (503, None), (None, "no\nid\n"), (BIG, "a\nb"), (504, "has <M> in\nit"), (1, rows[1][1]), (505, "line\n" * 200_000)]


def test_fill_in_middle_equals_brute_force_and_comes_back(spark):
    rows = infill_rows()
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, output string")
    for rate in (100, 40):
        out = fill_in_middle(docs, rate=rate)
        got = [tuple(r) for r in out.select("*", restored(F.col("output"), F.col("form")).alias("back")).collect()]
        want = [(i, *brute_infill(i, t, rate), t or "") for i, t in rows]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_blocks_cover_texts():
    assert list(blocks([5, 5, 100, 1, 1, 1], 10)) == [(0, 2), (2, 3), (3, 6)] and list(blocks([])) == []
    assert transform_block([], [], 7, 100, 50, 64)["n"] == []


# Prefix trie


def brute_trie(rows):
    found = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            found.setdefault(c, []).append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in found.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    nodes, kids, leaves, saved = {}, {}, {}, {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) if below else 1
        saved[k] = sum(saved[x] for x in below) + ((len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0)

    def ends(k, m):
        return hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest()

    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], ends(k, m)) for k, m in nodes.items())


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(rng, convs, longest):
    """Few distinct turns, so that prefixes are shared over several blocks; some copies, gaps, nulls and repeated rows."""
    rows = []
    for c in convs:
        n, kind = rng.randrange(1, longest), rng.random()
        say = (lambda i: "same") if kind < 0.5 else (lambda i: rng.choice(["same", "same", "same", "other", "é"]))
        rows += [(c, 3 * i, rng.choice(["user", "user", "user", "system"]) if i > 12 else "user", say(i)) for i in range(n)]
        if kind > 0.8:
            rows += [(c, None, None, "first"), (c, 2, "user", None), (c, 2, "user", "tie"), (c, 2, "user", "tie")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    convs = [*rng.sample(range(90), 60), BIG, BIG - BIG % 5, -7, 10_000, 10_004]
    rows = [*trie_rows(rng, convs, 30), *((200 + k, i, "user", "copy") for k in range(40) for i in range(12)), (None, 0, "user", "nobody"), *((77_777, i, "user", f"{i % 3}") for i in range(150))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    assert sorted(tuple(r) for r in prefix_trie(df).select(*NODE).collect()) == brute_trie(rows)


def test_prefix_trie_without_turns_and_empty(spark, monkeypatch):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "a")]  # its donor is absent and its own turn is skipped
    assert zlib.crc32(b"1") % 9 >= 1
    assert sorted(tuple(r) for r in prefix_trie(spark.createDataFrame(rows, schema)).select(*NODE).collect()) == brute_trie(rows)
    assert prefix_trie(spark.createDataFrame([], schema)).count() == 0


def test_prefix_trie_with_short_spans(spark, monkeypatch):
    """Spans of three turns and blocks of two, so that numbers and digests are carried over many spans; list pieces of seven ids."""
    import quantloom.llm.prefixtrie as trie

    for name, value in (("SPAN", 3), ("BLOCK", 2), ("IDS", 7)):
        monkeypatch.setattr(trie, name, value)
    rows = trie_rows(random.Random(9), range(40), 25) + [(100 + k, i, "user", "copy") for k in range(30) for i in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(tuple(r) for r in prefix_trie(df).select(*NODE).collect()) == brute_trie(rows)

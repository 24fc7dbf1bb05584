import bisect
import hashlib
import random
import re
import zlib

from quantloom.llm.decontam import contaminated, oversample_for, without_contaminated
from quantloom.llm.ring import assign_shards, ring_points, ring_runs


def shingles(text, k=5):
    w = [x for x in re.sub(r"[^\w]|_", " ", (text or "").lower()).split()]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_pairs_are_those_of_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(4000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([6, 14, 30, 60])))) for i in range(40)] + [(90, None), (91, ""), (92, "a b"), (93, "one two three four five")]
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 50, 3000])))) for i in range(60)] + [(70, None), (71, "A b!"), (72, "a b c"), (73, "so One, two; three four FIVE.")]
    for i in range(100, 160):  # passages inside longer texts, some with words changed
        t = rng.choice(items[:40])[1].split()
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = "zz"
        docs.append((i, " ".join([word() for _ in range(rng.choice([0, 20, 2000]))] + [t[0].upper() + ","] + t[1:] + [word() for _ in range(9)])))
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in contaminated(d, q).collect()}
    ds, qs = {i: shingles(t) for i, t in docs}, {i: shingles(t) for i, t in items}
    want = {(i, j, len(a & b), len(b)) for i, a in ds.items() for j, b in qs.items() if b and len(a & b) >= 0.8 * len(b) - 1e-9}
    assert got == want and len(want) > 20
    left = without_contaminated(d, q)
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == set(ds) - {w[0] for w in want}


def test_long_items_use_short_sketches_and_empty_tables(spark):
    assert oversample_for(30) == 4 and oversample_for(1) is None
    none = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t")], "item_id long, text string")
    assert contaminated(none, q).count() == 0
    docs = spark.createDataFrame([(1, "x y a b c d e f g h i j k l m n o p q r s t z"), (None, "a"), (2, "nothing of it")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in contaminated(docs, q).collect()] == [(1, 1)]
    assert contaminated(docs, q.limit(0)).count() == 0 and without_contaminated(docs, q.limit(0)).count() == 3


def walk(rows, shards):
    """One row after another around the ring: rows(doc_id, text) -> (doc_id, size, crc, shard, slot), in turns of one point for every arc."""
    points, owners = ring_points(shards)
    arcs = {}
    for i, t in rows:
        raw = (t or "").encode()
        place = int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:8], 16)
        arcs.setdefault(bisect.bisect_left(points, place) % len(points), []).append((place, i is not None, i or 0, zlib.crc32(raw), len(raw) + 8, i))
    room, used, out = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)], [0] * shards, []
    for v in arcs.values():
        v.sort(reverse=True)
    for d in range(len(points)):
        for a in sorted(arcs):
            s = owners[(a + d) % len(points)]
            while arcs[a] and used[s] < room[s]:
                *_, crc, size, i = arcs[a].pop()
                out.append((i, size, crc, s, used[s]))
                used[s] += 1
    return out


def test_every_row_is_where_the_walk_puts_it(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(10**9), "x" * rng.randrange(5)) for _ in range(700)] + [(None, "n"), (None, None), (-5, "é")] + [(7, f"copy {i % 3}") for i in range(60)]
    rng.shuffle(rows)
    for shards in (1, 5, 24):
        got = assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards).collect()
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got), key=str) == sorted(walk(rows, shards), key=str)


def test_ring(spark):
    rows = [(i, "t" * (i % 7)) for i in range(1003)] + [(None, None), (5, "again"), (5, "again")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, shard string")
    got = assign_shards(docs, 24).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    assert assign_shards(docs.limit(0), 24).count() == 0


def test_rows_stay_near_home_and_few_move():
    rng = random.Random(1)
    place = {}
    for shards in (24, 25):
        points, owners = ring_points(shards)
        arcs = {}
        for k in range(20000):
            random.seed(k)
            arcs.setdefault(bisect.bisect_left(points, random.randrange(1 << 32)) % len(points), []).append(k)
        runs = ring_runs({a: len(v) for a, v in arcs.items()}, owners, shards)
        place[shards] = {k: s for a, lo, hi, s, _ in runs for k in arcs[a][lo:hi]}
        home = sum(place[shards][k] == owners[a] for a, v in arcs.items() for k in v)
        assert home > 0.85 * 20000
    del rng
    assert sum(place[24][k] != place[25][k] for k in range(20000)) < 0.35 * 20000

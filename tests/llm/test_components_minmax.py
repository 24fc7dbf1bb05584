import random

import pytest

from quantloom.llm.components import connected_components
from quantloom.llm.minmax import keep_one_of_each_group, near_duplicates


def brute_components(pairs):
    label = {}
    for a, b in pairs:
        label.setdefault(a, a)
        label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, x) for x in range(201, 260)]
    rng.shuffle(pairs)
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == brute_components(pairs)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = brute_components(links)
    return {i: (len(sets[i]), label.get(i, i)) for i in sets}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    out, n = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "one two three")], 6
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(300):  # one group of near copies, many beyond the threshold of one another: over a block's size
        t = list(base)
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = f"x{rng.random()}"
        out.append((n, " ".join(t)))
        n += 1
    for _ in range(60):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(3, 400)))
        out.extend([(n, t), (n + 1, t.upper())])
        n += 2
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_are_those_of_brute_force(spark, rows, percent):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, percent).collect()}
    assert got == brute_near(rows, percent)


def test_edges_of_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "A b c d e f")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in near_duplicates(docs).collect())
    assert got == [("7", 7, True), ("7", 7, True), ("9", 7, False), ("None", None, True)]
    kept = keep_one_of_each_group(docs.selectExpr("*", "1 as kept", "2 as _gone2"))
    assert kept.columns == ["doc_id", "text", "kept", "_gone2"] and kept.where("doc_id = 9").count() == 0
    assert kept.where("doc_id = 7").count() == 1 and kept.where("doc_id is null").count() == 1
    same = docs.selectExpr("*", "1 as _gone", "2 as _GONE_", "map('a', 1) as m")
    assert sorted(str(r["doc_id"]) for r in keep_one_of_each_group(same).collect()) == ["7", "None"]

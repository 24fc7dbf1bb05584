import math
import random
from collections import Counter

import numpy as np
import pytest

from quantloom.llm.common import mix
from quantloom.llm.suffix import Powers, Runs, minimisers, repeated_passages
from quantloom.llm.topk import nra_block, top_k
from quantloom.llm.urls import ORDER, RULES, judge_urls


def brute_spans(docs, least):
    where = {}
    every = {i: (t or "").lower().split() for i, t in docs}
    for i, w in every.items():
        for a in range(len(w) - least + 1):
            where.setdefault(tuple(w[a : a + least]), set()).add(i)
    out = set()
    for i, w in every.items():
        hit = [a for a in range(len(w) - least + 1) if len(where[tuple(w[a : a + least])]) > 1]
        spans = []
        for a in hit:
            if spans and a <= spans[-1][1]:
                spans[-1][1] = a + least
            else:
                spans.append([a, a + least])
        out |= {(i, a, b) for a, b in spans}
    return out


def covered(spans):
    return {(i, x) for i, a, b in spans for x in range(a, b)}


def spans_of(df):
    return {(r["doc_id"], r["start_word"], r["end_word"]) for r in df.collect()}


def test_passages_are_those_of_brute_force(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(3000)}"
    common = [[word() for _ in range(n)] for n in (60, 55, 120, 49)]
    docs = []
    for i in range(120):
        t = [word() for _ in range(rng.randrange(200))]
        if i % 2:
            t += rng.choice(common) + [word() for _ in range(rng.randrange(80))]
        docs.append((i, " ".join(t)))
    docs += [(200, docs[1][1]), (201, None), (202, ""), (203, " ".join(common[2] + common[2])), (204, " ".join(common[0] * 40 + common[1] * 30))]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs] + [(None, docs[1][1], 1), (1, docs[1][1], 1)], "doc_id long, text string, start_word int").repartition(3)
    want = brute_spans(docs, 50)
    assert len(want) > 40
    for rows in (100_000, 40):  # borders of partitions on several levels
        assert covered(spans_of(repeated_passages(d, rows=rows))) == covered(want)
    assert repeated_passages(d.limit(0)).count() == 0


def slices(seed, kinds, length, longest):
    """Texts made of overlapping slices of four passages: partners that are nearest in neither order are common."""
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(kinds)}" for _ in range(length)] for _ in range(4)]
    docs = []
    for i in range(50):
        w = []
        for _ in range(rng.randrange(2, 5)):
            at = rng.randrange(length - 10)
            w += rng.choice(passages)[at : at + rng.randrange(5, longest)] + [f"w{rng.randrange(kinds)}" for _ in range(rng.choice([0, 0, 3, 8]))]
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("kinds, length, longest, least, window, gram", [(100_000, 300, 140, 50, 25, 8), (6, 60, 30, 16, 6, 4)])
def test_no_passage_of_overlapping_slices_is_missed(spark, seed, kinds, length, longest, least, window, gram):
    docs = slices(seed, kinds, length, longest)
    got = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), least, window, gram, rows=(100_000, 300, 60)[seed])
    assert covered(spans_of(got)) == covered(brute_spans(docs, least))


def test_a_doc_id_with_several_texts(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage, other = text(80), text(60)
    rows = [(1, f"{text(600)} {passage}"), (1, f"{text(3)} {passage}"), (2, f"{passage} {text(9)}"), (3, other), (3, other), (4, text(20))]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 3, 83, 80), (1, 600, 680, 80), (2, 0, 80, 80)]


def test_minimisers_are_the_first_least_of_each_window():
    rng = np.random.default_rng(0)
    for n, kinds in ((7, 9), (8, 9), (40, 2), (400, 50), (3000, 10**6)):
        h = mix(rng.integers(0, kinds, n).astype(np.uint64))
        runs = Runs(h, Powers())
        g = [int(runs.of(np.array([i]), 8)[0]) for i in range(n - 7)]
        want = {i + int(np.argmin(np.array(g[i : i + 25], np.uint64))) for i in range(max(1, len(g) - 24))} if g else set()
        assert minimisers(runs, n).tolist() == sorted(want)
        for i in range(0, n - 8, 7):
            assert g[i] == int(Runs(h[i : i + 8], Powers()).of(np.array([0]), 8)[0])


def brute_top(rows, every, k):
    v = {i: np.floor(256 * np.array(x, float)) for i, x in rows}
    out = []
    for q in v:
        if q % every == 0:
            s = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:k]
            out += [(q, r, c, -n) for r, (n, c) in enumerate(s, 1)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(230)] + [(300 + i, [1.0] * 12) for i in range(8)]
    bad = [(400, None), (450, [1.0, None] + [0.0] * 10), (500, [float("nan")] * 12), (550, [float("inf")] * 12), (None, [1.0] * 12), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows + bad], "vec_id long, embedding array<double>, score int")
    for c, q in ((1024, 1024), (40, 3)):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(df, candidates=c, queries=q).collect())
        assert got == brute_top(rows, 50, 5)
    assert top_k(df.limit(0)).count() == 0


def test_rows_that_repeat_a_vec_id(spark):
    rows = [(0, [1.0]), (0, [1.0]), (50, [-1.0]), (1, [0.5]), (1, [2.0]), (1, [2.0]), (2, [1.0])] + [(3, [0.25])] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(df).orderBy("query_id", "rank").collect()]
    one = [(0, 1, 1, 131072), (0, 2, 1, 131072), (0, 3, 2, 65536), (0, 4, 1, 32768), (0, 5, 3, 16384)]
    assert got == one + [(50, r, 3, -16384) for r in range(1, 6)]




def test_nra_stops_early_on_skewed_lists():
    x = np.zeros((400, 3))
    x[:, 0] = np.arange(400)
    x[:, 1:] = np.random.default_rng(0).integers(0, 5, (400, 2))
    q = np.array([[10.0, 1, 0], [-10, 0, 1]])
    for k in (1, 5):
        a, b, rows, s = nra_block(x, np.arange(400), q, np.array([-1, -2]), k)
        assert (b == rows).all()
        for j in (0, 1):
            score = x @ q[j]
            assert sorted(s[a == j]) == sorted(np.sort(score)[::-1][:k]) and all(score[int(c)] == v for c, v in zip(b[a == j], s[a == j], strict=True))


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def brute_urls(rows):
    out, data = {}, []
    for i, url in rows:
        host, path = split(url)
        fits = [(len(h) + len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, None, None)
        data.append((i, url or "", host, path, best[1], best[2]))
    grams = {c: Counter() for c in ("allow", "block")}
    seen = set()
    for _, url, _, _, _, v in data:
        line = "\x02" * ORDER + url + "\x03"
        for a in range(len(line) - ORDER):
            seen.add(line[a : a + ORDER + 1])
            if v:
                grams[v][line[a : a + ORDER + 1]] += 1
    alphabet = {g[-1] for g in seen}

    def prob(c, g):
        total, kinds = Counter(), {}
        p = None
        for k in range(ORDER + 1):
            n, t, a = 0, set(), 0
            ctx, s = g[ORDER - k : ORDER], g[ORDER - k :]
            for h, m in grams[c].items():
                if h[ORDER - k : ORDER] == ctx:
                    a += m
                    t.add(h[-1])
                    n += m if h[ORDER - k :] == s else 0
            low = 1 / (len(alphabet) + 1) if p is None else p
            p = (n + len(t) * low) / (a + len(t)) if a else low
        del total, kinds
        return p

    ratio = {g: math.log(prob("allow", g)) - math.log(prob("block", g)) for g in seen}
    score = {}
    for _, url, *_ in data:
        line = "\x02" * ORDER + url + "\x03"
        score[url] = round(np.mean([ratio[line[a : a + ORDER + 1]] for a in range(len(line) - ORDER)]), 9)
    facts = {c: [score[d[1]] for d in data if d[5] == c] for c in grams}
    m, s = {c: np.mean(v) for c, v in facts.items()}, {c: np.std(v) for c, v in facts.items()}
    line = (m["allow"] * s["block"] + m["block"] * s["allow"]) / (s["allow"] + s["block"])
    for i, url, host, path, rule, v in data:
        out[i] = (host, path, rule, v or ("allow" if score[url] >= line else "block"), score[url])
    return out


def test_urls(spark):
    rng = random.Random(2)
    hosts = ["www.example.com", "example.com", "EXAMPLE.com", "a.net", "b.org", "notexample.com", "com", "x.Example.org"]
    paths = ["/en/1", "/es/2?x=/fr/", "/fr/3#a", "", "/", "?q", "/de/é"]
    rows = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(150)] + [(900, None), (901, ""), (902, "no scheme"), (903, "http://"), (904, "a://b://c.com/x")]
    d = spark.createDataFrame([(i, u, "r") for i, u in rows], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(d).collect()}
    want = brute_urls(rows)
    assert got == {i: w[:4] for i, w in want.items()}
    assert {v[3] for v in got.values()} == {"allow", "block"}
    assert judge_urls(d.limit(0)).count() == 0
    assert {r["verdict"] for r in judge_urls(d.where("url like '%.org%'")).collect()} == {"allow"}

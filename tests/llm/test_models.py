import math
import random
from collections import Counter

import numpy as np
import pytest

from quantloom.llm.crossent import ALPHA, PRIOR, VOCABULARY, cross_entropy_difference, load_model, pair_model
from quantloom.llm.langid import SHORT, UNKNOWN, Lattice, LongWords, PieceIndex, accept_identified, fit, grouped, identify, load_vocabulary
from quantloom.llm.mixing import MOST_SLACK, SLACKS, SPREAD, TARGETS, TOLERANCE, fit_rates, mixed, mixing_rates, rates_after, train


def paths(word, p, at=0):
    """Sum over all segmentations, by recursion."""
    if at == len(word):
        return 1.0
    total = 0.0
    for j in range(at + 1, len(word) + 1):
        if word[at:j] in p:
            total += p[word[at:j]] * paths(word, p, j)
        elif j == at + 1:
            total += UNKNOWN * paths(word, p, j)
    return total


PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "bb"]


def test_forward_sums_all_segmentations():
    vocabulary = {w: i for i, w in enumerate(PIECES)}
    index = PieceIndex(vocabulary)
    p = np.random.default_rng(0).dirichlet(np.ones(len(PIECES)), 2).T
    words = ["▁abab", "▁aabb", "▁bxba"]
    for kind in (Lattice, LongWords):
        got = np.exp(kind(words, index).totals(p))
        for i, w in enumerate(words):
            for k in range(2):
                assert math.isclose(got[i, k], paths(w, {x: p[j, k] for x, j in vocabulary.items()}), rel_tol=1e-9)
    # EM does not lower the likelihood.
    counts = {w: np.array([3.0, 1.0]) for w in words}
    like = lambda q: sum((Lattice([w], index).totals(q)[0] * counts[w]).sum() for w in words)
    assert like(fit(counts, vocabulary, 2, 4)) >= like(fit(counts, vocabulary, 2, 1)) - 1e-6


def test_long_words_are_summed_whole():
    vocabulary = {w: i for i, w in enumerate(PIECES)}
    index = PieceIndex(vocabulary)
    rng = random.Random(1)
    p = np.random.default_rng(2).dirichlet(np.ones(len(PIECES)), 2).T
    ws = ["▁" + "".join(rng.choice("abx") for _ in range(n)) for n in (3, 9, 20, 23)]
    c = np.random.default_rng(3).integers(1, 9, (4, 2)).astype(float)
    long = LongWords(ws, index)
    assert np.allclose(long.totals(p), np.concatenate([Lattice([w], index).totals(p) for w in ws]), rtol=1e-12)
    assert np.allclose(long.expected(p, c), sum(Lattice([w], index).expected(p, c[i : i + 1]) for i, w in enumerate(ws)))
    assert np.allclose(long.seen(c, len(PIECES)), sum(Lattice([w], index).seen(c[i : i + 1], len(PIECES)) for i, w in enumerate(ws)))
    # A word beyond any double: the sum over all segmentations of n equal letters obeys a recurrence that logarithms carry.
    one = {"a": 0, "aa": 1}
    q = np.array([[0.3], [0.7]])
    n, a = 5000, [1.0, 0.3]
    scale = 0.0
    for _ in range(n - 1):
        a = [a[1], 0.3 * a[1] + 0.7 * a[0]]
        if a[1] < 1e-200:
            a, scale = [x * 1e200 for x in a], scale - 200 * math.log(10)
    assert math.isclose(LongWords(["a" * n], PieceIndex(one)).totals(q)[0, 0], math.log(a[1]) + scale, rel_tol=1e-9, abs_tol=1e-9)
    mixed = ["a" * k for k in (1, 5, SHORT, SHORT + 1, 60, 300)]
    assert sorted(w for g in grouped(mixed) for w in g) == sorted(mixed) and all(len(g[-1]) > SHORT or len({*map(len, g)}) == 1 for g in grouped(mixed))


def texts(n, seed):
    rng = random.Random(seed)
    stems = {"aa": ["the", "thing", "where", "ought", "shell"], "bb": ["der", "nicht", "schaft", "ungen", "ich"], "cc": ["le", "eaux", "quel", "ment", "oui"]}
    out = []
    for i in range(n):
        lang = rng.choice(list(stems))
        out.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(5, 60))), lang))
    return out


def test_language_id(spark):
    rows = texts(300, 1)
    extra = [(900, None, "aa"), (901, "", None), (902, "123 -- 4", "bb"), (903, "X" * 70_000, None), (None, "the thing where", None)]
    docs = spark.createDataFrame([(i, t, x, 0.5) for i, t, x in rows + extra], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    assert len(got) == 305
    held = [(i, x) for i, _, x in rows if got[i]["held_out"]]
    assert len(held) > 20 and np.mean([got[i]["lang_pred"] == x for i, x in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[None]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = accept_identified(docs)
    assert kept.columns == docs.columns and {900, 901, 902}.isdisjoint(r["doc_id"] for r in kept.collect()) and kept.count() >= 300
    assert kept.where("doc_id is null").count() == 1  # its text can be told
    none = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in identify(none).collect()} == {"und"} and identify(docs.limit(0)).count() == 0


def brute_losses(docs, target):
    """Losses from the definition, a text at a time, with the pieces that the vocabulary gives each word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    size = sp.get_piece_size()
    every = {i: [p for w in (t or "").encode().lower().split() for p in sp.encode(w.decode())] for i, t in docs}
    out = {i: {"n_tokens": len(x)} for i, x in every.items()}
    for side, ids in (("target", target), ("background", list(every))):
        uni, bi, ctx = Counter(), Counter(), Counter()
        for i in ids:
            for v, w in zip([size, *every[i]], every[i], strict=False):
                uni[w], bi[v, w], ctx[v] = uni[w] + 1, bi[v, w] + 1, ctx[v] + 1
        n = sum(uni.values())
        p = lambda v, w: (bi[v, w] + PRIOR * (uni[w] + ALPHA) / (n + ALPHA * size)) / (ctx[v] + PRIOR)  # noqa: B023, E731
        for v in [size, *list(uni)[:3], 7]:
            assert math.isclose(sum(p(v, w) for w in range(size)), 1, rel_tol=1e-9)
        for i, x in every.items():
            out[i][f"loss_{side}"] = -sum(math.log(p(v, w)) for v, w in zip([size, *x], x, strict=False)) / len(x) if x else None
    return out


def test_cross_entropy_difference(spark):
    rng = random.Random(2)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randrange(1, 6)))
    docs = [(i, " ".join(word("abcdefgh" if i % 3 else "aabbxyz") for _ in range(rng.randrange(1, 40)))) for i in range(60)] + [(70, None), (71, " "), (72, "É\u3000ﬁ \U0001f600!"), (73, "the word " * 3000)]
    target = list(range(0, 60, 3))
    d = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, is_target string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in [*target, 0, None]], "doc_id long")
    want = brute_losses(docs, target)
    for hot in (2_000_000, 40, 0):  # all pairs are sent; some are; none is
        got = {r["doc_id"]: r for r in cross_entropy_difference(d, ids, hot).collect()}
        assert len(got) == len(docs)
        for i, x in want.items():
            assert got[i]["n_tokens"] == x["n_tokens"]
            for k in ("loss_target", "loss_background"):
                assert got[i][k] is None if x[k] is None else math.isclose(got[i][k], x[k], rel_tol=1e-9), (i, k)
    assert np.mean([got[i]["score"] for i in target]) < np.mean([got[i]["score"] for i in range(60) if i not in target])
    assert cross_entropy_difference(d.limit(0), ids.limit(0)).count() == 0


def test_repeated_rows_are_scored_one_by_one(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a b"), (None, None), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    for hot in (100, 0):
        got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["loss_background"] or 0, 9)) for r in cross_entropy_difference(d, none, hot).collect())
        assert [x[:2] for x in got] == [("1", 1), ("1", 2), ("1", 2), ("None", 0), ("None", 0), ("None", 2)]
        assert got[1] == got[2] and got[5][2] == got[1][2]


def test_the_model_keeps_every_pair(spark):
    rows = [("common filler " * 50_000, False)] * 3 + [("rare gem", True), ("other find", False)]
    d = spark.createDataFrame(rows, "text string, is_target boolean")
    file = spark.sparkContext.broadcast(load_model())
    got = pair_model(d, file, 32_000)
    assert got.where("n_b = 1").count() >= 4 and got.agg({"n_b": "max"}).first()[0] > 100_000


def test_rates_are_those_of_plain_projected_gradient(spark):
    rng = np.random.default_rng(0)
    p, n = rng.dirichlet([0.3, 0.3, 0.3], 400), rng.integers(1, 500, 400)
    table = spark.createDataFrame([(int(k), [float(x) for x in r]) for k, r in zip(n, p, strict=True)], "n_tokens long, p array<double>").repartition(3)
    goal = np.array([0.6, 0.3, 0.1])
    w = n / n.sum()
    soft = np.minimum(MOST_SLACK, SLACKS[0] * np.maximum(w @ p, goal) ** 2)
    x = np.ones(400)
    for _ in range(20_000):
        x = np.maximum(0, x - 0.02 * ((x - 1) + p @ (((w * x) @ p - goal) / soft)))
    r = rates_after(p, fit_rates(table, goal, tolerance=0.5)[0])  # ends with the first slack
    assert (r >= 0).all() and np.abs(x - r).max() < 0.05
    r = rates_after(p, fit_rates(table, goal)[0])
    assert (np.abs((w * r) @ p - goal) <= TOLERANCE * np.maximum(w @ p, goal)).all()


def test_mixing(spark):
    rng = random.Random(3)
    kinds = {"clean": "river stone cloud", "low": "buy click now", "toxic": "vile worthless scum"}
    docs = [(i, " ".join(rng.choice(kinds[k].split()) for _ in range(40)), k) for i in range(200) for k in [rng.choice(list(kinds))]]
    labels = spark.createDataFrame([(i, int(k == "clean"), int(k == "toxic")) for i, _, k in docs if i % 2] + [(999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame([(i, t, 7) for i, t, _ in docs] + [(500, None, 7), (None, "river", 7)], "doc_id long, text string, rate int")
    got = {r["doc_id"]: r for r in mixing_rates(d, labels).collect()}
    right = [max(kinds, key=lambda c: got[i][f"p_{c}"]) == k for i, _, k in docs]
    assert np.mean(right) > 0.95
    tokens = {c: sum(got[i]["rate"] * got[i]["n_tokens"] * got[i][f"p_{c}"] for i, _, _ in docs) for c in kinds}
    total = sum(got[i]["n_tokens"] for i, _, _ in docs)
    assert abs(tokens["clean"] / total - 0.9) < 0.05 and tokens["toxic"] / total < 0.03
    out = mixed(d, labels)
    assert out.columns == d.columns and out.where("doc_id is null").count() == 1
    assert {r["rate"] for r in mixing_rates(d, labels.limit(0)).collect()} == {1.0} and mixing_rates(d.limit(0), labels).count() == 0


def newton_rates(p, w, goal):
    """The optimum of each slack by Newton's method on the dual, with the operator's rule for the slack; and what is left."""
    share = w @ p
    scale, most = np.maximum(share, goal), SPREAD * max(1.0, (goal**2 / share).sum())
    price, kept = np.zeros(len(goal)), np.ones(len(p))
    for slack in SLACKS:
        soft = np.minimum(MOST_SLACK, slack * scale**2)

        def dual(x):
            r = np.maximum(0, 1 - p @ x)
            return w @ (0.5 * (r - 1) ** 2 + r * (p @ x)) - x @ goal - 0.5 * soft @ x**2

        for _ in range(500):
            r = np.maximum(0, 1 - p @ price)
            slope = (w * r) @ p - goal - soft * price
            if np.abs(slope).max() < 1e-13:
                break
            step, t = np.linalg.solve((p * (w * (p @ price < 1))[:, None]).T @ p + np.diag(soft), slope), 1.0
            while dual(price + t * step) < dual(price) - 1e-15 and t > 1e-9:
                t /= 2
            price = price + t * step
        r = np.maximum(0, 1 - p @ price)
        if w @ r**2 > most:
            break
        kept = r
        if np.abs(((w * r) @ p - goal) / scale).max() <= TOLERANCE:
            break
    return kept, ((w * kept) @ p - goal) / scale


@pytest.mark.parametrize("mixed_up", [0.0, 0.35])
def test_the_whole_query_has_the_rates_of_newtons_method(spark, mixed_up):
    """Texts of their domain's words, or with a share of words of any domain, so that posteriors are soft and targets cannot be met."""
    rng = random.Random(8)
    kinds = {"clean": "river stone cloud field", "low": "buy click now cheap", "toxic": "vile worthless scum filth"}
    every = " ".join(kinds.values()).split()
    docs = [(i, " ".join(rng.choice(every if rng.random() < 2.4 * mixed_up else kinds[k].split()) for _ in range(rng.randrange(4, 30))), k) for i in range(600) for k in [rng.choices(list(kinds), (6, 3, 1))[0]]]
    labels = spark.createDataFrame([(i, int(k == "clean"), int(k == "toxic")) for i, _, k in docs], "doc_id long, quality int, toxic int")
    got = sorted(mixing_rates(spark.createDataFrame(docs, "doc_id long, text string, domain string"), labels).collect())
    p, n = np.array([[r["p_clean"], r["p_low"], r["p_toxic"]] for r in got]), np.array([r["n_tokens"] for r in got], float)
    want, left = newton_rates(p, n / n.sum(), np.array([TARGETS[d] for d in ("clean", "low", "toxic")]))
    rates = np.array([r["rate"] for r in got])
    assert {r["met"] for r in got} == {bool(np.abs(left).max() <= TOLERANCE)}
    assert np.abs(rates - want).max() < 0.1 and np.average(np.abs(rates - want), weights=n) < 0.02


def test_a_rare_domain_meets_its_target(spark):
    rng = np.random.default_rng(1)
    p = np.vstack([[0.98, 0.0199, 0.0001]] * 700 + [[0.03, 0.9699, 0.0001]] * 290 + [[0.01, 0.01, 0.98]] * 10)
    n = rng.integers(50, 500, 1000)
    table = spark.createDataFrame([(int(k), [float(x) for x in r]) for k, r in zip(n, p, strict=True)], "n_tokens long, p array<double>").repartition(3)
    goal = np.array([0.9, 0.1, 0.0])
    steps, left = fit_rates(table, goal)
    r = rates_after(p, steps)
    e, share = (r * n) @ p / n.sum(), n @ p / n.sum()
    assert np.allclose((e - goal) / np.maximum(share, goal), left) and np.abs(left).max() <= TOLERANCE
    assert r[-1] < 0.02 and (r >= 0).all()


def test_mixing_drops_one_toxic_document_in_a_hundred(spark):
    rng = random.Random(5)
    kinds = {"clean": "river stone cloud", "low": "buy click now", "toxic": "vile worthless scum"}
    docs = [(i, " ".join(rng.choice(kinds[k].split()) for _ in range(40)), k) for i in range(1000) for k in ["toxic" if i % 100 == 0 else "low" if i % 4 == 1 else "clean"]]
    labels = spark.createDataFrame([(i, int(k == "clean"), int(k == "toxic")) for i, _, k in docs], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    domains, _, _ = train(d, labels, 100)
    assert domains == ["clean", "low", "toxic"]
    got = mixing_rates(d, labels).collect()
    share = sum(r["n_tokens"] * r["p_toxic"] for r in got)
    assert sum(r["rate"] * r["n_tokens"] * r["p_toxic"] for r in got) < 0.1 * share
    toxic = {i for i, _, k in docs if k == "toxic"}
    assert max(r["rate"] for r in got if r["doc_id"] in toxic) < 0.05


def test_telling_features_take_little_memory_and_match_a_count():
    """The driver counts features one class after the other: no place is kept for each occurrence."""
    import tracemalloc

    from quantloom.llm.mixing import LEAST_DOCS, LEAST_Z, telling

    draw = np.random.default_rng(3)
    y = draw.integers(0, 3, 1500)
    per = [np.unique(np.concatenate([draw.integers(0, 400, 300) + 200 * y[i], draw.integers(0, 1 << 32, 100)])).astype(np.uint32) for i in range(len(y))]
    rows, flat = np.repeat(np.arange(len(y), dtype=np.int32), [len(p) for p in per]), np.concatenate(per)
    tracemalloc.start()
    got = telling(rows, flat, y, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * flat.nbytes
    seen = [Counter(flat[y[rows] == c].tolist()) for c in range(3)]
    share = np.bincount(y) / len(y)
    want = []
    for k in sorted(set().union(*seen)):
        m = np.array([s[k] for s in seen], float)
        z = (m - m.sum() * share) / np.sqrt(np.maximum(m.sum() * share * (1 - share), 1e-12))
        if m.sum() >= LEAST_DOCS and np.abs(z).max() >= LEAST_Z:
            want.append(k)
    assert want and got.tolist() == want
    assert len(telling(np.zeros(0, np.int32), np.zeros(0, np.uint32), np.array([0, 1]), 2)) == 0

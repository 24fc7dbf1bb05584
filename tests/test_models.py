import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import models as mo

DAY = date(2024, 1, 1)


@pytest.fixture(scope="module")
def table(spark):
    """120 dates, 12 codes; a planted return that follows `a`, fades with `b` and ignores `c`; one date with a null feature."""
    rng, rows = random.Random(4), []
    for i in range(120):
        for code in range(12):
            a, b, c = (rng.uniform(0, 100) for _ in range(3))
            r = (a - 50) / 25 - (b - 50) / 50 + (a - 50) * (c - 50) / 1500 + rng.gauss(0, 0.5)
            rows.append((DAY + timedelta(days=i), code, round(r, 6), a, b, None if (i, code) == (7, 3) else c))
    return spark.createDataFrame(rows, "trade_date date, code long, net_return double, a double, b double, c double").cache()


def pandas_of(df):
    return df.toPandas().sort_values(["trade_date", "code"]).reset_index(drop=True)


def brute_objective(top):
    """top: list of (date, net, excess)."""
    net, exc = np.array([t[1] for t in top]), np.array([t[2] for t in top])
    win, avg = round(float((exc > 0).mean() * 100), 2), round(float(exc.mean()), 4)
    down = [round(x, 4) for x in net if round(x, 4) < 0]
    sd = np.std(down, ddof=1) if len(down) >= 2 else (-avg * 2 if avg < 0 else 2.0)
    sortino = round(avg / sd, 6) if sd > 1e-8 else 0.0
    age = np.array([(max(t[0] for t in top) - t[0]).days for t in top])
    rate = [((net > 0) * 0.5 ** (age / h)).sum() / (0.5 ** (age / h)).sum() * 100 for h in (60, 30)]
    decay = round(max(0.75, min(1.25, 1 + max(-20, min(20, rate[1] - rate[0])) / 100)), 6)
    return round((win + 2 * avg + 0.5 * sortino) * decay, 6)


def brute_evaluate(p, weights, k):
    top = []
    for d, g in p.groupby("trade_date"):
        med = g["net_return"].median()
        score = sum(g[c].fillna(0) * w for c, w in weights.items())
        order = sorted(zip(-score, g["code"], g["net_return"]))[:k]
        top += [(d, r, r - med) for _, _, r in order]
    return brute_objective(top)


def brute_search(p, initial, k, steps):
    best = mo.normalised(initial)
    value, rounds = brute_evaluate(p, best, k), 0
    for _ in range(steps):
        gained, rounds = False, rounds + 1
        for c in initial:
            for by in (0.7, 1.3):
                w = mo.normalised({**best, c: best[c] * by})
                v = brute_evaluate(p, w, k)
                if v > value + 1e-9:
                    best, value, gained = w, v, True
        if not gained:
            break
    return best, value, rounds


def test_coordinate_search_equals_the_loop(spark, table):
    t = table.fillna(0.0)
    start = {"a": 0.3, "b": 0.4, "c": 0.3}
    half = F.when(F.col("trade_date") < DAY + timedelta(days=50), "early").otherwise("late")
    s = t.withColumn("grp", F.explode(F.array(F.lit("all"), half)))
    got = {r["grp"]: r for r in mo.coordinate_search(s, ["a", "b", "c"], start, k=3, steps=6).collect()}
    p = pandas_of(t)
    cut = DAY + timedelta(days=50)
    for name, part in (("all", p), ("early", p[p.trade_date < cut]), ("late", p[p.trade_date >= cut])):
        weights, value, rounds = brute_search(part, start, 3, 6)
        assert {c: got[name][c] for c in start} == weights and got[name]["objective"] == pytest.approx(value, abs=1e-5) and got[name]["rounds"] == rounds
    assert got["all"]["a"] > 0.4 > 0.2 > got["all"]["b"] and got["all"]["objective"] > got["all"]["start"]
    assert mo.coordinate_search(s.limit(0), ["a", "b", "c"], start).count() == 0


def test_walk_forward_search_beats_bad_weights(spark, table):
    out = mo.walk_forward_search(table.fillna(0.0), ["a", "b", "c"], {"a": 0.1, "b": 0.6, "c": 0.3}, k=3, steps=8, folds=3, purge=2).orderBy("fold").collect()
    assert [r["fold"] for r in out] == [1, 2, 3] and all(r["improvement"] > 0 for r in out)


def test_expanding_folds(spark):
    for n, folds, purge in ((23, 4, 2), (10, 4, 5), (3, 4, 0), (2, 4, 0), (0, 4, 0)):
        dates = [DAY + timedelta(days=i) for i in range(n)]
        df = spark.createDataFrame([(d,) for d in dates] * 2, "trade_date date")
        got = sorted((r["fold"], r["part"], r["trade_date"]) for r in mo.expanding_folds(df, folds, purge).collect())
        want, count = [], min(folds, n - 1)
        size = max(1, n // (count + 1)) if n >= 3 else 0
        for f in range(count if n >= 3 else 0):
            end = n - size * (count - f)
            if end - purge > 0:
                want += [(f + 1, "train", d) for d in dates[: end - purge]] + [(f + 1, "test", d) for d in dates[end : end + size]]
        assert got == sorted(want)


def test_interaction_terms_find_the_planted_pair(spark, table):
    s = mo.with_excess(table.fillna(50.0), ["trade_date"]).withColumn("fold", F.lit(1))
    terms = {r["pair"]: r for r in mo.interaction_terms(s, ["a", "b", "c"]).collect()}
    best = max(terms.values(), key=lambda r: abs(r["correlation"]))
    assert best["pair"] == "a*c" and best["n"] == 1440
    p = s.toPandas()
    x = ((p.a - 50) / 50) * ((p.c - 50) / 50)
    assert best["coefficient"] == pytest.approx(np.cov(x, p.excess, ddof=0)[0, 1] / x.var(ddof=0), abs=1e-5)
    capped = mo.interaction_scores(s.withColumn("score", F.lit(95.0)), mo.interaction_terms(s, ["a", "b", "c"]), ["a", "b", "c"])
    low, high = capped.agg(F.min("challenger"), F.max("challenger")).first()
    assert low >= 83 and high <= 100
    few = mo.interaction_terms(s.limit(10), ["a", "b", "c"])
    assert few.count() == 0 and mo.interaction_scores(s.withColumn("score", F.lit(1.0)), few, ["a", "b", "c"]).where("challenger <> 1").count() == 0


def test_ladder_promotes_a_better_challenger_only(spark, table):
    base = mo.with_excess(table, ["trade_date"]).withColumn("fold", F.lit(1) + (F.date_diff("trade_date", F.lit(DAY)) / 40).cast("long"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), v.alias("rank_score")) for n, v in (("baseline", F.col("b")), ("good", F.col("a") - F.col("b") / 2), ("same", F.col("b")), ("bad", F.col("b") - F.col("a")))]))
    got = {r["variant"]: r for r in mo.ladder(base.withColumn("_e", each).select("fold", "trade_date", "code", "net_return", "excess", "_e.*"), 3, draws=200).collect()}
    assert got["good"]["status"] == "oos_passed" and got["good"]["positive_folds"] == got["good"]["folds"] == 3
    assert got["same"]["status"] == got["bad"]["status"] == "shadow_only" and got["bad"]["p_value"] == 1.0


def brute_models(p, cols, first, every):
    days = {d: i for i, d in enumerate(sorted(p.trade_date.unique()))}
    day = p.trade_date.map(days).to_numpy()
    x = np.column_stack([np.ones(len(p)), p[cols].fillna(0).to_numpy(float)])
    y, up = p.net_return.to_numpy(), (p.net_return > 0).to_numpy(float)
    pen = 0.01 * np.r_[0.0, np.ones(len(cols))]
    prob, ret = np.full(len(p), np.nan), np.full(len(p), np.nan)
    for r in range(first, len(days), every):
        t, use = day < r, (day >= r) & (day < r + every)
        ridge = np.linalg.pinv(x[t].T @ x[t] + np.diag(pen)) @ x[t].T @ y[t]
        beta = np.zeros(x.shape[1])
        for _ in range(50):
            q = 1 / (1 + np.exp(-x[t] @ beta))
            beta -= np.linalg.solve((x[t].T * (q * (1 - q))) @ x[t] / t.sum() + np.diag(pen), x[t].T @ (q - up[t]) / t.sum() + pen * beta)
        prob[use], ret[use] = 1 / (1 + np.exp(-x[use] @ beta)), x[use] @ ridge
    return day, prob, ret


def test_walk_forward_models_equal_brute_force(spark, table):
    scaled = table.select("trade_date", "code", "net_return", *[(F.col(c) / 100).alias(c) for c in "abc"])
    got = pandas_of(mo.walk_forward_models(scaled, ["a", "b", "c"], ["a"], least_days=40, every=7))
    p = pandas_of(scaled)
    for tag, cols in (("", ["a", "b", "c"]), ("ablation_", ["a"])):
        day, prob, ret = brute_models(p, cols, 40, 7)
        late = day >= 40
        assert len(got) == late.sum()
        assert np.allclose(got[f"{tag}probability"], prob[late], atol=1e-7) and np.allclose(got[f"{tag}expected_return"], ret[late], atol=1e-8)
        assert np.allclose(got[f"{tag}rank_key"], (prob * ret)[late], atol=1e-7)
    assert mo.walk_forward_models(scaled, ["a"], ["a"], least_days=500).count() == 0


def test_counterfactual_days(spark):
    rows = [(DAY + timedelta(days=i), c, r, sel, loc, key, abl) for i in range(2) for c, r, sel, loc, key, abl in ((1, 3.0, True, 9.0, 0.1, 0.0), (2, -6.0, True, 8.0, 0.2, 0.9), (3, 1.5, False, 99.0, 0.9, 0.8), (4, 0.0, True, 1.0, 0.2, 0.1))]
    df = spark.createDataFrame(rows, "trade_date date, code long, net_return double, selected boolean, local double, rank_key double, ablation_rank_key double")
    a, b = mo.counterfactual_days(df, "selected", "local", 2).orderBy("trade_date").collect()
    assert (a["local_return"], a["challenger_return"], a["ablation_return"], a["replacements"], a["increment"], a["ablation_increment"]) == (-1.5, -2.25, -2.25, "3", -0.75, 0.0)
    assert a["local_max_drawdown"] == -1.5 and b["local_max_drawdown"] == pytest.approx((0.985**2 - 1) * 100, abs=1e-6)

"""Queries against all rows of their block in small units: counts of bins and cuts, and sums with the rows of the last cut."""

from __future__ import annotations

import numpy as np

from quantloom.operators import peers as pr


def test_units_of_any_size_count_every_pair_once(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 2, i, i % 9, 1.0, float(rng.integers(-5, 5)), 0.0, float(rng.integers(0, 9)), None if i % 7 == 0 else float(rng.integers(0, 4))) for i in range(90)]
    asks = [(k % 3, k, float(rng.integers(0, 9)), None if k % 4 == 0 else float(rng.integers(0, 4))) for k in range(11)]
    t = pr.packed(spark.createDataFrame(rows, "block int, train_id long, age int, w double, r double, dd double, x double, y double"), "block", "train_id", 7, "t")
    q = pr.packed(spark.createDataFrame(asks, "block int, query_id long, x double, y double"), "block", "query_id", 3, "q")
    features = {"x": (2.0, 1.5), "y": (1.0, 1.0)}
    got = {}
    for r in pr.compared(t, q, "block", features, 1, spark.range(1).schema["id"].dataType, "bins").collect():
        got[r["query_id"], r["bin"]] = got.get((r["query_id"], r["bin"]), 0) + r["n"]
    want = {}
    for block, k, x, y in asks:
        for row in rows:
            if row[0] == block:
                parts = [((a - b) / s) ** 2 * w for a, b, s, w in ((x, row[6], 2.0, 1.5), (y, row[7], 1.0, 1.0)) if a is not None and b is not None]
                d = np.floor(sum(parts) / (2.5 if len(parts) == 2 else 1.5) * 1e9 + 0.5)
                key = k, int(np.array([d], np.float32).view(np.int32)[0] >> pr.SHIFT)
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_bins_and_cuts_are_in_the_order_of_the_distances():
    d = np.sort(np.concatenate([np.arange(0, 3000.0), 10 ** np.linspace(3, 13, 5000)]).round())
    key = pr.bin_of(d[None, :])[0]
    part = pr.cut_of(d, key)
    assert (np.diff(key) >= 0).all() and (np.diff(key.astype(np.int64) * pr.CUTS + part) >= 0).all() and pr.bin_of(np.array([[-1.0]]))[0, 0] == pr.NONE


FEATURES = {"x": (2.0, 1.5), "y": (1.0, 1.0), "z": (5.0, 0.2)}


def _random(seed: int, n: int, m: int):
    rng = np.random.default_rng(seed)
    ys = [rng.normal(0, 3, n), rng.integers(0, 9, n).astype(float), np.where(rng.random(n) < 0.1, np.nan, rng.random(n) * 40)]
    return rng, ys, [rng.normal(0, 3, m), rng.integers(0, 9, m).astype(float), np.where(np.arange(m) % 3 == 0, np.nan, rng.random(m) * 40)]


def test_tiles_count_and_sum_what_all_pairs_do():
    rng, ys, xs = _random(3, 3000, 40)
    fs, ids = list(FEATURES.values()), rng.permutation(3000)
    for least in (2, 3):
        s, d = pr.Slice(ys, ids, fs, least), pr.distances(xs, ys, fs, least)
        low, high = np.full(40, 3e8), np.full(40, 9e8)
        got, inside = s.counts(xs, low, high), (d >= 3e8) & (d < 9e8)
        assert (got[:, 0] == (d >= 0).sum(axis=1)).all() and (got[:, 1] == ((d >= 0) & (d < 3e8)).sum(axis=1)).all()
        part = pr.part_of(d, low[:, None], high[:, None])
        assert all((got[i, 2:] == np.bincount(part[i, inside[i]], minlength=pr.CUTS)).all() for i in range(40))
        cut, left = np.full(40, 7), np.full(40, 3)
        found = sorted(zip(*(v.tolist() for v in s.last(xs, low, high, cut, left))))
        assert found == sorted((i, *x) for i in range(40) for x in sorted((d[i, j], ids[j]) for j in np.flatnonzero(inside[i] & (part[i] == 7)))[:3])
        limit = np.where((d >= 0).any(axis=1), np.median(d, axis=1), 0.0)
        limit = np.array([d[i, np.argmin(np.abs(d[i] - limit[i]))] for i in range(40)])
        end = np.full(40, 1500)
        near = (d >= 0) & ((d < limit[:, None]) | ((d == limit[:, None]) & (ids <= 1500)))
        w, key, age = rng.random(3000), rng.integers(0, 5, 3000), rng.integers(0, 99, 3000).astype(float)
        sums, young = s.near(xs, limit, end, w[:, None], key, w, 5, age)
        assert np.allclose(sums, np.column_stack([near @ w, *(near[:, key == k] @ w[key == k] for k in range(5))]))
        assert (young == np.where(near, age, np.inf).min(axis=1)).all()


def test_sums_come_back_as_one_matrix_whatever_the_returns(spark):
    """A row for each query, unit and bin of returns filled the disk: 3,000 rows of as many returns gave some 40 rows a query."""
    rng, ys, xs = _random(4, 3000, 40)
    rows = [(1, i, i % 9, 0.5, float(rng.normal(0, 5)), 0.0, *(float(y[i]) for y in ys)) for i in range(3000)]
    asks = [(1, k, *(float(x[k]) for x in xs), 9e8, 3000, 0) for k in range(40)]
    t = pr.packed(spark.createDataFrame(rows, "block int, train_id long, age int, w double, r double, dd double, x double, y double, z double"), "block", "train_id", 1000, "t")
    q = pr.packed(spark.createDataFrame(asks, "block int, query_id long, x double, y double, z double, limit double, last long, own long"), "block", "query_id", pr.QUERIES, "q")
    out = pr.compared(t, q, "block", FEATURES, 2, spark.range(1).schema["id"].dataType, "sums", np.sort([r[4] for r in rows]))
    assert out.count() == 3
    near = pr.distances(xs, ys, list(FEATURES.values()), 2)
    near = (near >= 0) & (near <= 9e8)
    got = {r["query_id"]: (r["peers"], round(r["wr"], 9)) for r in pr.summed(out, spark.range(1).schema["id"].dataType).collect()}
    assert got == {k: (int(near[k].sum()), round(float(sum(0.5 * r[4] for r, n in zip(rows, near[k]) if n)), 9)) for k in range(40) if near[k].any()}

"""What a step shuffles and how often: the same rows whatever the size, without copies of rows or joins back."""

from __future__ import annotations

import time
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from quantloom.operators import crosssection as cs
from quantloom.operators import execution as ex
from quantloom.operators import joins as jn
from quantloom.operators import models as mo
from quantloom.operators import replay as rp
from quantloom.operators import validation as va
from quantloom.plans.registry import queries
from quantloom.sources import tables as tb


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def test_percentiles_copy_no_rows_and_score_repeated_keys(spark):
    rows = [(1, "a", 1.0, 5.0, True), (1, "a", 2.0, 5.0, True), (1, "b", 4.0, 5.0, False), (1, "c", 3.0, None, True), (2, "d", 7.0, 1.0, True)]
    d = spark.createDataFrame(rows, "day long, id string, v double, u double, ready boolean")
    out = cs.percentile_scores(d, ["day"], ["v", "u"], F.col("ready"), inverse=("u",), key=("day", "id"))
    logical, _ = _plan(out)
    assert "Join" not in logical and "Generate" not in logical
    got = sorted((r["day"], r["id"], r["v"], round(r["v_pct"], 6), r["u_pct"]) for r in out.collect())
    third = 100 / 3
    assert got == [(1, "a", 1.0, round(third, 6), 50.0), (1, "a", 2.0, round(2 * third, 6), 50.0), (1, "b", 4.0, 100.0, 50.0), (1, "c", 3.0, 100.0, 50.0), (2, "d", 7.0, 50.0, 50.0)]


def test_outcomes_make_no_row_for_a_bar_ahead_and_join_nothing(spark):
    """One shuffle by code and a fold of each signal's bars: what is shuffled does not grow with the days looked ahead."""
    bars = [("c", date(2020, 1, 1) + timedelta(days=i), 10.0, 10.0 + i / 10, 10.0, 10.0 + i / 20, 1.0, 1e9) for i in range(12)] + [("e", date(2020, 1, 5), 5.0, 5.0, 5.0, 5.0, 1.0, 1e9)]
    b = spark.createDataFrame(bars, "code string, trade_date date, open double, high double, low double, close double, volume double, turnover double")
    rows = [(1, "s", date(2020, 1, 2), "c", 1.0, 1), (2, "s", date(2020, 1, 2), "c", 1.0, 2), (3, "s", date(2019, 1, 1), "c", 1.0, 1), (4, "s", date(2020, 1, 11), "c", 1.0, 1), (5, "s", date(2020, 2, 1), "e", 1.0, 1), (6, "s", date(2020, 2, 1), "z", 1.0, 1)]
    s = spark.createDataFrame(rows, "signal_id long, strategy string, signal_date date, code string, score double, rank long")
    out = ex.outcomes(s, b)
    logical, _ = _plan(out)
    assert "Join" not in logical and "Generate" not in logical
    got = {r["signal_id"]: (r["state"], r["entry_price"], r["exit_reason"], r["exit_days"], r["return_1d"]) for r in out.collect()}
    up = (10.1 / 10.05 - 1) * 100
    assert got == {1: ("settled", 10.05, "hold_to_term", 3, up), 2: ("settled", 10.05, "hold_to_term", 3, up), 3: ("no_bars", None, None, None, None), 4: ("pending", 10.5, None, None, (10.55 / 10.5 - 1) * 100), 5: ("pending", 5.0, None, None, None), 6: ("no_bars", None, None, None, None)}


def _brute(queries, train, features, k, least_shared):
    out = {}
    for qid, qb, *q in queries:
        near = []
        for tid, tb, *t in train:
            both = [(x, y, s, w) for x, y, (s, w) in zip(q, t, features.values(), strict=True) if x is not None and y is not None]
            if qb == tb and len(both) >= least_shared:
                near.append((round(sum(((x - y) / s) ** 2 * w for x, y, s, w in both) / sum(w for *_, w in both), 9), tid))
        out[qid] = [t for _, t in sorted(near)[:k]]
    return {q: v for q, v in out.items() if v}


def test_nearest_is_brute_force_on_clusters_outliers_and_missing_features(spark):
    rng, features = np.random.default_rng(3), {"a": (10.0, 1.0), "b": (100.0, 2.0)}
    for least in (1, 2):
        rows = []
        for i in range(360):
            a, b = (float(rng.integers(0, 9)), float(rng.normal(0, 40))) if i % 3 else (float(rng.normal(50, 0.1)), 7.0)
            rows.append((i, "xyz"[i % 3 if i % 7 else 2], a if i % 11 else None, b if i % 13 else None))
        rows += [(900, "x", 1e6, 3.0), (901, "y", -5e4, 0.0), (902, "w", 1.0, 1.0), (903, "w", 1.0, None), (904, "x", None, None), (905, None, 1.0, 1.0), *((1000 + i, "x", 3.0, 3.0) for i in range(20))]
        q, t = [r for r in rows if r[0] % 4 == 0 or r[0] == 902], [r for r in rows if r[0] % 4 and r[0] != 902]
        got = {}
        for r in jn.nearest(spark.createDataFrame(q, "query_id long, blk string, a double, b double"), spark.createDataFrame(t, "train_id long, blk string, a double, b double"), "blk", features, 3, least).orderBy("query_id", "near").collect():
            got.setdefault(r["query_id"], []).append(r["train_id"])
        want = _brute([r for r in q if r[1]], [r for r in t if r[1]], features, 3, least)
        assert got == want


def test_nearest_of_a_hot_block_compares_few_of_its_pairs(spark):
    """80,000 x 80,000 rows of one block, of which all pairs took many minutes."""
    n, x = 80_000, (F.col("id") * 7919 % 100_003).cast("double")
    d = spark.range(n).select("id", F.lit("x").alias("blk"), x.alias("a"), (F.col("id") * 104_729 % 100_019).cast("double").alias("b"))
    at = time.monotonic()
    out = jn.nearest(d.withColumnRenamed("id", "query_id"), d.withColumnRenamed("id", "train_id"), "blk", {"a": (10.0, 1.0), "b": (10.0, 1.0)}, 1)
    assert out.where("near = 1 and query_id = train_id and distance = 0").count() == n and time.monotonic() - at < 120


def test_pooled_ranks_come_from_several_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(float(rng.integers(-40, 40)), float(rng.normal()), float(rng.integers(0, 30))) for _ in range(2000)]
    d = spark.createDataFrame(rows, "f double, g double, r double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranks = va.spread_ranks(d.withColumn("pool", F.lit("all")), ["pool"], "f")
        got = {r["f"]: r["rank"] for r in ranks.collect()}
        pooled = sorted((r["factor"], r["n"], round(r["ic"], 9)) for r in va.pooled_rank_ic(d, ["f", "g"], "r").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    f = np.array([r[0] for r in rows])
    assert got == {v: float((f < v).sum() + ((f == v).sum() + 1) / 2) for v in set(f.tolist())}
    assert pooled == sorted((r["factor"], r["n"], round(r["ic"], 9)) for r in va.daily_rank_ic(d.withColumn("pool", F.lit("all")), ["f", "g"], "r", "pool").collect())


def test_a_search_sorts_the_best_of_each_batch_not_copies_of_all_samples(spark):
    """A row for each sample and candidate is neither made nor sorted; ties, missing and undefined scores stand where Spark puts them."""
    rng = np.random.default_rng(5)
    rows = [(g, date(2024, 1, 1) + timedelta(d), f"c{c:03d}", float(rng.normal()), 0.0, None if c % 50 == 7 else float(rng.integers(0, 4)), float("nan") if (c, d) == (3, 1) else float(rng.integers(0, 3))) for g in ("a", "b") for d in range(3) for c in rng.permutation(200)]
    rng.shuffle(rows)
    s = spark.createDataFrame([tuple(r) for r in rows], "grp string, trade_date date, code string, net_return double, excess double, x double, y double").repartition(3)
    tried = {"a": [("low", [0.3, 0.7]), ("high", [0.5, 0.5])], "b": [("low", [0.9, 0.1])]}
    top = mo._top_candidates(s, tried, ["x", "y"], 5)
    logical, _ = _plan(top)
    assert "Generate" not in logical and "Join" not in logical and "MapInArrow" in logical
    each = spark.createDataFrame([(g, n, *w) for g, c in tried.items() for n, w in c], "grp string, candidate string, w_x double, w_y double")
    want = mo.top_rows(s.join(each, "grp"), ["grp", "candidate"], mo.weighted_score(["x", "y"]), 5)
    cols = ["grp", "candidate", "trade_date", "code", "net_return"]
    assert sorted(map(tuple, top.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    few = mo._top_candidates(s.where("code < 'c003'"), tried, ["x", "y"], 5)
    assert few.count() == 3 * 3 * 3


def test_newtons_rounds_start_from_few_rows_and_end_on_all(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=60_000)
    rows = [(int(i * 10 // 60_000), float(v), bool(u)) for i, (v, u) in enumerate(zip(x, rng.random(60_000) < 1 / (1 + np.exp(-0.3 - 0.8 * x)), strict=True))]
    s = spark.createDataFrame(rows, "day long, x double, up boolean")
    refits, sizes = np.array([6, 8]), []
    from_zero = mo.logistic_by_refit(s, ["x"], "up", refits, tolerance=1e-12)
    kind = type(s)
    plain = kind.mapInPandas
    try:
        kind.mapInPandas = lambda d, *a, **k: (sizes.append(d.count()), plain(d, *a, **k))[1]
        got = mo.logistic_by_refit(s, ["x"], "up", refits)
    finally:
        kind.mapInPandas = plain
    assert sum(n == 60_000 for n in sizes) <= 4 and sum(n < 6_000 for n in sizes) >= 2
    for r, beta in zip(refits, got, strict=True):
        t = np.array([d < r for d, _, _ in rows])
        z, y = np.column_stack([np.ones(t.sum()), x[t]]), np.array([u for _, _, u in rows], float)[t]
        g = z.T @ (1 / (1 + np.exp(-z @ beta)) - y) / t.sum() + mo.RIDGE * np.array([0.0, beta[1]])
        assert np.abs(g).max() < 1e-9
    assert np.allclose(got, from_zero, atol=1e-9)


def test_outcomes_shuffle_lines_once_by_code(spark, tmp_path):
    """Lines are not folded before their shuffle, bars not dealt again by code, and each block of bars is collected once."""
    rows = [(i, 1, i % 3, 1, 1.0, 100.0 + i % 7, date(2020, 1, 1) + timedelta(days=i // 3)) for i in range(120)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    b = tb.bars(spark, str(tmp_path))
    s = spark.createDataFrame([(k, date(2019, 12, 31) + timedelta(days=k), k % 4, 1.0) for k in range(44)], "signal_id long, signal_date date, code long, score double")
    f = ex.with_future(s, b, 20)
    assert f._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # lines and signals
    held = {}
    for r in b.orderBy("code", "trade_date").collect():
        held.setdefault(r["code"], []).append((r["trade_date"], r["close"]))
    for r in f.collect():
        mine = held.get(r["code"], [])
        n = sum(d <= r["signal_date"] for d, _ in mine)
        assert (r["idx"], r["entry_price"]) == (n, mine[n - 1][1] if n else None)
        assert [(x["step"], x["trade_date"], x["close"]) for x in r["future"]] == [(n + i, *x) for i, x in enumerate(mine[n : n + 20], 1)]
        assert [x["prev_close"] for x in r["future"]] == [mine[n + i - 1][1] if n + i else None for i in range(len(r["future"]))]


def test_exit_fold_ends_with_the_position(spark):
    """Bars after the holding days neither trigger nor are compared, and the order of a future needs no comparison in lambdas."""
    day = date(2020, 1, 1)
    bars = spark.createDataFrame([(1, day + timedelta(days=k), *[100.0 if k < 5 else 50.0] * 4, 1.0, 1e9) for k in range(30)], "code long, trade_date date, open double, high double, low double, close double, volume double, turnover double")
    out = ex.with_exit(ex.with_future(spark.createDataFrame([(1, 1, day)], "signal_id long, code long, signal_date date"), bars, 15))
    r = out.select("exit.*").first()
    assert (r["exit_reason"], r["exit_price"], r["exit_days"]) == ("hold_to_term", 100.0, 3)
    plan, _ = _plan(out)
    assert "sort_array(" in plan and "array_sort(" not in plan


def test_replay_makes_its_rows_once(spark):
    """The regime of a date comes from its own partition, as market_regime has it: bars are not made again for it."""
    i = F.col("id")
    close = 100 + (i * 37 % 11) + (i % 40) * 0.5
    bars = spark.range(240).select((i % 4).alias("code"), F.date_add(F.lit("2020-01-01"), (i / 4).cast("int")).alias("trade_date"), close.alias("open"), (close + 1).alias("high"), (close - 1).alias("low"), close.alias("close"), F.lit(1e6).alias("volume"), F.lit(1e9).alias("turnover"))
    names = spark.createDataFrame([(k, f"60000{k}", f"n{k}") for k in range(4)], "code long, symbol string, name string")
    plan = rp.replay_rows(bars, names, 1e6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
    q = spark.range(240).select(F.date_add(F.lit("2020-01-01"), (i % 9).cast("int")).alias("trade_date"), F.when(i % 7 > 0, i % 29 - 8.0 - i % 9).alias("pct_chg"), (i % 17 * 1.0).alias("amplitude"), F.lit(1.0).alias("turnover"))
    want = {r["trade_date"]: r["level"] for r in cs.market_regime(q).collect()}
    got = {(r["trade_date"], r["level"]) for r in cs.with_market_level(q).collect()}
    assert got == set(want.items()) and len(set(want.values())) > 1


def test_percentiles_at_once_are_those_of_sorted_rows(spark):
    """One shuffle and no sort of rows by a value; missing and undefined values, members and rows without a group as before."""
    rng = np.random.default_rng(8)
    rows = [(None if i % 50 == 0 else i % 4, i, None if i % 11 == 0 else float("nan") if i % 37 == 0 else float(rng.integers(0, 30)), float(rng.normal()) if i % 4 else 2.0, None if i % 13 == 0 else i % 3 > 0) for i in range(400)] + [(9, 999, 1.0, 1.0, True)]
    d = spark.createDataFrame(rows, "day int, id int, v double, u double, ready boolean")
    out = cs.percentiles_at_once(d, ["day"], ["v", "u"], {"u": "ready"}, inverse=("v",))
    logical, physical = _plan(out)
    assert "Join" not in logical and "Window" not in logical and physical.count("FlatMapGroupsInArrow") == 1
    want = cs.percentile_scores(cs.percentile_scores(d, ["day"], ["v"], inverse=("v",)), ["day"], ["u"], F.col("ready"))
    assert sorted((r["id"], r["v_pct"], r["u_pct"]) for r in out.collect()) == sorted((r["id"], r["v_pct"], r["u_pct"]) for r in want.collect())


def test_next_day_rows_are_shuffled_by_code_and_by_date_only(spark):
    """Quotes and factors are made side by side, not joined, and no value's sort takes whole rows."""
    plan = queries()["x4_tomorrow_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan and plan.count("FlatMapGroupsInArrow") == 1


def test_groups_that_share_dates_keep_their_rows_once(spark, monkeypatch):
    """All dates and a regime's dates are two groups of the same rows; a row for each group and a join with the medians were written."""
    rng, made, write = np.random.default_rng(6), [], mo.written
    rows = [(["all", "up" if d % 3 else "down"], date(2024, 1, 1) + timedelta(d), c, float(rng.normal(x / 50, 1)), float(x), float(rng.integers(0, 100))) for d in range(12) for c in range(25) for x in [rng.integers(0, 100)]]
    s = spark.createDataFrame(rows, "grp array<string>, trade_date date, code int, net_return double, a double, b double").repartition(3)
    monkeypatch.setattr(mo, "written", lambda df, name: made.append(df) or write(df, name))
    got = mo.coordinate_search(s, ["a", "b"], {"a": 0.5, "b": 0.5}, k=4).orderBy("grp").collect()
    assert made[0].count() == len(rows) and "Join" not in made[0]._jdf.queryExecution().optimizedPlan().toString()
    want = mo.coordinate_search(s.withColumn("grp", F.explode("grp")), ["a", "b"], {"a": 0.5, "b": 0.5}, k=4).orderBy("grp").collect()
    assert got == want and [r["grp"] for r in got] == ["all", "down", "up"]

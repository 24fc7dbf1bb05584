"""Fitting in Spark: weight search, challenger ladder, and expanding-window models for all refit dates at once.

Samples are rows (trade_date, code, net_return, score columns). Every fold, regime, candidate or refit date is a key of the
same job; the driver holds a few numbers for each of them (weights, coefficients), never samples.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from ..functions.scalars import nonzero
from ..sources.shared import written
from .stats import benjamini_hochberg, bootstrap_p_value, deflated_sharpe, net_asset_value

# Fixed values of the search, the objective and the interaction terms.
FACTORS = (0.7, 1.3)
LEAST_WEIGHT, MOST_WEIGHT = 0.01, 0.75
HALF_LIFE = 60
LEAST_GAIN = 1e-9
LEAST_SAMPLES, LEAST_CORRELATION, MOST_PAIRS = 20, 0.02, 8
COEFFICIENT_CAP, DELTA_SCALE, DELTA_CAP = 5.0, 6.0, 12.0
IMPROVE_MARGIN, FDR_Q = 0.05, 0.1
RIDGE = 0.01
# Where Newton's method starts from: a fit on one in so many rows, where a refit has enough of them.
WARM_SHARE, WARM_ROWS, WARM_TOLERANCE = 32, 1000, 1e-4


# Folds and objectives


def expanding_folds(dates: DataFrame, folds: int = 4, purge: int = 0) -> DataFrame:
    """dates(trade_date) -> fold from 1, trade_date, part (train or test).

    The last folds * size dates are tested, size = dates / (folds + 1); a fold trains on all dates before its test dates less
    the last purge. Folds without a date on either side are left out, as are all below three dates. A row a date.
    """
    one = Window.partitionBy(F.lit(0))
    d = dates.select("trade_date").distinct().withColumn("i", F.row_number().over(one.orderBy("trade_date")) - 1).withColumn("n", F.count("*").over(one)).where("n >= 3")
    count = F.least(F.lit(max(1, folds)), F.col("n") - 1)
    size = F.greatest(F.lit(1), F.floor(F.col("n") / (count + 1)))
    f = d.withColumn("folds", count.cast("int")).withColumn("size", size).withColumn("fold", F.explode(F.sequence(F.lit(1), F.col("folds"))))
    start = F.col("n") - F.col("size") * (F.col("folds") - F.col("fold") + 1)
    part = F.when((F.col("i") >= start) & (F.col("i") < start + F.col("size")), "test").when(F.col("i") < start - purge, "train")
    kept = f.withColumn("part", part).withColumn("trains", start - purge > 0).where("trains and part is not null")
    return kept.select(F.col("fold").cast("bigint").alias("fold"), "trade_date", "part")


def with_excess(samples: DataFrame, by: list[str], ret: str = "net_return") -> DataFrame:
    """samples with excess: the return less the median of its date, found where the date's rows are; rows without one go."""
    median = F.median(ret).over(Window.partitionBy(*by))
    return samples.dropna(subset=by).withColumn("excess", F.col(ret) - median)


def top_rows(samples: DataFrame, by: list[str], score: Column, k: int) -> DataFrame:
    """The k highest scores of each group and date, ties by code."""
    w = Window.partitionBy(*by, "trade_date").orderBy(F.desc("_score"), "code")
    return samples.withColumn("_score", score).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_score", "_rank")


def objectives(selected: DataFrame, by: list[str]) -> DataFrame:
    """by, n, win_rate, avg_excess, avg_return, sortino, decay, objective of the rows chosen.

    objective = (win rate over the median + 2 * mean excess + 0.5 * Sortino ratio) * decay; decay compares the win rate with a
    half-life of 30 days to that of 60, from 0.75 to 1.25.
    """
    age = F.date_diff(F.max("trade_date").over(Window.partitionBy(*by)), "trade_date")
    x = selected.withColumn("_age", age).withColumn("_r", F.round("net_return", 4)).withColumn("_w60", F.pow(F.lit(0.5), F.col("_age") / HALF_LIFE)).withColumn("_w30", F.pow(F.lit(0.5), F.col("_age") / (HALF_LIFE // 2)))
    up, down = (F.col("net_return") > 0).cast("double"), F.when(F.col("_r") < 0, F.col("_r"))
    g = x.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("excess") > 0).cast("double")) * 100, 2).alias("win_rate"), F.round(F.avg("excess"), 4).alias("avg_excess"), F.round(F.avg("net_return"), 4).alias("avg_return"),
        F.count(down).alias("_losses"), F.stddev_samp(down).alias("_sd"), *[(F.sum(up * F.col(f"_w{h}")) / F.sum(f"_w{h}") * 100).alias(f"_t{h}") for h in (60, 30)],
    )
    avg = F.col("avg_excess")
    spread = F.when(F.col("_losses") >= 2, F.col("_sd")).when(avg < 0, -avg * 2).otherwise(2.0)
    drift = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("_t30") - F.col("_t60")))
    g = g.withColumn("sortino", F.when(spread > 1e-8, F.round(avg / nonzero(spread), 6)).otherwise(0.0)).withColumn("decay", F.round(F.greatest(F.lit(0.75), F.least(F.lit(1.25), 1 + drift / 100)), 6))
    value = F.round((F.col("win_rate") + 2 * avg + 0.5 * F.col("sortino")) * F.col("decay"), 6)
    return g.select(*by, "n", "win_rate", "avg_excess", "avg_return", "sortino", "decay", value.alias("objective"))


def weighted_score(columns: Sequence[str], prefix: str = "w_") -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + F.col(c) * F.col(f"{prefix}{c}")
    return out


# Weight search


def normalised(weights: dict[str, float]) -> dict[str, float]:
    """Weights within their bounds, adding up to 1, to four digits."""
    w = {k: min(MOST_WEIGHT, max(LEAST_WEIGHT, v)) for k, v in weights.items()}
    return {k: round(v / sum(w.values()), 4) for k, v in w.items()}


def _best_of_runs(low: np.ndarray, code: pa.Array, run: np.ndarray, k: int) -> np.ndarray:
    """Places of the k lowest of each run, ties by code. run: ascending numbers."""
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    some = []
    for lo, hi in zip(starts, [*starts[1:], len(run)], strict=True):
        part = low[lo:hi]
        some.append(lo + (np.flatnonzero(part <= np.partition(part, k - 1)[k - 1]) if hi - lo > k else np.arange(hi - lo)))
    at = np.concatenate(some) if some else np.zeros(0, np.int64)
    at = at[np.lexsort((pd.factorize(code.take(pa.array(at)).to_pandas(), sort=True)[0], low[at], run[at]))]
    first = np.flatnonzero(np.diff(run[at], prepend=-1))
    return at[np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at))) < k]


def _top_candidates(samples: DataFrame, tried: dict[str, list[tuple[str, list[float]]]], columns: Sequence[str], k: int, sets: dict[str, list[str]] | None = None) -> DataFrame:
    """The k best rows of every group, date and candidate weights, ties by code: those of each batch first, then the best of these.
    sets: the groups that rows of a grp stand for, where that is not one."""
    keep = ["grp", "trade_date", "code", "net_return", "excess"]
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grp, day = (b.column(c).dictionary_encode(null_encoding="encode") for c in ("grp", "trade_date"))
            key = grp.indices.to_numpy().astype(np.int64) * (len(day.dictionary) + 1) + day.indices.to_numpy()
            if (np.diff(key) < 0).any():
                order = pa.array(np.argsort(key, kind="stable"))
                b, key, grp = b.take(order), np.sort(key), grp.take(order)
            for i, g in enumerate(grp.dictionary.to_pylist()):
                at = np.flatnonzero(grp.indices.to_numpy() == i)
                own, number = b.take(pa.array(at)), key[at]
                x = [own.column(c).cast(pa.float64()) for c in columns]
                gone = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in x], axis=0)
                x = [c.fill_null(0.0).to_numpy() for c in x]
                for into, name, weights in ((into, *t) for into in (sets or {}).get(g, (g,)) for t in tried.get(into, ())):
                    score = np.zeros(len(at))
                    for v, w in zip(x, weights, strict=True):
                        score = score + v * w
                    # In Spark's order: undefined scores first, missing ones last.
                    best = _best_of_runs(np.where(gone, np.inf, np.where(np.isnan(score), -np.inf, -score)), own.column("code"), number, k)
                    top = own.take(pa.array(best))
                    yield pa.RecordBatch.from_arrays([pa.array([into] * len(best), pa.string()), *(top.column(c) for c in keep[1:]), pa.array([name] * len(best), pa.string()), pa.array(score[best], mask=gone[best])], names=[*keep, "candidate", "_score"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "candidate string", "_score double"])
    return top_rows(samples.select(*keep, *columns).mapInArrow(run, schema), ["grp", "candidate"], F.col("_score"), k)


def _evaluated(samples: DataFrame, tried: list[tuple], columns: Sequence[str], k: int, sets: dict[str, list[str]]) -> dict[tuple, float]:
    """(grp, candidate, weights...) -> the objective of each, in one job. tried has a few rows for each group."""
    by_group: dict[str, list[tuple[str, list[float]]]] = {}
    for g, name, *weights in tried:
        by_group.setdefault(g, []).append((name, [float(w) for w in weights]))
    some = [name for name, groups in sets.items() if by_group.keys() & set(groups)]
    top = _top_candidates(samples.where(F.col("grp").isin(some)), by_group, columns, k, sets)
    return {(r["grp"], r["candidate"]): r["objective"] for r in objectives(top, ["grp", "candidate"]).select("grp", "candidate", "objective").collect()}


def coordinate_search(samples: DataFrame, columns: Sequence[str], initial: dict[str, float], k: int = 10, steps: int = 2, normalise: bool = True) -> DataFrame:
    """samples(grp, trade_date, code, net_return, <columns>) -> grp, a weight for each column, start, objective, rounds.

    Greedy coordinate steps, all groups (folds, regimes, strategies) side by side: a weight is tried at 0.7 and 1.3 of its
    value, and a trial that gains is kept before the next one is made. One job a weight tries 0.7, 1.3 and 0.7 * 1.3 for every
    group, which is all that this order of trials can ask for. A group stops after a round without a gain, or `steps` rounds.
    Where grp is an array, a date's rows are in all of its groups, and the whole date is: they are kept once, not once a group.
    """
    shared = isinstance(samples.schema["grp"].dataType, ArrayType)
    kept = samples.select(F.array_join("grp", "\x1f").alias("grp") if shared else "grp", "trade_date", "code", "net_return", *columns)
    # A date's rows lie side by side after their window, so that a batch keeps few of them.
    grouped = written(with_excess(kept, ["trade_date"] if shared else ["grp", "trade_date"]), "search-samples")
    found = [r["grp"] for r in grouped.select("grp").distinct().collect()]
    sets = {g: g.split("\x1f") if shared else [g] for g in found}
    first = normalised(initial) if normalise else dict(initial)
    names = sorted({g for groups in sets.values() for g in groups})
    if not names:
        return grouped.sparkSession.createDataFrame([], ", ".join(["grp string", *(f"{c} double" for c in columns), "start double", "objective double", "rounds long"]))

    def moved(w: dict[str, float], c: str, by: float) -> dict[str, float]:
        out = {**w, c: w[c] * by}
        return normalised(out) if normalise else {**out, c: round(out[c], 4)}

    start = _evaluated(grouped, [(g, "start", *first.values()) for g in names], columns, k, sets)
    best = {g: (dict(first), start[g, "start"]) for g in names}
    rounds, live = dict.fromkeys(names, 0), list(names)
    for _ in range(max(1, steps)):
        gained = set()
        for c in columns:
            low, high = FACTORS
            trials = {g: {"low": moved(best[g][0], c, low), "high": moved(best[g][0], c, high)} for g in live}
            for g in live:
                trials[g]["both"] = moved(trials[g]["low"], c, high)
            found = _evaluated(grouped, [(g, name, *w.values()) for g in live for name, w in trials[g].items()], columns, k, sets)
            for g in live:
                second = "high"
                if found[g, "low"] > best[g][1] + LEAST_GAIN:
                    best[g], second = (trials[g]["low"], found[g, "low"]), "both"
                    gained.add(g)
                if found[g, second] > best[g][1] + LEAST_GAIN:
                    best[g] = trials[g][second], found[g, second]
                    gained.add(g)
        for g in live:
            rounds[g] += 1
        live = [g for g in live if g in gained]
        if not live:
            break
    rows = [(g, *(float(best[g][0][c]) for c in columns), start[g, "start"], best[g][1], rounds[g]) for g in names]
    return grouped.sparkSession.createDataFrame(rows, ", ".join(["grp string", *(f"{c} double" for c in columns), "start double", "objective double", "rounds long"]))


def walk_forward_search(samples: DataFrame, columns: Sequence[str], initial: dict[str, float], k: int = 10, steps: int = 2, folds: int = 4, purge: int = 5) -> DataFrame:
    """fold, is_objective, baseline_oos, best_oos, improvement: weights fitted on each fold's training dates, all folds in the same
    jobs, against the initial ones on its test dates."""
    parts = F.broadcast(expanding_folds(samples, folds, purge))  # a row a date and fold
    dealt = written(samples.select("trade_date", "code", "net_return", *columns).join(parts, "trade_date").withColumn("grp", F.col("fold").cast("string")), "search-folds")
    fitted = coordinate_search(dealt.where("part = 'train'"), columns, initial, k, steps)
    tried = fitted.select("grp", F.lit("best").alias("candidate"), *[F.col(c).alias(f"w_{c}") for c in columns])
    base = fitted.select("grp", F.lit("base").alias("candidate"), *[F.lit(v).alias(f"w_{c}") for c, v in normalised(initial).items()])
    test = with_excess(dealt.where("part = 'test'"), ["grp", "trade_date"]).join(F.broadcast(tried.unionByName(base)), "grp")
    o = objectives(top_rows(test, ["grp", "candidate"], weighted_score(columns), k), ["grp", "candidate"]).groupBy("grp").agg(*[F.max(F.when(F.col("candidate") == c, F.col("objective"))).alias(f"{c}_oos") for c in ("base", "best")])
    return fitted.join(o, "grp").select(F.col("grp").cast("bigint").alias("fold"), F.col("objective").alias("is_objective"), F.col("base_oos").alias("baseline_oos"), "best_oos", (F.col("best_oos") - F.col("base_oos")).alias("improvement"))


# Challenger ladder


def _unit(c: str) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.coalesce(F.col(c), F.lit(50.0)) - 50) / 50))


def pair_products(columns: Sequence[str]) -> dict[str, Column]:
    """Second-order products of scores from 0 to 100, each brought to -1..1."""
    return {f"{a}*{b}": _unit(a) * _unit(b) for a, b in combinations(columns, 2)}


def interaction_terms(samples: DataFrame, columns: Sequence[str], by: str = "fold", most: int = MOST_PAIRS) -> DataFrame:
    """samples(by, trade_date, net_return, excess, <columns>) -> by, pair, coefficient, correlation, n.

    Each pair's product is regressed on the excess return; pairs correlated by at least 0.02 stay, the `most` strongest ones.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(p).alias("pair"), v.alias("x")) for i, (p, v) in enumerate(pair_products(columns).items())]))
    x = samples.select(by, F.col("excess").alias("y"), pairs.alias("_p")).select(by, "y", "_p.*")
    g = x.groupBy(by, "at", "pair").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    g = g.where((F.col("n") >= LEAST_SAMPLES) & (F.col("vx") > 1e-10) & (F.col("vy") > 1e-10)).withColumn("correlation", F.col("c") / F.sqrt(nonzero(F.col("vx") * F.col("vy"))))
    coefficient = F.round(F.greatest(F.lit(-COEFFICIENT_CAP), F.least(F.lit(COEFFICIENT_CAP), F.col("c") / nonzero(F.col("vx")))), 6)
    w = Window.partitionBy(by).orderBy(F.desc(F.round(F.abs("correlation"), 6)), "at")
    g = g.where(F.abs("correlation") >= LEAST_CORRELATION).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return g.select(by, "pair", coefficient.alias("coefficient"), F.round("correlation", 6).alias("correlation"), "n")


def interaction_scores(samples: DataFrame, terms: DataFrame, columns: Sequence[str], by: str = "fold", score: str = "score") -> DataFrame:
    """samples with challenger: the score and the capped sum of the group's terms, from 0 to 100."""
    maps = F.broadcast(terms.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("pair", "coefficient"))).alias("_t")))  # a row a group, at most MOST_PAIRS pairs
    delta = F.lit(0.0)
    for p, v in pair_products(columns).items():
        delta = delta + F.coalesce(F.element_at("_t", F.lit(p)), F.lit(0.0)) * v * DELTA_SCALE
    capped = F.greatest(F.lit(-DELTA_CAP), F.least(F.lit(DELTA_CAP), delta))
    return samples.join(maps, by, "left").withColumn("challenger", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(score) + capped))).drop("_t")


def ladder(scored: DataFrame, k: int = 10, margin: float = IMPROVE_MARGIN, q: float = FDR_Q, draws: int = 1000) -> DataFrame:
    """scored(fold, variant, trade_date, code, net_return, excess, rank_score); variant 'baseline' is what the others challenge.

    variant, folds, baseline_oos, challenger_oos, improvement, positive_folds, p_value, fdr_passed, ci_low, dsr_probability,
    status. A challenger passes out of sample if its mean objective beats the baseline's by more than margin and in more than
    half of the folds; then false discovery rate over all challengers, interval of the folds' return gains and deflated
    Sharpe ratio of the daily paired increments may block it, in this order.
    """
    top = written(top_rows(scored, ["fold", "variant"], F.col("rank_score"), k), "ladder-top")
    o = objectives(top, ["fold", "variant"])
    base = o.where("variant = 'baseline'").select("fold", F.col("objective").alias("b"), F.col("avg_return").alias("br"))
    pairs = o.where("variant <> 'baseline'").join(base, "fold")
    gain = F.col("avg_return") - F.col("br")
    folds = pairs.groupBy("variant").agg(
        F.count("*").alias("folds"), F.round(F.avg("b"), 4).alias("baseline_oos"), F.round(F.avg("objective"), 4).alias("challenger_oos"), F.sum((F.round(F.col("objective") - F.col("b"), 4) > 0).cast("bigint")).alias("positive_folds"),
        F.round(F.avg(gain) - F.when(F.count("*") > 1, 1.96 * F.stddev_samp(gain) / F.sqrt(F.count("*"))).otherwise(0.0), 4).alias("ci_low"),
    )
    day = top.groupBy("variant", "trade_date").agg(F.avg("net_return").alias("r"))
    inc = day.where("variant <> 'baseline'").join(day.where("variant = 'baseline'").select("trade_date", F.col("r").alias("b")), "trade_date").select("variant", "trade_date", F.round(F.col("r") - F.col("b"), 6).alias("inc"))
    p = benjamini_hochberg(bootstrap_p_value(inc, "variant", "trade_date", "inc", draws).withColumn("_all", F.lit(0)), ["_all"], "p_value", ["variant"], q).select("variant", "p_value", F.col("rejected").alias("fdr_passed"))
    d = deflated_sharpe(inc, ["variant"], "inc", 1).select("variant", F.col("probability").alias("dsr_probability"), F.col("passed").alias("dsr_passed"))
    g = folds.join(p, "variant", "left").join(d, "variant", "left")
    passed = (F.col("challenger_oos") > F.col("baseline_oos") + margin) & (F.col("positive_folds") > F.floor(F.col("folds") / 2))
    status = F.when(~passed, "shadow_only").when(~F.coalesce("fdr_passed", F.lit(False)), "fdr_blocked").when(F.col("ci_low") < 0, "ci_blocked").when(~F.coalesce("dsr_passed", F.lit(False)), "dsr_blocked").otherwise("oos_passed")
    return g.select("variant", "folds", "baseline_oos", "challenger_oos", F.round(F.col("challenger_oos") - F.col("baseline_oos"), 4).alias("improvement"), "positive_folds", "p_value", F.coalesce("fdr_passed", F.lit(False)).alias("fdr_passed"), "ci_low", "dsr_probability", status.alias("status"))


def interaction_ladder(samples: DataFrame, columns: Sequence[str], k: int = 10, folds: int = 4, purge: int = 5, draws: int = 1000) -> DataFrame:
    """The ladder of samples(trade_date, code, net_return, score, <columns>) with the interaction challenger: every sample is dealt to
    the folds that it may train or test, and all folds are fitted and judged in the same jobs."""
    parts = F.broadcast(expanding_folds(samples, folds, purge))  # a row a date and fold
    dealt = written(with_excess(samples, ["trade_date"]).join(parts, "trade_date"), "ladder-folds")
    terms = interaction_terms(dealt.where("part = 'train'"), columns)
    test = interaction_scores(dealt.where("part = 'test'"), terms, columns)
    variants = F.explode(F.array(F.struct(F.lit("baseline").alias("variant"), F.col("score").alias("rank_score")), F.struct(F.lit("interaction").alias("variant"), F.col("challenger").alias("rank_score"))))
    return ladder(test.select("fold", "trade_date", "code", "net_return", "excess", variants.alias("_v")).select("fold", "trade_date", "code", "net_return", "excess", "_v.*"), k, draws=draws)


# Expanding-window models


def indexed_dates(samples: DataFrame) -> DataFrame:
    """trade_date, day: the dates numbered from 0. A row a date."""
    return samples.select("trade_date").distinct().withColumn("day", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("trade_date")).cast("long") - 1)


def ridge_by_refit(samples: DataFrame, features: Sequence[str], ret: str, first: int, every: int) -> tuple[np.ndarray, np.ndarray]:
    """samples(day, <features>, ret) -> the refit days and a row of coefficients (intercept first) for each.

    Products of features are summed by day, days are added up, so a refit's normal equations are one row: those of all days
    before it. A refit is made on day `first` and each `every` days later.
    """
    x = [F.lit(1.0), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features)]
    cells = [(a, b) for a in range(len(x)) for b in range(a, len(x))]
    sums = [F.sum(x[a] * x[b]).alias(f"g{i}") for i, (a, b) in enumerate(cells)] + [F.sum(v * F.coalesce(F.col(ret), F.lit(0.0))).alias(f"y{i}") for i, v in enumerate(x)]
    days = samples.groupBy("day").agg(*sums)
    w = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row a date
    names = [f"g{i}" for i in range(len(cells))] + [f"y{i}" for i in range(len(x))]
    refits = days.select("day", *[F.sum(c).over(w).alias(c) for c in names]).where((F.col("day") >= first) & ((F.col("day") - first) % every == 0)).orderBy("day").toPandas()
    v, n = refits[names].to_numpy(float), len(x)
    gram = np.zeros((len(v), n, n))
    for i, (a, b) in enumerate(cells):
        gram[:, a, b] = gram[:, b, a] = v[:, i]
    gram += RIDGE * np.diag([0.0] + [1.0] * (n - 1))
    beta = (np.linalg.pinv(gram, hermitian=True) @ v[:, len(cells) :, None])[:, :, 0] if len(v) else np.zeros((0, n))
    return refits["day"].to_numpy(np.int64), beta


def logistic_by_refit(samples: DataFrame, features: Sequence[str], positive: str, refits: np.ndarray, rounds: int = 30, tolerance: float = 1e-9) -> np.ndarray:
    """samples(day, <features>, positive) -> coefficients (intercept first) for each refit day, fitted on all days before it.

    Newton's method for mean log loss + ridge / 2 * |coefficients|^2, intercept free. A round is one job: a task adds up gradient
    and curvature of its rows for every refit day at once; a few numbers for each refit day go to the driver. The first rounds
    only look for where to start, on one in WARM_SHARE rows; the fit is on all rows, until it moves no more.
    """
    n, r = 1 + len(features), len(refits)
    if not r:
        return np.zeros((0, n))
    cells = [(a, b) for a in range(n) for b in range(a, n)]
    beta, penalty = np.zeros((r, n)), RIDGE * np.r_[0.0, np.ones(n - 1)]
    names = ["n", *(f"d{i}" for i in range(n)), *(f"h{i}" for i in range(len(cells)))]
    table = samples.select("day", F.col(positive).cast("double").alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)])
    few = table.where(F.pmod(F.xxhash64(*table.columns), F.lit(WARM_SHARE)) == 0)

    def one_round(table: DataFrame, beta: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((len(names), r))
            for b in batches:
                v = b.to_numpy(float)
                v = v[np.argsort(v[:, 0], kind="stable")]
                for lo in range(0, len(v), 256):  # what is made of them stays in the cache
                    day, y, c = v[lo : lo + 256, 0], v[lo : lo + 256, 1], v[lo : lo + 256, 2:]
                    since = int(np.searchsorted(refits, day[0], side="right"))  # refits of this day and before use none of these rows
                    x = np.column_stack([np.ones(len(c)), c])
                    p = 1 / (1 + np.exp(-np.clip(x @ beta[since:].T, -30, 30)))
                    e, q = p - y[:, None], p * (1 - p)
                    late = int(np.searchsorted(refits, day[-1], side="right"))  # from here on they use all of them
                    used = day[:, None] < refits[None, since:late]
                    e[:, : late - since] *= used
                    q[:, : late - since] *= used
                    out[0, since:late] += used.sum(axis=0)
                    out[0, late:] += len(c)
                    out[1 : 1 + n, since:] += x.T @ e
                    out[1 + n :, since:] += np.stack([x[:, i] * x[:, j] for i, j in cells]) @ q
            yield pd.DataFrame({"refit": np.arange(r)} | dict(zip(names, out, strict=True)))

        schema = ", ".join(["refit long", *(f"{c} double" for c in names)])
        got = table.mapInPandas(run, schema).groupBy("refit").agg(*[F.sum(c).alias(c) for c in names]).orderBy("refit").toPandas()
        return got[names].to_numpy(float)

    for part, enough in ((few, WARM_TOLERANCE), (table, tolerance)):
        for _ in range(rounds):
            v = one_round(part, beta)
            if not len(v):
                break
            count = np.maximum(v[:, :1], 1)
            slope = v[:, 1 : 1 + n] / count + penalty * beta
            curve = np.zeros((r, n, n))
            for i, (a, b) in enumerate(cells):
                curve[:, a, b] = curve[:, b, a] = v[:, 1 + n + i] / count[:, 0]
            curve += np.diag(penalty) + 1e-12 * np.eye(n)
            step = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
            beta = beta - step
            if np.abs(step).max() < enough:
                break
        if part is few and len(v):
            # Elsewhere, or where these rows fit without end, from 0.
            beta[(v[:, 0] < WARM_ROWS) | ~(np.abs(beta).max(axis=1) < 5)] = 0.0
    return beta


def walk_forward_models(samples: DataFrame, features: Sequence[str], ablation: Sequence[str], least_days: int = 60, every: int = 5) -> DataFrame:
    """samples(trade_date, code, net_return, <features>) -> the samples from day least_days on, with probability, expected_return,
    rank_key and the same of a model on the ablation's features alone.

    Refitted each `every` days on all earlier days. rank_key = probability of a gain times expected return.
    """
    spark = samples.sparkSession
    x = written(samples.join(F.broadcast(indexed_dates(samples)), "trade_date").withColumn("_up", (F.col("net_return") > 0).cast("double")), "model-samples")
    out, names = x.where(F.col("day") >= least_days).withColumn("_block", F.floor((F.col("day") - least_days) / every)), []
    for tag, cols in (("", features), ("ablation_", ablation)):
        days, ridge = ridge_by_refit(x, cols, "net_return", least_days, every)
        logistic = logistic_by_refit(x, cols, "_up", days)
        blocks = (days - least_days) // every
        rows = [(int(b), [float(v) for v in m], [float(v) for v in g]) for b, m, g in zip(blocks, ridge, logistic, strict=True)]
        models = spark.createDataFrame(rows, f"_block long, {tag}m array<double>, {tag}g array<double>")
        out = out.join(F.broadcast(models), "_block")  # a row a refit date

        def linear(beta: str) -> Column:
            v = F.get(beta, F.lit(0))
            for i, c in enumerate(cols, 1):
                v = v + F.get(beta, F.lit(i)) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            return v

        logit = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), linear(f"{tag}g")))
        out = out.withColumn(f"{tag}probability", 1 / (1 + F.exp(-logit))).withColumn(f"{tag}expected_return", linear(f"{tag}m")).withColumn(f"{tag}rank_key", F.col(f"{tag}probability") * F.col(f"{tag}expected_return"))
        names += [f"{tag}{c}" for c in ("probability", "expected_return", "rank_key")]
    return out.select(*samples.columns, "day", *names)


def counterfactual_days(scored: DataFrame, selected: str, local: str, k: int = 5) -> DataFrame:
    """A row a date: returns of the k best by the local score among the selected, by the challenger's rank_key and by the
    ablation's, their increments, replaced codes, and the worst drawdown so far of local and challenger."""
    def place(c: str, keep: Column) -> Column:
        return F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc(keep.cast("int")), F.desc(c), "code"))

    keep = F.col(selected)
    x = scored.withColumn("_l", place(local, keep)).withColumn("_c", place("rank_key", F.lit(True))).withColumn("_a", place("ablation_rank_key", F.lit(True)))
    in_l, in_c, in_a = keep & (F.col("_l") <= k), F.col("_c") <= k, F.col("_a") <= k

    def ret(inside: Column) -> Column:
        return F.round(F.sum(F.when(inside, F.col("net_return")).otherwise(0.0)) / k, 6)

    day = x.where(in_l | in_c | in_a).groupBy("trade_date").agg(
        ret(in_l).alias("local_return"), ret(in_c).alias("challenger_return"), ret(in_a).alias("ablation_return"),
        F.array_join(F.array_sort(F.collect_set(F.when(in_c & ~in_l, F.col("code").cast("string")))), ",").alias("replacements"),
    )
    day = day.withColumn("increment", F.round(F.col("challenger_return") - F.col("local_return"), 6)).withColumn("ablation_increment", F.round(F.col("challenger_return") - F.col("ablation_return"), 6)).withColumn("_one", F.lit(0))
    w = Window.partitionBy("_one").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # a row a date
    for side in ("local", "challenger"):
        day = net_asset_value(day, ["_one"], "trade_date", f"{side}_return").withColumn(f"{side}_max_drawdown", F.round(F.min("drawdown").over(w), 6)).drop("nav", "peak", "drawdown")
    return day.drop("_one")

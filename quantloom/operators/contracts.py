"""Row contracts: universes, sample provenance, readiness, execution phases, thresholds, attached lookups, feeds, gates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clamp, is_supported_code
from ..sources.shared import written
from . import peers as pr
from .scoring import hot_rank_score
from .stats import bootstrap_interval, bootstrap_p_value, deflated_sharpe

# Provenance labels and the names that stand for them.
SAMPLE_TYPES = ("real_forward", "close_forward", "intraday_pit_replay", "daily_proxy_replay", "legacy_baseline")
SAMPLE_ALIASES = {
    "real": "real_forward", "live": "real_forward", "forward": "real_forward", "production": "real_forward", "close": "close_forward", "close_final": "close_forward",
    "replay": "daily_proxy_replay", "daily_proxy": "daily_proxy_replay", "daily_bar_proxy": "daily_proxy_replay", "intraday": "intraday_pit_replay", "pit_replay": "intraday_pit_replay", "legacy": "legacy_baseline",
}
# Backup threshold by regime, and steps (column, high from, its step, middle from, its step, low to, its step).
BACKUP_BASE = {"risk_on": 46.0, "balanced": 45.0, "risk_off": 44.0}
BACKUP_STEPS = (
    ("volatility_20d", 12.0, 3.0, None, 0.0, 5.0, -1.0),
    ("turnover_rate", 18.0, 2.0, 10.0, 1.0, 5.0, -0.5),
    ("order_imbalance", 8.0, 2.0, 4.0, 1.0, None, 0.0),
)
# Least coverage in percent of the fields that a quote must have, that execution needs, and that research may use.
GATES = (("base_quote", 98.0), ("hard_filter_execution", 99.0), ("optional_research", 95.0))
DIRECTION_WEIGHTS = {"score": 0.30, "quality": 0.24, "rule_consistency": 0.18, "agent": 0.18}
PROMOTED_TYPES = ("real_forward", "intraday_pit_replay", "daily_proxy_replay", "legacy_baseline")


def _number(c: str) -> Column:
    """A missing or undefined number counts as 0."""
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)


def swing_universe(df: DataFrame, market: str | None = None) -> DataFrame:
    """Rows that a 2 to 5 day candidate may come from; of one market, if named. Missing numbers count as 0."""
    d = df if market is None else df.where(F.col("market") == market)
    sixty = _number("sixty_day_pct")
    return d.where((_number("pct_chg") <= 8) & (sixty <= 85) & (_number("ytd_pct") <= 130) & (sixty >= -18))


def breadth_universe(quotes: DataFrame) -> DataFrame:
    """Quotes that count for a market's breadth: a supported code, no special treatment or delisting in the name, a price above 0."""
    return quotes.where(is_supported_code(F.col("code")) & ~F.coalesce(F.col("name"), F.lit("")).rlike("(?i)ST|退") & (_number("price") > 0))


def sample_type(c: Column) -> Column:
    """The provenance label that a text stands for; unknown, if none."""
    key = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in SAMPLE_ALIASES.items() for x in kv])[key], key)
    return F.when(label.isin(*SAMPLE_TYPES), label).otherwise("unknown")


def is_primary(strategy: Column, rank: Column, tier: Column, allowed: Column, most_rank: int = 10) -> Column:
    """Whether a signal counts for validation: not where execution is ruled out; by its tier, if it has one; else tomorrow's by rank."""
    named = F.trim(F.coalesce(tier, F.lit("")))
    return F.when(~F.coalesce(allowed, F.lit(True)), False).when(named != "", named == "primary_watch").when(strategy == "tomorrow_picks", F.coalesce(rank, F.lit(0)) <= most_rank).otherwise(True)


def outcome_ready(corrected: Column, future_days: Column, exit_reason: Column, exit_days: Column, holding_days: int) -> Column:
    """Corrected, or enough days seen, or an early exit within the days seen. No days seen count as one."""
    seen = F.when(F.coalesce(future_days, F.lit(0)) == 0, 1).otherwise(future_days)
    left, days = F.coalesce(exit_reason, F.lit("")), F.coalesce(exit_days, F.lit(0))
    return F.coalesce(corrected, F.lit(False)) | (seen >= max(1, holding_days)) | (~left.isin("", "hold_to_term") & (days > 0) & (days <= seen))


def execution_phase(ts: Column, start: str = "09:40", end: str = "14:00") -> Column:
    """struct(allowed, phase) of a point in time."""
    t = F.date_format(ts, "HH:mm")

    def state(allowed: bool, phase: str) -> Column:
        return F.struct(F.lit(allowed).alias("allowed"), F.lit(phase).alias("phase"))

    out = F.when((t >= "09:30") & (t < start), state(False, "open_observe")).when((t >= start) & (t < "10:30"), state(True, "main_execution"))
    return out.when((t >= "10:30") & (t <= "11:20"), state(True, "late_execution")).when((t >= "13:00") & (t <= end), state(False, "afternoon_observe")).otherwise(state(False, "backup_only"))


def backup_threshold(level: Column, min_score: float) -> Column:
    """A row's least score as a backup: its regime's base, steps for volatility, turnover rate and imbalance, below min_score."""
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in BACKUP_BASE.items() for x in kv])[level], F.lit(BACKUP_BASE["balanced"]))
    for c, high, up, mid, some, low, down in BACKUP_STEPS:
        v = F.abs(_number(c)) if c == "order_imbalance" else _number(c)
        step = F.when(v >= high, up)
        step = step if mid is None else step.when(v >= mid, some)
        step = step if low is None else step.when(v <= low, down)
        base = base + step.otherwise(0.0)
    t = clamp(base, 0, 100)
    return F.round(F.when(t >= min_score, max(0.0, min_score - 0.1)).otherwise(t), 2)


def attach_missing(df: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """df with the columns of facts (one row a key) that it does not have; those that it has stay as they are."""
    new = [c for c in facts.columns if c != key and c not in df.columns]
    return df.join(facts.select(key, *new), key, "left")


def attach_lookups(df: DataFrame, hot: DataFrame, industry: DataFrame, sentiment: DataFrame) -> DataFrame:
    """df(code, industry) with hot_rank_score (50 without a rank), industry_pct (0) and sentiment_score (50). hot(code, hot_rank),
    industry(industry, industry_pct), sentiment(code, sentiment_score): one row a key."""
    d = df.join(hot, "code", "left").join(industry, "industry", "left").join(sentiment, "code", "left")
    return d.withColumn("hot_rank_score", hot_rank_score(F.col("hot_rank"))).withColumn("industry_pct", F.coalesce("industry_pct", F.lit(0.0))).withColumn("sentiment_score", F.coalesce("sentiment_score", F.lit(50.0)))


def direction_score(score: Column, quality: Column, rule_consistency: Column, agent: Column, risk: Column) -> Column:
    """Blend of a row's scores; a missing score is 50, quality falls back on it, the agent on quality, the others on 50."""
    s = F.coalesce(score, F.lit(50.0))
    q = F.coalesce(quality, s)
    parts = {"score": s, "quality": q, "rule_consistency": F.coalesce(rule_consistency, F.lit(50.0)), "agent": F.coalesce(agent, q)}
    out = sum((parts[k] * w for k, w in DIRECTION_WEIGHTS.items()), F.lit(0.0)) + (100 - F.coalesce(risk, F.lit(50.0))) * 0.10
    return clamp(out, 0, 100)


def strategy_hits(rows: DataFrame) -> DataFrame:
    """rows(strategy, tier, observation_mode, execution_allowed, scores..) -> with direction_score, observation_only and execution_allowed."""
    only = (F.col("strategy") == "tomorrow_picks") & ((F.coalesce("tier", F.lit("")) == "backup_pool") | (F.coalesce("observation_mode", F.lit("")) == "intraday_provisional") | ~F.coalesce("execution_allowed", F.lit(True)))
    d = rows.withColumn("direction_score", direction_score(*[F.col(c) for c in ("score", "quality", "rule_consistency", "agent", "risk")])).withColumn("observation_only", only)
    return d.withColumn("execution_allowed", F.coalesce("execution_allowed", ~F.col("observation_only")))


def expected_return(queries: DataFrame, train: DataFrame, block: str, features: dict[str, tuple[float, float]], share: float = 0.35, least: int = 20, least_shared: int = 3, half_life: int = 60, ready_days: int = 60) -> DataFrame:
    """Of each query the peers are the nearest max(least, share of all) of the training rows of its block: train(train_id, block,
    signal_date, net_return, max_drawdown, features), by scaled weighted squared distance over the features that both have,
    least_shared at least. -> query_id, peers, expected, p_win, downside_p10, expected_drawdown, uncertainty, confidence.

    Weights halve in half_life days before the newest peer; confidence is ready where the whole training table has ready_days
    dates. Queries with fewer than `least` rows to compare with have no row. Ties go to the smaller train_id.

    Queries are a stated set, today's rows, held against all training rows: every query meets every row of its block, in units of
    bounded size (see peers.py). No list of pairs is sorted or shuffled: a sample of the block gives a bracket of distances, all rows are
    counted in parts of it, and only the rows of the part that the share ends in are ranked; where the share ends outside, the bracket
    comes from all rows. All else are sums; the 10 % quantile is found by bins of returns and finer ones within. A unit gives back as
    much as it has queries, whatever its rows. A feature that is not finite counts as missing.
    """
    last = train.agg(F.max("signal_date").alias("d"), F.count("*").alias("n")).first()
    age = F.date_diff(F.lit(last["d"]), "signal_date")
    rows = train.select(block, "train_id", age.alias("age"), F.pow(F.lit(0.5), age / F.lit(float(half_life))).alias("w"), F.col("net_return").alias("r"), F.coalesce("max_drawdown", F.lit(0.0)).alias("dd"), *features)
    t = pr.packed(rows, block, "train_id", pr.ROWS, "t")
    w, kind = Window.partitionBy("query_id"), queries.schema["query_id"].dataType
    one_in = F.ceil(F.count("*") / pr.SAMPLE)
    some = rows.join(rows.groupBy(block).agg(one_in.alias("one_in")), block).where(F.pmod(F.xxhash64("train_id"), F.col("one_in")) == 0)
    marks = np.sort([x["r"] for x in rows.where(F.pmod(F.xxhash64("train_id", F.lit("r")), F.lit(-(-last["n"] // pr.CUTS**2) or 1)) == 0).select("r").dropna().collect()])

    def held(q: DataFrame, step: str, t: DataFrame = t) -> DataFrame:
        return pr.compared(t, pr.packed(q, block, "query_id", pr.QUERIES, "q"), block, features, least_shared, kind, step, marks)

    def bins(q: DataFrame, t: DataFrame) -> DataFrame:
        n = held(q, "bins", t).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        return n.withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))

    def bracket(q: DataFrame, found: DataFrame, sampled: Column) -> DataFrame:
        """q with the bins, low and high, that the share ends between: surely where all rows were counted, else mostly."""
        limit, slack = F.greatest(F.lit(least), F.floor(F.col("all") * share)), F.when(sampled, F.ceil(3 * F.sqrt(F.col("all") * share * (1 - share))) + 1).otherwise(0)
        ends = [F.min(F.when(F.col("upto") >= F.least(F.col("all"), limit + k * slack), F.col("bin"))).alias(c) for k, c in ((-1, "low"), (1, "high"))]
        return q.join(found.groupBy("query_id").agg(*ends), "query_id", "left").fillna(0, ["low", "high"])

    many = last["n"] > pr.SAMPLE
    q = queries.select("query_id", block, *features)
    q = written(bracket(q, bins(q, pr.packed(some.drop("one_in"), block, "train_id", pr.SAMPLE, "t")), F.lit(many)), "peer-brackets")
    cut = written(pr.cut_by_counts(held(q, "counts"), kind, share, least), "peer-cuts")
    if (missed := cut.where("not hit").join(q.drop("low", "high"), "query_id").drop("cut", "left", "hit")).count():
        again = written(bracket(missed, bins(missed, t), F.lit(False)), "peer-brackets")
        cut = cut.where("hit").unionByName(pr.cut_by_counts(held(again, "counts"), kind, share, least))
        q = q.join(again, "query_id", "left_anti").unionByName(again)
    q = written(q.join(cut.where("hit").drop("hit"), "query_id"), "peer-cut")

    at = held(q, "last").join(q.select("query_id", "left"), "query_id").withColumn("near", F.row_number().over(w.orderBy("distance", "train_id"))).where("near = left")
    q = written(q.drop("low", "high", "cut", "left").join(at.select("query_id", F.col("distance").alias("limit"), F.col("train_id").alias("last")), "query_id"), "peer-limits")
    g = written(pr.summed(held(q, "sums"), kind), "peer-sums")
    q = written(q.join(g.select("query_id", "own", "before", "goal"), "query_id"), "peer-coarse")
    fine = pr.narrowed(held(q, "finer"), kind)
    q = written(q.drop("before").join(fine, "query_id").withColumn("own", F.col("own") * pr.CUTS + F.col("fine")).drop("fine"), "peer-fine")
    inside = held(q, "lows").groupBy("query_id", "r").agg(F.sum("w").alias("w"))
    so_far = F.col("before") + F.sum("w").over(w.orderBy("r").rangeBetween(Window.unboundedPreceding, 0))
    tenth = inside.join(q.select("query_id", "before", "goal"), "query_id").withColumn("so_far", so_far).groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("so_far") >= F.col("goal") * (1 - 1e-12), F.col("r"))), F.max("r")).alias("downside_p10"))

    mean = F.col("wr") / F.col("w")
    total = F.col("w") * F.pow(F.lit(2.0), F.col("age") / F.lit(float(half_life)))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("wrr") / F.col("w") - mean * mean)) / F.sqrt(F.greatest(F.lit(1.0), total))
    ready = train.select("signal_date").distinct().count() >= ready_days
    return g.join(tenth, "query_id").select("query_id", "peers", mean.alias("expected"), (F.col("wwin") / F.col("w")).alias("p_win"), "downside_p10", (F.col("wdd") / F.col("w")).alias("expected_drawdown"), spread.alias("uncertainty"), F.lit("ready" if ready else "shadow").alias("confidence"))


def paired_increment(paired: DataFrame, by: str, date: str, draws: int = 1000) -> DataFrame:
    """paired(by, date, increment) -> by, n, mean, low, high, p_value, sharpe, probability of the increments over their dates."""
    interval, p = bootstrap_interval(paired, by, date, "increment", draws), bootstrap_p_value(paired, by, date, "increment", draws)
    sharpe = deflated_sharpe(paired, [by], "increment").select(by, "n", "mean", "sharpe", "probability")
    return sharpe.join(interval, by, "left").join(p.select(by, "p_value"), by, "left")


def freshness(snapshots: DataFrame, now: Column) -> DataFrame:
    """snapshots(captured_at, observed_at) -> with age_seconds (null without a time, 0 at least) and in_window (14:30 to 14:50)."""
    t = F.date_format("captured_at", "HH:mm:ss")
    return snapshots.withColumn("age_seconds", F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp("observed_at"))).withColumn("in_window", F.coalesce((t >= "14:30:00") & (t < "14:50:00"), F.lit(False)))


def coverage_gates(coverage: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """coverage(field, coverage_pct) -> gate, required_pct, least_pct, passed, eligible: a row for each of GATES. A field that is not
    there is covered by 0 percent; a gate without fields does not pass; eligible counts the fields at the required share."""
    wanted = [(g, r, f) for g, r in GATES for f in fields.get(g, ())]
    spark = coverage.sparkSession
    gates = spark.createDataFrame(wanted, "gate string, required_pct double, field string").join(coverage.select("field", "coverage_pct"), "field", "left")
    pct = F.coalesce("coverage_pct", F.lit(0.0))
    got = gates.groupBy("gate", "required_pct").agg(F.min(pct).alias("least_pct"), F.sum((pct >= F.col("required_pct")).cast("bigint")).alias("eligible"))
    every = spark.createDataFrame(list(GATES), "gate string, required_pct double").join(got, ["gate", "required_pct"], "left")
    return every.select("gate", "required_pct", "least_pct", F.coalesce(F.col("least_pct") >= F.col("required_pct"), F.lit(False)).alias("passed"), F.coalesce("eligible", F.lit(0)).alias("eligible"))


def conform_spot(raw: DataFrame, names: dict[str, str], required: tuple[str, ...], numbers: tuple[str, ...], stamp: str = "quote_time") -> DataFrame:
    """A spot feed: columns renamed, required ones checked, absent numbers 0, text numbers cast (null where they are none), and the
    batch's newest time stamp (epoch seconds) as quote_timestamp."""
    d = raw.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in raw.columns])
    if missing := [c for c in required if c not in d.columns]:
        raise ValueError(f"the feed has no {', '.join(missing)}")
    for c in numbers:
        d = d.withColumn(c, F.expr(f"try_cast(`{c}` AS double)") if c in d.columns else F.lit(0.0))
    newest = d.agg(F.max(F.expr(f"try_cast(`{stamp}` AS double)") if stamp in d.columns else F.lit(None).cast("double")).alias("_t"))
    return d.crossJoin(F.broadcast(newest)).withColumn("quote_timestamp", F.when(F.col("_t") > 0, F.timestamp_seconds("_t"))).drop("_t", stamp)


def conform_events(feed: DataFrame, code: tuple[str, ...], date: tuple[str, ...], ratio: tuple[str, ...]) -> DataFrame:
    """An event feed -> code (six digits), date, unlock_ratio, pledge_ratio: of each, the first alias that is there and not empty. Rows
    without a code go."""

    def first(names: tuple[str, ...]) -> Column:
        there = [F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.col(f"`{c}`").cast("string")) for c in names if c in feed.columns]
        return F.coalesce(*there) if there else F.lit(None).cast("string")

    r = first(ratio).cast("double")
    d = feed.select(first(code).alias("code"), first(date).alias("date"), r.alias("unlock_ratio"), r.alias("pledge_ratio")).where("code is not null")
    return d.withColumn("code", F.lpad(F.right(F.regexp_replace("code", r"\D", ""), F.lit(6)), 6, "0"))


def experiment_violations(experiments: DataFrame) -> DataFrame:
    """experiments(experiment_id, experiment_family, hypothesis, primary_metric, sample_type, baseline_id, production_baseline_id,
    trial_count, candidate_parameters) -> experiment_id and the rules that a record breaks; records that break none are left out."""

    def empty(c: str) -> Column:
        return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""

    broken = [F.when(empty(c), c) for c in ("experiment_id", "hypothesis", "primary_metric", "experiment_family", "production_baseline_id")]
    broken.append(F.when(~sample_type(F.col("sample_type")).isin(*PROMOTED_TYPES), "sample_type"))
    broken.append(F.when(~empty("baseline_id") & (F.trim("baseline_id") != F.trim("production_baseline_id")), "baseline_id"))
    tried, said = F.coalesce(F.size("candidate_parameters"), F.lit(0)), F.coalesce("trial_count", F.lit(0))
    broken += [F.when(tried <= 0, "candidate_parameters"), F.when((said <= 0) | (said < tried), "trial_count")]
    return experiments.select("experiment_id", F.array_compact(F.array(*broken)).alias("violations")).where(F.size("violations") > 0)


def readiness(signals: DataFrame, outcomes: DataFrame, version: str, days: int = 60) -> DataFrame:
    """signals(signal_id, strategy, signal_date, code, rank, baseline_id), outcomes(signal_id) -> by strategy: signals of the current
    and of other baselines, dates, labelled share in percent, ready (days dates labelled)."""
    j = signals.join(outcomes.select("signal_id", F.lit(True).alias("_done")), "signal_id", "left")
    now, done = F.col("baseline_id") == version, F.coalesce("_done", F.lit(False))
    g = j.groupBy("strategy").agg(F.count("*").alias("n"), F.sum(now.cast("bigint")).alias("current"), F.sum((now & done).cast("bigint")).alias("labelled"), F.countDistinct(F.when(now, F.col("signal_date"))).alias("days"), F.countDistinct(F.when(now & done, F.col("signal_date"))).alias("labelled_days"))
    return g.select("strategy", "n", "current", (F.col("n") - F.col("current")).alias("other"), "days", "labelled_days", F.when(F.col("current") > 0, F.col("labelled") / F.col("current") * 100).otherwise(0.0).alias("coverage_pct"), (F.col("labelled_days") >= days).alias("ready"))


def backfill_candidates(signals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Codes with a signal that has no outcome -> code, waiting, latest, best_rank."""
    return signals.join(outcomes.select("signal_id"), "signal_id", "left_anti").groupBy("code").agg(F.count("*").alias("waiting"), F.max("signal_date").alias("latest"), F.min("rank").alias("best_rank"))


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars as Parquet, a folder for each market and first five characters of the code, so that a code's bars are read from one."""
    d = bars.withColumn("prefix", F.substring("code", 1, 5))
    d.repartition("market", "prefix").sortWithinPartitions("code", "trade_date").write.partitionBy("market", "prefix").parquet(path)


def read_bars(bars: DataFrame, path: str) -> DataFrame:
    """What write_bars wrote, with the columns of bars; prefixes stay text."""
    return bars.sparkSession.read.schema(bars.withColumn("prefix", F.lit("")).schema).parquet(path)

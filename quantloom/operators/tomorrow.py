"""The next-day strategy for all dates at once: reject ladder, components, penalty, display gate, diversity, fallback, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from . import crosssection as cs
from . import scoring as sc
from .strategies import HISTORICAL, has_signal

# Fixed values. Components: (factor, weight) of the strict and of the backup list.
MOMENTUM = {"strict": (("pct_chg", 0.34), ("speed", 0.24), ("volume_ratio", 0.24), ("sixty_day_pct", 0.18)), "backup": (("pct_chg", 0.30), ("speed", 0.20), ("volume_ratio", 0.22), ("sixty_day_pct", 0.28))}
TREND = {"strict": (("sixty_day_pct", 0.55), ("ytd_pct", 0.25), ("amplitude", 0.20)), "backup": (("sixty_day_pct", 0.60), ("ytd_pct", 0.25), ("amplitude", 0.15))}
LIQUIDITY = (("turnover", 0.58), ("turnover_rate", 0.42))
EDGE = (("ret_5d", 0.18), ("ret_10d", 0.18), ("ret_20d", 0.20), ("ma20_gap", 0.14), ("vol_amount_5d", 0.12), ("volatility_20d", 0.12))
EDGE_BREAKOUT, EDGE_BULL = (72.0, 50.0, 0.04), (68.0, 50.0, 0.02)
LOWER_IS_BETTER = ("volatility_20d", "amplitude")
# Reject ladder, least change, volume ratio, turnover rate and close location; and the backup's.
LADDER = {"strict": (0.6, 0.9, 1.5, 0.25), "relaxed": (0.3, 0.75, 0.8, None), "backup": (-1.0, 0.65, 0.8, 0.15)}
HISTORY_FLOOR, BREADTH = 25.0, (55.0, 45.0)
GATE = {"strict": {"history": (60.0, 68.0, 78.0), "risk_on": 60.0, "balanced": 66.0, "risk_off": 72.0, "unknown": 70.0}, "relaxed": {"history": (56.0, 64.0, 72.0), "risk_on": 56.0, "balanced": 60.0, "risk_off": 66.0, "unknown": 62.0}}
DISPLAY, PER_THEME, PER_INDUSTRY, BACKUP_SCORE, BACKUP_CUT, BACKUP_PENALTY = 8, 5, 2, 45.0, 4.0, 6.0
PRIMARY = {"n": 5, "n_neutral": 3, "per_theme": 2, "score": 68.0, "penalty": 12.0, "damp": 0.72, "sixty": 90.0, "ytd": 130.0, "edge": 78.0, "tail": 72.0}


def _ready() -> Column:
    return F.coalesce(F.col("factor_ready"), F.lit(0)) > 0


def near_limit_up(min_turnover: float) -> Column:
    limit = F.when(F.col("market").isin("chinext", "star"), 20.0).otherwise(10.0)
    return (sc.number("pct_chg") >= limit * 0.88) & (sc.number("turnover") < min_turnover * 2)


def reject_reason(kind: str, min_turnover: float) -> Column:
    """The first rule of the ladder (strict, relaxed or backup) that a row fails; null if none."""
    change, volume, rate, location = LADDER[kind]
    p, v, t, a, s = (sc.number(c) for c in ("pct_chg", "volume_ratio", "turnover_rate", "amplitude", "speed"))
    where = sc.close_location(sc.number("price"), sc.number("high"), sc.number("low"))
    weak = [("weak_close", where < location)] if location is not None else []
    limit_up = ("near_limit_up", near_limit_up(min_turnover) & (t < 8.0))
    pace = [("speed", (s > 4.2) | (s < -2.2))]
    rules = [("change", (p <= change) | (p >= sc.upper_gain() * 0.88)), ("volume_ratio", (v < volume) | (v >= 5.0)), ("turnover_rate_low", (t > 0) & (t < rate)), ("turnover_rate_high", t >= 20.0), ("amplitude", a >= 12.0)]
    rules += pace + weak + [limit_up] if kind == "backup" else weak + [limit_up] + pace
    if min_turnover > 0:
        rules.append(("turnover", sc.number("turnover") < min_turnover))
    rules.append(("history", _ready() & ((sc.number("ret_20d") < -18) | (sc.number("ma20_gap") < -10) | (sc.number("volatility_20d") > 10))))
    out = F.lit(None).cast("string")
    for name, failed in reversed(rules):
        out = F.when(failed, name).otherwise(out)
    return out


def penalty_parts(provisional: bool = False) -> dict[str, Column]:
    """Risk penalties by name, 0 for none. Provisional rows are not judged by where they close."""
    p, a, t, v, s, px, hi, lo, op = (sc.number(c) for c in ("pct_chg", "amplitude", "turnover_rate", "volume_ratio", "speed", "price", "high", "low", "open"))
    where, ranged = sc.close_location(px, hi, lo), (px > 0) & (hi > lo) & (lo > 0) & F.lit(not provisional)
    gain = (px / F.when(op > 0, op) - 1) * 100
    r20, gap, vol = (sc.number(c) for c in ("ret_20d", "ma20_gap", "volatility_20d"))

    def past(c: Column) -> Column:
        return F.when(_ready(), c).otherwise(0.0)

    return {
        "intraday_chase": sc.smooth_penalty(p - sc.upper_gain() * 0.78, 0.0, 12.0, 3.0),
        "amplitude": sc.smooth_penalty(a, 10.0, 10.0, 1.5),
        "turnover_rate": sc.smooth_penalty(t, 16.0, 9.0, 1.0),
        "volume_ratio": sc.smooth_penalty(v, 4.5, 10.0, 2.0),
        "mid_gain_weak_close": F.when(ranged & (p >= 4.5) & (p < 7.0) & (where < 0.6), sc.smooth_penalty(where, 0.6, 7.0, 3.0, -1)).otherwise(0.0),
        "weak_tail_close": F.when(ranged & (where < 0.45), sc.smooth_penalty(where, 0.40, 10.0, 4.0, -1)).otherwise(0.0),
        "intraday_exhaustion": F.when((op > 0) & (px > 0), F.when(gain > 6, 8.0).when(gain < -1, 6.0).otherwise(0.0)).otherwise(0.0),
        "weak_volume_ratio": F.when(v < 1.05, 4.0).otherwise(0.0),
        "late_chase_speed": sc.smooth_penalty(s, 2.1, 7.0, 2.0),
        "late_fade": sc.smooth_penalty(s, -2.1, 7.0, 2.0, -1),
        "history_downtrend": past(F.when(r20 < -12, 8.0).when(r20 < -6, 4.0).otherwise(0.0)),
        "ma20_break": past(F.when(gap < -6, 6.0).otherwise(0.0)),
        "history_volatility": past(F.when(vol > 8, 7.0).when(vol > 6, 3.0).otherwise(0.0)),
    }


def tomorrow_scores(df: DataFrame, by: list[str], key: tuple[str, ...], min_turnover: float, provisional: bool = False) -> DataFrame:
    """df with reject and backup_reject (first failed rule), components, risk_penalty, damp, score and backup_score.

    df: by, key, market, level, factor_ready and the numbers that the parts name; missing ones count as 0. All rows of a group
    are compared with each other, rejected or not; historical parts among ready rows, 50 for the others.
    """
    kinds = sorted({c for parts in (*MOMENTUM.values(), *TREND.values(), LIQUIDITY, EDGE) for c, _ in parts})
    past, group = [c for c in kinds if c in HISTORICAL], Window.partitionBy(*by)
    d = df.withColumns({c: sc.number(c) for c in kinds}).withColumn("_ready", _ready())
    # Whether a column tells rows of the group apart is found where the rows are shuffled to for the percentiles.
    d = d.withColumns({f"_has_{c}": has_signal(c, by, F.col("_ready")) if c in past else F.max(F.abs(c)).over(group) > 1e-9 for c in (*past, "amplitude")})
    d = cs.percentiles_at_once(d, by, kinds, dict.fromkeys(past, "_ready"), LOWER_IS_BETTER)
    ready = F.col("_ready")

    def part(c: str, historical: bool) -> Column:
        if not historical:
            return F.col(f"{c}_pct")
        return F.when(ready & F.col(f"_has_{c}"), F.col(f"{c}_pct")).otherwise(50.0)

    def any_signal(c: str) -> Column:
        return F.when(F.col(f"_has_{c}"), F.col(f"{c}_pct")).otherwise(50.0)

    def total(parts) -> Column:
        return sum((v * w for v, w in parts), F.lit(0.0))

    edge = total((part(c, True), w) for c, w in EDGE)
    for flag, (yes, no, w) in (("breakout_20d", EDGE_BREAKOUT), ("ma_bull_aligned", EDGE_BULL)):
        edge = edge + F.when(sc.number(flag) != 0, yes).otherwise(no) * w
    momentum = {k: total((part(c, c in ("sixty_day_pct", "ytd_pct")), w) for c, w in v) for k, v in MOMENTUM.items()}
    trend = {k: total((any_signal(c) if c == "amplitude" else part(c, True), w) for c, w in v) for k, v in TREND.items()}
    d = d.withColumns({
        "momentum_score": momentum["strict"], "trend_score": trend["strict"], "_momentum_backup": momentum["backup"], "liquidity_score": total((F.col(f"{c}_pct"), w) for c, w in LIQUIDITY),
        "historical_edge_score": F.when(ready, sc.clamp(edge, 0, 100)).otherwise(50.0), "execution_score": sc.execution_score(), "tail_setup_score": F.lit(50.0) if provisional else sc.tail_setup_score(),
        "regime_bonus": sc.regime_bonus("tomorrow", min_turnover), "damp": sc.overheat_damp(),
        "reject": reject_reason("relaxed" if provisional else "strict", min_turnover), "backup_reject": reject_reason("backup", min_turnover),
        "risk_penalty_parts": F.map_filter(F.create_map(*[x for k, v in penalty_parts(provisional).items() for x in (F.lit(k), v)]), lambda _, v: v > 0),
    })
    d = d.withColumn("risk_penalty", F.aggregate(F.map_values("risk_penalty_parts"), F.lit(0.0), lambda a, v: a + v))
    d = d.withColumn("base_score", sc.combined("tomorrow"))
    backup = d.withColumn("momentum_score", F.col("_momentum_backup")).withColumn("_backup_base", sc.combined("tomorrow")).withColumn("momentum_score", momentum["strict"])

    def final(base: str, more: float) -> Column:
        return sc.clamp((F.col(base) - F.col("risk_penalty") - more + F.col("regime_bonus")) * F.col("damp"), 0, 100)

    out = backup.withColumn("score", F.round(final("base_score", 0.0), 2)).withColumn("backup_score", F.round(sc.clamp(final("_backup_base", BACKUP_PENALTY) - BACKUP_CUT, 0, 100), 2))
    return out.drop("_momentum_backup", "_backup_base", "_ready", *[f"_has_{c}" for c in (*past, "amplitude")], *[f"{c}_pct" for c in kinds if f"{c}_pct" not in df.columns])


def display_floor(kind: str = "strict") -> Column:
    """The least score shown, by the date's history breadth (breadth20_pct, where coverage_pct suffices), else by its level."""
    g, b = GATE[kind], F.col("breadth20_pct")
    strong, neutral, weak = g["history"]
    level = F.when(F.col("level") == "risk_on", g["risk_on"]).when(F.col("level") == "balanced", g["balanced"]).when(F.col("level") == "risk_off", g["risk_off"]).otherwise(g["unknown"])
    return F.when(F.coalesce("coverage_pct", F.lit(0.0)) >= HISTORY_FLOOR, F.when(b > BREADTH[0], strong).when(b > BREADTH[1], neutral).otherwise(weak)).otherwise(level)


def primary_limit(shown: Column) -> Column:
    """How many of the rows shown may be primary on the date."""
    b, most, few = F.col("breadth20_pct"), F.least(shown, F.lit(PRIMARY["n"])), F.least(shown, F.lit(PRIMARY["n_neutral"]))
    by_level = F.when(F.col("level") == "risk_off", 0).when(F.col("level") == "balanced", few).otherwise(most)
    return F.when(F.coalesce("coverage_pct", F.lit(0.0)) >= HISTORY_FLOOR, F.when(b <= BREADTH[1], 0).when(b <= BREADTH[0], few).otherwise(most)).otherwise(by_level)


def primary_blockers() -> Column:
    """Why a row shown cannot be primary: array of reasons."""
    strong = (F.col("historical_edge_score") >= PRIMARY["edge"]) & (F.col("tail_setup_score") >= PRIMARY["tail"]) & (F.col("risk_penalty") <= PRIMARY["penalty"] * 0.75)
    rules = {
        "score": F.col("score") < F.greatest(F.col("floor"), F.lit(PRIMARY["score"])), "penalty": F.round("risk_penalty", 2) > PRIMARY["penalty"], "overheated": F.round("damp", 4) < PRIMARY["damp"],
        "sixty_day_gain": (sc.number("sixty_day_pct") > PRIMARY["sixty"]) & ~strong, "year_gain": (sc.number("ytd_pct") > PRIMARY["ytd"]) & ~strong,
    }
    return F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))


def tomorrow_candidates(df: DataFrame, breadth: DataFrame, by: str, code: str, min_turnover: float, display: int = DISPLAY, provisional: bool = False) -> DataFrame:
    """The rows shown: by, code, source (strict, or backup where a date has no strict one), score, floor, place, tier, blockers.

    df as for tomorrow_scores, with theme (industry where null) and industry; breadth(by, coverage_pct, breadth20_pct). Rows that
    pass the ladder and the date's floor go in falling order of score, ties by code, through caps of five a theme and two an
    industry, `display` at most; a date without any takes the backup list, from 45 points. Primary are up to five of the strict
    rows without blockers, two a theme; all else is backup_watch, and everything on a provisional date intraday_watch.
    """
    # Only rows that pass a ladder can be shown, so only these, and what the rules below ask of them, are written.
    used = (by, code, "theme", "industry", "level", "reject", "backup_reject", "score", "backup_score", "risk_penalty", "damp", "sixty_day_pct", "ytd_pct", "historical_edge_score", "tail_setup_score")
    d = tomorrow_scores(df, [by], (by, code), min_turnover, provisional).where("reject is null or backup_reject is null").select(*used)
    d = written(d, "tomorrow-scores").join(breadth.select(by, "coverage_pct", "breadth20_pct"), by, "left")
    d = d.withColumn("floor", display_floor("relaxed" if provisional else "strict")).withColumn("_theme", F.coalesce(F.col("theme"), F.col("industry"), F.col(code).cast("string"))).withColumn("_industry", F.lower(F.coalesce("industry", F.lit(""))))
    strict = F.col("reject").isNull() & (F.col("score") >= F.col("floor"))
    has = F.max(strict.cast("int")).over(Window.partitionBy(by)) == 1
    backup = ~has & F.col("backup_reject").isNull() & (F.col("backup_score") >= BACKUP_SCORE)
    pool = d.withColumn("source", F.when(strict, "strict").when(backup, "backup")).where("source is not null")
    pool = pool.withColumn("score", F.when(F.col("source") == "strict", F.col("score")).otherwise(F.col("backup_score"))).withColumn("_down", -F.col("score"))
    shown = cs.two_caps(pool, [by], ["_down", code], "_theme", "_industry", PER_THEME, PER_INDUSTRY, display)
    shown = shown.withColumn("blockers", primary_blockers()).withColumn("_free", (F.col("source") == "strict") & (F.size("blockers") == 0) & F.lit(not provisional))
    seat = F.row_number().over(Window.partitionBy(by, "_theme", "_free").orderBy("place"))
    shown = shown.withColumn("_seated", F.col("_free") & (seat <= PRIMARY["per_theme"]))
    rank = F.row_number().over(Window.partitionBy(by, "_seated").orderBy("place"))
    strict_shown = F.sum((F.col("source") == "strict").cast("int")).over(Window.partitionBy(by))
    primary = F.col("_seated") & (rank <= primary_limit(strict_shown))
    tier = F.lit("intraday_watch") if provisional else F.when(primary, "primary_watch").otherwise("backup_watch")
    return shown.select(by, code, "source", "score", "floor", "place", tier.alias("tier"), F.concat_ws(",", "blockers").alias("blockers"))

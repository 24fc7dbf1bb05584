"""Strategies end to end: components, score, gate, diversity and tiers, for all dates at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import contracts as ct
from . import crosssection as cs
from . import scoring as sc

# Fixed values of the 2 to 5 day strategy. Parts: (factor, weight, what stands in where the factor is 0 on the whole date).
SWING_MOMENTUM = (("ret_5d", 0.24, "pct_chg"), ("ret_10d", 0.22, "sixty_day_pct"), ("ma5_gap", 0.16, "pct_chg"), ("vol_amount_5d", 0.18, "volume_ratio"), ("breakout_20d", 0.08, None))
SWING_VOLUME_RATIO = 0.12
SWING_TREND = (("ret_20d", 0.30, "sixty_day_pct"), ("sixty_day_pct", 0.26, None), ("ma20_gap", 0.22, "sixty_day_pct"), ("ytd_pct", 0.10, None), ("volatility_20d", 0.12, "amplitude"))
SWING_LIQUIDITY = (("turnover", 0.62), ("turnover_rate", 0.38))
SWING_LOWER_IS_BETTER = ("volatility_20d", "amplitude")
# Compared among rows whose history suffices only.
HISTORICAL = ("sixty_day_pct", "ytd_pct", "ret_3d", "ret_5d", "ret_10d", "ret_20d", "ma5_gap", "ma10_gap", "ma20_gap", "ma60_gap", "vol_ma5_ratio", "vol_amount_5d", "breakout_20d", "volatility_20d")
SWING_MIN_SCORE, SWING_MIN_READY, SWING_DEGRADED_LIMIT, SWING_PER_INDUSTRY = 60.0, 0.30, 8, 2


def context_scores(df: DataFrame, by: list[str], columns: list[str], key: tuple[str, ...], inverse: tuple[str, ...] = (), ready: str = "factor_ready") -> DataFrame:
    """df with <column>_pct: percentiles by group, of historical columns among ready rows alone; below two of these all are 50."""
    now, past = [c for c in columns if c not in HISTORICAL], [c for c in columns if c in HISTORICAL]
    d = cs.percentile_scores(df, by, now, inverse=inverse, key=key) if now else df
    return cs.percentile_scores(d, by, past, inverse=inverse, member=F.coalesce(F.col(ready), F.lit(0)) > 0, key=key) if past else d


def has_signal(factor: str, by: list[str], ready: Column) -> Column:
    """Whether at least two rows of the group are ready and one of them has a factor other than 0."""
    group = Window.partitionBy(*by)
    return (F.count(F.when(ready, 1)).over(group) >= 2) & (F.max(F.when(ready, F.abs(factor))).over(group) > 1e-9)


def swing_scores(df: DataFrame, by: list[str], key: tuple[str, ...], min_turnover: float, market: str | None = None) -> DataFrame:
    """Rows of the swing universe with their components, penalty, regime bonus, base_score and score.

    df: by, key (tells rows apart), market, level, factor_ready (above 0 where a row's history suffices) and the numbers that the parts name. A
    missing number counts as 0. Historical parts are 50 for a row whose history does not suffice; the others are compared among
    themselves, and where a factor is 0 on all of them, or they are fewer than two, its stand-in counts; without one, 50.
    """
    kinds = sorted({c for f, _, g in SWING_MOMENTUM + SWING_TREND for c in (f, g) if c} | {"volume_ratio"} | {c for c, _ in SWING_LIQUIDITY})
    d = ct.swing_universe(df, market)
    d = d.withColumns({c: sc.number(c) for c in kinds})
    d = context_scores(d, by, kinds, key, SWING_LOWER_IS_BETTER)
    ready = F.coalesce(F.col("factor_ready"), F.lit(0)) > 0

    def past(factor: str, instead: str | None) -> Column:
        other = F.col(f"{instead}_pct") if instead else F.lit(50.0)
        return F.when(~ready, 50.0).when(has_signal(factor, by, ready), F.col(f"{factor}_pct")).otherwise(other)

    def total(parts: list[Column]) -> Column:
        return sum(parts[1:], parts[0])

    d = d.withColumns({
        "momentum_score": total([past(f, g) * w for f, w, g in SWING_MOMENTUM] + [F.col("volume_ratio_pct") * SWING_VOLUME_RATIO]),
        "trend_score": total([past(f, g) * w for f, w, g in SWING_TREND]),
        "liquidity_score": total([F.col(f"{c}_pct") * w for c, w in SWING_LIQUIDITY]),
        "execution_score": sc.execution_score(),
        "not_overextended_score": sc.not_overextended(),
        "regime_bonus": sc.regime_bonus("swing", min_turnover),
    }).drop(*[f"{c}_pct" for c in kinds if f"{c}_pct" not in df.columns])
    return sc.with_final_score(sc.with_penalty(d, "swing"), "swing")


def swing_candidates(df: DataFrame, by: list[str], key: tuple[str, ...], min_turnover: float, top_n: int = 30, market: str | None = None) -> DataFrame:
    """swing_scores with degraded (too few rows of the group with history), place and tier; both null for rows that are not shown.

    Shown are rows of SWING_MIN_SCORE or more by falling score, at most SWING_PER_INDUSTRY an industry, the first top_n, or
    SWING_DEGRADED_LIMIT in a degraded group, where all are only watched. Ties go by key.
    """
    group, order = Window.partitionBy(*by), [F.desc("_score"), *key]
    d = swing_scores(df, by, key, min_turnover, market).withColumn("_score", F.round("score", 6))
    d = d.withColumn("degraded", F.avg(F.when(F.col("factor_ready") > 0, 1.0).otherwise(0.0)).over(group) < SWING_MIN_READY)
    seat = F.row_number().over(Window.partitionBy(*by, "industry").orderBy(*order))
    d = d.withColumn("_ok", (F.col("_score") >= SWING_MIN_SCORE) & (seat <= SWING_PER_INDUSTRY))
    d = d.withColumn("_place", F.row_number().over(group.orderBy(F.desc("_ok"), *order)).cast("bigint"))
    shown = F.col("_ok") & (F.col("_place") <= F.when(F.col("degraded"), F.least(F.lit(top_n), F.lit(SWING_DEGRADED_LIMIT))).otherwise(top_n))
    d = d.withColumn("place", F.when(shown, F.col("_place"))).withColumn("tier", F.when(shown, F.when(F.col("degraded"), "backup_watch").otherwise("primary_watch")))
    return d.drop("_score", "_ok", "_place")

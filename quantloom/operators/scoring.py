"""Scores, penalties and rankings as column expressions built from tables of bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clamp
from .filters import BUYABLE_GROWTH, BUYABLE_MAIN

INF = float("inf")

# Fixed values. Bands: (from, to, points), the first that holds counts; "[" at the ends unless noted by the builder.
VOLUME_BANDS = ((1.1, 3.2, 16), (3.2, 4.5, 6), (0.8, 1.1, -4), (4.5, INF, -14))
TURNOVER_BANDS = ((2.0, 10.0, 9), (10.0, 15.0, 4), (15.0, INF, -10))
CLOSE_BANDS = ((0.72, 2, 16), (0.60, 0.72, 6), (0.52, 0.60, 2), (-1, 0.30, -28), (0.30, 0.45, -16))
AMPLITUDE_BANDS = ((0.0, 6.8, 10), (-INF, 9.0, 4), (11.0, INF, -12))
HOT_RANKS = ((20, 100.0), (50, 88.0), (100, 76.0), (200, 62.0))
PENALTIES = {  # key: (column, threshold, most, steepness, direction)
    "swing": {"intraday_chase": ("pct_chg", 7.0, 6.0, 2.0, 1), "volume_ratio": ("volume_ratio", 5.5, 7.0, 2.0, 1), "turnover_rate": ("turnover_rate", 18.0, 6.0, 1.0, 1), "volatility": ("volatility_20d", 7.0, 7.0, 1.4, 1), "ma5_gap": ("ma5_gap", 18.0, 5.0, 0.45, 1)},
    "tomorrow": {"amplitude": ("amplitude", 10.0, 10.0, 1.5, 1), "turnover_rate": ("turnover_rate", 16.0, 9.0, 1.0, 1), "volume_ratio": ("volume_ratio", 4.5, 10.0, 2.0, 1)},
}
LEAST_PENALTY = 0.25
DAMP_FLOOR = 0.6
WEIGHTS = {
    "today": {"momentum": 0.35, "liquidity": 0.25, "industry": 0.10, "sentiment": 0.20, "risk_guard": 0.10},
    "tomorrow": {"liquidity": 0.30, "momentum": 0.20, "execution": 0.15, "tail_setup": 0.15, "historical_edge": 0.20},
    "swing": {"momentum": 0.30, "trend": 0.25, "liquidity": 0.20, "execution": 0.15, "not_overextended": 0.10},
}
REGIME_TILT = {
    "risk_on": {"momentum": 1.12, "trend": 1.08, "quality": 0.92},
    "risk_off": {"momentum": 0.82, "trend": 0.94, "quality": 1.16, "liquidity": 1.08},
    "balanced": {"momentum": 0.96, "trend": 1.0, "quality": 1.04},
}
TILTED_BY = {"momentum": "momentum", "trend": "trend", "liquidity": "liquidity", "risk_guard": "quality", "execution": "quality", "tail_setup": "quality", "historical_edge": "quality", "not_overextended": "quality"}
MODEL_WEIGHTS = {"price_volume": 0.35, "expected_return": 0.25, "event": 0.20, "probability": 0.10, "meta": 0.10}
LOCAL_WEIGHT, EXTERNAL_WEIGHT, MOST_PENALTY = 0.75, 0.25, 30.0


def number(c: str) -> Column:
    """A number of a row; a missing one counts as 0."""
    return F.coalesce(F.col(c), F.lit(0.0))


def points(c: Column, bands: Sequence[tuple[float, float, float]]) -> Column:
    """The points of the first band that holds the value, ends included; 0 outside all. A missing value counts as 0."""
    c, out = F.coalesce(c, F.lit(0.0)), F.lit(0.0)
    for low, high, p in reversed(bands):
        out = F.when((c >= low) & (c <= high), float(p)).otherwise(out)
    return out


def upper_gain(market: str = "market") -> Column:
    return F.when(F.col(market).isin("chinext", "star"), BUYABLE_GROWTH).otherwise(BUYABLE_MAIN)


def close_location(price: Column, high: Column, low: Column) -> Column:
    """Where the price stands in the day's range, 0.5 without one."""
    ok = (price > 0) & (high > low) & (low > 0)
    return F.when(ok, clamp((price - low) / F.when(high > low, high - low), 0, 1)).otherwise(0.5)


def execution_score() -> Column:
    p, up = number("pct_chg"), upper_gain()
    return F.when(p <= 0, 45.0).when(p <= up * 0.55, 88.0).when(p <= up * 0.78, 76.0).otherwise(58.0)


def not_overextended() -> Column:
    s, y = number("sixty_day_pct"), number("ytd_pct")
    cut = F.when(s > 45, F.least(F.lit(30.0), (s - 45) * 0.8)).otherwise(0.0) + F.when(y > 80, F.least(F.lit(35.0), (y - 80) * 0.6)).otherwise(0.0) + F.when(number("amplitude") > 10, 8.0).otherwise(0.0) + F.when(s < -20, 16.0).otherwise(0.0)
    return clamp(86 - cut, 0, 100)


def overheat_damp() -> Column:
    return DAMP_FLOOR + (1 - DAMP_FLOOR) * not_overextended() / 100


def hot_rank_score(rank: Column) -> Column:
    out = F.lit(52.0)
    for most, score in reversed(HOT_RANKS):
        out = F.when(rank <= most, score).otherwise(out)
    return F.when(F.coalesce(rank, F.lit(0)) == 0, 50.0).otherwise(out)


def tail_setup_score() -> Column:
    """Shape of the day near the close: change, volume ratio, turnover rate, close location, gain since the open, amplitude, speed."""
    p, up, px, op = number("pct_chg"), upper_gain(), number("price"), number("open")
    gain = (px / F.when(op > 0, op) - 1) * 100
    change = F.when((p >= 1.1) & (p <= F.least(up * 0.78, F.lit(5.5))), 20.0).when((p >= 0.6) & (p < 1.1), 10.0).when((p >= 0.4) & (p < 0.6), 2.0).when(p > up * 0.86, -22.0).when(p <= 0, -20.0).otherwise(0.0)
    since = F.when((op > 0) & (px > 0), F.when((gain >= 0.3) & (gain <= 4.8), 10.0).when(gain < 0, -10.0).when(gain > 6, -14.0).otherwise(0.0)).otherwise(0.0)
    loc = close_location(px, number("high"), number("low"))
    where = F.when(loc >= 0.72, 16.0).when(loc >= 0.60, 6.0).when(loc >= 0.52, 2.0).when(loc < 0.30, -28.0).when(loc < 0.45, -16.0).otherwise(0.0)
    a, s = number("amplitude"), number("speed")
    amp = F.when((a > 0) & (a <= 6.8), 10.0).when(a <= 9, 4.0).when(a >= 11, -12.0).otherwise(0.0)
    pace = F.when((s >= 0) & (s <= 1.6), 8.0).when((s > 1.6) & (s <= 2.4), 2.0).when((s >= -1.2) & (s < 0), -4.0).when(s > 2.4, -10.0).otherwise(-7.0)
    return clamp(52 + change + points(F.col("volume_ratio"), VOLUME_BANDS) + points(F.col("turnover_rate"), TURNOVER_BANDS) + where + since + amp + pace, 0, 100)


def smooth_penalty(c: Column, threshold: float, most: float, steepness: float, direction: int = 1) -> Column:
    """Logistic penalty; what is below LEAST_PENALTY counts as none."""
    z = clamp((F.coalesce(c, F.lit(0.0)) - threshold) * steepness * direction, -50, 50)
    p = most / (1 + F.exp(-z))
    return F.when(p >= LEAST_PENALTY, p).otherwise(0.0)


def penalty_parts(kind: str) -> dict[str, Column]:
    return {k: smooth_penalty(F.col(c), t, m, s, d) for k, (c, t, m, s, d) in PENALTIES[kind].items()}


def with_penalty(df: DataFrame, kind: str, name: str = "risk_penalty") -> DataFrame:
    """df with the penalties' sum and, as a map, the parts above 0."""
    parts = penalty_parts(kind)
    d = df.withColumn(f"{name}_parts", F.map_filter(F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]), lambda _, v: v > 0))
    return d.withColumn(name, F.aggregate(F.map_values(f"{name}_parts"), F.lit(0.0), lambda a, v: a + v))


def regime_bonus(style: str, min_turnover: float) -> Column:
    """Points for how a row stands to its date's regime; styles: short, tomorrow, swing."""
    p, v, a, t, s = (number(c) for c in ("pct_chg", "volume_ratio", "amplitude", "turnover", "sixty_day_pct"))

    def give(cond: Column, x: float) -> Column:
        return F.when(cond, x).otherwise(0.0)

    on = give(p > 0, 1.8) + give((v >= 1.1) & (v <= 4.5), 1.6) + give(t >= min_turnover * 4, 1.2) + give(a > 11, -1.5)
    off = give(s < -12, -2.5)
    if style in ("short", "tomorrow"):
        off = off + give(p > 4, -4.5) + give(v > 4.5, -2.5) + give(a > 9, -2.5)
    calm = give((v >= 1.0) & (v <= 3.5), 0.8) + give(a > 12, -1.2)
    level = F.col("level")
    return F.when(level == "risk_on", on).when(level == "risk_off", off).when(level.isNull(), 0.0).otherwise(calm)


def combined(strategy: str) -> Column:
    """Weighted sum of <component>_score columns, each tilted around 50 by its date's regime (column level)."""
    out = F.lit(0.0)
    for c, w in WEIGHTS[strategy].items():
        v = F.col(f"{c}_score")
        if k := TILTED_BY.get(c):
            tilt = F.lit(1.0)
            for level, profile in REGIME_TILT.items():
                tilt = F.when(F.col("level") == level, profile.get(k, 1.0)).otherwise(tilt)
            v = clamp(50 + (v - 50) * tilt, 0, 100)
        out = out + v * w
    return out


def with_final_score(df: DataFrame, strategy: str) -> DataFrame:
    """df(<component>_score.., risk_penalty, regime_bonus, level) -> with base_score and score, damped and clamped."""
    d = df.withColumn("base_score", combined(strategy))
    return d.withColumn("score", clamp((F.col("base_score") - F.col("risk_penalty") + F.col("regime_bonus")) * overheat_damp(), 0, 100))


def ensemble(df: DataFrame) -> DataFrame:
    """df(<model> columns, null for missing) -> with ensemble_score, dispersion, agreement."""
    s = {k: clamp(F.coalesce(F.col(k), F.lit(50.0)), 0, 100) for k in MODEL_WEIGHTS}
    total = sum(MODEL_WEIGHTS.values())
    score = sum((s[k] * w for k, w in MODEL_WEIGHTS.items()), F.lit(0.0)) / total
    spread = F.greatest(*s.values()) - F.least(*s.values())
    return df.withColumn("ensemble_score", score).withColumn("dispersion", spread).withColumn("agreement", 1 - spread / 100)


def merge_external(df: DataFrame, external: DataFrame, key: list[str]) -> DataFrame:
    """Local scores blended with a table of external ones (score, penalty, veto): 75/25 less the summed penalty capped at 30; rows
    without an external score keep their own. Vetoed rows sink; rank by (veto, -final, -local, code)."""
    e = external.select(*key, F.col("score").alias("external_score"), F.col("penalty").alias("external_penalty"), "veto")
    j = df.join(e, key, "left")
    covered = F.col("external_score").isNotNull()
    final = F.when(covered, F.col("score") * LOCAL_WEIGHT + F.col("external_score") * EXTERNAL_WEIGHT - F.least(F.lit(MOST_PENALTY), F.col("risk_penalty") + F.col("external_penalty"))).otherwise(F.col("score"))
    j = j.withColumn("final_score", clamp(final, 0, 100)).withColumn("veto", F.coalesce("veto", F.lit(False)))
    w = Window.partitionBy(*[k for k in key if k != "code"]).orderBy("veto", F.desc("final_score"), F.desc("score"), "code")
    return j.withColumn("place", F.row_number().over(w).cast("bigint"))

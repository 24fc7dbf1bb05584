"""Candidate filters: named predicates, waterfall, all failures, tradability."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_supported_code, market_type

# Fixed values.
MIN_TURNOVER = 5e7
MAX_GAIN = 12.0
BUYABLE_MAIN, BUYABLE_GROWTH = 6.5, 10.0
SPECIAL_NAME = "(?i)ST|退"


def rules(min_turnover: float = MIN_TURNOVER) -> dict[str, Column]:
    """The eight hard rules in the order in which a row is counted; each is true where the row passes."""
    p, growth = F.col("pct_chg"), market_type(F.col("code")).isin("chinext", "star")
    return {
        "unsupported_code": is_supported_code(F.col("code")),
        "special_treatment": ~F.coalesce(F.col("name"), F.lit("")).rlike(SPECIAL_NAME),
        "positive_price": F.col("price") > 0,
        "min_turnover": F.col("turnover") >= min_turnover,
        "deep_drop": p > -8,
        "max_gain": p <= MAX_GAIN,
        "buyable_gain": p <= F.when(growth, BUYABLE_GROWTH).otherwise(BUYABLE_MAIN),
        "one_word_limit": ~((F.col("high") > 0) & (F.col("high") == F.col("low")) & (p > 8)),
    }


def candidates(quotes: DataFrame, min_turnover: float = MIN_TURNOVER) -> DataFrame:
    """quotes that pass every rule, with their market."""
    keep = F.lit(True)
    for ok in rules(min_turnover).values():
        keep = keep & F.coalesce(ok, F.lit(False))
    return quotes.where(keep).withColumn("market", market_type(F.col("code")))


def first_failure(min_turnover: float = MIN_TURNOVER) -> Column:
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), k) for k, ok in rules(min_turnover).items()])


def failures(min_turnover: float = MIN_TURNOVER) -> Column:
    """All rules that a row fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), k) for k, ok in rules(min_turnover).items()]))


def filter_report(quotes: DataFrame, by: list[str], min_turnover: float = MIN_TURNOVER) -> DataFrame:
    """Waterfall by group: rows by the first rule that they fail (`passed` for none)."""
    return quotes.withColumn("reason", F.coalesce(first_failure(min_turnover), F.lit("passed"))).groupBy(*by, "reason").agg(F.count("*").alias("n"))


def tradable(limit_pct: Callable[[Column], Column] | None = None) -> tuple[Column, Column]:
    """(unbuyable at the upper limit, sealed at the lower limit) of a bar with prev_close."""
    from ..functions.scalars import daily_limit_pct

    pct = (limit_pct or daily_limit_pct)(F.col("code"))
    prev = F.col("prev_close")
    up = (prev > 0) & (F.col("open") >= prev * (1 + pct / 100) * 0.995) & (F.col("low") >= prev * (1 + pct / 100) * 0.995)
    low = prev * (1 - pct / 100)
    down = (prev > 0) & (F.col("high") <= low * 1.01) & (F.col("low") <= low * 1.005) & (F.col("price") <= low * 1.01)
    return F.coalesce(up, F.lit(False)), F.coalesce(down, F.lit(False))

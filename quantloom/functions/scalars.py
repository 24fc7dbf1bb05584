"""Column expressions used across the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SUPPORTED_PREFIXES = ("600", "601", "603", "605", "000", "001", "002", "003", "300", "301", "688")
NULL_TOKENS = ("", "-", "--", "nan", "none", "null")


def coerce_number(c: Column, default: float | None = 0.0) -> Column:
    """Text or number -> double: commas and % stripped; null tokens, NaN and infinities -> default."""
    text = F.lower(F.trim(F.regexp_replace(c.cast("string"), "[,%]", "")))
    number = F.when(~text.isin(*NULL_TOKENS), text.try_cast("double"))
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    return finite if default is None else F.coalesce(finite, F.lit(float(default)))


def normalize_code(c: Column) -> Column:
    """What stands before a dot, zero-padded to six characters, or its last six."""
    head = F.substring_index(F.trim(c.cast("string")), ".", 1)
    return F.when(F.length(head) >= 6, F.right(head, F.lit(6))).otherwise(F.lpad(head, 6, "0"))


def market_type(code: Column) -> Column:
    return F.when(code.startswith("688") | code.startswith("689"), "star").when(code.startswith("300") | code.startswith("301"), "chinext").otherwise("main")


def is_supported_code(code: Column) -> Column:
    hit = F.lit(False)
    for p in SUPPORTED_PREFIXES:
        hit = hit | code.startswith(p)
    return hit


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def nonzero(c: Column) -> Column:
    """0 means missing: null instead."""
    return F.when(c != 0, c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.when(b != 0, b)


def pct_change(a: Column, b: Column) -> Column:
    """100 * (a / b - 1), null where b is not positive."""
    return (a / F.when(b > 0, b) - 1) * 100


def style_bucket(cap: Column) -> Column:
    return F.when(cap >= 1e11, "large").when(cap >= 2e10, "mid").when(cap > 0, "small").otherwise("unknown")


def daily_limit_pct(code: Column) -> Column:
    """The exchange's price limit: 20 % on the growth boards, else 10 %."""
    return F.when(market_type(code).isin("star", "chinext"), 20.0).otherwise(10.0)

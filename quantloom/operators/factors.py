"""Rolling price and volume factors over all codes and dates at once.

Every window is on one specification (by code, in date order), so Spark sorts once. A factor that needs k bars is taken
only where the code has k bars within the look-back window; otherwise it is 0, as for a missing value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clamp, nonzero, ratio

FACTORS = ("ret_3d", "ret_5d", "ret_10d", "ret_20d", "ma5_gap", "ma10_gap", "ma20_gap", "ma60_gap", "ma_bull_aligned", "vol_amount_5d", "vol_ma5_ratio", "turnover_20d", "breakout_20d", "volatility_20d")
SHAPE_FACTORS = ("close_vs_typical_price", "upper_wick_ratio", "lower_wick_ratio", "price_position_20d", "amplitude_5d_mean")


def _spec(key: str, date: str):
    return Window.partitionBy(key).orderBy(date)


def with_factors(bars: DataFrame, key: str = "code", date: str = "trade_date", lookback: int = 120, least_bars: int | None = 6) -> DataFrame:
    """bars(key, date, open, high, low, close, volume, turnover) -> with bar_no, coverage and all FACTORS.

    Only rows with least_bars bars so far and a positive close are kept, all with None. `lookback` is the number of last bars a factor may
    use (at least 25): with 30 bars a 60-day average is unavailable on every date.
    """
    w, span = _spec(key, date), max(25, lookback)
    n = F.least(F.row_number().over(w), F.lit(span)).alias("n")
    close, zero = F.col("close"), F.lit(0.0)

    def back(c: str, k: int) -> Column:
        return F.lag(c, k).over(w)

    def over(f, c, k: int, end: int = 0) -> Column:
        return f(c).over(w.rowsBetween(-k + 1 + end, end))

    b = bars.withColumn("bar_no", F.row_number().over(w)).withColumn("n", n).withColumn("r1", ratio(close, back("close", 1)) - 1)
    for k in (5, 10, 20, 60):
        b = b.withColumn(f"_ma{k}", over(F.avg, "close", k))
    b = b.withColumn("_t5", over(F.avg, "turnover", 5)).withColumn("_t5p", F.when(F.col("n") >= 10, over(F.avg, "turnover", 5, -5)).otherwise(F.col("_t5")))
    b = b.withColumn("_h20", over(F.max, "high", 20)).withColumn("_v5", over(F.avg, "volume", 5)).withColumn("turnover_20d", over(F.avg, "turnover", 20))
    b = b.withColumn("_sd", over(F.stddev_samp, "r1", 20))
    for k in (3, 5, 10, 20):
        b = b.withColumn(f"_c{k}", F.when(F.col("n") > k, back("close", k)))

    def ret(k: int) -> Column:
        base = F.col(f"_c{k}")
        return F.coalesce((close / F.when(base > 0, base) - 1) * 100, zero).alias(f"ret_{k}d")

    def gap(k: int) -> Column:
        m = F.col(f"_ma{k}")
        return F.when((F.col("n") >= k) & (m > 0), (close / nonzero(m) - 1) * 100).otherwise(zero).alias(f"ma{k}_gap")

    n_ = F.col("n")
    bull = (n_ >= 60) & (F.round(F.col("_ma5") - F.col("_ma10"), 9) > 0) & (F.round(F.col("_ma10") - F.col("_ma20"), 9) > 0) & (F.round(F.col("_ma20") - F.col("_ma60"), 9) > 0)
    ready = [F.col(f"_c{k}") > 0 for k in (3, 5, 10, 20)] + [n_ >= 5, n_ >= 20, (n_ >= 10) & (F.col("_t5p") > 0), (n_ >= 20) & (F.col("_h20") > 0), n_ >= 21]
    coverage = sum((F.coalesce(c, F.lit(False)).cast("int") for c in ready), F.lit(0)) / len(ready)
    few = F.coalesce(F.col("_sd"), zero) * 100  # fewer than 20 returns: those there are
    out = b.select(
        *bars.columns, "bar_no", *[ret(k) for k in (3, 5, 10, 20)], *[gap(k) for k in (5, 10, 20, 60)],
        F.when(bull, 1.0).otherwise(zero).alias("ma_bull_aligned"),
        F.coalesce(ratio(F.col("_t5"), F.col("_t5p")), zero).alias("vol_amount_5d"),
        F.coalesce(ratio(F.col("volume"), F.col("_v5")), zero).alias("vol_ma5_ratio"),
        "turnover_20d",
        F.when((F.col("_h20") > 0) & (close >= F.col("_h20") * 0.995), 1.0).otherwise(zero).alias("breakout_20d"),
        few.alias("volatility_20d"), coverage.alias("coverage"),
    )
    return out if least_bars is None else out.where((F.col("bar_no") >= least_bars) & (F.col("close") > 0))


def with_shape_factors(bars: DataFrame, key: str = "code", date: str = "trade_date") -> DataFrame:
    """bars -> with wick ratios, close against typical price, 20-day position, 5-day amplitude and streaks."""
    w = _spec(key, date)
    w20 = w.rowsBetween(-19, 0)
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    typical, span = (h + low + c) / 3, h - low
    prev = F.lag("close").over(w)
    b = bars.withColumn("_h20", F.max("high").over(w20)).withColumn("_l20", F.min("low").over(w20)).withColumn("_amp", F.when(prev > 0, span / nonzero(prev) * 100))
    b = with_streaks(b, key, date)
    zero = F.lit(0.0)
    return b.select(
        *bars.columns,
        F.coalesce((ratio(c, typical) - 1) * 100, zero).alias("close_vs_typical_price"),
        F.when(span > 0, clamp((h - F.greatest(o, c)) / nonzero(span), 0, 1)).otherwise(zero).alias("upper_wick_ratio"),
        F.when(span > 0, clamp((F.least(o, c) - low) / nonzero(span), 0, 1)).otherwise(zero).alias("lower_wick_ratio"),
        F.when(F.col("_h20") > F.col("_l20"), clamp((c - F.col("_l20")) / nonzero(F.col("_h20") - F.col("_l20")) * 100, 0, 100)).otherwise(50.0).alias("price_position_20d"),
        F.coalesce(F.avg("_amp").over(w.rowsBetween(-4, 0)), zero).alias("amplitude_5d_mean"),
        "up_days", "down_days",
    )


def with_streaks(bars: DataFrame, key: str = "code", date: str = "trade_date") -> DataFrame:
    """bars -> with up_days, down_days: length of the current run of rising or falling closes (0 after an unchanged close)."""
    w = _spec(key, date)
    move = F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)).cast("int"), F.lit(0))
    b = bars.withColumn("_dir", move).withColumn("_new", F.when(F.lag("_dir").over(w) == F.col("_dir"), 0).otherwise(1))
    b = b.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.row_number().over(Window.partitionBy(key, "_island").orderBy(date)).cast("bigint")
    b = b.withColumn("_run", run)
    zero = F.lit(0).cast("bigint")
    return b.select(*bars.columns, F.when(F.col("_dir") > 0, F.col("_run")).otherwise(zero).alias("up_days"), F.when(F.col("_dir") < 0, F.col("_run")).otherwise(zero).alias("down_days"))


def with_trend_factors(bars: DataFrame, key: str = "code", date: str = "trade_date", least_bars: int = 25) -> DataFrame:
    """bars -> long-trend columns: 60-day return, MA20 and MA60 gaps, 60-day drawdown, risk-adjusted momentum, trend flags."""
    w = _spec(key, date)
    c = F.col("close")

    def over(f, col, k):
        return f(col).over(w.rowsBetween(-k + 1, 0))

    b = bars.withColumn("bar_no", F.row_number().over(w)).withColumn("r1", ratio(c, F.lag("close").over(w)) - 1)
    b = b.withColumn("_c20", F.lag("close", 20).over(w)).withColumn("_c60", F.lag("close", 60).over(w)).withColumn("_ma20", over(F.avg, "close", 20)).withColumn("_ma60", over(F.avg, "close", 60)).withColumn("_peak", over(F.max, "close", 60)).withColumn("_sd", over(F.stddev_samp, "r1", 20))
    b = b.where(F.col("bar_no") >= least_bars)
    ret20, gap20 = (c / F.when(F.col("_c20") > 0, F.col("_c20")) - 1) * 100, (c / nonzero(F.col("_ma20")) - 1) * 100
    gap60 = F.when(F.col("bar_no") >= 60, (c / nonzero(F.col("_ma60")) - 1) * 100).otherwise(0.0)
    vol = F.col("_sd") * 100
    ahead = F.round(F.col("_ma20") - F.col("_ma60"), 9)  # equal averages differ in their last bits
    return b.select(
        *bars.columns, F.coalesce(ret20, F.lit(0.0)).alias("trend_ret_20d"),
        F.coalesce((c / F.when(F.col("_c60") > 0, F.col("_c60")) - 1) * 100, F.lit(0.0)).alias("trend_ret_60d"),
        gap20.alias("trend_ma20_gap"), gap60.alias("trend_ma60_gap"),
        ((c / nonzero(F.col("_peak")) - 1) * 100).alias("drawdown_60d"),
        F.coalesce(ret20 / nonzero(vol), F.lit(0.0)).alias("risk_adjusted_momentum"),
        ((gap20 > 0) & (ahead > 0)).alias("uptrend"),
        ((gap20 < 0) & (ahead < 0)).alias("downtrend"),
    )

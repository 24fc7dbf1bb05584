"""Replay of the next-day strategy over past dates, as research samples that a second run does not save twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import market_type
from ..sources.batches import save_batches, stored
from . import crosssection as cs
from . import factors as fx
from . import filters as ft
from . import tomorrow as tm

VERSION = "tomorrow_picks_replay"


def replay_rows(bars: DataFrame, names: DataFrame, min_turnover: float, top_n: int = 10, lookback: int = 30, future_days: int = 3) -> DataFrame:
    """bars(code, ...), names(code, symbol, name) -> trade_date, code, place, score of what the strategy would have shown on each date.

    A code counts on a date if it has `lookback` bars up to it, so that nothing later is seen, and future_days after it, so that
    the sample can be labelled. Its factors are of the last bars up to the date. Candidates are filtered, the regime is theirs,
    and scores are the live strategy's; bars have no turnover rate and no trustworthy industry. All dates are one job.
    """
    w = Window.partitionBy("code").orderBy("trade_date")
    b = bars.withColumn("_left", F.count("*").over(w.rowsBetween(1, Window.unboundedFollowing))).withColumn("prev_close", F.lag("close").over(w)).withColumn("_p60", F.lag("close", 60).over(w)).withColumn("_p120", F.lag("close", 120).over(w)).withColumn("_first", F.first("close").over(w))
    f = fx.with_factors(b, lookback=max(lookback, 30)).where((F.col("bar_no") >= lookback) & (F.col("_left") >= max(1, future_days)) & (F.col("close") > 0))

    def change(now, then):
        return F.coalesce((now / F.when(then > 0, then) - 1) * 100, F.lit(0.0))

    x = f.join(names.select("code", "symbol", "name"), "code").select(
        F.col("code").alias("id"), F.col("symbol").alias("code"), "name", "trade_date", F.col("close").alias("price"), "open", "high", "low", "prev_close", "turnover", "volume", change(F.col("close"), F.col("prev_close")).alias("pct_chg"), F.coalesce((F.col("high") - F.col("low")) / F.col("prev_close") * 100, F.lit(0.0)).alias("amplitude"),
        F.when(F.col("vol_ma5_ratio") != 0, F.col("vol_ma5_ratio")).when(F.col("vol_amount_5d") != 0, F.col("vol_amount_5d")).otherwise(1.0).alias("volume_ratio"), F.lit(0.0).alias("turnover_rate"), F.lit(0.0).alias("speed"), change(F.col("close"), F.col("_p60")).alias("sixty_day_pct"), change(F.col("close"), F.coalesce("_p120", "_first")).alias("ytd_pct"),
        "ret_5d", "ret_10d", "ret_20d", "ma20_gap", "vol_amount_5d", "volatility_20d", "breakout_20d", "ma_bull_aligned", F.lit(1).alias("factor_ready"), F.lit(None).cast("string").alias("industry"), F.lit(None).cast("string").alias("theme"),
    )
    x = ft.candidates(x, min_turnover).withColumn("market", market_type(F.col("code")))
    x = cs.with_market_level(x.where("trade_date is not null"))
    s = tm.tomorrow_scores(x, ["trade_date"], ("id", "trade_date"), min_turnover).where("reject is null")
    place = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("score"), "id"))
    return s.withColumn("place", place.cast("bigint")).where(F.col("place") <= top_n).select("trade_date", F.col("id").alias("code"), "place", "score")


def backfill(table: str, rows: DataFrame, replay_days: int | None = None, version: str = VERSION, strategy: str = "tomorrow_picks") -> DataFrame:
    """Save the replayed rows of dates that the table does not hold yet, the newest replay_days of them (all if None), as replay batches
    -> strategy, saved, replaced. Dates saved by an earlier run are left as they are, so a second run over them adds nothing."""
    new = rows.select(F.lit(strategy).alias("strategy"), F.lit(version).alias("version"), F.col("trade_date").alias("signal_date"), F.lit("replay").alias("phase"), "code", "place", "score")
    schema = new.withColumn("slot", F.lit("")).withColumn("month", F.lit("")).schema
    old = stored(rows.sparkSession, table, schema)
    if old is not None:
        done = old.where((F.col("strategy") == strategy) & (F.col("version") == version)).select("signal_date").distinct()
        new = new.join(done, "signal_date", "left_anti")
    if replay_days is not None:
        dates = new.select("signal_date").distinct().orderBy(F.desc("signal_date")).limit(max(1, replay_days))
        new = new.join(dates, "signal_date", "left_semi")
    return save_batches(table, new)

"""Outcomes of signals by entry rule, as a ladder of states: what became of a signal that could perhaps not be filled or sold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import nonzero
from ..sources.shared import written
from .execution import ExitPolicy, numbered, sealed_limit_down, simulate_exits

# Fixed values.
BRANCHES = ("close_auction", "post_1430", "today")
LIMIT_UP = 0.995
STALE_DAYS = 30
WINDOWS = (3, 5, 10, 20)


def unbuyable_limit_up(prev: Column, limit_pct: Column) -> Column:
    """The whole day at the upper limit, so that nothing could be bought."""
    limit, op, hi, lo, close = prev * (1 + F.greatest(F.lit(1.0), limit_pct) / 100), *(F.coalesce(nonzero(F.col(c)), F.col("close")) for c in ("open", "high", "low", "close"))
    return F.coalesce((prev > 0) & (F.least(op, hi, lo, close) > 0) & (op >= limit * LIMIT_UP) & (lo >= limit * LIMIT_UP) & (hi <= limit * 1.01) & (close >= limit * LIMIT_UP), F.lit(False))


def entry_outcomes(signals: DataFrame, bars: DataFrame, today: str, policy: ExitPolicy = ExitPolicy(), delay_days: int = 10) -> DataFrame:
    """signals(signal_id, code, signal_date, branch, price_at_signal, holding_days, limit_pct, delisted) -> the outcome of each.

    branch: close_auction (bought at the day's close, sold at the next one), post_1430 (bought at price_at_signal, sold by the
    exit rules within holding_days), today (price_at_signal against the day's close, no trade). States, with their reason:

      unknown   no bar on the signal's day, or none after it for STALE_DAYS up to `today`
      unfilled  no price, or at the upper limit, so that nobody could buy
      pending   bought, and what it takes to sell has not happened yet (delay_days bars beyond the windows are looked at)
      settled   sold; a delisted stock that ran out of bars at its last close, flagged survivorship_corrected

    Returns count from the entry price: of the closes 3, 5, 10 and 20 bars on (the last one where there are fewer), best and
    worst price of three bars. One numbered table of bars serves entry, future and exits; nothing is joined by range.
    """
    b = written(numbered(bars), "outcome-bars")
    on = b.select("code", F.col("trade_date").alias("signal_date"), "idx", "open", "high", "low", "close", F.coalesce("prev_close", F.lit(0.0)).alias("prev_close"))
    d = signals.join(on, ["code", "signal_date"], "left")
    entry = F.when(F.col("branch") == "close_auction", F.col("close")).otherwise(F.col("price_at_signal"))
    d = d.withColumn("entry_price", F.coalesce(entry, F.lit(0.0)))
    at_limit = (F.col("prev_close") > 0) & (F.col("entry_price") >= F.col("prev_close") * (1 + F.greatest(F.lit(1.0), F.col("limit_pct")) / 100) * LIMIT_UP)
    blocked = F.when(F.col("branch") == "post_1430", at_limit).when(F.col("branch") == "close_auction", unbuyable_limit_up(F.col("prev_close"), F.col("limit_pct"))).otherwise(F.lit(False))
    d = written(d.withColumn("_blocked", F.coalesce(blocked, F.lit(False))).withColumn("_stale", F.date_diff(F.lit(today).cast("date"), "signal_date") >= STALE_DAYS), "outcome-entries")

    far, live = max(WINDOWS) + delay_days, (F.col("branch") != "today") & F.col("idx").isNotNull() & (F.col("entry_price") > 0) & ~F.col("_blocked")
    ahead = d.where(live).select("signal_id", "code", "branch", "entry_price", "holding_days", "limit_pct", F.posexplode(F.sequence(F.col("idx") + 1, F.col("idx") + far)).alias("step", "idx"))
    ahead = ahead.join(b.select("code", "idx", "trade_date", "open", "high", "low", "close", "prev_close"), ["code", "idx"])
    step, close = F.col("step"), F.col("close")
    # The next close; on a sealed day, the open of the first bar after it that is not sealed.
    sealed_first = F.max(F.when(step == 0, sealed_limit_down(F.col("entry_price"), F.col("limit_pct"))))
    free = F.when((step > 0) & ~sealed_limit_down(F.col("prev_close"), F.col("limit_pct")), step)
    marks = ahead.groupBy("signal_id").agg(
        F.count("*").alias("future_days"), *[F.max_by("close", F.when(step < n, step)).alias(f"close_{n}d") for n in (1, *WINDOWS)], F.max(F.when(step == 0, F.col("open"))).alias("next_open"),
        F.max(F.when(step < 3, F.col("high"))).alias("_high"), F.min(F.when(step < 3, F.col("low"))).alias("_low"), sealed_first.alias("_sealed"), F.min_by(F.struct("step", F.coalesce(nonzero(F.col("open")), close).alias("px"), "trade_date"), free).alias("_free"),
        F.min_by("trade_date", step).alias("next_date"), F.max_by(F.struct("step", close.alias("px"), "trade_date"), step).alias("_last"),
    )
    exits = simulate_exits(ahead.where("branch = 'post_1430'"), policy).select("signal_id", F.col("exit_price").alias("_px"), F.col("exit_reason").alias("_why"), F.col("exit_days").alias("_days"), F.col("exit_date").alias("_date"))
    d = d.join(marks, "signal_id", "left").join(exits, "signal_id", "left")

    branch, none = F.col("branch"), F.coalesce("future_days", F.lit(0)) == 0
    short = (F.col("_why") == "hold_to_term") & (F.col("future_days") < F.col("holding_days"))
    gone = short & F.coalesce("delisted", F.lit(False))
    ladder = [
        (F.col("idx").isNull() & (branch == "today") & ~F.col("_stale"), "pending", "signal_day_bar_missing"), (F.col("idx").isNull(), "unknown", "signal_day_bar_missing"),
        ((branch == "today") & ((F.col("entry_price") <= 0) | (close <= 0)), "unknown", "reference_or_close_invalid"), (branch == "today", "settled", "same_day_close_observation"),
        (F.col("entry_price") <= 0, "unfilled", "invalid_entry_price"), (F.col("_blocked"), "unfilled", "limit_up_unfilled"), (none & F.col("_stale"), "unknown", "no_bar_since"), (none, "pending", "waiting_for_next_day"),
        ((branch == "close_auction") & ~F.col("_sealed"), "settled", "next_close"), ((branch == "close_auction") & F.col("_free").isNotNull(), "settled", "limit_down_delayed_to_open"), (branch == "close_auction", "pending", "limit_down_exit_pending"),
        (gone, "settled", "delisted_last_tradable"), (short, "pending", "insufficient_future"), (F.col("_why").endswith("_unfilled"), "pending", "exit_unfilled"),
    ]
    state, reason = F.lit("settled"), F.col("_why")
    for holds, s, r in reversed(ladder):
        state, reason = F.when(holds, s).otherwise(state), F.when(holds, r).otherwise(reason)
    d = d.withColumn("state", state).withColumn("reason", reason)
    why = F.col("reason")
    price = F.when(branch == "today", close).when(why == "next_close", F.col("close_1d")).when(why == "limit_down_delayed_to_open", F.col("_free.px")).when(why == "delisted_last_tradable", F.col("_last.px")).otherwise(F.col("_px"))
    days = F.when(branch == "today", 0).when(why == "next_close", 1).when(why == "limit_down_delayed_to_open", F.col("_free.step") + 1).when(why == "delisted_last_tradable", F.col("_last.step") + 1).otherwise(F.col("_days"))
    date = F.when(branch == "today", F.col("signal_date")).when(why == "next_close", F.col("next_date")).when(why == "limit_down_delayed_to_open", F.col("_free.trade_date")).when(why == "delisted_last_tradable", F.col("_last.trade_date")).otherwise(F.col("_date"))
    settled, traded, filled = F.col("state") == "settled", (F.col("state") == "settled") & (branch != "today"), (branch != "today") & F.col("state").isin("settled", "pending") & (F.col("entry_price") > 0)

    def since(c: Column) -> Column:
        return F.when(traded, (c / F.col("entry_price") - 1) * 100)

    return d.select(
        "signal_id", "code", "signal_date", "branch", "state", "reason", F.when(filled | settled, F.col("entry_price")).alias("entry_price"), F.coalesce("future_days", F.lit(0)).cast("bigint").alias("future_days"),
        since(F.when(F.col("next_open") > 0, F.col("next_open"))).alias("next_open_return"), since(F.col("close_1d")).alias("return_1d"), *[since(F.col(f"close_{n}d")).alias(f"return_{n}d") for n in WINDOWS], since(F.col("_high")).alias("max_gain_3d"), since(F.col("_low")).alias("max_drawdown_3d"),
        F.when(traded, F.col("_high") / F.col("entry_price") - 1 >= 0.03).alias("hit_3pct"), F.when(traded, F.col("_high") / F.col("entry_price") - 1 >= 0.05).alias("hit_5pct"),
        F.when(settled, price).alias("exit_price"), F.when(settled, (price / F.col("entry_price") - 1) * 100).alias("exit_return"), F.when(settled, days).cast("bigint").alias("exit_days"), F.when(settled, date).alias("exit_date"),
        F.when(branch == "today", F.when(settled, "observation_closed")).when(settled, "closed").when(F.col("state") == "unfilled", "not_entered").when(filled & why.isin("limit_down_exit_pending", "exit_unfilled"), "exit_pending").when(filled, "open_position").alias("position"),
        (why == "delisted_last_tradable").alias("survivorship_corrected"),
    )

"""Rolling factor backtest and exit-policy comparison: all dates, codes and policies in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .execution import CostPolicy, ExitPolicy, slippage_pct
from .factors import with_factors
from .stats import net_asset_value

# The linear signal.
SIGNAL_WEIGHTS = {"ret_5d": 0.20, "ret_10d": 0.22, "ret_20d": 0.25, "ma20_gap": 0.14, "vol_amount_5d": 2.0, "breakout_20d": 4.0, "volatility_20d": -0.35}


def linear_signal(weights: dict[str, float] | None = None) -> Column:
    out = F.lit(0.0)
    for c, w in (weights or SIGNAL_WEIGHTS).items():
        out = out + F.col(c) * w
    return out


def trades(bars: DataFrame, holding_days: int = 3, lookback: int = 30, costs: CostPolicy = CostPolicy(), weights: dict[str, float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each code and date with `lookback` bars before and holding_days after: signal, gross and net return to term.

    The close at the exit is a lead over the factors' own window: no further shuffle. keep: factor columns to carry along.
    """
    w = Window.partitionBy("code").orderBy("trade_date")
    ahead = bars.withColumn("_exit", F.lead("close", holding_days).over(w)).withColumn("_exit_date", F.lead("trade_date", holding_days).over(w))
    f = with_factors(ahead, lookback=lookback).where((F.col("bar_no") > lookback) & (F.col("_exit") > 0))
    gross = (F.col("_exit") / F.col("close") - 1) * 100
    cost = costs.fee_pct + slippage_pct(F.col("turnover"), costs)
    return f.select("code", "trade_date", F.col("_exit_date").alias("exit_date"), linear_signal(weights).alias("signal"), F.col("close").alias("entry_price"), gross.alias("gross_return"), cost.alias("cost_pct"), (gross - cost).alias("net_return"), *keep)


def daily_top_k(rows: DataFrame, k: int = 10, by: str = "trade_date", score: str = "signal") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), "code")
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def rolling_backtest(bars: DataFrame, top_k: int = 10, holding_days: int = 3, lookback: int = 30, step: int = 1, last_dates: int = 80) -> DataFrame:
    """Equity by rebalance date: the last `last_dates` dates, every step-th, top_k by signal, equal weights.

    One row a date is all that the unpartitioned last windows see.
    """
    t = trades(bars, holding_days, lookback)
    dates = t.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(last_dates)
    dates = dates.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("trade_date"))).where((F.col("_i") - 1) % step == 0)
    picked = daily_top_k(t.join(F.broadcast(dates.select("trade_date")), "trade_date"), top_k)
    daily = picked.groupBy("trade_date").agg(F.count("*").alias("holdings"), F.avg("net_return").alias("period_return"), F.avg("cost_pct").alias("avg_cost")).withColumn("book", F.lit("all"))
    return net_asset_value(daily, ["book"], "trade_date", "period_return").drop("book", "peak")


def backtest_metrics(equity: DataFrame) -> DataFrame:
    """One row: periods, average, win rate, total return, worst drawdown, best and worst period."""
    r = F.col("period_return")
    return equity.agg(F.count("*").alias("period_count"), F.avg(r).alias("avg_period_return"), (F.avg((r > 0).cast("double")) * 100).alias("win_rate"), ((F.max_by("nav", "trade_date") - 1) * 100).alias("total_return"), F.min("drawdown").alias("max_drawdown"), F.max(r).alias("best_period"), F.min(r).alias("worst_period"))


def candidate_weights_objective(rows: DataFrame, weights: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """Every weight vector of a search step at once: weights(candidate, <columns>) x factor rows -> average and win rate of the daily
    top k. Factors, exits and costs do not depend on the weights and are made once; weights are a handful of rows."""
    score = sum((F.col(c) * F.col(f"w_{c}") for c in columns), F.lit(0.0))
    v = weights.select("candidate", *[F.col(c).alias(f"w_{c}") for c in columns]).collect()
    each = F.explode(F.array(*[F.struct(F.lit(r["candidate"]).alias("candidate"), *[F.lit(float(r[f"w_{c}"])).alias(f"w_{c}") for c in columns]) for r in v]))
    x = rows.withColumn("_w", each).select(*rows.columns, "_w.*").withColumn("signal", score)
    top = x.withColumn("rank", F.row_number().over(Window.partitionBy("candidate", "trade_date").orderBy(F.desc("signal"), "code"))).where(F.col("rank") <= k)
    day = top.groupBy("candidate", "trade_date").agg(F.avg("net_return").alias("r"))
    return day.groupBy("candidate").agg(F.count("*").alias("days"), F.avg("r").alias("avg_return"), (F.avg((F.col("r") > 0).cast("double")) * 100).alias("win_rate"), F.expr("percentile(r, 0.25)").alias("q25"))


def walk_forward(dates: DataFrame, folds: int = 4, test_days: int = 20, purge: int = 5) -> DataFrame:
    """dates(trade_date) -> fold, trade_date, part (train or test): the last folds of test_days dates, train before them less a purge."""
    d = dates.select("trade_date").distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("trade_date")))
    n = F.max("i").over(Window.partitionBy(F.lit(0)))
    f = d.withColumn("n", n).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = F.col("n") - (folds - F.col("fold")) * test_days + 1
    part = F.when((F.col("i") >= start) & (F.col("i") < start + test_days), "test").when(F.col("i") < start - purge, "train")
    return f.withColumn("part", part).where("part is not null").select(F.col("fold").cast("bigint").alias("fold"), "trade_date", "part")

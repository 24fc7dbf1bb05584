"""Queries on outcome states, the point-in-time audit, merged sources and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as au
from ..operators import merging as mg
from ..operators import outcomes as oc
from ..operators import replay as rp
from ..operators import samples as sp
from ..sources import tables as tb
from ..sources.shared import shared_path, written
from .market import FLOOR, rounded
from .trading import _outcomes
from .views import with_views

TODAY = "1998-12-31"


def _branched(spark, d):
    """Signals with an entry rule by strategy, a reference price, a holding period, a limit and delisted codes."""
    s, k = tb.signals(spark, d), F.col("strategy").cast("int")
    branch = F.when(k <= 2, "close_auction").when(k <= 4, "post_1430").otherwise("today")
    return s.select(
        "signal_id", "code", "signal_date", branch.alias("branch"), F.when(F.col("signal_id") % 97 != 5, 100 + F.col("score") / 10).alias("price_at_signal"), F.when(k == 3, 1).otherwise(5).alias("holding_days"),
        F.when(F.col("code") % 5 == 1, 20.0).when(F.col("code") % 7 == 2, 3.0).otherwise(10.0).alias("limit_pct"), (F.col("code") % 11 == 5).alias("delisted"),
    )


RETURNS = ["entry_price", "next_open_return", "return_1d", "return_3d", "return_5d", "return_10d", "return_20d", "max_gain_3d", "max_drawdown_3d", "exit_price", "exit_return"]


def x18_states(spark, d):
    """Outcomes of signals under three entry rules: settled, pending, unfilled or unknown, and why."""
    return rounded(oc.entry_outcomes(_branched(spark, d), tb.bars(spark, d), TODAY), *RETURNS)


def _evidence(spark, d):
    """Every signal as a candidate with its evidence: most of it seen before the cut-off, some after, some missing."""
    i, cut = F.col("signal_id"), F.col("signal_date").cast("timestamp") + F.expr("interval 14 hours 30 minutes")

    def at(minutes):
        return cut + F.make_dt_interval(mins=F.lit(minutes) if isinstance(minutes, int) else minutes)

    late = F.when(i % 37 == 4, 45).otherwise(-30)
    keys = [f"model_input.{c}" for c in ("price", "score", "turnover")]
    return tb.signals(spark, d).select(
        F.col("signal_id").alias("candidate_id"), cut.alias("cutoff"),
        F.map_filter(F.create_map(F.lit("quote_observed_at"), at(late), F.lit("market_data_cutoff"), F.when(i % 53 != 7, at(0)), F.lit("event_loaded_at"), at(F.when(i % 41 == 9, 5).otherwise(-5))), lambda _, v: v.isNotNull()).alias("source_times"),
        F.when(i % 29 == 3, F.array(at(-60), at(90), at(120))).otherwise(F.array(at(-60))).alias("announcements"),
        F.map_filter(F.create_map(*[x for n, k in enumerate(keys) for x in (F.lit(k), F.when(i % 61 != 11 + n, at(F.when(i % 67 == 13 + n, 1).otherwise(-20))))]), lambda _, v: v.isNotNull()).alias("feature_times"),
        F.create_map(*[x for k in keys for x in (F.lit(k), F.col("score"))]).alias("features"),
        F.map_filter(F.create_map(*[x for n, k in enumerate(keys) for x in (F.lit(k), F.when(i % 71 != 17 + n, i % 13 == n))]), lambda _, v: v.isNotNull()).alias("missing"),
        (i % 43 != 8).alias("point_in_time_valid"), F.when(i % 47 != 10, F.array(F.lit("eligible"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )


def a32_point_in_time(spark, d):
    """What each candidate's evidence shows that could not be known at its cut-off."""
    return au.evidence_violations(_evidence(spark, d))


def _records(spark, d):
    """Outcomes as execution records, with slips planted by the rules that the audit looks for."""
    i = F.col("signal_id")
    o = oc.entry_outcomes(_branched(spark, d), tb.bars(spark, d), TODAY).where("branch <> 'today'")
    b = tb.bars(spark, d).select("code", "trade_date", "low", "high", "close")
    o = o.join(b.select("code", F.col("trade_date").alias("signal_date"), F.col("close").alias("_in")), ["code", "signal_date"], "left").join(b.select("code", F.col("trade_date").alias("exit_date"), F.col("low").alias("exit_low"), F.col("high").alias("exit_high")), ["code", "exit_date"], "left")
    settled, n = F.col("state") == "settled", F.lit(1000.0)
    gross = F.col("exit_return") + F.when(i % 31 == 6, 0.01).otherwise(0.0)
    gone = F.when(F.col("survivorship_corrected"), "liquidated_last_tradable").otherwise("not_applicable")
    return o.select(
        F.col("signal_id").alias("candidate_id"), F.when(i % 89 != 12, i).alias("signal_id"), F.when(i % 101 != 20, F.col("state")).otherwise("lost").alias("state"), "entry_price", "exit_price", F.when(settled, gross).otherwise(F.when((F.col("state") == "unknown") & (i % 5 == 1), 1.0)).alias("gross"), F.when(settled & (i % 59 != 14), gross - 0.5).alias("net"),
        F.lit(0.25).alias("fee_pct"), F.lit(0.2).alias("slippage_pct"), F.when(i % 73 == 19, 0.06).otherwise(0.05).alias("impact_pct"), F.lit(0.5).alias("base_total"), F.lit(0.25).alias("exp_fee_pct"), F.lit(0.2).alias("exp_slippage_pct"), F.lit(0.05).alias("exp_impact_pct"),
        F.when(F.col("branch") == "close_auction", F.col("_in")).otherwise(F.col("entry_price")).alias("raw_entry"), "exit_low", "exit_high",
        n.alias("order_quantity"), F.when(F.col("state") == "unfilled", 0.0).otherwise(F.when(i % 79 == 21, 900.0).otherwise(n)).alias("filled_quantity"), F.when(settled, n).otherwise(0.0).alias("exit_quantity"),
        F.when(F.col("state") == "unfilled", n).otherwise(0.0).alias("unfilled_quantity"), F.when(F.col("state") == "unfilled", F.when(i % 3 == 0, 400.0).otherwise(n)).otherwise(0.0).alias("unfilled_entry_quantity"), F.lit(0.0).alias("unfilled_exit_quantity"),
        F.lit("p1").alias("batch_policy"), F.when(i % 83 != 22, "p1").otherwise("p2").alias("record_policy"), (settled | (i % 7 == 1)).alias("promotion_eligible"), gone.alias("delisting"),
        F.map_filter(F.create_map(*[x for k, m in (("market", 23), ("industry", 24), ("style", 25)) for x in (F.lit(k), F.when(i % 91 != m, F.struct(F.when(i % 93 != m, F.lit(1.0) + F.when(i % 95 == m, 0.5).otherwise(0.0)).alias("return_pct"), F.array(F.lit(0.5), F.lit(1.5), F.lit(None).cast("double")).alias("constituents"))))]), lambda _, v: v.isNotNull()).alias("benchmarks"),
    )


def a41_execution(spark, d):
    """What the execution records say that cannot be recomputed from what they hold."""
    return au.execution_violations(_records(spark, d))


def j17_conservation(spark, d):
    """Batches, candidates, signals and outcomes counted against each other."""
    key, i = ["strategy", "signal_date"], F.col("signal_id")
    s = tb.signals(spark, d).select(*key, "signal_id", "rank")
    o = oc.entry_outcomes(_branched(spark, d), tb.bars(spark, d), TODAY).select("signal_id", "state")
    candidates = s.select(*key, (i % 3 != 0).alias("selected"), ((i % 3 != 0) | (i % 4 == 0)).alias("eligible"))
    kept = s.where("signal_id % 3 <> 0")
    batches = s.groupBy(*key).agg(F.sum((i % 3 != 0).cast("bigint")).alias("saved_count"), (F.count("*") + F.when(F.min(i) % 19 == 2, 1).otherwise(0)).alias("candidate_count"), F.sum((i % 3 != 0).cast("bigint")).alias("selected_count"))
    return au.batch_conservation(batches, candidates, kept, kept.where("signal_id % 101 <> 20").join(o, "signal_id"), key)


def x38_merge(spark, d):
    """Newest rows of three strategies and of the quotes as one row a code, each field from the best source that has it."""
    s = tb.signals(spark, d)
    last = s.groupBy("strategy", "code").agg(F.max_by(F.struct("score", "rank"), F.struct("signal_date", "signal_id")).alias("x"))
    names = F.element_at(F.create_map(*[F.lit(x) for x in ("1", "today_term", "2", "tomorrow_picks", "3", "swing_picks")]), F.col("strategy"))
    a = last.where("strategy in ('1', '2', '3')").select("code", names.alias("source"), F.col("strategy").cast("int").alias("arrival"), F.when(F.col("code") % 4 != 1, F.col("x.score")).alias("score"), (F.col("code") * F.col("strategy").cast("int") % 7).cast("double").alias("value_score"), F.lit(None).cast("double").alias("price"), F.when(F.col("code") % 3 == F.col("strategy").cast("int") % 3, F.lit("")).otherwise(F.concat(F.lit("n"), "strategy")).alias("name"))
    q = tb.quotes(spark, d).groupBy(F.col("id").alias("code")).agg(F.max_by(F.struct("price", "name"), "trade_date").alias("x"))
    b = q.select("code", F.lit("candidate_pool").alias("source"), F.lit(9).alias("arrival"), F.lit(40.0).alias("score"), F.lit(1.0).alias("value_score"), F.col("x.price").alias("price"), F.col("x.name").alias("name"))
    m = mg.merge_sources(a.unionByName(b), ["score", "value_score", "price", "name"], arrival=["arrival"])
    return m.select("code", "source", "score", "value_score", "price", "name", *[F.try_element_at("provenance", F.lit(f)).alias(f"{f}_from") for f in ("score", "price", "name")])


def x31_replay(spark, d):
    """The next-day strategy replayed on all past dates: the newest hundred first, then the rest, then once more for nothing."""
    table, names = shared_path(spark, "replay"), tb.read(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), tb.code_text(F.col("s_suppkey")).alias("symbol"), F.col("s_name").alias("name"))
    rows = written(rp.replay_rows(tb.bars(spark, d), names, FLOOR), "replay-rows")
    for days in (100, None):
        rp.backfill(table, rows, days)
    again = rp.backfill(table, rows)
    held = spark.read.parquet(table).select("signal_date", "code", "place", "score", "version")
    return held.join(F.broadcast(again.agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_again"))))


def _status(spark, d):
    """Signals of two versions with outcomes, skips, records and batches, and the settled outcomes."""
    i = F.col("signal_id")
    s = tb.signals(spark, d).select("signal_id", "strategy", F.when(i % 5 != 0, "v2").otherwise("v1").alias("version"), "signal_date", F.lit("close").alias("phase"), "rank")
    o = written(_outcomes(spark, d), "outcomes").where("state = 'settled'").select("signal_id", F.when(i % 11 != 3, "b1").otherwise("b0").alias("baseline"), F.col("exit_days").alias("future_days"), F.col("net_return").alias("primary_return"), "next_open_return", "max_drawdown", F.when(i % 7 != 0, F.col("exit_return")).alias("exit_return"), "exit_reason", "exit_days")
    b = s.groupBy(*sp.BATCH).agg(F.when(F.min(i) % 3 != 0, F.count("*")).otherwise(0).alias("candidate_count")).withColumn("sample_type", F.lit("real_forward")).where(F.col("strategy") != "5")
    return sp.status_rows(s, o, s.where("signal_id % 13 = 2").select("signal_id"), s.where("signal_id % 4 <> 1").select("signal_id", (i % 6 != 0).alias("promotion_eligible")), b), o


def j7_status_rows(spark, d):
    """Counts of labelled, skipped and pending signals by strategy, version and sample type."""
    return sp.status_counts(_status(spark, d)[0], ["strategy", "version", "sample_type"])


def j8_weight_samples(spark, d):
    """The training set of live weights: current version and baseline, fit for promotion, the newest 120 dates of a strategy."""
    rows, o = _status(spark, d)
    versions = spark.createDataFrame([(str(k), "v2", "b1") for k in range(1, 6)], "strategy string, version string, baseline string")
    return rounded(sp.weight_samples(rows, o, versions), "primary_return", "next_open_return", "max_drawdown", "exit_return")


QUERIES = [j7_status_rows, j8_weight_samples, x18_states, a32_point_in_time, a41_execution, j17_conservation, x38_merge, x31_replay]

_BRANCHED = """
, br AS (SELECT signal_id, code, signal_date, CASE WHEN strategy <= '2' THEN 'close_auction' WHEN strategy <= '4' THEN 'post_1430' ELSE 'today' END AS branch, CASE WHEN signal_id % 97 <> 5 THEN 100 + score / 10 END AS ref, CASE WHEN strategy = '3' THEN 1 ELSE 5 END AS hold,
  CASE WHEN code % 5 = 1 THEN 20.0::DOUBLE WHEN code % 7 = 2 THEN 3 ELSE 10 END AS lim, code % 11 = 5 AS gone, strategy, rank FROM signals),
en AS (SELECT br.*, b.idx, b.close AS day_close, coalesce(CASE WHEN branch = 'close_auction' THEN b.close ELSE ref END, 0) AS entry, coalesce(b.prev_close, 0) AS prev, b.open AS op, b.high AS hi, b.low AS lo, date_diff('day', signal_date, DATE '1998-12-31') >= 30 AS stale FROM br LEFT JOIN numbered b ON b.code = br.code AND b.trade_date = br.signal_date),
bk AS (SELECT *, coalesce(CASE branch WHEN 'post_1430' THEN prev > 0 AND entry >= prev * (1 + lim / 100) * 0.995::DOUBLE WHEN 'close_auction' THEN prev > 0 AND least(op, lo, day_close) >= prev * (1 + lim / 100) * 0.995::DOUBLE AND hi <= prev * (1 + lim / 100) * 1.01::DOUBLE ELSE false END, false) AS blocked FROM en),
ah AS (SELECT k.signal_id, k.branch, k.entry, k.hold, k.lim, b.idx - k.idx - 1 AS step, b.trade_date, b.open, b.high, b.low, b.close, b.prev_close FROM bk k JOIN numbered b ON b.code = k.code AND b.idx BETWEEN k.idx + 1 AND k.idx + 30 WHERE branch <> 'today' AND k.idx IS NOT NULL AND entry > 0 AND NOT blocked),
mk AS (SELECT signal_id, count(*) AS fd, arg_max(close, step) FILTER (step < 1) AS c1, arg_max(close, step) FILTER (step < 3) AS c3, arg_max(close, step) FILTER (step < 5) AS c5, arg_max(close, step) FILTER (step < 10) AS c10, arg_max(close, step) FILTER (step < 20) AS c20, max(open) FILTER (step = 0) AS no, max(high) FILTER (step < 3) AS mh, min(low) FILTER (step < 3) AS ml,
  bool_or(high <= entry * (1 - lim / 100) * 1.01::DOUBLE AND low <= entry * (1 - lim / 100) * 1.005::DOUBLE AND close <= entry * (1 - lim / 100) * 1.01::DOUBLE) FILTER (step = 0) AS sealed, arg_min(trade_date, step) AS nd,
  arg_min({'step': step, 'px': open, 'd': trade_date}, step) FILTER (step > 0 AND NOT (high <= prev_close * (1 - lim / 100) * 1.01::DOUBLE AND low <= prev_close * (1 - lim / 100) * 1.005::DOUBLE AND close <= prev_close * (1 - lim / 100) * 1.01::DOUBLE)) AS fr, arg_max({'step': step, 'px': close, 'd': trade_date}, step) AS la FROM ah GROUP BY signal_id),
m1 AS (SELECT *, step < hold AS live, entry * 0.95::DOUBLE AS stop, entry * 1.08::DOUBLE AS take, greatest(entry, coalesce(max(high) OVER (PARTITION BY signal_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), entry)) * 0.96::DOUBLE AS trail,
  high <= prev_close * (1 - lim / 100) * 1.01::DOUBLE AND low <= prev_close * (1 - lim / 100) * 1.005::DOUBLE AND close <= prev_close * (1 - lim / 100) * 1.01::DOUBLE AS shut FROM ah WHERE branch = 'post_1430'),
m2 AS (SELECT *, CASE WHEN live AND low <= stop THEN 'stop_loss' WHEN live AND high >= take THEN 'take_profit' WHEN live AND step > 0 AND low <= trail THEN 'trailing_stop' END AS why FROM m1),
ht AS (SELECT signal_id, arg_min({'step': step, 'why': why, 'd': trade_date, 'px': CASE WHEN why = 'take_profit' THEN take WHEN why = 'stop_loss' THEN least(stop, open) ELSE least(trail, open) END, 'stuck': shut AND why <> 'take_profit'}, step) AS hit FROM m2 WHERE why IS NOT NULL GROUP BY signal_id),
ex AS (SELECT m2.signal_id, any_value(hit) AS hit, arg_min({'step': step, 'px': open, 'd': trade_date}, step) FILTER (step > hit.step AND NOT shut) AS again, arg_max({'step': step, 'px': close, 'd': trade_date}, step) AS las, arg_max({'step': step, 'px': close, 'd': trade_date}, step) FILTER (live) AS term FROM m2 LEFT JOIN ht USING (signal_id) GROUP BY m2.signal_id),
ey AS (SELECT signal_id, CASE WHEN coalesce(hit.stuck, false) AND again IS NOT NULL THEN hit.why || '_limit_down_delayed' WHEN coalesce(hit.stuck, false) THEN hit.why || '_limit_down_unfilled' ELSE coalesce(hit.why, 'hold_to_term') END AS ewhy,
  CASE WHEN coalesce(hit.stuck, false) AND again IS NOT NULL THEN again WHEN coalesce(hit.stuck, false) THEN las WHEN hit IS NOT NULL THEN {'step': hit.step, 'px': hit.px, 'd': hit.d} ELSE term END AS e FROM ex),
al AS (SELECT bk.*, mk.* EXCLUDE (signal_id), ewhy, e FROM bk LEFT JOIN mk USING (signal_id) LEFT JOIN ey USING (signal_id)),
st AS (SELECT *, CASE WHEN idx IS NULL AND branch = 'today' AND NOT stale THEN 'pending:signal_day_bar_missing' WHEN idx IS NULL THEN 'unknown:signal_day_bar_missing' WHEN branch = 'today' AND (entry <= 0 OR day_close <= 0) THEN 'unknown:reference_or_close_invalid' WHEN branch = 'today' THEN 'settled:same_day_close_observation'
  WHEN entry <= 0 THEN 'unfilled:invalid_entry_price' WHEN blocked THEN 'unfilled:limit_up_unfilled' WHEN fd IS NULL AND stale THEN 'unknown:no_bar_since' WHEN fd IS NULL THEN 'pending:waiting_for_next_day' WHEN branch = 'close_auction' AND NOT sealed THEN 'settled:next_close' WHEN branch = 'close_auction' AND fr IS NOT NULL THEN 'settled:limit_down_delayed_to_open'
  WHEN branch = 'close_auction' THEN 'pending:limit_down_exit_pending' WHEN ewhy = 'hold_to_term' AND fd < hold AND gone THEN 'settled:delisted_last_tradable' WHEN ewhy = 'hold_to_term' AND fd < hold THEN 'pending:insufficient_future' WHEN ewhy LIKE '%\\_unfilled' ESCAPE '\\' THEN 'pending:exit_unfilled' ELSE 'settled:' || ewhy END AS sr FROM al),
su AS (SELECT *, split_part(sr, ':', 1) AS state, split_part(sr, ':', 2) AS reason FROM st),
sx AS (SELECT *, CASE WHEN branch = 'today' THEN day_close WHEN reason = 'next_close' THEN c1 WHEN reason = 'limit_down_delayed_to_open' THEN fr.px WHEN reason = 'delisted_last_tradable' THEN la.px ELSE e.px END AS px, CASE WHEN branch = 'today' THEN 0 WHEN reason = 'next_close' THEN 1 WHEN reason = 'limit_down_delayed_to_open' THEN fr.step + 1 WHEN reason = 'delisted_last_tradable' THEN la.step + 1 ELSE e.step + 1 END AS days,
  CASE WHEN branch = 'today' THEN signal_date WHEN reason = 'next_close' THEN nd WHEN reason = 'limit_down_delayed_to_open' THEN fr.d WHEN reason = 'delisted_last_tradable' THEN la.d ELSE e.d END AS xd, state = 'settled' AND branch <> 'today' AS traded, branch <> 'today' AND state IN ('settled', 'pending') AND entry > 0 AS filled FROM su),
oc AS (SELECT signal_id, code, signal_date, branch, strategy, state, reason, CASE WHEN filled OR state = 'settled' THEN entry END AS entry_price, coalesce(fd, 0) AS future_days, CASE WHEN traded AND no > 0 THEN (no / entry - 1) * 100 END AS next_open_return, CASE WHEN traded THEN (c1 / entry - 1) * 100 END AS return_1d, CASE WHEN traded THEN (c3 / entry - 1) * 100 END AS return_3d,
  CASE WHEN traded THEN (c5 / entry - 1) * 100 END AS return_5d, CASE WHEN traded THEN (c10 / entry - 1) * 100 END AS return_10d, CASE WHEN traded THEN (c20 / entry - 1) * 100 END AS return_20d, CASE WHEN traded THEN (mh / entry - 1) * 100 END AS max_gain_3d, CASE WHEN traded THEN (ml / entry - 1) * 100 END AS max_drawdown_3d,
  CASE WHEN traded THEN mh / entry - 1 >= 0.03::DOUBLE END AS hit_3pct, CASE WHEN traded THEN mh / entry - 1 >= 0.05::DOUBLE END AS hit_5pct, CASE WHEN state = 'settled' THEN px END AS exit_price, CASE WHEN state = 'settled' THEN (px / entry - 1) * 100 END AS exit_return, CASE WHEN state = 'settled' THEN days END AS exit_days, CASE WHEN state = 'settled' THEN xd END AS exit_date,
  CASE WHEN branch = 'today' THEN CASE WHEN state = 'settled' THEN 'observation_closed' END WHEN state = 'settled' THEN 'closed' WHEN state = 'unfilled' THEN 'not_entered' WHEN filled AND reason IN ('limit_down_exit_pending', 'exit_unfilled') THEN 'exit_pending' WHEN filled THEN 'open_position' END AS position, reason = 'delisted_last_tradable' AS survivorship_corrected FROM sx)"""
_X18 = ", ".join(f"round({c}, 6) AS {c}" for c in RETURNS)
_KEYS = ("price", "score", "turnover")
_A32 = " UNION ALL ".join([
    "SELECT signal_id AS candidate_id, 'timestamp_not_visible' AS type, 'quote_observed_at' AS field FROM signals WHERE signal_id % 37 = 4", "SELECT signal_id, 'timestamp_not_visible', 'market_data_cutoff' FROM signals WHERE signal_id % 53 = 7", "SELECT signal_id, 'timestamp_not_visible', 'event_loaded_at' FROM signals WHERE signal_id % 41 = 9",
    "SELECT signal_id, 'future_announcement', strftime(signal_date + to_minutes(870 + m), '%Y-%m-%d %H:%M:%S') FROM signals, (VALUES (90), (120)) t(m) WHERE signal_id % 29 = 3", "SELECT signal_id, 'point_in_time_invalid', '' FROM signals WHERE signal_id % 43 = 8", "SELECT signal_id, 'eligibility_reason_missing', '' FROM signals WHERE signal_id % 47 = 10",
    *[f"SELECT signal_id, 'missing_mask_absent', 'model_input.{k}' FROM signals WHERE signal_id % 71 = {17 + n}" for n, k in enumerate(_KEYS)],
    *[f"SELECT signal_id, 'feature_timestamp_not_visible', 'model_input.{k}' FROM signals WHERE NOT (signal_id % 71 <> {17 + n} AND signal_id % 13 = {n}) AND (signal_id % 61 = {11 + n} OR signal_id % 67 = {13 + n})" for n, k in enumerate(_KEYS)],
])
_A41 = """
, rc AS (SELECT o.*, b.close AS raw_close, x.low AS xl, x.high AS xh, signal_id % 101 <> 20 AS named, CASE WHEN state = 'settled' THEN exit_return + CASE WHEN signal_id % 31 = 6 THEN 0.01::DOUBLE ELSE 0 END END AS gross FROM oc o LEFT JOIN bars b ON b.code = o.code AND b.trade_date = o.signal_date LEFT JOIN bars x ON x.code = o.code AND x.trade_date = o.exit_date WHERE branch <> 'today'),
vs AS (SELECT *, named AND state = 'settled' AS se, signal_id % 89 <> 12 AS has FROM rc)
SELECT signal_id AS candidate_id, 'selected_candidate_without_signal' AS type, '' AS field FROM vs WHERE NOT has
UNION ALL SELECT signal_id, 'execution_policy_version_mismatch', '' FROM vs WHERE has AND signal_id % 83 = 22 UNION ALL SELECT signal_id, 'execution_cost_not_reproducible', '' FROM vs WHERE has AND signal_id % 73 = 19
UNION ALL SELECT signal_id, 'return_inputs_missing', '' FROM vs WHERE se AND (signal_id % 59 = 14) UNION ALL SELECT signal_id, 'return_not_reproducible', '' FROM vs WHERE se AND signal_id % 59 <> 14 AND signal_id % 31 = 6
UNION ALL SELECT signal_id, 'entry_fill_not_in_raw_prices', '' FROM vs WHERE se AND branch = 'close_auction' AND (raw_close IS NULL OR abs(raw_close - entry_price) > 0.001::DOUBLE) UNION ALL SELECT signal_id, 'exit_fill_not_in_raw_prices', '' FROM vs WHERE se AND (xl IS NULL OR NOT exit_price BETWEEN xl - 0.001::DOUBLE AND xh + 0.001::DOUBLE)
UNION ALL SELECT signal_id, 'settled_quantity_not_conserved', '' FROM vs WHERE se AND signal_id % 79 = 21 UNION ALL SELECT signal_id, 'unfilled_quantity_not_conserved', '' FROM vs WHERE named AND state = 'unfilled' AND signal_id % 3 = 0
UNION ALL SELECT signal_id, 'unknown_has_fabricated_return_or_promotion', '' FROM vs WHERE named AND state = 'unknown' AND (signal_id % 5 = 1 OR signal_id % 7 = 1) UNION ALL SELECT signal_id, 'label_status_missing', '' FROM vs WHERE has AND NOT named
UNION ALL SELECT signal_id, 'delisting_liquidation_not_settled', '' FROM vs WHERE survivorship_corrected AND NOT se
UNION ALL SELECT signal_id, CASE WHEN signal_id % 91 = m THEN 'benchmark_missing' WHEN signal_id % 93 = m THEN 'benchmark_unavailable' ELSE 'benchmark_not_reproducible' END, k FROM vs, (VALUES ('market', 23), ('industry', 24), ('style', 25)) t(k, m) WHERE se AND (signal_id % 91 = m OR signal_id % 93 = m OR signal_id % 95 = m)"""

_STATUS = """
, sg AS (SELECT signal_id, strategy, CASE WHEN signal_id % 5 <> 0 THEN 'v2' ELSE 'v1' END AS version, signal_date, rank FROM signals),
ot AS (SELECT signal_id, CASE WHEN signal_id % 11 <> 3 THEN 'b1' ELSE 'b0' END AS baseline, net_return, next_open_return, max_drawdown, CASE WHEN signal_id % 7 <> 0 THEN exit_return END AS exit_return, exit_reason, exit_days FROM settled),
bt AS (SELECT strategy, version, signal_date, min(signal_id) % 3 <> 0 AS kept FROM sg WHERE strategy <> '5' GROUP BY ALL),
sr AS (SELECT sg.*, ot.signal_id IS NOT NULL AS lab, sg.signal_id % 13 = 2 AS skip, baseline, CASE WHEN bt.kept THEN sg.signal_id % 4 <> 1 AND sg.signal_id % 6 <> 0 ELSE true END AS ok, CASE WHEN bt.strategy IS NULL THEN 'unknown' ELSE 'real_forward' END AS sample_type
  FROM sg LEFT JOIN ot USING (signal_id) LEFT JOIN bt ON bt.strategy = sg.strategy AND bt.version = sg.version AND bt.signal_date = sg.signal_date)"""

ORACLES = {
    "j7_status_rows": with_views(["settled"], _STATUS + " SELECT strategy, version, sample_type, count(*) AS signals, count(*) FILTER (lab) AS labelled, count(*) FILTER (NOT lab AND skip) AS skipped, count(*) FILTER (NOT lab AND NOT skip) AS pending, count(*) FILTER (lab AND ok) AS eligible, count(DISTINCT signal_date) FILTER (lab) AS labelled_days FROM sr GROUP BY ALL"),
    "j8_weight_samples": with_views(["settled"], _STATUS + """
, c AS (SELECT * FROM sr WHERE lab AND ok AND version = 'v2' AND baseline = 'b1' QUALIFY dense_rank() OVER (PARTITION BY strategy ORDER BY signal_date DESC) <= 120)
SELECT c.signal_id, strategy, version, signal_date, rank, round(coalesce(net_return, 0), 6) AS primary_return, round(coalesce(next_open_return, 0), 6) AS next_open_return, round(coalesce(max_drawdown, 0), 6) AS max_drawdown, round(coalesce(exit_return, net_return, 0), 6) AS exit_return, coalesce(exit_reason, '') AS exit_reason, coalesce(exit_days, 0) AS exit_days FROM c JOIN ot USING (signal_id)"""),
    "x18_states": with_views(["numbered", "signals"], _BRANCHED + f" SELECT signal_id, code, signal_date, branch, state, reason, future_days, {_X18}, hit_3pct, hit_5pct, CAST(exit_days AS BIGINT) AS exit_days, exit_date, position, survivorship_corrected FROM oc"),
    "a32_point_in_time": with_views(["signals"], _A32),
    "a41_execution": with_views(["numbered", "signals"], _BRANCHED + _A41),
    "j17_conservation": with_views(["numbered", "signals"], _BRANCHED + """
, c AS (SELECT s.strategy, s.signal_date, count(*) AS actual, min(s.signal_id) % 19 = 2 AS extra, count(*) FILTER (s.signal_id % 3 <> 0 OR s.signal_id % 4 = 0) AS eligible, count(*) FILTER (s.signal_id % 3 <> 0) AS signals,
  count(*) FILTER (k AND state = 'settled') AS settled, count(*) FILTER (k AND state = 'unfilled') AS unfilled, count(*) FILTER (k AND state = 'pending') AS pending, count(*) FILTER (k AND state = 'unknown') AS unknown FROM (SELECT *, signal_id % 3 <> 0 AND signal_id % 101 <> 20 AS k FROM oc) s GROUP BY ALL)
SELECT strategy, signal_date, signals AS saved_count, actual + extra::INT AS candidate_count, signals AS selected_count, actual, eligible, signals AS selected, 0::BIGINT AS selected_ineligible, signals, settled + unfilled + pending + unknown AS records, settled, unfilled, pending, unknown, NOT extra AND signals = settled + unfilled + pending + unknown AS conserved FROM c"""),
    "x38_merge": with_views(["signals", "quotes"], """
, a AS (SELECT strategy, code, arg_max(score, row(signal_date, signal_id)) AS score FROM signals WHERE strategy IN ('1', '2', '3') GROUP BY ALL),
q AS (SELECT id AS code, arg_max(price, trade_date) AS price, arg_max(name, trade_date) AS name FROM quotes GROUP BY id),
r AS (SELECT code, CASE strategy WHEN '1' THEN 'today_term' WHEN '2' THEN 'tomorrow_picks' ELSE 'swing_picks' END AS source, strategy::INT AS arrival, 3 AS bonus, CASE WHEN code % 4 <> 1 THEN score END AS score, (code * strategy::INT % 7)::DOUBLE AS value_score, NULL::DOUBLE AS price, CASE WHEN code % 3 = strategy::INT % 3 THEN '' ELSE 'n' || strategy END AS name FROM a
  UNION ALL SELECT code, 'candidate_pool', 9, 1, 40, 1, price, name FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY arrival) AS n, max(row(bonus, coalesce(score, 0), value_score)) OVER (PARTITION BY code ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r),
p AS (SELECT *, CASE WHEN best IS NULL OR row(bonus, coalesce(score, 0), value_score) > best THEN -n ELSE n END AS place FROM n)
SELECT code, arg_min(source, place) AS source, arg_min(score, place) FILTER (score <> 0) AS score, arg_min(value_score, place) FILTER (value_score <> 0) AS value_score, arg_min(price, place) FILTER (price <> 0) AS price, arg_min(name, place) FILTER (name <> '') AS name,
  arg_min(source, place) FILTER (score <> 0) AS score_from, arg_min(source, place) FILTER (price <> 0) AS price_from, arg_min(source, place) FILTER (name <> '') AS name_from FROM p GROUP BY code"""),
}

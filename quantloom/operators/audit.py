"""The point-in-time audit: every violation of every candidate as a row, and counts held against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
REQUIRED_TIMES = ("quote_observed_at", "market_data_cutoff")
OPTIONAL_TIMES = ("event_loaded_at", "fundamentals_loaded_at")
GROSS_TOLERANCE, NET_TOLERANCE, COST_TOLERANCE, FILL_TOLERANCE, QUANTITY_TOLERANCE = 0.001, 0.0015, 0.0001, 0.001, 1e-8
STATES = ("settled", "unfilled", "pending", "unknown")


def _found(kind: str, field: Column | str = "") -> Column:
    return F.struct(F.lit(kind).alias("type"), (F.lit(field) if isinstance(field, str) else field).alias("field"))


def evidence_violations(candidates: DataFrame) -> DataFrame:
    """candidates(candidate_id, cutoff, source_times map, announcements array, feature_times map, features map, missing map,
    point_in_time_valid, reasons array) -> candidate_id, type, field.

    Times that a decision rests on must be there and not after the cut-off; others not after it if they are there. Each
    feature has a missing mask, and if it is not missing a time at which it was seen. Maps are looked through in place: a
    candidate's row is not repeated for what is in order.
    """
    cut, times = F.col("cutoff"), F.coalesce(F.col("source_times"), F.create_map().cast("map<string,timestamp>"))

    def late(t: Column) -> Column:
        return t.isNull() | cut.isNull() | (t > cut)

    fixed = [F.when(late(F.try_element_at(times, F.lit(k))), _found("timestamp_not_visible", k)) for k in REQUIRED_TIMES]
    fixed += [F.when(F.try_element_at(times, F.lit(k)).isNotNull() & late(F.try_element_at(times, F.lit(k))), _found("timestamp_not_visible", k)) for k in OPTIONAL_TIMES]
    fixed += [F.when(~F.coalesce("point_in_time_valid", F.lit(False)), _found("point_in_time_invalid")), F.when(F.coalesce(F.size("reasons"), F.lit(0)) <= 0, _found("eligibility_reason_missing"))]
    future = F.transform(F.filter(F.coalesce(F.col("announcements"), F.array().cast("array<timestamp>")), lambda t: late(t)), lambda t: _found("future_announcement", F.date_format(t, "yyyy-MM-dd HH:mm:ss")))
    names, masks, seen = F.map_keys(F.coalesce(F.col("features"), F.create_map().cast("map<string,double>"))), F.coalesce(F.col("missing"), F.create_map().cast("map<string,boolean>")), F.coalesce(F.col("feature_times"), F.create_map().cast("map<string,timestamp>"))
    unmasked = F.transform(F.filter(names, lambda k: F.try_element_at(masks, k).isNull()), lambda k: _found("missing_mask_absent", k))
    unseen = F.transform(F.filter(names, lambda k: ~F.coalesce(F.try_element_at(masks, k), F.lit(False)) & late(F.try_element_at(seen, k))), lambda k: _found("feature_timestamp_not_visible", k))
    every = F.concat(F.array_compact(F.array(*fixed)), future, unmasked, unseen)
    return candidates.select("candidate_id", F.explode(every).alias("v")).select("candidate_id", "v.type", "v.field")


def execution_violations(records: DataFrame) -> DataFrame:
    """records(candidate_id, signal_id, state, entry/exit price, gross/net, costs, scenario costs, quantities, the raw bars of entry and
    exit, benchmark parts, policy versions, delisting) -> candidate_id, type, field: what does not follow from what is stored.

    Expected: gross from the two prices, net from gross less the base scenario's total, the stored costs those recomputed
    (exp_*), fills within their raw bars, quantities conserved, benchmarks the mean of their constituents, and no return or
    promotion where the outcome is unknown.
    """
    c = {k: F.col(k) for k in records.columns}

    def off(a: Column, b: Column, by: float) -> Column:
        return a.isNull() | b.isNull() | (F.abs(a - b) > by)

    settled, unfilled, unknown = (c["state"] == s for s in ("settled", "unfilled", "unknown"))
    inputs = c["entry_price"].isNull() | c["exit_price"].isNull() | c["gross"].isNull() | c["base_total"].isNull() | c["net"].isNull() | (c["entry_price"] <= 0)
    gross = (c["exit_price"] / F.when(c["entry_price"] > 0, c["entry_price"]) - 1) * 100
    wrong = (F.abs(gross - c["gross"]) > GROSS_TOLERANCE) | (F.abs(gross - c["base_total"] - c["net"]) > NET_TOLERANCE)
    costs = off(c["fee_pct"], c["exp_fee_pct"], COST_TOLERANCE) | off(c["slippage_pct"], c["exp_slippage_pct"], COST_TOLERANCE) | off(c["impact_pct"], c["exp_impact_pct"], COST_TOLERANCE) | off(c["base_total"], c["exp_fee_pct"] + c["exp_slippage_pct"] + c["exp_impact_pct"], COST_TOLERANCE)
    exit_out = c["exit_low"].isNull() | c["exit_high"].isNull() | ~c["exit_price"].between(c["exit_low"] - FILL_TOLERANCE, c["exit_high"] + FILL_TOLERANCE)
    order, filled, sold, left = (F.coalesce(c[k], F.lit(0.0)) for k in ("order_quantity", "filled_quantity", "exit_quantity", "unfilled_quantity"))
    left_in, left_out = (F.coalesce(c[k], F.lit(0.0)) for k in ("unfilled_entry_quantity", "unfilled_exit_quantity"))
    q = QUANTITY_TOLERANCE
    kept = (F.abs(left - left_in - left_out) <= q) & (F.abs(order - left) <= q) & (((filled == 0) & (left_in == order) & (left_out == 0)) | ((filled == order) & (left_in == 0) & (left_out == order)))
    rules = [
        (c["signal_id"].isNull(), "selected_candidate_without_signal"),
        (c["signal_id"].isNotNull() & (c["batch_policy"].isNull() | ~c["batch_policy"].eqNullSafe(c["record_policy"])), "execution_policy_version_mismatch"),
        (c["signal_id"].isNotNull() & costs, "execution_cost_not_reproducible"),
        (settled & inputs, "return_inputs_missing"), (settled & ~inputs & wrong, "return_not_reproducible"),
        (settled & off(c["raw_entry"], c["entry_price"], FILL_TOLERANCE), "entry_fill_not_in_raw_prices"), (settled & exit_out, "exit_fill_not_in_raw_prices"),
        (settled & ((F.abs(order - filled) > q) | (F.abs(order - sold) > q) | (F.abs(left) > q)), "settled_quantity_not_conserved"), (unfilled & ~kept, "unfilled_quantity_not_conserved"),
        (unknown & (c["gross"].isNotNull() | F.coalesce(c["promotion_eligible"], F.lit(False))), "unknown_has_fabricated_return_or_promotion"),
        (c["signal_id"].isNotNull() & ~F.coalesce(c["state"].isin(*STATES), F.lit(False)), "label_status_missing"),
        (c["delisting"].eqNullSafe(F.lit("liquidated_last_tradable")) & ~settled, "delisting_liquidation_not_settled"),
    ]
    marks = F.coalesce(F.col("benchmarks"), F.create_map().cast("map<string,struct<return_pct:double,constituents:array<double>>>"))

    def benchmark(name: str) -> Column:
        m = F.try_element_at(marks, F.lit(name))
        parts = F.filter(F.coalesce(m["constituents"], F.array().cast("array<double>")), lambda x: x.isNotNull())
        mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(parts) > 0, F.size(parts))
        kind = F.when(m.isNull(), "benchmark_missing").when(m["return_pct"].isNull(), "benchmark_unavailable").when(off(mean, m["return_pct"], FILL_TOLERANCE), "benchmark_not_reproducible")
        return F.when(settled & kind.isNotNull(), F.struct(kind.alias("type"), F.lit(name).alias("field")))

    every = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), _found(kind)) for bad, kind in rules], *[benchmark(n) for n in ("market", "industry", "style")]))
    return records.select("candidate_id", F.explode(every).alias("v")).select("candidate_id", "v.type", "v.field")


def batch_conservation(batches: DataFrame, candidates: DataFrame, signals: DataFrame, records: DataFrame, key: list[str]) -> DataFrame:
    """A row for each batch with its counts on four levels and whether they agree: batches(key, saved_count, candidate_count,
    selected_count), candidates(key, eligible, selected), signals(key), records(key, state). Each level is aggregated once."""
    def n(c: Column) -> Column:
        return F.sum(c.cast("bigint"))

    e, s = F.coalesce("eligible", F.lit(False)), F.coalesce("selected", F.lit(False))
    cand = candidates.groupBy(*key).agg(F.count("*").alias("actual"), n(e).alias("eligible"), n(s).alias("selected"), n(s & ~e).alias("selected_ineligible"))
    sig = signals.groupBy(*key).agg(F.count("*").alias("signals"))
    rec = records.groupBy(*key).agg(F.count("*").alias("records"), *[n(F.col("state") == k).alias(k) for k in STATES])
    levels = ("actual", "eligible", "selected", "selected_ineligible", "signals", "records", *STATES)
    j = batches.join(cand, key, "left").join(sig, key, "left").join(rec, key, "left")
    j = j.select(*key, "saved_count", "candidate_count", "selected_count", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in levels])
    agree = (F.col("candidate_count") == F.col("actual")) & (F.col("saved_count") == F.col("signals")) & (F.col("selected_count") == F.col("signals")) & (F.col("selected_ineligible") == 0) & (F.col("selected") == F.col("signals")) & (F.col("signals") == F.col("records"))
    total = F.col("settled") + F.col("unfilled") + F.col("pending") + F.col("unknown")
    return j.withColumn("conserved", F.coalesce(agree & (F.col("records") == total), F.lit(False)))

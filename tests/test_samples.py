from datetime import date, timedelta

from quantloom.operators import samples as sp

DAY = date(2024, 1, 1)


def tables(spark):
    s = spark.createDataFrame([(i, "a", "v2" if i % 2 else "v1", DAY + timedelta(days=i), "close", 1) for i in range(1, 7)], "signal_id long, strategy string, version string, signal_date date, phase string, rank long")
    o = spark.createDataFrame([(1, "b", 3, None, 1.0, None, None, None, None), (3, "b", 5, 2.0, None, -1.0, 2.5, "stop", 2), (4, "b", 5, 3.0, 1.0, 1.0, 1.0, "x", 1), (5, "old", 5, 4.0, 1.0, 1.0, 1.0, "x", 1)], "signal_id long, baseline string, future_days int, primary_return double, next_open_return double, max_drawdown double, exit_return double, exit_reason string, exit_days int")
    skips = spark.createDataFrame([(1,), (2,), (2,)], "signal_id long")
    records = spark.createDataFrame([(1, True), (3, False)], "signal_id long, promotion_eligible boolean")
    batches = spark.createDataFrame([("a", "v2", DAY + timedelta(days=i), "close", n, "real") for i, n in ((1, 5), (3, 0), (5, 2))], "strategy string, version string, signal_date date, phase string, candidate_count long, sample_type string")
    return sp.status_rows(s, o, skips, records, batches), o


def test_status_rows_and_counts(spark):
    rows, _ = tables(spark)
    got = {r.signal_id: (r.has_outcome, r.has_skip, r.baseline, r.future_days, r.promotion_eligible, r.sample_type) for r in rows.collect()}
    assert got == {
        1: (True, True, "b", 3, True, "real"), 2: (False, True, "", 1, True, "unknown"), 3: (True, False, "b", 5, True, "real"),
        4: (True, False, "b", 5, True, "unknown"), 5: (True, False, "old", 5, False, "real"), 6: (False, False, "", 1, True, "unknown"),
    }
    count = sp.status_counts(rows, ["strategy"]).first()
    assert (count.signals, count.labelled, count.skipped, count.pending, count.eligible, count.labelled_days) == (6, 4, 1, 1, 3, 4)
    assert sp.status_counts(rows.limit(0), ["strategy"]).count() == 0


def test_weight_samples_are_current_fit_and_new(spark):
    rows, o = tables(spark)
    current = spark.createDataFrame([("a", "v2", "b")], "strategy string, version string, baseline string")
    got = {r.signal_id: (r.primary_return, r.next_open_return, r.max_drawdown, r.exit_return, r.exit_reason, r.exit_days) for r in sp.weight_samples(rows, o, current).collect()}
    assert got == {1: (0.0, 1.0, 0.0, 0.0, "", 0), 3: (2.0, 0.0, -1.0, 2.5, "stop", 2)}
    assert [r.signal_id for r in sp.weight_samples(rows, o, current, days=1).collect()] == [3]

"""The strategies against small tables."""

from __future__ import annotations

import pytest

from quantloom.operators import strategies as st

NUMBERS = ["ret_5d", "ret_10d", "ret_20d", "ma5_gap", "ma20_gap", "vol_amount_5d", "breakout_20d", "volatility_20d", "pct_chg", "sixty_day_pct", "ytd_pct", "volume_ratio", "turnover", "turnover_rate", "amplitude"]
SCHEMA = "date string, id int, industry string, market string, level string, factor_ready int, " + ", ".join(f"{c} double" for c in NUMBERS)


def row(i, date="a", industry="x", ready=1, **given):
    v = {c: float(i) / 10 for c in NUMBERS} | {"sixty_day_pct": float(i), "turnover": 1e6 * i} | given
    return (date, i, industry, "main", "balanced", ready, *[v[c] for c in NUMBERS])


def swing(spark, rows, **kw):
    out = st.swing_candidates(spark.createDataFrame(rows, SCHEMA), ["date"], ("date", "id"), 1e6, **kw)
    return {(r["date"], r["id"]): r for r in out.collect()}


def test_swing_scores_by_hand(spark):
    """Two rows: every percentile is 50 or 100, inverse ones 50 or 0."""
    got = swing(spark, [row(10), row(20)])
    low, high = got["a", 10], got["a", 20]
    assert low["momentum_score"] == pytest.approx(50) and high["momentum_score"] == pytest.approx(100)
    assert low["trend_score"] == pytest.approx(0.88 * 50 + 0.12 * 50) and high["trend_score"] == pytest.approx(0.88 * 100)
    assert low["execution_score"] == 88.0 and high["liquidity_score"] == pytest.approx(100)


def test_swing_without_history_is_neutral_and_watched(spark):
    got = swing(spark, [row(i, ready=0, industry=str(i)) for i in range(1, 13)], top_n=30)
    assert {r["trend_score"] for r in got.values()} == {50.0} and all(r["degraded"] for r in got.values())
    assert {r["tier"] for r in got.values()} <= {None, "backup_watch"}
    assert sum(r["place"] is not None for r in got.values()) <= st.SWING_DEGRADED_LIMIT


def test_swing_stand_ins_where_a_factor_is_zero_everywhere(spark):
    got = swing(spark, [row(i, ret_10d=0.0, breakout_20d=None) for i in (10, 20)])
    assert got["a", 20]["momentum_score"] == pytest.approx(100 * 0.92 + 50 * 0.08)


def test_swing_caps_industries_and_leaves_out_what_the_universe_does(spark):
    got = swing(spark, [row(i) for i in range(10, 30)] + [row(90), row(31, pct_chg=8.5), row(5, date="b")])
    assert ("a", 90) not in got and ("a", 31) not in got and ("b", 5) in got
    shown = [r for r in got.values() if r["place"] and r["date"] == "a"]
    assert 0 < len(shown) <= st.SWING_PER_INDUSTRY and min(r["score"] for r in shown) >= st.SWING_MIN_SCORE
    assert {r["place"] for r in shown} == set(range(1, len(shown) + 1))


def test_swing_of_missing_numbers_and_of_nothing(spark):
    nothing = {c: None for c in NUMBERS}
    got = swing(spark, [row(1, industry=None, **nothing), row(2, ready=None, **nothing)])
    assert len(got) == 2 and {r["momentum_score"] for r in got.values()} == {50.0}
    assert swing(spark, []) == {}

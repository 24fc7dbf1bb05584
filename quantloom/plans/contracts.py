"""Queries on row contracts: universes, provenance, readiness, phases, thresholds, lookups, feeds and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import market_type
from ..operators import contracts as ct
from ..operators import crosssection as cs
from ..operators import portfolio as pf
from ..operators import risk_events as rk
from ..operators import stats as st
from ..sources import tables as tb
from ..sources.shared import shared_path, written
from .market import rounded
from .trading import _daily, _outcomes
from .views import with_views


def _nth(names, c):
    """One of the names for each number; null where the list says so."""
    return F.element_at(F.array(*[F.lit(n).cast("string") for n in names]), (c % len(names) + 1).cast("int"))


_TYPES = ("live", " Replay ", "close_final", "INTRADAY", "legacy", "real_forward", "daily_bar_proxy", "guess", "", None)


def f6_swing_universe(spark, d):
    """Parts as candidates that may be held for two to five days."""
    p = tb.read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 23 - 9).cast("double").alias("pct_chg"), F.when(F.col("p_partkey") % 7 > 0, (F.col("p_partkey") % 131 - 30).cast("double")).alias("sixty_day_pct"), (F.col("p_size") * 3.0).alias("ytd_pct"))
    return ct.swing_universe(p).select("p_partkey", "pct_chg", "sixty_day_pct", "ytd_pct")


def f7_breadth_universe(spark, d):
    """Quotes of each date that count for the market's breadth, and those among them that rose."""
    q = ct.breadth_universe(tb.quotes(spark, d))
    return q.groupBy("trade_date").agg(F.count("*").alias("n"), F.sum((F.col("pct_chg") > 0).cast("bigint")).alias("up"))


def f11_sample_types(spark, d):
    """Signals by the provenance that their raw label stands for."""
    o = tb.read(spark, d, "orders").select(ct.sample_type(_nth(_TYPES, F.col("o_orderkey"))).alias("sample_type"))
    return o.groupBy("sample_type").agg(F.count("*").alias("n"))


def f12_primary_signals(spark, d):
    """Signals that count for validation, by strategy."""
    s = tb.signals(spark, d).withColumn("name", F.when(F.col("strategy") == "1", "tomorrow_picks").otherwise(F.col("strategy")))
    tier, allowed = _nth(("", "primary_watch", None, "backup_pool"), F.col("signal_id")), F.when(F.col("code") % 5 == 0, False).when(F.col("code") % 5 == 1, True)
    s = s.withColumn("primary", ct.is_primary(F.col("name"), F.col("rank"), tier, allowed, 2))
    return s.groupBy("strategy").agg(F.count("*").alias("n"), F.sum(F.col("primary").cast("bigint")).alias("counted"))


def f13_ready_outcomes(spark, d):
    """Outcomes that are ready for a holding of five days."""
    o = _outcomes(spark, d)
    seen = F.when(F.col("return_5d").isNotNull(), 5).when(F.col("return_3d").isNotNull(), 3).when(F.col("return_1d").isNotNull(), 1).otherwise(0)
    return o.select("signal_id", ct.outcome_ready(F.col("signal_id") % 97 == 0, seen, F.col("exit_reason"), F.col("exit_days"), 5).alias("ready"))


def f17_backup_threshold(spark, d):
    """The least backup score of each quote, by its date's regime."""
    q = tb.quotes(spark, d)
    level = cs.market_regime(q).select("trade_date", "level")
    q = q.join(level, "trade_date").select("trade_date", "id", "level", (F.col("amplitude") * 2).alias("volatility_20d"), (F.col("id") % 25).cast("double").alias("turnover_rate"), F.when(F.col("id") % 3 > 0, F.col("pct_chg") * 2).alias("order_imbalance"))
    return q.select("trade_date", "id", ct.backup_threshold(F.col("level"), 47.0).alias("threshold"))


def f18_execution_phase(spark, d):
    """Ticks by the phase of the day that they fall into."""
    t = tb.ticks(spark, d).select(ct.execution_phase(F.col("ts")).alias("s")).select("s.*")
    return t.groupBy("phase", "allowed").agg(F.count("*").alias("n"))


def j2_attach(spark, d):
    """Facts of the supplier's own table attached to quotes; what a quote has is not overwritten."""
    facts = tb.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("other").alias("industry"), F.col("s_nationkey").cast("double").alias("quality"), F.col("s_acctbal").alias("cap")).where("id % 4 <> 1")
    return ct.attach_missing(tb.quotes(spark, d).select("trade_date", "id", "industry", "cap"), facts, "id").select("trade_date", "id", "industry", "cap", "quality")


def j4_lookups(spark, d):
    """Hot rank, industry strength and sentiment of each quote, with their defaults."""
    q = tb.quotes(spark, d).select("trade_date", F.col("id").alias("code"), "industry", "pct_chg")
    hot = tb.read(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("code"), (F.col("s_suppkey") * 7 % 260).alias("hot_rank"))
    industry = tb.read(spark, d, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("industry"), (F.col("n_nationkey") / 8.0).alias("industry_pct"))
    mood = tb.ticks(spark, d).where("kind = 'purchase'").groupBy("code").agg(F.round(F.least(F.lit(100.0), F.max("price")), 6).alias("sentiment_score"))
    return ct.attach_lookups(q, hot, industry, mood).select("trade_date", "code", "hot_rank_score", "industry_pct", "sentiment_score")


def x14_direction(spark, d):
    """Direction score of every signal, and whether it may only be watched."""
    s = tb.signals(spark, d)
    k = F.col("signal_id")

    def some(m, n, c):
        return F.when(k % m > 0, (c % n).cast("double"))

    rows = s.select("signal_id", F.when(F.col("strategy") == "1", "tomorrow_picks").otherwise(F.col("strategy")).alias("strategy"), "score", some(3, 101, k * 3).alias("quality"), some(4, 101, k * 5).alias("rule_consistency"), some(5, 101, k * 7).alias("agent"), some(7, 101, k * 11).alias("risk"), _nth(("", "backup_pool", None), k).alias("tier"), F.when(k % 11 == 0, "intraday_provisional").alias("observation_mode"), F.when(F.col("code") % 6 == 0, False).when(F.col("code") % 6 == 1, True).alias("execution_allowed"))
    return rounded(ct.strategy_hits(rows), "direction_score").select("signal_id", "direction_score", "observation_only", "execution_allowed")


def x15_expected_return(spark, d):
    """Expected return of the signals of the newest 30 days from the nearest 35 % of all signals of their strategy settled before."""
    o = written(_outcomes(spark, d), "outcomes")
    day = o.agg(F.max("signal_date").alias("d")).first()["d"]
    old = F.col("signal_date") < F.date_sub(F.lit(day), 30)
    train = o.where((F.col("state") == "settled") & old).select(F.col("signal_id").alias("train_id"), "strategy", "signal_date", (F.col("exit_return") - F.col("total_pct")).alias("net_return"), "max_drawdown", "score", "entry_price", "total_pct", F.col("rank").cast("double").alias("rank"))
    q = o.where(~old).select(F.col("signal_id").alias("query_id"), "strategy", "score", "entry_price", "total_pct", F.when(F.col("signal_id") % 3 != 0, F.col("rank").cast("double")).alias("rank"))
    return rounded(ct.expected_return(q, train, "strategy", {"score": (100.0, 1.8), "entry_price": (10.0, 1.0), "total_pct": (5.0, 0.5), "rank": (5.0, 0.4)}), "expected", "p_win", "downside_p10", "expected_drawdown", "uncertainty")


def q5_experiment_fdr(spark, d):
    """Declared trials of orders as experiments, judged over their family; trials that were not reported count with p = 1."""
    o = tb.read(spark, d, "orders").select(F.col("o_orderkey").alias("experiment_id"), F.col("o_orderpriority").alias("experiment_family"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("trial_count"), (F.col("o_orderkey") * 7919 % 9973 / 9973.0).alias("p"))
    e = o.withColumn("p_values", F.array(F.col("p") * F.col("p") * 0.01, "p"))
    return st.experiment_fdr(e).select("experiment_id", "experiment_family", "trial", F.round("p_value", 12).alias("p_value"), "reported", "rejected")


def q7_paired_increment(spark, d):
    """Every strategy's daily returns against the first one's: interval, p-value and Sharpe ratio of the increments."""
    daily = _daily(spark, d)
    value = [c for c in daily.columns if c not in ("strategy", "signal_date")][0]
    base = daily.where("strategy = '1'").select("signal_date", F.col(value).alias("base"))
    paired = daily.where("strategy <> '1'").join(base, "signal_date").withColumn("increment", F.col(value) - F.col("base"))
    return rounded(ct.paired_increment(paired, "strategy", "signal_date"), "mean", "low", "high", "p_value", "sharpe", "probability")


def a13_readiness(spark, d):
    """Labelled signals of the current baseline by strategy."""
    s = tb.signals(spark, d).withColumn("baseline_id", F.when(F.col("signal_id") % 5 == 0, "v1").otherwise("v2"))
    return rounded(ct.readiness(s, _outcomes(spark, d).where("state = 'settled'"), "v2"), "coverage_pct")


def a13_backfill(spark, d):
    """Codes whose signals wait for an outcome."""
    return ct.backfill_candidates(tb.signals(spark, d), _outcomes(spark, d).where("state = 'settled'"))


def a22_gates(spark, d):
    """Coverage gates over the quotes' fields, one of which is missing now and then."""
    q = tb.quotes(spark, d).select("code", "name", "price", "pct_chg", "turnover", F.when(F.col("id") % 40 > 0, F.col("volume")).alias("volume_ratio"), "amplitude", F.when(F.col("id") % 25 > 0, F.col("cap")).alias("order_imbalance"))
    c = cs.field_coverage(q, q.columns)
    fields = {"base_quote": ("code", "name", "price", "pct_chg", "turnover"), "hard_filter_execution": ("price", "turnover", "volume_ratio", "amplitude"), "optional_research": ("order_imbalance", "main_net_flow_1d")}
    return rounded(ct.coverage_gates(c, fields), "least_pct")


def a22_freshness(spark, d):
    """Age of each user's last tick at the newest one of all, and whether it fell into the closing window."""
    t = tb.ticks(spark, d)
    last = t.groupBy("code").agg(F.max("ts").alias("observed_at")).withColumn("captured_at", F.col("observed_at"))
    now = t.agg(F.max("ts").alias("now"))
    return ct.freshness(last.crossJoin(F.broadcast(now)), F.col("now")).select("code", F.col("age_seconds").cast("bigint").alias("age_seconds"), "in_window")


def s14_spot(spark, d):
    """Parts as a raw spot feed with text numbers."""
    raw = tb.read(spark, d, "part").select(F.col("p_partkey").alias("代码"), F.col("p_name").alias("名称"), F.when(F.col("p_partkey") % 9 == 0, "-").otherwise(F.col("p_retailprice").cast("string")).alias("最新价"), (F.col("p_partkey") + 1_700_000_000).cast("string").alias("行情时间戳"))
    return ct.conform_spot(raw, {"代码": "code", "名称": "name", "最新价": "price", "行情时间戳": "quote_time"}, ("code", "name", "price"), ("price", "pct_chg")).select("code", "price", "pct_chg", F.unix_timestamp("quote_timestamp").alias("stamp"))


def s18_events(spark, d):
    """Customers as an event feed under alias columns."""
    raw = tb.read(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).alias("股票代码"), F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("sz"), F.col("c_custkey").cast("string"))).otherwise(F.lit("")).alias("code"), F.col("c_mktsegment").alias("date"), F.col("c_acctbal").alias("占比"))
    return ct.conform_events(raw, ("code", "股票代码"), ("日期", "date"), ("ratio", "占比")).select("code", "date", "unlock_ratio", "pledge_ratio")


def s19_blacklist_files(spark, d):
    """Two blacklists, one of JSON lines and one of CSV, written and read back, merged by code."""
    o = tb.read(spark, d, "orders").select((F.col("o_custkey") % 50).alias("code"), _nth(rk.LEVELS, F.col("o_orderkey")).alias("level"), (F.col("o_orderkey") % 10).cast("double").alias("penalty"), (F.col("o_orderkey") % 9 == 0).alias("hard"), F.to_date("o_orderdate").alias("expires"))
    lines, table = shared_path(spark, "blacklist-json"), shared_path(spark, "blacklist-csv")
    o.where("code % 2 = 0").write.json(lines)
    o.where("code % 2 = 1").write.option("header", True).csv(table)
    shape = "code bigint, level string, penalty double, hard boolean, expires date"
    both = spark.read.schema(shape).json(lines).unionByName(spark.read.schema(shape).option("header", True).csv(table))
    return rk.merge_blacklist(both.withColumn("as_of", F.lit("1997-01-01").cast("date")))


def s25_experiments(spark, d):
    """A registry of experiments, written as JSON lines and read back: the rules that its records break."""
    o = tb.read(spark, d, "orders")
    k = F.col("o_orderkey")
    e = o.select(k.alias("experiment_id"), F.when(k % 5 > 0, F.col("o_orderpriority")).otherwise(" ").alias("experiment_family"), F.lit("h").alias("hypothesis"), F.lit("net").alias("primary_metric"), _nth(_TYPES, k).alias("sample_type"), F.when(k % 7 == 0, "old").alias("baseline_id"), F.lit("v2").alias("production_baseline_id"), (k % 3).cast("int").alias("trial_count"), F.array_repeat(F.lit("p"), (k % 4).cast("int")).alias("candidate_parameters"))
    path = shared_path(spark, "experiments")
    e.write.json(path)
    got = ct.experiment_violations(spark.read.schema(e.schema).json(path))
    return got.select("experiment_id", F.concat_ws(",", "violations").alias("violations"))


def s7_bar_layout(spark, d):
    """Bars written by market and prefix and read again: codes and rows of each folder."""
    path = shared_path(spark, "bars")
    b = tb.bars(spark, d).withColumn("code", tb.code_text(F.col("code")))
    b = b.withColumn("market", market_type(F.col("code")))
    ct.write_bars(b, path)
    return ct.read_bars(b, path).groupBy("market", "prefix").agg(F.count("*").alias("n"), F.countDistinct("code").alias("codes"))


QUERIES = [f6_swing_universe, f7_breadth_universe, f11_sample_types, f12_primary_signals, f13_ready_outcomes, f17_backup_threshold, f18_execution_phase, j2_attach, j4_lookups, x14_direction, x15_expected_return, q5_experiment_fdr, q7_paired_increment, a13_readiness, a13_backfill, a22_gates, a22_freshness, s14_spot, s18_events, s19_blacklist_files, s25_experiments, s7_bar_layout]

from .rules import _LEVELS  # noqa: E402

_SUP = "substr(code, 1, 3) IN ('600','601','603','605','000','001','002','003','300','301','688')"
_T = "['live', ' Replay ', 'close_final', 'INTRADAY', 'legacy', 'real_forward', 'daily_bar_proxy', 'guess', '', NULL]"
_KIND = "CASE lower(trim(coalesce({t}[o_orderkey % 10 + 1], ''))) WHEN 'live' THEN 'real_forward' WHEN 'replay' THEN 'daily_proxy_replay' WHEN 'close_final' THEN 'close_forward' WHEN 'intraday' THEN 'intraday_pit_replay' WHEN 'legacy' THEN 'legacy_baseline' WHEN 'real_forward' THEN 'real_forward' WHEN 'daily_bar_proxy' THEN 'daily_proxy_replay' ELSE 'unknown' END".format(t=_T)
ORACLES = {
    "f6_swing_universe": "SELECT * FROM (SELECT p_partkey, CAST(p_partkey % 23 - 9 AS DOUBLE) AS pct_chg, CASE WHEN p_partkey % 7 > 0 THEN CAST(p_partkey % 131 - 30 AS DOUBLE) END AS sixty_day_pct, p_size * 3.0::DOUBLE AS ytd_pct FROM part) WHERE coalesce(pct_chg, 0) <= 8 AND coalesce(sixty_day_pct, 0) BETWEEN -18 AND 85 AND coalesce(ytd_pct, 0) <= 130",
    "f7_breadth_universe": with_views(["quotes"], f"SELECT trade_date, count(*) AS n, count(*) FILTER (pct_chg > 0) AS up FROM quotes WHERE {_SUP} AND NOT regexp_matches(name, '(?i)ST') AND price > 0 GROUP BY trade_date"),
    "f11_sample_types": f"SELECT {_KIND} AS sample_type, count(*) AS n FROM orders GROUP BY 1",
    "f12_primary_signals": with_views(["signals"], "SELECT strategy, count(*) AS n, count(*) FILTER (CASE WHEN code % 5 = 0 THEN false WHEN signal_id % 4 = 1 THEN true WHEN signal_id % 4 = 3 THEN false WHEN strategy = '1' THEN rank <= 2 ELSE true END) AS counted FROM signals GROUP BY strategy"),
    "f13_ready_outcomes": with_views(["outcomes"], "SELECT signal_id, signal_id % 97 = 0 OR return_5d IS NOT NULL OR (coalesce(exit_reason, '') NOT IN ('', 'hold_to_term') AND coalesce(exit_days, 0) > 0 AND exit_days <= CASE WHEN return_3d IS NOT NULL THEN 3 ELSE 1 END) AS ready FROM outcomes"),
    "f17_backup_threshold": with_views(["quotes"], _LEVELS + """ SELECT trade_date, id, round(CASE WHEN t >= 47 THEN 46.9::DOUBLE ELSE t END, 2) AS threshold FROM (
  SELECT trade_date, id, (CASE level WHEN 'risk_on' THEN 46.0::DOUBLE WHEN 'risk_off' THEN 44 ELSE 45 END + CASE WHEN amplitude * 2 >= 12 THEN 3 WHEN amplitude * 2 <= 5 THEN -1 ELSE 0 END
    + CASE WHEN id % 25 >= 18 THEN 2.0::DOUBLE WHEN id % 25 >= 10 THEN 1 WHEN id % 25 <= 5 THEN -0.5::DOUBLE ELSE 0 END
    + CASE WHEN id % 3 = 0 THEN 0 WHEN abs(pct_chg * 2) >= 8 THEN 2 WHEN abs(pct_chg * 2) >= 4 THEN 1 ELSE 0 END) AS t FROM quotes JOIN lv USING (trade_date))"""),
    "f18_execution_phase": """SELECT phase, phase IN ('main_execution', 'late_execution') AS allowed, count(*) AS n FROM (SELECT CASE WHEN t >= '09:30' AND t < '09:40' THEN 'open_observe' WHEN t >= '09:40' AND t < '10:30' THEN 'main_execution'
  WHEN t >= '10:30' AND t <= '11:20' THEN 'late_execution' WHEN t >= '13:00' AND t <= '14:00' THEN 'afternoon_observe' ELSE 'backup_only' END AS phase FROM (SELECT strftime(ts, '%H:%M') AS t FROM events)) GROUP BY 1""",
    "j2_attach": with_views(["quotes"], "SELECT trade_date, id, industry, cap, CASE WHEN id % 4 <> 1 THEN CAST(s_nationkey AS DOUBLE) END AS quality FROM quotes JOIN supplier ON s_suppkey = id"),
    "j4_lookups": with_views(["quotes"], """SELECT trade_date, id AS code, CASE WHEN id % 3 = 0 OR id * 7 % 260 = 0 THEN 50.0::DOUBLE WHEN id * 7 % 260 <= 20 THEN 100 WHEN id * 7 % 260 <= 50 THEN 88 WHEN id * 7 % 260 <= 100 THEN 76 WHEN id * 7 % 260 <= 200 THEN 62 ELSE 52 END AS hot_rank_score,
  CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey / 8.0::DOUBLE ELSE 0.0::DOUBLE END AS industry_pct, coalesce(m, 50.0::DOUBLE) AS sentiment_score FROM quotes JOIN nation ON n_name = industry
  LEFT JOIN (SELECT user_id, round(least(100.0::DOUBLE, max(value)), 6) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1) ON user_id = id"""),
    "x14_direction": with_views(["signals"], """SELECT signal_id, round(greatest(0, least(100, score * 0.30::DOUBLE + q * 0.24::DOUBLE + coalesce(rc, 50.0::DOUBLE) * 0.18::DOUBLE + coalesce(ag, q) * 0.18::DOUBLE + (100 - coalesce(rk, 50.0::DOUBLE)) * 0.10::DOUBLE)), 6) AS direction_score, o AS observation_only,
  CASE WHEN code % 6 = 0 THEN false WHEN code % 6 = 1 THEN true ELSE NOT o END AS execution_allowed
  FROM (SELECT *, CASE WHEN signal_id % 3 > 0 THEN CAST(signal_id * 3 % 101 AS DOUBLE) ELSE score END AS q, CASE WHEN signal_id % 4 > 0 THEN CAST(signal_id * 5 % 101 AS DOUBLE) END AS rc, CASE WHEN signal_id % 5 > 0 THEN CAST(signal_id * 7 % 101 AS DOUBLE) END AS ag, CASE WHEN signal_id % 7 > 0 THEN CAST(signal_id * 11 % 101 AS DOUBLE) END AS rk,
    strategy = '1' AND (signal_id % 3 = 1 OR signal_id % 11 = 0 OR code % 6 = 0) AS o FROM signals)"""),
    "x15_expected_return": with_views(["outcomes"], """, t AS (SELECT signal_id AS train_id, strategy, signal_date, exit_return - total_pct AS r, coalesce(max_drawdown, 0) AS dd, score, entry_price, total_pct, rank FROM outcomes WHERE state = 'settled' AND signal_date < (SELECT max(signal_date) - 30 FROM signals)),
q AS (SELECT signal_id AS query_id, strategy, score, entry_price, total_pct, CASE WHEN signal_id % 3 <> 0 THEN rank END AS rank FROM outcomes WHERE signal_date >= (SELECT max(signal_date) - 30 FROM signals)),
e AS (SELECT query_id, train_id, signal_date, r, dd, (q.score IS NOT NULL)::INT + (q.entry_price IS NOT NULL AND t.entry_price IS NOT NULL)::INT + (q.total_pct IS NOT NULL AND t.total_pct IS NOT NULL)::INT + (q.rank IS NOT NULL)::INT AS shared,
  round((pow((q.score - t.score) / 100.0::DOUBLE, 2) * 1.8::DOUBLE + coalesce(pow((q.entry_price - t.entry_price) / 10.0::DOUBLE, 2), 0) + coalesce(pow((q.total_pct - t.total_pct) / 5.0::DOUBLE, 2) * 0.5::DOUBLE, 0) + coalesce(pow((q.rank - t.rank) / 5.0::DOUBLE, 2) * 0.4::DOUBLE, 0))
    / (1.8::DOUBLE + CASE WHEN q.entry_price - t.entry_price IS NULL THEN 0 ELSE 1.0::DOUBLE END + CASE WHEN q.total_pct - t.total_pct IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN q.rank IS NULL THEN 0 ELSE 0.4::DOUBLE END), 9) AS d FROM q JOIN t USING (strategy)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, train_id) AS near, count(*) OVER (PARTITION BY query_id) AS n FROM e WHERE shared >= 3) WHERE n >= 20 AND near <= greatest(20, floor(n * 0.35::DOUBLE))),
w AS (SELECT *, pow(0.5::DOUBLE, date_diff('day', signal_date, max(signal_date) OVER (PARTITION BY query_id)) / 60.0::DOUBLE) AS w FROM p),
c AS (SELECT query_id, r, sum(w) OVER (PARTITION BY query_id ORDER BY r RANGE UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY query_id) AS total FROM w),
low AS (SELECT query_id, min(r) AS p10 FROM c WHERE c >= 0.1::DOUBLE * total GROUP BY 1)
SELECT query_id, count(*) AS peers, round(sum(w * r) / sum(w), 6) AS expected, round(sum(CASE WHEN r > 0 THEN w ELSE 0 END) / sum(w), 6) AS p_win, round(any_value(p10), 6) AS downside_p10, round(sum(w * dd) / sum(w), 6) AS expected_drawdown,
  round(sqrt(greatest(0, sum(w * r * r) / sum(w) - pow(sum(w * r) / sum(w), 2))) / sqrt(greatest(1, sum(w))), 6) AS uncertainty, CASE WHEN (SELECT count(DISTINCT signal_date) FROM t) >= 60 THEN 'ready' ELSE 'shadow' END AS confidence
FROM w JOIN low USING (query_id) GROUP BY query_id HAVING count(*) >= 20"""),
    "q5_experiment_fdr": """WITH t AS (SELECT o_orderkey AS experiment_id, o_orderpriority AS experiment_family, unnest(range(0, o_orderkey % 4 + 1)) AS trial, o_orderkey * 7919 % 9973 / 9973.0::DOUBLE AS p FROM orders),
v AS (SELECT experiment_id, experiment_family, trial, CASE trial WHEN 0 THEN p * p * 0.01::DOUBLE WHEN 1 THEN p ELSE 1.0::DOUBLE END AS p_value, trial < 2 AS reported FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY experiment_family ORDER BY p_value, experiment_id, trial) AS k, count(*) OVER (PARTITION BY experiment_family) AS m FROM v)
SELECT experiment_id, experiment_family, trial, round(p_value, 12) AS p_value, reported, k <= coalesce(max(CASE WHEN p_value <= 0.1::DOUBLE * k / m THEN k END) OVER (PARTITION BY experiment_family), 0) AS rejected FROM r""",
    "a13_readiness": with_views(["signals", "settled"], """, j AS (SELECT s.*, d.signal_id IS NOT NULL AS done, s.signal_id % 5 <> 0 AS cur FROM signals s LEFT JOIN (SELECT signal_id FROM settled) d USING (signal_id))
SELECT strategy, count(*) AS n, count(*) FILTER (cur) AS current, count(*) FILTER (NOT cur) AS other, count(DISTINCT signal_date) FILTER (cur) AS days, count(DISTINCT signal_date) FILTER (cur AND done) AS labelled_days,
  round(coalesce(count(*) FILTER (cur AND done) / nullif(count(*) FILTER (cur), 0) * 100, 0), 6) AS coverage_pct, count(DISTINCT signal_date) FILTER (cur AND done) >= 60 AS ready FROM j GROUP BY strategy"""),
    "a13_backfill": with_views(["signals", "settled"], "SELECT code, count(*) AS waiting, max(signal_date) AS latest, min(rank) AS best_rank FROM signals WHERE signal_id NOT IN (SELECT signal_id FROM settled) GROUP BY code"),
    "a22_gates": with_views(["quotes"], """, f AS (SELECT count(*) AS n, count(CASE WHEN id % 40 > 0 THEN volume END) AS v, count(CASE WHEN id % 25 > 0 THEN cap END) AS o FROM quotes)
SELECT 'base_quote' AS gate, 98.0::DOUBLE AS required_pct, 100.0::DOUBLE AS least_pct, true AS passed, 5 AS eligible FROM f
UNION ALL SELECT 'hard_filter_execution', 99.0::DOUBLE, round(v / n * 100, 6), v / n * 100 >= 99, 3 + (v / n * 100 >= 99)::INT FROM f
UNION ALL SELECT 'optional_research', 95.0::DOUBLE, 0.0::DOUBLE, false, (o / n * 100 >= 95)::INT FROM f"""),
    "a22_freshness": "WITH l AS (SELECT user_id AS code, max(ts) AS t FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events) SELECT code, CAST(floor(epoch(now)) - floor(epoch(t)) AS BIGINT) AS age_seconds, strftime(t, '%H:%M:%S') >= '14:30:00' AND strftime(t, '%H:%M:%S') < '14:50:00' AS in_window FROM l, n",
    "s14_spot": "SELECT p_partkey AS code, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_retailprice AS DOUBLE) END AS price, 0.0::DOUBLE AS pct_chg, (SELECT max(p_partkey) + 1700000000 FROM part) AS stamp FROM part",
    "s18_events": "SELECT lpad(right(CAST(c_custkey AS VARCHAR), 6), 6, '0') AS code, c_mktsegment AS date, CAST(c_acctbal AS DOUBLE) AS unlock_ratio, CAST(c_acctbal AS DOUBLE) AS pledge_ratio FROM customer WHERE c_custkey % 3 < 2",
    "s19_blacklist_files": "SELECT o_custkey % 50 AS code, CAST(sum(o_orderkey % 10) AS DOUBLE) AS penalty, ['none', 'low', 'medium', 'high', 'critical'][max(o_orderkey % 5) + 1] AS level, bool_or(o_orderkey % 9 = 0) AS hard, count(*) AS items FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01' GROUP BY 1",
    "s25_experiments": f"""SELECT experiment_id, violations FROM (SELECT o_orderkey AS experiment_id, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'experiment_family' END, CASE WHEN {_KIND} IN ('unknown', 'close_forward') THEN 'sample_type' END, CASE WHEN o_orderkey % 7 = 0 THEN 'baseline_id' END,
  CASE WHEN o_orderkey % 4 = 0 THEN 'candidate_parameters' END, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 3 < o_orderkey % 4 THEN 'trial_count' END) AS violations FROM orders) WHERE violations <> ''""",
    "s7_bar_layout": "WITH b AS (SELECT DISTINCT l_suppkey AS k, CAST(l_shipdate AS DATE) AS t, ['600', '300', '688', '430', '000'][l_suppkey % 5 + 1] || lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0') AS code FROM lineitem) SELECT CASE substr(code, 1, 3) WHEN '300' THEN 'chinext' WHEN '688' THEN 'star' ELSE 'main' END AS market, substr(code, 1, 5) AS prefix, count(*) AS n, count(DISTINCT code) AS codes FROM b GROUP BY 1, 2",
}

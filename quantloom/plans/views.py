"""DuckDB SQL of the engine's views and of longer operators, for the oracles. `with_views(names, body)` makes one statement."""

from __future__ import annotations

_FAC = ["bars"]

VIEWS: dict[str, tuple[list[str], str]] = {
    "bars": ([], """
  SELECT code, trade_date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
         CAST(sum(qty) AS DOUBLE) AS volume, CAST(sum(amount) AS DOUBLE) AS turnover
  FROM (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS trade_date, CAST(l_quantity AS DECIMAL(18,2)) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
               1e2 + (CAST(round(l_extendedprice * 100) AS BIGINT) % 1000) / 1e2 AS px,
               row(l_orderkey, l_linenumber, l_partkey, 1e2 + (CAST(round(l_extendedprice * 100) AS BIGINT) % 1000) / 1e2) AS k FROM lineitem)
  GROUP BY code, trade_date"""),
    "quotes": (["bars"], """
  SELECT b.code AS id, ['600', '300', '688', '430', '000'][b.code % 5 + 1] || lpad(CAST(b.code % 1000 AS VARCHAR), 3, '0') AS code,
         CASE WHEN b.code % 17 = 3 THEN '*ST ' || s_name ELSE s_name END AS name, n_name AS industry, trade_date, open, high, low, close AS price, prev_close, volume, turnover, s_acctbal AS cap,
         coalesce((close / prev_close - 1) * 100, 0) AS pct_chg, coalesce((high - low) / prev_close * 100, 0) AS amplitude
  FROM (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS prev_close FROM bars) b
  JOIN supplier ON s_suppkey = b.code JOIN nation ON s_nationkey = n_nationkey"""),
    "signals": ([], """
  SELECT *, row_number() OVER (PARTITION BY strategy, signal_date ORDER BY score DESC, signal_id) AS rank FROM (
    SELECT o_orderkey AS signal_id, substr(o_orderpriority, 1, 1) AS strategy, CAST(o_orderdate AS DATE) AS signal_date, o_custkey % (SELECT count(*) FROM supplier) AS code,
           (CAST(round(o_totalprice * 100) AS BIGINT) % 10000) / 100.0::DOUBLE AS score FROM orders)"""),
    "fx": (["bars"], """
  SELECT *, least(bar_no, {look}) AS n,
         avg(turnover) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS t5q,
         stddev_samp(r1) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd
  FROM (SELECT *, row_number() OVER w AS bar_no, close / lag(close) OVER w - 1 AS r1, lag(close, 3) OVER w AS p3, lag(close, 5) OVER w AS p5, lag(close, 10) OVER w AS p10, lag(close, 20) OVER w AS p20,
               avg(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m5, avg(close) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m10,
               avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m20, avg(close) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m60,
               avg(turnover) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS t5, avg(turnover) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS turnover_20d,
               avg(volume) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v5, max(high) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS h20
        FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date))"""),
    "factors": (["fx"], """
  SELECT code, trade_date, open, high, low, close, volume, turnover, bar_no,
         CASE WHEN n > 3 AND p3 > 0 THEN (close / p3 - 1) * 100 ELSE 0 END AS ret_3d, CASE WHEN n > 5 AND p5 > 0 THEN (close / p5 - 1) * 100 ELSE 0 END AS ret_5d,
         CASE WHEN n > 10 AND p10 > 0 THEN (close / p10 - 1) * 100 ELSE 0 END AS ret_10d, CASE WHEN n > 20 AND p20 > 0 THEN (close / p20 - 1) * 100 ELSE 0 END AS ret_20d,
         CASE WHEN n >= 5 THEN (close / m5 - 1) * 100 ELSE 0 END AS ma5_gap, CASE WHEN n >= 10 THEN (close / m10 - 1) * 100 ELSE 0 END AS ma10_gap,
         CASE WHEN n >= 20 THEN (close / m20 - 1) * 100 ELSE 0 END AS ma20_gap, CASE WHEN n >= 60 THEN (close / m60 - 1) * 100 ELSE 0 END AS ma60_gap,
         CASE WHEN n >= 60 AND round(m5 - m10, 9) > 0 AND round(m10 - m20, 9) > 0 AND round(m20 - m60, 9) > 0 THEN 1.0::DOUBLE ELSE 0 END AS ma_bull_aligned,
         coalesce(t5 / nullif(CASE WHEN n >= 10 THEN t5q ELSE t5 END, 0), 0) AS vol_amount_5d, coalesce(volume / nullif(v5, 0), 0) AS vol_ma5_ratio, turnover_20d,
         CASE WHEN h20 > 0 AND close >= h20 * 0.995::DOUBLE THEN 1.0::DOUBLE ELSE 0 END AS breakout_20d, coalesce(sd, 0) * 100 AS volatility_20d
  FROM fx WHERE bar_no >= 6 AND close > 0"""),
    "numbered": (["bars"], "SELECT *, row_number() OVER w AS idx, lag(close) OVER w AS prev_close FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date)"),
    "indexed": (["numbered", "signals"], """
  SELECT s.*, coalesce(b.idx, 0) AS idx, b.close AS entry_price, b.turnover AS entry_turnover
  FROM signals s ASOF LEFT JOIN numbered b ON s.code = b.code AND s.signal_date >= b.trade_date"""),
    "ahead": (["indexed"], """
  SELECT i.signal_id, i.code, i.entry_price, b.idx - i.idx - 1 AS step, b.trade_date, b.open, b.high, b.low, b.close, b.prev_close, b.turnover
  FROM indexed i JOIN numbered b ON b.code = i.code AND b.idx BETWEEN i.idx + 1 AND i.idx + 15"""),
    "marked": (["ahead"], """
  SELECT *, CASE WHEN hs THEN 'stop_loss' WHEN ht THEN 'take_profit' WHEN hr THEN 'trailing_stop' END AS why, CASE WHEN hs THEN stop WHEN ht THEN take ELSE trail END AS lvl FROM (
    SELECT *, live AND low <= stop AS hs, live AND high >= take AS ht, live AND step > 0 AND low <= trail AS hr FROM (
      SELECT *, step < 3 AS live, entry_price * (1 - 5.0::DOUBLE / 100) AS stop, entry_price * (1 + 8.0::DOUBLE / 100) AS take, peak * (1 - 4.0::DOUBLE / 100) AS trail,
             high <= prev_close * (1 - 10.0::DOUBLE / 100) * 1.01::DOUBLE AND low <= prev_close * (1 - 10.0::DOUBLE / 100) * 1.005::DOUBLE AND close <= prev_close * (1 - 10.0::DOUBLE / 100) * 1.01::DOUBLE AS sealed
      FROM (SELECT *, greatest(entry_price, coalesce(max(high) OVER (PARTITION BY signal_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), entry_price)) AS peak FROM ahead WHERE entry_price > 0)))"""),
    "exits": (["marked"], """
  SELECT signal_id, entry_price,
         CASE WHEN stuck AND again IS NOT NULL THEN again.open WHEN stuck THEN last.close WHEN hit IS NOT NULL THEN hit.px WHEN term IS NOT NULL THEN term.close ELSE entry_price END AS exit_price,
         CASE WHEN stuck AND again IS NOT NULL THEN hit.why || '_limit_down_delayed' WHEN stuck THEN hit.why || '_limit_down_unfilled' ELSE coalesce(hit.why, 'hold_to_term') END AS exit_reason,
         CASE WHEN stuck AND again IS NOT NULL THEN again.step WHEN stuck THEN last.step WHEN hit IS NOT NULL THEN hit.step ELSE coalesce(term.step, 0) END + 1 AS exit_days
  FROM (SELECT signal_id, any_value(entry_price) AS entry_price, any_value(hit) AS hit, coalesce(any_value(hit).stuck, false) AS stuck,
               arg_min({{'step': step, 'open': open}}, step) FILTER (step > hit.step AND NOT sealed) AS again, arg_max({{'step': step, 'close': close}}, step) AS last,
               arg_max({{'step': step, 'close': close}}, step) FILTER (live) AS term
        FROM (SELECT m.*, h.hit FROM marked m LEFT JOIN (
                SELECT signal_id, arg_min({{'step': step, 'why': why, 'px': CASE WHEN open < lvl AND why <> 'take_profit' THEN open ELSE lvl END, 'stuck': sealed AND why <> 'take_profit'}}, step) AS hit
                FROM marked WHERE why IS NOT NULL GROUP BY signal_id) h USING (signal_id)) GROUP BY signal_id)"""),
    "outcomes": (["exits"], """
  SELECT i.signal_id, i.strategy, i.signal_date, i.code, i.rank, i.score,
         CASE WHEN i.idx = 0 THEN 'no_bars' WHEN coalesce(m.future_days, 0) >= 3 OR (e.exit_reason IS NOT NULL AND e.exit_reason <> 'hold_to_term') THEN 'settled' ELSE 'pending' END AS state,
         i.entry_price, m.next_open_return, m.return_1d, m.return_3d, m.return_5d, m.max_gain, m.max_drawdown, coalesce(m.max_gain, 0) >= 3 AS hit_3pct, coalesce(m.max_gain, 0) >= 5 AS hit_5pct,
         e.exit_reason, e.exit_days, (e.exit_price / i.entry_price - 1) * 100 AS exit_return,
         0.25::DOUBLE + CASE WHEN entry_turnover >= 1e9 THEN 0.05::DOUBLE WHEN entry_turnover >= 3e8 THEN 0.12::DOUBLE WHEN entry_turnover >= 1e8 THEN 0.25::DOUBLE ELSE 0.45::DOUBLE END
           + CASE WHEN entry_turnover > 0 THEN least(5.0::DOUBLE, 0.1::DOUBLE * sqrt(200000.0::DOUBLE / entry_turnover) * 100) ELSE 0 END AS total_pct
  FROM indexed i LEFT JOIN (
    SELECT signal_id, count(*) AS future_days, max(CASE WHEN step = 0 THEN (open / entry_price - 1) * 100 END) AS next_open_return, max(CASE WHEN step = 0 THEN (close / entry_price - 1) * 100 END) AS return_1d,
           max(CASE WHEN step = 2 THEN (close / entry_price - 1) * 100 END) AS return_3d, max(CASE WHEN step = 4 THEN (close / entry_price - 1) * 100 END) AS return_5d,
           max((high / entry_price - 1) * 100) AS max_gain, min((low / entry_price - 1) * 100) AS max_drawdown
    FROM ahead WHERE step < 5 AND entry_price > 0 GROUP BY signal_id) m USING (signal_id) LEFT JOIN exits e USING (signal_id)"""),
    "settled": (["outcomes"], "SELECT *, exit_return - total_pct AS net_return FROM outcomes WHERE state = 'settled'"),
}


def with_views(names: list[str], body: str, look: int = 120) -> str:
    """A WITH statement over the views named and those that they stand on."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in VIEWS[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    text = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1].replace('{{', '{').replace('}}', '}').replace('{look}', str(look))})" for n in order)
    return f"WITH {text}\n{body}" if not body.lstrip().startswith(",") else f"WITH {text}\n{body}"

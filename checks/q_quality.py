"""Candle checks, stored-bar checks, trade-log cleansing, shortlist."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.operators.quality import candle_warnings, enforce_bar_limit, sampled_slices, validate_stored
from barlab.operators.shortlist import display, metric_columns, quality_filter, shortlist
from barlab.operators.tradelog import NUMERIC, REJECTIONS, chart_segments, clean_trades, examine, warnings
from checks import duck_sql as D
from checks.feeds import RESULTS, TRADES, TRADE_WINDOW, bars, derived, event_ticks, results, trade_log
from checks.registry import query, r

# Events as untidy candles: some times do not parse, some repeat, some go back.
_UNTIDY = """SELECT event_type AS pair, 'tick' AS timeframe, event_id AS seq,
  CASE WHEN event_type = 'click' AND user_id % 40 = 0 THEN 'never' WHEN event_type = 'view' THEN substr(CAST(ts AS STRING), 1, 16) || ':00'
       WHEN event_type = 'error' AND user_id % 50 = 0 THEN '2023-12-31 00:00:00' ELSE substr(CAST(ts AS STRING), 1, 19) END AS timestamp,
  value AS open, CASE WHEN event_type = 'signup' AND user_id % 30 = 0 THEN NULL ELSE value END AS high, value AS low, value AS close FROM events"""


@query(
    "k1_candle_warnings",
    f"""WITH u AS (SELECT *, try_cast(timestamp AS TIMESTAMP) AS t FROM ({_UNTIDY})), l AS (SELECT *, lag(t) OVER (PARTITION BY pair ORDER BY seq) AS p FROM u),
    s AS (SELECT pair, count(*) FILTER (t IS NULL) AS bad, count(*) FILTER (t < p) AS back, count(*) - count(DISTINCT t) - (CASE WHEN count(*) > count(t) THEN 1 ELSE 0 END) AS dup,
      count(*) FILTER (high IS NULL) AS miss FROM l GROUP BY 1)
    SELECT pair, 'tick' AS timeframe, code, coalesce(n, 0) AS count FROM (
      SELECT pair, 'invalid_timestamp' AS code, bad AS n FROM s WHERE bad > 0 UNION ALL SELECT pair, 'timestamps_not_sorted', NULL FROM s WHERE bad > 0 OR back > 0
      UNION ALL SELECT pair, 'duplicate_timestamps', dup FROM s WHERE dup > 0 UNION ALL SELECT pair, 'missing_ohlc', miss FROM s WHERE miss > 0)""",
)
def k1(spark, sf):
    return candle_warnings(derived(spark, sf, _UNTIDY, "events")).withColumn("count", F.coalesce("count", F.lit(0)))


@query(
    "k2_bar_limit",
    f"SELECT pair, {D.stamp('ts')} AS timestamp, {r('mid')} AS mid FROM ({D.EVENT_TICKS}) ORDER BY ts DESC LIMIT 5000",
)
def k2(spark, sf):
    """More rows than allowed: the most recent ones are kept."""
    kept_rows, warning = enforce_bar_limit(event_ticks(spark, sf), max_bars=5000, truncate=True)
    assert warning is None or warning["kept_bars"] == 5000
    return kept_rows.select("pair", "timestamp", "mid")


# Stored hourly bars, one fault per pair.
def _faulty(spark, sf):
    rows = bars(spark, sf, "1h").withColumn("position", F.unix_seconds("timestamp"))
    is_pair = lambda name: F.col("pair") == name
    hour = F.hour("timestamp")
    twice = F.when(is_pair("error") & (hour == 5), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    null_at = is_pair("view") & (hour == 7)
    return (
        rows.withColumn("copy", F.explode(twice))
        .withColumn("position", F.col("position") + F.col("copy"))
        .withColumn("position", F.when(is_pair("purchase") & (F.dayofmonth("timestamp") == 9), -F.col("position")).otherwise(F.col("position")))
        .withColumn("timestamp", F.when(is_pair("signup"), F.col("timestamp") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("timestamp")))
        .withColumns({c: F.when(~null_at, F.col(c)) for c in ("open", "high", "low", "close")})
        .drop("copy")
    )


_VERDICTS = f"""WITH {D.event_bars('1h')} SELECT pair, '1h' AS timeframe, pair = 'click' AS valid,
  CASE pair WHEN 'error' THEN 'duplicate timestamps detected' WHEN 'view' THEN 'all-null OHLC row detected' WHEN 'signup' THEN 'timestamps are not aligned to timeframe boundaries'
    WHEN 'purchase' THEN 'timestamps are not monotonic' ELSE 'validated ' || count(*) || ' rows' END AS message FROM bars GROUP BY pair"""


@query("k3_stored_bars", _VERDICTS + " UNION ALL SELECT DISTINCT pair, '4h', false, 'missing output file' FROM bars")
def k3(spark, sf):
    wanted = bars(spark, sf, "1h").select("pair").distinct().withColumn("timeframe", F.explode(F.array(F.lit("1h"), F.lit("4h"))))
    return validate_stored(_faulty(spark, sf), position="position", requested=wanted)


@query(
    "k3_spacing",
    f"""WITH {D.event_bars('15m')}, g AS (SELECT pair, count(*) AS n FROM bars GROUP BY 1)
    SELECT pair, '1h' AS timeframe, false AS valid, 'timestamps are not aligned to timeframe boundaries' AS message FROM g""",
)
def k3_spacing(spark, sf):
    """Fine bars stored under a coarser name."""
    return validate_stored(bars(spark, sf, "15m").withColumn("timeframe", F.lit("1h")))


@query(
    "k4_sampled_check",
    f"WITH {D.event_bars('1h')} SELECT pair, '1h' AS timeframe, true AS valid, 'validated ' || count(*) || ' rows' AS message FROM bars GROUP BY pair",
)
def k4(spark, sf):
    return validate_stored(sampled_slices(bars(spark, sf, "1h")))


# --- trade log ---
START, END = TRADE_WINDOW
_EXAMINED = f"""WITH log AS ({TRADES}), p AS (SELECT *, trade_id IS NULL OR trim(trade_id) = '' AS blank,
  CASE WHEN trade_id IS NULL OR trim(trade_id) = '' THEN 'trade_' || seq ELSE trade_id END AS id, lower(side) AS sd,
  try_cast(entry_time AS TIMESTAMP) AS et, try_cast(entry_price AS DOUBLE) AS ep, try_cast(exit_time AS TIMESTAMP) AS xt0, try_cast(exit_price AS DOUBLE) AS xp,
  try_cast(stop_loss AS DOUBLE) AS sl, try_cast(take_profit AS DOUBLE) AS tp FROM log),
q AS (SELECT *, CASE WHEN xp IS NOT NULL THEN xt0 END AS xt, xt0 IS NOT NULL AND xp IS NULL AS unpriced FROM p),
e AS (SELECT *, CASE WHEN et IS NULL THEN 0 WHEN ep IS NULL THEN 1 WHEN sd IS NULL OR sd NOT IN ('long', 'short') THEN 2 WHEN xt < et THEN 3
  WHEN coalesce(upper(pair), '') <> 'EURUSD' THEN 4 WHEN coalesce(lower(timeframe), '') <> '1h' THEN 5
  WHEN NOT (et <= TIMESTAMP '{END} 23:59:59.999999' AND coalesce(xt, et) >= TIMESTAMP '{START} 00:00:00') THEN 6 ELSE 7 END AS k FROM q) """


def _examined(spark, sf):
    return examine(trade_log(spark, sf), pair="eurusd", timeframe="1H", start=START, end=END)


def _count(code: str, condition: str) -> str:
    return f"SELECT '{code}' AS code, count(*) AS count FROM e WHERE {condition}"


_WARNINGS = [
    _count("missing_trade_id", "blank"),
    *[_count(code, f"k = {i}") for i, code in enumerate(REJECTIONS)],
    _count("missing_exit_price", "unpriced AND k > 2"),
    _count("invalid_stop_loss", "stop_loss IS NOT NULL AND sl IS NULL AND k > 3"),
    _count("open_trade", "k = 7 AND xt IS NULL"),
    _count("missing_stop_loss", "k = 7 AND sl IS NULL"),
    _count("missing_take_profit", "k = 7 AND tp IS NULL"),
]


@query("k5_trade_log_warnings", _EXAMINED + f"SELECT * FROM ({' UNION ALL '.join(_WARNINGS)}) WHERE count > 0")
def k5(spark, sf):
    return warnings(_examined(spark, sf))


@query(
    "k6_exit_repair",
    _EXAMINED + f"SELECT seq, {D.stamp('et')} AS entry_time, {D.stamp('xt')} AS exit_time, unpriced AS exit_unpriced, k = 3 AS dropped FROM e WHERE k >= 3",
)
def k6(spark, sf):
    rows = _examined(spark, sf).where(F.col("rank") >= REJECTIONS.index("invalid_trade_duration"))
    return rows.select("seq", "entry_time", "exit_time", "exit_unpriced", (F.col("rejected") == "invalid_trade_duration").alias("flag")).select(
        "seq", "entry_time", "exit_time", "exit_unpriced", F.coalesce("flag", F.lit(False)).alias("dropped")
    )


@query(
    "k7_optional_numbers",
    _EXAMINED + f"SELECT seq, {r('sl')} AS stop_loss, {r('tp')} AS take_profit, {r('try_cast(size AS DOUBLE)')} AS size, NULL::DOUBLE AS pnl, stop_loss IS NOT NULL AND sl IS NULL AS stop_loss_invalid FROM e",
)
def k7(spark, sf):
    return _examined(spark, sf).select("seq", *NUMERIC, "stop_loss_invalid")


@query("k8_series_match", _EXAMINED + "SELECT seq, CASE WHEN k = 4 THEN 'pair_mismatch' WHEN k = 5 THEN 'timeframe_mismatch' END AS rejected FROM e WHERE k >= 4")
def k8(spark, sf):
    rows = _examined(spark, sf).where(F.col("rank") >= REJECTIONS.index("pair_mismatch"))
    return rows.select("seq", F.when(F.col("rejected").isin("pair_mismatch", "timeframe_mismatch"), F.col("rejected")).alias("rejected"))


@query(
    "k9_chart_window",
    _EXAMINED + f"""SELECT id AS trade_id, sd AS side, {D.stamp('et')} AS entry_time, {r('ep')} AS entry_price, {D.stamp('xt')} AS exit_time,
    {r('CASE WHEN unpriced THEN NULL ELSE xp END')} AS exit_price, {r('sl')} AS stop_loss, {r('tp')} AS take_profit FROM e WHERE k = 7""",
)
def k9(spark, sf):
    return clean_trades(_examined(spark, sf)).select(
        "trade_id", "side", "entry_time", "entry_price", "exit_time", "exit_price", "stop_loss", "take_profit"
    )


_CHART_END = f"TIMESTAMP '{END} 23:59:59.999999'"


@query(
    "k10_chart_segments",
    _EXAMINED + f""", t AS (SELECT id, sd, et, ep, xt, CASE WHEN unpriced THEN NULL ELSE xp END AS xp, sl, tp, coalesce(xt, {_CHART_END}) AS until FROM e WHERE k = 7)
    SELECT trade_id, side, kind, {D.stamp('x0')} AS x0, {r('y0')} AS y0, {D.stamp('x1')} AS x1, {r('y1')} AS y1 FROM (
      SELECT id AS trade_id, sd AS side, 'entry' AS kind, et AS x0, ep AS y0, NULL::TIMESTAMP AS x1, NULL::DOUBLE AS y1 FROM t
      UNION ALL SELECT id, sd, 'exit', xt, xp, NULL, NULL FROM t WHERE xt IS NOT NULL AND xp IS NOT NULL
      UNION ALL SELECT id, sd, 'trade_line', et, ep, xt, xp FROM t WHERE xt IS NOT NULL AND xp IS NOT NULL
      UNION ALL SELECT id, sd, 'stop_line', et, sl, until, sl FROM t WHERE sl IS NOT NULL
      UNION ALL SELECT id, sd, 'target_line', et, tp, until, tp FROM t WHERE tp IS NOT NULL)""",
)
def k10(spark, sf):
    return chart_segments(clean_trades(_examined(spark, sf)), chart_end=END)


# --- shortlist ---
_KEPT = f"""SELECT *, net_pnl / nullif(abs(max_drawdown), 0) AS rd_ratio, net_pnl / nullif(total_trades, 0) AS avg_trade FROM ({RESULTS})
  WHERE total_trades >= 250 AND profit_factor >= 1.03 AND max_drawdown >= -0.49 AND win_rate >= 0.3"""
LIMITS = dict(min_trades=250, max_drawdown=0.49)


@query("i1_column_names", f"SELECT config_hash, {r('win_rate')} AS win_rate, total_trades AS trades FROM ({RESULTS})")
def i1(spark, sf):
    """Alternative column names resolve to the same metrics."""
    renamed = results(spark, sf).withColumnsRenamed({"win_rate": "win_rate_pct", "total_trades": "trades"})
    win, trades = metric_columns(renamed)
    return renamed.select("config_hash", F.col(win).alias("win_rate"), F.col(trades).alias("trades"))


@query("i2_quality_filter", f"SELECT config_hash, {r('rd_ratio')} AS rd_ratio, {r('avg_trade')} AS avg_trade FROM ({_KEPT})")
def i2(spark, sf):
    return quality_filter(results(spark, sf), **LIMITS).select("config_hash", "rd_ratio", "avg_trade")


def _top(by: str) -> str:
    return f"SELECT * FROM ({_KEPT}) ORDER BY {by} DESC NULLS LAST, config_hash LIMIT 25"


@query("i3_top_k", f"SELECT config_hash, {r('rd_ratio')} AS rd_ratio, {r('net_pnl')} AS net_pnl FROM ({_top('rd_ratio')})")
def i3(spark, sf):
    return shortlist(results(spark, sf), top=25, sort_by="rd_ratio", **LIMITS).select("config_hash", "rd_ratio", "net_pnl")


@query(
    "i4_display",
    f"""SELECT pair || ' ' || timeframe || ' ' || entry_type || ' ' || replace(ma_types, ',', '/') || ' ' || replace(ma_periods, ',', '/') || ' exit=' || exit_profile AS summary,
    total_trades AS trades, round(net_pnl, 6) + 0.0 AS net_pnl, round(win_rate * 100, 2) AS win_rate, round(profit_factor, 3) AS profit_factor, round(rd_ratio, 3) AS rd_ratio,
    round(final_capital, 2) AS final_capital FROM ({_top('profit_factor')})""",
)
def i4(spark, sf):
    return display(shortlist(results(spark, sf), top=25, **LIMITS))

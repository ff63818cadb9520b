"""Trades, equity and metrics; all SQL runs the same bar-stepping state machine."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.operators.ledger.configs import CONFIG_FIELDS, check_configs, configs_per_series
from barlab.operators.ledger.entries import align_signals
from barlab.operators.metrics import EXIT_COUNTS
from barlab.operators.signals import ma_strategy
from barlab.plans.backtest import run_backtest
from checks import duck_sql as D
from checks.feeds import bars, derived, kept, table
from checks.registry import query, r
from checks.runs import BASE, BROKEN, NAMES, RULE, RUNS, TIMEFRAME, settings


def book(spark, sf):
    """All runs of ``RUNS`` over all pairs, kept for the session."""

    def build():
        candles = bars(spark, sf, TIMEFRAME)
        return run_backtest(candles, ma_strategy(candles, **RULE), configs_per_series(candles, settings()))

    return kept(spark, sf, "book", build)


def _machine(names: list[str], tail: str, extra: str = "") -> str:
    """SQL over ``trades`` / ``steps`` of the named runs."""
    runs = settings(names)
    feeds = []
    for k, run in enumerate(runs):
        ma = "fast" if run.get("ma_stop_source", "short") == "short" else "slow"
        feeds.append(
            f"SELECT {k} AS k, pair, i, ts, o, h, l, c, sig, atr_{run.get('atr_method', 'wilder')} AS atr, "
            f"atr_{run.get('chandelier_atr_method', 'wilder')} AS chatr, {ma} AS ma FROM sigs"
        )
    named = " ".join(f"WHEN {k} THEN '{run['strategy_name']}'" for k, run in enumerate(runs))
    return f"""WITH RECURSIVE {D.event_bars(TIMEFRAME)},
tr AS (SELECT *, {D.true_range()} AS tr FROM bars),
{D.recurrence('rc', 'tr', 'c', [('e3', 'ema', 3)])},
{D.recurrence('rt', 'tr', 'tr', [('w14', 'wilder', 14), ('e9', 'ema', 9)])},
av AS (SELECT *, {D.sma('c', 8)} AS slow, {D.sma('tr', 5)} AS atr_sma FROM tr),
ind AS (SELECT a.*, CASE WHEN a.i >= 2 THEN e3 END AS fast, CASE WHEN a.i >= 13 THEN w14 END AS atr_wilder, CASE WHEN a.i >= 8 THEN e9 END AS atr_ema
  FROM av a JOIN rc USING (pair, i) JOIN rt USING (pair, i)),
reg AS (SELECT *, CASE WHEN c > fast AND c > slow THEN 1 WHEN c < fast AND c < slow THEN -1 ELSE 0 END AS g FROM ind),
sigs AS (SELECT *, CASE WHEN g = 1 AND coalesce(lag(g) OVER w, 0) <= 0 THEN 1 WHEN g = -1 AND coalesce(lag(g) OVER w, 0) >= 0 THEN -1 ELSE 0 END AS sig
  FROM reg WINDOW w AS (PARTITION BY pair ORDER BY i)),
cfg AS ({D.config_rows(runs)}),
feed AS ({' UNION ALL '.join(feeds)}),
{D.machine()}{extra},
named AS (SELECT *, CASE k {named} END AS run FROM trades)
{tail}"""


KEY = ["run", "pair", "trade_no"]


def _trades(spark, sf, names: list[str], columns: list[str]):
    rows = book(spark, sf).trades.where(F.col("strategy_name").isin(names))
    return rows.withColumn("run", F.col("strategy_name")).select(*KEY, *columns)


# ledger column -> SQL over ``named``
SQL = {
    "side": "side", "entry_index": "entry_index", "exit_index": "exit_index", "entry_time": D.stamp("entry_ts"),
    "exit_time": D.stamp("exit_ts"), "entry_price": r("entry_price"), "exit_price": r("exit_price"), "stop_loss": r("stop_loss"),
    "take_profit": r("take_profit"), "size": r("size"), "pnl": r("net"), "outcome": "CASE WHEN net > 0 THEN 'win' WHEN net < 0 THEN 'loss' ELSE 'breakeven' END",
    "capital_before": r("capital_before"), "capital_after": r("capital_after"), "risk_amount": r("risk_amount"),
    "stop_distance_at_entry": r("stop_distance"), "atr_at_entry": r("atr_at_entry"), "trailing_stop_initial": r("trail_initial"),
    "trailing_stop_final": r("trail_final"), "trailing_stop_exit_hit": "reason IN ('trailing_stop', 'chandelier_trailing_stop')",
    "break_even_stop_price": r("break_even_price"), "break_even_exit_hit": "reason = 'break_even'", "ma_stop_initial": r("ma_initial"),
    "ma_stop_final": r("ma_final"), "ma_stop_exit_hit": "reason = 'ma_stop'", "exit_reason": "reason", "duration_bars": "duration",
    "gross_pnl": r("gross"), "net_pnl": r("net"), "trade_id": "run || '_' || trade_no", "position_size_used": r("size"),
    "strategy_name": "run", "timeframe": f"'{TIMEFRAME}'",
}


def trade_query(name: str, runs: list[str], columns: list[str]):
    shown = ", ".join(f"{SQL[c]} AS {c}" for c in columns)
    query(name, _machine(runs, f"SELECT run, pair, trade_no, {shown} FROM named"))(
        lambda spark, sf: _trades(spark, sf, runs, columns)
    )


FILLS = ["side", "entry_index", "entry_time", "entry_price", "exit_index", "exit_time", "exit_price", "exit_reason"]
trade_query("f3_costs", ["fixed_levels", "atr_levels", "everything"], ["side", "entry_price", "exit_price", "gross_pnl", "net_pnl"])
trade_query("f4_flips", ["plain"], FILLS)
trade_query("f5_levels", ["fixed_levels", "atr_levels"], ["side", "entry_price", "stop_loss", "take_profit", "atr_at_entry"])
trade_query("f7_trailing", ["trailing", "trailing_live_atr"], [*FILLS, "trailing_stop_initial", "trailing_stop_final", "trailing_stop_exit_hit"])
trade_query("f8_activation", ["activated", "activated_atr"], [*FILLS, "trailing_stop_initial", "trailing_stop_final"])
trade_query("f9_chandelier", ["chandelier", "chandelier_activated"], [*FILLS, "trailing_stop_initial", "trailing_stop_final", "trailing_stop_exit_hit"])
trade_query("f10_break_even", ["break_even", "break_even_atr"], [*FILLS, "break_even_stop_price", "break_even_exit_hit"])
trade_query("f11_ma_stop", ["ma_stop", "ma_stop_buffered", "risk_ma_stop"], [*FILLS, "ma_stop_initial", "ma_stop_final", "ma_stop_exit_hit"])
trade_query("f12_tightest_stop", ["everything", "break_even_atr"], FILLS)
trade_query("f13_bar_exits", ["fixed_levels", "atr_levels", "long_only"], FILLS)
trade_query("f15_one_position", ["long_only", "short_only"], FILLS)
trade_query("f16_fixed_size", ["fixed_levels", "plain", "trailing"], ["size", "risk_amount", "stop_distance_at_entry"])
trade_query("f17_risk_size", ["risk_sized", "risk_ma_stop", "risk_ruin"], ["size", "risk_amount", "stop_distance_at_entry", "capital_before"])
trade_query("f18_capital", ["fixed_levels", "risk_sized", "risk_ruin"], ["capital_before", "capital_after", "gross_pnl", "net_pnl", "outcome"])
trade_query("f19_trade_records", NAMES, list(SQL))


@query(
    "f14_forced_end",
    _machine(NAMES, f"SELECT run, pair, trade_no, side, {D.stamp('exit_ts')} AS exit_time, {r('exit_price')} AS exit_price FROM named WHERE reason = 'forced_end'"),
)
def f14(spark, sf):
    return _trades(spark, sf, NAMES, ["side", "exit_time", "exit_price", "exit_reason"]).where("exit_reason = 'forced_end'").drop("exit_reason")


_EXTERNAL = "SELECT event_type AS pair, ts, CASE WHEN user_id % 3 = 0 THEN 1 WHEN user_id % 3 = 1 THEN -1 ELSE 0 END AS signal, event_id AS seq FROM events"


@query(
    "f1_align_signals",
    f"""WITH {D.event_bars('4h')}, s AS (SELECT pair, {D.bucket('ts', '4h')} AS ts, last(signal ORDER BY seq) AS signal FROM ({_EXTERNAL}) WHERE hour(ts) < 12 GROUP BY 1, 2)
    SELECT pair, {D.stamp('ts')} AS timestamp, {r('c')} AS close, coalesce(signal, 0) AS signal FROM bars LEFT JOIN s USING (pair, ts)""",
)
def f1(spark, sf):
    """Many signals per bar time and none for some bars."""
    raw = table(spark, sf, "events").selectExpr(
        "event_type AS pair", "'4h' AS timeframe", "CAST(ts AS TIMESTAMP) AS at",
        "CASE WHEN user_id % 3 = 0 THEN 1 WHEN user_id % 3 = 1 THEN -1 ELSE 0 END AS signal", "event_id AS seq",
    )
    signals = raw.where(F.hour("at") < 12).withColumn("timestamp", F.window("at", "4 hours").start).drop("at")
    return align_signals(bars(spark, sf, "4h"), signals).select("pair", "timestamp", "close", "signal")


def _candidate_sql(names: list[str]) -> str:
    return _machine(
        names,
        f"""SELECT CASE f.k {' '.join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names))} END AS run, f.pair, f.i AS entry_index,
        CASE WHEN psig > 0 THEN 'long' ELSE 'short' END AS side, {r("CASE WHEN psig > 0 THEN o + spread / 2 + slip ELSE o - spread / 2 - slip END")} AS entry_price
        FROM walk f JOIN cfg c ON c.k = f.k WHERE psig <> 0 AND (CASE WHEN psig > 0 THEN longs ELSE shorts END)
        AND (NOT (coalesce(slm = 'atr', false) OR coalesce(tpm = 'atr', false) OR coalesce(tam = 'atr', false) OR coalesce(bem = 'atr', false) OR coalesce(bebm = 'atr', false)) OR patr IS NOT NULL)
        AND (NOT mas OR pma IS NOT NULL)""",
    )


def _candidates(spark, sf, names):
    rows = book(spark, sf).candidates.where(F.col("strategy_name").isin(names))
    return rows.select(
        F.col("strategy_name").alias("run"), "pair", "entry_index", F.when(F.col("sign") > 0, "long").otherwise("short").alias("side"),
        (F.col("sign") * F.col("entry_s")).alias("entry_price"),
    )


@query("f2_candidate_entries", _candidate_sql(["plain", "fixed_levels", "long_only", "short_only"]))
def f2(spark, sf):
    return _candidates(spark, sf, ["plain", "fixed_levels", "long_only", "short_only"])


@query("f6_warm_up_gates", _candidate_sql(["atr_levels", "trailing_live_atr", "activated_atr", "ma_stop_buffered", "break_even_atr"]))
def f6(spark, sf):
    return _candidates(spark, sf, ["atr_levels", "trailing_live_atr", "activated_atr", "ma_stop_buffered", "break_even_atr"])


EQUITY_RUNS = ["plain", "fixed_levels", "everything", "long_only", "risk_ruin"]


def _run_name(names: list[str], key: str) -> str:
    return f"CASE {key} {' '.join(f'WHEN {k} THEN {chr(39)}{n}{chr(39)}' for k, n in enumerate(names))} END"


@query(
    "f20_equity",
    _machine(
        EQUITY_RUNS,
        f"SELECT {_run_name(EQUITY_RUNS, 'k')} AS run, pair, {D.stamp('ts')} AS timestamp, {r('equity')} AS equity, {r('capital')} AS capital, side AS position_side FROM equity",
        f", {D.equity()}",
    ),
)
def f20(spark, sf):
    names = book(spark, sf).runs.select("run_id", F.col("strategy_name").alias("run")).where(F.col("run").isin(EQUITY_RUNS))
    return book(spark, sf).equity.join(names, "run_id").select("run", "pair", "timestamp", "equity", "capital", "position_side")


def _f21_sql() -> str:
    rows = []
    for name, setting in BROKEN.items():
        rows.append((name, EXPECTED_ERRORS[name]))
    values = ", ".join(f"('{n}', {'NULL' if e is None else chr(39) + e.replace(chr(39), chr(39) * 2) + chr(39)})" for n, e in rows)
    return f"SELECT run, pair, error FROM (VALUES {values}) v(run, error) CROSS JOIN (SELECT DISTINCT event_type AS pair FROM events)"


EXPECTED_ERRORS = {
    "bad_mode": "Unsupported position_sizing_mode.",
    "no_capital": "initial_capital must be positive.",
    "no_size": "fixed_position_size must be positive when position_sizing_mode='fixed'.",
    "no_risk": "risk_percent must be positive when position_sizing_mode='risk_percent'.",
    "no_stop": "position_sizing_mode='risk_percent' requires an entry-time stop from stop_loss or ma_stop.",
    "negative_spread": "spread must be zero or positive.",
    "no_side": "At least one of allow_long or allow_short must be enabled.",
    "many_positions": "Only one_position_at_a_time=True is supported.",
    "mode_without_value": "stop_loss_mode requires stop_loss to be set.",
    "zero_target": "take_profit must be positive when provided.",
    "strange_mode": "Unsupported stop_loss_mode.",
    "strange_trailing": "Unsupported trailing_type.",
    "strange_source": "Unsupported ma_stop_source.",
    "buffer_without_stop": "ma_stop_buffer and ma_stop_buffer_mode require ma_stop to be enabled.",
    "activation_alone": "trailing_activation requires trailing stop configuration.",
    "multiplier_on_standard": "chandelier_multiplier is only used with trailing_type='chandelier'.",
    "stop_on_chandelier": "trailing_stop and trailing_stop_mode are not used with trailing_type='chandelier'.",
    "chandelier_alone": "trailing_type='chandelier' requires a positive chandelier_multiplier.",
    "bad_atr_period": "atr_period must be a positive integer.",
    "bad_atr_method": "Unsupported atr_method.",
    "fine": None,
    "fine_spelling": None,
}


@query("f21_config_checks", _f21_sql())
def f21(spark, sf):
    templates = [{**BASE, "strategy_name": name, **setting} for name, setting in BROKEN.items()]
    configs = configs_per_series(bars(spark, sf, TIMEFRAME), templates)
    return check_configs(configs).select(F.col("strategy_name").alias("run"), "pair", "error")


# One config per order; some break one rule or more, the first broken rule is reported.
_CONFIGS = """SELECT o_orderkey AS key, CASE WHEN o_custkey % 11 = 0 THEN 0.0 ELSE o_totalprice END AS initial_capital,
  CASE WHEN o_orderstatus = 'P' THEN ' Risk_Percent ' ELSE 'fixed' END AS position_sizing_mode, CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE 1.5 END AS fixed_position_size,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 0.01 END AS risk_percent, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN -2.0 ELSE 2.0 END AS stop_loss,
  CASE WHEN o_orderkey % 3 = 0 THEN 'ATR' WHEN o_orderkey % 3 = 1 THEN NULL ELSE 'pips' END AS stop_loss_mode,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'chandelier' ELSE 'standard' END AS trailing_type,
  CASE WHEN o_custkey % 2 = 0 THEN 1.5 END AS chandelier_multiplier, o_custkey % 17 > 0 AS allow_long, o_custkey % 34 > 0 AS allow_short FROM orders"""


@query(
    "f21_config_rows",
    f"""WITH c AS (SELECT *, lower(trim(position_sizing_mode)) AS mode, CASE WHEN stop_loss IS NULL THEN stop_loss_mode ELSE lower(trim(coalesce(stop_loss_mode, 'absolute'))) END AS slm FROM ({_CONFIGS}))
    SELECT key, CASE WHEN initial_capital <= 0 THEN 'initial_capital must be positive.'
      WHEN mode = 'fixed' AND fixed_position_size IS NULL THEN 'fixed_position_size must be positive when position_sizing_mode=''fixed''.'
      WHEN mode = 'risk_percent' AND risk_percent IS NULL THEN 'risk_percent must be positive when position_sizing_mode=''risk_percent''.'
      WHEN mode = 'risk_percent' AND stop_loss IS NULL THEN 'position_sizing_mode=''risk_percent'' requires an entry-time stop from stop_loss or ma_stop.'
      WHEN NOT allow_long AND NOT allow_short THEN 'At least one of allow_long or allow_short must be enabled.'
      WHEN stop_loss IS NULL AND slm IS NOT NULL THEN 'stop_loss_mode requires stop_loss to be set.'
      WHEN stop_loss <= 0 THEN 'stop_loss must be positive when provided.' WHEN slm NOT IN ('absolute', 'atr') THEN 'Unsupported stop_loss_mode.'
      WHEN trailing_type = 'standard' AND chandelier_multiplier IS NOT NULL THEN 'chandelier_multiplier is only used with trailing_type=''chandelier''.'
      WHEN trailing_type = 'chandelier' AND chandelier_multiplier IS NULL THEN 'trailing_type=''chandelier'' requires a positive chandelier_multiplier.' END AS error FROM c""",
)
def f21_rows(spark, sf):
    """Every order as a config row."""
    rows = derived(spark, sf, _CONFIGS, "orders")
    filled = rows.selectExpr(
        "key", *[name if name in rows.columns else f"CAST({'NULL' if value is None else repr(value)} AS {dtype}) AS {name}" for name, dtype, value in CONFIG_FIELDS]
    )
    return check_configs(filled).select("key", "error")


def metric_query(name: str, columns: list[str]):
    shown = ", ".join(c if c in COUNTS else f"{r(c)} AS {c}" for c in columns)
    sql = _machine(NAMES, f"SELECT {_run_name(NAMES, 'k')} AS run, pair, {shown} FROM metrics", f", {D.equity()}, {D.metrics()}")

    def run(spark, sf):
        names = book(spark, sf).runs.select("run_id", "pair", F.col("strategy_name").alias("run"))
        return book(spark, sf).metrics.join(names, ["run_id", "pair"]).select("run", "pair", *columns)

    query(name, sql)(run)


COUNTS = ["total_trades", "long_trades_count", "short_trades_count", *EXIT_COUNTS.values()]
metric_query(
    "g1_trade_totals",
    ["total_trades", "gross_pnl", "net_pnl", "win_rate", "average_win", "average_loss", "expectancy", "average_trade_duration_bars",
     "average_risk_amount", "average_position_size_used", "long_trades_count", "short_trades_count"],
)
metric_query("g2_drawdown", ["max_drawdown", "max_drawdown_pct"])
metric_query("g3_profit_factor", ["profit_factor"])
metric_query("g4_capital", ["initial_capital", "final_capital", "ending_equity", "total_return_pct"])
metric_query("g5_exit_counts", list(EXIT_COUNTS.values()))

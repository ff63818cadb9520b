"""SQL text blocks for the independent (DuckDB) side of the checks.

Recurrences are plain recursions over the bar number here, and the ledger is a
bar-stepping state machine: different formulations from the Spark operators.
"""

from __future__ import annotations

SECONDS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400}

EVENT_TICKS = "SELECT event_type AS pair, ts, value AS mid, event_id AS seq FROM events"
LINE_TICKS = (
    "SELECT l_returnflag AS pair, l_shipdate AS ts, l_extendedprice AS mid, "
    "row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS seq, "
    "l_quantity, l_discount, l_tax FROM lineitem"
)


def bucket(ts: str, timeframe: str) -> str:
    micros = SECONDS[timeframe] * 1_000_000
    return f"make_timestamp((epoch_us({ts}) // {micros}) * {micros})"


def stamp(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def event_bars(timeframe: str, name: str = "bars") -> str:
    """CTE ``name(pair, ts, o, h, l, c, n, i)`` of event bars."""
    return f"""{name} AS (
  SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) - 1 AS i FROM (
    SELECT pair, {bucket('ts', timeframe)} AS ts, first(mid ORDER BY ts, seq) AS o, max(mid) AS h, min(mid) AS l,
           last(mid ORDER BY ts, seq) AS c, count(*) AS n
    FROM ({EVENT_TICKS}) GROUP BY 1, 2))"""


def over(frame: str = "", key: str = "pair") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY i {frame})"


def sma(column: str, n: int, key: str = "pair") -> str:
    return f"CASE WHEN i >= {n - 1} THEN avg({column}) {over(f'ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW', key)} END"


def wma(column: str, n: int, key: str = "pair", first: int = 0) -> str:
    terms = " + ".join(f"{n - k} * lag({column}, {k}) {over('', key)}" for k in range(n))
    return f"CASE WHEN i >= {first + n - 1} THEN ({terms}) / {n * (n + 1) / 2} END"


def true_range() -> str:
    previous = f"lag(c) {over()}"
    return f"greatest(h - l, coalesce(abs(h - {previous}), h - l), coalesce(abs(l - {previous}), h - l))"


def recurrence(name: str, source: str, value: str, specs: list[tuple[str, str, int]]) -> str:
    """CTE ``name(pair, i, <col>...)`` running y = f(y, x) over ``source.value``.

    ``specs``: (column, kind, n) with kind ema or wilder; values are masked later.
    """
    starts, steps = [], []
    for column, kind, n in specs:
        if kind == "ema":
            starts.append(f"{value}::DOUBLE AS {column}")
            steps.append(f"r.{column} * {1 - 2 / (n + 1)!r} + s.{value} * {2 / (n + 1)!r}")
        else:
            starts.append(f"{value}::DOUBLE AS {column}")
            steps.append(
                f"CASE WHEN s.i < {n - 1} THEN r.{column} + s.{value} "
                f"WHEN s.i = {n - 1} THEN (r.{column} + s.{value}) / {n} "
                f"ELSE (r.{column} * {n - 1} + s.{value}) / {n} END"
            )
    return f"""{name} AS (
  SELECT pair, i, {', '.join(starts)} FROM {source} WHERE i = 0
  UNION ALL
  SELECT s.pair, s.i, {', '.join(steps)} FROM {name} r JOIN {source} s ON s.pair = r.pair AND s.i = r.i + 1)"""


DEFAULTS = {
    "cap0": None, "mode": "fixed", "fsize": None, "riskp": None, "spread": 0.0, "slip": 0.0, "fee": 0.0,
    "longs": True, "shorts": True, "sl": None, "slm": None, "tp": None, "tpm": None, "ts": None, "tsm": None,
    "ttype": "standard", "ta": None, "tam": None, "chm": None, "be": None, "bem": None, "beb": None, "bebm": None,
    "mas": False, "mab": None, "mabm": None,
}
# setting of a run -> column of the state machine
SHORT = {
    "initial_capital": "cap0", "position_sizing_mode": "mode", "fixed_position_size": "fsize", "risk_percent": "riskp",
    "spread": "spread", "slippage": "slip", "fee_per_trade": "fee", "allow_long": "longs", "allow_short": "shorts",
    "stop_loss": "sl", "stop_loss_mode": "slm", "take_profit": "tp", "take_profit_mode": "tpm",
    "trailing_stop": "ts", "trailing_stop_mode": "tsm", "trailing_type": "ttype", "trailing_activation": "ta",
    "trailing_activation_mode": "tam", "chandelier_multiplier": "chm", "break_even": "be", "break_even_mode": "bem",
    "break_even_buffer": "beb", "break_even_buffer_mode": "bebm", "ma_stop": "mas", "ma_stop_buffer": "mab",
    "ma_stop_buffer_mode": "mabm",
}
_TEXT = {"mode", "slm", "tpm", "tsm", "ttype", "tam", "bem", "bebm", "mabm"}
_BOOL = {"longs", "shorts", "mas"}


def _sql(column: str, value) -> str:
    kind = "VARCHAR" if column in _TEXT else "BOOLEAN" if column in _BOOL else "DOUBLE"
    if value is None:
        return f"NULL::{kind}"
    return f"'{value}'" if kind == "VARCHAR" else f"{value}::{kind}"


def config_rows(runs: list[dict]) -> str:
    """CTE body: one row per run, key k = position; implied modes and buffers filled in."""
    rows = []
    for k, run in enumerate(runs):
        values = dict(DEFAULTS)
        values.update({SHORT[name]: value for name, value in run.items() if name in SHORT})
        if values["be"] is not None and values["beb"] is None:
            values["beb"] = 0.0
        if values["mas"] and values["mab"] is None:
            values["mab"] = 0.0
        for value, mode in (("sl", "slm"), ("tp", "tpm"), ("ts", "tsm"), ("ta", "tam"), ("be", "bem"), ("beb", "bebm"), ("mab", "mabm")):
            if values[value] is not None and values[mode] is None:
                values[mode] = "absolute"
        rows.append(f"SELECT {k} AS k, " + ", ".join(f"{_sql(c, v)} AS {c}" for c, v in values.items()))
    return " UNION ALL ".join(rows)


def _dist(value: str, mode: str, atr: str) -> str:
    return f"CASE WHEN {mode} = 'absolute' THEN {value} WHEN {mode} = 'atr' THEN {value} * {atr} END"


def machine(feed: str = "feed", config: str = "cfg") -> str:
    """CTEs ``steps`` (one row per run, pair and bar) and ``trades``.

    ``feed(k, pair, i, ts, o, h, l, c, sig, atr, chatr, ma)``: bars with the signal,
    the two live ATRs and the followed average of run k.
    """
    uses_atr = "(" + " OR ".join(f"coalesce({m} = 'atr', false)" for m in ("slm", "tpm", "tsm", "tam", "bem", "bebm", "mabm")) + ")"
    needs_atr = "(" + " OR ".join(f"coalesce({m} = 'atr', false)" for m in ("slm", "tpm", "tam", "bem", "bebm")) + ")"
    return f"""walk AS MATERIALIZED (
  SELECT *, lag(sig) OVER w AS psig, lag(atr) OVER w AS patr, lag(ma) OVER w AS pma, max(i) OVER (PARTITION BY k, pair) AS last_i
  FROM {feed} WINDOW w AS (PARTITION BY k, pair ORDER BY i)),
steps AS (
  SELECT w.k, w.pair, w.i, c.cap0 AS capital, 0 AS s, 0::DOUBLE AS entry, NULL::DOUBLE AS stop, NULL::DOUBLE AS target,
         NULL::DOUBLE AS atr_e, NULL::DOUBLE AS trail, NULL::DOUBLE AS trail0, NULL::DOUBLE AS even, NULL::DOUBLE AS mastop,
         NULL::DOUBLE AS mastop0, NULL::DOUBLE AS peak, 0::DOUBLE AS size, NULL::DOUBLE AS cap_before, NULL::DOUBLE AS risk,
         NULL::DOUBLE AS gap, NULL::BIGINT AS entry_i, false AS x1, NULL::DOUBLE AS x1_price, NULL::DOUBLE AS x1_after,
         false AS x2, NULL::DOUBLE AS x2_price, NULL::VARCHAR AS x2_reason, NULL::DOUBLE AS x2_after,
         {{'s': 0, 'entry': 0::DOUBLE, 'stop': NULL::DOUBLE, 'target': NULL::DOUBLE, 'atr_e': NULL::DOUBLE, 'trail': NULL::DOUBLE,
           'trail0': NULL::DOUBLE, 'even': NULL::DOUBLE, 'mastop': NULL::DOUBLE, 'mastop0': NULL::DOUBLE, 'size': NULL::DOUBLE,
           'cap_before': NULL::DOUBLE, 'risk': NULL::DOUBLE, 'gap': NULL::DOUBLE, 'entry_i': NULL::BIGINT}} AS p1,
         {{'s': 0, 'entry': 0::DOUBLE, 'stop': NULL::DOUBLE, 'target': NULL::DOUBLE, 'atr_e': NULL::DOUBLE, 'trail': NULL::DOUBLE,
           'trail0': NULL::DOUBLE, 'even': NULL::DOUBLE, 'mastop': NULL::DOUBLE, 'mastop0': NULL::DOUBLE, 'size': NULL::DOUBLE,
           'cap_before': NULL::DOUBLE, 'risk': NULL::DOUBLE, 'gap': NULL::DOUBLE, 'entry_i': NULL::BIGINT}} AS p2
  FROM walk w JOIN {config} c USING (k) WHERE w.i = 0
  UNION ALL
  SELECT k, pair, i, CASE WHEN x2 THEN x2_after ELSE capital END, CASE WHEN x2 THEN 0 ELSE s END, entry, stop, target, atr_e,
         CASE WHEN x2 THEN NULL ELSE trail_new END, CASE WHEN x2 THEN NULL ELSE trail0_new END,
         CASE WHEN x2 THEN NULL ELSE even_new END, CASE WHEN x2 THEN NULL ELSE mastop_new END,
         CASE WHEN x2 THEN NULL ELSE mastop0_new END, CASE WHEN x2 THEN NULL ELSE peak_new END, size, cap_before, risk, gap, entry_i,
         x1, x1_price, x1_after, x2, x2_price, x2_reason, x2_after, p1, p2
  FROM (SELECT *,
      greatest(trail, trail_move) AS trail_new, coalesce(trail0, trail_move) AS trail0_new
    FROM (SELECT *,
        greatest(mastop, ma_move) AS mastop_new, coalesce(mastop0, ma_move) AS mastop0_new,
        CASE WHEN trails AND (ta IS NULL OR peak_new >= entry + ta_d) THEN
          CASE WHEN ttype = 'chandelier' THEN peak_new - chm * chatr ELSE s * c - ts_d END END AS trail_move,
        {{'s': s, 'entry': entry, 'stop': stop, 'target': target, 'atr_e': atr_e, 'trail': trail, 'trail0': trail0, 'even': even,
          'mastop': mastop, 'mastop0': mastop0, 'size': size, 'cap_before': cap_before, 'risk': risk, 'gap': gap, 'entry_i': entry_i}} AS p2,
        CASE WHEN x2 THEN capital + (x2_price - entry) * size - fee END AS x2_after
      FROM (SELECT *,
          CASE WHEN stop_hit THEN tight ELSE target END - spread / 2 - slip AS x2_price,
          CASE WHEN NOT stop_hit THEN 'take_profit' WHEN stop = tight THEN 'stop_loss' WHEN even = tight THEN 'break_even'
               WHEN mastop = tight THEN 'ma_stop' WHEN ttype = 'chandelier' THEN 'chandelier_trailing_stop' ELSE 'trailing_stop' END AS x2_reason,
          (s <> 0 AND (stop_hit OR take_hit)) AS x2,
          CASE WHEN s <> 0 THEN greatest(peak, best) END AS peak_new,
          CASE WHEN s <> 0 THEN coalesce(even, CASE WHEN greatest(peak, best) >= entry + be_d THEN entry + beb_d END) END AS even_new,
          CASE WHEN mas AND s <> 0 THEN s * ma - mab_d END AS ma_move
        FROM (SELECT *,
            coalesce(worst <= tight, false) AS stop_hit, coalesce(best >= target, false) AS take_hit
          FROM (SELECT *,
              greatest(stop, even, mastop, trail) AS tight,
              CASE WHEN s > 0 THEN l ELSE -h END AS worst, CASE WHEN s > 0 THEN h ELSE -l END AS best,
              {_dist('be', 'bem', 'atr_e')} AS be_d, {_dist('beb', 'bebm', 'atr_e')} AS beb_d, {_dist('ta', 'tam', 'atr_e')} AS ta_d,
              {_dist('ts', 'tsm', 'atr')} AS ts_d, {_dist('mab', 'mabm', 'atr')} AS mab_d
            FROM (SELECT k, pair, i, o, h, l, c, atr, chatr, ma, capital1 AS capital, x1, x1_price, x1_after, p1,
                spread, slip, fee, ttype, ta, tam, ts, tsm, chm, be, bem, beb, bebm, mas, mab, mabm, trails,
                CASE WHEN enters THEN want WHEN x1 THEN 0 ELSE s END AS s,
                CASE WHEN enters THEN entry2 ELSE entry END AS entry,
                CASE WHEN enters THEN stop2 WHEN x1 THEN NULL ELSE stop END AS stop,
                CASE WHEN enters THEN target2 WHEN x1 THEN NULL ELSE target END AS target,
                CASE WHEN enters THEN atr_e2 WHEN x1 THEN NULL ELSE atr_e END AS atr_e,
                CASE WHEN enters OR x1 THEN NULL ELSE trail END AS trail, CASE WHEN enters OR x1 THEN NULL ELSE trail0 END AS trail0,
                CASE WHEN enters OR x1 THEN NULL ELSE even END AS even,
                CASE WHEN enters THEN ma2 WHEN x1 THEN NULL ELSE mastop END AS mastop,
                CASE WHEN enters THEN ma2 WHEN x1 THEN NULL ELSE mastop0 END AS mastop0,
                CASE WHEN enters OR x1 THEN NULL ELSE peak END AS peak,
                CASE WHEN enters THEN size2 ELSE size END AS size,
                CASE WHEN enters THEN capital1 ELSE cap_before END AS cap_before,
                CASE WHEN enters THEN risk2 ELSE risk END AS risk,
                CASE WHEN enters THEN gap2 ELSE gap END AS gap,
                CASE WHEN enters THEN i ELSE entry_i END AS entry_i
              FROM (SELECT *,
                  CASE WHEN mode = 'fixed' THEN gap2 * fsize ELSE capital1 * riskp END AS risk2,
                  CASE WHEN mode = 'fixed' THEN fsize ELSE capital1 * riskp / gap2 END AS size2,
                  coalesce((s = 0 OR x1) AND want <> 0 AND (CASE WHEN want > 0 THEN longs ELSE shorts END)
                    AND (NOT {needs_atr} OR patr IS NOT NULL) AND (NOT mas OR pma IS NOT NULL)
                    AND (mode = 'fixed' OR (gap2 IS NOT NULL AND capital1 > 0)), false) AS enters
                FROM (SELECT *, CASE WHEN abs(entry2 - greatest(stop2, ma2)) > 0 THEN abs(entry2 - greatest(stop2, ma2)) END AS gap2
                  FROM (SELECT *,
                      entry2 - ({_dist('sl', 'slm', 'patr')}) AS stop2, entry2 + ({_dist('tp', 'tpm', 'patr')}) AS target2,
                      CASE WHEN mode = 'risk_percent' AND mas THEN want * pma - ({_dist('mab', 'mabm', 'patr')}) END AS ma2,
                      CASE WHEN {uses_atr} THEN patr END AS atr_e2,
                      CASE WHEN x1 THEN x1_after ELSE capital END AS capital1
                    FROM (SELECT *, want * o + spread / 2 + slip AS entry2,
                        CASE WHEN x1 THEN capital + (x1_price - entry) * size - fee END AS x1_after
                      FROM (SELECT c.*, q.k AS qk, b.pair, b.i, b.o, b.h, b.l, b.c, b.atr, b.chatr, b.ma, b.psig, b.patr, b.pma,
                          q.capital, q.s, q.entry, q.stop, q.target, q.atr_e, q.trail, q.trail0, q.even, q.mastop, q.mastop0, q.peak,
                          q.size, q.cap_before, q.risk, q.gap, q.entry_i,
                          sign(b.psig)::INT AS want, (q.s <> 0 AND q.s * b.psig < 0) AS x1,
                          q.s * b.o - c.spread / 2 - c.slip AS x1_price,
                          CASE WHEN c.ttype = 'standard' THEN c.ts IS NOT NULL ELSE c.chm IS NOT NULL END AS trails,
                          {{'s': q.s, 'entry': q.entry, 'stop': q.stop, 'target': q.target, 'atr_e': q.atr_e, 'trail': q.trail,
                            'trail0': q.trail0, 'even': q.even, 'mastop': q.mastop, 'mastop0': q.mastop0, 'size': q.size,
                            'cap_before': q.cap_before, 'risk': q.risk, 'gap': q.gap, 'entry_i': q.entry_i}} AS p1
                        FROM steps q JOIN walk b ON b.k = q.k AND b.pair = q.pair AND b.i = q.i + 1 JOIN {config} c ON c.k = q.k)))))))))))),
closed AS (
  SELECT k, pair, i AS exit_i, 1 AS part, x1_price AS exit_s, 'signal_exit' AS reason, x1_after AS cap_after, p1 AS p FROM steps WHERE x1
  UNION ALL
  SELECT k, pair, i, 2, x2_price, x2_reason, x2_after, p2 FROM steps WHERE x2
  UNION ALL
  SELECT q.k, q.pair, q.i, 3, q.s * b.c - c.spread / 2 - c.slip, 'forced_end',
         q.capital + (q.s * b.c - c.spread / 2 - c.slip - q.entry) * q.size - c.fee,
         {{'s': q.s, 'entry': q.entry, 'stop': q.stop, 'target': q.target, 'atr_e': q.atr_e, 'trail': q.trail, 'trail0': q.trail0,
           'even': q.even, 'mastop': q.mastop, 'mastop0': q.mastop0, 'size': q.size, 'cap_before': q.cap_before, 'risk': q.risk,
           'gap': q.gap, 'entry_i': q.entry_i}}
  FROM steps q JOIN walk b ON b.k = q.k AND b.pair = q.pair AND b.i = q.i JOIN {config} c ON c.k = q.k
  WHERE q.i = b.last_i AND q.s <> 0),
trades AS (
  SELECT x.k, x.pair, row_number() OVER (PARTITION BY x.k, x.pair ORDER BY exit_i, part) AS trade_no,
         CASE WHEN p.s > 0 THEN 'long' ELSE 'short' END AS side, p.s AS s, p.entry_i AS entry_index, exit_i AS exit_index,
         en.ts AS entry_ts, ex.ts AS exit_ts, p.s * p.entry AS entry_price, p.s * exit_s AS exit_price, p.s * p.stop AS stop_loss,
         p.s * p.target AS take_profit, p.size AS size, p.cap_before AS capital_before, cap_after AS capital_after,
         p.risk AS risk_amount, p.gap AS stop_distance, p.atr_e AS atr_at_entry, p.s * p.trail0 AS trail_initial,
         p.s * p.trail AS trail_final, p.s * p.even AS break_even_price, p.s * p.mastop0 AS ma_initial, p.s * p.mastop AS ma_final,
         reason, exit_i - p.entry_i AS duration, (exit_s - p.entry) * p.size AS gross, (exit_s - p.entry) * p.size - c.fee AS net
  FROM closed x JOIN {config} c ON c.k = x.k
  JOIN walk en ON en.k = x.k AND en.pair = x.pair AND en.i = p.entry_i
  JOIN walk ex ON ex.k = x.k AND ex.pair = x.pair AND ex.i = x.exit_i)"""


def equity() -> str:
    """CTE ``equity(k, pair, i, ts, equity, capital, side)`` after ``machine()``."""
    return """equity AS (
  SELECT q.k, q.pair, q.i, b.ts,
    CASE WHEN f.cap_after IS NOT NULL THEN f.cap_after WHEN q.s <> 0 THEN q.capital + (q.s * b.c - q.entry) * q.size ELSE q.capital END AS equity,
    coalesce(f.cap_after, q.capital) AS capital,
    CASE WHEN f.cap_after IS NOT NULL OR q.s = 0 THEN 'flat' WHEN q.s > 0 THEN 'long' ELSE 'short' END AS side
  FROM steps q JOIN walk b ON b.k = q.k AND b.pair = q.pair AND b.i = q.i
  LEFT JOIN (SELECT k, pair, exit_i, cap_after FROM closed WHERE part = 3) f ON f.k = q.k AND f.pair = q.pair AND f.exit_i = q.i
  WHERE q.i >= 1)"""


EXITS = {
    "stop_loss": "stop_loss_exits", "trailing_stop": "trailing_stop_exits", "chandelier_trailing_stop": "chandelier_trailing_exits",
    "break_even": "break_even_exits", "ma_stop": "ma_stop_exits", "take_profit": "take_profit_exits",
    "signal_exit": "signal_exits", "forced_end": "forced_end_exits",
}


def metrics(config: str = "cfg") -> str:
    """CTE ``metrics`` per (k, pair) after ``machine()`` and ``equity()``."""
    counts = ", ".join(f"count(*) FILTER (reason = '{r}') AS {c}" for r, c in EXITS.items())
    return f"""totals AS (
  SELECT k, pair, count(*) AS total_trades, sum(gross) AS gross_pnl, sum(net) AS net_pnl, count(*) FILTER (net > 0) AS wins,
    avg(net) FILTER (net > 0) AS average_win, avg(net) FILTER (net < 0) AS average_loss,
    coalesce(sum(net) FILTER (net > 0), 0) AS profit, abs(coalesce(sum(net) FILTER (net < 0), 0)) AS loss,
    avg(duration) AS dur, avg(risk_amount) AS risk, avg(size) AS size, count(*) FILTER (side = 'long') AS long_trades_count,
    count(*) FILTER (side = 'short') AS short_trades_count, {counts} FROM trades GROUP BY 1, 2),
falls AS (
  SELECT k, pair, min(equity - peak) AS dd, min(equity / nullif(peak, 0) - 1) AS ddp, arg_max(equity, i) AS ending, arg_max(capital, i) AS final
  FROM (SELECT *, max(equity) OVER (PARTITION BY k, pair ORDER BY i ROWS UNBOUNDED PRECEDING) AS peak FROM equity) GROUP BY 1, 2),
metrics AS (
  SELECT f.k, f.pair, c.cap0 AS initial_capital, f.final AS final_capital,
    CASE WHEN t.k IS NULL THEN 0 ELSE (f.final - c.cap0) / c.cap0 * 100 END AS total_return_pct,
    coalesce(total_trades, 0) AS total_trades, coalesce(gross_pnl, 0) AS gross_pnl, coalesce(net_pnl, 0) AS net_pnl,
    coalesce(wins / total_trades, 0) AS win_rate, coalesce(average_win, 0) AS average_win, coalesce(average_loss, 0) AS average_loss,
    CASE WHEN loss > 0 THEN profit / loss WHEN profit > 0 THEN 'inf'::DOUBLE ELSE 0 END AS profit_factor,
    coalesce(net_pnl / total_trades, 0) AS expectancy, CASE WHEN t.k IS NULL THEN 0 ELSE dd END AS max_drawdown,
    CASE WHEN t.k IS NULL THEN 0 ELSE ddp END AS max_drawdown_pct, f.ending AS ending_equity,
    coalesce(dur, 0) AS average_trade_duration_bars, coalesce(risk, 0) AS average_risk_amount,
    coalesce(t.size, 0) AS average_position_size_used, coalesce(long_trades_count, 0) AS long_trades_count,
    coalesce(short_trades_count, 0) AS short_trades_count, {', '.join(f'coalesce({c}, 0) AS {c}' for c in EXITS.values())}
  FROM falls f JOIN {config} c ON c.k = f.k LEFT JOIN totals t ON t.k = f.k AND t.pair = f.pair)"""

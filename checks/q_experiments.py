"""The parameter matrix on a small grid of rules, over all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.functions.indicators import with_indicators
from barlab.plans.experiments import (
    DEFAULT_SETTINGS,
    EXIT_PROFILES,
    RESULT_COLUMNS,
    TRAILING_PROFILES,
    by_merge,
    distinct_rules,
    experiment_matrix,
    flatten_results,
    in_matrix_order,
    progress,
    resume,
    run_matrix,
    signal_key,
    slices,
    split_complete,
)
from barlab.session import materialize
from barlab.sources.results import save_book
from checks import duck_sql as D
from checks.feeds import bars, derived, kept, scratch, table
from checks.registry import query, r

GRID = dict(
    periods_2=[(3, 8), (5, 12)], types_2=[("sma", "ema"), ("wma", "sma")], periods_3=[(3, 5, 9)], types_3=[("ema", "sma", "wma")],
    settings=dict(spread=0.02, slippage=0.01, initial_capital=1000.0),
)
PROFILES = ["fixed2040", "atr12", "atr_trailing", "atr_trailing_be", "atr_ma_stop"]
ENTRIES = ["crossover", "crossover_breakout", "price_above_all"]


def _series(spark, sf):
    """One series per supplier: the matrix grows with the table."""
    return table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("pair"), F.lit("1h").alias("timeframe"))


def _matrix(spark, sf, **changes):
    return experiment_matrix(_series(spark, sf), **{"exit_profiles": PROFILES, **GRID, **changes})


def _event_matrix(spark, sf, profiles):
    """The same rules for the pairs that have bars."""
    series = bars(spark, sf, "1h").select("pair", "timeframe").distinct()
    return experiment_matrix(series, exit_profiles=profiles, **GRID)


def rules() -> list[tuple[tuple, tuple, str]]:
    found = [(p, t, e) for p in GRID["periods_2"] for t in GRID["types_2"] for e in ENTRIES]
    return found + [(p, t, e) for p in GRID["periods_3"] for t in GRID["types_3"] for e in ENTRIES if e != "crossover"]


def variants(profiles: list[str]) -> list[tuple[str, str | None]]:
    return [(p, v) for p in profiles for v in (("standard", "chandelier") if p in TRAILING_PROFILES else (None,))]


SUPPLIERS = "SELECT 'S' || s_suppkey AS pair FROM supplier"


def matrix_sql(profiles: list[str] = PROFILES, series: str = SUPPLIERS) -> str:
    """One row per rule and exit, as text."""
    rules_sql = ", ".join(f"('{','.join(map(str, p))}', '{','.join(t)}', '{e}')" for p, t, e in rules())
    exits_sql = ", ".join(f"('{p}', {'NULL' if v is None else repr(v)})" for p, v in variants(profiles))
    return f"""SELECT pair, '1h' AS timeframe, ma_periods, ma_types, entry_type, exit_profile, trailing_type_variant FROM ({series})
    CROSS JOIN (VALUES {rules_sql}) a(ma_periods, ma_types, entry_type) CROSS JOIN (VALUES {exits_sql}) b(exit_profile, trailing_type_variant)"""


MATRIX_KEY = ["pair", "timeframe", "ma_periods", "ma_types", "entry_type", "exit_profile", "trailing_type_variant"]


@query("h1_matrix", matrix_sql())
def h1(spark, sf):
    return _matrix(spark, sf).select(*MATRIX_KEY)


@query("h1_default_size", f"SELECT pair, timeframe, 873 AS runs, 873 AS hashes FROM ({SUPPLIERS}), (VALUES ('1h'), ('1d')) t(timeframe)")
def h1_default(spark, sf):
    """The default matrix: runs per series."""
    series = _series(spark, sf).select("pair", F.explode(F.array(F.lit("1h"), F.lit("1d"))).alias("timeframe"))
    return experiment_matrix(series).groupBy("pair", "timeframe").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("config_hash").alias("hashes"))


@query(
    "h1_selection",
    f"""SELECT pair, timeframe, 873 AS runs FROM (SELECT DISTINCT pair FROM ({SUPPLIERS})), (VALUES ('1d')) t(timeframe)
    WHERE pair IN (SELECT min(pair) FROM ({SUPPLIERS}) UNION ALL SELECT max(pair) FROM ({SUPPLIERS}))""",
)
def h1_selection(spark, sf):
    """Two pairs and one timeframe asked for in another case."""
    series = _series(spark, sf).select("pair", F.explode(F.array(F.lit("1h"), F.lit("1d"))).alias("timeframe"))
    ends = series.agg(F.min("pair"), F.max("pair")).first()
    chosen = experiment_matrix(series, pairs=[name.swapcase() for name in ends], timeframes=["1D"])
    return chosen.groupBy("pair", "timeframe").agg(F.count(F.lit(1)).alias("runs"))


def _profile_sql() -> str:
    rows = []
    for name, variant in variants(list(EXIT_PROFILES)):
        profile = EXIT_PROFILES[name]
        if not profile:
            continue
        trail = None if variant == "chandelier" else profile.get("trailing_stop")
        values = [
            f"'{name}'", repr(variant) if variant else "NULL", profile["stop_loss"], profile["take_profit"], f"'{profile['stop_loss_mode']}'",
            trail if trail is not None else "NULL", 1.5 if variant == "chandelier" else "NULL",
            profile.get("break_even", "NULL"), profile.get("break_even_buffer", "NULL"), str(bool(profile.get("ma_stop"))).lower(),
            profile.get("ma_stop_buffer", "NULL"),
        ]
        rows.append("(" + ", ".join(str(v) for v in values) + ")")
    columns = "exit_profile, trailing_type_variant, stop_loss, take_profit, mode, trailing_stop, multiplier, break_even, break_even_buffer, ma_stop, ma_stop_buffer"
    shown = ", ".join(f"{r(c + '::DOUBLE')} AS {c}" for c in ("stop_loss", "take_profit", "trailing_stop", "multiplier", "break_even", "break_even_buffer", "ma_stop_buffer"))
    return f"""SELECT pair, exit_profile, trailing_type_variant, mode, ma_stop, {shown} FROM ({SUPPLIERS}) CROSS JOIN (VALUES {', '.join(rows)}) v({columns})"""


@query("h3_exit_profiles", _profile_sql())
def h3(spark, sf):
    matrix = experiment_matrix(_series(spark, sf), exit_profiles=list(EXIT_PROFILES), **GRID)
    return matrix.select(
        "pair", "exit_profile", "trailing_type_variant", F.col("stop_loss_mode").alias("mode"), "ma_stop", "stop_loss", "take_profit",
        "trailing_stop", F.col("chandelier_multiplier").alias("multiplier"), "break_even", "break_even_buffer", "ma_stop_buffer",
    ).distinct()


@query("h4_config_hash", f"SELECT pair, count(*) AS runs, count(*) AS hashes, 0 AS shared_with_next_version, 40 AS digits FROM ({matrix_sql()}) GROUP BY pair")
def h4(spark, sf):
    """Distinct per config; a new version changes every hash."""
    first, second = _matrix(spark, sf), _matrix(spark, sf, version="v2")
    shared = first.join(by_merge(second.select("config_hash", F.lit(1).alias("hit"))), "config_hash", "left")
    return shared.groupBy("pair").agg(
        F.count(F.lit(1)).alias("runs"), F.count_distinct("config_hash").alias("hashes"), F.count("hit").alias("shared_with_next_version"),
        F.max(F.length("config_hash")).alias("digits"),
    )


@query("h5_slices", f"SELECT pair, timeframe, '2019-01-01' AS start_date, '2025-12-31' AS end_date, count(*) AS runs FROM ({matrix_sql()}) GROUP BY 1, 2")
def h5(spark, sf):
    return slices(_matrix(spark, sf))


# Completed: everything on profile atr12; failed: breakout entries on fixed2040.
_DONE, _FAILED = "exit_profile = 'atr12'", "exit_profile = 'fixed2040' AND entry_type = 'crossover_breakout'"


def _attempted(spark, sf):
    matrix = _matrix(spark, sf)
    stale = _matrix(spark, sf, version="v0")
    return matrix, matrix.where(_DONE).select("config_hash").union(stale.select("config_hash")), matrix.where(_FAILED).select("config_hash")


@query("h6_progress", f"""SELECT count(*) AS total, count(*) FILTER ({_DONE}) AS completed, count(*) FILTER ({_FAILED}) AS failed,
  count(*) FILTER (NOT ({_DONE}) AND NOT ({_FAILED})) AS pending FROM ({matrix_sql()})""")
def h6_progress(spark, sf):
    return progress(*_attempted(spark, sf))


@query("h6_pending", f"SELECT * FROM ({matrix_sql()}) WHERE NOT ({_DONE}) AND NOT ({_FAILED})")
def h6_pending(spark, sf):
    return resume(*_attempted(spark, sf)).select(*MATRIX_KEY)


@query(
    "h7_first_pending",
    f"""SELECT pair, timeframe, ma_periods, ma_types, entry_type, exit_profile, trailing_type_variant FROM ({matrix_sql()}) WHERE NOT ({_DONE}) AND NOT ({_FAILED})
    ORDER BY pair, len(string_split(ma_periods, ',')), list_transform(string_split(ma_periods, ','), lambda x: x::INT), string_split(ma_types, ','), entry_type,
    list_position({PROFILES}, exit_profile), trailing_type_variant NULLS FIRST LIMIT 40""",
)
def h7(spark, sf):
    return resume(*_attempted(spark, sf), max_runs=40).select(*MATRIX_KEY)


# --- signals of every rule, then full results ---
def _ma(kind: str, n: int) -> str:
    return f"{kind}_{n}"


_AVERAGES = sorted({(k, n) for p, t, _ in rules() for k, n in zip(t, p)})
_EMAS = [(k, n) for k, n in _AVERAGES if k == "ema"]


def _signal_sql(periods, types, entry) -> str:
    """Signal of one rule over ``mas`` (current and previous values)."""
    names = [_ma(k, n) for n, k in sorted(zip(periods, types), key=lambda x: x[0])]
    fast, slow = names[0], names[-1]
    above = lambda p, c: "(" + " AND ".join(f"{c} > {p}{m}" for m in names) + ")"
    below = lambda p, c: "(" + " AND ".join(f"{c} < {p}{m}" for m in names) + ")"
    up, down = f"({fast} > {slow} AND p_{fast} <= p_{slow})", f"({fast} < {slow} AND p_{fast} >= p_{slow})"
    if entry == "price_above_all":
        up = f"(coalesce({above('', 'c')}, false) AND NOT coalesce({above('p_', 'p_c')}, false))"
        down = f"(coalesce({below('', 'c')}, false) AND NOT coalesce({below('p_', 'p_c')}, false))"
    elif entry == "crossover_breakout":
        up, down = f"({up} AND {above('', 'c')})", f"({down} AND {below('', 'c')})"
    return f"CASE WHEN coalesce({up}, false) THEN 1 WHEN coalesce({down}, false) THEN -1 ELSE 0 END"


def _rule_name(periods, types, entry) -> str:
    return f"{','.join(types)}|{','.join(map(str, periods))}|{entry}|true|true"


_WIDE = ", ".join(
    f"{D.sma('c', n) if k == 'sma' else D.wma('c', n)} AS {_ma(k, n)}" for k, n in _AVERAGES if k != "ema"
)
MAS = f"""WITH RECURSIVE {D.event_bars('1h')}, tr AS (SELECT *, {D.true_range()} AS tr FROM bars),
{D.recurrence('rc', 'bars', 'c', [(f'e{n}', 'ema', n) for _, n in _EMAS])},
{D.recurrence('rt', 'tr', 'tr', [('w14', 'wilder', 14)])},
wide AS (SELECT *, {_WIDE} FROM bars),
now AS (SELECT w.*, CASE WHEN w.i >= 13 THEN w14 END AS atr, {', '.join(f'CASE WHEN w.i >= {n - 1} THEN e{n} END AS {_ma(k, n)}' for k, n in _EMAS)} FROM wide w JOIN rc USING (pair, i) JOIN rt USING (pair, i)),
mas AS (SELECT *, lag(c) OVER w AS p_c, {', '.join(f'lag({_ma(k, n)}) OVER w AS p_{_ma(k, n)}' for k, n in _AVERAGES)} FROM now WINDOW w AS (PARTITION BY pair ORDER BY i)),
ruled AS ({' UNION ALL '.join(f"SELECT '{_rule_name(*rule)}' AS rule, *, {_signal_sql(*rule)} AS sig, {_ma(*min(zip(rule[0], rule[1]))[::-1])} AS fast FROM mas" for rule in rules())})"""


@query("h8_shared_signals", MAS + f" SELECT rule AS signal_key, pair, {D.stamp('ts')} AS timestamp, sig AS signal FROM ruled WHERE sig <> 0")
def h8(spark, sf):
    """One signal set per distinct rule, whatever the number of runs that use it."""
    distinct = distinct_rules(_event_matrix(spark, sf, PROFILES))
    averages = [a for rule in distinct.values() for a in rule.averages]
    frame = with_indicators(bars(spark, sf, "1h"), averages)
    tested = F.array(*[F.struct(F.lit(key).alias("signal_key"), rule.signal().alias("signal")) for key, rule in distinct.items()])
    return frame.select("pair", "timestamp", F.inline(F.filter(tested, lambda s: s["signal"] != 0))).select("signal_key", "pair", "timestamp", "signal")


RESULT_PROFILES = ["atr12", "atr_trailing", "atr_ma_stop"]


def _result_runs(profiles: list[str]) -> list[tuple]:
    return [(rule, profile, variant) for rule in rules() for profile, variant in variants(profiles)]


def _result_sql(tail: str, profiles: list[str] = RESULT_PROFILES) -> str:
    settings, feeds, names = [], [], []
    for k, (rule, profile, variant) in enumerate(_result_runs(profiles)):
        run = {**DEFAULT_SETTINGS, **GRID["settings"], **EXIT_PROFILES[profile]}
        if variant == "chandelier":
            run.pop("trailing_stop"), run.pop("trailing_stop_mode")
            run.update(trailing_type="chandelier", chandelier_multiplier=1.5)
        settings.append(run)
        names.append(f"({k}, '{_rule_name(*rule)}', '{profile}', {repr(variant) if variant else 'NULL'})")
    return f"""{MAS}, ids AS (SELECT * FROM (VALUES {', '.join(names)}) v(k, rule, exit_profile, variant)),
    cfg AS ({D.config_rows(settings)}),
    feed AS (SELECT k, pair, i, ts, o, h, l, c, sig, atr, atr AS chatr, fast AS ma FROM ids JOIN ruled USING (rule)),
    {D.machine()}, {D.equity()}, {D.metrics()} {tail}"""


NUMBERS = ["final_capital", "total_return_pct", "gross_pnl", "net_pnl", "win_rate", "profit_factor", "max_drawdown", "max_drawdown_pct", "average_risk_amount"]
INTEGERS = ["total_trades", "long_trades_count", "stop_loss_exits", "trailing_stop_exits", "chandelier_trailing_exits", "ma_stop_exits", "take_profit_exits", "signal_exits", "forced_end_exits"]


def _results(spark, sf):
    def build():
        book = run_matrix(bars(spark, sf, "1h"), _event_matrix(spark, sf, RESULT_PROFILES))
        return materialize(flatten_results(book), "results")

    return kept(spark, sf, "matrix-results", build)


@query(
    "h9_result_rows",
    _result_sql(f"""SELECT pair, split_part(rule, '|', 1) AS ma_types, split_part(rule, '|', 2) AS ma_periods, split_part(rule, '|', 3) AS entry_type, exit_profile,
    coalesce(variant, 'standard') AS trailing_type, {', '.join(f'{r(c)} AS {c}' for c in NUMBERS)}, {', '.join(INTEGERS)} FROM metrics JOIN ids USING (k)"""),
)
def h9(spark, sf):
    rows = _results(spark, sf)
    assert rows.columns == RESULT_COLUMNS and len(rows.columns) == 74
    return rows.select("pair", "ma_types", "ma_periods", "entry_type", "exit_profile", "trailing_type", *NUMBERS, *INTEGERS)


@query(
    "a15_matrix_signals",
    _result_sql(
        f"""SELECT pair, rule AS signal_key, count(*) AS signals, CAST(sum(sig) AS BIGINT) AS balance, {D.stamp('min(ts)')} AS first_at
        FROM ruled WHERE sig <> 0 GROUP BY 1, 2""",
        ["atr12"],
    ),
)
def a15_signals(spark, sf):
    """Signals of a matrix book, stored once per rule and series and read back."""
    root = scratch(spark)
    save_book(run_matrix(bars(spark, sf, "1h"), _event_matrix(spark, sf, ["atr12"])), root)
    return spark.read.parquet(f"{root}/signals").groupBy("pair", "signal_key").agg(
        F.count(F.lit(1)).alias("signals"), F.sum("signal").alias("balance"), F.date_format(F.min("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("first_at")
    )


_DERIVED = "SELECT o_orderkey AS key, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_totalprice END AS net, CASE WHEN o_custkey % 15 = 0 THEN NULL ELSE 1.5 END AS pf FROM orders"


@query(
    "h10_required_metrics",
    f"""SELECT key::VARCHAR AS config_hash, CASE WHEN net IS NULL OR pf IS NULL THEN 'missing required metrics: ' || concat_ws(', ', CASE WHEN net IS NULL THEN 'net_pnl' END, CASE WHEN pf IS NULL THEN 'profit_factor' END) END AS error FROM ({_DERIVED})""",
)
def h10(spark, sf):
    rows = derived(spark, sf, _DERIVED, "orders").select(
        F.col("key").cast("string").alias("config_hash"), F.lit("{}").alias("config_json"), F.lit(1).alias("total_trades"),
        F.col("net").alias("net_pnl"), F.col("pf").alias("profit_factor"), F.lit(0.0).alias("max_drawdown"),
    )
    complete, failed = split_complete(rows)
    return complete.select("config_hash", F.lit(None).cast("string").alias("error")).unionByName(failed.select("config_hash", "error"))


@query(
    "h11_failure_isolation",
    f"""SELECT pair, count(*) FILTER (entry_type <> 'crossover_breakout') AS completed, count(*) FILTER (entry_type = 'crossover_breakout') AS failed
    FROM ({matrix_sql(['atr12'], 'SELECT DISTINCT event_type AS pair FROM events')}) GROUP BY pair""",
)
def h11(spark, sf):
    """Broken configs among good ones: logged, and the rest still run."""
    matrix = _event_matrix(spark, sf, ["atr12"]).withColumn(
        "stop_loss", F.when(F.col("entry_type") == "crossover_breakout", F.lit(-1.0)).otherwise(F.col("stop_loss"))
    )
    book = run_matrix(bars(spark, sf, "1h"), matrix)
    done = book.metrics.groupBy("pair").agg(F.count(F.lit(1)).alias("completed"))
    broken = book.rejected.where("error IS NOT NULL").groupBy("pair").agg(F.count(F.lit(1)).alias("failed"))
    return done.join(broken, "pair").select("pair", "completed", "failed")


# Windows per config: two that hold bars and one that holds none; dates alone mean whole days.
# Capital compounds to five digits before the point: four after it are certain on both sides.
WINDOWED_PROFILES = ["atr12", "atr_ma_stop"]
WINDOWS = [("2024-01-03", "2024-01-14"), ("2024-01-10 06:00:00", "2024-01-26"), ("2031-01-01", "2031-12-31")]
_WINDOWED = f"""{D.event_bars('1h', 'all_bars')}, windows AS (SELECT * FROM (VALUES
    ('{WINDOWS[0][0]}', '{WINDOWS[0][1]}', TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-15'), ('{WINDOWS[1][0]}', '{WINDOWS[1][1]}', TIMESTAMP '2024-01-10 06:00:00', TIMESTAMP '2024-01-27'))
    v(start_date, end_date, low, high)),
  bars AS MATERIALIZED (SELECT pair || '@' || start_date || '@' || end_date AS pair, ts, o, h, l, c, n, row_number() OVER (PARTITION BY pair, start_date ORDER BY ts) - 1 AS i
    FROM all_bars JOIN windows ON ts >= low AND ts < high)"""


def _windowed_sql() -> str:
    shown = f"""SELECT split_part(pair, '@', 1) AS pair, split_part(pair, '@', 2) AS start_date, split_part(pair, '@', 3) AS end_date, split_part(rule, '|', 1) AS ma_types,
    split_part(rule, '|', 2) AS ma_periods, split_part(rule, '|', 3) AS entry_type, exit_profile, coalesce(variant, 'standard') AS trailing_type,
    {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in NUMBERS)}, {', '.join(INTEGERS)} FROM metrics JOIN ids USING (k)"""
    return _result_sql(shown, WINDOWED_PROFILES).replace(D.event_bars("1h"), _WINDOWED, 1)


@query("h5_windowed_runs", _windowed_sql())
def h5_windowed(spark, sf):
    """Runs over their own windows: bars are cut before averages; a window without bars gives no row."""
    series = bars(spark, sf, "1h").select("pair", "timeframe").distinct()
    matrix = None
    for start, end in WINDOWS:
        grid = {**GRID, "settings": {**GRID["settings"], "start_date": start, "end_date": end}}
        part = experiment_matrix(series, exit_profiles=WINDOWED_PROFILES, **grid)
        matrix = part if matrix is None else matrix.unionByName(part)
    rows = flatten_results(run_matrix(bars(spark, sf, "1h"), matrix))
    return rows.select("pair", "start_date", "end_date", "ma_types", "ma_periods", "entry_type", "exit_profile", "trailing_type", *[F.round(c, 4).alias(c) for c in NUMBERS], *INTEGERS)

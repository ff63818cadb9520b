"""Scans, sinks and file choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.plans.build import build_store
from barlab.session import materialize
from barlab.sources.candles import candle_window, outputs_to_build, write_candles
from barlab.sources.catalogue import bar_files, canonical_files, choose_sources, prune_by_year, read_ticks, tick_files, year_window
from barlab.sources.results import (
    append_failures,
    append_results,
    completed_hashes,
    failed_hashes,
    read_results,
    read_trade_log,
    save_book,
    save_shortlist,
    union_results,
)
from barlab.schemas import TIMEFRAMES
from barlab.operators.shortlist import shortlist
from checks import duck_sql as D
from checks.feeds import (
    PATHS,
    RESULTS,
    SOURCE_PAIRS,
    THIS_YEAR,
    bars,
    derived,
    event_ticks,
    line_ticks,
    paths,
    results,
    scratch,
    store,
    table,
    trade_log,
)
from checks.q_bars import LINES
from checks.q_ledger import _machine, _run_name, book
from checks.registry import query, r
from checks.runs import NAMES, TIMEFRAME

PRICES = f"{r('o')} AS open, {r('h')} AS high, {r('l')} AS low, {r('c')} AS close"


@query(
    "a1_candle_scan",
    f"""WITH {D.event_bars('1h')} SELECT pair, '1h' AS timeframe, {D.stamp('ts')} AS timestamp, {PRICES}, n AS tick_count FROM bars
    WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-21 00:00:00'""",
)
def a1(spark, sf):
    """The store's hourly partition, inclusive bounds, date-only end."""
    rows = candle_window(spark.read.parquet(store(spark, sf)), None, "1h", "2024-01-05T06:00:00Z", "2024-01-20")
    return rows.select("pair", "timeframe", "timestamp", "open", "high", "low", "close", "tick_count")


@query("a1_duplicate_check", f"SELECT pair, count(*) AS rows, count(*) - count(DISTINCT ts) AS duplicates FROM ({LINES}) GROUP BY 1")
def a1_duplicates(spark, sf):
    ticks = line_ticks(spark, sf).select("pair", "timestamp")
    return (
        ticks.groupBy("pair", "timestamp").agg(F.count(F.lit(1)).alias("same"))
        .groupBy("pair").agg(F.sum("same").alias("rows"), F.sum(F.col("same") - 1).alias("duplicates"))
    )


# --- file choice on the derived file tree ---
_NAME = r"regexp_extract(path, '([^/]*)$', 1)"
_STEM = f"lower(regexp_replace({_NAME}, '\\.[^.]*$', ''))"
_KNOWN = "CASE " + " ".join(f"WHEN contains(upper(path), '{p}') THEN '{p}'" for p in SOURCE_PAIRS) + " END"
_BAR_TF = "CASE " + " ".join(f"WHEN contains(lower(path), '/{tf}/') OR contains(lower({_NAME}), '_{tf}_') THEN '{tf}'" for tf in TIMEFRAMES) + " END"
_TICKS = f"""SELECT path, regexp_extract(path, '^cleaned_ticks/([^/]+)/', 1) AS pair, 'tick' AS source_timeframe FROM paths
  WHERE starts_with(path, 'cleaned_ticks/') AND path LIKE '%.parquet' AND regexp_extract(path, '^cleaned_ticks/([^/]+)/', 1) IN {tuple(SOURCE_PAIRS)}
  AND NOT contains(lower({_NAME}), 'recent')"""
_BARS = f"""SELECT * FROM (SELECT path, {_KNOWN} AS pair, {_BAR_TF} AS source_timeframe, {_STEM} AS stem FROM paths
  WHERE starts_with(path, 'bars/') AND path LIKE '%.parquet' AND NOT contains(lower({_NAME}), '_raw') AND NOT contains(lower({_NAME}), 'latest'))
  WHERE pair IS NOT NULL AND source_timeframe IS NOT NULL"""
_GRANULAR = "(regexp_matches(stem, '_(201[89]|202[0-9])$') OR suffix(stem, '_2025_now'))"
_CANONICAL = f"""SELECT path, pair, source_timeframe FROM (SELECT *, {_GRANULAR} AS g, bool_or({_GRANULAR}) OVER (PARTITION BY pair, source_timeframe) AS any_g FROM barfiles)
  WHERE (g OR NOT any_g) AND NOT contains(stem, 'recent')"""
TREE = f"WITH paths AS ({PATHS}), tickfiles AS ({_TICKS}), barfiles AS ({_BARS}), canonical AS ({_CANONICAL}) "
RANK = "CASE source_timeframe WHEN 'tick' THEN -1 " + " ".join(f"WHEN '{tf}' THEN {i}" for i, tf in enumerate(TIMEFRAMES)) + " END"


@query("a4_tick_files", TREE + "SELECT pair, path FROM tickfiles")
def a4(spark, sf):
    return tick_files(paths(spark, sf), SOURCE_PAIRS).select("pair", "path")


@query("a4_tick_scan", f"SELECT event_type AS pair, event_id AS seq, {D.stamp('ts')} AS timestamp, {r('value')} AS mid FROM events")
def a4_scan(spark, sf):
    """The tick files of every pair, read recursively in one scan; the same ticks again in files named ``recent`` are left out."""
    root = scratch(spark)
    ticks = event_ticks(spark, sf)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for (pair,) in ticks.select("pair").distinct().collect():
        own = ticks.where(F.col("pair") == pair).drop("pair")
        for part in ("2024/one", "2024/two"):
            own.write.parquet(f"{root}/cleaned_ticks/{pair}/{part}")
        again = path(f"{root}/cleaned_ticks/{pair}/2024/two")
        files = again.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.listStatus(again):
            if status.getPath().getName().endswith(".parquet"):
                files.rename(status.getPath(), path(again, "Recent_" + status.getPath().getName()))
    return read_ticks(spark, root).select("pair", "seq", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "mid")


@query("a5_bar_files", TREE + "SELECT pair, source_timeframe, path FROM barfiles")
def a5(spark, sf):
    return bar_files(paths(spark, sf), SOURCE_PAIRS).select("pair", "source_timeframe", "path")


@query("a6_canonical_files", TREE + "SELECT pair, source_timeframe, path FROM canonical")
def a6(spark, sf):
    return canonical_files(bar_files(paths(spark, sf), SOURCE_PAIRS)).select("pair", "source_timeframe", "path")


_FIRST = "CASE WHEN contains(path, '2025_now') THEN 2025 ELSE list_min(list_transform(regexp_extract_all(path, '20[0-9][0-9]'), lambda x: x::INT)) END"
_LAST = f"CASE WHEN contains(path, '2025_now') THEN {THIS_YEAR + 1} ELSE list_max(list_transform(regexp_extract_all(path, '20[0-9][0-9]'), lambda x: x::INT)) END"


@query(
    "a7_year_pruning",
    f"WITH paths AS ({PATHS}) SELECT path, coalesce({_FIRST}, 0) AS first_year, coalesce({_LAST}, 0) AS last_year FROM paths WHERE {_FIRST} IS NULL OR ({_LAST} >= 2020 AND {_FIRST} <= 2021)",
)
def a7(spark, sf):
    first, last = year_window(F.col("path"), THIS_YEAR)
    pruned = prune_by_year(paths(spark, sf), "2020-03-01", "2021-06-30", THIS_YEAR)
    return pruned.select("path", F.coalesce(first, F.lit(0)).alias("first_year"), F.coalesce(last, F.lit(0)).alias("last_year"))


_OFFERED = "SELECT pair, source_timeframe, path FROM tickfiles UNION ALL SELECT pair, source_timeframe, path FROM canonical"


@query(
    "a8_source_choice",
    TREE + f", offered AS ({_OFFERED}) SELECT pair, source_timeframe, path FROM (SELECT *, {RANK} AS k, min({RANK}) OVER (PARTITION BY pair) AS best FROM offered) WHERE k = best",
)
def a8(spark, sf):
    tree = paths(spark, sf)
    return choose_sources(tick_files(tree, SOURCE_PAIRS), bar_files(tree, SOURCE_PAIRS)).select("pair", "source_timeframe", "path")


@query("a8_forced_source", TREE + f", offered AS ({_OFFERED}) SELECT pair, path FROM offered WHERE source_timeframe = '1h'")
def a8_forced(spark, sf):
    tree = paths(spark, sf)
    return choose_sources(tick_files(tree, SOURCE_PAIRS), bar_files(tree, SOURCE_PAIRS), "1H").select("pair", "path")


@query(
    "a11_candle_sink",
    " UNION ALL ".join(
        f"SELECT pair, '{tf}' AS timeframe, count(*) AS bars, {r('sum(h - l)')} AS range_sum, {D.stamp('min(ts)')} AS first, {D.stamp('max(ts)')} AS last FROM (SELECT pair, {D.bucket('ts', tf)} AS ts, max(mid) AS h, min(mid) AS l FROM ({D.EVENT_TICKS}) GROUP BY 1, 2) GROUP BY 1"
        for tf in TIMEFRAMES
    ),
)
def a11(spark, sf):
    """Written as partitioned Parquet, read back from disk."""
    rows = spark.read.parquet(store(spark, sf))
    return rows.groupBy("pair", "timeframe").agg(
        F.count(F.lit(1)).alias("bars"), F.sum(F.col("high") - F.col("low")).alias("range_sum"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
    )


@query(
    "a12_skip_valid_outputs",
    """SELECT DISTINCT event_type AS pair, tf AS timeframe FROM events, (VALUES ('1h'), ('4h'), ('30m')) t(tf)
    WHERE tf = '30m' OR (tf = '4h' AND event_type = 'error') OR (tf = '1h' AND event_type = 'view')""",
)
def a12(spark, sf):
    """Outputs shifted off their grid, or absent, are rebuilt; valid ones are kept."""
    stored = spark.read.parquet(store(spark, sf)).where(F.col("timeframe").isin("1h", "4h"))
    spoiled = (F.col("pair") == "error") & (F.col("timeframe") == "4h")
    existing = stored.withColumn(
        "timestamp", F.when(spoiled, F.col("timestamp") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("timestamp"))
    ).where(~((F.col("pair") == "view") & (F.col("timeframe") == "1h")))
    wanted = event_ticks(spark, sf).select("pair").distinct().withColumn("timeframe", F.explode(F.array(*[F.lit(t) for t in ("30m", "1h", "4h")])))
    return outputs_to_build(wanted, existing).select("pair", "timeframe")


@query(
    "a12_partition_overwrite",
    f"""WITH {D.event_bars('4h')} SELECT pair, timeframe, count(*) AS bars, {r('sum(c)')} AS closes FROM (
      SELECT pair, '4h' AS timeframe, c FROM bars WHERE pair <> 'click' UNION ALL SELECT pair, '4h', c + 1 FROM bars WHERE pair = 'click') GROUP BY 1, 2""",
)
def a12_overwrite(spark, sf):
    """Rewriting one pair leaves the other partitions alone."""
    root = scratch(spark) + "/store"
    rows = bars(spark, sf, "4h")
    write_candles(rows, root)
    write_candles(rows.where("pair = 'click'").withColumn("close", F.col("close") + 1), root)
    return spark.read.parquet(root).groupBy("pair", "timeframe").agg(F.count(F.lit(1)).alias("bars"), F.sum("close").alias("closes"))


_PART_A = "SELECT event_type AS pair, count(*) AS total_trades, round(sum(value), 2) AS net_pnl FROM events GROUP BY event_type"
_PART_B = "SELECT o_orderpriority AS pair, count(*) AS total_trades, round(max(o_totalprice), 2) AS optional_metric FROM orders GROUP BY o_orderpriority"


@query(
    "a13_schema_drift",
    f"SELECT pair, total_trades, {r('net_pnl')} AS net_pnl, NULL::DOUBLE AS optional_metric FROM ({_PART_A}) UNION ALL SELECT pair, total_trades, NULL, {r('optional_metric')} FROM ({_PART_B})",
)
def a13(spark, sf):
    """Two parts with different columns, read as one dataset."""
    path = scratch(spark) + "/results"
    derived(spark, sf, _PART_A, "events").write.mode("append").parquet(path)
    derived(spark, sf, _PART_B, "orders").write.mode("append").parquet(path)
    merged = union_results([derived(spark, sf, _PART_A, "events"), derived(spark, sf, _PART_B, "orders")])
    return read_results(spark, path).select(*merged.columns)


@query(
    "a14_result_append",
    f"SELECT config_hash, total_trades, {r('net_pnl')} AS net_pnl, CASE WHEN timeframe = '4h' THEN {r('net_pnl')} END AS late FROM ({RESULTS})",
)
def a14(spark, sf):
    path = scratch(spark) + "/results"
    rows = results(spark, sf)
    # The first part lacks a column that the second has.
    for half in (rows.where("timeframe = '1h'").drop("late"), rows.where("timeframe = '4h'").withColumn("late", F.col("net_pnl"))):
        append_results(half, path, ["config_hash", "total_trades", "net_pnl", "late"], {"late": "double"})
    return read_results(spark, path).join(completed_hashes(spark, path), "config_hash")


@query(
    "a15_run_output",
    _machine(
        NAMES,
        f"""SELECT {_run_name(NAMES, 'k')} AS strategy, pair, '{TIMEFRAME}' AS timeframe, total_trades, total_trades AS logged_trades,
        {r('gross_pnl')} AS gross_pnl, {r('net_pnl')} AS net_pnl FROM metrics""",
        f", {D.equity()}, {D.metrics()}",
    ),
)
def a15(spark, sf):
    """Tables of all runs by run id, read back and joined."""
    root = scratch(spark)
    save_book(book(spark, sf), root)
    metrics, trades = spark.read.parquet(f"{root}/metrics"), spark.read.parquet(f"{root}/trades")
    logged = trades.groupBy("run_id").agg(F.count(F.lit(1)).alias("logged_trades"))
    return metrics.join(logged, "run_id", "left").select(
        "strategy", "pair", "timeframe", "total_trades", F.coalesce("logged_trades", F.lit(0)).alias("logged_trades"), "gross_pnl", "net_pnl"
    )


@query(
    "a16_failure_log",
    """SELECT CAST(o_orderkey AS VARCHAR) AS config_hash FROM orders WHERE o_orderstatus <> 'P'""",
)
def a16(spark, sf):
    """JSON lines written and read back; blank hashes and broken lines are skipped."""
    path = scratch(spark) + "/failed"
    orders = table(spark, sf, "orders")
    failures = orders.select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey").cast("string")).otherwise("").alias("config_hash"),
        F.lit("{}").alias("config"), F.lit("broken").alias("error"), F.col("o_orderdate").cast("string").alias("timestamp"),
    )
    append_failures(failures, path)
    orders.select(F.concat(F.lit("{not json "), F.col("o_orderkey").cast("string")).alias("value")).write.mode("append").text(path)
    return failed_hashes(spark, path)


@query("a17_trade_files", "SELECT o_orderkey AS seq, o_orderstatus AS status FROM orders")
def a17(spark, sf):
    """The trade log as CSV and as Parquet reads back the same rows."""
    folder = scratch(spark)
    log = trade_log(spark, sf)
    log.write.option("header", "true").csv(f"{folder}/trades.csv")
    log.write.parquet(f"{folder}/trades.parquet")
    text, typed = read_trade_log(spark, f"{folder}/trades.csv"), read_trade_log(spark, f"{folder}/trades.parquet")
    both = text.select(F.col("seq").cast("bigint").alias("seq"), "entry_price").join(typed.select("seq", F.col("entry_price").alias("typed_price")), "seq")
    status = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    return both.where("entry_price = typed_price").select("seq").join(status, "seq")


_BEST = f"""SELECT * FROM ({RESULTS}) WHERE total_trades >= 200 AND profit_factor >= 1.03 AND max_drawdown >= -0.35 AND win_rate >= 0.3"""


@query(
    "a17_shortlist_files",
    f"SELECT count(*) AS rows, count(DISTINCT config_hash) AS hashes FROM (SELECT * FROM ({_BEST}) ORDER BY profit_factor DESC, config_hash LIMIT 50)",
)
def a17_shortlist(spark, sf):
    """Parquet plus CSV twin; both hold the same rows."""
    path = scratch(spark) + "/shortlist.parquet"
    save_shortlist(shortlist(results(spark, sf)), path)
    twin = spark.read.option("header", "true").csv(path[: -len(".parquet")] + ".csv").select("config_hash")
    both = spark.read.parquet(path).join(twin, "config_hash")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("config_hash").alias("hashes"))


@query(
    "a_build_store",
    " UNION ALL ".join(
        f"SELECT upper(pair) AS pair, '{tf}' AS timeframe, count(*) AS bars, {r('sum(h)')} AS highs FROM (SELECT pair, {D.bucket('ts', tf)} AS ts, max(mid) AS h FROM ({D.EVENT_TICKS}) GROUP BY 1, 2) GROUP BY 1"
        for tf in ("1h", "4h", "1d")
    ),
)
def a_build(spark, sf):
    """A tick file tree on disk -> chosen files -> candle store."""
    source, target = scratch(spark), scratch(spark) + "/store"
    ticks = event_ticks(spark, sf).drop("seq").withColumn("pair", F.upper("pair"))
    names = [row.pair for row in ticks.select("pair").distinct().collect()]
    for name in names:
        ticks.where(F.col("pair") == name).drop("pair").write.parquet(f"{source}/cleaned_ticks/{name}/2024")
    build_store(spark, source, target, pairs=names, timeframes=["1h", "4h", "1d"])
    return spark.read.parquet(target).groupBy("pair", "timeframe").agg(F.count(F.lit(1)).alias("bars"), F.sum("high").alias("highs"))


# A first build of everything; then January 2 to 9 only, with the ticks of one pair gone from that window, a shift in
# one kept output, and a pair without files.
_FIRST, _LAST = "2024-01-02", "2024-01-09"
_GONE = f"event_type = 'view' AND ts >= TIMESTAMP '{_FIRST}' AND ts < TIMESTAMP '2024-01-10'"


def _rebuild(spark, sf, overwrite: bool):
    source, target = scratch(spark), scratch(spark) + "/store"
    ticks = event_ticks(spark, sf).drop("seq")
    names = [row[0] for row in ticks.select(F.upper("pair")).distinct().collect()]
    gone = (F.col("pair") == "view") & (F.col("timestamp") >= F.lit(_FIRST).cast("timestamp")) & (F.col("timestamp") < F.lit("2024-01-10").cast("timestamp"))
    for name in names:
        ticks.where((F.upper("pair") == name) & ~gone).drop("pair").write.parquet(f"{source}/cleaned_ticks/{name}/2024")
    build_store(spark, source, target, pairs=names, timeframes=["1h", "4h"])
    if not overwrite:
        broken = spark.read.parquet(target).where("pair = 'CLICK' AND timeframe = '4h'").withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 SECOND"))
        write_candles(materialize(broken, "broken"), target)
    outcome = build_store(spark, source, target, pairs=[*names, "NOWHERE"], timeframes=["1h", "4h"], start=_FIRST, end=_LAST, overwrite=overwrite)
    left = spark.read.parquet(target).groupBy("pair", "timeframe").agg(F.count(F.lit(1)).alias("bars"))
    return outcome.join(left, ["pair", "timeframe"], "left").select("pair", "timeframe", "status", F.coalesce("bars", F.lit(0)).alias("bars"))


def _counted(where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT upper(event_type) AS pair, '{tf}' AS timeframe, count(DISTINCT {D.bucket('ts', tf)}) AS bars FROM events WHERE {where} GROUP BY 1" for tf in ("1h", "4h")
    )


_WINDOW = f"ts >= TIMESTAMP '{_FIRST}' AND ts < TIMESTAMP '2024-01-10' AND NOT ({_GONE})"
_NOWHERE = "SELECT 'NOWHERE' AS pair, tf AS timeframe, 'no_source' AS status, 0 AS bars FROM (VALUES ('1h'), ('4h')) t(tf)"


@query(
    "a12_empty_window_removed",
    f"""SELECT a.pair, a.timeframe, CASE WHEN b.bars IS NULL THEN 'empty' ELSE 'built' END AS status, coalesce(b.bars, 0) AS bars
    FROM ({_counted(f'NOT ({_GONE})')}) a LEFT JOIN ({_counted(_WINDOW)}) b USING (pair, timeframe) UNION ALL {_NOWHERE}""",
)
def a12_emptied(spark, sf):
    """A rebuild whose window holds no tick of a pair removes that pair's older outputs."""
    return _rebuild(spark, sf, True)


@query(
    "a12_skip_existing",
    f"""SELECT a.pair, a.timeframe, CASE WHEN a.pair = 'CLICK' AND a.timeframe = '4h' THEN 'built' ELSE 'skipped' END AS status,
      CASE WHEN a.pair = 'CLICK' AND a.timeframe = '4h' THEN b.bars ELSE a.bars END AS bars
    FROM ({_counted(f'NOT ({_GONE})')}) a LEFT JOIN ({_counted(_WINDOW)}) b USING (pair, timeframe) UNION ALL {_NOWHERE}""",
)
def a12_kept(spark, sf):
    """Without overwriting, valid outputs stay whole and only the broken one is rebuilt."""
    return _rebuild(spark, sf, False)

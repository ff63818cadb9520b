"""The given tables seen as ticks, bars, paths, results and trade logs.

Derivations used on both sides are written once as SQL text that Spark and
DuckDB read alike.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from barlab.operators.resample import ticks_to_all_bars, ticks_to_bars
from barlab.session import materialize, shared_folder
from barlab.sources.candles import write_candles

_KEPT: dict[tuple, object] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make):
    """Build a stored table (or book) once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    shared = shared_folder(spark)
    if "://" in shared or shared.startswith("file:"):
        import uuid

        return f"{shared}/barlab/scratch-{uuid.uuid4().hex}"
    import os

    os.makedirs(shared, exist_ok=True)
    return tempfile.mkdtemp(prefix="scratch-", dir=shared)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def present(df: DataFrame) -> DataFrame:
    """Comparable output: doubles to six places, times and arrays as text."""
    shown = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), ",")
        shown.append(column.alias(field.name))
    return df.select(*shown)


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("pair"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("mid"),
        F.col("event_id").alias("seq"),
    )


# A daily feed with many ticks at the same instant; some without a mid.
LINE_FIELDS = """l_returnflag AS pair, l_extendedprice - l_discount AS bid, l_extendedprice + l_tax AS ask,
  CASE WHEN l_discount > 0 THEN l_extendedprice END AS mid, l_tax * 10 AS spread, l_quantity AS quantity, l_discount AS discount, l_tax AS tax"""


def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    return lines.withColumn("seq", order).selectExpr(*_split(LINE_FIELDS), "CAST(l_shipdate AS TIMESTAMP) AS timestamp", "seq")


def _split(fields: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in fields:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [p.strip() for p in parts + [current]]


def bars(spark: SparkSession, sf_dir: str, timeframe: str) -> DataFrame:
    """Event bars of one timeframe, stored once."""
    return kept(
        spark, sf_dir, f"bars-{timeframe}", lambda: materialize(ticks_to_bars(event_ticks(spark, sf_dir), timeframe), "candles")
    )


def store(spark: SparkSession, sf_dir: str) -> str:
    """Root of a candle store with all seven timeframes of the events."""

    def build() -> str:
        root = scratch(spark) + "/store"
        write_candles(ticks_to_all_bars(event_ticks(spark, sf_dir)), root)
        return root

    return kept(spark, sf_dir, "store", build)


# --- a file tree, one path per order (repeats removed) ---
_PAIR = """CASE o_custkey % 7 WHEN 0 THEN 'EURUSD' WHEN 1 THEN 'USDJPY' WHEN 2 THEN 'GBPUSD' WHEN 3 THEN 'EURJPY'
  WHEN 4 THEN 'AUDUSD' WHEN 5 THEN 'XAUUSD' ELSE 'GBPJPY' END"""
_TF = """CASE o_orderkey % 6 WHEN 0 THEN '5m' WHEN 1 THEN '15m' WHEN 2 THEN '30m' WHEN 3 THEN '1h' WHEN 4 THEN '4h' ELSE '1d' END"""
_YEAR = "CAST(year(o_orderdate) + 23 AS STRING)"
PATHS = f"""SELECT DISTINCT CASE substr(o_orderpriority, 1, 1)
    WHEN '1' THEN CASE WHEN o_custkey % 7 < 3 THEN 'cleaned_ticks/' || p || '/' || y || '/' || lower(p) || '_ticks_' || y || CASE WHEN o_custkey % 5 = 0 THEN '_recent' ELSE '' END || '.parquet'
                  ELSE 'notes/' || y || CASE WHEN o_custkey % 2 = 0 THEN '/README' ELSE '/notes.TXT' END END
    WHEN '2' THEN 'bars/' || t || '/' || lower(p) || '_' || t || '_' || y || '.parquet'
    WHEN '3' THEN 'bars/' || t || '/' || lower(p) || '_bars' || CASE o_orderstatus WHEN 'F' THEN '_raw' WHEN 'O' THEN '_latest' ELSE '_recent' END || '.parquet'
    WHEN '4' THEN 'bars/misc/' || lower(p) || '_' || t || '_' || CASE WHEN o_custkey % 3 = 0 THEN '2025_now' WHEN o_custkey % 3 = 1 THEN 'all' ELSE y || '_recent' END || CASE WHEN o_custkey % 4 = 0 THEN '.csv' ELSE '.parquet' END
    ELSE 'raw/' || p || '/' || y || '/' || CAST(month(o_orderdate) AS STRING) || '/' || p || '.' || y || CASE WHEN o_custkey % 6 = 0 THEN '.json' ELSE '.bi5' END
  END AS path
FROM (SELECT *, {_PAIR} AS p, {_TF} AS t, {_YEAR} AS y FROM orders)"""
SOURCE_PAIRS = ["EURUSD", "USDJPY", "GBPUSD", "EURJPY", "AUDUSD", "GBPJPY"]
THIS_YEAR = 2026


def derived(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A shared SQL text over given tables, without touching the session's views."""
    text = sql
    for name in tables:
        text = text.replace(f"FROM {name}", f"FROM parquet.`{sf_dir}/{name}.parquet`")
    return spark.sql(text)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path table, stored once like any file listing."""
    return kept(spark, sf_dir, "paths", lambda: materialize(derived(spark, sf_dir, PATHS, "orders"), "paths"))


# --- experiment results, one per part; odd divisors keep figures off rounding ties ---
RESULTS = """SELECT l_partkey AS part, CASE l_partkey % 3 WHEN 0 THEN 'EURUSD' WHEN 1 THEN 'USDJPY' ELSE 'GBPUSD' END AS pair,
  CASE l_partkey % 2 WHEN 0 THEN '1h' ELSE '4h' END AS timeframe, 'crossover' AS entry_type, 'ema,sma' AS ma_types, '25,50' AS ma_periods,
  CASE l_partkey % 4 WHEN 0 THEN 'atr12' ELSE 'fixed1010' END AS exit_profile, CAST(l_partkey AS STRING) AS config_hash,
  count(*) * 10 AS total_trades, CAST(sum(l_quantity) AS DOUBLE) / CAST(700 AS DOUBLE) AS profit_factor,
  -max(l_discount) * CAST(5 AS DOUBLE) AS max_drawdown, CAST(round(sum(l_tax) * 100) AS DOUBLE) / CAST(count(*) * 10 + 1 AS DOUBLE) AS win_rate,
  CAST(floor(sum(l_extendedprice) + CAST(0.005 AS DOUBLE)) AS DOUBLE) / CAST(9973 AS DOUBLE) - CAST(100 AS DOUBLE) AS net_pnl,
  CAST(floor(sum(l_extendedprice) + CAST(0.005 AS DOUBLE)) AS DOUBLE) / CAST(101 AS DOUBLE) AS final_capital
FROM lineitem GROUP BY l_partkey"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, RESULTS, "lineitem")


# --- a messy trade log, one trade per order ---
TRADES = """SELECT o_orderkey AS seq, CASE WHEN o_custkey % 13 = 0 THEN ' ' WHEN o_custkey % 17 = 0 THEN NULL ELSE 'T' || CAST(o_orderkey AS STRING) END AS trade_id,
  CASE WHEN o_orderkey % 19 = 0 THEN 'hold' WHEN o_custkey % 2 = 0 THEN 'LONG' ELSE 'short' END AS side,
  CASE WHEN o_orderkey % 23 = 0 THEN 'soon' ELSE substr(CAST(o_orderdate AS STRING), 1, 10) || ' 08:00:00' END AS entry_time,
  CASE WHEN o_orderkey % 29 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS STRING) END AS entry_price,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE substr(CAST(o_orderdate AS STRING), 1, 10) || CASE WHEN o_orderkey % 31 = 0 THEN ' 07:00:00' ELSE ' 20:00:00' END END AS exit_time,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST(o_totalprice + o_custkey AS STRING) END AS exit_price,
  CASE WHEN o_orderkey % 41 = 0 THEN 'none' WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_totalprice - 50 AS STRING) END AS stop_loss,
  CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_totalprice + 75 AS STRING) END AS take_profit,
  '1' AS size, CAST(NULL AS STRING) AS pnl,
  CASE WHEN o_orderkey % 43 = 0 THEN 'usdjpy' WHEN o_orderkey % 47 = 0 THEN NULL ELSE 'eurusd' END AS pair,
  CASE WHEN o_orderkey % 53 = 0 THEN '4h' ELSE '1H' END AS timeframe FROM orders"""
TRADE_WINDOW = ("1996-01-01", "2000-12-31")


def trade_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, TRADES, "orders")

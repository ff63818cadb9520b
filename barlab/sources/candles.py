"""The candle store: Parquet, partitioned by pair and timeframe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlab.functions.nulls import clean_doubles, require_columns
from barlab.functions.timeframes import seconds_of, utc, within
from barlab.operators.quality import validate_stored
from barlab.operators.resample import as_candles
from barlab.schemas import BLOCK, CANDLE_OPTIONAL, SERIES

REQUIRED = ["timestamp", "open", "high", "low", "close"]

# Bars per file of one series: a hot series is written by many tasks.
BARS_PER_FILE = 2048 * BLOCK


def candle_window(candles: DataFrame, pair: str | None, timeframe: str | None, start: str | None, end: str | None) -> DataFrame:
    """Required and present optional columns of one series and inclusive UTC window.

    All predicates are plain comparisons: partition pruning on pair and
    timeframe, row-group pruning on timestamp.
    """
    require_columns(candles, REQUIRED, "candle")
    picked = candles
    if pair is not None:
        picked = picked.where(F.col("pair") == pair)
    if timeframe is not None:
        picked = picked.where(F.col("timeframe") == timeframe)
    keep = [c for c in (*REQUIRED, *SERIES, *CANDLE_OPTIONAL) if c in candles.columns]
    typed = picked.withColumn("timestamp", utc(F.col("timestamp")))
    return clean_doubles(typed.where(within(F.col("timestamp"), start, end)).select(*keep))


def read_candles(
    spark: SparkSession,
    root: str,
    pair: str,
    timeframe: str,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """One series from the store; empty windows and duplicate timestamps are errors."""
    rows = candle_window(spark.read.parquet(root), pair.upper(), timeframe.lower(), start, end)
    found = check_unique(rows).first()
    if found["rows"] == 0:
        raise ValueError(f"No candle rows found for {pair} {timeframe} between {start} and {end}.")
    if found["duplicates"]:
        raise ValueError("Candle input contains duplicate timestamps.")
    return rows


def check_unique(rows: DataFrame) -> DataFrame:
    """Row and duplicate counts, grouped by timestamp first so no task sees a whole series."""
    return (
        rows.groupBy(*[c for c in SERIES if c in rows.columns], "timestamp")
        .agg(F.count(F.lit(1)).alias("same"))
        .agg(
            F.coalesce(F.sum("same"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.col("same") - 1), F.lit(0)).alias("duplicates"),
        )
    )


def write_candles(bars: DataFrame, root: str, *, mode: str = "overwrite") -> None:
    """Write whole series; only the (pair, timeframe) partitions present in ``bars`` are replaced."""
    span = F.coalesce(seconds_of(F.col("timeframe")), F.lit(86400)).cast("bigint") * F.lit(BARS_PER_FILE)
    piece = F.floor(F.unix_seconds("timestamp") / span)
    (
        as_candles(bars)
        .repartition(*SERIES, piece)
        .sortWithinPartitions(*SERIES, "timestamp")
        .write.option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .mode(mode)
        .partitionBy(*SERIES)
        .parquet(root)
    )


def remove_series(spark: SparkSession, root: str, pair: str, timeframe: str) -> None:
    """Drop the stored partition of one series, if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/pair={pair}/timeframe={timeframe}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def outputs_to_build(requested: DataFrame, existing: DataFrame | None, *, overwrite: bool = False) -> DataFrame:
    """Requested (pair, timeframe) rows still to build: all, or those without a valid output."""
    if overwrite or existing is None:
        return requested
    valid = validate_stored(existing).where("valid").select(*SERIES)
    return requested.join(valid, SERIES, "left_anti")

"""Bars from a growing tick folder.

The stream emits a bar once the watermark has passed its bucket and keeps only
open buckets as state.  A stream never closes the last buckets by itself;
``with_open_bars`` completes them from the ticks of those buckets in batch.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from barlab.functions.timeframes import bucket_start, utc
from barlab.operators.resample import as_candles, ticks_to_bars
from barlab.schemas import TIMEFRAME_SECONDS


def stream_ticks(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    """A folder of Parquet tick files as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def streaming_bars(ticks: DataFrame, timeframe: str, *, delay: str = "0 seconds") -> DataFrame:
    """Closed bars of a tick stream (pair, timestamp, mid[, spread][, seq])."""
    moment = F.struct("timestamp", "seq") if "seq" in ticks.columns else F.struct("timestamp")
    priced = F.when(F.col("mid").isNotNull(), moment)
    timed = ticks.withColumn("timestamp", utc(F.col("timestamp"))).withWatermark("timestamp", delay)
    bars = (
        timed.groupBy("pair", F.window("timestamp", f"{TIMEFRAME_SECONDS[timeframe]} seconds").alias("span"))
        .agg(
            F.min_by("mid", priced).alias("open"),
            F.max("mid").alias("high"),
            F.min("mid").alias("low"),
            F.max_by("mid", priced).alias("close"),
            *([F.avg("spread").alias("spread")] if "spread" in ticks.columns else []),
            F.count(F.lit(1)).alias("tick_count"),
        )
        .where(F.col("high").isNotNull())
        .withColumns(
            {
                "timestamp": F.col("span.start"),
                "timeframe": F.lit(timeframe),
                "source_kind": F.lit("ticks"),
                "source_timeframe": F.lit("tick"),
            }
        )
    )
    return as_candles(bars)


def run_available(bars: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Process everything that is there, append closed bars, and stop."""
    query = (
        bars.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def late_ticks(ticks: DataFrame, closed: DataFrame, timeframe: str, *, delay: str = "0 seconds") -> DataFrame:
    """(pair, late) of pairs with ticks that the stream has dropped behind its watermark.

    ``ticks`` is the folder in batch, ``closed`` the stream's output so far.  Every bucket the
    watermark has passed must hold as many ticks as its bar counts; the excess came late.  Nothing
    depends on the progress a query remembers, so restarts and any number of batches do no harm.
    Buckets without any price give no bar and are not counted.
    """
    timed = ticks.withColumn("timestamp", utc(F.col("timestamp")))
    length = F.lit(TIMEFRAME_SECONDS[timeframe])
    per_bucket = timed.groupBy("pair", bucket_start(F.col("timestamp"), length).alias("start")).agg(
        F.count(F.lit(1)).alias("ticks"), F.count("mid").alias("priced")
    )
    latest = timed.agg((F.max("timestamp") - F.expr(f"INTERVAL {delay}")).alias("passed")).first()["passed"]
    ended = F.col("start") + F.expr(f"INTERVAL {TIMEFRAME_SECONDS[timeframe]} SECONDS") <= F.lit(latest).cast("timestamp")
    bars = closed.select("pair", F.col("timestamp").alias("start"), "tick_count")
    late = F.col("ticks") - F.coalesce("tick_count", F.lit(0))
    return (
        per_bucket.where(ended & (F.col("priced") > 0))
        .join(bars, ["pair", "start"], "left")
        .groupBy("pair")
        .agg(F.sum(late).alias("late"))
        .where("late > 0")
    )


def late_rows(ticks: DataFrame, closed: DataFrame, timeframe: str, *, delay: str = "0 seconds") -> int:
    """Ticks that arrived behind the watermark and were dropped."""
    return late_ticks(ticks, closed, timeframe, delay=delay).agg(F.coalesce(F.sum("late"), F.lit(0))).first()[0]


def require_in_order(ticks: DataFrame, closed: DataFrame, timeframe: str, *, delay: str = "0 seconds") -> None:
    """Late or overlapping input must not pass silently."""
    dropped = late_rows(ticks, closed, timeframe, delay=delay)
    if dropped:
        raise ValueError(f"{dropped} late ticks: input is not in order across batches")


def with_open_bars(closed: DataFrame, ticks: DataFrame, timeframe: str) -> DataFrame:
    """Closed bars plus the buckets still open, from the ticks of those buckets only."""
    latest = closed.agg(F.max("timestamp")).first()[0]
    timed = ticks.withColumn("timestamp", utc(F.col("timestamp")))
    if latest is not None:
        start = latest + timedelta(seconds=TIMEFRAME_SECONDS[timeframe])
        timed = timed.where(F.col("timestamp") >= F.lit(start))
    return closed.unionByName(ticks_to_bars(timed, timeframe))

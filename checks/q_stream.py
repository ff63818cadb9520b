"""Incremental bars from the event file read as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.schemas import TIMEFRAME_SECONDS, TIMEFRAMES
from barlab.streaming.incremental import Build
from barlab.streaming.bars import late_ticks, run_available, stream_ticks, streaming_bars, with_open_bars
from checks import duck_sql as D
from checks.feeds import event_ticks, scratch, table
from checks.q_bars import OHLC, _ohlc
from checks.registry import query, r

FRAME = "1h"


def _stream(spark, sf):
    folder = scratch(spark)
    raw = stream_ticks(spark, sf, table(spark, sf, "events").schema, "events.parquet")
    ticks = raw.select(
        F.col("event_type").alias("pair"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("mid"), F.col("event_id").alias("seq"),
    )
    run_available(streaming_bars(ticks, FRAME), f"{folder}/bars", f"{folder}/state")
    return spark.read.parquet(f"{folder}/bars")


@query(
    "l1_stream_bars",
    f"""WITH {D.event_bars(FRAME)} SELECT pair, '{FRAME}' AS timeframe, {D.stamp('ts')} AS timestamp, {r('o')} AS open, {r('h')} AS high, {r('l')} AS low, {r('c')} AS close, n AS tick_count
    FROM bars WHERE epoch_us(ts) + {TIMEFRAME_SECONDS[FRAME]}::BIGINT * 1000000 <= (SELECT epoch_us(max(ts)) FROM events)""",
)
def l1(spark, sf):
    """Only buckets the watermark has passed are emitted."""
    return _stream(spark, sf).select(*OHLC, "tick_count")


@query("l2_open_buckets", _ohlc(D.EVENT_TICKS, FRAME, "1 AS z|n AS tick_count"))
def l2(spark, sf):
    """The stream's bars completed by a batch over the open buckets."""
    closed = _stream(spark, sf)
    return with_open_bars(closed, event_ticks(spark, sf), FRAME).select(*OHLC, "tick_count")


# Every tenth event arrives in a second batch, after the others.
_LATE = "event_id % 10 = 0"


@query(
    "l3_late_input",
    f"""SELECT event_type AS pair, count(*) AS late FROM events
    WHERE {_LATE} AND epoch_us({D.bucket('ts', FRAME)}) + {TIMEFRAME_SECONDS[FRAME]}::BIGINT * 1000000 <= (SELECT epoch_us(max(ts)) FROM events WHERE NOT ({_LATE})) GROUP BY 1""",
)
def l3(spark, sf):
    """Ticks dropped behind the watermark, over two runs of the stream that share their state."""
    folder = scratch(spark)
    ticks = event_ticks(spark, sf)
    for late in (False, True):
        part = ticks.where((F.col("seq") % 10 == 0) == F.lit(late))
        part.write.mode("append").parquet(f"{folder}/ticks")
        stream = stream_ticks(spark, f"{folder}/ticks", ticks.schema)
        run_available(streaming_bars(stream, FRAME), f"{folder}/bars", f"{folder}/state")
    return late_ticks(spark.read.parquet(f"{folder}/ticks"), spark.read.parquet(f"{folder}/bars"), FRAME)


def _build(spark, ticks, batches, **how):
    """Batches of the ticks as files of one folder, built as a stream that takes a file at a time."""
    folder = scratch(spark)
    for batch in batches:
        ticks.where(batch).coalesce(1).write.mode("append").parquet(f"{folder}/ticks")
    build = Build(f"{folder}/build", **how)
    build.run_available(spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/ticks"))
    return build


def _by_time(ticks, parts: int) -> list:
    """Conditions that cut the ticks into time ranges."""
    low, high = ticks.select(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    edges = [low + (high - low) * k // parts for k in range(parts)] + [high + 1]
    at = F.unix_micros("timestamp")
    return [(at >= a) & (at < b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _closed_sql(tf: str) -> str:
    return f"""(WITH {D.event_bars(tf)}, reached AS (SELECT event_type, max(ts) AS ts FROM events GROUP BY 1)
    SELECT pair, '{tf}' AS timeframe, {D.stamp('b.ts')} AS timestamp, {r('o')} AS open, {r('h')} AS high, {r('l')} AS low, {r('c')} AS close, n AS tick_count
    FROM bars b JOIN reached r ON r.event_type = b.pair WHERE b.ts < {D.bucket('r.ts', tf)})"""


@query("l1_stream_all_timeframes", " UNION ALL ".join(_closed_sql(tf) for tf in TIMEFRAMES))
def l1_all(spark, sf):
    """Seven timeframes of all pairs from one stream, in four batches; a bar is out once its own pair has passed it."""
    ticks = event_ticks(spark, sf)
    return _build(spark, ticks, _by_time(ticks, 4)).closed(spark).select(*OHLC, "tick_count")


@query("l2_flush_all_timeframes", " UNION ALL ".join(f"({_ohlc(D.EVENT_TICKS, tf, '1 AS z|n AS tick_count')})" for tf in TIMEFRAMES))
def l2_all(spark, sf):
    """The end of the input: what the last batch left open comes out, too."""
    ticks = event_ticks(spark, sf)
    return _build(spark, ticks, _by_time(ticks, 3)).flushed(spark).select(*OHLC, "tick_count")


@query(
    "l3_late_pair",
    f"""WITH reached AS (SELECT event_type, max(ts) AS ts FROM events WHERE NOT ({_LATE} AND event_type = 'click') GROUP BY 1),
    late AS (SELECT e.event_type, count(*) AS late FROM events e JOIN reached r USING (event_type)
      WHERE event_id % 10 = 0 AND e.event_type = 'click' AND e.ts < {D.bucket('r.ts', FRAME)} GROUP BY 1)
    SELECT event_type AS pair, coalesce(late, 0) AS late, coalesce(late, 0) > 0 AS failed FROM reached LEFT JOIN late USING (event_type)""",
)
def l3_pair(spark, sf):
    """One pair's rows come late, in a second batch: it fails, the others go on."""
    ticks = event_ticks(spark, sf)
    late = (F.col("seq") % 10 == 0) & (F.col("pair") == "click")
    return _build(spark, ticks, [~late, late], timeframes=(FRAME,)).marks(spark).select("pair", "late", "failed")

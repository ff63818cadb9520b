"""Checks on candles and stored bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.functions.indicators import whole_blocks
from barlab.functions.nulls import require_columns
from barlab.functions.timeframes import bucket_start, seconds_of, utc
from barlab.schemas import CANDLE_BASE, SERIES

# Rows per piece when a row order is followed without gathering a whole series.
PIECE = 65536


def with_previous(df: DataFrame, keys: list[str], position: str, value: str, name: str) -> DataFrame:
    """``name`` = ``value`` of the previous row by ``position`` (a row number), per key.

    Rows are cut into pieces by position; the value before a piece comes from a
    one-row-per-piece summary.
    """
    pieced = df.withColumn("piece", whole_blocks(F.col(position), PIECE))
    # Wrapped, so that a NULL value is told apart from "no previous row".
    wrapped = F.struct(F.col(value).alias("value"))
    tails = pieced.groupBy(*keys, "piece").agg(F.max_by(wrapped, F.col(position)).alias("tail"))
    before = tails.select(
        *keys, "piece", F.lag("tail").over(Window.partitionBy(*keys).orderBy("piece")).alias("tail_before")
    )
    inside = Window.partitionBy(*keys, "piece").orderBy(position)
    return (
        pieced.join(before, [*keys, "piece"])
        .withColumn("own", F.lag(wrapped).over(inside))
        .withColumn(name, F.coalesce(F.col("own"), F.col("tail_before"))["value"])
        .drop("piece", "own", "tail_before")
    )


def candle_warnings(candles: DataFrame, *, position: str = "seq", keys: list[str] = SERIES) -> DataFrame:
    """Warnings with counts per series: (keys, code, count).

    ``position`` is the row order of the input.  A timestamp that does not parse
    counts as invalid, and makes the order unsorted.
    """
    require_columns(candles, ["timestamp", "open", "high", "low", "close"], "candle")
    moment = F.col("timestamp")
    if dict(candles.dtypes)["timestamp"] == "string":
        moment = F.try_to_timestamp(moment)
    parsed = candles.withColumn("moment", utc(moment))
    ordered = with_previous(parsed, keys, position, "moment", "previous")
    missing = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    per_time = ordered.groupBy(*keys, "moment").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("moment") < F.col("previous")).alias("backward"),
        F.count_if(missing).alias("missing"),
    )
    totals = per_time.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("moment").isNull(), F.col("rows"))), F.lit(0)).alias("invalid"),
        F.sum("backward").alias("backward"),
        F.sum(F.col("rows") - 1).alias("duplicates"),
        F.sum("missing").alias("missing"),
    )
    warning = lambda code, count, shown=None: F.struct(
        F.lit(code).alias("code"), count.alias("count"), (shown if shown is not None else count > 0).alias("shown")
    )
    none = F.lit(None).cast("bigint")
    unsorted = (F.col("backward") > 0) | (F.col("invalid") > 0)
    listed = F.array(
        warning("invalid_timestamp", F.col("invalid")),
        warning("timestamps_not_sorted", none, unsorted),
        warning("duplicate_timestamps", F.col("duplicates")),
        warning("missing_ohlc", F.col("missing")),
    )
    return totals.select(*keys, F.inline(listed)).where("shown").drop("shown")


def enforce_bar_limit(candles: DataFrame, *, max_bars: int, truncate: bool) -> tuple[DataFrame, dict | None]:
    """At most ``max_bars`` bars: an error, or the most recent ones and a warning."""
    if max_bars <= 0:
        raise ValueError("max_bars must be positive")
    total = candles.count()
    if total <= max_bars:
        return candles, None
    if not truncate:
        raise ValueError(f"Requested window contains {total} bars, which exceeds max_bars={max_bars}.")
    kept = candles.orderBy(F.col("timestamp").desc()).limit(max_bars)
    return kept, {"code": "truncated_bars", "requested_bars": total, "kept_bars": max_bars}


def sampled_slices(bars: DataFrame, position: str | None = None) -> DataFrame:
    """Rows of the first two and the last piece of every series, for a light check."""
    seconds = F.coalesce(seconds_of(F.col("timeframe")), F.lit(86400)).cast("bigint")
    row = F.col(position) if position else F.floor(F.unix_seconds(utc(F.col("timestamp"))) / seconds)
    pieced = bars.withColumn("piece", whole_blocks(row, PIECE))
    pieces = pieced.select(*SERIES, "piece").distinct()
    ranked = Window.partitionBy(*SERIES).orderBy("piece")
    chosen = (
        pieces.withColumns({"from_start": F.row_number().over(ranked), "next": F.lead("piece").over(ranked)})
        .where((F.col("from_start") <= 2) | F.col("next").isNull())
        .select(*SERIES, "piece")
    )
    return pieced.join(chosen, [*SERIES, "piece"], "left_semi").drop("piece")


# --- fixed values: messages of the stored-bar check, in the order they are tried ---
MONOTONIC = "timestamps are not monotonic"
DUPLICATE = "duplicate timestamps detected"
ALL_NULL = "all-null OHLC row detected"
MISALIGNED = "timestamps are not aligned to timeframe boundaries"
TOO_CLOSE = "timestamp spacing is smaller than the target timeframe"
EMPTY = "output file is empty"
MISSING = "missing output file"


def validate_stored(bars: DataFrame, *, position: str | None = None, requested: DataFrame | None = None) -> DataFrame:
    """(pair, timeframe, valid, message) per series; the first rule that fails is the message.

    ``position`` is the stored row order.  Without it rows are taken in time
    order, which leaves the order rule nothing to find.  ``requested`` adds the
    series that have no rows at all.
    """
    missing = [c for c in CANDLE_BASE if c not in bars.columns]
    if missing:
        known = [c for c in SERIES if c in bars.columns]
        named = bars.select(*known).distinct() if known else bars.sparkSession.range(1).select()
        return named.select(
            *[F.col(c) if c in known else F.lit(None).cast("string").alias(c) for c in SERIES],
            F.lit(False).alias("valid"),
            F.lit(f"missing required columns: {missing}").alias("message"),
        )
    seconds = F.coalesce(seconds_of(F.col("timeframe")), F.lit(86400)).cast("bigint")
    typed = bars.withColumn("timestamp", utc(F.col("timestamp")))
    if position is None:
        typed = typed.withColumn("order_in_time", F.unix_micros("timestamp"))
        followed = _previous_in_time(typed, seconds)
    else:
        followed = with_previous(typed, SERIES, position, "timestamp", "previous")
    gap = F.unix_micros("timestamp") - F.unix_micros("previous")
    prices = [F.col(c).isNull() for c in ("open", "high", "low", "close")]
    per_time = followed.groupBy(*SERIES, "timestamp").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(gap < 0).alias("backward"),
        F.count_if(prices[0] & prices[1] & prices[2] & prices[3]).alias("all_null"),
        F.count_if(gap < seconds * F.lit(1_000_000)).alias("close_by"),
    )
    totals = per_time.groupBy(*SERIES).agg(
        F.sum("rows").alias("rows"),
        F.sum("backward").alias("backward"),
        F.sum(F.col("rows") - 1).alias("duplicates"),
        F.sum("all_null").alias("all_null"),
        F.sum("close_by").alias("close_by"),
        F.count_if(bucket_start(F.col("timestamp"), seconds) != F.col("timestamp")).alias("misaligned"),
    )
    failed = (
        F.when(F.col("backward") > 0, MONOTONIC)
        .when(F.col("duplicates") > 0, DUPLICATE)
        .when(F.col("all_null") > 0, ALL_NULL)
        .when(F.col("misaligned") > 0, MISALIGNED)
        .when(F.col("close_by") > 0, TOO_CLOSE)
    )
    result = totals.select(
        *SERIES,
        failed.isNull().alias("valid"),
        F.coalesce(failed, F.concat(F.lit("validated "), F.col("rows").cast("string"), F.lit(" rows"))).alias("message"),
    )
    if requested is None:
        return result
    return (
        requested.select(*SERIES)
        .join(result, SERIES, "left")
        .select(*SERIES, F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("message", F.lit(MISSING)).alias("message"))
    )


def _previous_in_time(bars: DataFrame, seconds: Column) -> DataFrame:
    """``previous`` timestamp in time order, cut into time slices."""
    bucketed = bars.withColumn("slot", F.floor(F.unix_seconds("timestamp") / seconds).cast("bigint"))
    pieced = bucketed.withColumn("piece", whole_blocks(F.col("slot"), PIECE))
    tails = pieced.groupBy(*SERIES, "piece").agg(F.max("timestamp").alias("tail"))
    before = tails.select(*SERIES, "piece", F.lag("tail").over(Window.partitionBy(*SERIES).orderBy("piece")).alias("tail_before"))
    inside = Window.partitionBy(*SERIES, "piece").orderBy("timestamp")
    return pieced.join(before, [*SERIES, "piece"]).withColumn(
        "previous", F.coalesce(F.lag("timestamp").over(inside), F.col("tail_before"))
    )


def warning_summary(candles: DataFrame, *, position: str = "seq") -> DataFrame:
    """Bars and number of distinct warnings per series, for comparing timeframes."""
    warned = candle_warnings(candles, position=position).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("warnings"))
    bars = candles.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("bars"))
    return bars.join(warned, SERIES, "left").select(*SERIES, "bars", F.coalesce("warnings", F.lit(0)).alias("warnings"))

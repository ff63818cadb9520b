"""Ticks and bars into coarser bars.

Every bucket is one group of one aggregation: partial aggregation runs before
the exchange, so a pair that holds a third of all ticks sends one small row per
bucket and task, not its ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlab.functions.timeframes import bucket_start, rank_of, seconds_of
from barlab.schemas import CANDLE_SCHEMA, TIMEFRAME_SECONDS, TIMEFRAMES


def requested(timeframes: list[str] | None) -> list[str]:
    """Distinct known timeframes, finest first."""
    names = list(timeframes or TIMEFRAMES)
    unknown = [name for name in names if name not in TIMEFRAME_SECONDS]
    if unknown:
        raise ValueError(f"Unknown timeframes: {unknown}")
    return sorted(set(names), key=TIMEFRAMES.index)


def targets_for(source_timeframe: str, timeframes: list[str] | None = None) -> list[str]:
    """Timeframes a source can serve: ticks serve all, bars only their own and coarser."""
    names = requested(timeframes)
    if source_timeframe == "tick":
        return names
    return [name for name in names if TIMEFRAMES.index(name) >= TIMEFRAMES.index(source_timeframe)]


def as_candles(bars: DataFrame) -> DataFrame:
    """Fixed candle columns in fixed order; absent optional columns are NULL."""
    return bars.select(
        *[
            (F.col(f.name) if f.name in bars.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in CANDLE_SCHEMA.fields
        ]
    )


def _tick_order(ticks: DataFrame) -> Column:
    return F.struct("timestamp", "seq") if "seq" in ticks.columns else F.struct("timestamp")


def ticks_to_bars(ticks: DataFrame, timeframe: str) -> DataFrame:
    """OHLC of ``mid`` in left-closed buckets; buckets without any mid are dropped.

    ``tick_count`` counts all rows of the bucket, also those without a mid.
    """
    moment = _tick_order(ticks)
    priced = F.when(F.col("mid").isNotNull(), moment)
    bucket = bucket_start(F.col("timestamp"), TIMEFRAME_SECONDS[timeframe])
    bars = (
        ticks.groupBy("pair", bucket.alias("bucket"))
        .agg(
            F.min_by("mid", priced).alias("open"),
            F.max("mid").alias("high"),
            F.min("mid").alias("low"),
            F.max_by("mid", priced).alias("close"),
            *([F.avg("spread").alias("spread")] if "spread" in ticks.columns else []),
            F.count(F.lit(1)).alias("tick_count"),
        )
        .where(F.col("high").isNotNull())
        .withColumnRenamed("bucket", "timestamp")
        .withColumn("timeframe", F.lit(timeframe))
        .withColumn("source_kind", F.lit("ticks"))
        .withColumn("source_timeframe", F.lit("tick"))
    )
    return as_candles(bars)


def ticks_to_all_bars(ticks: DataFrame, timeframes: list[str] | None = None) -> DataFrame:
    """Every requested timeframe from one scan of the ticks.

    The ticks become bars of the finest requested timeframe (the only pass over
    ticks); coarser bars are folded from those, carrying the sums that keep mean
    spread and tick count exact.
    """
    names = requested(timeframes)
    moment = _tick_order(ticks)
    priced = F.when(F.col("mid").isNotNull(), moment)
    spread = F.col("spread") if "spread" in ticks.columns else F.lit(None).cast("double")
    base = (
        ticks.groupBy("pair", bucket_start(F.col("timestamp"), TIMEFRAME_SECONDS[names[0]]).alias("bucket"))
        .agg(
            F.min_by("mid", priced).alias("open"),
            F.max("mid").alias("high"),
            F.min("mid").alias("low"),
            F.max_by("mid", priced).alias("close"),
            F.sum(spread).alias("spread_sum"),
            F.count(spread).alias("spread_rows"),
            F.count(F.lit(1)).alias("tick_count"),
        )
    )
    fanned = base.withColumn("timeframe", F.explode(F.array(*[F.lit(n) for n in names])))
    filled = F.when(F.col("high").isNotNull(), F.col("bucket"))
    bars = (
        fanned.groupBy("pair", "timeframe", bucket_start(F.col("bucket"), seconds_of(F.col("timeframe"))).alias("timestamp"))
        .agg(
            F.min_by("open", filled).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", filled).alias("close"),
            F.try_divide(F.sum("spread_sum"), F.sum("spread_rows")).alias("spread"),
            F.sum("tick_count").alias("tick_count"),
        )
        .where(F.col("high").isNotNull())
        .withColumn("source_kind", F.lit("ticks"))
        .withColumn("source_timeframe", F.lit("tick"))
    )
    return as_candles(bars)


def bars_to_bars(bars: DataFrame, timeframe: str, source_timeframe: str) -> DataFrame:
    """Coarser bars from bars of one timeframe; the same timeframe passes rows through.

    First and last skip NULLs, the spread is a mean, and volume is a sum that is
    0 (not NULL) when every volume of the bucket is missing.
    """
    if timeframe not in targets_for(source_timeframe):
        raise ValueError(f"{timeframe} is finer than the source timeframe {source_timeframe}")
    labelled = (
        lambda df: as_candles(
            df.withColumn("timeframe", F.lit(timeframe))
            .withColumn("source_kind", F.lit("bars"))
            .withColumn("source_timeframe", F.lit(source_timeframe))
        )
    )
    if timeframe == source_timeframe:
        return labelled(bars)
    at = lambda name: F.when(F.col(name).isNotNull(), F.col("timestamp"))
    grouped = bars.groupBy("pair", bucket_start(F.col("timestamp"), TIMEFRAME_SECONDS[timeframe]).alias("bucket")).agg(
        F.min_by("open", at("open")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", at("close")).alias("close"),
        *([F.avg("spread").alias("spread")] if "spread" in bars.columns else []),
        *([F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume")] if "volume" in bars.columns else []),
    )
    return labelled(
        grouped.dropna(subset=["open", "high", "low", "close"]).withColumnRenamed("bucket", "timestamp")
    )


def bars_to_all_bars(bars: DataFrame, source_timeframe: str, timeframes: list[str] | None = None) -> DataFrame:
    """Every servable timeframe from one scan of the source bars."""
    coarser = [n for n in targets_for(source_timeframe, timeframes) if n != source_timeframe]
    own = bars_to_bars(bars, source_timeframe, source_timeframe)
    if not coarser:
        return own
    at = lambda name: F.when(F.col(name).isNotNull(), F.col("timestamp"))
    fanned = bars.withColumn("target", F.explode(F.array(*[F.lit(n) for n in coarser])))
    folded = (
        fanned.groupBy("pair", "target", bucket_start(F.col("timestamp"), seconds_of(F.col("target"))).alias("bucket"))
        .agg(
            F.min_by("open", at("open")).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", at("close")).alias("close"),
            *([F.avg("spread").alias("spread")] if "spread" in bars.columns else []),
            *([F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume")] if "volume" in bars.columns else []),
        )
        .dropna(subset=["open", "high", "low", "close"])
        .withColumnsRenamed({"bucket": "timestamp", "target": "timeframe"})
        .withColumn("source_kind", F.lit("bars"))
        .withColumn("source_timeframe", F.lit(source_timeframe))
    )
    wanted = requested(timeframes)
    return as_candles(folded).unionByName(own) if source_timeframe in wanted else as_candles(folded)


def servable(bars_or_pairs: DataFrame, source_column: str = "source_timeframe", target_column: str = "timeframe") -> Column:
    """Row predicate: may this target be built from this source?"""
    return (F.col(source_column) == "tick") | (rank_of(F.col(target_column)) >= rank_of(F.col(source_column)))

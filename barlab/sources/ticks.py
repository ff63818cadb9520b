"""Tick and source-bar normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlab.functions.nulls import clean_doubles
from barlab.functions.timeframes import utc

# --- fixed values: columns a source may offer ---
TICK_COLUMNS = ["mid", "spread", "bid", "ask"]
OHLC = ["open", "high", "low", "close"]
BAR_COLUMNS = (
    OHLC
    + [f"mid_{c}" for c in OHLC]
    + ["spread"]
    + [f"spread_{c}" for c in OHLC]
    + ["volume", "tick_volume"]
)


def _pruned(df: DataFrame, candidates: list[str]) -> DataFrame:
    keep = [c for c in ("pair", "timestamp", "seq") if c in df.columns]
    keep += [c for c in candidates if c in df.columns]
    return clean_doubles(df.select(*keep)).withColumn("timestamp", utc(F.col("timestamp")))


def normalize_ticks(df: DataFrame) -> DataFrame:
    """``timestamp, pair, mid[, spread][, seq]`` from mid or bid/ask ticks.

    The choice is made per input, by the columns it has, not per row.
    """
    ticks = _pruned(df, TICK_COLUMNS)
    quoted = {"bid", "ask"} <= set(ticks.columns)
    if "mid" not in ticks.columns:
        if not quoted:
            raise ValueError("tick input is missing mid and bid/ask columns")
        ticks = ticks.withColumn("mid", (F.col("bid") + F.col("ask")) / F.lit(2.0))
    if "spread" not in ticks.columns and quoted:
        ticks = ticks.withColumn("spread", F.col("ask") - F.col("bid"))
    return ticks.drop("bid", "ask")


def row_mean(columns: list[str]) -> Column:
    """Mean of the non-NULL values of a row, NULL when there are none."""
    total, present = F.lit(0.0), F.lit(0)
    for name in columns:
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        present = present + F.col(name).isNotNull().cast("int")
    return F.try_divide(total, present)


def normalize_bars(df: DataFrame) -> DataFrame:
    """``timestamp, pair, OHLC[, spread][, volume]``; mid prices win over plain ones."""
    bars = _pruned(df, BAR_COLUMNS)
    names = set(bars.columns)
    if {f"mid_{c}" for c in OHLC} <= names:
        prices = [F.col(f"mid_{c}").cast("double").alias(c) for c in OHLC]
    elif set(OHLC) <= names:
        prices = [F.col(c).cast("double") for c in OHLC]
    else:
        raise ValueError("bar input is missing OHLC columns")
    extras = []
    spreads = [f"spread_{c}" for c in OHLC if f"spread_{c}" in names]
    if "spread" in names:
        extras.append(F.col("spread").cast("double"))
    elif spreads:
        extras.append(row_mean(spreads).alias("spread"))
    for volume in ("volume", "tick_volume"):
        if volume in names:
            extras.append(F.col(volume).cast("double").alias("volume"))
            break
    keys = [c for c in ("pair", "timestamp", "seq") if c in names]
    return bars.select(*keys, *prices, *extras)

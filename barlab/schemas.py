"""Column contracts shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

# A series is one instrument at one bar length.
SERIES = ["pair", "timeframe"]

# Rows per block when a series is cut into pieces for windows and joins.
# 512 keeps 3 ** 511 (fastest decaying average) inside the double range.
BLOCK = 512

# --- fixed values: timeframe names and their length in seconds, finest first ---
TIMEFRAME_SECONDS = {
    "1m": 60,
    "5m": 300,
    "15m": 900,
    "30m": 1800,
    "1h": 3600,
    "4h": 14400,
    "1d": 86400,
}
TIMEFRAMES = list(TIMEFRAME_SECONDS)

# --- fixed values: instruments known to the layout audit and to the builder ---
TARGET_PAIRS = ["EURUSD", "USDJPY", "GBPUSD", "EURJPY", "AUDUSD", "USDCAD"]

# --- fixed values: column order of a stored candle ---
CANDLE_BASE = ["timestamp", "pair", "timeframe", "open", "high", "low", "close"]
CANDLE_OPTIONAL = ["spread", "tick_count", "volume", "source_kind", "source_timeframe"]

CANDLE_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("pair", T.StringType()),
        T.StructField("timeframe", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("spread", T.DoubleType()),
        T.StructField("tick_count", T.LongType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("source_kind", T.StringType()),
        T.StructField("source_timeframe", T.StringType()),
    ]
)

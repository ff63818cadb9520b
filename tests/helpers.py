"""Small frames for hand-computed cases."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

START = datetime(2025, 1, 1)
STEP = {"15m": timedelta(minutes=15), "1h": timedelta(hours=1), "4h": timedelta(hours=4), "1d": timedelta(days=1)}
CANDLE = "pair STRING, timeframe STRING, timestamp TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE"


def moment(i: int, timeframe: str = "1h") -> datetime:
    return START + i * STEP[timeframe]


def candles(spark, rows, timeframe="1h", pair="EURUSD"):
    """``rows``: (open, high, low, close) per bar."""
    data = [(pair, timeframe, moment(i, timeframe), *map(float, row)) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, CANDLE)


def closes(spark, values, timeframe="1h", pair="EURUSD"):
    return candles(spark, [(v, v, v, v) for v in values], timeframe, pair)


def signals(spark, by_bar, timeframe="1h", pair="EURUSD", short=None, long=None):
    """``by_bar``: {bar: signal}; optional short / long averages per bar."""
    bars = sorted(set(by_bar) | set(range(len(short or []))) | set(range(len(long or []))))
    data = [
        (
            pair,
            timeframe,
            moment(i, timeframe),
            by_bar.get(i, 0),
            None if short is None or short[i] is None else float(short[i]),
            None if long is None or long[i] is None else float(long[i]),
        )
        for i in bars
    ]
    frame = spark.createDataFrame(data, "pair STRING, timeframe STRING, timestamp TIMESTAMP, signal INT, short_sma DOUBLE, long_sma DOUBLE")
    if short is None and long is None:
        frame = frame.drop("short_sma", "long_sma")
    return frame


def settings(timeframe="1h", **changes):
    return {
        "pair": "EURUSD",
        "timeframe": timeframe,
        "strategy_name": "synthetic",
        "start_date": "2025-01-01",
        "end_date": "2025-01-02",
        "initial_capital": 10_000.0,
        "fixed_position_size": 1.0,
        **changes,
    }


def column(df, name, order="timestamp"):
    return [row[name] for row in df.orderBy(order).select(F.col(name)).collect()]

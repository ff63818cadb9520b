"""Chart data as tables: indicator lines in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barlab.functions.indicators import Average, with_indicators
from barlab.schemas import SERIES


def overlay_lines(candles: DataFrame, *, sma_windows: list[int] = (), ema_windows: list[int] = ()) -> DataFrame:
    """(series, timestamp, indicator, value): distinct positive windows, NULL while warming up."""
    chosen = [Average("sma", n) for n in sorted({int(n) for n in sma_windows if int(n) > 0})]
    chosen += [Average("ema", n) for n in sorted({int(n) for n in ema_windows if int(n) > 0})]
    if not chosen:
        return candles.limit(0).select(
            *SERIES, "timestamp", F.lit("").alias("indicator"), F.lit(None).cast("double").alias("value")
        )
    frame = with_indicators(candles, chosen)
    pairs = ", ".join(f"'{a.kind.upper()} {a.period}', {a.column}" for a in chosen)
    return frame.select(*SERIES, "timestamp", F.expr(f"stack({len(chosen)}, {pairs}) AS (indicator, value)"))

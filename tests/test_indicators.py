from __future__ import annotations

import math
import random

import pytest

from barlab.functions.indicators import Average, TrueRangeAverage, index_bars, with_indicators
from barlab.operators.overlays import overlay_lines
from tests.helpers import candles, closes, column


def approx(values):
    return [None if v is None else pytest.approx(v, abs=1e-9) for v in values]


@pytest.mark.parametrize(
    "average, values, expected",
    [
        (Average("sma", 2), [1, 2, 3, 4], [None, 1.5, 2.5, 3.5]),
        (Average("ema", 2), [1, 2, 3, 4], [None, 5 / 3, 2.5555555556, 3.5185185185]),
        (Average("wma", 3), [1, 2, 3, 4, 5], [None, None, 14 / 6, 20 / 6, 26 / 6]),
        (Average("hma", 4), [1, 2, 3, 4, 5, 6], [None] * 4 + [5.0, 6.0]),
    ],
)
def test_average_values(spark, average, values, expected):
    frame = with_indicators(closes(spark, values), [average])
    assert column(frame, average.column) == approx(expected)
    assert column(frame, f"prev_{average.column}") == approx([None, *expected[:-1]])


FRAME = [(9, 10, 8, 9), (9, 11, 8, 10), (10, 12, 9, 11), (11, 13, 10, 12)]


@pytest.mark.parametrize(
    "atr, expected",
    [
        (TrueRangeAverage("wilder", 3), [None, None, 8 / 3, 25 / 9]),
        (TrueRangeAverage("sma", 3), [None, None, 8 / 3, 3.0]),
        (TrueRangeAverage("ema", 3), [None, None, 2.75, 2.875]),
    ],
)
def test_atr_values(spark, atr, expected):
    frame = with_indicators(candles(spark, FRAME), [], [atr])
    assert column(frame, "true_range") == [2, 3, 3, 3]
    assert column(frame, atr.column) == approx(expected)


def test_bad_indicator_settings():
    with pytest.raises(ValueError):
        TrueRangeAverage("median", 3)
    with pytest.raises(ValueError):
        TrueRangeAverage("sma", 0)
    with pytest.raises(ValueError):
        Average("vwma", 3)
    with pytest.raises(ValueError):
        Average("sma", 0)


def test_index_is_dense_across_chunks(spark):
    """1,500 bars in three chunks: numbers, neighbours and series end."""
    rng = random.Random(7)
    values = [rng.uniform(1, 2) for _ in range(1500)]
    rows = index_bars(closes(spark, values, "15m")).orderBy("timestamp").collect()
    assert [r.bar_index for r in rows] == list(range(1500))
    assert [r.prev_close for r in rows] == [None, *values[:-1]]
    assert [r.next_open for r in rows] == [*values[1:], None]
    assert {(r.last_index, r.last_close) for r in rows} == {(1499, values[-1])}


def test_long_series_matches_direct_recurrences(spark):
    rng = random.Random(11)
    values = [100.0]
    for _ in range(1400):
        values.append(round(values[-1] + rng.uniform(-1, 1), 2))
    wanted = [Average(k, n) for k in ("sma", "ema", "wma") for n in (2, 9, 200)]
    rows = with_indicators(closes(spark, values, "15m"), wanted, [TrueRangeAverage("wilder", 14)]).orderBy("timestamp").collect()

    for n in (2, 9, 200):
        ema = values[0]
        for i, value in enumerate(values):
            ema = value if i == 0 else ema + 2 / (n + 1) * (value - ema)
            row = rows[i]
            if i < n - 1:
                assert row[f"sma_{n}"] is None and row[f"ema_{n}"] is None and row[f"wma_{n}"] is None
                continue
            window = values[i - n + 1 : i + 1]
            assert row[f"sma_{n}"] == pytest.approx(math.fsum(window) / n, abs=1e-9)
            assert row[f"ema_{n}"] == pytest.approx(ema, abs=1e-9)
            weighted = math.fsum((j + 1) * v for j, v in enumerate(window)) / (n * (n + 1) / 2)
            assert row[f"wma_{n}"] == pytest.approx(weighted, abs=1e-9)
            if i > n - 1:
                assert row[f"prev_ema_{n}"] == pytest.approx(rows[i - 1][f"ema_{n}"], abs=1e-9)

    ranges = [0.0] + [abs(b - a) for a, b in zip(values, values[1:])]
    atr = sum(ranges[:14]) / 14
    for i in range(13, len(values)):
        if i > 13:
            atr = (atr * 13 + ranges[i]) / 14
        assert rows[i].atr_wilder_14 == pytest.approx(atr, abs=1e-9)


def test_unchanged_closes_give_exact_ties(spark):
    frame = with_indicators(closes(spark, [0.1, 0.7] + [0.3] * 20), [Average("sma", 3), Average("sma", 7), Average("wma", 5)])
    last = frame.orderBy("timestamp").collect()[-1]
    assert last.sma_3 == last.sma_7 == last.wma_5 == 0.3


def test_missing_close(spark):
    series = closes(spark, [1, 2, 3, 4, 5, 6]).selectExpr(
        "pair", "timeframe", "timestamp", "open", "high", "low", "CASE WHEN close = 3 THEN NULL ELSE close END AS close"
    )
    frame = with_indicators(series, [Average("sma", 2)])
    assert column(frame, "sma_2") == [None, 1.5, None, None, 4.5, 5.5]
    with pytest.raises(Exception, match="must not be NULL"):
        with_indicators(series, [Average("ema", 2)]).collect()


def test_overlay_windows_are_distinct_positive_sorted(spark):
    lines = overlay_lines(closes(spark, [1, 2, 3]), sma_windows=[2, 2, -1, 0], ema_windows=[3])
    assert {r.indicator for r in lines.collect()} == {"SMA 2", "EMA 3"}
    assert lines.count() == 6

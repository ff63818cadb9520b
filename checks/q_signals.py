"""Entry signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.functions.indicators import Average, with_indicators
from barlab.operators.signals import generate, ma_strategy, register_strategy, sma_crossover
from checks import duck_sql as D
from checks.feeds import bars
from checks.registry import query, r

OUT = ["pair", "timestamp", "signal", "side", "tag", "strategy_name"]


def _labelled(signal: str, up: str, down: str, strategy: str, source: str, extra: str = "") -> str:
    return f"""SELECT pair, {D.stamp('ts')} AS timestamp, {signal} AS signal, CASE WHEN {signal} > 0 THEN 'long' WHEN {signal} < 0 THEN 'short' ELSE 'flat' END AS side,
    CASE WHEN {signal} > 0 THEN '{up}' WHEN {signal} < 0 THEN '{down}' ELSE '' END AS tag, '{strategy}' AS strategy_name{extra} FROM {source}"""


def _entry(regime: str, window: str = "PARTITION BY pair ORDER BY i") -> str:
    before = f"coalesce(lag({regime}) OVER ({window}), 0)"
    return f"CASE WHEN {regime} = 1 AND {before} <= 0 THEN 1 WHEN {regime} = -1 AND {before} >= 0 THEN -1 ELSE 0 END"


SMA_38 = f"""WITH {D.event_bars('1h')}, av AS (SELECT *, {D.sma('c', 3)} AS s, {D.sma('c', 8)} AS l8 FROM bars),
reg AS (SELECT *, CASE WHEN s > l8 THEN 1 WHEN s < l8 THEN -1 ELSE 0 END AS g FROM av),
sig AS (SELECT *, {_entry('g')} AS sg FROM reg) """


@query("d1_sma_crossover", SMA_38 + _labelled("sg", "sma_cross_up_3_8", "sma_cross_down_3_8", "sma_crossover", "sig", f", {r('s')} AS short_sma, {r('l8')} AS long_sma"))
def d1(spark, sf):
    return sma_crossover(bars(spark, sf, "1h"), short_window=3, long_window=8).select(*OUT, "short_sma", "long_sma")


# Averages in period order: ema 3, sma 8, wma 12.
THREE = f"""WITH RECURSIVE {D.event_bars('1h')}, {D.recurrence('rec', 'bars', 'c', [('e3', 'ema', 3)])},
av AS (SELECT b.pair, b.i, b.ts, b.c, CASE WHEN b.i >= 2 THEN e3 END AS m1, m2, m3 FROM (SELECT *, {D.sma('c', 8)} AS m2, {D.wma('c', 12)} AS m3 FROM bars) b JOIN rec USING (pair, i)),
lagged AS (SELECT *, lag(m1) OVER w AS p1, lag(m2) OVER w AS p2, lag(m3) OVER w AS p3 FROM av WINDOW w AS (PARTITION BY pair ORDER BY i)) """


def _cross(fast: str, slow: str, up: str = "true", down: str = "true") -> str:
    return f"""CASE WHEN coalesce(m{fast} > m{slow} AND p{fast} <= p{slow} AND {up}, false) THEN 1
    WHEN coalesce(m{fast} < m{slow} AND p{fast} >= p{slow} AND {down}, false) THEN -1 ELSE 0 END"""


@query("d2_ma_crossover", THREE + f", sig AS (SELECT *, {_cross('1', '2')} AS sg FROM lagged) " + _labelled("sg", "crossover_long_ema3_sma8", "crossover_short_ema3_sma8", "ma_strategy", "sig"))
def d2(spark, sf):
    return ma_strategy(bars(spark, sf, "1h"), ma_types=["ema", "sma"], ma_periods=[3, 8], entry_type="crossover").select(*OUT)


ABOVE, BELOW = "(c > m1 AND c > m2 AND c > m3)", "(c < m1 AND c < m2 AND c < m3)"
REGIME = f", reg AS (SELECT *, CASE WHEN {ABOVE} THEN 1 WHEN {BELOW} THEN -1 ELSE 0 END AS g FROM lagged)"
TAG3 = "ema3_sma8_wma12"


@query("d3_price_above_all", THREE + REGIME + f", sig AS (SELECT *, {_entry('g')} AS sg FROM reg) " + _labelled("sg", f"price_above_all_long_{TAG3}", f"price_above_all_short_{TAG3}", "ma_strategy", "sig"))
def d3(spark, sf):
    return ma_strategy(
        bars(spark, sf, "1h"), ma_types=["ema", "sma", "wma"], ma_periods=[3, 8, 12], entry_type="price_above_all"
    ).select(*OUT)


@query("d4_crossover_breakout", THREE + f", sig AS (SELECT *, {_cross('1', '3', ABOVE, BELOW)} AS sg FROM lagged) " + _labelled("sg", f"crossover_breakout_long_{TAG3}", f"crossover_breakout_short_{TAG3}", "ma_strategy", "sig"))
def d4(spark, sf):
    return ma_strategy(
        bars(spark, sf, "1h"), ma_types=["ema", "sma", "wma"], ma_periods=[3, 8, 12], entry_type="crossover_breakout"
    ).select(*OUT)


@query(
    "d5_average_order",
    THREE + f"SELECT pair, {D.stamp('ts')} AS timestamp, {r('m1')} AS ma_1, {r('m2')} AS ma_2, {r('m3')} AS ma_3, {r('m1')} AS ma_fast, {r('m3')} AS ma_slow FROM av",
)
def d5(spark, sf):
    """Given longest first; exposed shortest first."""
    return ma_strategy(
        bars(spark, sf, "1h"), ma_types=["wma", "ema", "sma"], ma_periods=[12, 3, 8], entry_type="crossover_breakout"
    ).select("pair", "timestamp", "ma_1", "ma_2", "ma_3", "ma_fast", "ma_slow")


@query(
    "d6_one_sided",
    THREE + REGIME + f""", sig AS (SELECT *, CASE WHEN {_entry('g')} > 0 THEN 1 ELSE 0 END AS lo, CASE WHEN {_entry('g')} < 0 THEN -1 ELSE 0 END AS sh FROM reg)
    SELECT pair, {D.stamp('ts')} AS timestamp, lo AS long_signal, CASE WHEN lo = 1 THEN 'price_above_all_long_{TAG3}' ELSE '' END AS long_tag, sh AS short_signal FROM sig""",
)
def d6(spark, sf):
    rule = dict(ma_types=["ema", "sma", "wma"], ma_periods=[3, 8, 12], entry_type="price_above_all")
    longs = ma_strategy(bars(spark, sf, "1h"), **rule, allow_short=False)
    shorts = ma_strategy(bars(spark, sf, "1h"), **rule, allow_long=False)
    return longs.select("pair", "timestamp", F.col("signal").alias("long_signal"), F.col("tag").alias("long_tag")).join(
        shorts.select("pair", "timestamp", F.col("signal").alias("short_signal")), ["pair", "timestamp"]
    )


def _close_over_average(candles, *, window: int):
    frame = with_indicators(candles, [Average("sma", window)])
    above = (F.col("close") > F.col(f"sma_{window}")) & (F.col("prev_close") <= F.col(f"prev_sma_{window}"))
    return frame.select("pair", "timestamp", F.when(above, 1).otherwise(0).alias("signal"))


@query(
    "d7_registered_strategy",
    f"""WITH {D.event_bars('1h')}, av AS (SELECT *, {D.sma('c', 5)} AS m FROM bars)
    SELECT pair, {D.stamp('ts')} AS timestamp, CASE WHEN c > m AND lag(c) OVER w <= lag(m) OVER w THEN 1 ELSE 0 END AS signal FROM av WINDOW w AS (PARTITION BY pair ORDER BY i)""",
)
def d7(spark, sf):
    """A user's own candles -> signals function, applied by name."""
    register_strategy("close_over_average", _close_over_average)
    return generate(bars(spark, sf, "1h"), "close_over_average", window=5)

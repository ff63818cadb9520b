"""Resampling and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.functions.indicators import Average, TrueRangeAverage, index_bars, true_range, with_indicators
from barlab.operators.overlays import overlay_lines
from barlab.operators.quality import warning_summary
from barlab.operators.resample import (
    bars_to_all_bars,
    bars_to_bars,
    servable,
    targets_for,
    ticks_to_all_bars,
    ticks_to_bars,
)
from barlab.schemas import TIMEFRAMES
from barlab.sources.ticks import normalize_bars, normalize_ticks
from checks import duck_sql as D
from checks.feeds import LINE_FIELDS, bars, derived, event_ticks, line_ticks
from checks.registry import query, r

OHLC = ["pair", "timeframe", "timestamp", "open", "high", "low", "close"]
LINE_ORDER = "l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey"


def _ohlc(source: str, timeframe: str, extra: str = "", order: str = "ts, seq") -> str:
    return f"""SELECT pair, '{timeframe}' AS timeframe, {D.stamp('b')} AS timestamp, {r('o')} AS open, {r('h')} AS high, {r('l')} AS low, {r('c')} AS close{extra and ', ' + extra.split('|')[1]}
FROM (SELECT pair, {D.bucket('ts', timeframe)} AS b, first(mid ORDER BY {order}) FILTER (mid IS NOT NULL) AS o, max(mid) AS h, min(mid) AS l,
        last(mid ORDER BY {order}) FILTER (mid IS NOT NULL) AS c, count(*) AS n{extra and ', ' + extra.split('|')[0]} FROM ({source}) GROUP BY 1, 2) WHERE h IS NOT NULL"""


LINES = f"SELECT {LINE_FIELDS}, l_shipdate AS ts, {LINE_ORDER} FROM lineitem"


@query("b1_ticks_to_bars", _ohlc(D.EVENT_TICKS, "1h"))
def b1(spark, sf):
    return ticks_to_bars(event_ticks(spark, sf), "1h").select(*OHLC)


@query("b1_ties_and_gaps", _ohlc(LINES, "1d", order=f"ts, {LINE_ORDER}"))
def b1_ties(spark, sf):
    return ticks_to_bars(line_ticks(spark, sf), "1d").select(*OHLC)


@query("b2_mean_spread", _ohlc(LINES, "1d", f"avg(spread) AS sp|{r('sp')} AS spread", order=f"ts, {LINE_ORDER}"))
def b2(spark, sf):
    return ticks_to_bars(line_ticks(spark, sf), "1d").select(*OHLC, "spread")


@query("b3_tick_count", _ohlc(LINES, "1d", "1 AS z|n AS tick_count", order=f"ts, {LINE_ORDER}"))
def b3(spark, sf):
    return ticks_to_bars(line_ticks(spark, sf), "1d").select(*OHLC, "tick_count")


# Hourly bars with missing opens, spreads and volumes.
def _gappy(spark, sf):
    number = F.hour("timestamp") + F.dayofmonth("timestamp")
    return bars(spark, sf, "1h").select(
        "pair", "timestamp",
        F.when(number % 5 != 0, F.col("open")).alias("open"), "high", "low",
        F.when(number % 7 != 0, F.col("close")).alias("close"),
        F.when(number % 3 != 0, F.col("high") - F.col("low")).alias("spread"),
        F.when(F.dayofmonth("timestamp") % 2 == 0, F.col("tick_count").cast("double")).alias("volume"),
    )


GAPPY = f"""{D.event_bars('1h')},
gappy AS (SELECT pair, ts, CASE WHEN (hour(ts) + day(ts)) % 5 <> 0 THEN o END AS o, h, l, CASE WHEN (hour(ts) + day(ts)) % 7 <> 0 THEN c END AS c,
  CASE WHEN (hour(ts) + day(ts)) % 3 <> 0 THEN h - l END AS sp, CASE WHEN day(ts) % 2 = 0 THEN n END AS v FROM bars)"""


def _fold(timeframe: str) -> str:
    return f"""SELECT pair, '{timeframe}' AS timeframe, {D.stamp('b')} AS timestamp, {r('o')} AS open, {r('h')} AS high, {r('l')} AS low, {r('c')} AS close,
  {r('sp')} AS spread, {r('v')} AS volume
FROM (SELECT pair, {D.bucket('ts', timeframe)} AS b, first(o ORDER BY ts) FILTER (o IS NOT NULL) AS o, max(h) AS h, min(l) AS l,
  last(c ORDER BY ts) FILTER (c IS NOT NULL) AS c, avg(sp) AS sp, coalesce(sum(v), 0)::DOUBLE AS v FROM gappy GROUP BY 1, 2)
WHERE o IS NOT NULL AND c IS NOT NULL"""


@query("b4_bars_to_bars", f"WITH {GAPPY} {_fold('4h')}")
def b4(spark, sf):
    return bars_to_bars(_gappy(spark, sf), "4h", "1h").select(*OHLC, "spread", "volume")


@query(
    "b6_fan_out_ticks",
    " UNION ALL ".join(f"({_ohlc(D.EVENT_TICKS, tf, '1 AS z|n AS tick_count')})" for tf in TIMEFRAMES),
)
def b6(spark, sf):
    return ticks_to_all_bars(event_ticks(spark, sf)).select(*OHLC, "tick_count")


@query("b6_fan_out_spread", " UNION ALL ".join(
    f"({_ohlc(LINES, tf, 'avg(spread) AS sp|' + r('sp') + ' AS spread, n AS tick_count', order=f'ts, {LINE_ORDER}')})" for tf in ("4h", "1d")
))
def b6_spread(spark, sf):
    return ticks_to_all_bars(line_ticks(spark, sf), ["1d", "4h"]).select(*OHLC, "spread", "tick_count")


@query(
    "b6_fan_out_bars",
    f"""WITH {GAPPY} SELECT pair, '1h' AS timeframe, {D.stamp('ts')} AS timestamp, {r('o')} AS open, {r('h')} AS high, {r('l')} AS low, {r('c')} AS close,
    {r('sp')} AS spread, {r('v')} AS volume FROM gappy UNION ALL ({_fold('4h')}) UNION ALL ({_fold('1d')})""",
)
def b6_bars(spark, sf):
    return bars_to_all_bars(_gappy(spark, sf), "1h").select(*OHLC, "spread", "volume")


_RANK = "CASE {0} WHEN 'tick' THEN -1 WHEN '1m' THEN 0 WHEN '5m' THEN 1 WHEN '15m' THEN 2 WHEN '30m' THEN 3 WHEN '1h' THEN 4 WHEN '4h' THEN 5 ELSE 6 END"
_SOURCES = """SELECT event_type AS pair, CASE event_type WHEN 'click' THEN 'tick' WHEN 'view' THEN '5m' WHEN 'error' THEN '1h' WHEN 'signup' THEN '4h' ELSE '1d' END AS source_timeframe, count(*) AS rows FROM events GROUP BY event_type"""


@query(
    "b7_skip_finer_targets",
    f"""SELECT pair, source_timeframe, timeframe, ticks FROM (SELECT pair, source_timeframe, rows AS ticks, unnest(['1m','5m','15m','30m','1h','4h','1d']) AS timeframe FROM ({_SOURCES}))
    WHERE {_RANK.format('timeframe')} >= {_RANK.format('source_timeframe')}""",
)
def b7(spark, sf):
    sources = derived(spark, sf, _SOURCES, "events")
    targets = sources.withColumn("timeframe", F.explode(F.array(*[F.lit(tf) for tf in TIMEFRAMES])))
    assert targets_for("4h") == ["4h", "1d"]
    return targets.where(servable(targets)).select("pair", "source_timeframe", "timeframe", F.col("rows").alias("ticks"))


@query("b8_bars_across_batches", _ohlc(D.EVENT_TICKS, "4h", "1 AS z|n AS tick_count"))
def b8(spark, sf):
    """Ticks of a bucket arriving in many pieces give one bar."""
    pieces = event_ticks(spark, sf).repartition(16)
    fine = ticks_to_bars(pieces, "15m")
    counted = fine.groupBy("pair", F.window("timestamp", "4 hours").start.alias("timestamp")).agg(F.sum("tick_count").alias("tick_count"))
    return bars_to_bars(fine, "4h", "15m").select(*OHLC).join(counted, ["pair", "timestamp"])


@query(
    "a9_normalize_quotes",
    f"""SELECT pair, {D.stamp('ts')} AS timestamp, count(*) AS ticks, {r('sum((bid + ask) / 2)')} AS mids, {r('sum(ask - bid)')} AS spreads
    FROM ({LINES}) GROUP BY 1, 2""",
)
def a9(spark, sf):
    ticks = normalize_ticks(line_ticks(spark, sf).drop("mid", "spread"))
    return ticks.groupBy("pair", "timestamp").agg(
        F.count(F.lit(1)).alias("ticks"), F.sum("mid").alias("mids"), F.sum("spread").alias("spreads")
    )


@query(
    "a9_normalize_mids",
    f"""SELECT pair, {D.stamp('ts')} AS timestamp, count(*) AS ticks, count(mid) AS priced, {r('sum(mid)')} AS mids, {r('sum(spread)')} AS spreads
    FROM ({LINES}) GROUP BY 1, 2""",
)
def a9_mid(spark, sf):
    ticks = normalize_ticks(line_ticks(spark, sf))
    return ticks.groupBy("pair", "timestamp").agg(
        F.count(F.lit(1)).alias("ticks"), F.count("mid").alias("priced"), F.sum("mid").alias("mids"), F.sum("spread").alias("spreads")
    )


@query(
    "a10_normalize_bars",
    f"""WITH {D.event_bars('1h')}, raw AS (SELECT *, CASE WHEN hour(ts) % 2 = 0 THEN h - l END AS s1, CASE WHEN hour(ts) % 3 = 0 THEN abs(o - c) END AS s2,
      CASE WHEN hour(ts) % 5 = 0 THEN 1.0 END AS s3 FROM bars)
    SELECT pair, {D.stamp('ts')} AS timestamp, {r('o + 1')} AS open, {r('h + 1')} AS high, {r('l + 1')} AS low, {r('c + 1')} AS close, {r('n::DOUBLE')} AS volume,
      {r("(coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0)) / nullif((s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT, 0)")} AS spread FROM raw""",
)
def a10(spark, sf):
    hour = F.hour("timestamp")
    raw = bars(spark, sf, "1h").drop("spread", "volume").withColumns(
        {
            **{f"mid_{c}": F.col(c) + 1 for c in ("open", "high", "low", "close")},
            "spread_open": F.when(hour % 2 == 0, F.col("high") - F.col("low")),
            "spread_high": F.when(hour % 3 == 0, F.abs(F.col("open") - F.col("close"))),
            "spread_close": F.when(hour % 5 == 0, F.lit(1.0)),
            "tick_volume": F.col("tick_count"),
        }
    )
    return normalize_bars(raw).select("pair", "timestamp", "open", "high", "low", "close", "volume", "spread")


# --- indicators on hourly bars ---
def _indicated(spark, sf, averages=(), atrs=()):
    columns = [a.column for a in (*averages, *atrs)]
    return with_indicators(bars(spark, sf, "1h"), list(averages), list(atrs)).select("pair", "timestamp", "bar_index", *columns)


def _windowed(columns: dict[str, str], source: str = "bars", ctes: str = "") -> str:
    shown = ", ".join(f"{r(sql)} AS {name}" for name, sql in columns.items())
    return f"WITH {D.event_bars('1h')}{ctes} SELECT pair, {D.stamp('ts')} AS timestamp, i AS bar_index, {shown} FROM {source}"


TR = f", tr AS (SELECT *, {D.true_range()} AS tr FROM bars)"


def _recursive(value: str, specs: list[tuple[str, str, int]]) -> str:
    masked = ", ".join(f"{r(f'CASE WHEN t.i >= {n - 1} THEN {column} END')} AS {column}" for column, _, n in specs)
    return f"""WITH RECURSIVE {D.event_bars('1h')}{TR}, {D.recurrence('rec', 'tr', value, specs)}
    SELECT t.pair, {D.stamp('t.ts')} AS timestamp, t.i AS bar_index, {masked} FROM tr t JOIN rec USING (pair, i)"""


@query("c1_sma", _windowed({"sma_3": D.sma("c", 3), "sma_25": D.sma("c", 25), "sma_100": D.sma("c", 100)}))
def c1(spark, sf):
    return _indicated(spark, sf, [Average("sma", n) for n in (3, 25, 100)])


@query("c2_ema", _recursive("c", [("ema_1", "ema", 1), ("ema_3", "ema", 3), ("ema_25", "ema", 25), ("ema_100", "ema", 100)]))
def c2(spark, sf):
    return _indicated(spark, sf, [Average("ema", n) for n in (1, 3, 25, 100)])


@query("c3_wma", _windowed({"wma_3": D.wma("c", 3), "wma_14": D.wma("c", 14), "wma_70": D.wma("c", 70)}))
def c3(spark, sf):
    return _indicated(spark, sf, [Average("wma", n) for n in (3, 14, 70)])


def _hull(n: int) -> str:
    half, root = n // 2, int(n**0.5)
    return f""", h{n} AS (SELECT pair, i, {D.wma('x', root, first=n - 1)} AS hma_{n} FROM (SELECT pair, i, 2 * ({D.wma('c', half)}) - ({D.wma('c', n)}) AS x FROM bars))"""


@query(
    "c4_hma",
    f"""WITH {D.event_bars('1h')}{_hull(9)}{_hull(16)} SELECT pair, {D.stamp('ts')} AS timestamp, i AS bar_index, {r('hma_9')} AS hma_9, {r('hma_16')} AS hma_16
    FROM bars JOIN h9 USING (pair, i) JOIN h16 USING (pair, i)""",
)
def c4(spark, sf):
    return _indicated(spark, sf, [Average("hma", n) for n in (9, 16)])


@query("c5_true_range", _windowed({"true_range": "tr"}, "tr", TR))
def c5(spark, sf):
    frame = index_bars(bars(spark, sf, "1h"))
    return frame.select("pair", "timestamp", "bar_index", true_range().alias("true_range"))


@query("c6_atr_wilder", _recursive("tr", [("atr_wilder_2", "wilder", 2), ("atr_wilder_14", "wilder", 14), ("atr_wilder_50", "wilder", 50)]))
def c6(spark, sf):
    return _indicated(spark, sf, atrs=[TrueRangeAverage("wilder", n) for n in (2, 14, 50)])


@query("c7_atr_ema", _recursive("tr", [("atr_ema_5", "ema", 5), ("atr_ema_14", "ema", 14)]))
def c7(spark, sf):
    return _indicated(spark, sf, atrs=[TrueRangeAverage("ema", n) for n in (5, 14)])


@query("c8_atr_sma", _windowed({"atr_sma_5": D.sma("tr", 5), "atr_sma_14": D.sma("tr", 14)}, "tr", TR))
def c8(spark, sf):
    return _indicated(spark, sf, atrs=[TrueRangeAverage("sma", n) for n in (5, 14)])


@query(
    "c9_shared_averages",
    f"""WITH RECURSIVE {D.event_bars('1h')}, {D.recurrence('rec', 'bars', 'c', [('ema_9', 'ema', 9), ('ema_21', 'ema', 21)])}
    SELECT pair, {D.stamp('ts')} AS timestamp, i AS bar_index, {r(D.sma('c', 9))} AS sma_9, {r(D.wma('c', 9))} AS wma_9,
    {r('CASE WHEN i >= 8 THEN ema_9 END')} AS ema_9, {r('CASE WHEN i >= 20 THEN ema_21 END')} AS ema_21 FROM bars JOIN rec USING (pair, i)""",
)
def c9(spark, sf):
    """Requested twice, computed once, all in one pass."""
    wanted = [Average("sma", 9), Average("ema", 9), Average("wma", 9), Average("ema", 21), Average("ema", 9)]
    return with_indicators(bars(spark, sf, "1h"), wanted).select("pair", "timestamp", "bar_index", "sma_9", "wma_9", "ema_9", "ema_21")


@query(
    "e1_overlay_lines",
    f"""WITH RECURSIVE {D.event_bars('1h')}, {D.recurrence('rec', 'bars', 'c', [('e5', 'ema', 5)])},
    wide AS (SELECT pair, ts, {D.sma('c', 3)} AS s3, {D.sma('c', 20)} AS s20, CASE WHEN i >= 4 THEN e5 END AS e5 FROM bars JOIN rec USING (pair, i))
    SELECT pair, '1h' AS timeframe, {D.stamp('ts')} AS timestamp, indicator, {r('value')} AS value FROM (
      SELECT pair, ts, 'SMA 3' AS indicator, s3 AS value FROM wide UNION ALL SELECT pair, ts, 'SMA 20', s20 FROM wide UNION ALL SELECT pair, ts, 'EMA 5', e5 FROM wide)""",
)
def e1(spark, sf):
    return overlay_lines(bars(spark, sf, "1h"), sma_windows=[20, 3, 3, -1], ema_windows=[5])


@query(
    "e2_compare_timeframes",
    " UNION ALL ".join(
        f"SELECT pair, '{tf}' AS timeframe, count(*) AS bars, 0 AS warnings FROM (SELECT DISTINCT event_type AS pair, {D.bucket('ts', tf)} AS b FROM events) GROUP BY 1"
        for tf in TIMEFRAMES
    ),
)
def e2(spark, sf):
    every = ticks_to_all_bars(event_ticks(spark, sf)).withColumn("seq", F.unix_seconds("timestamp"))
    return warning_summary(every)

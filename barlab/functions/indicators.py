"""Moving averages and average true range for all series at once.

Two exchanges of the bars, whatever the number of indicators:

1. ``index_bars`` cuts each series by time into chunks of at most ``BLOCK``
   buckets, numbers the bars densely and attaches each bar's neighbours.
2. ``with_indicators`` cuts by that number into blocks, lends every block the
   last rows of its predecessors (the *lead-in*), and reads moving windows as
   short frames or, from ``LONG_FRAME`` rows on, as differences of block-local
   running sums, so the cost per bar does not grow with the period.

A long series is therefore spread over many tasks; only one row per chunk or
block ever meets in a per-series window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.functions.recurrence import Decay, block_carries, power
from barlab.functions.timeframes import seconds_of
from barlab.schemas import BLOCK, SERIES

# --- fixed values: supported averages ---
MA_TYPES = ("sma", "ema", "wma", "hma")
ATR_METHODS = ("wilder", "sma", "ema")

# Frames longer than this are read from running sums.
LONG_FRAME = 64

INDEX_COLUMNS = [
    "bar_index",
    "prev_close",
    "next_open",
    "next_timestamp",
    "last_index",
    "last_close",
    "last_timestamp",
]


@dataclass(frozen=True)
class Average:
    """One moving average, for example ``Average("ema", 25)``."""

    kind: str
    period: int

    def __post_init__(self):
        if self.kind not in MA_TYPES:
            raise ValueError(f"Unsupported ma_type: {self.kind!r}. Supported types: {', '.join(sorted(MA_TYPES))}.")
        if not isinstance(self.period, int) or self.period <= 0:
            raise ValueError("MA period must be a positive integer.")

    @property
    def column(self) -> str:
        return f"{self.kind}_{self.period}"


@dataclass(frozen=True)
class TrueRangeAverage:
    """One average true range, for example ``TrueRangeAverage("wilder", 14)``."""

    method: str = "wilder"
    period: int = 14

    def __post_init__(self):
        if self.method not in ATR_METHODS:
            raise ValueError(
                f"Unsupported ATR method: {self.method!r}. Supported methods: {', '.join(sorted(ATR_METHODS))}."
            )
        if not isinstance(self.period, int) or self.period <= 0:
            raise ValueError("ATR period must be a positive integer.")

    @property
    def column(self) -> str:
        return f"atr_{self.method}_{self.period}"


def whole_blocks(number: Column, size: Column | int = BLOCK) -> Column:
    """Integer quotient, rounded down also below zero."""
    length = F.lit(size) if isinstance(size, int) else size
    return ((number - F.pmod(number, length)) / length).cast("bigint")


def index_bars(candles: DataFrame) -> DataFrame:
    """Dense ``bar_index`` per series plus each bar's neighbours and series end.

    Neighbours across chunk edges come from a one-row-per-chunk summary, so no
    task sorts a whole series.
    """
    span = F.coalesce(seconds_of(F.col("timeframe")), F.lit(86400)).cast("bigint") * F.lit(BLOCK)
    chunked = candles.withColumn("chunk", whole_blocks(F.unix_seconds("timestamp"), span))
    summary = chunked.groupBy(*SERIES, "chunk").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max_by(F.struct("close", "timestamp"), F.col("timestamp")).alias("tail"),
        F.min_by(F.struct("open", "timestamp"), F.col("timestamp")).alias("head"),
    )
    ordered = Window.partitionBy(*SERIES).orderBy("chunk")
    whole = Window.partitionBy(*SERIES)
    edges = summary.select(
        *SERIES,
        "chunk",
        (F.sum("rows").over(ordered) - F.col("rows")).alias("rows_before"),
        F.lag("tail").over(ordered)["close"].alias("tail_before"),
        F.lead("head").over(ordered).alias("head_after"),
        (F.sum("rows").over(whole) - 1).alias("last_index"),
        F.max_by("tail", "chunk").over(whole).alias("end"),
    )
    inside = Window.partitionBy(*SERIES, "chunk").orderBy("timestamp")
    following = F.coalesce(F.lead(F.struct("open", "timestamp")).over(inside), F.col("head_after"))
    first_row = F.row_number().over(inside) == 1
    return (
        chunked.join(edges, [*SERIES, "chunk"])
        .withColumn("bar_index", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("prev_close", F.when(first_row, F.col("tail_before")).otherwise(F.lag("close").over(inside)))
        .withColumn("following", following)
        .select(
            *candles.columns,
            "bar_index",
            "prev_close",
            F.col("following.open").alias("next_open"),
            F.col("following.timestamp").alias("next_timestamp"),
            "last_index",
            F.col("end.close").alias("last_close"),
            F.col("end.timestamp").alias("last_timestamp"),
        )
    )


def true_range() -> Column:
    """Largest of high-low and the two distances to the previous close."""
    return F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - F.col("prev_close")),
        F.abs(F.col("low") - F.col("prev_close")),
    )


def _half(period: int) -> int:
    return max(period // 2, 1)


def _root(period: int) -> int:
    return max(math.isqrt(period), 1)


class _Block:
    """Moving sums inside one block and its lead-in rows."""

    def __init__(self):
        self.order = Window.partitionBy(*SERIES, "block").orderBy("bar_index")
        self.grow = self.order.rowsBetween(Window.unboundedPreceding, 0)

    def running(self, term: Column) -> Column:
        return F.coalesce(F.sum(term).over(self.grow), F.lit(0.0))

    def moving(self, source: str, length: int) -> Column:
        """Sum of the last ``length`` values; ``sum_<source>`` is their running sum."""
        if length <= LONG_FRAME:
            return F.sum(source).over(self.order.rowsBetween(-(length - 1), 0))
        return F.col(f"sum_{source}") - F.coalesce(F.lag(f"sum_{source}", length).over(self.order), F.lit(0.0))

    def mean(self, source: str, length: int) -> Column:
        return self.moving(source, length) / F.lit(float(length))

    def weighted_mean(self, source: str, length: int) -> Column:
        """Weights 1..length, oldest first; ``ramp_<source>`` is value times position."""
        ramp = self.moving(f"ramp_{source}", length)
        level = self.moving(source, length)
        return (ramp - (F.col("pos") - F.lit(length)) * level) / F.lit(length * (length + 1) / 2.0)

    def sums(self, sources: list[str]) -> dict[str, Column]:
        return {f"sum_{source}": self.running(F.col(source)) for source in sources}

    def before(self, value: Column) -> Column:
        return F.lag(value).over(self.order)


def _ema_decay(name: str, period: int) -> Decay:
    return Decay(name, 1.0 - 2.0 / (period + 1.0), period)


def with_indicators(
    candles: DataFrame,
    averages: list[Average] = (),
    atrs: list[TrueRangeAverage] = (),
) -> DataFrame:
    """Add every requested average, its value on the previous bar, and every ATR.

    Columns: ``<kind>_<n>`` and ``prev_<kind>_<n>`` per average,
    ``atr_<method>_<n>`` per ATR, plus ``INDEX_COLUMNS``.  Values are NULL until
    enough bars exist.  A NULL close leaves simple and weighted averages NULL as
    long as it is in reach; exponential and Wilder averages reject it.
    """
    averages = sorted(set(averages), key=lambda a: (a.period, a.kind))
    atrs = sorted(set(atrs), key=lambda a: (a.period, a.method))
    bars = candles if set(INDEX_COLUMNS) <= set(candles.columns) else index_bars(candles)
    if not averages and not atrs:
        return bars
    bars = bars.withColumn("true_range", true_range())

    sums = {a for a in averages if a.kind in ("sma", "wma", "hma")}
    exponential = [a for a in averages if a.kind == "ema" and a.period > 1]
    decays: dict[Decay, Column] = {}
    def present(source: str) -> Column:
        problem = F.raise_error(F.lit(f"{source} must not be NULL in an exponential or Wilder average"))
        return F.coalesce(F.col(source), problem.cast("double"))

    def alpha_input(source: str, period: int) -> Column:
        weight = F.when(F.col("bar_index") == 0, F.lit(1.0)).otherwise(F.lit(2.0 / (period + 1.0)))
        return present(source) * weight

    for average in exponential:
        decays[_ema_decay(average.column, average.period)] = alpha_input("close", average.period)
    for atr in atrs:
        if atr.period == 1:
            continue
        if atr.method == "ema":
            decays[_ema_decay(atr.column, atr.period)] = alpha_input("true_range", atr.period)
        elif atr.method == "wilder":
            factor = (atr.period - 1.0) / atr.period
            share = present("true_range") / F.lit(float(atr.period))
            # The seed is a plain mean: undo the decay the first n terms meet on the way to it.
            seeded = share * power(factor, F.least(F.col("bar_index") - F.lit(atr.period - 1), F.lit(0)))
            decays[Decay(atr.column, factor, atr.period)] = seeded

    lead_in = 1
    for average in sums:
        lead_in = max(lead_in, average.period + (_root(average.period) if average.kind == "hma" else 0) + 1)
    for atr in atrs:
        if atr.method == "sma":
            lead_in = max(lead_in, atr.period)

    number = F.col("bar_index")
    home = whole_blocks(number)
    carried = None
    if decays:
        positioned = bars.withColumn("block", home).withColumn("pos", F.pmod(number, F.lit(BLOCK)))
        carried = block_carries(positioned, decays)

    reached = F.least(whole_blocks(number + F.lit(lead_in)), whole_blocks(F.col("last_index")))
    lent = (
        bars.withColumn("block", F.explode(F.sequence(home, reached)))
        .withColumn("own", F.col("block") == home)
        .withColumn("pos", number - F.col("block") * F.lit(BLOCK))
    )

    block = _Block()
    moved = F.when(~F.col("close").eqNullSafe(F.col("prev_close")), number)
    lent = lent.withColumn("ramp_close", F.col("close") * F.col("pos"))
    frame = lent.withColumns(
        {
            **block.sums(["close", "ramp_close", "true_range"]),
            "last_missing": F.max(F.when(F.col("close").isNull(), number)).over(block.grow),
            "still_since": F.coalesce(F.max(moved).over(block.grow), F.min(number).over(block.grow)),
            **{
                f"loc_{decay.name}": F.sum(F.when(F.col("own"), term * power(decay.factor, -F.col("pos")))).over(block.grow)
                * power(decay.factor, F.col("pos"))
                for decay, term in decays.items()
            },
        }
    )

    # A missing close is in reach while fewer than ``length`` bars have passed since.
    complete_since = F.coalesce(F.col("last_missing"), F.lit(-1))

    def warm(length: int, value: Column) -> Column:
        return F.when(number - complete_since >= F.lit(length), value)

    def settled(length: int, value: Column) -> Column:
        """Over unchanged closes an average is that close, free of rounding."""
        still = number - F.col("still_since") >= F.lit(length - 1)
        return warm(length, F.when(still, F.col("close")).otherwise(value))

    values: dict[str, Column] = {}
    hulls = [a for a in averages if a.kind == "hma"]
    for average in averages:
        n = average.period
        if average.kind == "sma":
            values[average.column] = settled(n, block.mean("close", n))
        elif average.kind == "wma":
            values[average.column] = settled(n, block.weighted_mean("close", n))
        elif average.kind == "ema" and n == 1:
            values[average.column] = F.col("close")
        elif average.kind == "hma":
            hull = F.lit(2.0) * block.weighted_mean("close", _half(n)) - block.weighted_mean("close", n)
            values[f"hull_{n}"] = warm(n, hull)
    for atr in atrs:
        if atr.period == 1:
            values[atr.column] = F.col("true_range")
        elif atr.method == "sma":
            values[atr.column] = warm(atr.period, block.mean("true_range", atr.period))
    frame = frame.withColumns(values)

    if hulls:
        frame = frame.withColumns({f"ramp_hull_{a.period}": F.col(f"hull_{a.period}") * F.col("pos") for a in hulls})
        sources = [f"{kind}hull_{a.period}" for a in hulls for kind in ("", "ramp_")]
        frame = frame.withColumns(block.sums(sources))
        frame = frame.withColumns(
            {
                a.column: settled(
                    a.period + _root(a.period) - 1, block.weighted_mean(f"hull_{a.period}", _root(a.period))
                )
                for a in hulls
            }
        )

    earlier = {
        f"prev_{a.column}": block.before(F.col(a.column))
        for a in averages
        if a not in exponential
    }
    earlier |= {f"before_{a.column}": block.before(F.col(f"loc_{a.column}")) for a in exponential}
    frame = frame.withColumns(earlier).where("own")

    if carried is not None:
        frame = frame.join(carried, [*SERIES, "block"], "left")
        finished: dict[str, Column] = {}
        for decay in decays:
            carry = F.coalesce(F.col(f"carry_{decay.name}"), F.lit(0.0))
            finished[decay.name] = F.when(
                number >= F.lit(decay.warmup - 1),
                F.col(f"loc_{decay.name}") + power(decay.factor, F.col("pos") + 1) * carry,
            )
        for a in exponential:
            factor = _ema_decay(a.column, a.period).factor
            carry = F.coalesce(F.col(f"carry_{a.column}"), F.lit(0.0))
            finished[f"prev_{a.column}"] = F.when(
                number >= F.lit(a.period),
                F.coalesce(F.col(f"before_{a.column}"), F.lit(0.0)) + power(factor, F.col("pos")) * carry,
            )
        frame = frame.withColumns(finished)

    wanted = [a.column for a in averages] + [f"prev_{a.column}" for a in averages] + [a.column for a in atrs]
    return frame.select(*bars.columns, *wanted)

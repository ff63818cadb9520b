"""Linear recurrences y[t] = d * y[t-1] + b[t] as block-wise sums.

A series is cut into blocks of ``BLOCK`` bars.  Inside a block the value is
``d**p * sum(b[j] * d**-j)``, a running sum; what earlier blocks leave behind is
one number per block, the *carry*, folded from the block totals.  The fold has two
levels, blocks inside a span of ``BLOCK`` blocks and spans, and leaves no old value out.
No task ever holds more than one block of bars or one row per span of a series.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.schemas import BLOCK, SERIES


@dataclass(frozen=True)
class Decay:
    """One recurrence: its name, decay factor and warm-up length."""

    name: str
    factor: float
    warmup: int

    @property
    def block(self) -> float:
        """Decay over a whole block."""
        return self.factor**BLOCK


def power(base: float, exponent: Column) -> Column:
    return F.pow(F.lit(base), exponent)


def _fold(ends: Column, step: float) -> Column:
    return F.aggregate(ends, F.lit(0.0), lambda total, end: total * F.lit(step) + end)


def block_carries(bars: DataFrame, terms: dict[Decay, Column]) -> DataFrame:
    """Value of every recurrence just before each block starts.

    ``bars`` has the series keys, ``block`` and ``pos`` (position in the block);
    ``terms`` maps each recurrence to its input term b.
    """
    totals = bars.groupBy(*SERIES, "block").agg(
        *[
            F.coalesce(F.sum(term * power(decay.factor, F.lit(BLOCK - 1) - F.col("pos"))), F.lit(0.0)).alias(decay.name)
            for decay, term in terms.items()
        ]
    )
    totals = totals.withColumn("span", F.floor(F.col("block") / F.lit(BLOCK))).withColumn("place", F.pmod("block", F.lit(BLOCK)))
    inside = _carries(totals, [*SERIES, "span"], "block", {d.name: d.block for d in terms}, ["place"])
    ends = totals.groupBy(*SERIES, "span").agg(
        *[F.sum(F.col(d.name) * power(d.block, F.lit(BLOCK - 1) - F.col("place"))).alias(d.name) for d in terms]
    )
    before = _carries(ends, SERIES, "span", {d.name: d.block**BLOCK for d in terms}, []).withColumnsRenamed(
        {f"carry_{d.name}": f"span_{d.name}" for d in terms}
    )
    whole = [
        (F.col(f"carry_{d.name}") + power(d.block, F.col("place")) * F.col(f"span_{d.name}")).alias(f"carry_{d.name}") for d in terms
    ]
    return inside.join(before, [*SERIES, "span"]).select(*SERIES, "block", *whole)


def _carries(totals: DataFrame, keys: list[str], at: str, steps: dict[str, float], kept: list[str]) -> DataFrame:
    """What all earlier rows of the same ``keys`` leave behind, as ``carry_<name>``."""
    order = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    carries = [_fold(F.collect_list(name).over(order), step).alias(f"carry_{name}") for name, step in steps.items()]
    return totals.select(*dict.fromkeys([*keys, at, *kept]), *carries)

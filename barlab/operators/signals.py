"""Entry signals.

Each rule is a row expression over a bar's averages and the previous bar's
(``prev_*``), which ``with_indicators`` supplies; no window is needed here.
A strategy is any ``candles -> signals`` DataFrame function; ``STRATEGIES`` is
the registry, ``generate`` applies one with ``DataFrame.transform``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from barlab.functions.indicators import Average, with_indicators
from barlab.schemas import SERIES

# --- fixed values: entry rules of the moving-average strategy ---
ENTRY_TYPES = ("crossover", "price_above_all", "crossover_breakout")

SIGNAL_COLUMNS = ["timestamp", "signal", "side", "tag", "strategy_name"]


def _sign(up: Column, down: Column) -> Column:
    return F.when(up, F.lit(1)).when(down, F.lit(-1)).otherwise(F.lit(0))


def regime_entry(regime: Column, previous: Column, allow_long: bool, allow_short: bool) -> Column:
    """+1 / -1 on the bar where the regime turns up / down, also from neutral."""
    before = F.coalesce(previous, F.lit(0))
    return _sign(
        F.lit(allow_long) & (regime == 1) & (before <= 0),
        F.lit(allow_short) & (regime == -1) & (before >= 0),
    )


def _labels(signal: Column, long_tag: str, short_tag: str, strategy: str) -> list[Column]:
    return [
        signal.cast("int").alias("signal"),
        F.when(signal > 0, "long").when(signal < 0, "short").otherwise("flat").alias("side"),
        F.when(signal > 0, long_tag).when(signal < 0, short_tag).otherwise("").alias("tag"),
        F.lit(strategy).alias("strategy_name"),
    ]


def sma_crossover(
    candles: DataFrame, *, short_window: int, long_window: int, allow_long: bool = True, allow_short: bool = True
) -> DataFrame:
    """Regime of short over long SMA; a signal on each regime change."""
    if short_window <= 0 or long_window <= 0:
        raise ValueError("short_window and long_window must be positive integers.")
    if short_window >= long_window:
        raise ValueError("short_window must be strictly less than long_window.")
    short, long = Average("sma", short_window), Average("sma", long_window)
    frame = with_indicators(candles, [short, long])
    side_of = lambda prefix: _sign(
        F.col(prefix + short.column) > F.col(prefix + long.column),
        F.col(prefix + short.column) < F.col(prefix + long.column),
    )
    signal = regime_entry(side_of(""), side_of("prev_"), allow_long, allow_short)
    return frame.select(
        *SERIES,
        "timestamp",
        *_labels(
            signal,
            f"sma_cross_up_{short_window}_{long_window}",
            f"sma_cross_down_{short_window}_{long_window}",
            "sma_crossover",
        ),
        F.col(short.column).alias("short_sma"),
        F.col(long.column).alias("long_sma"),
    )


@dataclass(frozen=True)
class MaRule:
    """A moving-average entry rule; averages are kept sorted by period, then input order."""

    averages: tuple[Average, ...]
    entry_type: str
    allow_long: bool = True
    allow_short: bool = True

    @classmethod
    def of(cls, ma_types, ma_periods, entry_type, allow_long=True, allow_short=True) -> MaRule:
        if len(ma_types) != len(ma_periods):
            raise ValueError("ma_types and ma_periods must have the same length.")
        if len(ma_types) not in (2, 3):
            raise ValueError("Exactly 2 or 3 moving averages are supported.")
        entry = entry_type.strip().lower()
        if entry not in ENTRY_TYPES:
            raise ValueError(
                f"Unsupported entry_type: {entry_type!r}. Supported types: {', '.join(sorted(ENTRY_TYPES))}."
            )
        if entry == "crossover" and len(ma_types) != 2:
            raise ValueError("entry_type='crossover' supports exactly 2 moving averages.")
        averages = [Average(kind.strip().lower(), int(n)) for kind, n in zip(ma_types, ma_periods)]
        return cls(tuple(sorted(averages, key=lambda a: a.period)), entry, allow_long, allow_short)

    @property
    def fast(self) -> Average:
        return self.averages[0]

    @property
    def slow(self) -> Average:
        return self.averages[-1]

    @property
    def suffix(self) -> str:
        return "_".join(f"{a.kind}{a.period}" for a in self.averages)

    def beyond_all(self, prefix: str, close: str) -> tuple[Column, Column]:
        """Close above / below every average; false while any average is missing."""
        above, below = F.lit(True), F.lit(True)
        for average in self.averages:
            above = above & (F.col(close) > F.col(prefix + average.column))
            below = below & (F.col(close) < F.col(prefix + average.column))
        return F.coalesce(above, F.lit(False)), F.coalesce(below, F.lit(False))

    def signal(self) -> Column:
        """The rule as a column over a ``with_indicators`` frame."""
        fast, slow = self.fast.column, self.slow.column
        up = (F.col(fast) > F.col(slow)) & (F.col(f"prev_{fast}") <= F.col(f"prev_{slow}"))
        down = (F.col(fast) < F.col(slow)) & (F.col(f"prev_{fast}") >= F.col(f"prev_{slow}"))
        above, below = self.beyond_all("", "close")
        if self.entry_type == "price_above_all":
            was_above, was_below = self.beyond_all("prev_", "prev_close")
            return regime_entry(_sign(above, below), _sign(was_above, was_below), self.allow_long, self.allow_short)
        if self.entry_type == "crossover_breakout":
            up, down = up & above, down & below
        return _sign(F.lit(self.allow_long) & up, F.lit(self.allow_short) & down)


def ma_strategy(
    candles: DataFrame,
    *,
    ma_types: list[str],
    ma_periods: list[int],
    entry_type: str,
    allow_long: bool = True,
    allow_short: bool = True,
) -> DataFrame:
    """Crossover, price-beyond-all or breakout entries on two or three averages."""
    rule = MaRule.of(ma_types, ma_periods, entry_type, allow_long, allow_short)
    frame = with_indicators(candles, list(rule.averages))
    numbered = [F.col(a.column).alias(f"ma_{i}") for i, a in enumerate(rule.averages, start=1)]
    return frame.select(
        *SERIES,
        "timestamp",
        *_labels(
            rule.signal(),
            f"{rule.entry_type}_long_{rule.suffix}",
            f"{rule.entry_type}_short_{rule.suffix}",
            "ma_strategy",
        ),
        *numbered,
        F.col(rule.fast.column).alias("ma_fast"),
        F.col(rule.slow.column).alias("ma_slow"),
    )


Strategy = Callable[..., DataFrame]
STRATEGIES: dict[str, Strategy] = {"sma_crossover": sma_crossover, "ma_strategy": ma_strategy}


def register_strategy(name: str, strategy: Strategy) -> None:
    """Make a ``candles -> signals`` function available by name."""
    STRATEGIES[name] = strategy


def generate(candles: DataFrame, strategy: str, **params) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy: {strategy!r}. Registered: {', '.join(sorted(STRATEGIES))}.")
    return candles.transform(STRATEGIES[strategy], **params)

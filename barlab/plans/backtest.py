"""Candles and signals in, trades, equity and metrics out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, functions as F

from barlab.functions.indicators import with_indicators
from barlab.operators.ledger.chain import accept, settle
from barlab.operators.ledger.configs import check_configs, required_atrs
from barlab.operators.ledger.entries import SIGNAL_ROW, align_signals, candidate_entries
from barlab.operators.ledger.equity import equity_curve, stretches
from barlab.operators.ledger.exits import (
    DIAGNOSTICS,
    FIRST_BLOCKS,
    fixed_hits,
    pack_bars,
    ratchet_hits,
    resolve_exits,
    with_salts,
)
from barlab.operators.metrics import run_metrics
from barlab.schemas import SERIES
from barlab.session import materialize


@dataclass
class Book:
    """Result tables of a set of runs; ``rejected`` holds invalid configs with their error, ``signals`` what the runs of a key share."""

    runs: DataFrame
    rejected: DataFrame
    bars: DataFrame
    packed: DataFrame
    candidates: DataFrame
    trades: DataFrame
    signals: DataFrame

    @property
    def equity(self) -> DataFrame:
        return equity_curve(self.runs, self.trades, self.packed)

    @property
    def metrics(self) -> DataFrame:
        return run_metrics(self.runs, self.trades, stretches(self.runs, self.trades, self.packed))


@dataclass
class SlicedBook(Book):
    """A book kept over named data windows, shown under the plain pairs."""

    kept: Book | None = None
    plain: Callable[[DataFrame], DataFrame] | None = None

    @classmethod
    def of(cls, book: Book, plain: Callable[[DataFrame], DataFrame]) -> SlicedBook:
        shown = replace(book, **{name: plain(getattr(book, name)) for name in ("runs", "rejected", "bars", "trades", "signals")})
        return cls(**{f.name: getattr(shown, f.name) for f in fields(Book)}, kept=book, plain=plain)

    @property
    def equity(self) -> DataFrame:
        return self.plain(self.kept.equity)

    @property
    def metrics(self) -> DataFrame:
        return self.plain(self.kept.metrics)


def keep_book(
    bars: DataFrame,
    signal_rows: DataFrame,
    runs: DataFrame,
    rejected: DataFrame,
    *,
    atr_columns: list[str],
    ma_columns: list[str],
    first_blocks: int = FIRST_BLOCKS,
) -> Book:
    """Resolve all runs over materialised, indexed bars.

    ``signal_rows`` need a ``timestamp`` besides the columns of ``SIGNAL_ROW``.
    """
    runs = with_salts(runs)
    summary = bars.groupBy(*SERIES).agg(F.max("last_index").alias("last_index"))
    salts = runs.groupBy(*SERIES).agg(F.first("salts").alias("salts"))
    # Read several times below: written once.
    levels = [*atr_columns, *ma_columns]
    packed = materialize(pack_bars(bars, ["timestamp", "high", "low", "close"], levels).join(salts, SERIES), "packed")
    candidates = materialize(candidate_entries(signal_rows, runs, atr_columns, ma_columns), "candidates")

    kinds = {row[0] for row in runs.select("ratchets").distinct().collect()}
    leveled = candidates.where("has_exit_level")
    outcomes = fixed_hits(leveled.where("NOT ratchets"), packed) if kinds != {True} else None
    if True in kinds:
        ratcheted = ratchet_hits(leveled.where("ratchets"), packed, levels=levels, first_blocks=first_blocks)
        outcomes = ratcheted if outcomes is None else outcomes.unionByName(ratcheted)

    kept = [
        "run_id",
        *SERIES,
        "strategy_name",
        "position_sizing_mode",
        "initial_capital",
        "fixed_position_size",
        "risk_percent",
        "fee_per_trade",
        "sign",
        "entry_index",
        "entry_time",
        "entry_s",
        "stop_s",
        "target_s",
        "stop_distance",
        "atr_at_entry",
        "flip_index",
        "exit_index",
        "exit_time",
        "exit_reason",
        "exit_s",
        *DIAGNOSTICS,
    ]
    resolved = materialize(resolve_exits(candidates, outcomes).select(*kept), "resolved")
    trades = materialize(settle(accept(resolved)), "trades")
    live = runs.join(summary.where("last_index >= 1"), SERIES)
    signals = signal_rows.select("signal_key", *SERIES, "timestamp", "signal")
    return Book(live, rejected, bars, packed, candidates, trades, signals)


def run_backtest(candles: DataFrame, signals: DataFrame, configs: DataFrame, *, first_blocks: int = FIRST_BLOCKS) -> Book:
    """Run every config row over the series it names, all sharing ``signals``.

    ``signals`` may carry ``short_sma, long_sma`` or ``ma_fast, ma_slow`` for MA
    stops; the first of each pair wins per row.
    """
    checked = materialize(check_configs(configs), "configs")
    atrs = required_atrs(checked)
    aligned = align_signals(with_indicators(candles, [], atrs), signals)
    sources = {"stop_ma_short": ("short_sma", "ma_fast"), "stop_ma_long": ("long_sma", "ma_slow")}
    offered = {name: [c for c in columns if c in signals.columns] for name, columns in sources.items()}
    offered = {name: columns for name, columns in offered.items() if columns}
    bars = aligned.withColumns({name: F.coalesce(*[F.col(c) for c in columns]) for name, columns in offered.items()})
    ma_columns = list(offered)
    atr_columns = [a.column for a in atrs]
    bars = materialize(
        bars.select(
            *SERIES,
            "timestamp",
            "open",
            "high",
            "low",
            "close",
            "bar_index",
            "signal",
            *SIGNAL_ROW[5:],
            *atr_columns,
            *ma_columns,
        ),
        "bars",
    )
    checked = checked.withColumn("ma_stop_series", F.concat(F.lit("stop_ma_"), "ma_stop_source"))
    unserved = F.col("ma_stop") & ~F.col("ma_stop_series").isin(*ma_columns) if ma_columns else F.col("ma_stop")
    checked = checked.withColumn(
        "error",
        F.coalesce("error", F.when(unserved, F.lit("ma_stop requires signals that carry the chosen moving average."))),
    )
    runs = checked.where(F.col("error").isNull()).withColumn("signal_key", F.lit("shared"))
    rows = bars.withColumn("signal_key", F.lit("shared")).where("signal <> 0")
    return keep_book(
        bars,
        rows,
        runs,
        checked.where(F.col("error").isNotNull()),
        atr_columns=atr_columns,
        ma_columns=ma_columns,
        first_blocks=first_blocks,
    )

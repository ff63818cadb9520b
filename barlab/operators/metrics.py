"""Run metrics from trades and equity, for all runs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barlab.operators.ledger.equity import falls
from barlab.schemas import SERIES

RUN = ["run_id", *SERIES]

# --- fixed values: exit reason -> metric ---
EXIT_COUNTS = {
    "stop_loss": "stop_loss_exits",
    "trailing_stop": "trailing_stop_exits",
    "chandelier_trailing_stop": "chandelier_trailing_exits",
    "break_even": "break_even_exits",
    "ma_stop": "ma_stop_exits",
    "take_profit": "take_profit_exits",
    "signal_exit": "signal_exits",
    "forced_end": "forced_end_exits",
}

# --- fixed values: order of the metrics in a result row ---
METRIC_COLUMNS = [
    "initial_capital",
    "final_capital",
    "total_return_pct",
    "total_trades",
    "gross_pnl",
    "net_pnl",
    "win_rate",
    "average_win",
    "average_loss",
    "profit_factor",
    "expectancy",
    "max_drawdown",
    "max_drawdown_pct",
    "ending_equity",
    "average_trade_duration_bars",
    "average_risk_amount",
    "average_position_size_used",
    "long_trades_count",
    "short_trades_count",
    *EXIT_COUNTS.values(),
]

_COUNTS = ["total_trades", "long_trades_count", "short_trades_count", *EXIT_COUNTS.values()]


def trade_totals(trades: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Sums, means and counts of one run's trades (one aggregation, map-side combined)."""
    net = F.coalesce("net_pnl", "pnl") if "pnl" in trades.columns else F.col("net_pnl")
    won, lost = F.col("net_pnl") > 0, F.col("net_pnl") < 0
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.coalesce(F.sum("gross_pnl"), F.lit(0.0)).alias("gross_pnl"),
        F.coalesce(F.sum(net), F.lit(0.0)).alias("net_pnl"),
        F.count_if(won).alias("wins"),
        F.avg(F.when(won, F.col("net_pnl"))).alias("average_win"),
        F.avg(F.when(lost, F.col("net_pnl"))).alias("average_loss"),
        F.coalesce(F.sum(F.when(won, F.col("net_pnl"))), F.lit(0.0)).alias("profit"),
        F.abs(F.coalesce(F.sum(F.when(lost, F.col("net_pnl"))), F.lit(0.0))).alias("loss"),
        F.avg("duration_bars").alias("average_trade_duration_bars"),
        F.avg("risk_amount").alias("average_risk_amount"),
        F.avg("position_size_used").alias("average_position_size_used"),
        F.count_if(F.col("side") == "long").alias("long_trades_count"),
        F.count_if(F.col("side") == "short").alias("short_trades_count"),
        *[F.count_if(F.col("exit_reason") == reason).alias(name) for reason, name in EXIT_COUNTS.items()],
    )


def drawdowns(pieces: DataFrame) -> DataFrame:
    """Deepest fall from the running peak, in money and as a fraction; ``pieces`` are the ``stretches`` of the runs."""
    return falls(pieces).groupBy(*RUN).agg(
        F.min("fall").alias("max_drawdown"),
        F.min("fall_pct").alias("max_drawdown_pct"),
        F.max_by("ending", "start").alias("ending_equity"),
        F.max_by("capital", "start").alias("final_capital"),
    )


def run_metrics(runs: DataFrame, trades: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per run of ``runs`` (run_id, series, initial_capital), also without trades.

    ``pieces`` are the ``stretches`` of the runs.
    """
    joined = (
        runs.select(*RUN, "initial_capital")
        .join(trade_totals(trades), RUN, "left")
        .join(drawdowns(pieces), RUN, "left")
    )
    total = F.coalesce("total_trades", F.lit(0))
    zero = lambda column: F.coalesce(column, F.lit(0.0))
    traded = lambda column: F.when(total > 0, column).otherwise(F.lit(0.0))
    start = F.col("initial_capital")
    final = F.coalesce("final_capital", start)
    return joined.select(
        *RUN,
        start,
        final.alias("final_capital"),
        traded((final - start) / start * 100.0).alias("total_return_pct"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in _COUNTS],
        zero("gross_pnl").alias("gross_pnl"),
        zero("net_pnl").alias("net_pnl"),
        traded(F.try_divide("wins", total)).alias("win_rate"),
        zero("average_win").alias("average_win"),
        zero("average_loss").alias("average_loss"),
        F.when(F.col("loss") > 0, F.col("profit") / F.col("loss"))
        .when(F.col("profit") > 0, F.lit(float("inf")))
        .otherwise(F.lit(0.0))
        .alias("profit_factor"),
        traded(F.try_divide("net_pnl", total)).alias("expectancy"),
        traded(zero("max_drawdown")).alias("max_drawdown"),
        traded(zero("max_drawdown_pct")).alias("max_drawdown_pct"),
        F.coalesce("ending_equity", start).alias("ending_equity"),
        zero("average_trade_duration_bars").alias("average_trade_duration_bars"),
        zero("average_risk_amount").alias("average_risk_amount"),
        zero("average_position_size_used").alias("average_position_size_used"),
    ).select(*RUN, *METRIC_COLUMNS)

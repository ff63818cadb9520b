"""Hand-computed trades."""

from __future__ import annotations

import pytest

from barlab.operators.ledger.configs import check_configs, config_table
from barlab.plans.backtest import run_backtest
from checks.q_ledger import EXPECTED_ERRORS
from checks.runs import BASE, BROKEN
from tests.helpers import candles, moment, settings, signals


def run(spark, rows, by_bar, timeframe="1h", short=None, long=None, **changes):
    bars = candles(spark, rows, timeframe)
    sig = signals(spark, by_bar, timeframe, short=short, long=long)
    book = run_backtest(bars, sig, config_table(spark, [settings(timeframe, **changes)]))
    return book, book.trades.orderBy("trade_no").collect()


def near(value):
    return pytest.approx(value, abs=1e-9)


def test_entry_on_next_open_with_costs(spark):
    rows = [(1.1, 1.1, 1.1, 1.1), (1.1010, 1.102, 1.1, 1.1015), (1.1015, 1.102, 1.101, 1.1018)]
    _, trades = run(spark, rows, {0: 1}, "15m", spread=0.0002, slippage=0.0001)
    assert trades[0].entry_price == near(1.1012) and trades[0].entry_time == moment(1, "15m")
    assert trades[0].exit_reason == "forced_end" and trades[0].exit_price == near(1.1018 - 0.0002)


def test_flip_on_the_same_open(spark):
    rows = [(1.1, 1.1, 1.1, 1.1), (1.1, 1.1, 1.1, 1.1), (1.0990, 1.1, 1.09, 1.095), (1.095, 1.096, 1.094, 1.095)]
    _, trades = run(spark, rows, {0: 1, 1: -1}, "15m", spread=0.0002, slippage=0.00005)
    assert [t.exit_reason for t in trades] == ["signal_exit", "forced_end"]
    assert trades[0].exit_price == near(1.09885) and trades[1].side == "short"
    assert trades[0].exit_time == trades[1].entry_time == moment(2, "15m")


def test_last_signal_never_trades_and_repeats_are_ignored(spark):
    flat = [(10, 10, 10, 10)] * 4
    _, trades = run(spark, flat, {0: 1, 1: 1, 3: -1})
    assert len(trades) == 1


def test_opposite_signal_closes_even_if_that_side_may_not_enter(spark):
    flat = [(10, 10, 10, 10)] * 5
    _, trades = run(spark, flat, {0: 1, 2: -1}, allow_short=False)
    assert [(t.side, t.exit_reason, t.exit_index) for t in trades] == [("long", "signal_exit", 3)]


def test_stop_wins_within_a_bar(spark):
    short = [(1.2, 1.2, 1.2, 1.2), (1.2, 1.2015, 1.1980, 1.2), (1.2, 1.2, 1.2, 1.2)]
    _, trades = run(spark, short, {0: -1}, "15m", stop_loss=0.0010, take_profit=0.0015)
    assert trades[0].exit_reason == "stop_loss" and trades[0].exit_price == near(1.2010)
    long = [(1.1, 1.1, 1.1, 1.1), (1.1, 1.102, 1.0985, 1.1), (1.1, 1.1, 1.1, 1.1)]
    _, trades = run(spark, long, {0: 1}, "15m", stop_loss=0.0010, take_profit=0.0015)
    assert trades[0].exit_reason == "stop_loss" and trades[0].exit_price == near(1.0990)
    assert trades[0].duration_bars == 0


ATR_ROWS = [(10, 11, 9, 10), (12, 15, 11, 13), (20, 20.5, 19.5, 20.1), (20.2, 20.4, 19.9, 20)]


def test_atr_levels_freeze_at_the_signal_bar(spark):
    _, trades = run(
        spark, ATR_ROWS, {1: 1}, "15m", stop_loss=1.0, stop_loss_mode="atr", take_profit=2.0, take_profit_mode="atr", atr_period=2, atr_method="sma"
    )
    assert trades[0].atr_at_entry == near(3.5)
    assert trades[0].stop_loss == near(16.5) and trades[0].take_profit == near(27.0)


def test_atr_warm_up_skips_only_entry_time_levels(spark):
    _, skipped = run(spark, ATR_ROWS, {0: 1}, "15m", stop_loss=1.0, stop_loss_mode="atr", atr_period=2, atr_method="sma")
    assert skipped == []
    _, kept = run(spark, ATR_ROWS, {0: 1}, "15m", trailing_stop=1.0, trailing_stop_mode="atr", atr_period=2, atr_method="sma")
    assert len(kept) == 1 and kept[0].atr_at_entry is None


def test_risk_sizing(spark):
    rows = [(1.1, 1.1, 1.1, 1.1)] * 3
    _, trades = run(
        spark, rows, {0: 1}, "15m", initial_capital=100.0, position_sizing_mode="risk_percent", risk_percent=0.01, stop_loss=0.0020
    )
    assert trades[0].risk_amount == near(1.0) and trades[0].size == pytest.approx(500.0)


def test_compounding(spark):
    rows = [(10, 10, 10, 10), (10, 11, 10, 11), (11, 11, 11, 11), (11, 12, 11, 12), (12, 12, 12, 12)]
    book, trades = run(
        spark, rows, {0: 1, 2: 1}, "15m", initial_capital=100.0, position_sizing_mode="risk_percent", risk_percent=0.01, stop_loss=1.0, take_profit=1.0
    )
    assert [t.capital_before for t in trades] == [near(100.0), near(101.0)]
    assert trades[1].risk_amount == near(1.01)
    metrics = book.metrics.collect()[0]
    assert metrics.total_trades == 2 and metrics.take_profit_exits == 2 and metrics.profit_factor == float("inf")


def test_standard_trailing(spark):
    rows = [(10, 10.2, 9.8, 10), (10, 11.2, 9.4, 11), (11, 11.6, 10.1, 11.4), (11.4, 11.5, 10.6, 10.8), (10.8, 10.9, 10.7, 10.85)]
    _, trades = run(spark, rows, {0: 1}, "15m", trailing_stop=1.0)
    assert trades[0].trailing_stop_initial == near(10.0) and trades[0].trailing_stop_final == near(10.4)
    assert trades[0].exit_reason == "forced_end" and not trades[0].trailing_stop_exit_hit


def test_activated_trailing(spark):
    rows = [(10, 10.1, 9.9, 10), (10, 10.8, 9.9, 10.4), (10.4, 11.2, 10.2, 10.9), (10.9, 10.95, 10, 10.2), (10.2, 10.3, 10.1, 10.25)]
    _, trades = run(spark, rows, {0: 1}, "15m", trailing_stop=1.0, trailing_activation=1.0)
    assert trades[0].trailing_stop_initial == near(9.9) and trades[0].trailing_stop_final == near(9.9)


def test_chandelier(spark):
    rows = [(9, 10, 8, 9), (10, 12, 9, 11), (11, 13, 10, 12), (12, 12.5, 9, 10), (10, 10.1, 9.9, 10)]
    _, trades = run(
        spark, rows, {0: 1}, trailing_type="chandelier", chandelier_multiplier=1.0, chandelier_atr_period=2, chandelier_atr_method="sma"
    )
    assert trades[0].trailing_stop_initial == near(9.5) and trades[0].trailing_stop_final == near(10.0)
    assert trades[0].exit_reason == "chandelier_trailing_stop" and trades[0].trailing_stop_exit_hit


def test_break_even(spark):
    rows = [(10, 10.1, 9.9, 10), (10, 10.8, 9.8, 10.6), (10.6, 11.2, 10.5, 10.9), (10.9, 10.95, 10, 10.2), (10.2, 10.3, 10.1, 10.2)]
    _, trades = run(spark, rows, {0: 1}, break_even=1.0, break_even_buffer=0.1)
    assert trades[0].exit_reason == "break_even" and trades[0].exit_price == near(10.1) and trades[0].exit_index == 3
    assert trades[0].break_even_exit_hit


def test_trailing_tighter_than_break_even(spark):
    rows = [(10, 10.1, 9.9, 10), (10, 11.4, 9.9, 11.2), (11.2, 11.3, 10.15, 10.8), (10.8, 10.9, 10.7, 10.8)]
    _, trades = run(spark, rows, {0: 1}, trailing_stop=0.5, break_even=1.0, break_even_buffer=0.1)
    assert trades[0].exit_reason == "trailing_stop" and trades[0].exit_price == near(10.7)
    assert trades[0].break_even_stop_price == near(10.1)


def test_ma_stop_ratchets(spark):
    rows = [(10, 10.1, 9.9, 10), (10, 10.5, 9.95, 10.4), (10.4, 10.9, 10.3, 10.8), (10.8, 11.0, 10.7, 10.9), (10.9, 11.1, 10.8, 10.95)]
    _, trades = run(spark, rows, {0: 1}, short=[9.9, 10.2, 10.6, 10.5, 10.4], long=[9.8, 10.0, 10.2, 10.3, 10.4], ma_stop=True)
    assert trades[0].ma_stop_initial == near(10.2) and trades[0].ma_stop_final == near(10.6)
    assert trades[0].exit_reason == "forced_end"


def test_ma_stop_live_atr_buffer(spark):
    rows = [(10, 11, 9, 10), (10, 11, 9, 10), (10, 11, 9, 10.4), (10.4, 11.4, 10.2, 11), (11, 11.2, 10.9, 11.1)]
    _, trades = run(
        spark, rows, {1: 1}, short=[9.8, 10, 11, 12.5, 11.9], ma_stop=True, ma_stop_buffer=0.5, ma_stop_buffer_mode="atr",
        atr_period=2, atr_method="sma",
    )
    assert trades[0].ma_stop_initial == near(10.0)
    assert trades[0].exit_reason == "ma_stop" and trades[0].ma_stop_final == near(11.7) and trades[0].exit_price == near(11.7)


def test_ma_stop_needs_its_average(spark):
    rows = [(10, 10, 10, 10)] * 3
    book, trades = run(spark, rows, {0: 1}, ma_stop=True)
    assert trades == [] and book.rejected.count() == 1
    _, skipped = run(spark, rows, {0: 1}, short=[None, 1.0, 1.0], ma_stop=True)
    assert skipped == []


def test_equity_and_flat_runs(spark):
    rows = [(10, 10, 10, 10), (10, 12, 10, 12), (12, 13, 9, 11), (11, 11, 11, 11)]
    book, _ = run(spark, rows, {0: 1})
    curve = book.equity.orderBy("timestamp").collect()
    assert [c.equity for c in curve] == [near(10_002), near(10_001), near(10_001)]
    assert [c.position_side for c in curve] == ["long", "long", "flat"]
    metrics = book.metrics.collect()[0]
    assert metrics.max_drawdown == near(-1.0) and metrics.max_drawdown_pct == near(10_001 / 10_002 - 1)
    idle, trades = run(spark, rows, {})
    assert trades == [] and idle.equity.count() == 3
    zero = idle.metrics.collect()[0]
    assert zero.total_trades == 0 and zero.max_drawdown == 0.0 and zero.final_capital == 10_000.0


def test_config_errors(spark):
    runs = [{**BASE, "strategy_name": name, **changes} for name, changes in BROKEN.items()]
    found = {r.strategy_name: r.error for r in check_configs(config_table(spark, runs)).collect()}
    assert found == EXPECTED_ERRORS


def test_run_ids_are_stable_and_distinct(spark):
    first = config_table(spark, [settings(), settings(stop_loss=1.0)]).collect()
    again = config_table(spark, [settings(), settings(stop_loss=1.0)]).collect()
    assert [r.run_id for r in first] == [r.run_id for r in again]
    assert len({r.run_id for r in first}) == 2
    assert first[0].run_id.startswith("synthetic_2025-01-01_2025-01-02_")

"""Backtest settings and signal rules used by the ledger queries, for both sides."""

from __future__ import annotations

BASE = {"initial_capital": 1000.0, "fixed_position_size": 1.0}
RISK = {"position_sizing_mode": "risk_percent", "risk_percent": 0.01}

# Distances are in event-value units (mean about 50).
RUNS: dict[str, dict] = {
    "plain": {},
    "fixed_levels": dict(stop_loss=20.0, take_profit=40.0, spread=0.02, slippage=0.01, fee_per_trade=0.5),
    "atr_levels": dict(stop_loss=1.0, stop_loss_mode="atr", take_profit=2.0, take_profit_mode="atr", spread=0.1),
    "trailing": dict(trailing_stop=15.0, take_profit=80.0),
    "trailing_live_atr": dict(trailing_stop=0.8, trailing_stop_mode="atr", stop_loss=30.0),
    "activated": dict(trailing_stop=20.0, trailing_activation=25.0, stop_loss=40.0),
    "activated_atr": dict(trailing_stop=10.0, trailing_activation=0.3, trailing_activation_mode="atr"),
    "chandelier": dict(trailing_type="chandelier", chandelier_multiplier=1.0, chandelier_atr_period=5, chandelier_atr_method="sma"),
    "chandelier_activated": dict(
        trailing_type="chandelier", chandelier_multiplier=0.7, trailing_activation=0.5, trailing_activation_mode="atr",
        atr_period=9, atr_method="ema",
    ),
    "break_even": dict(break_even=15.0, break_even_buffer=1.0, stop_loss=35.0),
    "break_even_atr": dict(
        break_even=0.4, break_even_mode="atr", break_even_buffer=0.1, break_even_buffer_mode="atr", trailing_stop=30.0,
    ),
    "ma_stop": dict(ma_stop=True, take_profit=60.0),
    "ma_stop_buffered": dict(ma_stop=True, ma_stop_source="long", ma_stop_buffer=0.3, ma_stop_buffer_mode="atr"),
    "everything": dict(
        stop_loss=1.2, stop_loss_mode="atr", take_profit=90.0, trailing_stop=1.5, trailing_stop_mode="atr",
        break_even=20.0, ma_stop=True, ma_stop_buffer=10.0, spread=0.5,
    ),
    "long_only": dict(stop_loss=25.0, take_profit=25.0, allow_short=False),
    "short_only": dict(trailing_stop=18.0, allow_long=False),
    "risk_sized": dict(stop_loss=15.0, take_profit=30.0, fee_per_trade=0.2, **RISK),
    "risk_ma_stop": dict(ma_stop=True, ma_stop_buffer=5.0, stop_loss=30.0, **RISK),
    "risk_ruin": dict(stop_loss=10.0, slippage=6.0, position_sizing_mode="risk_percent", risk_percent=0.9),
}
NAMES = list(RUNS)


def settings(names: list[str] | None = None) -> list[dict]:
    return [{**BASE, "strategy_name": name, **RUNS[name]} for name in (names or NAMES)]


TIMEFRAME = "1h"
RULE = dict(ma_types=["ema", "sma"], ma_periods=[3, 8], entry_type="price_above_all")

# Invalid settings, one rule broken each.
BROKEN: dict[str, dict] = {
    "bad_mode": dict(position_sizing_mode="kelly"),
    "no_capital": dict(initial_capital=0.0),
    "no_size": dict(fixed_position_size=-1.0),
    "no_risk": dict(position_sizing_mode="risk_percent"),
    "no_stop": dict(position_sizing_mode="risk_percent", risk_percent=0.01),
    "negative_spread": dict(spread=-1.0),
    "no_side": dict(allow_long=False, allow_short=False),
    "many_positions": dict(one_position_at_a_time=False),
    "mode_without_value": dict(stop_loss_mode="atr"),
    "zero_target": dict(take_profit=0.0),
    "strange_mode": dict(stop_loss=1.0, stop_loss_mode="pips"),
    "strange_trailing": dict(trailing_type="parabolic"),
    "strange_source": dict(ma_stop=True, ma_stop_source="middle"),
    "buffer_without_stop": dict(ma_stop_buffer=1.0),
    "activation_alone": dict(trailing_activation=1.0),
    "multiplier_on_standard": dict(trailing_stop=1.0, chandelier_multiplier=1.0),
    "stop_on_chandelier": dict(trailing_type="chandelier", trailing_stop=1.0, chandelier_multiplier=1.0),
    "chandelier_alone": dict(trailing_type="chandelier"),
    "bad_atr_period": dict(atr_period=0),
    "bad_atr_method": dict(atr_method="wma"),
    "fine": dict(stop_loss=1.0),
    "fine_spelling": dict(stop_loss=1.0, stop_loss_mode=" ATR ", trailing_type="Standard"),
}

"""The ledger against the bar-stepping SQL machine on random settings."""

from __future__ import annotations

import random

import duckdb
import pytest

from barlab.operators.ledger import exits
from barlab.operators.ledger.configs import configs_per_series
from barlab.operators.signals import sma_crossover
from barlab.operators.resample import ticks_to_bars
from barlab.plans.backtest import run_backtest
from checks import duck_sql as D
from checks.feeds import event_ticks


def random_run(rng: random.Random) -> dict:
    mode = lambda absolute, atr: rng.choice([("absolute", absolute), ("atr", atr)])
    run = {"initial_capital": 1000.0, "fixed_position_size": 1.0, "atr_period": 5, "atr_method": "sma"}
    for name, absolute, multiple, chance in (
        ("stop_loss", 18.0, 0.8, 0.7), ("take_profit", 35.0, 1.5, 0.6), ("break_even", 14.0, 0.5, 0.4),
    ):
        if rng.random() < chance:
            chosen, value = mode(absolute, multiple)
            run[name], run[f"{name}_mode"] = value * rng.uniform(0.5, 1.5), chosen
    if "break_even" in run and rng.random() < 0.5:
        run["break_even_buffer"] = rng.uniform(0, 3)
    kind = rng.choice(["none", "standard", "chandelier"])
    if kind == "standard":
        chosen, value = mode(16.0, 0.9)
        run["trailing_stop"], run["trailing_stop_mode"] = value, chosen
    elif kind == "chandelier":
        run.update(trailing_type="chandelier", chandelier_multiplier=rng.uniform(0.5, 1.5), chandelier_atr_period=5, chandelier_atr_method="sma")
    if kind != "none" and rng.random() < 0.5:
        chosen, value = mode(12.0, 0.4)
        run["trailing_activation"], run["trailing_activation_mode"] = value, chosen
    if rng.random() < 0.3:
        run.update(ma_stop=True, ma_stop_source=rng.choice(["short", "long"]))
        if rng.random() < 0.5:
            run["ma_stop_buffer"], run["ma_stop_buffer_mode"] = rng.uniform(0, 0.5), "atr"
    if ("stop_loss" in run or run.get("ma_stop")) and rng.random() < 0.4:
        run.update(position_sizing_mode="risk_percent", risk_percent=rng.choice([0.01, 0.3]))
    if rng.random() < 0.3:
        run[rng.choice(["allow_long", "allow_short"])] = False
    run.update(spread=rng.choice([0.0, 0.5]), slippage=rng.choice([0.0, 0.1]), fee_per_trade=rng.choice([0.0, 1.0]))
    return run


@pytest.mark.parametrize("seed, pack, zones, blocks, runs_per_salt", [(1, 512, 512, 8, 64), (2, 3, 2, 1, 5)])
def test_random_settings(spark, sf, seed, pack, zones, blocks, runs_per_salt, monkeypatch):
    """Blocks of 3 bars force summaries, zones and several passes over candidates; 5 runs per salt several copies of the bars."""
    monkeypatch.setattr(exits, "RUNS_PER_SALT", runs_per_salt)
    monkeypatch.setattr(exits, "PACK", pack)
    monkeypatch.setattr(exits, "ZONES", zones)
    rng = random.Random(seed)
    runs = [{**random_run(rng), "strategy_name": f"r{k}"} for k in range(24)]
    bars = ticks_to_bars(event_ticks(spark, sf), "4h").cache()
    book = run_backtest(bars, sma_crossover(bars, short_window=2, long_window=5), configs_per_series(bars, runs), first_blocks=blocks)
    assert book.rejected.count() == 0

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    feeds = " UNION ALL ".join(
        f"SELECT {k} AS k, pair, i, ts, o, h, l, c, sig, atr, atr AS chatr, {'s2' if r.get('ma_stop_source', 'short') == 'short' else 's5'} AS ma FROM sigs"
        for k, r in enumerate(runs)
    )
    rows = duck.execute(
        f"""WITH RECURSIVE {D.event_bars('4h')}, tr AS (SELECT *, {D.true_range()} AS tr FROM bars),
        av AS (SELECT *, {D.sma('c', 2)} AS s2, {D.sma('c', 5)} AS s5, {D.sma('tr', 5)} AS atr FROM tr),
        reg AS (SELECT *, CASE WHEN s2 > s5 THEN 1 WHEN s2 < s5 THEN -1 ELSE 0 END AS g FROM av),
        sigs AS (SELECT *, CASE WHEN g = 1 AND coalesce(lag(g) OVER w, 0) <= 0 THEN 1 WHEN g = -1 AND coalesce(lag(g) OVER w, 0) >= 0 THEN -1 ELSE 0 END AS sig
          FROM reg WINDOW w AS (PARTITION BY pair ORDER BY i)),
        cfg AS ({D.config_rows(runs)}), feed AS ({feeds}), {D.machine()}
        SELECT 'r' || k, pair, trade_no, entry_index, exit_index, reason, side, entry_price, exit_price, capital_after, trail_initial, trail_final, break_even_price, ma_initial, ma_final
        FROM trades"""
    ).fetchall()
    columns = [
        "strategy_name", "pair", "trade_no", "entry_index", "exit_index", "exit_reason", "side", "entry_price", "exit_price", "capital_after",
        "trailing_stop_initial", "trailing_stop_final", "break_even_stop_price", "ma_stop_initial", "ma_stop_final",
    ]
    mine = sorted(tuple(r) for r in book.trades.select(*columns).collect())
    theirs = sorted(rows)
    assert len(mine) > 300
    assert [m[:7] for m in mine] == [t[:7] for t in theirs]
    for m, t in zip(mine, theirs):
        assert [v is None for v in m] == [v is None for v in t]
        assert [v for v in m[7:] if v is not None] == pytest.approx([v for v in t[7:] if v is not None], rel=1e-9, abs=1e-6)

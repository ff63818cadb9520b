from __future__ import annotations

import pytest

from barlab.operators.signals import MaRule, generate, ma_strategy, register_strategy, sma_crossover
from tests.helpers import closes, column, moment


def fired(df):
    return [(r.timestamp, r.signal) for r in df.orderBy("timestamp").collect() if r.signal]


@pytest.mark.parametrize("kind", ["sma", "wma"])
def test_crossover_up_then_down(spark, kind):
    df = ma_strategy(closes(spark, [5, 4, 3, 4, 5, 4, 3]), ma_types=[kind, kind], ma_periods=[2, 3], entry_type="crossover")
    assert [s for _, s in fired(df)] == [1, -1]


def test_hull_crossover(spark):
    df = ma_strategy(closes(spark, [8, 7, 6, 5, 6, 7, 8, 7, 6, 5]), ma_types=["hma", "hma"], ma_periods=[3, 5], entry_type="crossover")
    assert fired(df) == [(moment(7), -1)]


def test_price_above_all_and_average_order(spark):
    df = ma_strategy(
        closes(spark, [1, 2, 3, 4, 5, 1, 0.5, 0.25]), ma_types=["ema", "sma", "sma"], ma_periods=[5, 2, 3], entry_type="price_above_all"
    )
    assert [s for _, s in fired(df)] == [1, -1]
    last = df.orderBy("timestamp").collect()[-1]
    assert last.ma_fast == last.ma_1 and last.ma_slow == last.ma_3
    assert last.tag == "" and {r.tag for r in df.where("signal = 1").collect()} == {"price_above_all_long_sma2_sma3_ema5"}


def test_crossover_breakout(spark):
    df = ma_strategy(
        closes(spark, [5, 4, 3, 4, 6, 7, 6, 5]), ma_types=["sma", "sma", "ema"], ma_periods=[4, 2, 3], entry_type="crossover_breakout"
    )
    assert [s for _, s in fired(df)] == [1, -1]


def test_first_bar_after_warm_up(spark):
    """A regime signals at once; a crossover needs a previous value."""
    rising = closes(spark, [1, 2, 3, 4])
    assert fired(sma_crossover(rising, short_window=2, long_window=3)) == [(moment(2), 1)]
    assert fired(ma_strategy(rising, ma_types=["sma", "sma"], ma_periods=[2, 3], entry_type="crossover")) == []


def test_side_gates(spark):
    series = closes(spark, [5, 4, 3, 4, 5, 4, 3])
    rule = dict(ma_types=["sma", "sma"], ma_periods=[2, 3], entry_type="crossover")
    assert [s for _, s in fired(ma_strategy(series, **rule, allow_short=False))] == [1]
    assert [s for _, s in fired(ma_strategy(series, **rule, allow_long=False))] == [-1]


@pytest.mark.parametrize(
    "types, periods, entry",
    [
        (["sma"], [2], "crossover"),
        (["sma", "sma"], [2], "crossover"),
        (["sma", "sma", "sma"], [2, 3, 4], "crossover"),
        (["sma", "sma"], [2, 3], "unknown"),
        (["sma", "abc"], [2, 3], "crossover"),
        (["sma", "sma"], [0, 3], "crossover"),
    ],
)
def test_bad_rules(types, periods, entry):
    with pytest.raises(ValueError):
        MaRule.of(types, periods, entry)


def test_bad_sma_windows(spark):
    for short, long in ((0, 3), (3, 3), (5, 3)):
        with pytest.raises(ValueError):
            sma_crossover(closes(spark, [1, 2]), short_window=short, long_window=long)


def test_registered_strategy(spark):
    register_strategy("always", lambda df, value: df.selectExpr("pair", "timeframe", "timestamp", f"{value} AS signal"))
    assert column(generate(closes(spark, [1, 2]), "always", value=1), "signal") == [1, 1]
    with pytest.raises(ValueError):
        generate(closes(spark, [1, 2]), "never")

"""Block summaries of the ledger: acceptance, first touches and drawdowns against plain loops, and their plans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from barlab.operators.ledger import chain, equity, exits
from barlab.operators.metrics import drawdowns

BARS = "pair string, timeframe string, bar_index bigint, timestamp timestamp, high double, low double, close double, salts int"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def packed_bars(spark, prices, levels=(), pair="P"):
    rows = [(pair, "1m", i, None, h, l, c, 2) for i, (h, l, c) in enumerate(prices)]
    bars = spark.createDataFrame(rows, BARS)
    for name in levels:
        bars = bars.withColumn(name, F.lit(1.0))
    packed = exits.pack_bars(bars, ["timestamp", "high", "low", "close"], list(levels))
    return packed.withColumn("salts", F.lit(2))


def walk_prices(seed: int, n: int) -> list[tuple[float, float, float]]:
    rng, close, out = random.Random(seed), 100.0, []
    for _ in range(n):
        close += rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0])
        out.append((close + rng.choice([0.0, 0.5]), close - rng.choice([0.0, 0.5]), close))
    return out


@pytest.mark.parametrize("pack, n, longest", [(4, 300, 40), (512, 3000, 900), (3, 200, 1)])
def test_acceptance_of_one_sided_rules(spark, pack, n, longest, monkeypatch):
    """A signal on almost every bar, all on one side: chains over many blocks."""
    monkeypatch.setattr(exits, "PACK", pack)
    rng = random.Random(pack)
    rows, want = [], set()
    for run in ("a", "b", "c"):
        for stretch in (None, 10_000):
            free = -1
            for entry in range(0 if stretch is None else 5000, n if stretch is None else 5000 + n, 1 if run == "a" else 3):
                leave = entry + rng.randint(0, longest)
                rows.append((run, "P", "1m", 1, stretch, entry, leave))
                if entry > free:
                    want.add((run, entry))
                    free = leave
    resolved = spark.createDataFrame(rows, "run_id string, pair string, timeframe string, sign int, flip_index bigint, entry_index bigint, exit_index bigint").repartition(4)
    assert {(r.run_id, r.entry_index) for r in chain.accept(resolved).collect()} == want
    assert chain.accept(resolved.where("entry_index < 0")).count() == 0


def test_acceptance_gathers_no_stretch(spark):
    """Lists are gathered by (stretch, block) only."""
    resolved = spark.createDataFrame([("a", "P", "1m", 1, None, 0, 3)], "run_id string, pair string, timeframe string, sign int, flip_index bigint, entry_index bigint, exit_index bigint")
    lists = [line for line in plan(chain.chained_blocks(resolved)).splitlines() if "collect_list" in line]
    assert lists and all("block" in line for line in lists)
    stored = spark.createDataFrame(chain.chained_blocks(resolved).collect(), chain.chained_blocks(resolved).schema)
    assert "collect_" not in plan(chain.moves(stored))


def candidates(spark, entries, **settings):
    rows = spark.createDataFrame([("r", "P", "1m", e, last) for e, last in entries], "run_id string, pair string, timeframe string, entry_index bigint, limit_index bigint")
    return rows.withColumns({"salts": F.lit(2), **{k: F.lit(v).cast("double") if isinstance(v, float) else F.lit(v) for k, v in settings.items()}})


@pytest.mark.parametrize("pack, zones", [(512, 512), (16, 3), (5, 2)])
@pytest.mark.parametrize("sign", [1, -1])
def test_fixed_levels_open_two_blocks(spark, pack, zones, sign, monkeypatch):
    monkeypatch.setattr(exits, "PACK", pack)
    monkeypatch.setattr(exits, "ZONES", zones)
    n = 10_000 if pack == 512 else 600
    prices = walk_prices(3, n)
    packed = packed_bars(spark, prices).cache()
    entries = [(e, min(n - 1, e + 7 * k)) for k, e in enumerate(range(0, n, n // 60))] + [(e, n - 1) for e in range(1, n, n // 40)]
    rows = candidates(spark, dict(entries).items(), sign=sign)
    start = spark.createDataFrame([(i, c) for i, (_, _, c) in enumerate(prices)], "entry_index bigint, at double")
    rows = rows.join(start, "entry_index").withColumns({"stop_s": F.col("sign") * F.col("at") - 12.0, "target_s": F.col("sign") * F.col("at") + 9.0}).drop("at")
    got = {r.entry_index: tuple(r.hit)[:1] + tuple(r.hit)[2:] for r in exits.fixed_hits(rows, packed).collect()}
    want = {}
    for e, last in dict(entries).items():
        stop, target = sign * prices[e][2] - 12.0, sign * prices[e][2] + 9.0
        for i in range(e, last + 1):
            high, low, _ = prices[i]
            worst, best = (low, high) if sign > 0 else (-high, -low)
            if worst <= stop or best >= target:
                want[e] = (i, stop, "stop_loss") if worst <= stop else (i, target, "take_profit")
                break
    assert got == want and len(want) > 20
    pending = rows.where(exits.block_of(F.col("limit_index")) > exits.block_of(F.col("entry_index")))
    opened = exits.deciding_blocks(pending, packed).groupBy("entry_index").count()
    assert opened.where("count > 1").isEmpty() and not opened.isEmpty()


RATCHET = {
    "entry_s": None, "stop_s": None, "target_s": None, "activation_s": None, "break_even_at_s": None, "break_even_stop_s": None, "first_ma_stop_s": None,
    "trailing_activation": None, "trailing_stop": None, "trailing_stop_mode": "absolute", "chandelier_multiplier": None, "ma_stop_buffer": None, "ma_stop_buffer_mode": None,
}


def test_moving_stops_make_no_row_per_bar(spark):
    """Between the join with packed bars and the state of a block: no exchange, no generated row."""
    rows = candidates(spark, [(0, 9)], sign=1, trails=True, trailing_type="standard", ma_stop=False, atr_at=0, ma_at=0, chandelier_at=0, block=0)
    rows = rows.withColumns({k: F.lit(v).cast("string" if k.endswith("_mode") else "double") for k, v in RATCHET.items()} | {c: F.lit(None).cast("double") for c in exits.CARRY})
    packed = packed_bars(spark, walk_prices(1, 10), ["atr"])
    for fold in (exits.walk(), exits.summarize()):
        text = plan(exits.beside_bars(rows, packed, start="entry_index", end="limit_index").select("run_id", "entry_index", fold.alias("state")))
        above = text[: text.index("Join")]
        assert "Exchange" not in above and "Generate" not in above and "Window" not in above and "aggregate(" in above


@pytest.mark.parametrize("pack", [512, 7])
def test_drawdown_from_stretches(spark, pack, monkeypatch):
    """Against the curve bar by bar; also where equity falls below zero, and flat stretches stay one row each."""
    monkeypatch.setattr(exits, "PACK", pack)
    rng, n = random.Random(5), 700
    prices = walk_prices(9, n)
    packed = packed_bars(spark, prices).cache()
    trades, at, no = [], 4, 0
    while at < n - 60:
        leave, sign = at + rng.randint(1, 50), rng.choice([1, -1])
        no += 1
        trades.append(("r", "P", "1m", no, at, leave, sign, prices[at][2], 100.0 + no, 100.5 + no, rng.choice([1.0, 2.0, 120.0])))
        at = leave + rng.randint(0, 60)
    kind = "run_id string, pair string, timeframe string, trade_no bigint, entry_index bigint, exit_index bigint, sign int, entry_price double, capital_before double, capital_after double, size double"
    frame = spark.createDataFrame(trades, kind)
    runs = spark.createDataFrame([("r", "P", "1m", 2, 100.0, n - 1), ("idle", "P", "1m", 2, 50.0, n - 1)], "run_id string, pair string, timeframe string, salts int, initial_capital double, last_index bigint")
    pieces = equity.stretches(runs, frame, packed)
    got = {r.run_id: (r.max_drawdown, r.max_drawdown_pct, r.ending_equity, r.final_capital) for r in drawdowns(pieces).collect()}
    want = {}
    for run in ("r", "idle"):
        curve = equity.equity_curve(runs.where(F.col("run_id") == run), frame.where(F.col("run_id") == run), packed).orderBy("bar_index").collect()
        peak, fall, part = float("-inf"), 0.0, 0.0
        for row in curve:
            peak = max(peak, row.equity)
            fall, part = min(fall, row.equity - peak), min(part, row.equity / peak - 1)
        want[run] = (fall, part, curve[-1].equity, curve[-1].capital)
    assert got == want and min(r.equity for r in equity.equity_curve(runs, frame, packed).collect()) < 0
    flat = equity.segments(runs, frame).where("sign = 0").count()
    held = equity.place(equity.segments(runs, frame).where("sign <> 0"), F.col("from_index"), F.col("to_index")).count()
    assert pieces.count() == flat + held
    assert "inline(slice" not in plan(drawdowns(pieces))

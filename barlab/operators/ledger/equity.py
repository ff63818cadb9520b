"""Marked-to-market equity, one row per run and bar.

Trades cut the bars of a run into segments that are either flat or hold one
position.  For the curve, segments meet the packed bars by (series, block) and unpack there; the
per-bar rows are born in place and are not shuffled again.

Drawdowns do not need the curve.  A flat segment is one row, and a held one is one row per block, folded in
place to its record highs and the lowest equity after each: such summaries compose in order with the highest equity before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.operators.ledger import exits
from barlab.operators.ledger.exits import bars_between, block_of, copies, open_bars, place
from barlab.schemas import SERIES

EQUITY_COLUMNS = ["timestamp", "equity", "capital", "realized_equity", "position_side"]


def segments(runs: DataFrame, trades: DataFrame) -> DataFrame:
    """Flat and open stretches covering bars 1..last of every run.

    ``runs`` has run_id, series, salts, initial_capital and last_index.
    """
    in_order = Window.partitionBy("run_id", *SERIES).orderBy("trade_no")
    head = trades.groupBy("run_id", *SERIES).agg(F.min("entry_index").alias("first_entry"))
    idle = runs.join(head, ["run_id", *SERIES], "left").select(
        "run_id",
        *SERIES,
        "salts",
        F.lit(1).cast("bigint").alias("from_index"),
        F.coalesce(F.col("first_entry") - 1, F.col("last_index")).alias("to_index"),
        F.lit(0).alias("sign"),
        F.col("initial_capital").alias("capital"),
        F.lit(0.0).alias("entry_s"),
        F.lit(0.0).alias("size"),
    )
    following = F.lead("entry_index").over(in_order)
    ended = trades.withColumn("next_entry", following).join(
        runs.select("run_id", *SERIES, "salts", "last_index"), ["run_id", *SERIES]
    )
    held = F.struct(
        F.col("entry_index").alias("from_index"),
        (F.col("exit_index") - 1).alias("to_index"),
        F.col("sign").alias("sign"),
        F.col("capital_before").alias("capital"),
        (F.col("sign") * F.col("entry_price")).alias("entry_s"),
        F.col("size").alias("size"),
    )
    flat = F.struct(
        F.col("exit_index").alias("from_index"),
        F.coalesce(F.col("next_entry") - 1, F.col("last_index")).alias("to_index"),
        F.lit(0).alias("sign"),
        F.col("capital_after").alias("capital"),
        F.lit(0.0).alias("entry_s"),
        F.lit(0.0).alias("size"),
    )
    traded = ended.select("run_id", *SERIES, "salts", F.inline(F.array(held, flat)))
    return idle.unionByName(traded).where(F.col("from_index") <= F.col("to_index"))


def _mark(placed: DataFrame, packed: DataFrame) -> DataFrame:
    rows = open_bars(placed, packed, F.col("from_index"), F.col("to_index"))
    sign = F.col("sign")
    mark = F.when(sign != 0, (sign * F.col("close") - F.col("entry_s")) * F.col("size")).otherwise(F.lit(0.0))
    return rows.select(
        "run_id",
        *SERIES,
        "bar_index",
        "timestamp",
        (F.col("capital") + mark).alias("equity"),
        "capital",
        F.col("capital").alias("realized_equity"),
        F.when(sign > 0, "long").when(sign < 0, "short").otherwise("flat").alias("position_side"),
    )


def equity_curve(runs: DataFrame, trades: DataFrame, packed: DataFrame) -> DataFrame:
    """``packed`` bars need timestamp and close."""
    return _mark(place(segments(runs, trades), F.col("from_index"), F.col("to_index")), packed)


def _record_highs() -> Column:
    """Fold ``span`` of a held position: finished steps, the step at hand (peak and lowest equity since) and the last equity."""
    none = F.lit(None).cast("double")
    pair = lambda state: F.array(F.struct(state["peak"].alias("peak"), state["low"].alias("low")))
    state = lambda done, peak, low, now: F.struct(done.alias("done"), peak.alias("peak"), low.alias("low"), now.alias("now"))

    def step(so_far: Column, bar: Column) -> Column:
        now = F.col("capital") + (F.col("sign") * bar["close"] - F.col("entry_s")) * F.col("size")
        lower = state(so_far["done"], so_far["peak"], F.least(so_far["low"], now), now)
        done = F.when(so_far["peak"].isNull(), so_far["done"]).otherwise(F.concat(so_far["done"], pair(so_far)))
        higher = state(done, now, now, now)
        return F.when(now.isNull() | (now <= so_far["peak"]), lower).otherwise(higher)

    start = state(F.array().cast("array<struct<peak:double,low:double>>"), none, none, none)
    return F.aggregate("span", start, step, lambda s: F.struct(F.concat(s["done"], pair(s)).alias("steps"), s["peak"].alias("top"), s["now"].alias("ending")))


def stretches(runs: DataFrame, trades: DataFrame, packed: DataFrame) -> DataFrame:
    """``run_id``, series, ``start``, ``capital``, ``steps`` (peak, low), ``top`` and ``ending``: flat segments, and held ones by block."""
    parts = segments(runs, trades)
    level = F.struct(F.array(F.struct(F.col("capital").alias("peak"), F.col("capital").alias("low"))).alias("steps"), F.col("capital").alias("top"), F.col("capital").alias("ending"))
    flat = parts.where("sign = 0").select("run_id", *SERIES, F.col("from_index").alias("start"), "capital", level.alias("course"))
    held = place(parts.where("sign <> 0"), F.col("from_index"), F.col("to_index")).join(copies(packed.select(*SERIES, "block", "bars", "salts")), [*SERIES, "block", "salt"])
    held = held.withColumn("span", bars_between(F.col("from_index"), F.col("to_index")))
    start = F.greatest(F.col("from_index"), F.col("block") * F.lit(exits.PACK))
    held = held.select("run_id", *SERIES, start.alias("start"), "capital", _record_highs().alias("course"))
    return flat.unionByName(held).select("run_id", *SERIES, "start", "capital", "course.*")


def falls(pieces: DataFrame) -> DataFrame:
    """``stretches`` with ``fall`` and ``fall_pct``: the deepest fall of each from the highest equity up to there."""
    rows = pieces.withColumn("block", block_of(F.col("start")))
    run = ["run_id", *SERIES]
    tops = rows.groupBy(*run, "block").agg(F.max("top").alias("top"))
    before = Window.partitionBy(*run).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*run, "block", F.max("top").over(before).alias("top_before"))
    inside = Window.partitionBy(*run, "block").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(tops, [*run, "block"]).withColumn("top_before", F.greatest("top_before", F.max("top").over(inside)))
    peak = lambda s: F.greatest(F.col("top_before"), s["peak"])
    return rows.withColumns(
        {
            "fall": F.array_min(F.transform("steps", lambda s: s["low"] - peak(s))),
            "fall_pct": F.array_min(F.transform("steps", lambda s: F.try_divide(s["low"], peak(s)) - 1)),
        }
    )

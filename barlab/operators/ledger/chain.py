"""One position at a time, then capital.

Whatever is open when the signal turns is closed on that same open, so the book
is flat at the start of every run of same-side signals: acceptance is decided
per (config, series, run) independently, from two numbers per candidate.  Inside a block of bars that is a fold;
a block hands on only where its last trade ends, and blocks are chained by pointer doubling.

Capital is folded over blocks of trades: each block is reduced to the map from
capital before to capital after, only those few numbers per block meet along a
(config, series), and every block then settles its own trades.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.functions.indicators import whole_blocks
from barlab.operators.ledger.entries import CANDIDATE_KEY
from barlab.operators.ledger.exits import block_of
from barlab.schemas import SERIES
from barlab.session import materialize

# --- fixed values: column order of a trade record ---
TRADE_COLUMNS = [
    "trade_id",
    "pair",
    "timeframe",
    "side",
    "entry_time",
    "entry_price",
    "exit_time",
    "exit_price",
    "stop_loss",
    "take_profit",
    "size",
    "pnl",
    "outcome",
    "strategy_name",
    "notes",
    "position_size_used",
    "capital_before",
    "capital_after",
    "risk_amount",
    "stop_distance_at_entry",
    "atr_at_entry",
    "trailing_stop_initial",
    "trailing_stop_final",
    "trailing_stop_exit_hit",
    "break_even_stop_price",
    "break_even_exit_hit",
    "ma_stop_initial",
    "ma_stop_final",
    "ma_stop_exit_hit",
    "exit_reason",
    "duration_bars",
    "gross_pnl",
    "net_pnl",
]


def scan(items: Column, start: Column, step, size: int = 256) -> Column:
    """Outputs of a sequential fold over an array, one per item.

    ``step(state, item)`` returns ``struct(state, out)``.  Items are taken in
    slices of ``size``: appending to an array copies it, so one long array of
    outputs would cost the square of its length.
    """
    first = step(start, F.element_at(items, 1))
    nothing = F.filter(F.array(first["out"]), lambda x: F.lit(False))
    slices = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(items) - 1) / F.lit(size)).cast("int")),
        lambda i: F.slice(items, i * F.lit(size) + 1, F.lit(size)),
    )

    def one(acc: Column, item: Column) -> Column:
        moved = step(acc["state"], item)
        return F.struct(moved["state"].alias("state"), F.concat(acc["outs"], F.array(moved["out"])).alias("outs"))

    def piece(acc: Column, part: Column) -> Column:
        return F.struct(
            F.concat(acc["done"], F.array(acc["now"]["outs"])).alias("done"),
            F.aggregate(part, F.struct(acc["now"]["state"].alias("state"), nothing.alias("outs")), one).alias("now"),
        )

    begin = F.struct(
        F.filter(F.array(nothing), lambda x: F.lit(False)).alias("done"),
        F.struct(start.alias("state"), nothing.alias("outs")).alias("now"),
    )
    return F.aggregate(
        slices, begin, piece, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]["outs"])))
    )


#: One run of same-side signals of one (config, series); ``stretch`` is where it turns, -1 at the end of the data.
STRETCH = ["run_id", *SERIES, "sign", "stretch"]


def chained_blocks(resolved: DataFrame) -> DataFrame:
    """One row per (stretch, block): ``candidates`` in order, each with the ``end`` of the trades it would start.

    ``end`` is where the last trade inside the block ends if this candidate is taken: the block's whole answer to
    whichever of its candidates comes first.
    """
    one = F.struct("entry_index", "exit_index")
    stretch = F.coalesce("flip_index", F.lit(-1)).alias("stretch")
    groups = resolved.select("run_id", *SERIES, "sign", stretch, block_of(F.col("entry_index")).alias("block"), one.alias("candidate"))
    groups = groups.groupBy(*STRETCH, "block").agg(F.sort_array(F.collect_list("candidate"), asc=False).alias("newest_first"))

    def step(later: Column, item: Column) -> Column:
        following = F.get(F.filter(later, lambda x: x["entry_index"] > item["exit_index"]), 0)
        end = F.coalesce(following["end"], item["exit_index"])
        return F.concat(F.array(F.struct(item["entry_index"], item["exit_index"], end.alias("end"))), later)

    none = F.array().cast("array<struct<entry_index:bigint,exit_index:bigint,end:bigint>>")
    return groups.select(*STRETCH, "block", F.aggregate("newest_first", none, step).alias("candidates"))


def moves(blocks: DataFrame) -> DataFrame:
    """``block, end`` -> ``next``: the first candidate after ``end`` in a later block (its block, ``start`` and ``end``)."""
    first = F.element_at("candidates", 1)
    opening = F.struct("block", first["entry_index"].alias("start"), first["end"].alias("end"))
    spans = blocks.groupBy(*STRETCH).agg(F.min("block").alias("low"), F.max("block").alias("high"))
    spans = spans.select(*STRETCH, F.explode(F.sequence("low", "high")).alias("block"))
    latest_first = Window.partitionBy(*STRETCH).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    known = spans.join(blocks.withColumn("opening", opening), [*STRETCH, "block"], "left")
    known = known.withColumn("later", F.last("opening", ignorenulls=True).over(latest_first)).select(*STRETCH, F.col("block").alias("at"), "candidates", "later")
    ends = F.explode(F.array_distinct(F.transform("candidates", lambda c: c["end"])))
    left = blocks.select(*STRETCH, "block", ends.alias("end")).withColumn("at", F.greatest("block", block_of(F.col("end"))))
    inside = F.when(F.col("at") > F.col("block"), F.get(F.filter("candidates", lambda c: c["entry_index"] > F.col("end")), 0))
    there = F.when(inside.isNotNull(), F.struct(F.col("at").alias("block"), inside["entry_index"].alias("start"), inside["end"].alias("end")))
    met = left.join(known, [*STRETCH, "at"]).select(*STRETCH, "block", "end", F.coalesce(there, "later").alias("next"))
    return met.where(F.col("next").isNotNull())


def first_taken(blocks: DataFrame) -> DataFrame:
    """``block, start, end`` of every block in which a candidate is taken: ``start`` is the first of them.

    The chain of blocks of a stretch is followed by pointer doubling: a round joins what is reached with moves twice as
    long, so rounds grow with the logarithm of the longest chain.
    """
    first = F.element_at("candidates", 1)
    head = F.min(F.struct("block", first["entry_index"].alias("start"), first["end"].alias("end"))).alias("head")
    reached = blocks.groupBy(*STRETCH).agg(head).select(*STRETCH, "head.*")
    jumps = materialize(moves(blocks), "moves")
    while True:
        more = materialize(reached.join(jumps, [*STRETCH, "block", "end"]).select(*STRETCH, "next.*"), "reached")
        if more.isEmpty():
            return reached
        reached = reached.unionByName(more)
        onward = jumps.select(*STRETCH, F.col("block").alias("to_block"), F.col("end").alias("to_end"), F.col("next").alias("onward"))
        halfway = jumps.select(*STRETCH, "block", "end", F.col("next.block").alias("to_block"), F.col("next.end").alias("to_end"))
        jumps = materialize(halfway.join(onward, [*STRETCH, "to_block", "to_end"]).select(*STRETCH, "block", "end", F.col("onward").alias("next")), "moves")


def accept(resolved: DataFrame) -> DataFrame:
    """Keep candidates that start after the previous accepted one ended.

    ``resolved`` is read twice: for the two numbers the decision needs, and for
    the rows that are kept.
    """
    blocks = materialize(chained_blocks(resolved), "stretches")

    def step(free_after: Column, item: Column) -> Column:
        taken = item["entry_index"] > free_after
        return F.struct(
            F.when(taken, item["exit_index"]).otherwise(free_after).alias("state"),
            F.when(taken, item["entry_index"]).alias("out"),
        )

    entries = scan(F.col("candidates"), F.col("start") - 1, step)
    accepted = (
        blocks.join(first_taken(blocks), [*STRETCH, "block"])
        .select("run_id", *SERIES, F.explode(entries).alias("entry_index"))
        .where(F.col("entry_index").isNotNull())
    )
    return resolved.join(accepted, CANDIDATE_KEY, "left_semi")


_RUN_SETTINGS = ["position_sizing_mode", "initial_capital", "fixed_position_size", "risk_percent", "fee_per_trade"]


def _block_map(trades: Column) -> Column:
    """What a block of trades does to capital y: y -> factor * y + shift, and how much it needs.

    A risk-sized run stops for good once its capital is gone; with y at or below
    ``ruin`` that happens inside the block.
    """
    fixed = F.col("position_sizing_mode") == "fixed"
    start = F.struct(F.lit(1.0).alias("factor"), F.lit(0.0).alias("shift"), F.lit(float("-inf")).alias("ruin"))

    def compose(so_far: Column, trade: Column) -> Column:
        move = trade["exit_s"] - trade["entry_s"]
        gain = F.when(fixed, F.lit(1.0)).otherwise(1.0 + F.col("risk_percent") * move / trade["stop_distance"])
        cost = F.when(fixed, move * F.col("fixed_position_size")).otherwise(F.lit(0.0)) - F.col("fee_per_trade")
        factor, shift = so_far["factor"] * gain, so_far["shift"] * gain + cost
        need = F.when(fixed, F.lit(float("-inf"))).when(factor > 0, -shift / factor).otherwise(F.lit(float("inf")))
        return F.struct(factor.alias("factor"), shift.alias("shift"), F.greatest(so_far["ruin"], need).alias("ruin"))

    return F.aggregate(trades, start, compose)


def _block_openings(blocks: DataFrame) -> DataFrame:
    """Capital and number of trades before each block; capital 0 once a run is ruined."""
    per_run = blocks.groupBy("run_id", *SERIES).agg(
        F.sort_array(F.collect_list(F.struct("block", "trade_count", "effect"))).alias("blocks"),
        F.first("initial_capital").alias("initial_capital"),
    )

    def step(state: Column, item: Column) -> Column:
        capital = state["capital"]
        effect = item["effect"]
        after = F.when(capital <= effect["ruin"], F.lit(0.0)).otherwise(effect["factor"] * capital + effect["shift"])
        return F.struct(
            F.struct(after.alias("capital"), (state["count"] + item["trade_count"]).alias("count")).alias("state"),
            F.struct(item["block"].alias("block"), capital.alias("opening"), state["count"].alias("trades_before")).alias("out"),
        )

    start = F.struct(F.col("initial_capital").alias("capital"), F.lit(0).cast("bigint").alias("count"))
    return per_run.select("run_id", *SERIES, F.inline(scan(F.col("blocks"), start, step)))


def settle(accepted: DataFrame) -> DataFrame:
    """Sizes, pnl and compounding capital per (config, series), as trade records.

    Besides the trade columns the result keeps ``run_id, trade_no, entry_index,
    exit_index, sign``.
    """
    payload = [c for c in accepted.columns if c not in ("entry_index", "run_id", *SERIES, *_RUN_SETTINGS)]
    blocks = (
        accepted.withColumn("block", whole_blocks(F.col("entry_index")))
        .groupBy("run_id", *SERIES, "block")
        .agg(
            F.sort_array(F.collect_list(F.struct("entry_index", *payload))).alias("trades"),
            *[F.first(c).alias(c) for c in _RUN_SETTINGS],
        )
        .withColumns({"trade_count": F.size("trades"), "effect": _block_map(F.col("trades"))})
    )

    def step(capital: Column, trade: Column) -> Column:
        at_risk = F.when(capital > 0, capital * F.col("risk_percent"))
        fixed = F.col("position_sizing_mode") == "fixed"
        size = F.when(fixed, F.col("fixed_position_size")).otherwise(at_risk / trade["stop_distance"])
        risk = F.when(fixed, trade["stop_distance"] * F.col("fixed_position_size")).otherwise(at_risk)
        net = (trade["exit_s"] - trade["entry_s"]) * size - F.col("fee_per_trade")
        after = F.coalesce(capital + net, capital)
        return F.struct(
            after.alias("state"),
            F.struct(
                capital.alias("capital_before"), size.alias("size"), risk.alias("risk_amount"), after.alias("capital_after")
            ).alias("out"),
        )

    opened = blocks.join(_block_openings(blocks), ["run_id", *SERIES, "block"])
    kept = ["run_id", *SERIES, "fee_per_trade", "trades_before"]
    rows = (
        opened.withColumn("sized", scan(F.col("trades"), F.col("opening"), step))
        .select(*kept, F.posexplode(F.arrays_zip("trades", "sized")).alias("at", "row"))
        .select(*kept, (F.col("trades_before") + F.col("at") + 1).alias("trade_no"), "row.trades.*", "row.sized.*")
        .where(F.col("size").isNotNull())
    )
    sign = F.col("sign")
    plain = lambda name: sign * F.col(name)
    gross = (F.col("exit_s") - F.col("entry_s")) * F.col("size")
    rows = rows.withColumns({"gross_pnl": gross, "net_pnl": gross - F.col("fee_per_trade")})
    net, reason = F.col("net_pnl"), F.col("exit_reason")
    return rows.select(
        "run_id",
        F.concat_ws("_", "strategy_name", F.col("trade_no").cast("string")).alias("trade_id"),
        *SERIES,
        F.when(sign > 0, "long").otherwise("short").alias("side"),
        "entry_time",
        plain("entry_s").alias("entry_price"),
        "exit_time",
        plain("exit_s").alias("exit_price"),
        plain("stop_s").alias("stop_loss"),
        plain("target_s").alias("take_profit"),
        "size",
        net.alias("pnl"),
        F.when(net > 0, "win").when(net < 0, "loss").otherwise("breakeven").alias("outcome"),
        "strategy_name",
        F.lit(None).cast("string").alias("notes"),
        F.col("size").alias("position_size_used"),
        "capital_before",
        "capital_after",
        "risk_amount",
        F.col("stop_distance").alias("stop_distance_at_entry"),
        "atr_at_entry",
        plain("trail_first_s").alias("trailing_stop_initial"),
        plain("trail_last_s").alias("trailing_stop_final"),
        reason.isin("trailing_stop", "chandelier_trailing_stop").alias("trailing_stop_exit_hit"),
        plain("break_even_s").alias("break_even_stop_price"),
        (reason == "break_even").alias("break_even_exit_hit"),
        plain("ma_first_s").alias("ma_stop_initial"),
        plain("ma_last_s").alias("ma_stop_final"),
        (reason == "ma_stop").alias("ma_stop_exit_hit"),
        "exit_reason",
        (F.col("exit_index") - F.col("entry_index")).cast("int").alias("duration_bars"),
        "gross_pnl",
        "net_pnl",
        "trade_no",
        "entry_index",
        "exit_index",
        "sign",
    )

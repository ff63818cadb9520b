"""First exit of every candidate entry, from prices alone.

Bars are packed into one row per (series, block) with at most ``PACK`` bars.
Candidates meet blocks by an equi-join on (series, block), so a hot series is spread over all
its blocks and no range join is needed.  What a candidate does inside a block is folded in place, over the
array of bars: a row per bar is never made, and nothing per bar is shuffled.

*Fixed levels.*  If the entry's block does not decide, a zone map (lowest low, highest high of every
block, ``ZONES`` blocks a row) names the first later block that reaches a level, and only that one is opened: two at most.

*Moving stops.*  A ratchet is a scan with a carry: peak, tightest trail and tightest average stop so far.  The
entry's block is walked bar by bar.  For later blocks each candidate gets a summary per block that does not
depend on the carry; composed in block order they give the carry before every block, and a bound on its stops tells
which blocks can end the trade.  Those alone are walked.  Unresolved candidates are followed over
horizons that grow eightfold; the same passes run whatever the length of the series.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.functions.indicators import whole_blocks
from barlab.operators.ledger.entries import CANDIDATE_KEY, distance, execution_price
from barlab.schemas import BLOCK, SERIES
from barlab.session import materialize

#: Bars of a packed row, and packed rows of a row of the zone map.
PACK = BLOCK
ZONES = BLOCK
#: Blocks followed after the entry's in the first pass over moving stops.
FIRST_BLOCKS = 8
HORIZON_GROWTH = 8
RUNS_PER_SALT = 64


def block_of(index: Column) -> Column:
    return whole_blocks(index, PACK)


def pack_bars(bars: DataFrame, columns: list[str], levels: list[str]) -> DataFrame:
    """One row per (series, block): its bars in order, as an array of at most PACK structs, and their extremes.

    ``levels`` (averages, ATRs) go into one array per bar, so that a candidate reads its own by number.
    """
    values = F.array(*levels).cast("array<double>").alias("levels")
    return (
        bars.select(*SERIES, block_of(F.col("bar_index")).alias("block"), F.struct("bar_index", *columns, values).alias("bar"))
        .groupBy(*SERIES, "block")
        .agg(F.sort_array(F.collect_list("bar")).alias("bars"), F.min("bar.low").alias("low"), F.max("bar.high").alias("high"))
    )


def with_salts(runs: DataFrame) -> DataFrame:
    """Runs with ``salts``: copies of the packed bars of their series, so that many runs on few blocks still spread.

    Each series has its own number.  It grows with the runs, so the copies never outweigh what they are joined to.
    """
    beside = F.count(F.lit(1)).over(Window.partitionBy(*SERIES))
    return runs.withColumn("salts", F.ceil(beside / F.lit(RUNS_PER_SALT)).cast("int"))


def salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.hash("run_id"), F.col("salts")))


def copies(packed: DataFrame) -> DataFrame:
    return packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def place(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """One copy of each row per block its [start, end] range touches, as ``block`` and ``salt``."""
    return salted(rows.withColumn("block", F.explode(F.sequence(block_of(start), block_of(end))))).drop("salts")


def bars_between(start: Column, end: Column) -> Column:
    """The bars of [start, end] inside the block at hand."""
    base = F.col("block") * F.lit(PACK)
    low = F.greatest(start - base, F.lit(0)).cast("int")
    high = F.least(end - base, F.lit(PACK - 1)).cast("int")
    return F.slice("bars", low + 1, F.greatest(high - low + 1, F.lit(0)))


def beside_bars(rows: DataFrame, packed: DataFrame, *, start: str, end: str) -> DataFrame:
    """Rows with a ``block``, beside their ``span``: the bars of [start, end] inside it."""
    joined = salted(rows).join(copies(packed.select(*SERIES, "block", "bars", "salts")), [*SERIES, "block", "salt"])
    return joined.withColumn("span", bars_between(F.col(start), F.col(end))).drop("bars", "salt")


def open_bars(placed: DataFrame, packed: DataFrame, start: Column, end: Column) -> DataFrame:
    """Placed rows x the bars of their range inside the block."""
    joined = placed.join(copies(packed), [*SERIES, "block", "salt"])
    return joined.select(*placed.columns, F.inline(bars_between(start, end)))


def _worst(bar: Column) -> Column:
    return F.when(F.col("sign") > 0, bar["low"]).otherwise(-bar["high"])


def _best(bar: Column) -> Column:
    return F.when(F.col("sign") > 0, bar["high"]).otherwise(-bar["low"])


def _reaches(level: Column) -> Column:
    return F.coalesce(level >= F.col("target_s"), F.lit(False))


def _hit(bar: Column, price: Column, reason: Column) -> Column:
    return F.struct(bar["bar_index"].alias("index"), bar["timestamp"].alias("time"), price.alias("price"), reason.alias("reason"))


DIAGNOSTICS = ["trail_first_s", "trail_last_s", "break_even_s", "ma_first_s", "ma_last_s"]


# --- fixed levels ---


def _stops(bar: Column) -> Column:
    return F.coalesce(_worst(bar) <= F.col("stop_s"), F.lit(False))


def _first_touch() -> Column:
    """First bar of ``span`` at a fixed stop or target; the stop wins within a bar."""
    bar = F.get(F.filter("span", lambda b: _stops(b) | _reaches(_best(b))), 0)
    price = F.when(_stops(bar), F.col("stop_s")).otherwise(F.col("target_s"))
    return F.when(bar.isNotNull(), _hit(bar, price, F.when(_stops(bar), "stop_loss").otherwise("take_profit")))


def zone_map(packed: DataFrame) -> DataFrame:
    """Extremes of ``ZONES`` packed rows in a row, in order."""
    zone = F.struct("block", "low", "high")
    return packed.groupBy(*SERIES, whole_blocks(F.col("block"), ZONES).alias("zone")).agg(F.sort_array(F.collect_list(zone)).alias("zones"), F.first("salts").alias("salts"))


def deciding_blocks(pending: DataFrame, packed: DataFrame) -> DataFrame:
    """``pending`` with ``block``: the first block behind the entry's that reaches a level, if any."""
    first, last = block_of(F.col("entry_index")) + 1, block_of(F.col("limit_index"))
    rows = salted(pending.withColumn("zone", F.explode(F.sequence(whole_blocks(first, ZONES), whole_blocks(last, ZONES)))))
    met = rows.join(copies(zone_map(packed)), [*SERIES, "zone", "salt"])
    touches = lambda z: (z["block"] >= first) & (z["block"] <= last) & (_stops(z) | _reaches(_best(z)))
    least = F.min(F.get(F.filter("zones", touches), 0)["block"])
    return met.groupBy(*pending.columns).agg(least.alias("block")).where(F.col("block").isNotNull())


def fixed_hits(candidates: DataFrame, packed: DataFrame) -> DataFrame:
    """First touch of a fixed stop or target; at most two blocks of a candidate are opened."""
    slim = candidates.select(*CANDIDATE_KEY, "salts", "sign", "stop_s", "target_s", "limit_index")
    entered = beside_bars(slim.withColumn("block", block_of(F.col("entry_index"))), packed, start="entry_index", end="limit_index")
    entered = materialize(entered.select(*slim.columns, _first_touch().alias("hit")), "outcomes")
    pending = entered.where(F.col("hit").isNull() & (block_of(F.col("limit_index")) > block_of(F.col("entry_index")))).drop("hit")
    later = beside_bars(deciding_blocks(pending, packed), packed, start="entry_index", end="limit_index")
    none = [F.lit(None).cast("double").alias(c) for c in DIAGNOSTICS]
    found = entered.select(*CANDIDATE_KEY, "hit").unionByName(later.select(*CANDIDATE_KEY, _first_touch().alias("hit")))
    return found.where(F.col("hit").isNotNull()).select(*CANDIDATE_KEY, "hit", *none)


# --- moving stops ---

_RATCHET_SETTINGS = [
    "sign",
    "entry_s",
    "stop_s",
    "target_s",
    "activation_s",
    "break_even_at_s",
    "break_even_stop_s",
    "first_ma_stop_s",
    "trails",
    "trailing_type",
    "trailing_activation",
    "trailing_stop",
    "trailing_stop_mode",
    "chandelier_multiplier",
    "ma_stop",
    "ma_stop_buffer",
    "ma_stop_buffer_mode",
    "limit_index",
]

#: What the bars so far have left: highest peak, tightest and first trail, tightest and first average stop.
CARRY = ["peak", "trail", "trail_begin", "ma", "ma_begin"]


def _state(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _level(bar: Column, number: str) -> Column:
    return F.get(bar["levels"], F.col(number))


def _ma_move(bar: Column) -> Column:
    average = F.col("sign") * _level(bar, "ma_at")
    return F.when(F.col("ma_stop"), average - distance("ma_stop_buffer", _level(bar, "atr_at")))


def _trail_move(bar: Column, peak: Column) -> Column:
    chandelier = peak - F.col("chandelier_multiplier") * _level(bar, "chandelier_at")
    standard = F.col("sign") * bar["close"] - distance("trailing_stop", _level(bar, "atr_at"))
    return F.when(F.col("trailing_type") == "chandelier", chandelier).otherwise(standard)


def _active(peak: Column) -> Column:
    return F.col("trails") & (F.col("trailing_activation").isNull() | (peak >= F.col("activation_s")))


def _even(peak: Column) -> Column:
    return F.when(peak >= F.col("break_even_at_s"), F.col("break_even_stop_s"))


def walk() -> Column:
    """Fold ``span`` from the carry columns on: the carry at the first touch (or after all bars) and the ``hit``.

    A bar is checked against the levels the *previous* bars left, then moves them.
    """
    nothing = F.when(F.lit(False), _hit(F.get("span", 0), F.lit(0.0), F.lit("")))

    def step(so_far: Column, bar: Column) -> Column:
        even = _even(so_far["peak"])
        tightest = F.greatest("stop_s", even, so_far["ma"], so_far["trail"])
        stopped, reached = F.coalesce(_worst(bar) <= tightest, F.lit(False)), _reaches(_best(bar))
        reason = (
            F.when(~stopped, "take_profit")
            .when(F.col("stop_s") == tightest, "stop_loss")
            .when(even == tightest, "break_even")
            .when(so_far["ma"] == tightest, "ma_stop")
            .when(F.col("trailing_type") == "chandelier", "chandelier_trailing_stop")
            .otherwise("trailing_stop")
        )
        hit = _hit(bar, F.when(stopped, tightest).otherwise(F.col("target_s")), reason)
        peak = F.greatest(so_far["peak"], _best(bar))
        trail, average = F.when(_active(peak), _trail_move(bar, peak)), _ma_move(bar)
        moved = _state(
            peak=peak,
            trail=F.greatest(so_far["trail"], trail),
            trail_begin=F.coalesce(so_far["trail_begin"], trail),
            ma=F.greatest(so_far["ma"], average),
            ma_begin=F.coalesce(so_far["ma_begin"], average),
            hit=nothing,
        )
        ended = _state(**{name: so_far[name] for name in CARRY}, hit=hit)
        return F.when(so_far["hit"].isNotNull(), so_far).when(stopped | reached, ended).otherwise(moved)

    return F.aggregate("span", _state(**{name: F.col(name) for name in CARRY}, hit=nothing), step)


def summarize() -> Column:
    """What ``span`` adds to any carry.

    Trails stand twice: of all bars, for a trail that is active before the block, and of the bars from the activation
    inside the block on (``late``).  A chandelier also hangs on earlier peaks; the lowest ATR says how high those can lift it.
    """
    none = F.lit(None).cast("double")
    fields = ["peak", "worst", "trail", "trail_begin", "late", "late_begin", "low_atr", "begin_peak", "begin_atr", "ma", "ma_begin"]

    def step(so_far: Column, bar: Column) -> Column:
        peak, average, atr = F.greatest(so_far["peak"], _best(bar)), _ma_move(bar), _level(bar, "chandelier_at")
        trail = F.when(F.col("trails"), _trail_move(bar, peak))
        late = F.when(_active(peak), trail)
        return _state(
            peak=peak,
            worst=F.least(so_far["worst"], _worst(bar)),
            trail=F.greatest(so_far["trail"], trail),
            trail_begin=F.coalesce(so_far["trail_begin"], trail),
            late=F.greatest(so_far["late"], late),
            late_begin=F.coalesce(so_far["late_begin"], late),
            low_atr=F.least(so_far["low_atr"], atr),
            begin_peak=F.coalesce(so_far["begin_peak"], F.when(atr.isNotNull(), peak)),
            begin_atr=F.coalesce(so_far["begin_atr"], atr),
            ma=F.greatest(so_far["ma"], average),
            ma_begin=F.coalesce(so_far["ma_begin"], average),
        )

    return F.aggregate("span", _state(**dict.fromkeys(fields, none)), step)


def composed(blocks: DataFrame) -> DataFrame:
    """Carry before and ``after`` every block of a candidate, from its summaries ``own`` and the carry it came with.

    Adds ``possible``: whether the block can end the trade, judged by the levels after it, which no bar in it exceeds.
    """
    order = Window.partitionBy(*CANDIDATE_KEY).orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    own = lambda name: F.col(f"own.{name}")
    tighter = lambda name, value: F.greatest(F.col(name), F.max(value).over(earlier))
    begun = lambda name, value: F.coalesce(F.col(name), F.first(value, ignorenulls=True).over(earlier))
    rows = blocks.withColumn("peak_now", tighter("peak", own("peak")))
    lifted = F.col("peak_now") - F.col("chandelier_multiplier") * own("low_atr")
    begin = F.greatest(F.col("peak_now"), own("begin_peak")) - F.col("chandelier_multiplier") * own("begin_atr")
    hangs = F.col("trailing_type") == "chandelier"
    active = F.coalesce(_active(F.col("peak_now")), F.lit(False))
    rows = rows.withColumns(
        {
            "moved": F.when(active, F.when(hangs, F.greatest(own("trail"), lifted)).otherwise(own("trail"))).otherwise(own("late")),
            "opened": F.when(active, F.when(hangs, begin).otherwise(own("trail_begin"))).otherwise(own("late_begin")),
        }
    )
    before = {
        "peak": F.col("peak_now"),
        "trail": tighter("trail", F.col("moved")),
        "trail_begin": begun("trail_begin", F.col("opened")),
        "ma": tighter("ma", own("ma")),
        "ma_begin": begun("ma_begin", own("ma_begin")),
    }
    rows = rows.withColumns({f"{name}_before": value for name, value in before.items()})
    was = lambda name: F.col(f"{name}_before")
    after = _state(
        peak=F.greatest(was("peak"), own("peak")),
        trail=F.greatest(was("trail"), F.col("moved")),
        trail_begin=F.coalesce(was("trail_begin"), F.col("opened")),
        ma=F.greatest(was("ma"), own("ma")),
        ma_begin=F.coalesce(was("ma_begin"), own("ma_begin")),
    )
    rows = rows.withColumn("after", after).drop(*CARRY).withColumnsRenamed({f"{name}_before": name for name in CARRY})
    bound = F.greatest("stop_s", _even(F.col("after.peak")), F.col("after.ma"), F.col("after.trail"))
    possible = F.coalesce(own("worst") <= bound, F.lit(False)) | _reaches(own("peak"))
    return rows.withColumn("possible", possible).drop("peak_now", "moved", "opened", "own")


def _outcome(rows: DataFrame) -> DataFrame:
    """``state`` holds a carry and a hit."""
    state = lambda name: F.col(f"state.{name}")
    levels = [state("trail_begin"), state("trail"), _even(state("peak")), state("ma_begin"), state("ma")]
    return rows.select(*CANDIDATE_KEY, state("hit").alias("hit"), *[value.alias(name) for name, value in zip(DIAGNOSTICS, levels, strict=True)])


def ratchet_hits(
    candidates: DataFrame, packed: DataFrame, *, levels: list[str], first_blocks: int = FIRST_BLOCKS
) -> DataFrame:
    """First touch of the tightest stop or the target when stops move; ``levels`` as in ``pack_bars``."""
    number = lambda series: (F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(series)) - 1).cast("int") if levels else F.lit(None).cast("int")
    places = {"atr_at": number("atr_series"), "ma_at": number("ma_stop_series"), "chandelier_at": number("chandelier_series")}
    none = F.lit(None).cast("double")
    start = {"peak": none, "trail": none, "trail_begin": none, "ma": F.col("first_ma_stop_s"), "ma_begin": F.col("first_ma_stop_s")}
    slim = candidates.withColumns({name: F.when(at >= 0, at) for name, at in places.items()} | start)
    slim = slim.select(*CANDIDATE_KEY, "salts", *_RATCHET_SETTINGS, *places, *CARRY)
    kept = [c for c in slim.columns if c not in CARRY]

    entered = beside_bars(slim.withColumn("block", block_of(F.col("entry_index"))), packed, start="entry_index", end="limit_index")
    walked = materialize(entered.select(*kept, "block", walk().alias("state")), "walked")
    horizon, outcomes = first_blocks, []
    while True:
        undecided = F.col("state.hit").isNull() & (F.col("block") < block_of(F.col("limit_index")))
        outcomes.append(_outcome(walked.where(~undecided)))
        pending = walked.where(undecided).select(*kept, F.col("block").alias("seen"), *[F.col(f"state.{name}").alias(name) for name in CARRY])
        if pending.isEmpty():
            return functools.reduce(DataFrame.unionByName, outcomes)
        last = F.least(block_of(F.col("limit_index")), F.col("seen") + F.lit(horizon))
        spread = pending.withColumn("block", F.explode(F.sequence(F.col("seen") + 1, last)))
        summaries = beside_bars(spread, packed, start="entry_index", end="limit_index").withColumn("own", summarize()).drop("span")
        blocks = materialize(composed(summaries), "summaries")
        opened = beside_bars(blocks.where("possible").drop("after"), packed, start="entry_index", end="limit_index")
        hits = opened.select(*CANDIDATE_KEY, "block", walk().alias("state")).where("state.hit IS NOT NULL")
        hits = hits.groupBy(*CANDIDATE_KEY).agg(F.min_by("state", "block").alias("found"))
        ends = blocks.groupBy(*kept).agg(F.max_by("after", "block").alias("after"), F.max("block").alias("block"))
        left = ends.join(hits, CANDIDATE_KEY, "left")
        open_ = F.struct(*[F.col(f"after.{name}").alias(name) for name in CARRY], F.col("found.hit").alias("hit"))
        walked = materialize(left.select(*kept, "block", F.coalesce("found", open_).alias("state")), "walked")
        horizon *= HORIZON_GROWTH


def resolve_exits(candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Hit, else opposite signal on its next open, else the last close."""
    joined = candidates.join(outcomes, CANDIDATE_KEY, "left")
    hit, flips = F.col("hit").isNotNull(), F.col("flip_index").isNotNull()
    base = (
        F.when(hit, F.col("hit.price"))
        .when(flips, F.col("sign") * F.col("flip_open"))
        .otherwise(F.col("sign") * F.col("last_close"))
    )
    choose = lambda at_hit, at_flip, at_end: F.when(hit, at_hit).when(flips, at_flip).otherwise(at_end)
    return joined.withColumns(
        {
            "exit_index": choose(F.col("hit.index"), F.col("flip_index"), F.col("last_index")),
            "exit_time": choose(F.col("hit.time"), F.col("flip_time"), F.col("last_timestamp")),
            "exit_reason": choose(F.col("hit.reason"), F.lit("signal_exit"), F.lit("forced_end")),
            "exit_s": execution_price(base, buying_in=False),
        }
    ).drop("hit")

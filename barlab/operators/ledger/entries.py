"""Candidate entries: every eligible signal, priced on the next bar's open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.functions.indicators import whole_blocks
from barlab.schemas import SERIES

# What a signal row must carry besides its levels (ATR and average columns).
SIGNAL_ROW = [
    "signal_key",
    *SERIES,
    "bar_index",
    "signal",
    "next_open",
    "next_timestamp",
    "last_index",
    "last_close",
    "last_timestamp",
]

CANDIDATE_KEY = ["run_id", *SERIES, "entry_index"]


def align_signals(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals onto bars by time: last one per timestamp wins, bars without one get 0.

    "Last" is the highest ``seq`` when the input has it, else the read order.
    """
    order = F.col("seq") if "seq" in signals.columns else F.monotonically_increasing_id()
    payload = [c for c in signals.columns if c not in (*SERIES, "timestamp", "seq")]
    latest = (
        signals.withColumn("arrival", order)
        .groupBy(*SERIES, "timestamp")
        .agg(F.max_by(F.struct(*payload), F.col("arrival")).alias("latest"))
        .select(*SERIES, "timestamp", "latest.*")
    )
    joined = bars.join(latest, [*SERIES, "timestamp"], "left")
    signal = F.coalesce(F.col("signal"), F.lit(0)) if "signal" in payload else F.lit(0)
    return joined.withColumn("signal", signal.cast("int"))


def pick(series_name: Column, columns: list[str]) -> Column:
    """Value of the column whose name the config row holds."""
    if not columns:
        return F.lit(None).cast("double")
    return F.coalesce(*[F.when(series_name == name, F.col(name)) for name in columns])


def execution_price(signed: Column, *, buying_in: bool) -> Column:
    """Signed price after half the spread and slippage, always against the trader."""
    half, slippage = F.col("spread") / F.lit(2.0), F.col("slippage")
    return signed + half + slippage if buying_in else signed - half - slippage


def distance(name: str, atr: Column) -> Column:
    """A setting as a price distance: absolute, or a multiple of ``atr``."""
    return F.when(F.col(f"{name}_mode") == "absolute", F.col(name)).when(
        F.col(f"{name}_mode") == "atr", F.col(name) * atr
    )


def executable(signal_rows: DataFrame) -> DataFrame:
    """Non-zero signals that have a next bar, each with the next opposite one.

    ``signal_rows`` is sparse (one row per signal, not per bar).  Sorting newest
    first turns "next following" into a running value, linear in the rows.  What
    follows in later blocks comes from one row per block, so no task holds a whole series.
    """
    active = signal_rows.where((F.col("signal") != 0) & F.col("next_timestamp").isNotNull())
    active = active.withColumn("signal_block", whole_blocks(F.col("bar_index")))
    fill = F.struct(
        (F.col("bar_index") + 1).alias("index"), F.col("next_open").alias("open"), F.col("next_timestamp").alias("time")
    )
    up, down = F.when(F.col("signal") > 0, fill), F.when(F.col("signal") < 0, fill)
    key = ["signal_key", *SERIES]
    # ``index`` comes first in ``fill``: the least is the earliest.
    firsts = active.groupBy(*key, "signal_block").agg(F.min(up).alias("up"), F.min(down).alias("down"))
    later = Window.partitionBy(*key).orderBy(F.col("signal_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = firsts.select(*key, "signal_block", *[F.last(name, ignorenulls=True).over(later).alias(f"later_{name}") for name in ("up", "down")])
    newest_first = (
        Window.partitionBy(*key, "signal_block").orderBy(F.col("bar_index").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    following = lambda here, name: F.coalesce(F.last(here, ignorenulls=True).over(newest_first), F.col(f"later_{name}"))
    return (
        active.join(after, [*key, "signal_block"])
        .withColumns({"next_up": following(up, "up"), "next_down": following(down, "down")})
        .withColumn("flip", F.when(F.col("signal") > 0, F.col("next_down")).otherwise(F.col("next_up")))
        .drop("later_up", "later_down")
    )


def beside_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Signals x runs of the same key and series, the blocks of a series dealt over as many tasks as there are.

    Runs are copied once per share of their series: at most once per shuffle partition and per block.
    """
    most = F.lit(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = F.least(whole_blocks(F.col("last_index")) + 1, most)
    dealt = rows.withColumn("share", F.pmod(F.col("signal_block"), shares))
    lengths = rows.groupBy(*SERIES).agg(F.max("last_index").alias("last_index"))
    copies = runs.join(lengths.select(*SERIES, F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1)).alias("share")), SERIES)
    return dealt.join(copies, ["signal_key", *SERIES, "share"]).drop("share", "signal_block")


def candidate_entries(signal_rows: DataFrame, runs: DataFrame, atr_columns: list[str], ma_columns: list[str]) -> DataFrame:
    """Signals x runs of the same signal key, side gates, warm-up gates and entry levels.

    ``runs`` are checked, valid configs with ``signal_key`` and, for MA stops,
    ``ma_stop_series`` naming the average to follow.  All prices are signed.
    """
    rows = executable(signal_rows)
    joined = beside_runs(rows, runs.withColumnRenamed("error", "config_error"))
    side = F.signum(F.col("signal")).cast("int")
    allowed = F.when(side > 0, F.col("allow_long")).otherwise(F.col("allow_short"))
    entry_atr = F.when(F.col("uses_atr"), pick(F.col("atr_series"), atr_columns))
    signal_ma = F.when(F.col("ma_stop"), pick(F.col("ma_stop_series"), ma_columns))
    gated = (
        joined.where(allowed)
        .withColumns({"sign": side, "atr_at_entry": entry_atr, "signal_ma": signal_ma})
        .where(~F.col("needs_entry_atr") | F.col("atr_at_entry").isNotNull())
        .where(~F.col("ma_stop") | F.col("signal_ma").isNotNull())
    )
    atr = F.col("atr_at_entry")
    priced = gated.withColumn("entry_s", execution_price(F.col("sign") * F.col("next_open"), buying_in=True))
    entry = F.col("entry_s")
    risk = F.col("position_sizing_mode") == "risk_percent"
    leveled = priced.withColumns(
        {
            "entry_index": F.col("bar_index") + 1,
            "entry_time": F.col("next_timestamp"),
            "stop_s": entry - distance("stop_loss", atr),
            "target_s": entry + distance("take_profit", atr),
            "activation_s": entry + distance("trailing_activation", atr),
            "break_even_at_s": entry + distance("break_even", atr),
            "break_even_stop_s": F.when(F.col("break_even").isNotNull(), entry + distance("break_even_buffer", atr)),
            "first_ma_stop_s": F.when(
                risk & F.col("ma_stop"), F.col("sign") * F.col("signal_ma") - distance("ma_stop_buffer", atr)
            ),
            "flip_index": F.col("flip.index"),
            "flip_open": F.col("flip.open"),
            "flip_time": F.col("flip.time"),
            "limit_index": F.coalesce(F.col("flip.index") - 1, F.col("last_index")),
        }
    )
    gap = F.abs(entry - F.greatest("stop_s", "first_ma_stop_s"))
    sized = leveled.withColumn("stop_distance", F.when(gap > 0, gap))
    return sized.where(~risk | F.col("stop_distance").isNotNull()).drop("flip", "next_up", "next_down", "config_error")

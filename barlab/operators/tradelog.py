"""Cleansing of external trade logs and their chart segments.

Every row gets the first reason it is rejected for, in rule order; one grouped
count of those reasons gives the warnings a sequential cleansing would report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlab.functions.nulls import nan_to_null, require_columns
from barlab.functions.timeframes import parse_bound

REQUIRED = ["trade_id", "side", "entry_time", "entry_price"]
NUMERIC = ["stop_loss", "take_profit", "size", "pnl"]

# --- fixed values: rejection reasons in the order the rules apply ---
REJECTIONS = [
    "invalid_entry_time",
    "invalid_entry_price",
    "invalid_side",
    "invalid_trade_duration",
    "pair_mismatch",
    "timeframe_mismatch",
    "trade_outside_chart_window",
]


def _time(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("timestamp")
    if dict(df.dtypes)[name] == "string":
        return F.try_to_timestamp(F.col(name))
    return F.col(name).cast("timestamp")


def _number(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    return nan_to_null(F.col(name).try_cast("double"))


def examine(log: DataFrame, *, pair: str, timeframe: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Parsed and repaired rows with ``rejected`` (NULL = kept), ``rank`` of the reason and repair flags.

    ``seq`` (the row position) names trades without an id; without it a unique
    but not dense number is used.
    """
    require_columns(log, REQUIRED, "trade")
    seq = F.col("seq") if "seq" in log.columns else F.monotonically_increasing_id()
    blank = F.col("trade_id").isNull() | (F.trim(F.col("trade_id").cast("string")) == "")
    parsed = log.withColumns(
        {
            "id_missing": blank,
            "trade_id": F.when(blank, F.concat(F.lit("trade_"), seq.cast("string"))).otherwise(F.col("trade_id").cast("string")),
            "entry_time": _time(log, "entry_time"),
            "entry_price": _number(log, "entry_price"),
            "side": F.lower(F.col("side").cast("string")),
            "exit_time": _time(log, "exit_time"),
            "exit_price": _number(log, "exit_price"),
            **{name: _number(log, name) for name in NUMERIC},
            **{
                f"{name}_invalid": (F.col(name).isNotNull() & _number(log, name).isNull()) if name in log.columns else F.lit(False)
                for name in NUMERIC
            },
        }
    )
    unpriced = F.col("exit_time").isNotNull() & F.col("exit_price").isNull()
    repaired = parsed.withColumn("exit_unpriced", unpriced).withColumn(
        "exit_time", F.when(~F.col("exit_unpriced"), F.col("exit_time"))
    )
    same = lambda name, wanted, fold: F.coalesce(fold(F.col(name).cast("string")) == wanted, F.lit(False))
    mismatch = lambda name, wanted, fold: ~same(name, wanted, fold) if name in log.columns else F.lit(False)
    low, high = parse_bound(start), parse_bound(end, is_end=True)
    inside = F.lit(True)
    if high is not None:
        inside = inside & (F.col("entry_time") <= F.lit(high))
    if low is not None:
        inside = inside & (F.coalesce("exit_time", "entry_time") >= F.lit(low))
    violated = [
        F.col("entry_time").isNull(),
        F.col("entry_price").isNull(),
        ~F.coalesce(F.col("side").isin("long", "short"), F.lit(False)),
        F.col("exit_time") < F.col("entry_time"),
        mismatch("pair", pair.upper(), F.upper),
        mismatch("timeframe", timeframe.lower(), F.lower),
        ~inside,
    ]
    rank = F.coalesce(
        *[F.when(condition, F.lit(i)) for i, condition in enumerate(violated)], F.lit(len(REJECTIONS))
    )
    assumed = {
        "pair": F.lit(pair.upper()) if "pair" not in log.columns else F.col("pair"),
        "timeframe": F.lit(timeframe.lower()) if "timeframe" not in log.columns else F.col("timeframe"),
    }
    return (
        repaired.withColumn("rank", rank)
        .withColumn("rejected", F.element_at(F.array(*[F.lit(r) for r in REJECTIONS], F.lit(None).cast("string")), F.col("rank") + 1))
        .withColumns(assumed)
    )


CLEAN_COLUMNS = [
    "trade_id", "pair", "timeframe", "side", "entry_time", "entry_price", "exit_time", "exit_price", *NUMERIC,
]
FREE_COLUMNS = ["outcome", "strategy_name", "notes"]


def clean_trades(examined: DataFrame) -> DataFrame:
    """Kept rows; sort by (entry_time, trade_id) where order matters."""
    free = [c for c in FREE_COLUMNS if c in examined.columns]
    return examined.where(F.col("rejected").isNull()).select(*CLEAN_COLUMNS, *free)


def warnings(examined: DataFrame) -> DataFrame:
    """(code, count) of everything dropped, repaired or noted, from one aggregation."""
    reached = lambda reason: F.col("rank") > REJECTIONS.index(reason)
    kept = F.col("rejected").isNull()
    noted = {
        "missing_trade_id": F.col("id_missing"),
        **{reason: F.col("rejected") == reason for reason in REJECTIONS},
        "missing_exit_price": F.col("exit_unpriced") & reached("invalid_side"),
        **{f"invalid_{name}": F.col(f"{name}_invalid") & reached("invalid_trade_duration") for name in NUMERIC},
        "open_trade": kept & F.col("exit_time").isNull(),
        "missing_stop_loss": kept & F.col("stop_loss").isNull(),
        "missing_take_profit": kept & F.col("take_profit").isNull(),
    }
    totals = examined.agg(*[F.count_if(F.coalesce(condition, F.lit(False))).alias(code) for code, condition in noted.items()])
    listed = ", ".join(f"'{code}', {code}" for code in noted)
    return totals.select(F.expr(f"stack({len(noted)}, {listed}) AS (code, count)")).where(F.col("count") > 0)


def schema_notes(log: DataFrame) -> list[str]:
    """Codes for absent optional columns that change the result."""
    return [f"missing_{name}_column" for name in ("exit_time", "exit_price", "pair", "timeframe") if name not in log.columns]


def chart_segments(
    trades: DataFrame,
    *,
    chart_end: str | None = None,
    show_entries: bool = True,
    show_exits: bool = True,
    show_trade_lines: bool = True,
    show_stop_loss: bool = True,
    show_take_profit: bool = True,
) -> DataFrame:
    """Markers and line segments: (trade_id, side, kind, x0, y0, x1, y1).

    Stop and target lines of open trades run to the end of the chart.
    """
    end = parse_bound(chart_end, is_end=True)
    chart_end_time = F.lit(end).cast("timestamp")
    closed = F.col("exit_time").isNotNull() & F.col("exit_price").isNotNull()
    until = F.coalesce(F.col("exit_time"), chart_end_time, F.col("entry_time"))
    none = F.lit(None)

    def item(kind, shown, x0, y0, x1, y1):
        return F.struct(
            F.lit(kind).alias("kind"), shown.alias("shown"), x0.alias("x0"), y0.cast("double").alias("y0"),
            x1.cast("timestamp").alias("x1"), y1.cast("double").alias("y1"),
        )

    entry, price = F.col("entry_time"), F.col("entry_price")
    level = lambda kind, on, name: item(kind, F.lit(on) & F.col(name).isNotNull(), entry, F.col(name), until, F.col(name))
    items = F.array(
        item("entry", F.lit(show_entries), entry, price, none, none),
        item("exit", F.lit(show_exits) & closed, F.col("exit_time"), F.col("exit_price"), none, none),
        item("trade_line", F.lit(show_trade_lines) & closed, entry, price, F.col("exit_time"), F.col("exit_price")),
        level("stop_line", show_stop_loss, "stop_loss"),
        level("target_line", show_take_profit, "take_profit"),
    )
    return trades.select("trade_id", "side", F.inline(items)).where("shown").drop("shown")

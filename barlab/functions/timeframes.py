"""UTC time bounds, timeframe lengths and bucket arithmetic."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

from barlab.schemas import TIMEFRAME_SECONDS, TIMEFRAMES


def utc(column: Column) -> Column:
    """Any timestamp-like column as an instant (the session runs in UTC)."""
    return column.cast("timestamp")


def parse_bound(value: str | None, *, is_end: bool = False) -> datetime | None:
    """Inclusive UTC bound; a date-only end means the last microsecond of that day."""
    if not value:
        return None
    moment = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    moment = moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)
    if is_end and len(value) <= 10:
        moment = moment + timedelta(days=1) - timedelta(microseconds=1)
    return moment


def within(column: Column, start: str | None, end: str | None) -> Column:
    """Inclusive range predicate; plain comparisons, so it reaches the Parquet scan."""
    low, high = parse_bound(start), parse_bound(end, is_end=True)
    predicate = F.lit(True)
    if low is not None:
        predicate = predicate & (column >= F.lit(low))
    if high is not None:
        predicate = predicate & (column <= F.lit(high))
    return predicate


def _choose(timeframe: Column, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(part) for item in table.items() for part in item]), timeframe)


def seconds_of(timeframe: Column) -> Column:
    """Length in seconds of a timeframe column, NULL when unknown."""
    return _choose(timeframe, TIMEFRAME_SECONDS)


def rank_of(timeframe: Column) -> Column:
    """Position in the fine-to-coarse order, NULL when unknown."""
    return _choose(timeframe, {name: rank for rank, name in enumerate(TIMEFRAMES)})


def bucket_start(timestamp: Column, seconds: Column | int) -> Column:
    """Left edge of the epoch-aligned bucket holding ``timestamp``."""
    length = F.lit(seconds) if isinstance(seconds, int) else seconds
    micros = F.unix_micros(timestamp)
    return F.timestamp_micros(micros - F.pmod(micros, length.cast("bigint") * F.lit(1_000_000)))

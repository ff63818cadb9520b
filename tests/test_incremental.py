"""Incremental building of all timeframes: batches against one pass, late pairs, repeats, bar sources, long histories."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barlab.operators.resample import bars_to_all_bars, ticks_to_all_bars
from barlab.streaming.incremental import Build

START = datetime(2025, 3, 1)
TICKS = "pair string, timestamp timestamp, mid double, spread double, seq bigint"
OHLC = ["pair", "timeframe", "timestamp", "open", "high", "low", "close"]


def ticks(seed: int, n: int, pairs=("A", "B")) -> list[tuple]:
    rng, out, now = random.Random(seed), [], START
    for i in range(n):
        now += timedelta(seconds=rng.choice([0, 5, 40, 600, 9000]))
        out.append((rng.choice(pairs), now, rng.choice([None, *[float(x) for x in range(90, 110)]]), rng.choice([0.5, 1.0]), i))
    return out


def same(got, want, columns) -> None:
    mine, theirs = (sorted(map(tuple, df.select(*columns).collect()), key=str) for df in (got, want))
    assert mine == theirs and mine


def test_batches_equal_one_pass(spark, tmp_path):
    """Batches cut buckets anywhere; each is taken twice, as after a failure."""
    rows, build = ticks(1, 240), Build(str(tmp_path))
    for number, at in enumerate(range(0, 240, 60)):
        batch = spark.createDataFrame(rows[at : at + 60], TICKS)
        build.take(batch, number)
        build.take(batch, number)
    every = ticks_to_all_bars(spark.createDataFrame(rows, TICKS))
    same(build.flushed(spark), every, [*OHLC, "spread", "tick_count"])
    reached = {r.pair: r.latest for r in build.marks(spark).collect()}
    assert reached == {p: max(t for q, t, *_ in rows if q == p) for p in "AB"} and build.marks(spark).where("failed").isEmpty()
    assert build.closed(spark).count() < every.count()


def test_one_late_pair_fails_alone(spark, tmp_path):
    rows, build = ticks(2, 120), Build(str(tmp_path), timeframes=("1h", "4h"))
    build.take(spark.createDataFrame(rows[:60], TICKS), 0)
    late = [("A", START, 100.0, 0.5, 999), ("A", START, 101.0, 0.5, 1000)]
    build.take(spark.createDataFrame(rows[60:] + late, TICKS), 1)
    assert {(r.pair, r.late, r.failed) for r in build.marks(spark).collect()} == {("A", 2, True), ("B", 0, False)}
    same(build.flushed(spark), ticks_to_all_bars(spark.createDataFrame([r for r in rows if r[0] == "B"], TICKS), ["1h", "4h"]), OHLC)
    build.take(spark.createDataFrame([("A", datetime(2026, 1, 1), 1.0, 0.5, 1), ("B", datetime(2026, 1, 1), 1.0, 0.5, 1)], TICKS), 2)
    assert {r.pair for r in build.closed(spark).collect()} == {"B"}


def test_ticks_out_of_order_in_an_open_bucket_are_not_late(spark, tmp_path):
    build, minute = Build(str(tmp_path), timeframes=("1h",)), timedelta(minutes=1)
    build.take(spark.createDataFrame([("A", START + 30 * minute, 5.0, 0.5, 1)], TICKS), 0)
    build.take(spark.createDataFrame([("A", START + 10 * minute, 7.0, 0.5, 2)], TICKS), 1)
    row = build.flushed(spark).first()
    assert (row.open, row.close, row.tick_count) == (7.0, 5.0, 2) and build.marks(spark).first().late == 0


def test_bar_source(spark, tmp_path):
    rng = random.Random(4)
    rows = [("A", START + timedelta(hours=h), *[rng.choice([None, 1.0, 2.0, 3.0]) if h % 9 == 0 else float(rng.randint(1, 9)) for _ in range(4)], float(h % 3), float(h)) for h in range(70)]
    bars = spark.createDataFrame(rows, "pair string, timestamp timestamp, open double, high double, low double, close double, spread double, volume double")
    build = Build(str(tmp_path), source_timeframe="1h", timeframes=("4h", "1d"))
    for number in range(3):
        build.take(bars.where((F.hour("timestamp") >= 0) & (F.col("volume") >= 25 * number) & (F.col("volume") < 25 * (number + 1))), number)
    same(build.flushed(spark), bars_to_all_bars(bars, "1h", ["4h", "1d"]), [*OHLC, "spread", "volume"])
    with pytest.raises(ValueError):
        Build(str(tmp_path), timeframes=("2h",)).names


def test_stream_of_files_and_state_of_a_batch(spark, tmp_path):
    """From a folder, a file a batch; what a batch reads besides its rows does not grow with the history."""
    rows, build = ticks(5, 480, pairs=("A",)), Build(f"{tmp_path}/build", timeframes=("1h", "1d"))
    for at in range(0, 480, 60):
        spark.createDataFrame(rows[at : at + 60], TICKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
    stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ticks")
    build.run_available(stream)
    assert build.last_batch(spark) == 7
    same(build.flushed(spark), ticks_to_all_bars(spark.createDataFrame(rows, TICKS), ["1h", "1d"]), OHLC)
    for number in range(8):
        assert spark.read.parquet(build.folder("marks", number)).count() == 1 and spark.read.parquet(build.folder("open", number)).count() == 2
    build.run_available(stream)
    assert build.last_batch(spark) == 7

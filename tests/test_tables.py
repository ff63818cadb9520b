"""Resampling, sources, checks, trade logs, shortlist, audit, experiments, streaming on small frames."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barlab.functions.timeframes import parse_bound
from barlab.operators.audit import file_facts, inspect_csv, inspect_parquet, pair_findings, pair_summary, quality_flags, raw_roots
from barlab.operators.quality import candle_warnings, enforce_bar_limit, validate_stored
from barlab.operators.resample import bars_to_bars, targets_for, ticks_to_all_bars, ticks_to_bars
from barlab.operators.shortlist import display, shortlist
from barlab.operators.tradelog import chart_segments, clean_trades, examine, schema_notes, warnings
from barlab.plans.experiments import (
    RESULT_COLUMNS,
    experiment_matrix,
    in_matrix_order,
    progress,
    resume,
    run_experiments,
    select_values,
    slices,
)
from barlab.sources.candles import outputs_to_build, read_candles, write_candles
from barlab.sources.results import append_failures, append_results, completed_hashes, failed_hashes
from barlab.sources.ticks import normalize_bars, normalize_ticks
from barlab.streaming.bars import late_rows, require_in_order, run_available, stream_ticks, streaming_bars, with_open_bars
from tests.helpers import candles, moment

TICK = "pair STRING, timestamp TIMESTAMP, seq BIGINT, mid DOUBLE, spread DOUBLE"


def ticks(spark, rows):
    return spark.createDataFrame([("EURUSD", datetime(2025, 1, 1, *at), i, mid, spread) for i, (at, mid, spread) in enumerate(rows)], TICK)


ROWS = [
    ((0, 1), 2.0, 0.1), ((0, 2), None, 0.3), ((0, 59), 1.0, None), ((0, 59), 3.0, 0.2), ((1, 0), 5.0, None), ((2, 30), None, 0.5), ((5, 0), 4.0, 0.4),
]


def test_tick_bars(spark):
    rows = ticks_to_bars(ticks(spark, ROWS), "1h").orderBy("timestamp").collect()
    first = rows[0]
    assert (first.open, first.high, first.low, first.close, first.tick_count) == (2.0, 3.0, 1.0, 3.0, 4)
    assert first.spread == pytest.approx(0.2)
    # The 02:00 bucket has ticks but no mid.
    assert [r.timestamp.hour for r in rows] == [0, 1, 5] and rows[1].spread is None


def test_fan_out_equals_direct_bars(spark):
    source = ticks(spark, ROWS)
    every = ticks_to_all_bars(source)
    for timeframe in ("1m", "1h", "4h", "1d"):
        direct = ticks_to_bars(source, timeframe)
        assert sorted(every.where(F.col("timeframe") == timeframe).collect()) == sorted(direct.collect())


def test_bars_to_bars_volume_and_nulls(spark):
    fine = candles(spark, [(1, 2, 0.5, 1.5), (1.5, 3, 1, 2), (2, 2, 2, 2)]).withColumn("volume", F.lit(None).cast("double"))
    fine = fine.withColumn("open", F.when(F.col("open") != 1, F.col("open")))
    row = bars_to_bars(fine, "4h", "1h").collect()[0]
    assert (row.open, row.high, row.low, row.close, row.volume) == (1.5, 3.0, 0.5, 2.0, 0.0)
    assert bars_to_bars(fine, "1h", "1h").count() == 3
    assert targets_for("1h") == ["1h", "4h", "1d"]
    with pytest.raises(ValueError):
        bars_to_bars(fine, "5m", "1h")


def test_normalisation_by_present_columns(spark):
    quotes = spark.createDataFrame([("EURUSD", datetime(2025, 1, 1), 1.0, 3.0)], "pair STRING, timestamp TIMESTAMP, bid DOUBLE, ask DOUBLE")
    row = normalize_ticks(quotes).collect()[0]
    assert (row.mid, row.spread) == (2.0, 2.0)
    with pytest.raises(ValueError):
        normalize_ticks(quotes.drop("ask"))
    with pytest.raises(ValueError):
        normalize_bars(quotes)
    nan = quotes.withColumn("mid", F.lit(float("nan")))
    assert normalize_ticks(nan).collect()[0].mid is None


def test_bounds():
    assert parse_bound("2025-01-02", is_end=True).isoformat() == "2025-01-02T23:59:59.999999+00:00"
    assert parse_bound("2025-01-02T03:00:00+02:00").isoformat() == "2025-01-02T01:00:00+00:00"
    assert parse_bound(None) is None


def test_candle_store(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = candles(spark, [(1, 2, 0.5, 1.5)] * 30)
    write_candles(rows, root)
    found = read_candles(spark, root, "eurusd", "1H", "2025-01-01T05:00:00", "2025-01-01")
    assert found.count() == 19
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "timestamp" in plan and "PartitionFilters: [isnotnull(pair" in plan
    with pytest.raises(ValueError, match="No candle rows"):
        read_candles(spark, root, "EURUSD", "1h", "2030-01-01", "2030-01-02")
    write_candles(rows.union(rows), root)
    with pytest.raises(ValueError, match="duplicate"):
        read_candles(spark, root, "EURUSD", "1h")
    wanted = spark.createDataFrame([("EURUSD", "1h"), ("EURUSD", "4h")], "pair STRING, timeframe STRING")
    assert outputs_to_build(wanted, spark.read.parquet(root)).count() == 2
    write_candles(rows, root)
    assert [r.timeframe for r in outputs_to_build(wanted, spark.read.parquet(root)).collect()] == ["4h"]
    assert outputs_to_build(wanted, spark.read.parquet(root), overwrite=True).count() == 2


def test_candle_warnings(spark):
    rows = spark.createDataFrame(
        [("P", "1h", 0, "2025-01-01 00:00:00", 1.0), ("P", "1h", 1, "2025-01-01 02:00:00", None), ("P", "1h", 2, "2025-01-01 01:00:00", 1.0),
         ("P", "1h", 3, "2025-01-01 01:00:00", 1.0), ("P", "1h", 4, "later", 1.0), ("Q", "1h", 0, "2025-01-01 00:00:00", 1.0)],
        "pair STRING, timeframe STRING, seq BIGINT, timestamp STRING, close DOUBLE",
    ).selectExpr("*", "close AS open", "close AS high", "close AS low")
    found = {(r.pair, r.code): r["count"] for r in candle_warnings(rows).collect()}
    assert found == {
        ("P", "invalid_timestamp"): 1, ("P", "timestamps_not_sorted"): None, ("P", "duplicate_timestamps"): 1, ("P", "missing_ohlc"): 1,
    }
    with pytest.raises(ValueError):
        candle_warnings(rows.drop("open"))


def test_bar_limit(spark):
    rows = candles(spark, [(1, 1, 1, 1)] * 5)
    assert enforce_bar_limit(rows, max_bars=5, truncate=False) == (rows, None)
    with pytest.raises(ValueError):
        enforce_bar_limit(rows, max_bars=4, truncate=False)
    kept, warning = enforce_bar_limit(rows, max_bars=2, truncate=True)
    assert sorted(r.timestamp for r in kept.collect()) == [moment(3), moment(4)] and warning["requested_bars"] == 5


def test_stored_bar_rules(spark):
    good = candles(spark, [(1, 1, 1, 1)] * 4)
    verdict = lambda df: tuple(validate_stored(df).select("valid", "message").collect()[0])
    assert verdict(good) == (True, "validated 4 rows")
    assert verdict(good.union(good))[1] == "duplicate timestamps detected"
    assert verdict(good.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 MINUTE")))[1].startswith("timestamps are not aligned")
    empty = good.withColumns({c: F.lit(None).cast("double") for c in ("open", "high", "low", "close")})
    assert verdict(empty)[1] == "all-null OHLC row detected"
    assert "missing required columns" in validate_stored(good.drop("open")).collect()[0].message


LOG = "trade_id STRING, side STRING, entry_time STRING, entry_price STRING, exit_time STRING, exit_price STRING, stop_loss STRING, seq BIGINT"


def test_trade_log(spark):
    rows = [
        ("a", "LONG", "2025-01-01 01:00:00", "1.0", "2025-01-01 02:00:00", "1.1", "0.9", 0),
        (" ", "short", "2025-01-01 03:00:00", "1.0", "2025-01-01 04:00:00", None, "x", 1),
        ("c", "flat", "2025-01-01 03:00:00", "1.0", None, None, None, 2),
        ("d", "long", "bad", "1.0", None, None, None, 3),
        ("e", "long", "2025-01-01 03:00:00", "n/a", None, None, None, 4),
        ("f", "long", "2025-01-01 03:00:00", "1.0", "2025-01-01 01:00:00", "1.0", None, 5),
        ("g", "long", "2026-01-01 03:00:00", "1.0", None, None, None, 6),
    ]
    log = spark.createDataFrame(rows, LOG)
    looked = examine(log, pair="eurusd", timeframe="1H", start="2025-01-01", end="2025-01-31")
    kept = clean_trades(looked).orderBy("entry_time", "trade_id").collect()
    assert [(r.trade_id, r.side, r.exit_price, r.pair) for r in kept] == [("a", "long", 1.1, "EURUSD"), ("trade_1", "short", None, "EURUSD")]
    assert {r.code: r["count"] for r in warnings(looked).collect()} == {
        "missing_trade_id": 1, "invalid_entry_time": 1, "invalid_entry_price": 1, "invalid_side": 1, "invalid_trade_duration": 1,
        "trade_outside_chart_window": 1, "missing_exit_price": 1, "invalid_stop_loss": 1, "open_trade": 1, "missing_stop_loss": 1,
        "missing_take_profit": 2,
    }
    assert schema_notes(log) == ["missing_pair_column", "missing_timeframe_column"]
    kinds = [(r.trade_id, r.kind) for r in chart_segments(clean_trades(looked), chart_end="2025-01-31").orderBy("trade_id", "kind").collect()]
    assert kinds == [("a", "entry"), ("a", "exit"), ("a", "stop_line"), ("a", "trade_line"), ("trade_1", "entry")]
    with pytest.raises(ValueError):
        examine(log.drop("side"), pair="EURUSD", timeframe="1h")


RESULT = "config_hash STRING, pair STRING, timeframe STRING, entry_type STRING, ma_types STRING, ma_periods STRING, exit_profile STRING, total_trades INT, profit_factor DOUBLE, max_drawdown DOUBLE, win_rate DOUBLE, net_pnl DOUBLE"


def result_rows(spark):
    base = ("EURUSD", "1h", "crossover", "ema,sma", "25,50", "atr12")
    return spark.createDataFrame(
        [("a", *base, 250, 1.5, -0.10, 0.45, 0.2), ("b", *base, 300, 1.2, -0.2, 0.4, 0.1), ("c", *base, 100, 2.0, -0.1, 0.5, 0.3),
         ("d", *base, 300, float("nan"), -0.1, 0.5, 0.3), ("e", *base, 300, 1.1, 0.0, 0.35, 0.3)], RESULT,
    )


def test_shortlist(spark):
    best = shortlist(result_rows(spark))
    assert [r.config_hash for r in best.collect()] == ["a", "b", "e"]
    assert [r.config_hash for r in shortlist(result_rows(spark), sort_by="rd_ratio").collect()] == ["a", "b", "e"]
    row = display(best).collect()[0]
    assert row.summary == "EURUSD 1h crossover ema/sma 25/50 exit=atr12" and row.win_rate == 45.0 and row.rd_ratio == 2.0 and row.final_capital is None
    renamed = result_rows(spark).withColumnsRenamed({"win_rate": "win_rate_pct", "total_trades": "trades"})
    assert shortlist(renamed, top=1).count() == 1
    with pytest.raises(ValueError):
        shortlist(result_rows(spark), sort_by="nothing")
    with pytest.raises(ValueError):
        shortlist(result_rows(spark).drop("win_rate"))


def test_audit(spark, tmp_path):
    tree = ["cleaned_ticks/EURUSD/x.parquet", "bars/15m/gbpusd_15m.parquet", "bars/1h/gbpusd_recent.csv", "raw/AUDUSD/2020/01.bi5", "raw/AUDUSD/2020/02.bi5", "x/readme"]
    facts = file_facts(spark.createDataFrame([(p,) for p in tree], "path STRING"), 2026)
    summary = {r.pair: r for r in pair_summary(facts, this_year=2026).collect()}
    assert summary["EURUSD"].missing_timeframes == [] and summary["GBPUSD"].buildable_timeframes == ["15m", "30m", "1h", "4h", "1d"]
    assert summary["AUDUSD"].raw_only and summary["AUDUSD"].observed_years == [2020]
    assert summary["AUDUSD"].gaps_2025_now == [2025, 2026]
    assert {(r.finding, r.pair) for r in pair_findings(pair_summary(facts, this_year=2026)).collect()} >= {("missing", "USDCAD"), ("raw_only", "AUDUSD")}
    flags = {r.flag: r.raised for r in quality_flags(facts, pair_summary(facts, this_year=2026)).collect()}
    assert flags == {"recent_overlap": True, "raw_variants": False, "latest_snapshot": False, "audusd_raw_only": True, "usdcad_absent": True}
    roots = raw_roots(facts).collect()
    assert [(r.root, r.file_count, r.years, r.pair) for r in roots] == [("raw/AUDUSD/2020", 2, [2020], "AUDUSD")]
    folder = tmp_path / "data"
    candles(spark, [(1, 1, 1, 1)] * 3).coalesce(1).write.parquet(str(folder / "a"))
    spark.createDataFrame([("2025-01-01 00:00:00",), ("bad",)], "time STRING").coalesce(1).write.option("header", True).csv(str(folder / "b"))
    parquet = inspect_parquet(spark, str(folder / "a")).collect()
    assert [(r.row_count, r.timestamp_column, r.max_timestamp) for r in parquet] == [(3, "timestamp", moment(2))]
    text = inspect_csv(spark, str(folder / "b")).collect()
    assert [(r.row_count, r.timestamp_column, r.min_timestamp) for r in text] == [(2, "time", datetime(2025, 1, 1))]


SERIES = [("EURUSD", "1h"), ("USDJPY", "4h")]
GRID = dict(periods_2=[(2, 3)], types_2=[("sma", "sma")], periods_3=[(2, 3, 4)], types_3=[("sma", "sma", "ema")])


def test_matrix_rules(spark):
    series = spark.createDataFrame(SERIES, "pair STRING, timeframe STRING")
    matrix = experiment_matrix(series, exit_profiles=["none", "ATR12", "atr_trailing"], **GRID)
    rows = matrix.collect()
    assert not [r for r in rows if len(r.ma_periods) == 3 and r.entry_type == "crossover"]
    assert {r.exit_profile for r in rows} == {"atr12", "atr_trailing"}
    assert len(rows) == 2 * 5 * 3 and len({r.config_hash for r in rows}) == len(rows)
    chandelier = [r for r in rows if r.trailing_type_variant == "chandelier"]
    assert all(r.trailing_stop is None and r.chandelier_multiplier == 1.5 and r.trailing_type == "chandelier" for r in chandelier)
    fixed = experiment_matrix(series, exit_profiles=["none"], settings={"position_sizing_mode": "fixed"}, **GRID)
    assert fixed.count() == 10
    assert {r.runs for r in slices(matrix).collect()} == {15}
    ordered = in_matrix_order(matrix).collect()
    assert [(r.pair, r.timeframe) for r in ordered] == sorted((r.pair, r.timeframe) for r in rows)
    v2 = experiment_matrix(series, exit_profiles=["atr12"], version="v2", **GRID)
    assert v2.join(matrix, "config_hash").count() == 0
    assert select_values(["eurusd"], ["EURUSD"]) == ["EURUSD"] and select_values(None, ["a"]) == ["a"]
    with pytest.raises(ValueError):
        select_values(["x"], ["a"])


def test_resume_parts(spark, tmp_path):
    series = spark.createDataFrame(SERIES[:1], "pair STRING, timeframe STRING")
    matrix = experiment_matrix(series, exit_profiles=["atr12"], **GRID)
    results, log = str(tmp_path / "results"), str(tmp_path / "failed")
    assert completed_hashes(spark, results).count() == 0 and failed_hashes(spark, log).count() == 0
    hashes = [r.config_hash for r in in_matrix_order(matrix).collect()]
    append_results(matrix.where(F.col("config_hash") == hashes[0]).select("config_hash"), results, ["config_hash", "net_pnl"], {"net_pnl": "double"})
    append_failures(spark.createDataFrame([(hashes[1], "{}", "boom", "now"), ("", "{}", "blank", "now")], "config_hash STRING, config STRING, error STRING, timestamp STRING"), log)
    with open(f"{log}/extra.json", "w") as handle:
        handle.write("\nnot json\n")
    done, failed = completed_hashes(spark, results), failed_hashes(spark, log)
    assert tuple(progress(matrix, done, failed).collect()[0]) == (5, 1, 1, 3)
    assert [r.config_hash for r in in_matrix_order(resume(matrix, done, failed, 2)).collect()] == hashes[2:4]


def test_run_experiments_end_to_end(spark, tmp_path):
    values = [10, 11, 9, 12, 8, 13, 9, 14, 8, 12, 10, 15, 9, 13, 11, 8, 12, 14, 9, 10]
    frame = candles(spark, [(v, v + 1, v - 1, v) for v in values])
    series = frame.select("pair", "timeframe").distinct()
    good = experiment_matrix(series, exit_profiles=["fixed1010"], settings={"start_date": "2025-01-01", "end_date": "2025-01-31"}, **GRID)
    broken = good.withColumn("take_profit", F.when(F.col("entry_type") == "price_above_all", F.lit(-1.0)).otherwise(F.col("take_profit")))
    where = dict(results_path=str(tmp_path / "results"), failed_path=str(tmp_path / "failed"))
    before = run_experiments(spark, frame, broken, **where)
    assert tuple(before.collect()[0]) == (5, 0, 0, 5)
    rows = spark.read.parquet(where["results_path"])
    assert rows.columns == RESULT_COLUMNS and rows.count() == 3
    after = run_experiments(spark, frame, broken, **where)
    assert tuple(after.collect()[0]) == (5, 3, 2, 0)


def test_streaming_bars(spark, tmp_path):
    folder, out, state = str(tmp_path / "ticks"), str(tmp_path / "bars"), str(tmp_path / "state")
    early = ticks(spark, ROWS[:5])
    early.coalesce(1).write.parquet(folder)
    stream = lambda: streaming_bars(stream_ticks(spark, folder, early.schema), "1h")
    run_available(stream(), out, state)
    assert [r.timestamp.hour for r in spark.read.parquet(out).collect()] == [0]
    later = ticks(spark, ROWS).where("seq >= 5")
    later.coalesce(1).write.mode("append").parquet(folder)
    run_available(stream(), out, state)
    require_in_order(spark.read.parquet(folder), spark.read.parquet(out), "1h")
    closed = spark.read.parquet(out)
    assert sorted(r.timestamp.hour for r in closed.collect()) == [0, 1]
    complete = with_open_bars(closed, spark.read.parquet(folder), "1h")
    assert sorted(complete.collect()) == sorted(ticks_to_bars(ticks(spark, ROWS), "1h").collect())
    ticks(spark, ROWS[:1]).coalesce(1).write.mode("append").parquet(folder)
    run_available(stream(), out, state)
    run_available(stream(), out, state)  # a restart that sees nothing new forgets nothing
    seen = spark.read.parquet(folder), spark.read.parquet(out), "1h"
    assert late_rows(*seen) == 1
    with pytest.raises(ValueError):
        require_in_order(*seen)

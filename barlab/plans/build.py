"""From source files to the candle store."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from barlab.functions.timeframes import within
from barlab.operators.quality import validate_stored
from barlab.operators.resample import bars_to_all_bars, requested, targets_for, ticks_to_all_bars
from barlab.schemas import SERIES, TARGET_PAIRS
from barlab.session import materialize
from barlab.sources.candles import outputs_to_build, remove_series, write_candles
from barlab.sources.catalogue import bar_files, choose_sources, list_files, prune_by_year, tick_files
from barlab.sources.ticks import normalize_bars, normalize_ticks


def build_from_ticks(ticks: DataFrame, timeframes: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """All requested bars of all pairs from one scan; the window filter reaches the scan."""
    normal = normalize_ticks(ticks)
    return ticks_to_all_bars(normal.where(within(F.col("timestamp"), start, end)), timeframes)


def build_from_bars(
    bars: DataFrame, source_timeframe: str, timeframes: list[str] | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    normal = normalize_bars(bars)
    return bars_to_all_bars(normal.where(within(F.col("timestamp"), start, end)), source_timeframe, timeframes)


def choose_files(
    spark: SparkSession,
    root: str,
    *,
    pairs: list[str] = TARGET_PAIRS,
    start: str | None = None,
    end: str | None = None,
    source_timeframe: str | None = None,
) -> DataFrame:
    """(pair, source_kind, source_timeframe, path) of the files a build will read."""
    files = list_files(spark, root, "*.parquet")
    chosen = choose_sources(tick_files(files, pairs), bar_files(files, pairs), source_timeframe)
    return prune_by_year(chosen, start, end)


def build_store(
    spark: SparkSession,
    input_root: str,
    output_root: str,
    *,
    pairs: list[str] = TARGET_PAIRS,
    timeframes: list[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    source_timeframe: str | None = None,
    overwrite: bool = True,
) -> DataFrame:
    """Build the store; one row per asked (pair, timeframe): pair, timeframe, source_timeframe, status, reason.

    ``built``: written.  ``skipped``: a valid output is there and ``overwrite`` is off.  ``empty``: the source has no row
    in the window; an older output is removed.  ``unservable``: the source is coarser.  ``no_source``: no file was found.

    The path list of one (pair, source) goes through the driver as reader arguments, as any file listing does; rows never do.
    """
    root, names = input_root.rstrip("/"), requested(timeframes)
    chosen = choose_files(spark, root, pairs=pairs, start=start, end=end, source_timeframe=source_timeframe)
    sources = {row.pair: row for row in chosen.groupBy("pair", "source_kind", "source_timeframe").agg(F.collect_list("path").alias("paths")).collect()}
    every = [pair for pair in dict.fromkeys([*pairs, *sources])]
    asked = [(pair, tf) for pair in every if pair in sources for tf in targets_for(sources[pair].source_timeframe, names)]
    stored = _stored(spark, output_root)
    todo, checked = set(asked), {}
    if asked and not overwrite and stored is not None:
        table = spark.createDataFrame(asked, "pair STRING, timeframe STRING")
        todo = {tuple(row) for row in outputs_to_build(table, stored.join(table, SERIES, "left_semi")).select(*SERIES).collect()}
    built = None
    for pair, source in sources.items():
        wanted = [tf for name, tf in asked if name == pair and (name, tf) in todo]
        if not wanted:
            continue
        rows = spark.read.parquet(*[f"{root}/{path}" for path in source.paths]).withColumn("pair", F.lit(pair))
        if source.source_kind == "ticks":
            bars = build_from_ticks(rows, wanted, start, end)
        else:
            bars = build_from_bars(rows, source.source_timeframe, wanted, start, end)
        built = bars if built is None else built.unionByName(bars)
    if built is not None:
        bars = materialize(built, "built")
        checked = {(row.pair, row.timeframe): row for row in validate_stored(bars).collect()}
        write_candles(bars, output_root)
        for pair, timeframe in todo - set(checked):
            remove_series(spark, output_root, pair, timeframe)
    outcomes = []
    for pair in every:
        source = sources.get(pair)
        for tf in names:
            row = checked.get((pair, tf))
            if source is None:
                outcome = ("no_source", "no source file for this pair and window")
            elif (pair, tf) not in asked:
                outcome = ("unservable", f"source bars of {source.source_timeframe} are coarser")
            elif (pair, tf) not in todo:
                outcome = ("skipped", "valid output kept")
            elif row is None:
                outcome = ("empty", "no source rows in the window")
            else:
                outcome = ("built" if row.valid else "failed", row.message)
            outcomes.append((pair, tf, source.source_timeframe if source else None, *outcome))
    return spark.createDataFrame(outcomes, "pair STRING, timeframe STRING, source_timeframe STRING, status STRING, reason STRING")


def _stored(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.parquet(root)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None

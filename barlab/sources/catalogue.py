"""Which source files to read, decided on a table of paths.

A path table has one row per file (``path``, optionally ``size_bytes``).  It is a
DataFrame, so choosing among millions of files is a job, not a driver loop.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barlab.functions.timeframes import parse_bound, rank_of
from barlab.schemas import TARGET_PAIRS, TIMEFRAMES

# --- fixed values: year suffixes that mark a canonical bar file, and the year floor of a window ---
FIRST_SUFFIX_YEAR, LAST_SUFFIX_YEAR = 2018, 2029
OPEN_SUFFIX = "2025_now"
OPEN_SUFFIX_YEAR = 2025
EARLIEST_YEAR = 2010


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path table of a folder tree; file contents are never read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select(F.col("path"), F.col("length").alias("size_bytes"))
    )
    prefix = root.rstrip("/") + "/"
    return files.withColumn("path", F.substring_index(F.col("path"), prefix, -1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def known_pair(path: Column, pairs: list[str] = TARGET_PAIRS) -> Column:
    """First known pair, in list order, that occurs anywhere in the path."""
    upper = F.upper(path)
    return F.coalesce(*[F.when(F.contains(upper, F.lit(pair)), F.lit(pair)) for pair in pairs])


def bar_timeframe(path: Column) -> Column:
    """First timeframe, finest first, named by a directory or inside the file name."""
    lower, name = F.lower(path), F.lower(file_name(path))
    return F.coalesce(
        *[
            F.when(F.contains(lower, F.lit(f"/{tf}/")) | F.contains(name, F.lit(f"_{tf}_")), F.lit(tf))
            for tf in TIMEFRAMES
        ]
    )


def tick_files(files: DataFrame, pairs: list[str] = TARGET_PAIRS) -> DataFrame:
    """Parquet files below ``cleaned_ticks/<pair>/``, except ``recent`` ones."""
    pair = F.regexp_extract("path", r"(?:^|/)cleaned_ticks/([^/]+)/.*\.parquet$", 1)
    return (
        files.withColumn("pair", pair)
        .where(F.col("pair").isin(pairs) & ~F.contains(F.lower(file_name(F.col("path"))), F.lit("recent")))
        .withColumns({"source_kind": F.lit("ticks"), "source_timeframe": F.lit("tick")})
    )


def bar_files(files: DataFrame, pairs: list[str] = TARGET_PAIRS) -> DataFrame:
    """Parquet files below ``bars/`` with a known pair and timeframe; no ``_raw`` or ``latest`` variants."""
    name = F.lower(file_name(F.col("path")))
    return (
        files.where(F.col("path").rlike(r"(^|/)bars/.*\.parquet$"))
        .where(~F.contains(name, F.lit("_raw")) & ~F.contains(name, F.lit("latest")))
        .withColumns({"pair": known_pair(F.col("path"), pairs), "source_timeframe": bar_timeframe(F.col("path"))})
        .where(F.col("pair").isNotNull() & F.col("source_timeframe").isNotNull())
        .withColumn("source_kind", F.lit("bars"))
    )


def is_granular(path: Column) -> Column:
    """Does the name end in a year suffix?"""
    name = F.lower(stem(path))
    year = F.regexp_extract(name, r"_(20\d{2})$", 1).try_cast("int")
    return F.coalesce(year.between(FIRST_SUFFIX_YEAR, LAST_SUFFIX_YEAR), F.lit(False)) | name.endswith(f"_{OPEN_SUFFIX}")


def canonical_files(bars: DataFrame) -> DataFrame:
    """Per (pair, timeframe): only year-suffixed files where there are any; never ``recent`` ones.

    The flag comes from a small aggregate joined back, so a pair with most of the
    files is not gathered into one window partition.
    """
    keys = ["pair", "source_timeframe"]
    marked = bars.withColumn("granular", is_granular(F.col("path")))
    any_granular = marked.groupBy(*keys).agg(F.bool_or("granular").alias("has_granular"))
    return (
        marked.join(any_granular, keys)
        .where(F.col("granular") | ~F.col("has_granular"))
        .where(~F.contains(F.lower(stem(F.col("path"))), F.lit("recent")))
        .drop("granular", "has_granular")
    )


def year_window(path: Column, this_year: int | None = None) -> tuple[Column, Column]:
    """First and last year named in a path, NULL when it names none."""
    now = this_year or datetime.now(timezone.utc).year
    years = F.transform(F.regexp_extract_all(path, F.lit(r"(20\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    is_open = F.contains(path, F.lit(OPEN_SUFFIX))
    return (
        F.when(is_open, F.lit(OPEN_SUFFIX_YEAR)).otherwise(F.array_min(years)),
        F.when(is_open, F.lit(now + 1)).otherwise(F.array_max(years)),
    )


def prune_by_year(files: DataFrame, start: str | None, end: str | None, this_year: int | None = None) -> DataFrame:
    """Drop files whose years cannot overlap the window; files without a year stay."""
    low, high = parse_bound(start), parse_bound(end, is_end=True)
    if low is None and high is None:
        return files
    now = this_year or datetime.now(timezone.utc).year
    first, last = year_window(F.col("path"), now)
    start_year = low.year if low else EARLIEST_YEAR
    end_year = high.year if high else now + 1
    return files.where(first.isNull() | ((last >= start_year) & (first <= end_year)))


def choose_sources(ticks: DataFrame, bars: DataFrame, forced: str | None = None) -> DataFrame:
    """Files of the chosen source per pair: the forced one, else ticks, else the finest bars."""
    columns = ["pair", "source_kind", "source_timeframe", "path"]
    offered = ticks.select(*columns).unionByName(canonical_files(bars).select(*columns))
    if forced:
        return offered.where(F.col("source_timeframe") == forced.lower())
    rank = F.when(F.col("source_kind") == "ticks", F.lit(-1)).otherwise(rank_of(F.col("source_timeframe")))
    best = offered.groupBy("pair").agg(F.min(rank).alias("best"))
    return offered.join(best, "pair").where(rank == F.col("best")).drop("best")


def read_ticks(spark: SparkSession, root: str, pairs: list[str] | str | None = None) -> DataFrame:
    """All tick files, recursively, in one scan; ``recent`` files are excluded before reading any row.

    A row's pair is the folder below ``cleaned_ticks`` that its file lies in.  ``pairs`` names one pair or several; None: all that are there.
    """
    base = f"{root.rstrip('/')}/cleaned_ticks"
    wanted = [pairs] if isinstance(pairs, str) else pairs
    folder = F.regexp_extract("_metadata.file_path", r"/cleaned_ticks/([^/]+)/", 1)
    return (
        spark.read.option("recursiveFileLookup", "true")
        .parquet(*([base] if wanted is None else [f"{base}/{pair}" for pair in wanted]))
        .where(~F.contains(F.lower(F.col("_metadata.file_name")), F.lit("recent")))
        .withColumn("pair", folder)
    )

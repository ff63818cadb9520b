"""Audit of a source file tree, on a table of relative paths and sizes."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlab.functions.timeframes import rank_of
from barlab.schemas import TARGET_PAIRS, TIMEFRAMES
from barlab.sources.catalogue import file_name, known_pair

# --- fixed values: file kinds, timestamp column priority and required years ---
STRUCTURED = [".parquet", ".csv", ".json", ".jsonl"]
USABLE = [".parquet", ".csv"]
RAW_SUFFIX = ".bi5"
TIMESTAMP_CANDIDATES = ["timestamp", "datetime", "time", "date", "ts"]
EARLIEST_YEAR = 2010
CLOSED_WINDOW = (2018, 2024)
OPEN_WINDOW_START = 2025


def _now(this_year: int | None) -> int:
    return this_year or datetime.now(timezone.utc).year


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot, '' when the name has none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def path_pair(path: Column) -> Column:
    """A known pair anywhere in the path, else the first free-standing six-letter word."""
    upper = F.translate(F.upper(path), "-/", "__")
    word = F.regexp_extract(upper, r"\b([A-Z]{6})\b", 1)
    return F.coalesce(known_pair(path), F.when(word != "", word))


def path_timeframes(path: Column) -> Column:
    """Timeframes named in the path, finest first."""
    pattern = r"(?<!\d)(1m|5m|15m|30m|1h|4h|1d)(?!\d)"
    found = F.regexp_extract_all(F.lower(path), F.lit(pattern), F.lit(1))
    return F.filter(F.array(*[F.lit(tf) for tf in TIMEFRAMES]), lambda tf: F.array_contains(found, tf))


def path_years(path: Column, this_year: int | None = None) -> Column:
    """Free-standing years of the path, plausible ones only, sorted."""
    years = F.transform(F.regexp_extract_all(path, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    latest = _now(this_year) + 1
    return F.array_sort(F.array_distinct(F.filter(years, lambda y: (y >= EARLIEST_YEAR) & (y <= latest))))


def file_facts(files: DataFrame, this_year: int | None = None) -> DataFrame:
    """Path table plus suffix, pair, timeframes, years and whether the file is structured or raw."""
    path = F.col("path")
    return files.withColumns(
        {
            "suffix": suffix(path),
            "pair": path_pair(path),
            "timeframes": path_timeframes(path),
            "years": path_years(path, this_year),
        }
    ).withColumns(
        {
            "structured": F.col("suffix").isin(STRUCTURED),
            "usable": F.col("suffix").isin(USABLE),
            "raw": F.col("suffix") == RAW_SUFFIX,
        }
    )


def inventory(rows: DataFrame, root: str | None = None, folders: bool = False) -> DataFrame:
    """Per file: rows, timestamp column and its range, from the data itself.

    ``rows`` is a file-based DataFrame (Parquet with merged schema, or CSV).
    With ``folders`` a folder right below ``root`` counts as one file, whatever number of parts it holds.
    The timestamp column is the first candidate that has values in the file.
    Unparsable times are ignored.
    """
    present = [c for c in TIMESTAMP_CANDIDATES if c in rows.columns]
    types = dict(rows.dtypes)
    parsed = {c: F.try_to_timestamp(F.col(c)) if types[c] == "string" else F.col(c).cast("timestamp") for c in present}
    per_file = rows.groupBy(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size_bytes")
    ).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count(c).alias(f"n_{c}") for c in present],
        *[F.min(parsed[c]).alias(f"min_{c}") for c in present],
        *[F.max(parsed[c]).alias(f"max_{c}") for c in present],
    )
    if root:
        per_file = per_file.withColumn("path", F.substring_index("path", root.rstrip("/") + "/", -1))
    if folders:
        per_file = per_file.groupBy(F.substring_index("path", "/", 1).alias("path")).agg(
            *[F.sum(c).alias(c) for c in ("size_bytes", "row_count", *[f"n_{c}" for c in present])],
            *[F.min(f"min_{c}").alias(f"min_{c}") for c in present],
            *[F.max(f"max_{c}").alias(f"max_{c}") for c in present],
        )
    first = lambda make: F.coalesce(*[F.when(F.col(f"n_{c}") > 0, make(c)) for c in present]) if present else F.lit(None)
    return per_file.select(
        "path",
        "size_bytes",
        "row_count",
        first(F.lit).cast("string").alias("timestamp_column"),
        first(lambda c: F.col(f"min_{c}")).cast("timestamp").alias("min_timestamp"),
        first(lambda c: F.col(f"max_{c}")).cast("timestamp").alias("max_timestamp"),
        F.array(*[F.lit(c) for c in rows.columns]).alias("columns"),
    )


def inspect_parquet(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").option("pathGlobFilter", "*.parquet").parquet(root)
    return inventory(rows, root)


def inspect_csv(spark: SparkSession, root: str) -> DataFrame:
    """CSV files below ``root`` that share one header; another header is an error, not a misread column."""
    rows = spark.read.option("recursiveFileLookup", "true").option("header", "true").option("enforceSchema", "false").option("pathGlobFilter", "*.csv").csv(root)
    return inventory(rows, root)


def raw_roots(facts: DataFrame) -> DataFrame:
    """Raw files per root (first three path parts): count, years, first and last path."""
    parts = F.split("path", "/")
    root = F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 3), "/")).otherwise(F.col("path"))
    # Years are few; one row per (root, year) before they are collected.
    raw = facts.where("raw").withColumn("root", root)
    per_year = raw.select("root", "path", F.explode_outer("years").alias("year")).groupBy("root", "year").agg(
        F.min("path").alias("first_path"), F.max("path").alias("last_path")
    )
    counted = raw.groupBy("root").agg(F.count(F.lit(1)).alias("file_count"))
    return (
        per_year.groupBy("root")
        .agg(
            F.array_sort(F.collect_set("year")).alias("years"),
            F.min("first_path").alias("first_path"),
            F.max("last_path").alias("last_path"),
        )
        .join(counted, "root")
        .withColumn("pair", path_pair(F.col("root")))
    )


def buildable(direct: Column, has_ticks: Column) -> Column:
    """All timeframes with ticks, else those no finer than the finest direct one."""
    every = F.array(*[F.lit(tf) for tf in TIMEFRAMES])
    ranks = F.transform(direct, rank_of)
    coarser = F.filter(every, lambda tf: rank_of(tf) >= F.array_min(ranks))
    return F.when(has_ticks, every).when(F.size(direct) > 0, coarser).otherwise(F.array().cast("array<string>"))


def _years(first: int, last: int) -> Column:
    return F.array(*[F.lit(y) for y in range(first, last + 1)]).cast("array<int>")


def pair_summary(
    facts: DataFrame, *, pairs: list[str] = TARGET_PAIRS, this_year: int | None = None, inspected: DataFrame | None = None
) -> DataFrame:
    """One row per known or seen pair: files, timeframes, years, coverage, gaps.

    ``inspected`` (``inventory`` rows) adds coverage and the years between first
    and last timestamp.
    """
    now = _now(this_year)
    rows = facts
    if inspected is not None:
        spans = inspected.select("path", "min_timestamp", "max_timestamp")
        rows = rows.join(spans, "path", "left").withColumn(
            "years",
            F.when(
                F.col("min_timestamp").isNotNull(),
                F.array_sort(F.array_union("years", F.sequence(F.year("min_timestamp"), F.year("max_timestamp")))),
            ).otherwise(F.col("years")),
        )
    else:
        rows = rows.withColumns({"min_timestamp": F.lit(None).cast("timestamp"), "max_timestamp": F.lit(None).cast("timestamp")})
    seen = rows.where(F.col("pair").isNotNull() & (F.col("structured") | F.col("raw")))
    # Collapse files to distinct (pair, year) and (pair, timeframe) before collecting sets.
    years = (
        seen.select("pair", F.explode("years").alias("year")).distinct().groupBy("pair").agg(F.collect_list("year").alias("years"))
    )
    direct = (
        seen.where("usable")
        .select("pair", F.explode("timeframes").alias("timeframe"))
        .distinct()
        .groupBy("pair")
        .agg(F.collect_list("timeframe").alias("direct"))
    )
    parts = F.split("path", "/")
    root = F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 3), "/")).otherwise(F.col("path"))
    raw = (
        facts.where("raw").select(root.alias("root")).distinct()
        .groupBy(path_pair(F.col("root")).alias("pair")).agg(F.count(F.lit(1)).alias("raw_roots"))
    )
    counts = seen.groupBy("pair").agg(
        F.count_if("structured").alias("structured_files"),
        F.count_if("usable").alias("usable_files"),
        F.coalesce(F.bool_or(F.col("usable") & F.col("path").startswith("cleaned_ticks/")), F.lit(False)).alias("has_ticks"),
        F.min(F.when(F.col("usable"), F.col("min_timestamp"))).alias("min_timestamp"),
        F.max(F.when(F.col("usable"), F.col("max_timestamp"))).alias("max_timestamp"),
    )
    known = facts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in pairs])).alias("pair"))
    base = known.union(seen.select("pair")).distinct()
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    ordered = F.filter(F.array(*[F.lit(tf) for tf in TIMEFRAMES]), lambda tf: F.array_contains(F.coalesce("direct", empty("string")), tf))
    joined = (
        base.join(counts, "pair", "left").join(years, "pair", "left").join(direct, "pair", "left").join(raw, "pair", "left")
        .withColumns(
            {
                "structured_files": F.coalesce("structured_files", F.lit(0)),
                "usable_files": F.coalesce("usable_files", F.lit(0)),
                "raw_roots": F.coalesce("raw_roots", F.lit(0)),
                "has_ticks": F.coalesce("has_ticks", F.lit(False)),
                "direct_timeframes": ordered,
                "observed_years": F.array_sort(F.coalesce("years", empty("int"))),
            }
        )
        .withColumn("buildable_timeframes", buildable(F.col("direct_timeframes"), F.col("has_ticks")))
    )
    every = F.array(*[F.lit(tf) for tf in TIMEFRAMES])
    return joined.select(
        "pair",
        "structured_files",
        "usable_files",
        "raw_roots",
        "direct_timeframes",
        "buildable_timeframes",
        F.array_except(every, "buildable_timeframes").alias("missing_timeframes"),
        "observed_years",
        F.array_except(_years(*CLOSED_WINDOW), "observed_years").alias("gaps_2018_2024"),
        F.array_except(_years(OPEN_WINDOW_START, now), "observed_years").alias("gaps_2025_now"),
        "has_ticks",
        ((F.col("raw_roots") > 0) & (F.col("usable_files") == 0)).alias("raw_only"),
        F.col("pair").isin(pairs).alias("target"),
        "min_timestamp",
        "max_timestamp",
    )


def pair_findings(summary: DataFrame) -> DataFrame:
    """(finding, pair): missing, raw-only and incomplete pairs."""
    missing = F.col("target") & (F.col("usable_files") == 0) & (F.col("raw_roots") == 0)
    incomplete = F.col("target") & (F.size("missing_timeframes") > 0)
    found = F.array(
        F.struct(F.lit("missing").alias("finding"), missing.alias("shown")),
        F.struct(F.lit("raw_only").alias("finding"), F.col("raw_only").alias("shown")),
        F.struct(F.lit("incomplete").alias("finding"), incomplete.alias("shown")),
    )
    return summary.select("pair", F.inline(found)).where("shown").select("finding", "pair")


def quality_flags(facts: DataFrame, summary: DataFrame) -> DataFrame:
    """(flag, raised) for overlapping, duplicate or missing sources."""
    structured = facts.where("structured")
    tree = structured.agg(
        F.coalesce(F.bool_or(F.contains("path", F.lit("recent"))), F.lit(False)).alias("recent_overlap"),
        F.coalesce(F.bool_or(F.col("path").endswith("_raw.parquet")), F.lit(False)).alias("raw_variants"),
        F.coalesce(F.bool_or(F.col("path") == "bars/15m/eurusd_bars_latest.parquet"), F.lit(False)).alias("latest_snapshot"),
    )
    pairs = summary.agg(
        F.coalesce(F.bool_or((F.col("pair") == "AUDUSD") & (F.col("usable_files") == 0) & (F.col("raw_roots") > 0)), F.lit(False)).alias("audusd_raw_only"),
        F.coalesce(F.bool_or((F.col("pair") == "USDCAD") & (F.col("usable_files") == 0) & (F.col("raw_roots") == 0)), F.lit(False)).alias("usdcad_absent"),
    )
    listed = lambda names: F.expr(f"stack({len(names)}, {', '.join(repr(n) + ', ' + n for n in names)}) AS (flag, raised)")
    return tree.select(listed(["recent_overlap", "raw_variants", "latest_snapshot"])).union(
        pairs.select(listed(["audusd_raw_only", "usdcad_absent"]))
    )


def other_suffixes(facts: DataFrame) -> DataFrame:
    """Files that are neither structured nor raw, per suffix."""
    return (
        facts.where(~F.col("structured") & ~F.col("raw"))
        .groupBy(F.when(F.col("suffix") == "", "[no_suffix]").otherwise(F.col("suffix")).alias("suffix"))
        .agg(F.count(F.lit(1)).alias("files"))
    )

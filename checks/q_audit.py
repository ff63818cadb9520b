"""Audit of the derived file tree and of the given files."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.operators.audit import (
    file_facts,
    inventory,
    other_suffixes,
    pair_findings,
    pair_summary,
    quality_flags,
    raw_roots,
)
from barlab.schemas import TARGET_PAIRS, TIMEFRAMES
from checks import duck_sql as D
from checks.feeds import PATHS, THIS_YEAR, paths
from checks.registry import query

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(
    "j1_file_inventory",
    " UNION ALL ".join(
        f"SELECT '{t}.parquet' AS file, count(*) AS row_count, " + (
            f"'ts' AS timestamp_column, {D.stamp('min(ts)')} AS min_timestamp, {D.stamp('max(ts)')} AS max_timestamp" if t == "events"
            else "NULL AS timestamp_column, NULL AS min_timestamp, NULL AS max_timestamp"
        ) + f" FROM {t}"
        for t in TABLES
    ),
)
def j1(spark, sf):
    """Rows and time range of every given file or folder of parts, read with one merged schema; one without rows counts 0."""
    rows = spark.read.option("mergeSchema", "true").parquet(*[f"{sf}/{t}.parquet" for t in TABLES])
    found = inventory(rows, sf, folders=True).withColumnRenamed("path", "file")
    given = spark.range(1).select(F.explode(F.array(*[F.lit(f"{t}.parquet") for t in TABLES])).alias("file"))
    return given.join(found, "file", "left").select(
        "file", F.coalesce("row_count", F.lit(0)).alias("row_count"), "timestamp_column", "min_timestamp", "max_timestamp"
    )


_NAME = r"regexp_extract(path, '([^/]*)$', 1)"
_SUFFIX = f"lower(regexp_extract({_NAME}, '[^.](\\.[^.]+)$', 1))"
_PAIR = "CASE " + " ".join(f"WHEN contains(upper(path), '{p}') THEN '{p}'" for p in TARGET_PAIRS) + r" ELSE nullif(regexp_extract(replace(replace(upper(path), '-', '_'), '/', '_'), '\b([A-Z]{6})\b', 1), '') END"
_TFS = "list_filter([{}], lambda t: regexp_matches(' ' || lower(path) || ' ', '[^0-9]' || t || '[^0-9]'))".format(", ".join(f"'{tf}'" for tf in TIMEFRAMES))
_YEARS = rf"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(path, '\b20[0-9][0-9]\b'), lambda y: y::INT), lambda y: y >= 2010 AND y <= {THIS_YEAR + 1})))"
FACTS = f"""WITH paths AS ({PATHS}), facts AS (SELECT path, {_SUFFIX} AS suffix, {_PAIR} AS pair, {_TFS} AS tfs, {_YEARS} AS years FROM paths),
marked AS (SELECT *, suffix IN ('.parquet', '.csv', '.json', '.jsonl') AS structured, suffix IN ('.parquet', '.csv') AS usable, suffix = '.bi5' AS raw FROM facts) """


def _facts(spark, sf):
    return file_facts(paths(spark, sf), THIS_YEAR)


def _joined(values: str) -> str:
    return f"coalesce(array_to_string({values}, ','), '')"


@query("j2_path_facts", FACTS + f"SELECT path, suffix, pair, {_joined('tfs')} AS timeframes, {_joined('years')} AS years, structured, usable, raw FROM marked")
def j2(spark, sf):
    return _facts(spark, sf).select("path", "suffix", "pair", "timeframes", "years", "structured", "usable", "raw")


_ROOT = "regexp_extract(path, '^([^/]*/[^/]*/[^/]*)', 1)"
_ROOT_PAIR = _PAIR.replace("path", "root")


@query(
    "j3_raw_roots",
    FACTS + f""", raw AS (SELECT *, {_ROOT} AS root FROM marked WHERE raw)
    SELECT root, {_ROOT_PAIR} AS pair, count(*) AS file_count, min(path) AS first_path, max(path) AS last_path,
    {_joined("list_sort(list_distinct(flatten(list(years))))")} AS years FROM raw GROUP BY root""",
)
def j3(spark, sf):
    return raw_roots(_facts(spark, sf)).select("root", "pair", "file_count", "first_path", "last_path", "years")


_EVERY = "[" + ", ".join(f"'{tf}'" for tf in TIMEFRAMES) + "]"
SUMMARY = FACTS + f""", seen AS (SELECT * FROM marked WHERE pair IS NOT NULL AND (structured OR raw)),
names AS (SELECT unnest([{', '.join(f"'{p}'" for p in TARGET_PAIRS)}]) AS pair UNION SELECT pair FROM seen),
agg AS (SELECT pair, count(*) FILTER (structured) AS structured_files, count(*) FILTER (usable) AS usable_files, count(DISTINCT CASE WHEN raw THEN {_ROOT} END) AS raw_roots,
  coalesce(bool_or(usable AND starts_with(path, 'cleaned_ticks/')), false) AS has_ticks, list_distinct(flatten(list(years))) AS years,
  list_distinct(flatten(list(CASE WHEN usable THEN tfs ELSE [] END))) AS direct FROM seen GROUP BY pair),
full_rows AS (SELECT pair, coalesce(structured_files, 0) AS structured_files, coalesce(usable_files, 0) AS usable_files, coalesce(raw_roots, 0) AS raw_roots,
  coalesce(has_ticks, false) AS has_ticks, coalesce(years, []) AS years, list_filter({_EVERY}, lambda t: list_contains(coalesce(direct, []), t)) AS direct FROM names LEFT JOIN agg USING (pair)),
built AS (SELECT *, CASE WHEN has_ticks THEN {_EVERY} WHEN len(direct) > 0 THEN list_filter({_EVERY}, lambda t: list_position({_EVERY}, t) >= list_position({_EVERY}, direct[1])) ELSE []::VARCHAR[] END AS buildable FROM full_rows),
summary AS (SELECT *, list_filter({_EVERY}, lambda t: NOT list_contains(buildable, t)) AS missing FROM built) """


def _summary(spark, sf):
    return pair_summary(_facts(spark, sf), this_year=THIS_YEAR)


@query(
    "j4_pair_summary",
    SUMMARY + f"""SELECT pair, structured_files, usable_files, raw_roots, has_ticks, {_joined('direct')} AS direct_timeframes, {_joined('list_sort(years)')} AS observed_years,
    raw_roots > 0 AND usable_files = 0 AS raw_only FROM summary""",
)
def j4(spark, sf):
    return _summary(spark, sf).select(
        "pair", "structured_files", "usable_files", "raw_roots", "has_ticks", "direct_timeframes", "observed_years", "raw_only"
    )


@query("j5_buildable_timeframes", SUMMARY + f"SELECT pair, {_joined('buildable')} AS buildable_timeframes, {_joined('missing')} AS missing_timeframes FROM summary")
def j5(spark, sf):
    return _summary(spark, sf).select("pair", "buildable_timeframes", "missing_timeframes")


@query(
    "j6_coverage_gaps",
    SUMMARY + f"SELECT pair, {_joined('list_filter(range(2018, 2025), lambda y: NOT list_contains(years, y))')} AS gaps_2018_2024, {_joined(f'list_filter(range(2025, {THIS_YEAR + 1}), lambda y: NOT list_contains(years, y))')} AS gaps_2025_now FROM summary",
)
def j6(spark, sf):
    return _summary(spark, sf).select("pair", "gaps_2018_2024", "gaps_2025_now")


_TARGET = f"pair IN {tuple(TARGET_PAIRS)}"


@query(
    "j7_pair_findings",
    SUMMARY + f"""SELECT 'missing' AS finding, pair FROM summary WHERE {_TARGET} AND usable_files = 0 AND raw_roots = 0
    UNION ALL SELECT 'raw_only', pair FROM summary WHERE raw_roots > 0 AND usable_files = 0
    UNION ALL SELECT 'incomplete', pair FROM summary WHERE {_TARGET} AND len(missing) > 0""",
)
def j7(spark, sf):
    return pair_findings(_summary(spark, sf))


@query(
    "j8_quality_flags",
    SUMMARY + """SELECT 'recent_overlap' AS flag, bool_or(contains(path, 'recent')) AS raised FROM marked WHERE structured
    UNION ALL SELECT 'raw_variants', bool_or(suffix(path, '_raw.parquet')) FROM marked WHERE structured
    UNION ALL SELECT 'latest_snapshot', bool_or(path = 'bars/15m/eurusd_bars_latest.parquet') FROM marked WHERE structured
    UNION ALL SELECT 'audusd_raw_only', coalesce(bool_or(pair = 'AUDUSD' AND usable_files = 0 AND raw_roots > 0), false) FROM summary
    UNION ALL SELECT 'usdcad_absent', coalesce(bool_or(pair = 'USDCAD' AND usable_files = 0 AND raw_roots = 0), false) FROM summary""",
)
def j8(spark, sf):
    facts = _facts(spark, sf)
    return quality_flags(facts, _summary(spark, sf))


@query("j8_other_suffixes", FACTS + "SELECT CASE WHEN suffix = '' THEN '[no_suffix]' ELSE suffix END AS suffix, count(*) AS files FROM marked WHERE NOT structured AND NOT raw GROUP BY 1")
def j8_other(spark, sf):
    return other_suffixes(_facts(spark, sf))

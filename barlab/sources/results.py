"""Run outputs, experiment rows and failure logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

FAILURE_SCHEMA = "config_hash STRING, config STRING, error STRING, timestamp STRING"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All parts of a result dataset; columns missing from a part are NULL."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def union_results(parts: list[DataFrame]) -> DataFrame:
    """Result tables with drifting columns as one."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def append_results(rows: DataFrame, path: str, columns: list[str], types: dict[str, str] | None = None) -> None:
    """Append rows in the fixed column order; absent columns become NULL of their type in ``types``.

    A type must be named for each absent column, so that parts with and without it can be read together.
    """
    present, types = set(rows.columns), types or {}
    if untyped := [c for c in columns if c not in present and c not in types]:
        raise ValueError(f"no type for absent columns: {', '.join(untyped)}")
    picked = [F.col(c).cast(types[c]) if c in present and c in types else F.col(c) if c in present else F.lit(None).cast(types[c]) for c in columns]
    rows.select(*[column.alias(c) for column, c in zip(picked, columns)]).write.mode("append").parquet(path)


def save_book(book, root: str) -> None:
    """Config, metrics, trades and equity of all runs, partitioned like run folders, keyed by ``run_id``.

    Signals other than 0 are shared by runs and stored once per ``signal_key`` and series (and window, in a matrix).
    """
    keys = book.runs.select("run_id", "pair", "timeframe", F.col("strategy_name").alias("strategy"))
    where = ["strategy", "pair", "timeframe"]
    save = lambda table, name: table.write.mode("append").partitionBy(*where).parquet(f"{root}/{name}")
    save(book.runs.withColumn("strategy", F.col("strategy_name")), "config")
    save(book.metrics.join(keys, ["run_id", "pair", "timeframe"]), "metrics")
    save(book.trades.withColumn("strategy", F.col("strategy_name")), "trades")
    save(book.equity.join(keys, ["run_id", "pair", "timeframe"]), "equity")
    book.signals.write.mode("append").partitionBy("pair", "timeframe").parquet(f"{root}/signals")


def _or_empty(read, spark: SparkSession, schema: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def completed_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Hashes with a result row; only that column is read."""

    def read() -> DataFrame:
        table = spark.read.parquet(path)
        if "config_hash" not in table.columns:
            return spark.createDataFrame([], "config_hash STRING")
        return table.select("config_hash").where(F.col("config_hash").isNotNull()).distinct()

    return _or_empty(read, spark, "config_hash STRING")


def append_failures(failures: DataFrame, path: str) -> None:
    """One JSON object per line: config_hash, config, error, timestamp."""
    failures.select("config_hash", "config", "error", "timestamp").write.mode("append").json(path)


def failed_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Hashes in a failure log; blank and unparsable lines and blank hashes are skipped."""

    def read() -> DataFrame:
        log = spark.read.schema(FAILURE_SCHEMA).option("mode", "PERMISSIVE").json(path)
        return log.select("config_hash").where(F.length("config_hash") > 0).distinct()

    return _or_empty(read, spark, "config_hash STRING")


def read_trade_log(spark: SparkSession, path: str) -> DataFrame:
    """A trade log from Parquet or CSV (all text; the cleansing step parses)."""
    if path.rstrip("/").lower().endswith(".parquet"):
        return spark.read.parquet(path)
    if path.rstrip("/").lower().endswith(".csv"):
        return spark.read.option("header", "true").csv(path)
    raise ValueError(f"Unsupported trades file format: {path}")


def save_shortlist(rows: DataFrame, path: str) -> None:
    """CSV only for a ``.csv`` path; else Parquet, with a CSV twin for a ``.parquet`` path."""
    lower = path.lower()
    if lower.endswith(".csv"):
        rows.write.mode("overwrite").option("header", "true").csv(path)
        return
    rows.write.mode("overwrite").parquet(path)
    if lower.endswith(".parquet"):
        rows.write.mode("overwrite").option("header", "true").csv(path[: -len(".parquet")] + ".csv")

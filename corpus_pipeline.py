"""Corpus pipeline: documents to token records in five stages, each stored before the next reads it.

1. toxicity: documents that the classifier chain rejects go.
2. n-gram Jaccard join: one document of each group of linked documents stays, a row of its own if wordless;
   linked are documents with a Jaccard of 0.8 or more over five-word shingles (op10's query takes three words and 0.9).
3. benchmark decontamination: contaminated documents go.
4. mixing sources to target weights: documents are repeated by Poisson counts and shuffled.
5. token-ID / binary output: framed records and their index, in the order of the mixing stage; one row per record.

A stage sees its predecessor's rows only.  Rows are told apart by a hash of id and text, so
null and repeated ids do no harm: repeats of one row share every decision, and stage 2
keeps one of them.  Empty input passes through as empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import decontamination, jaccard_join, mixing, token_records, toxicity
from llm._common import read, store
from llm.registry import ship

#: Near duplicates: words of a shingle, and the Jaccard in percent from which documents are linked.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("row_key", F.xxhash64("doc_id", "text"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.judged(spark, docs.select(*COLUMNS), sf_dir).filter(~F.col("toxic")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = keyed(docs)
    groups = jaccard_join.components(rows.select("row_key", "text"), id_col="row_key", shingle=NEAR_SHINGLE, percent=NEAR_PERCENT)
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("row_key"), (F.col("n_shingles") == 0).alias("wordless")).distinct()
    first = F.row_number().over(Window.partitionBy("row_key").orderBy("lang", "source", "n_chars"))
    return rows.join(kept, "row_key").withColumn("place", first).filter(F.col("wordless") | (F.col("place") == 1)).select(*COLUMNS)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = keyed(docs)
    verdict = decontamination.judged(rows.select(F.col("row_key").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    bad = verdict.filter("contaminated").select(F.col("doc_id").alias("row_key")).distinct()
    return rows.join(bad, "row_key", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_records.run_stage(spark, docs, by_id=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", reject_contaminated),
    ("mixing", mix_sources),
    ("token_records", write_tokens),
]

#: A learned classifier decides in the first stage; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

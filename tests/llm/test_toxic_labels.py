"""Few, one-sided and missing labels: the chain must not call everything toxic."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from llm import toxicity
from llm.registry import ship


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(300)]
    return spark.createDataFrame([(i, " ".join(rng.choices(words, k=60))) for i in range(120)], "doc_id bigint, text string").repartition(3).cache()


def labels(spark, toxic: dict[int, int | None], quality: dict[int, int | None] | None = None):
    rows = [(i, (quality or {}).get(i, i % 2), t) for i, t in toxic.items()]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def toxic_count(docs, marks) -> int:
    return toxicity.score(docs, toxicity.fit_chain(docs, marks, toxicity.label_categories())).filter("toxic").count()


@pytest.mark.parametrize("value", [0, 1, None])
def test_one_class_judges_nobody(spark, docs, value):
    assert toxic_count(docs, labels(spark, {i: value for i in range(60)})) == 0


def test_no_labels(spark, docs):
    assert toxic_count(docs, labels(spark, {0: 0}).filter("doc_id < 0")) == 0


def test_two_positives_do_not_condemn_the_rest(spark, docs):
    assert toxic_count(docs, labels(spark, {i: int(i in (3, 11)) for i in range(26)})) <= 6


def test_small_corpus_keeps_its_clean_rows(spark, docs, tmp_path):
    """The pipeline's first stage where no labelled text is toxic."""
    full = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    full.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, {i: 0 for i in range(60)}).write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.reject_toxic(spark, full, str(tmp_path)).count() == full.count()


def test_features_of_a_category_do_not_depend_on_the_others(spark, docs):
    """A word in three labelled texts counts, also beside a category without labels."""
    marks = labels(spark, {i: int(i < 6) for i in range(60)}, {i: None for i in range(60)})
    alone = toxicity.fit_chain(docs, marks, {"toxic": F.col("toxic")})
    beside = toxicity.fit_chain(docs, marks, toxicity.label_categories())
    assert np.array_equal(alone.chosen, beside.chosen) and len(alone.chosen)


def test_threshold():
    p, y = np.linspace(1, 0, 100), np.zeros(100)
    assert toxicity.best_threshold(p, y) == 0.5
    y[[50, 70]] = 1
    assert toxicity.best_threshold(p, y) == 0.5
    y[:20] = 1
    assert p[19] >= toxicity.best_threshold(p, y) > p[20]

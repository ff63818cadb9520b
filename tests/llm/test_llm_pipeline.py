"""The pipeline: every stage decides as its operator says, on what its predecessor kept."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from llm import decontamination, jaccard_join, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", "src0", 0), (9001, "", "en", None, 0), (9001, "", "en", None, 0), (9002, "same words here twice", "en", "src0", 21), (9002, "same words here twice", "en", "src0", 21)], docs.schema)
    out = [docs.unionByName(odd).cache()]
    for _, stage in pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def test_filters(spark, sf, stages):
    docs, clean, single, fresh, *_ = stages
    toxic = toxicity.judged(spark, docs, sf).filter("toxic").count()
    assert toxic and clean.count() == docs.count() - toxic
    linked = jaccard_join.components(pipeline.keyed(clean), id_col="row_key", shingle=pipeline.NEAR_SHINGLE, percent=pipeline.NEAR_PERCENT)
    groups = linked.filter("n_shingles > 0").agg(F.countDistinct("component_id")).first()[0]
    wordless = linked.filter("n_shingles = 0").count()
    assert single.count() == groups + wordless and single.filter("doc_id = 9002").count() == 1
    bad = decontamination.judged(single, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("contaminated").count()
    assert bad and fresh.count() == single.count() - bad


def test_columns_and_records(spark, stages):
    assert all(stage.columns == pipeline.COLUMNS for stage in stages[1:-1])
    mixed, records = stages[-2], stages[-1]
    assert records.count() == mixed.count() and {r.doc_id for r in mixed.select("doc_id").collect()} <= {r.doc_id for r in stages[3].select("doc_id").collect()}
    rows = records.orderBy("start").collect()
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_copies_do_not_stand_side_by_side(spark, stages, tmp_path):
    """Records follow the mixing stage's order, as it is stored."""
    stages[-2].write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    rows = pipeline.write_tokens(spark, mixed, "").orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    beside = sum(a == b for a, b in zip(ids, ids[1:], strict=False))
    by_chance = sum(n * (n - 1) for n in Counter(ids).values()) / len(ids)  # one source of few short texts is repeated often
    assert len(ids) == mixed.count() and beside < 1.3 * by_chance + 10 < len(ids) - len(set(ids))
    assert ids != sorted(ids, key=lambda i: (i is None, i))


def test_registered(spark, sf):
    names = {name.split("_")[0] for name in entry.queries() if name.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()
    assert entry.queries()["pipeline"](spark, sf).count() > 0

"""Benchmark items without an id still mark the documents that hold their text."""

from __future__ import annotations

from llm import decontamination
from llm.registry import ship


def test_null_id_items_count(spark):
    ship(spark)
    one, two = " ".join(f"a{i}" for i in range(15)), " ".join(f"b{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"{two} z"), (3, f"{one} {two}"), (4, "nothing of it")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, one), (7, two), (None, None)], "item_id bigint, text string")
    got = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in decontamination.judged(docs, bench).collect()}
    assert got == {1: (15, [], True), 2: (15, [7], True), 3: (30, [7], True), 4: (0, [], False)}

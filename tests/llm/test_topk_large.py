"""Top-k search on components that 32-bit floats, or doubles in sums, would round."""

from __future__ import annotations

import math
import random

import pytest

from llm import topk_search
from llm.registry import ship


@pytest.mark.parametrize("size", [16384.5009765625, 2.0**19, 2.0**18])
def test_large_components(spark, size):
    ship(spark)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-size, size) for _ in range(6)]) for i in range(300)] + [(300, [size] + [0.0] * 5), (301, [size] + [0.0] * 5)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = [tuple(r) for r in topk_search.top_k(frame, frame.filter("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = []
    for q in range(0, 302, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)[:5]
        want += [(q, place + 1, i, -s) for place, (s, i) in enumerate(best)]
    assert got == want


def test_scores_beyond_64_bits_are_an_error(spark):
    ship(spark)
    frame = spark.createDataFrame([(0, [2.0**30]), (1, [2.0**30])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk_search.top_k(frame, frame, 1).collect()

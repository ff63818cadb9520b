"""Top-k search where a block holds one or two candidates."""

from __future__ import annotations

import numpy as np
import pytest

from llm import topk_search
from llm.registry import ship


@pytest.mark.parametrize("n", [1, 2, 3, topk_search.BLOCK_ROWS + 1])
def test_tables_whose_last_block_is_small(spark, n):
    ship(spark)
    x = np.random.default_rng(n).normal(size=(n, 4)).astype(np.float32)
    x[-1] = 9.0  # the row of the last block is among the best
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>").coalesce(1)
    whole = np.floor(x.astype(np.float64) * 1024)
    got = {}
    for r in topk_search.top_k(frame, frame.filter("vec_id % 1000 = 0"), 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {}
    for q in range(0, n, 1000):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(n) if i != q)[:3]
        if best:
            want[q] = [(i, -s) for s, i in best]
    assert got == want

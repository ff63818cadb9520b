"""Dedup with anchors that are split over buckets: the same results as without, and no bucket that holds an anchor whole."""

from __future__ import annotations

import random

import numpy as np
import pytest

from llm import _anchors, lz_dedup, suffix_dedup
from llm.registry import ship

N = 300


@pytest.fixture(scope="module")
def docs(spark):
    """A passage between different neighbours in every document, also cut short, repeated and at either end."""
    ship(spark)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, few = prose(45), [prose(20) for _ in range(3)]
    texts = [f"{rng.choice([*few, prose(25)])} {passage} {rng.choice([*few, prose(25)])}" for _ in range(N)]
    texts += [passage, passage, f"{passage} {passage}", f"{prose(3)} {passage}", f"{passage} {prose(3)}", passage[10:], None, "", texts[3], texts[3]]
    rows = [(i * 37 % 1009 if i % 50 else None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).cache()


def rows(frame):
    return sorted(map(repr, frame.collect()))


@pytest.mark.parametrize("operator", [suffix_dedup, lz_dedup])
def test_split_anchors_give_the_same(docs, operator):
    whole = rows(operator.dedup(docs, hot=1 << 60))
    assert any("n_removed=0" not in r for r in whole)
    for hot in (0, 40):
        assert rows(operator.dedup(docs, hot=hot)) == whole


@pytest.mark.parametrize("job", [suffix_dedup.SuffixJob, lz_dedup.ParseJob])
def test_no_bucket_judges_a_hot_anchor(docs, job, monkeypatch):
    """Rows of one anchor that a bucket judges together stay within the bound."""
    def judge(self, keys, columns, blocks, was=job.judge):
        most = int(np.unique(keys, return_counts=True)[1].max())
        assert most <= 40, most
        return was(self, keys, columns, blocks)

    kind = type("Checked", (job,), {"judge": judge})
    assert _anchors.run(docs, kind, "doc_id", "text", 1 << 22, 40).count() == docs.count()
    with pytest.raises(Exception, match="AssertionError"):
        _anchors.run(docs, kind, "doc_id", "text", 1 << 22, 1 << 60).count()

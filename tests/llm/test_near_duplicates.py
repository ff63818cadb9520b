"""The near-duplicate stage against brute force, on texts that op10's own query does not link."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as pipeline
from llm import jaccard_join
from llm.registry import ship


def near_texts() -> list[str]:
    rng = random.Random(11)
    texts = []
    for size, edits in ((500, (9, 11)), (1000, (18, 22)), (40, (0, 1, 2)), (6, (0, 1)), (500, (12, 30))):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        texts.append(" ".join(base))
        for many in edits:
            copy = list(base)
            for place in range(many):
                copy[(place + 1) * size // (many + 1)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(base[: size - size // 9]))
    return [*texts, "only four words here", "only four words here", "only four words"]


def brute_force(texts: list[str], shingle: int, percent: int) -> list[int]:
    """Smallest row each row is connected with."""
    sets = []
    for text in texts:
        w = text.split()
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set()))
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


@pytest.mark.parametrize("chunk", [1, 256])
def test_stage_links_near_copies_in_the_gap(spark, chunk, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    ship(spark)
    texts = near_texts()
    five, three = brute_force(texts, 5, 80), brute_force(texts, 3, 90)
    assert len(set(five)) < len(set(three))  # some are linked by the stage's rule only
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert [r.component_id for r in jaccard_join.components(frame, shingle=5, percent=80).orderBy("doc_id").collect()] == five
    assert [r.component_id for r in jaccard_join.components(frame).orderBy("doc_id").collect()] == three
    rows = spark.createDataFrame([(i, text, "en", "s", len(text)) for i, text in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [r.doc_id for r in pipeline.one_of_each_group(spark, rows, "").collect()]
    assert sorted(five[i] for i in kept) == sorted(set(five))

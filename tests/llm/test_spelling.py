"""Spelling variants against all pairs of a small vocabulary."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from llm import spelling_variants
from llm.registry import ship


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p:] == b[p + 1 :] if len(a) < len(b) else a[p + 1 :] == b[p + 1 :]


def brute_force(vocabulary: dict[str, int]) -> set[tuple]:
    near = {w: [x for x in vocabulary if one_edit(w, x)] for w in vocabulary}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 2 * vocabulary[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), vocabulary[form[w]] if form[w] is not None else None) for w, n in vocabulary.items()}


def vocabulary() -> dict[str, int]:
    rng = random.Random(11)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 7))) for _ in range(500)}
    words |= {"a" * 60, "a" * 61, "a" * 62, "b" + "a" * 61, "x" * 30_000, "x" * 29_999 + "y", "x" * 29_999, "a", "b", "日本語", "日本"}
    return {w: rng.choice([1, 2, 2, 4, 8, 16, 300]) for w in sorted(words)}


@pytest.mark.parametrize("tile_rows", [3, 64, 2048])
def test_all_pairs(spark, tile_rows):
    ship(spark)
    words = vocabulary()
    rows = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n bigint, form int").repartition(4)
    got = {tuple(r) for r in spelling_variants.variants(rows, tile_rows=tile_rows).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute_force(words)


def test_query_on_texts(spark, monkeypatch):
    ship(spark)
    rng = random.Random(2)
    base = ["".join(rng.choices("abcdeéÀÿ", k=rng.randint(5, 9))) for _ in range(40)]
    texts: list[str | None] = [None, "", " ,.", "ABCDEF ÀbÇdÉ", "×÷ aaaaa×aaaaa÷aaaaa", "q" * 50_000, "q" * 50_000, "q" * 50_000]
    for _ in range(400):
        words = [rng.choice(base) for _ in range(rng.randint(1, 40))]
        words[0] = words[0][:2] + rng.choice("abcé") + words[0][3:]
        texts.append(rng.choice([" ", ", "]).join(words).replace("a", rng.choice("aA")))
    texts += texts[20:40]
    ids = [None if i == 9 else (i * 17) % 1013 for i in range(len(texts))]
    docs = spark.createDataFrame([(k, t, "w", 5) for k, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, word string, n int").repartition(5)
    counts: Counter = Counter()
    for key, text in zip(ids, texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    monkeypatch.setattr(spelling_variants, "read", lambda *_: docs)
    got = {tuple(r) for r in spelling_variants.op12_spelling_variants(spark, "").select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute_force({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    monkeypatch.setattr(spelling_variants, "read", lambda *_: docs.filter("doc_id < 0"))
    assert spelling_variants.op12_spelling_variants(spark, "").count() == 0

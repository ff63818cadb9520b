"""Phrase mining against counting everything, with a proposal that misses much and with its SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from llm import collocations
from llm.registry import ship

DOCS = "doc_id bigint, text string, lang string, rank string, score string"


def texts() -> list[tuple[str | None, str | None]]:
    rng = random.Random(8)
    words = ["the", "of", "New", "York", "city", "a", "b", "c", "été", "x" * 300, "\x00", "don't", " "]
    out: list[tuple[str | None, str | None]] = [(None, "en"), ("", None), (" \t. ", "en"), ("New York city, new york", None), ("x" * 70_000, "en")]
    for _ in range(300):
        parts = rng.choices(words, weights=[30, 20, 9, 9, 9, 8, 4, 3, 2, 1, 1, 1, 1], k=rng.randint(1, 40))
        glue = [rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]) for _ in parts]
        out.append(("".join(a + b for p in zip(parts, glue, strict=True) for a, b in [p]), rng.choice(["en", "en", "en", "", None, "dé"])))
    return out + out[10:40]


def brute_force(rows, least: int, top: int) -> list[tuple]:
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            total[lang if lang is not None else "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang if lang is not None else "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        best = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            inside = [b for other, b in f.items() if b >= least and len(phrase) < len(other) and any(other[i : i + len(phrase)] == phrase for i in range(len(other)))]
            if any(100 * b >= 80 * a for b in inside):
                continue
            score, k = min((2_000_000 * a // (f[phrase[:k]] + f[phrase[k:]]), k) for k in range(1, len(phrase)))
            best.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame([(i if i % 50 else None, t, lang, "r", "s") for i, (t, lang) in enumerate(texts())], DOCS).repartition(5)


@pytest.mark.parametrize("how", [{"sample": 1, "lowered": 3}, {"sample": 40, "lowered": 2}, {"sample": 10**9, "lowered": 1}, {"filter_bits": 1 << 7}])
def test_counts(docs, how):
    got = collocations.collocations(docs, top=25, least=3, **how).collect()
    assert sorted(map(tuple, got)) == brute_force(texts(), 3, 25)


def test_expansion_goes_on_until_closed(docs):
    """A proposal of nothing costs a pass for every phrase length; one of everything a single pass."""
    nothing, many = collocations.frequent(docs, least=3, sample=10**9)
    every, one = collocations.frequent(docs, least=3, sample=1, lowered=1)
    assert (many, one) == (4, 1)
    assert nothing.exceptAll(every).isEmpty() and every.exceptAll(nothing).isEmpty()


def test_counts_beyond_64_bits(spark):
    big = 9 * 10**18
    rows = [("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 1)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, f bigint")).collect()
    assert [(r.phrase, r.score) for r in got] == [("a b", 2_000_000 * (big - 1) // (2 * big))]


def test_empty(docs):
    assert collocations.collocations(docs.filter("doc_id < 0")).count() == 0


def test_against_sql(spark, sf):
    ship(spark)
    got = sorted(map(tuple, collocations.op13_collocations(spark, sf).collect()))
    want = duckdb.connect()
    want.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got and got == sorted(want.execute(collocations.SQL).fetchall())

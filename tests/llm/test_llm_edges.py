"""Every dealt operator on null, empty, very long, tied and repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import decontamination, html_text, jaccard_join, lm_scoring, lz_dedup, mixing, suffix_dedup, token_records, topk_search, toxicity
from llm.registry import ship

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, toxic string, score string, component int"


def sample_texts() -> list[str | None]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeghilmnorstu", k=rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, line = prose(60), prose(12)
    texts: list[str | None] = [None, "", " \t\n", "x", "Two words", "\x00\x1c nul", "ÀÉ é ß 日本語 текст", "aaa " * 500, "z" * 5000]
    base = [prose(rng.randint(3, 200)) for _ in range(40)]
    texts += base + base[:8] + base[:3]
    for text in base[10:25]:
        parts = text.split()
        parts[rng.randrange(len(parts))] = "changed"
        texts.append(" ".join(parts))
    texts += [prose(30) + " " + passage + " " + prose(20) for _ in range(6)] + [prose(10) + "\n" + line + "\n" + prose(9) for _ in range(5)]
    texts += [passage + " " + prose(5) + " " + passage, prose(30_000), base[5].upper()]
    return texts


@pytest.fixture(scope="module")
def texts():
    return sample_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Ids in no order, spread over partitions, with columns named like results."""
    ship(spark)
    rows = [((i * 37) % 1009, text, "en", f"s{i % 3}" if i % 7 else None, len(text or ""), "t", "s", 1) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def by_id(texts):
    return dict(sorted(((i * 37) % 1009, text or "") for i, text in enumerate(texts)))


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_suffix_dedup(docs, by_id):
    seen, want = set(), {}
    for key, text in by_id.items():
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            piece = data[i : i + 100]
            if piece in seen:
                gone[i : i + 100] = True
            seen.add(piece)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(data) else 0
        want[key] = (len(data), int(gone.sum()), spans, sha(np.frombuffer(data, np.uint8)[~gone].tobytes()))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 1000


def test_lz_dedup(docs, by_id):
    split = {key: words(text) for key, text in by_id.items()}
    windows = Counter(tuple(w[i : i + 35]) for w in split.values() for i in range(len(w) - 34))
    want = {}
    for key, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if windows[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want[key] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in lz_dedup.dedup(docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 500


@pytest.mark.parametrize("chunk", [1, 256])
def test_jaccard_join(docs, by_id, chunk, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    sets = {}
    for key, text in by_id.items():
        w = words(lower(text))
        sets[key] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())
    parent = {key: key for key in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 90 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(docs).collect()}
    assert got == {key: (len(sets[key]), find(key)) for key in sets}


def test_group_of_near_copies_over_many_chunks(spark, monkeypatch):
    """A chain whose ends are not linked directly, all under few hubs."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 1)
    rng = random.Random(2)
    text = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(text)))
        text[rng.randrange(120)] = f"n{i}"
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r.component_id for r in jaccard_join.components(frame).collect()} == {0}


def test_decontamination(spark, docs, by_id, texts):
    items = [(1, " ".join(texts[20].split()[2:30])), (2, "two WORDS"), (3, None), (4, ""), (1, "x"), (5, "never seen here at all"), (10, " ".join((texts[-3] or "").split()[:40]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = pattern.findall(lower(text or ""))
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    want = {}
    for key, text in by_id.items():
        w = pattern.findall(lower(text))
        hit, found = set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= owners
        want[key] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontamination.judged(docs, bench).collect()}
    assert got == want and any(w[3] for w in want.values())
    near = decontamination.contamination(spark.createDataFrame([(1, "a b x c d"), (2, "a b c d"), (3, "a d")], "doc_id bigint, text string"), spark.createDataFrame([(9, "a b c d")], "item_id bigint, text string"), slop=1)
    assert {r.doc_id for r in near.collect() if r.n_hit} == {1, 2}
    assert all(r.n_hit == 0 for r in decontamination.judged(docs, bench.limit(0)).collect())


def test_lm_scoring(docs, by_id):
    split = {key: words(lower(text)) for key, text in by_id.items()}
    held = {key for key in split if zlib.crc32(str(key).encode()) % 10 == 0}
    one, two = Counter(), Counter()
    for key, w in split.items():
        if key not in held:
            one.update([*w, 0])
            two.update(zip([1, *w], [*w, 0], strict=True))
    total, distinct = sum(one.values()), len(one)
    history = {**one, 1: len(split) - len(held)}
    m = len(two) / distinct
    for r in lm_scoring.score_texts(docs).collect():
        tokens = [*split[r.doc_id], 0]
        p = [(one[t] + 0.1) / (total + 0.1 * (distinct + 1)) for t in tokens]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(one[t] > 0 for t in tokens), total, r.doc_id in held)
        assert r.base_score == pytest.approx(sum(map(math.log10, p)))
        score = sum(math.log10((two[a, b] + m * q) / (history[a] + m) if history.get(a, 0) else q) for a, b, q in zip([1, *tokens], tokens, p, strict=False))
        assert r.score == pytest.approx(score)
    assert all(math.isfinite(r.score) for r in lm_scoring.score_texts(docs, order=3).collect())


def test_token_records(spark, docs, by_id, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_records.default_tokenizer())
    start = 0
    got = {r.doc_id: r for r in token_records.run_stage(spark, docs).collect()}
    for key, text in by_id.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    folder = f"file://{tmp_path}/records"
    index = token_records.write_records(docs, folder, token_records.default_tokenizer(), 1)
    one = token_records.read_ids(index.filter("doc_id = 37"), folder).first()
    assert one.ids == [*tokenizer.encode(by_id[37], add_special_tokens=False).ids, 1]
    record = token_records.frame(b"\x02\x05\x00")
    assert token_records.ids_of(record).tolist() == [5]
    for broken in (record[:-1], record[:13] + b"\x06" + record[14:]):
        with pytest.raises(ValueError):
            token_records.unframe(broken)


def test_tokens_of_unusual_texts():
    from tokenizers import Tokenizer

    path = token_records.default_tokenizer()
    tokenizer, encoder = Tokenizer.from_file(path), token_records.Encoder(path)
    odd = ["It's A<|endoftext|>b x\x1cyİ naïve ½²ª we'll're %%%''s DON'T ǅ­1234 a\x85b", "é ŉ ſt Σας", "a'b' 'tis x's'", "﻿​x 　y z", "ＡＢ ①", "a\x00b\x07"]
    for text in odd:
        assert encoder([text])[0] == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes(), text


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    assert rows and {"replica", "shuffle_key"} < set(rows[0].asDict()) and len({r.shuffle_key for r in rows}) == len(rows)
    assert [(r.doc_id, r.replica) for r in rows] == [(r.doc_id, r.replica) for r in sorted(rows, key=lambda r: r.shuffle_key)]
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("source"))
    weights = spark.createDataFrame([("rare", 0.9), ("common", 0.1)], "source string, weight double")
    counts = {r.source: r["count"] for r in mixing.mix(many, weights=weights).groupBy("source").count().collect()}
    assert abs(counts["rare"] - 18_000) < 6 * math.sqrt(18_000) and abs(counts["common"] - 2_000) < 6 * math.sqrt(2_000)
    heavy = mixing.replicate(many, weights=spark.createDataFrame([("rare", 1.0)], "source string, weight double")).groupBy("doc_id").count()
    mean, variance = heavy.agg(F.avg("count"), F.var_samp("count")).first()
    assert heavy.count() == 2_000 and abs(mean - 10) < 0.5 and abs(variance - 10) < 2


def test_topk(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[50:200] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(700, None), (701, [float("nan")] * 8), (702, [None] * 8), (703, [float("inf")] * 8), (None, [1.0] * 8), (5, [2.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x")).repartition(3)
    good = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and i not in (700, 701, 702, 703)]
    asked = frame.filter("vec_id % 100 = 0")
    for k in (10, 1000):
        got: dict = {}
        for r in topk_search.top_k(frame, asked, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        for query_id, q in ((i, v) for i, v in good if i % 100 == 0):
            best = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in good if i != query_id))[:k]
            assert got[query_id] == [(i, -s) for s, i in best]
    assert topk_search.top_k(frame, asked.limit(0)).count() == 0 and topk_search.top_k(frame.limit(0), asked).count() == 0


def test_html(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>"
        "<article><h1>Head line</h1><p>Some&amp;more <b>bold</b>\n text&nbsp;here<p>Second <a href=y>link</a> in it<!-- no --><div class='ad'>Buy this now</div>"
        "<div id=comments><p>A reader writes a lot of words in here</div><form><p>Your name</form></article><footer>(c) 2020</footer>"
    )
    rows = [(1, "u", page, "c"), (2, None, None, "c"), (3, "u", "", "c"), (4, "u", "<p", "c"), (5, "u", "<article>" + "<div>" * 3000 + "deep" + "<p>w</p>" * 20_000, "c")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(frame).collect()}
    text = "Head line\nSome&more bold text here\nSecond link in it"
    assert got[1] == (text, len(text)) and got[2] == got[3] == ("", 0) and got[5][1] > 20_000


def test_html_tree_fits_its_table():
    table, tree = html_text.labelled_table(), html_text.grown_tree()
    assert np.mean([tree.predict(tuple(r[:-1])) == r[-1] for r in table]) > 0.95


def test_toxicity_chain(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    train = labels.filter("doc_id % 3 != 0")
    chain = toxicity.fit_chain(docs, train, toxicity.label_categories())
    odd = spark.createDataFrame([(-1, None, "c"), (-2, "", "c"), (-3, " ", "c")], "doc_id bigint, text string, toxic string")
    got = {r.doc_id: r for r in toxicity.score(docs.select("doc_id", "text").withColumn("toxic", F.lit("c")).unionByName(odd), chain).collect()}
    assert not any(got[i].toxic for i in (-1, -2, -3))
    out = [r for r in labels.filter("doc_id % 3 = 0").collect()]
    assert np.mean([got[r.doc_id].toxic == bool(r.toxic) for r in out]) > 0.9
    none = toxicity.fit_chain(docs, labels.limit(0), toxicity.label_categories())
    assert not any(r.toxic for r in toxicity.score(docs, none).collect())


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    for frame in (suffix_dedup.dedup(none), lz_dedup.dedup(none), jaccard_join.components(none), decontamination.judged(none, bench), lm_scoring.score_texts(none), mixing.mix(none), token_records.run_stage(spark, none)):
        assert frame.count() == 0


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(None, text), (None, text), (3, text), (3, text), (1, "short")], "doc_id bigint, text string").repartition(3)
    kept = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.dedup(rows).collect())
    assert [n for _, n in kept].count(0) == 2 and kept[1][1] + kept[0][1] == len(text)
    assert all(r.n_removed == 60 for r in lz_dedup.dedup(rows).filter("n_words = 60").collect())
    assert {(r.doc_id, r.component_id) for r in jaccard_join.components(rows).collect()} == {(None, 3), (3, 3), (1, 1)}
    assert lm_scoring.score_texts(rows).count() == 5
    assert sorted(r.start for r in token_records.run_stage(spark, rows).collect())[0] == 0
    assert decontamination.judged(rows, spark.createDataFrame([(1, text)], "item_id bigint, text string")).filter("contaminated").count() == 4

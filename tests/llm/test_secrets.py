"""Base spans against plain patterns, inference, and what the learned automata add."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from llm import secret_scan
from llm.registry import ship

DOCS = "doc_id bigint, text string, kind string, spans int"
PATTERNS = [
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]


def plain_spans(text: str) -> list[tuple[int, int, str, int]]:
    found = []
    for place, (kind, pattern, group, least) in enumerate(PATTERNS):
        found += [(m.start(), place, kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(found)


def corpus() -> list[str | None]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    code = lambda k, chars="0123456789abcdef": "".join(rng.choices(chars, k=k))
    capital = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out: list[str | None] = [None, "", " ", "token=", "TOKEN : 'abcde'", "ſecret=abcdefgh toKen=abcdefgh", "password=secret=token", "AKIAAKIA", "xAKIA" + "A" * 15, "xAKIA" + "A" * 16]
    out += ["f" * 23, "f" * 24, "é" + "0" * 30 + "g", "api_key\"  =  \"a.b-c/d+e=\" apikey='123456'", "a" * 100_000, "token " + " " * 20_000 + "x", "日本 secret: 1234567 語"]
    for i in range(160):
        out.append(f'{prose(20)} token = "{code(40)}" {prose(5)} AKIA{code(16, capital)} {prose(3)}')
        out.append(f"{prose(30)} {''.join(word() for _ in range(5))}-{prose(10)}")
    out += [f"{prose(10)} é {code(22)} {prose(10)}" for _ in range(20)]
    return out + out[20:24]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i * 7 % 1000 if i != 30 else None, text, "k", 1) for i, text in enumerate(corpus())]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def test_base_and_learned_spans(spark, docs, monkeypatch):
    monkeypatch.setattr(secret_scan, "read", lambda *_: docs)
    rows = secret_scan.op11_secret_scan(spark, "").collect()
    by_id = {(i * 7 % 1000 if i != 30 else None): text or "" for i, text in enumerate(corpus())}
    assert len(rows) == len(by_id)
    learned = set()
    for row in rows:
        base = plain_spans(by_id[row.doc_id])
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(x[2] == k for x in base) for k in ("assign", "access", "hex")]
        labels = [f"{kind}:{start}:{end}" for start, _, kind, end in base]
        assert row.base_sha256 == hashlib.sha256(",".join(labels).encode()).hexdigest()
        spans = row.spans.split(",") if row.spans else []
        assert [s for s in spans if not s.startswith("learned")] == labels
        for span in spans:
            if span.startswith("learned"):
                _, a, b = span.split(":")
                learned.add(by_id[row.doc_id][int(a) : int(b)])
    formats = {x for x in learned if re.fullmatch("[0-9a-f]{22}", x)}
    assert len(formats) == 20 and not {x for x in learned if re.fullmatch("[a-z-]{16,}", x) and not re.fullmatch("[a-f]+", x)}


def test_nothing_to_learn_from(spark, docs):
    none = docs.filter("doc_id < 0")
    assert secret_scan.scan(none, secret_scan.learn(none)).count() == 0
    few = docs.filter(F.length("text") < 60)
    got = secret_scan.scan(few, secret_scan.learn(few)).collect()
    assert got and all(s.kind != "learned" for row in got for s in row.spans)


def test_inference_merges_equal_states():
    rng = random.Random(1)
    strings = ["ab" + "".join(rng.choices("01", k=rng.randint(5, 30))) for _ in range(2000)]
    automaton = secret_scan.Automaton(strings)
    assert len(automaton.stop) < 20
    good, bad = automaton.score(["ab0101101001", "ba0101101001"])
    assert good > bad + 5
    long = "ab" + "01" * 400
    assert automaton.score([long, "ab"])[0] == pytest.approx(one_by_one(automaton, long))


def one_by_one(automaton, text: str) -> float:
    state, total = 0, 0.0
    for c in text:
        code = secret_scan.SYMBOLS.index(c)
        total += automaton.log[state, code]
        state = automaton.next[state, code]
    return total + automaton.stop[state]

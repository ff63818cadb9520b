"""Secret scans by grammar inference: probabilistic automata learned from credentials judge the format of every candidate.

*Base spans* come from three fixed patterns (``assign``, ``access``, ``hex``), whole matches, and always stay.

*Labelled credentials* are the distinct values of base spans (of ``assign`` the assigned value): per kind the ``max_labelled``
of smallest hash, of at most ``LONGEST_LEARNED`` characters.  These two numbers and ``max_plain`` bound what reaches the driver.
*Plain strings*, the other side, are candidates outside base spans, ``max_plain`` of them.

*Inference.*  Strings of a kind make a prefix tree with counts.  From the root on, a state is merged into an earlier one if
their stop and next-character frequencies agree within the Hoeffding bound at ``ALPHA``, and so do the states
behind equal characters; else it stays a state of its own.  What comes out is a deterministic
automaton with probabilities, smoothed by ``SMOOTHING`` virtual characters a state; where it has no
arc, every further character is equally likely.

*Score.*  A candidate is a run of at least ``LEAST_CANDIDATE`` credential characters (not ending in a full stop) that no base span
touches.  Its format likelihood is the log of its probability under a kind's automaton over that under the one of plain strings, for
one character, so that lengths do not matter.  It becomes a span of kind ``learned`` when for one of the kinds this reaches both the ``MISSED`` quantile of
credentials and the ``FALSE`` quantile of plain strings; both are held out of the fit.  Plain strings only lack a label: those
that a first fit takes for a kind are set aside, unless they are more than ``SET_ASIDE`` of all (then the kind looks like plain text).  A kind with fewer than
``LEAST_LABELLED`` strings to fit or none held out adds nothing, and so does every kind where there are no plain strings.

Null and empty texts have no spans; texts of any length are scanned whole; repeated rows are scanned each; ids of any
value, null too, are passed on.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm._common import read, store
from llm.registry import query

MAX_LABELLED = 2_000
MAX_PLAIN = 8_000
LEAST_LABELLED = 50
LONGEST_LEARNED = 256
LEAST_CANDIDATE = 16
ALPHA = 0.05
SMOOTHING = 2.0
MISSED = 0.02
FALSE = 0.999
SET_ASIDE = 0.2
#: One string in so many is held out of the fit, to set the limits.
HELD_OUT = 5

# The base patterns and the least length of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is always a maximal one
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex")

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_CANDIDATE - 1},}}[A-Za-z0-9+/_=-]")
_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
#: Longer candidates are scored one by one; shorter ones of a batch together.
LONG = 512

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind number, end) of base spans, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def value_of(text: str, span: Span) -> str:
    start, kind, end = span
    return text[start:end] if kind else ASSIGN.match(text, start).group(2)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Runs of credential characters that no base span touches."""
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][0] < end:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= start:
            out.append((start, end))
    return out


class Tree:
    """Prefix tree with counts, whose states are merged in place."""

    def __init__(self, strings: list[str]):
        self.count, self.stop, self.arcs = [0], [0], [{}]  # arcs: symbol to [count, state]
        for text in strings:
            state = 0
            self.count[0] += 1
            for symbol in text:
                arc = self.arcs[state].get(symbol)
                if arc is None:
                    arc = self.arcs[state][symbol] = [0, len(self.count)]
                    self.count.append(0)
                    self.stop.append(0)
                    self.arcs.append({})
                arc[0] += 1
                state = arc[1]
                self.count[state] += 1
            self.stop[state] += 1

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether all frequencies from a and b on agree; b is the root of a tree."""
        width = math.sqrt(0.5 * math.log(2 / alpha))
        open_ = [(a, b)]
        while open_:
            a, b = open_.pop()
            n, m = self.count[a], self.count[b]
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound >= 1:
                continue  # no difference of frequencies is larger; behind here counts are smaller still
            if abs(self.stop[a] / n - self.stop[b] / m) > bound:
                return False
            for symbol in self.arcs[a].keys() | self.arcs[b].keys():
                one, other = self.arcs[a].get(symbol), self.arcs[b].get(symbol)
                if abs((one[0] if one else 0) / n - (other[0] if other else 0) / m) > bound:
                    return False
                if one and other:
                    open_.append((one[1], other[1]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree from b on to a."""
        open_ = [(a, b)]
        while open_:
            a, b = open_.pop()
            self.count[a] += self.count[b]
            self.stop[a] += self.stop[b]
            for symbol, (n, state) in self.arcs[b].items():
                arc = self.arcs[a].get(symbol)
                if arc is None:
                    self.arcs[a][symbol] = [n, state]
                else:
                    arc[0] += n
                    open_.append((arc[1], state))

    def merge(self, alpha: float) -> list[int]:
        """Merge compatible states; the states that are left, the root first."""
        kept, known = [0], {0}
        while True:
            edge = [(-arc[0], kept.index(state), symbol) for state in kept for symbol, arc in self.arcs[state].items() if arc[1] not in known]
            if not edge:
                return kept
            _, place, symbol = min(edge)
            arc = self.arcs[kept[place]][symbol]
            new = arc[1]
            for state in kept:
                if self.compatible(state, new, alpha):
                    arc[1] = state
                    self.fold(state, new)
                    break
            else:
                kept.append(new)
                known.add(new)


class Automaton:
    """Next state and log probability by (state, symbol), log probability of stopping by state.  The last state has no way out and knows nothing."""

    def __init__(self, strings: list[str], alpha: float = ALPHA, smoothing: float = SMOOTHING):
        tree = Tree(sorted(strings))
        states = tree.merge(alpha)
        number = {state: i for i, state in enumerate(states)}
        size, even = len(SYMBOLS), 1 / (len(SYMBOLS) + 1)
        self.next = np.full((len(states) + 1, size), len(states), np.int64)
        p, stop = np.full((len(states) + 1, size), even), np.full(len(states) + 1, even)
        for i, state in enumerate(states):
            n = tree.count[state] + smoothing
            p[i], stop[i] = smoothing * even / n, (tree.stop[state] + smoothing * even) / n
            for symbol, (count, target) in tree.arcs[state].items():
                code = _CODE[ord(symbol)]
                p[i, code] += count / n
                self.next[i, code] = number[target]
        self.log, self.stop = np.log(p), np.log(stop)

    def score(self, strings: list[str]) -> np.ndarray:
        """Log probability of every string, all steps of one length together."""
        sizes = np.array([len(s) for s in strings], np.int64)
        out = np.zeros(len(strings))
        for i in np.flatnonzero(sizes > LONG):
            state, total = 0, 0.0
            steps, logs = self.next.tolist(), self.log.tolist()
            for code in _CODE[np.frombuffer(strings[i].encode(), np.uint8)].tolist():
                total += logs[state][code]
                state = steps[state][code]
            out[i] = total + self.stop[state]
        short = np.flatnonzero(sizes <= LONG)
        short = short[np.argsort(-sizes[short], kind="stable")]
        codes = _CODE[np.frombuffer("".join(strings[i] for i in short).encode(), np.uint8)]
        first = np.cumsum(sizes[short]) - sizes[short]
        state, total = np.zeros(len(short), np.int64), np.zeros(len(short))
        for step in range(int(sizes[short].max(initial=0))):
            n = int(np.searchsorted(-sizes[short], -step, "left"))  # those longer than ``step``
            code = codes[first[:n] + step]
            total[:n] += self.log[state[:n], code]
            state[:n] = self.next[state[:n], code]
        out[short] = total + self.stop[state]
        return out


class Grammar:
    """Automata of credential kinds, one of plain strings, and the least log ratio a character by kind."""

    def __init__(self, credentials: dict[str, list[str]], plain: list[str], alpha: float = ALPHA):
        self.automata, self.limits, self.plain = [], [], None
        parts = {kind: split(strings) for kind, strings in sorted(credentials.items())}
        parts = {kind: (own, held) for kind, (own, held) in parts.items() if len(own) >= LEAST_LABELLED and held}
        fit, usual = split(plain)
        if not fit or not usual or not parts:
            return
        self.automata = [Automaton(own, alpha) for own, _ in parts.values()]
        self.plain = Automaton(fit, alpha)
        # Plain strings are those without a label: some are credentials, too, and must not teach.
        for automaton, (_, held) in zip(self.automata, parts.values(), strict=True):
            least = max(0.0, float(np.quantile(self.ratio(automaton, held), MISSED)))
            doubted = [self.ratio(automaton, strings) >= least for strings in (fit, usual)]
            if sum(d.sum() for d in doubted) <= SET_ASIDE * (len(fit) + len(usual)):
                fit, usual = ([s for s, d in zip(strings, doubt, strict=True) if not d] for strings, doubt in zip((fit, usual), doubted, strict=True))
        self.plain = Automaton(fit, alpha)
        for automaton, (_, held) in zip(self.automata, parts.values(), strict=True):
            highest = np.quantile(self.ratio(automaton, usual), FALSE) if usual else 0.0
            self.limits.append(max(float(np.quantile(self.ratio(automaton, held), MISSED)), float(highest), 0.0))

    def ratio(self, automaton: Automaton, strings: list[str]) -> np.ndarray:
        """Log ratio of both probabilities, for one character: strings of every length compare."""
        return (automaton.score(strings) - self.plain.score(strings)) / (np.array([len(s) for s in strings]) + 1)

    def accepts(self, strings: list[str]) -> np.ndarray:
        out = np.zeros(len(strings), bool)
        for automaton, limit in zip(self.automata, self.limits, strict=True):
            out |= self.ratio(automaton, strings) >= limit
        return out


def split(strings: list[str]) -> tuple[list[str], list[str]]:
    held = [zlib.crc32(s.encode()) % HELD_OUT == 0 for s in strings]
    return [s for s, h in zip(strings, held, strict=True) if not h], [s for s, h in zip(strings, held, strict=True) if h]


def texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def learn(docs: DataFrame, text_col: str = "text", max_labelled: int = MAX_LABELLED, max_plain: int = MAX_PLAIN) -> Grammar:
    """Automata from the credentials and plain strings of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in texts(batch.column(0)):
                base = base_spans(text)
                found.update((KINDS[span[1]], value_of(text, span)) for span in base)
                found.update(("plain", text[a:b]) for a, b in candidates(text, base))
            found = [x for x in found if len(x[1]) <= LONGEST_LEARNED]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["kind", "value"])

    values = store(docs.select(text_col).mapInArrow(run, "kind string, value string").distinct(), "secret-values")
    pick = lambda kind, most: sorted(r.value for r in values.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(most).collect())
    return Grammar({kind: pick(kind, max_labelled) for kind in KINDS}, pick("plain", max_plain))


def scan(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``: array of (kind, start, end, value) by start, then kind; positions in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(grammar)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, open_ = [], []
            for i, text in enumerate(texts(batch.column(1))):
                base = base_spans(text)
                spans.append([(a, k, b, text[a:b]) for a, k, b in base])
                open_ += [(i, a, b, text[a:b]) for a, b in candidates(text, base)]
            for (i, a, b, value), yes in zip(open_, sent.value.accepts([x[3] for x in open_]), strict=True):
                if yes:
                    spans[i].append((a, len(KINDS), b, value))
            names = (*KINDS, "learned")
            rows = [[{"kind": names[k], "start": a, "end": b, "value": v} for a, k, b, v in sorted(x)] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint, value: string>>")


@query("op11_secret_scan")
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = scan(docs, learn(docs))
    label = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "learned")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(label(base), 256).alias("base_sha256"), label(F.col("spans")).alias("spans"))

"""Phrase collocation mining by Toivonen's sampling.

A phrase is up to ``LONGEST`` words in a row inside a piece of a text; pieces end at ``. , ; : ! ?`` and line breaks.  A phrase
that occurs ``least`` times has parts that do, too.

1. *Sample.*  Phrases of one document in ``SAMPLE``, chosen by a hash of the id, with ``LOWERED`` occurrences
   there are proposed as frequent.  The proposal goes to the tasks as a bit filter of a fixed size (``FILTER_BITS``).
2. *Full pass.*  Over all texts, a phrase is counted if it is a word or if both its parts that are one
   word shorter are proposed: these are the proposed phrases and their negative border, in one condition.  The counts are
   exact, and a wrong bit of the filter only makes more phrases count.
3. *Expansion.*  Frequent phrases that were not proposed are failures of the border.  They join the proposal, and another
   pass counts what is new in the border.  This goes on until no frequent phrase is outside; then none is missed.  Each failure
   of a later pass is longer than one of an earlier pass, so there are ``LONGEST`` passes at most.

Blocks of texts count inside numpy and send one row per phrase, its 64-bit hash; the texts of frequent phrases are read in a last pass.

Everything is per ``lang`` (null: ``und``).  Null, empty and wordless texts have no phrases; repeated rows count each; null
ids are documents like others; texts and words of any length are taken whole.  Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm._common import U64, Block, hash_spans, lower, mix, read, store, text_blocks, words
from llm._sieve import FILTER_BITS, Sieve, sent, sieve_of
from llm.registry import query

LONGEST = 4
LEAST = 30
SAMPLE = 16
LOWERED = 2
#: A candidate inside a longer one with this share (percent) of its count is dropped.
INSIDE_PERCENT = 80
TOP = 2000
#: A language's candidates are first ranked in so many parts.
RANK_PARTS = 64
#: Text that a task counts at a time.
BLOCK_BYTES = 2 << 20
#: Rows that a task sends at a time.
BATCH = 1 << 16

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False
_MULTIPLIER = U64(0x9E3779B97F4A7C15)


class Phrases:
    """Words of a block, and the hash of every phrase by its number of words."""

    def __init__(self, block: Block, langs: list[str]):
        data = lower(block.data)
        starts, ends, before = words(data, block.offsets, _WORD)
        self.doc = np.repeat(np.arange(len(block)), np.diff(before))
        seeds = {lang: U64(h) for lang, h in zip(sorted(set(langs)), lang_hashes(sorted(set(langs))), strict=True)}
        seed = np.array([seeds[lang] for lang in langs], U64)
        piece = np.searchsorted(np.flatnonzero(_ENDS[data]), starts)
        self.joined = (self.doc[1:] == self.doc[:-1]) & (piece[1:] == piece[:-1])
        self.word = mix(hash_spans(data, starts, ends) + seed[self.doc])
        self.raw, self.at = data, (starts, ends)

    def joined_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words with single spaces between them, and where each starts and ends; only texts of phrases need them."""
        starts, ends = self.at
        sizes = ends - starts
        ends = np.cumsum(sizes + 1) - 1
        joined = np.full(int(ends[-1]) + 1 if len(sizes) else 0, 0x20, np.uint8)
        inside = np.ones(len(joined), bool)
        inside[ends] = False
        joined[inside] = self.raw[_WORD[self.raw]]
        return joined, ends - sizes, ends

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, hash of the phrase from every word on, whether it is in one piece)."""
        hashes, whole = self.word, np.ones(len(self.word), bool)
        for size in range(1, LONGEST + 1):
            yield size, hashes, whole
            if len(hashes) < 2:
                return
            hashes = mix(hashes[:-1] * _MULTIPLIER + self.word[size:])
            whole = whole[:-1] & self.joined[size - 1 :]

    def counted(self, sieve: Sieve) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, hashes, which of them are proposed or in the negative border of the proposal)."""
        counts = None
        for size, hashes, whole in self.levels():
            counts = whole if counts is None else whole & inside[:-1] & inside[1:]
            yield size, hashes, counts
            inside = counts.copy()
            inside[counts] = sieve.has(hashes[counts])

    @staticmethod
    def spans(joined: tuple[np.ndarray, np.ndarray, np.ndarray], first: np.ndarray, size: int) -> pa.Array:
        """Texts of the phrases from words ``first`` on."""
        data, starts, ends = joined
        a, b = starts[first], ends[first + size - 1]
        bounds = np.concatenate([[0], np.cumsum(b - a)])
        at = np.arange(bounds[-1]) + np.repeat(a - bounds[:-1], b - a)
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[at]))


def lang_hashes(langs: list[str]) -> np.ndarray:
    raw = [lang.encode() for lang in langs]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    return mix(hash_spans(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends) + U64(1))


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Phrases]]:
    """Blocks of (lang, text) batches."""
    for block in text_blocks(batches, BLOCK_BYTES):
        langs = ["und" if x is None else x for x in block.ids]
        yield langs, Phrases(block, langs)


def tallied(hashes: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Distinct hashes and how often each occurs, in small batches: a large one would be held in full on both sides of the pipe."""
    found, n = np.unique(hashes, return_counts=True)
    for i in range(0, len(found), BATCH):
        yield pa.array(found[i : i + BATCH].view(np.int64)), pa.array(n[i : i + BATCH], pa.int64())


def texts_of(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))


def propose(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int, lowered: int) -> DataFrame:
    """``hash`` of phrases that are frequent in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, phrases in blocks_of(batches):
            for _, hashes, whole in phrases.levels():
                for found, n in tallied(hashes[whole]):
                    yield pa.RecordBatch.from_arrays([found, n], ["hash", "n"])

    drawn = docs.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(13)), F.lit(sample)) == 0)
    return texts_of(drawn, text_col, lang_col).mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= lowered).select("hash")


def count(docs: DataFrame, text_col: str, lang_col: str, sieve: Sieve, older: Sieve | None, least: int) -> DataFrame:
    """Stored ``hash, size, f`` of frequent phrases that count with ``sieve`` and did not with ``older``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, older = filters.value
        for _, phrases in blocks_of(batches):
            before = phrases.counted(older) if older is not None else None
            for size, hashes, counts in phrases.counted(sieve):
                if before is not None:
                    counts = counts & ~next(before)[2]
                for found, n in tallied(hashes[counts]):
                    yield pa.RecordBatch.from_arrays([found, pa.array(np.full(len(n), size, np.int32)), n], ["hash", "size", "f"])

    with sent(docs.sparkSession, (sieve, older)) as filters:
        counted = texts_of(docs, text_col, lang_col).mapInArrow(run, "hash bigint, size int, f bigint")
        return store(counted.groupBy("hash", "size").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "phrases")


def missed(counted: DataFrame, sieve: Sieve) -> DataFrame:
    """Frequent phrases that can be part of longer ones and are not in the proposal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~proposed.value.has(batch.column(0).to_numpy().view(U64))))

    with sent(counted.sparkSession, sieve) as proposed:
        return store(counted.filter(F.col("size") < LONGEST).select("hash").mapInArrow(run, "hash bigint"), "phrases-missed")


def named(docs: DataFrame, text_col: str, lang_col: str, wanted: Sieve) -> DataFrame:
    """Stored ``hash, lang, size, phrase`` of phrases that ``wanted`` has, and per language a row of size 0 with the number of all words (``n``)."""

    def batch_of(hashes: np.ndarray, langs: pa.Array, size: int, texts: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(hashes.view(np.int64)), langs, pa.array(np.full(len(n), size, np.int32)), texts.cast(pa.string()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["hash", "lang", "size", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, phrases in blocks_of(batches):
            names, number = np.unique(np.array(langs, object), return_inverse=True)
            names = pa.array(names.tolist(), pa.string())
            yield batch_of(np.zeros(len(names), U64), names, 0, pa.array([""] * len(names)), np.bincount(number[phrases.doc], minlength=len(names)))
            joined = phrases.joined_words()
            for size, hashes, whole in phrases.levels():
                place = np.flatnonzero(whole)
                place = place[filter_.value.has(hashes[place])]
                found, first = np.unique(hashes[place], return_index=True)
                for i in range(0, len(first), BATCH):
                    at = place[first[i : i + BATCH]]
                    yield batch_of(found[i : i + BATCH], names.take(pa.array(number[phrases.doc[at]])), size, phrases.spans(joined, at, size), np.zeros(len(at), np.int64))

    with sent(docs.sparkSession, wanted) as filter_:
        rows = texts_of(docs, text_col, lang_col).mapInArrow(run, "hash bigint, lang string, size int, phrase string, n bigint")
        return store(rows.groupBy("hash", "lang", "size", "phrase").agg(F.sum("n").alias("n")), "phrases-named")


def frequent(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST, sample: int = SAMPLE, lowered: int = LOWERED, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, int]:
    """``lang, size, phrase, f`` of all phrases with ``least`` occurrences (and the words of each language, size 0), and the number of full counting passes."""
    proposal = store(propose(docs, id_col, text_col, lang_col, sample, lowered), "phrases-proposed")
    sieve, older, every, passes = sieve_of(proposal, filter_bits), None, None, 0
    while True:
        counted, passes = count(docs, text_col, lang_col, sieve, older, least), passes + 1
        every = counted if every is None else every.unionByName(counted)
        if missed(counted, sieve).isEmpty():
            break
        proposal = proposal.unionByName(counted.filter(F.col("size") < LONGEST).select("hash"))
        older, sieve = sieve, sieve_of(proposal, filter_bits)
    # A wrong bit of one filter only can make a phrase count in two passes; its counts are equal.
    every = store(every.groupBy("hash", "size").agg(F.max("f").alias("f")), "phrases-frequent")
    names = named(docs, text_col, lang_col, sieve_of(every, filter_bits))
    phrases = names.filter("size > 0").join(every, ["hash", "size"]).select("lang", "size", "phrase", "f")
    return phrases.unionByName(names.filter("size = 0").select("lang", "size", "phrase", F.col("n").alias("f"))), passes


def exact(column: str) -> str:
    return f"CAST({column} AS DECIMAL(19, 0))"


def scored(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of candidates (two words or more) that no longer candidate explains."""
    known = phrases.select("lang", F.col("phrase").alias("part"), "f")
    candidates = phrases.filter("size > 1").withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " "))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("left"), F.expr("array_join(slice(words, k + 1, size - k), ' ')").alias("right"))
    cuts = cuts.join(known.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"]).join(known.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"])
    score = F.expr(f"(CAST(2000000 AS DECIMAL(7, 0)) * {exact('a')}) DIV ({exact('l')} + {exact('r')})")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    parts = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    longer = candidates.filter("size > 2").select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"longer IS NULL OR 100 * {exact('longer')} < {INSIDE_PERCENT} * {exact('a')}"))
    return left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = TOP, least: int = LEAST, **how: int) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of every language."""
    phrases, _ = frequent(docs, id_col, text_col, lang_col, least, **how)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = scored(phrases.filter("size > 0")).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    rows = rows.withColumn("rank", place("lang", "part")).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", place("lang").cast("bigint")).filter(F.col("rank") <= top)
    totals = phrases.filter("size = 0").select("lang", F.col("f").alias("n"))
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w CROSS JOIN (VALUES (1), (2), (3), (4)) AS sizes(k)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1
), parts AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS score
  FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')
), best AS (
  SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, k, a, m, unnest(range(1, k - m + 2)) AS i
        FROM (SELECT lang, string_split(phrase, ' ') AS w, k, f AS a, unnest(range(2, k)) AS m FROM f WHERE k > 2))
  GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100 * i.longer::HUGEINT < 80 * b.a::HUGEINT
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))

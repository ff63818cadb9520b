"""Benchmark decontamination with a positional inverted index of the documents.

*Index.*  Every block of documents becomes one row: its words' hashes sorted, and
for each the sorted positions where it stands.  The index is a stored table; it
is sharded by document, so a document's postings are always together and any
number of benchmarks can be looked up in it.

*Search.*  A phrase starts from its rarest term in the block; that term's postings,
moved by the term's offset in the phrase, are the candidate starts.  They are
intersected with the next rarest term's list and so on.  With ``slop`` a term may
stand up to so many words away from its place (proximity match).

The benchmark is the stated query set.  It goes out in blocks of at most
``QUERY_WORDS`` words, each against the whole index.

Null or wordless texts have no words and no hits.  Repeated rows are separate
documents.  Items with the same id count once; those with a null id count
for hit words and the verdict like any other, but are not named: they add nothing to the list of items.  Words are compared by 64-bit hash.
Empty tables give empty results or none hit.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm._common import ALNUM, U64, hash_spans, lower, new_block_id, read, store, text_blocks, words
from llm.registry import query

WINDOW = 13
QUERY_WORDS = 1_000_000
INDEX_BYTES = 8 << 20
#: Positions skipped between documents; no phrase with its slop is longer.
GAP = 1 << 10

INDEX = "block bigint, doc_ids array<bigint>, doc_words array<bigint>, terms binary, bounds binary, positions binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of documents; see the module text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = new_block_id()
        for part in text_blocks(batches, INDEX_BYTES):
            data = lower(part.data)
            starts, ends, before = words(data, part.offsets, ALNUM)
            hashes, counts = hash_spans(data, starts, ends), np.diff(before)
            order = np.argsort(hashes, kind="stable")
            positions = (np.arange(len(hashes)) + GAP * np.repeat(np.arange(len(part)), counts)).astype(np.uint32)[order]
            hashes = hashes[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
            bounds = np.append(first, len(hashes)).astype(np.uint32)
            row = [[block], [part.ids], [counts], [hashes[first].tobytes()], [bounds.tobytes()], [positions.tobytes()]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["block", "doc_ids", "doc_words", "terms", "bounds", "positions"])
            block += 1

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, INDEX)


def phrases(item_ids: list[int | None], texts: list[str | None], length: int) -> tuple[list[np.ndarray], list[list[int]]]:
    """Distinct windows (as word hashes) and the items that hold each; null ids name no item."""
    found: dict[bytes, set[int]] = {}
    for item, text in zip(item_ids, texts, strict=True):
        data = lower(np.frombuffer((text or "").encode(), np.uint8))
        starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
        hashes = hash_spans(data, starts, ends)
        size = min(length, len(hashes))
        for i in range(len(hashes) - size + 1 if size else 0):
            held = found.setdefault(hashes[i : i + size].tobytes(), set())
            if item is not None:
                held.add(item)
    return [np.frombuffer(key, U64) for key in found], [sorted(items) for items in found.values()]


class Shard:
    """Postings of one index row."""

    def __init__(self, terms: bytes, bounds: bytes, positions: bytes):
        self.terms = np.frombuffer(terms, U64)
        self.bounds = np.frombuffer(bounds, np.uint32).astype(np.int64)
        positions = np.frombuffer(positions, np.uint32).astype(np.int64)
        # One ascending list for all terms: term number and position.
        self.postings = (np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.bounds)) << 32) + positions

    def find(self, windows: np.ndarray, lengths: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window number, start position) of every occurrence.  ``windows``: term hashes, padded to a rectangle."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.terms) or not len(windows):
            return nothing
        number = np.minimum(np.searchsorted(self.terms, windows), len(self.terms) - 1)
        inside = np.arange(windows.shape[1]) < lengths[:, None]
        count = np.where(self.terms[number] == windows, np.diff(self.bounds)[number], 0)
        count = np.where(inside, count, np.iinfo(np.int64).max)
        rarest_first = np.argsort(count, axis=1, kind="stable")
        which = np.flatnonzero(count.min(axis=1) > 0)
        anchor = rarest_first[which, 0]
        many = count[which, anchor]
        total = int(many.sum())
        if not total:
            return nothing
        window = np.repeat(which, many)
        offset = np.repeat(anchor, many)
        within = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
        at = self.postings[self.bounds[number[window, offset]] + within] & 0xFFFFFFFF
        start = at - offset
        for step in range(1, windows.shape[1]):
            offset = rarest_first[window, step]
            term = number[window, offset]
            used = step < lengths[window]
            want = (term << 32) + np.maximum(start + offset - slop, 0)
            place = np.minimum(np.searchsorted(self.postings, want), len(self.postings) - 1)
            got = self.postings[place]
            keep = ~used | ((got >= want) & (got <= (term << 32) + start + offset + slop))
            window, start = window[keep], start[keep]
        return window, start


def search(index: DataFrame, benchmark: DataFrame, length: int = WINDOW, slop: int = 0, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``block, place, spans array<bigint> (start, end, start, end ...), items array<bigint>`` of documents with hits, per query block."""
    spark = index.sparkSession
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_WORDS))  # a word takes a character at least
    schema, found = "block bigint, place int, spans array<bigint>, items array<bigint>", None
    for number in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).collect()
        keys, owners = phrases([row.item for row in rows], [row.text for row in rows], length)
        if not keys:
            continue
        lengths = np.array([len(key) for key in keys])
        table = np.zeros((len(keys), lengths.max()), U64)
        for i, key in enumerate(keys):
            table[i, : len(key)] = key
        sent = spark.sparkContext.broadcast((table, lengths, owners))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table, lengths, owners = sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    block, _, counts, *parts = (batch.column(c)[i].as_py() for c in range(6))
                    window, start = Shard(*parts).find(table, lengths, slop)
                    if not len(window):
                        continue
                    firsts = np.cumsum([0, *counts[:-1]]) + GAP * np.arange(len(counts))
                    place = np.searchsorted(firsts, np.maximum(start, 0), "right") - 1
                    begin = np.maximum(start - firsts[place] - slop, 0)
                    end = np.minimum(start - firsts[place] + lengths[window] + slop, np.array(counts)[place])
                    order = np.lexsort((end, begin, place))
                    out = []
                    for group in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
                        spans = merge_spans(begin[group], end[group])
                        held = sorted({item for w in set(window[group].tolist()) for item in owners[w]})
                        out.append((block, int(place[group[0]]), spans, held))
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["block", "place", "spans", "items"])

        part = index.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def merge_spans(begin: np.ndarray, end: np.ndarray) -> list[int]:
    """Union of spans sorted by begin, as start, end, start, end ..."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    firsts = np.flatnonzero(new)
    return np.stack([begin[firsts], reach[np.append(firsts[1:], len(begin)) - 1]], axis=1).ravel().tolist()


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, slop: int = 0) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items`` of every document: hit words by position and the items found."""
    index = store(build_index(docs), "postings")
    pairs = F.posexplode(F.arrays_zip("doc_ids", "doc_words"))
    every = index.select("block", pairs).select("block", F.col("pos").alias("place"), F.col("col.doc_ids").alias("doc_id"), F.col("col.doc_words").alias("n_words"))
    hits = search(index, benchmark, length, slop).groupBy("block", "place").agg(F.collect_list("spans").alias("parts"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged, hit = [], []
            for parts in batch.column("parts").to_pylist():
                pairs = np.array([x for part in parts for x in part]).reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                merged.append(merge_spans(pairs[:, 0], pairs[:, 1]))
                hit.append(sum(merged[-1][1::2]) - sum(merged[-1][::2]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("place"), batch.column("items"), pa.array(merged, pa.list_(pa.int64())), pa.array(hit, pa.int64())],
                ["block", "place", "items", "spans", "n_hit"],
            )

    joined = hits.mapInArrow(run, "block bigint, place int, items array<bigint>, spans array<bigint>, n_hit bigint")
    empty = F.array().cast("array<bigint>")
    return every.join(joined, ["block", "place"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("spans", empty).alias("spans"), F.coalesce("items", empty).alias("items"), "block", "place"
    )


def judged(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """Contamination with the verdict: hit words are at least one in ``share``."""
    return contamination(docs, benchmark).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


@query("op4_benchmark_decontamination")
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated"
    )

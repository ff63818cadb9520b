"""Spelling variant grouping by dense prefix-suffix tiling.

Two words are *near* if one inserted, deleted or replaced code point turns one into the other.  With p
and s the lengths of their common prefix and suffix, that is p + s >= longer length - 1.

*Tiles.*  Words lie in padded code-point matrices, one aligned to the left and one to the right.  Two blocks of
words are compared in one dense operation; the first mismatch from either side gives p and s of every pair.

*Which blocks meet.*  All of the vocabulary against itself would grow with its square.  The longer word
of a pair is cut into ``SEGMENTS`` segments; the edit lies in one of them, and what stands before and after it is
equal in both words.  So a word meets only words with the same (longer length, segment, text around the segment), once
for pairs in which it is the longer one or as long, once for those in which it is the shorter one.  A pair is counted in
the segment where its common prefix ends, so once.  Words under one key fill tiles of at most
``TILE_ROWS`` words; a key with more is dealt into blocks, and each pair of blocks is a tile in a task of its own.

A tile returns one row per word (how many near words, the best of them), never pairs.

A word's form is its near word with the largest count (ties: smallest in code-point order) if that count is at
least ``RATIO`` times its own; roots follow forms to the end by pointer doubling.

Null, empty and letterless texts have no words; repeated rows count each; texts and words of any length are taken
whole.  A null id counts as an empty string in the deletion rule.  Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm._common import buckets, read, store
from llm.registry import query

LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2
DAMAGE = 97
SEGMENTS = 3
#: Words of a tile; long words make smaller ones, so that a matrix has at most ``CELLS`` code points.
TILE_ROWS = 2048
CELLS = 1 << 24
#: Distinct words held by a counting task before it sends their counts on.
HELD = 1 << 18
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_PAD = np.uint32(0xFFFFFFFF)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = None) -> DataFrame:
    """``word, n`` over all whole texts: runs of Latin letters, A-Z lower-cased.

    With ``damage``, a run loses a code point where that number divides the crc32 of ``<id>:<run>``.
    """

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                seed = zlib.crc32(f"{key.as_py() if key.is_valid else ''}:".encode())
                for found, n in Counter(RUN.findall(text.as_py() or "")).items():
                    word = found.lower() if found.isascii() else found.translate(_LOWER)
                    if damage and not (h := zlib.crc32(word.encode(), seed)) % damage:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    counts[word] += n
                if len(counts) >= HELD:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def keyed(vocabulary: DataFrame) -> DataFrame:
    """``word, n, longer, segment, key`` for every key a word has; see the module text."""
    size, longer, segment = F.length("word"), F.col("longer"), F.col("segment")
    cut = lambda number: F.floor(number * longer / SEGMENTS).cast("int")
    rows = vocabulary.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENTS - 1))))
    rows = rows.withColumn("longer", (size + F.floor(F.col("place") / SEGMENTS)).cast("int")).withColumn("segment", (F.col("place") % SEGMENTS).cast("int"))
    rows = rows.filter(cut(segment) < cut(segment + 1))
    after = longer - cut(segment + 1)
    before_text, after_text = F.substring("word", F.lit(1), cut(segment)), F.substring("word", (size - after + 1).cast("int"), after)
    return rows.select("word", "n", "longer", "segment", F.xxhash64("longer", "segment", before_text, after_text).alias("key"))


def tiled(keys: DataFrame, tile_rows: int) -> DataFrame:
    """Keys with several words and one of full length, dealt into tiles: adds ``block``, ``tile`` and whether it is for pairs of two blocks (``across``)."""
    at_most = F.least(F.lit(tile_rows), F.greatest(F.lit(2), F.floor(F.lit(CELLS) / F.col("longer"))))
    groups = keys.groupBy("longer", "segment", "key").agg(F.count("*").alias("size"), F.max(F.length("word")).alias("most"))
    groups = groups.filter((F.col("size") > 1) & (F.col("most") == F.col("longer"))).select("longer", "segment", "key", F.ceil(F.col("size") / at_most).cast("int").alias("blocks"))
    rows = keys.join(groups, ["longer", "segment", "key"]).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.least("block", "other").cast("bigint") * F.col("blocks") + F.greatest("block", "other")
    return rows.select("word", "n", "longer", "segment", "key", "block", tile.alias("tile"), (F.col("block") != F.col("other")).alias("across"))


def matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words, padded on the right and on the left, and the words' lengths."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left, right = np.full((len(words), width), _PAD), np.full((len(words), width), _PAD)
    left[row, at] = points
    right[row, at + width - sizes[row]] = points
    return left, right[:, ::-1], sizes


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every row of ``a`` (groups, m, width) with every row of ``b`` (groups, n, width)."""
    same = a[:, :, None, :] == b[:, None, :, :]
    return np.where(same.all(axis=-1), a.shape[-1], same.argmin(axis=-1))


def compare(words: list[str], width: int, cut: tuple[np.ndarray, np.ndarray], block: np.ndarray, across: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near words of every word inside its group (rows ``firsts[i]`` and ``sizes[i]`` on): how many, and the lowest row number.

    ``cut``: the segment of every row.  In groups ``across`` blocks only words of different blocks count.
    """
    left, right, lengths = matrices(words, width)
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    classes = np.ceil(np.log2(sizes)).astype(np.int64)
    for kind in np.unique(classes):
        side = 1 << int(kind)
        step = max(1, min(side, int((CELLS / width) ** 0.5)))
        many = max(1, CELLS // (step * step * width))
        of_kind = np.flatnonzero(classes == kind)
        for start in range(0, len(of_kind), many):
            group = of_kind[start : start + many]
            rows = firsts[group, None] + np.arange(side)
            real = np.arange(side) < sizes[group, None]
            rows = np.where(real, rows, firsts[group, None])
            two = across[rows[:, 0]]
            for i in range(0, side, step):
                a, real_a = rows[:, i : i + step], real[:, i : i + step]
                for j in range(0, side, step):
                    b, real_b = rows[:, j : j + step], real[:, j : j + step]
                    p = common(left[a], left[b])
                    fits = p + common(right[a], right[b]) >= width - 1
                    fits &= (np.maximum(lengths[a][:, :, None], lengths[b][:, None, :]) == width) & (a[:, :, None] != b[:, None, :])
                    fits &= (p >= cut[0][a][:, :, None]) & (p < cut[1][a][:, :, None]) & real_a[:, :, None] & real_b[:, None, :]
                    fits &= ~two[:, None, None] | (block[a][:, :, None] != block[b][:, None, :])
                    group_at, row_at, other_at = np.nonzero(fits)
                    one, other = a[group_at, row_at], b[group_at, other_at]
                    near += np.bincount(one, minlength=len(words))
                    np.minimum.at(best, one, other)
    return near, best


def near_words(vocabulary: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``word, n_near, best_n, best`` of every word with a near one; ``vocabulary``: distinct ``word``, and ``n``."""
    many = buckets(vocabulary.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        # Inside a group, the row number rises from the best word to the worst.
        table = table.sort_by([("longer", "ascending"), ("segment", "ascending"), ("key", "ascending"), ("tile", "ascending"), ("n", "descending"), ("word", "ascending")])
        longer, segment, key, tile, block = (table.column(c).to_numpy() for c in ("longer", "segment", "key", "tile", "block"))
        across = table.column("across").to_numpy(zero_copy_only=False).astype(bool)
        new = np.ones(len(longer), bool)
        new[1:] = (longer[1:] != longer[:-1]) | (segment[1:] != segment[:-1]) | (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
        firsts = np.flatnonzero(new)
        sizes = np.diff(np.append(firsts, len(longer)))
        out = []
        for width in np.unique(longer):
            a, b = np.searchsorted(longer, [width, width + 1])
            mine = (firsts >= a) & (firsts < b) & (sizes > 1)
            if not mine.any():
                continue
            part = table.slice(a, b - a)
            cut = segment[a:b].astype(np.int64) * width // SEGMENTS, (segment[a:b].astype(np.int64) + 1) * width // SEGMENTS
            near, best = compare(part.column("word").to_pylist(), int(width), cut, block[a:b], across[a:b], firsts[mine] - a, sizes[mine])
            rows = np.flatnonzero(near)
            of = part.select(["word", "n"]).take(pa.array(best[rows]))
            out.append(pa.table({"word": part.column("word").take(pa.array(rows)), "near": near[rows], "best_n": of.column("n"), "best": of.column("word")}))
        return pa.concat_tables(out) if out else pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})

    tiles = tiled(keyed(vocabulary), tile_rows).withColumn("part", F.pmod(F.xxhash64("key", "tile"), F.lit(many)))
    found = tiles.groupBy("part").applyInArrow(run, "word string, near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), F.col("best").alias("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", (-F.col("b.least")).alias("best_n"), F.col("b.best").alias("best"))


def variants(vocabulary: DataFrame, ratio: int = RATIO, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``vocabulary`` (distinct ``word``, and ``n``)."""
    vocabulary = vocabulary.select("word", "n")
    near = vocabulary.join(near_words(vocabulary, tile_rows), "word", "left")
    right = F.col("best_n") >= ratio * F.col("n")
    near = store(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(right, F.col("best")).alias("form"), F.when(right, F.col("best_n")).alias("form_n")), "spelling-forms")
    up = near.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = store(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if up.filter("moved").isEmpty():
            break
        up = up.select("word", "root")
    return near.join(up.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_words(read(spark, sf_dir, "documents"), damage=DAMAGE)
    vocabulary = store(counted.filter((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT)), "spelling-words")
    return variants(vocabulary)

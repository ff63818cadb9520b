"""Shared helpers: table access, text blocks, hashing of words and byte strings, bucketed exchange.

Python tasks see text as *blocks*: a few megabytes of consecutive documents as
one byte array with offsets, so that all work on words and bytes is done by
whole-array numpy operations.  Where blocks have to meet by key they send one
packed row per hash bucket instead of one row per key.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from barlab.session import materialize

U64 = np.uint64
BLOCK_BYTES = 16 << 20
SEGMENT = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_WHITE = ~_WHITE
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, a-z, everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: later jobs and lost executors do not repeat the work."""
    return materialize(df, f"llm-{label}")


def buckets(spark: SparkSession, factor: int = 4) -> int:
    """Number of hash buckets: follows ``spark.sql.shuffle.partitions``, which is what sizes a task."""
    return factor * int(spark.conf.get("spark.sql.shuffle.partitions"))


class Block:
    """Consecutive documents: ids (object list), text offsets and bytes."""

    def __init__(self, ids: list, offsets: np.ndarray, data: np.ndarray):
        self.ids, self.offsets, self.data = ids, offsets, data

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def __len__(self) -> int:
        return len(self.ids)


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of (key, text) batches; null text counts as empty.  A single longer text is a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(1)
        if column.null_count:
            column = pc.fill_null(column, "")
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
        ids, start = batch.column(0).to_pylist(), 0
        while start < len(ids):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            end = min(end, len(ids))
            yield Block(ids[start:end], offsets[start : end + 1] - offsets[start], data[offsets[start] : offsets[end]])
            start = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``inside`` bytes, and the number of words before each document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    here = inside[data]
    first = here.copy()
    first[1:] &= ~here[:-1]
    last = here.copy()
    last[:-1] &= ~here[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = here[edges]
    last[edges - 1] = here[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


@functools.cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span (spans in ascending order), from running polynomial sums."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + SEGMENT, "right"))
        if j <= i:  # one very long span
            out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
            i += 1
            continue
        piece = data[base : ends[j - 1]].astype(U64) + U64(1)
        piece *= _powers(_MULTIPLIER, SEGMENT)[: len(piece)]
        sums = np.empty(len(piece) + 1, U64)
        sums[0] = 0
        np.cumsum(piece, out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        value = (sums[b] - sums[a]) * _powers(_INVERSE, SEGMENT)[a]
        out[i:j] = mix(value + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def hash_runs(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values (already mixed); entry i covers values[i : i + k]."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(_MULTIPLIER)
        out += values[j : j + n]
    return mix(out)


def sliding(reduce, values: np.ndarray, width: int) -> np.ndarray:
    """``reduce`` (np.minimum or np.maximum) over every ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = reduce(out[: len(out) - step], out[step:])
        have += step
    return out


def local_minima(hashes: np.ndarray, usable: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the minimum of a window of ``width`` usable neighbours.

    Selection depends on the window's content alone, so equal windows select at equal offsets.
    """
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    low = sliding(np.minimum, hashes, width)
    whole = sliding(np.minimum, usable.view(np.uint8), width).astype(bool)
    low = np.where(whole, low, U64(0))
    pad = np.zeros(width - 1, U64)
    best = sliding(np.maximum, np.concatenate([pad, low, pad]), width)
    return np.flatnonzero((best == hashes) & (best > 0))


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an integer array: byte planes, since neighbouring values share their high bytes."""
    if not len(values):
        return b""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def bucket_of(keys: np.ndarray, count: int) -> np.ndarray:
    """Bucket of a hash; rises with the hash, so sorted keys are grouped by bucket."""
    return (((keys >> U64(32)) * U64(count)) >> U64(32)).astype(np.int64)


def cuts(keys: np.ndarray, count: int) -> np.ndarray:
    """Bounds of every bucket in sorted keys."""
    return np.searchsorted(bucket_of(keys, count), np.arange(count + 1))


def new_block_id() -> int:
    """Unique among all blocks of a stage, the same when a task is repeated."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() << 32 if context else 0

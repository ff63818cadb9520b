"""Repeats of long windows through sampled anchors, exchanged in hash buckets.

Anchors are positions chosen by content (`local_minima`), at least one in every window
that matters, at the same offset in equal windows.  Four exchanges of packed rows:

1. every block sends its anchors' hashes to buckets, which tell it which occur elsewhere;
2. it sends the surroundings of shared anchors, one row for equal surroundings inside
   the block, and gets a bit mask per row: windows (by offset) that repeat.

A block keeps its documents compressed in a row that travels along; documents
without a shared anchor are settled after the first half and leave only their digest.
A group of copies, however large, sends one row per block and distinct surrounding.

The first exchange also adds up how many rows of surroundings an anchor would send.  An
anchor with more than ``HOT`` does not go to one bucket: its windows are dealt one by one, by the hash
of anchor, offset and the window's remaining content, one row per block and distinct window, and
a bucket only finds the first of each window or whether there are several.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm._common import U64, Block, buckets, cuts, hash_spans, mix, new_block_id, pack, text_blocks, unpack

#: Rows of one anchor that one bucket takes.
HOT = 1 << 14
#: Hot rows that are cut into windows at a time.
SLICE = 1 << 14

ROW = "block bigint, bucket int, keys binary, parts array<binary>"
NAMES = ["block", "bucket", "keys", "parts"]
KINDS = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary())]


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in KINDS]
    return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, KINDS, strict=True)], NAMES)


def by_bucket(block: int, many: int, keys: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """One packed row per bucket; ``keys`` ascend, columns may have several values per key."""
    bounds = cuts(keys, many)
    rows = []
    for b in range(many):
        x, y = bounds[b], bounds[b + 1]
        rows.append((block, b, pack(keys[x:y]), [pack(np.ascontiguousarray(c[x:y]).ravel()) for c in columns]))
    return rows


def split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(rows that travel along, rows with keys)."""
    own = table.column("keys").is_null()
    return table.filter(own), table.filter(pc.invert(own))


class Job:
    """What an operator does at each step; every method works on one block or one bucket."""

    result: str

    def anchors(self, block: Block) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], list[bytes]]:
        """Hashes of the anchors in block order, their surroundings (bytes, starts, ends), and the block's state."""
        raise NotImplementedError

    def hashes(self, state: list[bytes]) -> np.ndarray:
        """The anchors' hashes again, from the state: cheaper than to carry them."""
        raise NotImplementedError

    def surroundings(self, state: list[bytes], shared: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
        """Keys and columns of the rows to send (in the order of the mask to come), and the new state."""
        raise NotImplementedError

    def judge(self, keys: np.ndarray, columns: list[np.ndarray], blocks: np.ndarray) -> np.ndarray:
        """Mask of every row of a bucket."""
        raise NotImplementedError

    def sides(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Content before and after the anchor, nearest first, and how much of it is there."""
        return columns[0], columns[1], columns[2][:, :2]

    def gather(self, columns: list[np.ndarray], rows: np.ndarray, group: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Columns of a block's distinct windows; ``first``: where each stands first in ``rows`` and ``group``."""
        raise NotImplementedError

    def decide(self, keys: np.ndarray, columns: list[np.ndarray], blocks: np.ndarray) -> np.ndarray:
        """Answer (0 or 1) of every window row of a bucket; ``keys``: two hashes of each window."""
        raise NotImplementedError

    def repeats(self, answers: np.ndarray, group: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which windows repeat, from the answers to the block's distinct windows."""
        raise NotImplementedError

    def finish(self, state: list[bytes], masks: np.ndarray) -> pa.Table:
        raise NotImplementedError

    #: Types of the columns of distinct windows.
    window_kinds: list[type] = []
    #: Types of the columns sent, as (dtype, values per row).
    kinds: list[tuple[type, int]] = []


def running(keys: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Entry [m, i]: hash of row i's key and its first m bytes or words on one side."""
    out = np.empty((side.shape[1] + 1, len(keys)), U64)
    out[0] = keys
    for m in range(side.shape[1]):
        out[m + 1] = mix(out[m] * U64(0xD6E8FEB86659FD93) + side[:, m].astype(U64) + U64(m + 1))
    return out


def windows(keys: np.ndarray, before: np.ndarray, after: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, two hashes) of every whole window around the anchors, rows ascending inside an offset."""
    width, found = before.shape[1], []
    for start in range(0, len(keys), SLICE):
        part = slice(start, start + SLICE)
        seeds = [keys[part], mix(keys[part] + U64(0x2545F4914F6CDD1D))]
        hashed = [(running(s, before[part]), running(s, after[part])) for s in seeds]
        for d in range(width + 1):
            row = np.flatnonzero((room[part, 0] >= d) & (room[part, 1] >= width - d))
            both = [mix(x[d, row] * U64(0x9E3779B97F4A7C15) + y[width - d, row] + U64(d)) for x, y in hashed]
            found.append((row + start, np.full(len(row), d, np.uint8), np.column_stack(both)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros((0, 2), U64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of every row of two hashes, first row of each class); classes ascend."""
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))  # stable
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]).any(axis=1)
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    return where, order[new]


def run(docs: DataFrame, make: Callable[[], Job], id_col: str, text_col: str, block_bytes: int, hot: int) -> DataFrame:
    many, result = buckets(docs.sparkSession), make().result

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, block = make(), new_block_id()
        for part in text_blocks(batches, block_bytes):
            hashes, (data, starts, ends), state = job.anchors(part)
            keys, where, counts = np.unique(mix(hashes), return_inverse=True, return_counts=True)  # minima are small numbers: spread them over all buckets
            several = np.flatnonzero(counts[where] > 1)
            around = np.unique(np.column_stack([where[several].astype(U64), hash_spans(data, starts[several], ends[several])]), axis=0)[:, 0].astype(np.int64)
            rows_to_come = np.maximum(np.bincount(around, minlength=len(keys)), 1)
            rows = by_bucket(block, many, keys, [(np.minimum(rows_to_come, 0x7FFF) * 2 + (counts > 1)).astype(np.uint16)])
            yield as_batch([*rows, (block, block % many, None, state)])
            block += 1

    def mark(table: pa.Table) -> pa.Table:
        own, rows = split(table)
        keys = [unpack(k, U64) for k in rows.column("keys").to_pylist()]
        counts = np.concatenate([*[unpack(p[0], np.uint16) for p in rows.column("parts").to_pylist()], np.zeros(0, np.uint16)]).astype(np.int64)
        unique, where = np.unique(np.concatenate([*keys, np.zeros(0, U64)]), return_inverse=True)
        shared = np.bincount(where, 1 + (counts & 1), minlength=len(unique)) > 1
        crowded = shared & (np.bincount(where, counts >> 1, minlength=len(unique)) > hot)
        flags = np.split((shared.astype(np.uint8) + crowded)[where], np.cumsum([len(k) for k in keys])[:-1])
        answers = [(b, n, b"", [pack(f.astype(np.uint8))]) for b, n, f in zip(rows.column("block").to_pylist(), rows.column("bucket").to_pylist(), flags, strict=True)]
        return pa.concat_tables([pa.Table.from_batches([as_batch(answers)]), own.cast(pa.Table.from_batches([as_batch([])]).schema)])

    def describe(table: pa.Table) -> pa.Table:
        job = make()
        own, rows = split(table)
        block, parts = own.column("block")[0].as_py(), own.column("parts")[0].as_py()
        hashes = mix(job.hashes(parts))
        flags = np.concatenate([unpack(p[0], np.uint8) for p in rows.sort_by("bucket").column("parts").to_pylist()])
        unique = np.unique(hashes)
        shared = flags[np.searchsorted(unique, hashes)] > 0 if len(hashes) else np.zeros(0, bool)
        keys, columns, state = job.surroundings(parts, shared)
        keys = mix(keys)
        crowded = flags[np.searchsorted(unique, keys)] > 1 if len(keys) else np.zeros(0, bool)
        order = np.argsort(keys, kind="stable")
        order = order[~crowded[order]]
        out = by_bucket(block, many, keys[order], [c[order] for c in columns])
        split_up, at = [b""] * 3, np.flatnonzero(crowded)
        if len(at):
            chosen = [c[at] for c in columns]
            row, offset, both = windows(keys[at], *job.sides(chosen))
            # In row order, so that the first of equal windows is the first in the block.
            by_row = np.argsort(row, kind="stable")
            row, offset, both = row[by_row], offset[by_row], both[by_row]
            group, first = distinct(both)
            dealt = by_bucket(block, many, both[first, 0], [both[first, 1], *job.gather(chosen, row, group, first)])
            out = [(b, n, k, [*p, k2, *p2]) for (b, n, k, p), (_, _, k2, p2) in zip(out, dealt, strict=True)]
            split_up = [pack(at[row]), pack(offset), pack(group)]
        sizes = np.array([len(keys)], np.int64).tobytes()
        return pa.Table.from_batches([as_batch([*out, (block, block % many, None, [sizes, pack(order.astype(np.int64)), *split_up, *state])])])

    def judge(table: pa.Table) -> pa.Table:
        job = make()
        own, rows = split(table)
        keys = [unpack(k, U64) for k in rows.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        parts = rows.column("parts").to_pylist()
        columns = [np.concatenate([unpack(p[i], kind) for p in parts]).reshape(sum(sizes), -1) if sum(sizes) else np.zeros((0, width), kind) for i, (kind, width) in enumerate(job.kinds)]
        blocks = np.repeat(np.array(rows.column("block").to_pylist(), np.int64), sizes)
        masks = job.judge(np.concatenate([*keys, np.zeros(0, U64)]), columns, blocks) if sum(sizes) else np.zeros(0, U64)
        k = len(job.kinds)  # after these columns: windows of hot anchors, if there are any
        dealt = [unpack(p[k], U64) if len(p) > k else np.zeros(0, U64) for p in parts]
        window_sizes = [len(d) for d in dealt]
        replies = np.zeros(sum(window_sizes), np.uint8)
        if len(replies):
            some = [p for p in parts if len(p) > k]
            check, *window_columns = (np.concatenate([unpack(p[k + 1 + i], kind) for p in some]) for i, kind in enumerate([U64, *job.window_kinds]))
            of = np.repeat(np.array(rows.column("block").to_pylist(), np.int64), window_sizes)
            replies = job.decide(np.column_stack([np.concatenate(dealt), check]), window_columns, of)
        answers = [
            (b, n, b"", [pack(m), pack(w)])
            for b, n, m, w in zip(rows.column("block").to_pylist(), rows.column("bucket").to_pylist(), np.split(masks, np.cumsum(sizes)[:-1]), np.split(replies, np.cumsum(window_sizes)[:-1]), strict=True)
        ]
        return pa.concat_tables([pa.Table.from_batches([as_batch(answers)]), own.cast(pa.Table.from_batches([as_batch([])]).schema)])

    def finish(table: pa.Table) -> pa.Table:
        job = make()
        own, rows = split(table)
        size, order, row, offset, group, *state = own.column("parts")[0].as_py()
        parts = rows.sort_by("bucket").column("parts").to_pylist()
        masks = np.zeros(int(np.frombuffer(size, np.int64)[0]), U64)
        masks[unpack(order, np.int64)] = np.concatenate([*[unpack(p[0], U64) for p in parts], np.zeros(0, U64)])
        row, offset, group = unpack(row, np.int64), unpack(offset, np.uint8), unpack(group, np.int64)
        if len(row):
            first = np.zeros(len(row), bool)
            first[np.unique(group, return_index=True)[1]] = True
            hit = job.repeats(np.concatenate([unpack(p[1], np.uint8) for p in parts]).astype(bool), group, first)
            np.bitwise_or.at(masks, row[hit], U64(1) << offset[hit].astype(U64))
        return job.finish(state, masks)

    sent = docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(emit, ROW)
    described = sent.groupBy("bucket").applyInArrow(mark, ROW).groupBy("block").applyInArrow(describe, ROW)
    return described.groupBy("bucket").applyInArrow(judge, ROW).groupBy("block").applyInArrow(finish, result)


def first_equal(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the first of each distinct combination, class of every row, class sizes); classes by first appearance."""
    whole = np.column_stack([c.reshape(len(columns[0]), -1).view(np.uint8).reshape(len(columns[0]), -1) for c in map(np.ascontiguousarray, columns)])
    whole = np.ascontiguousarray(whole).view(np.dtype((np.void, whole.shape[1]))).ravel()
    _, first, where, counts = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    rank = np.argsort(first, kind="stable")
    number = np.empty(len(rank), np.int64)
    number[rank] = np.arange(len(rank))
    return first[rank], number[where], counts[rank]


def ids_to_bytes(ids: list) -> list[bytes]:
    return [np.array([0 if i is None else i for i in ids], np.int64).tobytes(), np.array([i is None for i in ids], np.uint8).tobytes()]


def ids_from_bytes(values: bytes, nulls: bytes) -> pa.Array:
    return pa.array(np.frombuffer(values, np.int64), mask=np.frombuffer(nulls, np.uint8).astype(bool))


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a window of ``width`` from one of the starts."""
    count = np.zeros(size + 1, np.int32)
    count[np.unique(starts) + 1] = 1
    count = np.cumsum(count)
    upto = count[1:]
    before = np.concatenate([np.zeros(min(width, size), np.int32), count[1 : max(1, size - width + 1)]])
    return upto > before

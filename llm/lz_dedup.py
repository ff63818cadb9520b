"""Substring dedup: words in long passages that occur elsewhere, by factors against a reference occurrence.

This stands in for relative Lempel-Ziv parsing and departs from it: nothing is parsed greedily and no reference block is indexed.  An
anchor exchange (`_anchors`) brings occurrences together, and an exact grouping of windows settles what the first comparison leaves open.

A passage of 35 words holds an anchor: a run of 18 words whose hash is lowest among 18
neighbours.  Occurrences of an anchor meet in a bucket with the 17 words on each side.

* The first occurrence is the reference.  Every other one is factored against it: the
  longest common stretch to the left and to the right of the anchor is a factor, and if it
  has at least 35 words, all windows inside it are repeats, in both texts.
* At factor boundaries, windows that the reference does not explain are checked against every
  other reference of the anchor: two occurrences that agree in a window's words
  explain it for each other.

All occurrences of a repeated passage go, the first too.  Factors that overlap or touch add up.

Null text has no words.  Texts of fewer than 35 words are kept whole.  Repeated rows are
separate documents.  Other columns are ignored; an empty table gives an empty result.
Anchors are told apart by 64-bit hashes, the words around them by 32-bit hashes each.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from llm import _anchors
from llm._common import BLOCK_BYTES, NOT_WHITE, U64, hash_runs, hash_spans, local_minima, mix, pack, read, unpack, words
from llm.registry import query

LENGTH = 35
GRAM = 18
SIDE = LENGTH - GRAM


class ParseJob(_anchors.Job):
    result = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    window_kinds = [np.uint8]
    kinds = [(np.uint32, SIDE), (np.uint32, SIDE), (np.uint8, 3)]

    def anchors(self, block):
        starts, ends, before = words(block.data, block.offsets, NOT_WHITE)
        values = hash_spans(block.data, starts, ends)
        counts = np.diff(before)
        grams = hash_runs(values, GRAM)
        end = np.repeat(before[1:], counts)[: len(grams)]
        usable = (np.arange(len(grams)) + GRAM <= end) & np.repeat(counts >= LENGTH, counts)[: len(grams)]
        places = local_minima(grams, usable, SIDE + 1)
        text = zstandard.ZstdCompressor(level=1).compress(block.data.tobytes())
        doc = np.searchsorted(before, places, "right")
        around = block.data, starts[np.maximum(places - SIDE, before[doc - 1])], ends[np.minimum(places + LENGTH, before[doc]) - 1]
        return grams[places], around, [pack(places), np.asarray(block.offsets, np.int64).tobytes(), text, *_anchors.ids_to_bytes(block.ids)]

    def hashes(self, state):
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(state[2]), np.uint8) if len(state[2]) else np.zeros(0, np.uint8)
        starts, ends, self.before = words(self.data, np.frombuffer(state[1], np.int64), NOT_WHITE)
        self.values = hash_spans(self.data, starts, ends)
        self.places = unpack(state[0], np.int64)
        self.found = hash_runs(self.values, GRAM)[self.places]
        return self.found

    def surroundings(self, state, shared):
        _, offsets, text, ids, nulls = state
        hashes, places, offsets, data, before = self.found[shared], self.places[shared], np.frombuffer(offsets, np.int64), self.data, self.before
        values = (self.values >> U64(32)).astype(np.uint32)
        counts = np.diff(before)
        doc = np.searchsorted(before, places, "right") - 1
        pending = np.zeros(len(counts), bool)
        pending[doc] = True
        digests = [b"" if p else hashlib.sha256(b" ".join(data[a:b].tobytes().split())).digest() for p, a, b in zip(pending, offsets[:-1], offsets[1:], strict=True)]
        left = np.minimum(places - before[doc], SIDE)
        right = np.minimum(before[doc + 1] - places - GRAM, SIDE)
        wide = np.concatenate([np.zeros(SIDE, np.uint32), values, np.zeros(SIDE, np.uint32)])
        step, windows = np.arange(SIDE), np.lib.stride_tricks.sliding_window_view(wide, SIDE)
        lefts, rights = windows[places][:, ::-1].copy(), windows[places + SIDE + GRAM].copy()
        lefts[step >= left[:, None]] = 0
        rights[step >= right[:, None]] = 0
        room = np.column_stack([left, right]).astype(np.uint8)
        if len(places):
            first, where, sizes = _anchors.first_equal(hashes, lefts, rights, room)
        else:
            first, where, sizes = (np.zeros(0, np.int64),) * 3
        several = np.column_stack([room[first], (sizes > 1).astype(np.uint8)]).astype(np.uint8)
        lengths = np.where(pending, np.diff(offsets), 0)
        kept = data[np.repeat(pending, np.diff(offsets))]
        shift = np.concatenate([[0], np.cumsum(np.where(pending, counts, 0))])
        new = [
            pack(shift[doc] + places - before[doc]), pack(where), room.tobytes(), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64).tobytes(), counts.astype(np.int64).tobytes(),
            zstandard.ZstdCompressor(level=1).compress(kept.tobytes()), b"".join(digests), pending.tobytes(), ids, nulls,
        ]
        return hashes[first], [lefts[first], rights[first], several], new

    def judge(self, keys, columns, blocks):
        lefts, rights, about = columns
        n = len(keys)
        left, right, several = about[:, 0].astype(np.int64), about[:, 1].astype(np.int64), about[:, 2] > 0
        offset = np.arange(SIDE + 1)
        fits = (offset <= left[:, None]) & (SIDE - offset <= right[:, None])
        repeat = fits & several[:, None]
        order = np.argsort(keys, kind="stable")
        new = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])
        reference = np.empty(n, np.int64)
        reference[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]

        def common(side: np.ndarray, room: np.ndarray) -> np.ndarray:
            same = side == side[reference]
            length = np.where(same.all(axis=1), SIDE, same.argmin(axis=1))
            return np.minimum(length, np.minimum(room, room[reference]))

        other = np.flatnonzero(reference != np.arange(n))
        long_left, long_right = common(lefts, left)[other, None], common(rights, right)[other, None]
        factor = (offset <= long_left) & (SIDE - offset <= long_right)
        repeat[other] |= factor
        np.logical_or.at(repeat, reference[other], factor)
        # Boundaries: classes in which some window is not explained yet.
        open_class = np.zeros(n, bool)
        open_class[reference[(fits & ~repeat).any(axis=1)]] = True
        rows = np.flatnonzero(open_class[reference])
        if len(rows):
            to_left, to_right = _anchors.running(keys[rows], lefts[rows]), _anchors.running(keys[rows], rights[rows])
            for j in range(SIDE + 1):
                whole = np.flatnonzero(fits[rows, j])
                window = mix(to_left[j, whole] * U64(0x9E3779B97F4A7C15) + to_right[SIDE - j, whole])
                _, where, counts = np.unique(window, return_inverse=True, return_counts=True)
                repeat[rows[whole[counts[where] > 1]], j] = True
        return (repeat.astype(U64) << offset.astype(U64)).sum(axis=1, dtype=U64)

    def gather(self, columns, rows, group, first):
        return [np.minimum(np.bincount(group, 1 + columns[2][rows, 2]), 2).astype(np.uint8)]

    def decide(self, keys, columns, blocks):
        where, _ = _anchors.distinct(keys)
        return (np.bincount(where, columns[0]) > 1)[where].astype(np.uint8)

    def repeats(self, answers, group, first):
        return answers[group]

    def finish(self, state, masks):
        places, where, room, offsets, counts, text, digests, pending, ids, nulls = state
        places, where, room = unpack(places, np.int64), unpack(where, np.int64), np.frombuffer(room, np.uint8).reshape(-1, 2)
        offsets, counts, pending = np.frombuffer(offsets, np.int64), np.frombuffer(counts, np.int64), np.frombuffer(pending, bool)
        data = zstandard.ZstdDecompressor().decompress(text) if offsets[-1] else b""
        mask = masks[where] if len(where) else np.zeros(0, U64)
        starts = [places[((mask >> U64(j)) & U64(1)).astype(bool) & (room[:, 0] >= j) & (room[:, 1] >= SIDE - j)] - j for j in range(SIDE + 1)]
        first = np.concatenate([[0], np.cumsum(np.where(pending, counts, 0))])
        gone = _anchors.covered(np.concatenate(starts), LENGTH, int(first[-1]))
        shas, removed, at = [], [], 0
        for i in range(len(counts)):
            if pending[i]:
                drop = gone[first[i] : first[i + 1]]
                removed.append(int(drop.sum()))
                parts = data[offsets[i] : offsets[i + 1]].split()
                shas.append(hashlib.sha256(b" ".join(compress(parts, (~drop).tolist()))).hexdigest())
            else:
                removed.append(0)
                shas.append(digests[at : at + 32].hex())
                at += 32
        return pa.table({"doc_id": _anchors.ids_from_bytes(ids, nulls), "n_words": counts, "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = _anchors.HOT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    return _anchors.run(docs, ParseJob, id_col, text_col, BLOCK_BYTES, hot)


@query("op9_lz_dedup")
def op9_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))

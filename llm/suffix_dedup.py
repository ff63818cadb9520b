"""Suffix-array dedup: bytes covered by long strings that start earlier in the corpus.

This departs from the plain difference-cover algorithm: no suffixes of the corpus are ordered as a whole.  An anchor exchange
(`_anchors`) brings equal surroundings together, and sorting and naming happen inside a hash bucket, over 50 bytes on each side.

Suffixes are sampled by a *difference cover chosen by content*: positions whose
50-byte string hashes lowest among 51 neighbours.  Like a fixed cover it has, for any two
equal strings of 100 bytes, a common shift at which both are sampled; unlike one it
samples about one position in 26, and lets suffixes whose start is unique drop out.

* Sampled suffixes meet in hash buckets of their first 50 bytes.  The next bytes are cut into
  words; triples of words are sorted and replaced by their rank (name), then triples
  of names, until one name is left: their order.  Comparing neighbours in that order gives
  common prefix lengths.  The bytes before the sample are treated alike.
* The remaining suffixes (up to 50 bytes before a sample) are merged in through their sample:
  such a suffix is its bytes up to the sample and the sample's name at the depth
  that is left.  Equal pairs are equal 100-byte strings; all but the first in
  document order are repeats.

Order of documents is by id, null first, then as stored.  Null text counts as empty.
Texts under 100 bytes are kept whole.  Matches never cross documents.  Repeated rows are
separate documents.  Other columns are ignored; an empty table gives an empty result.
Sampled 50-byte strings are told apart by 64-bit hashes, all else by bytes; but 100-byte strings
around a sample that stands in very many surroundings (`_anchors.HOT`) by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from llm import _anchors
from llm._common import SEGMENT, U64, Block, hash_spans, local_minima, pack, read, unpack
from llm.registry import query

LENGTH = 100
GRAM = 50
SIDE = LENGTH - GRAM
BLOCK = 4 << 20


def by_id(block: Block) -> Block:
    """The block with documents in ascending id, null first."""
    keys = [(i is not None, i or 0) for i in block.ids]
    order = sorted(range(len(block)), key=keys.__getitem__)
    if order == list(range(len(block))):
        return block
    lengths = np.diff(block.offsets)[order]
    data = np.concatenate([block.data[block.offsets[i] : block.offsets[i + 1]] for i in order])
    return Block([block.ids[i] for i in order], np.concatenate([[0], np.cumsum(lengths)]), data)


def sampled(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the cover and the hashes of the strings there."""
    places, hashes = [], []
    n = len(block.data) - GRAM + 1
    offsets, step = block.offsets, SEGMENT // 2
    for start in range(0, max(n, 0), step):
        # Overlap on both sides, so that every window is seen whole in one piece.
        a, b = max(0, start - SIDE), min(n, start + step + SIDE)
        at = np.arange(a, b)
        doc = np.searchsorted(offsets, at, "right")
        usable = (at + GRAM <= offsets[doc]) & (offsets[doc] - offsets[doc - 1] >= LENGTH)
        value = hash_spans(block.data, at, at + GRAM)
        found = local_minima(value, usable, SIDE + 1)
        keep = (found + a >= start) & (found + a < start + step)
        places.append(found[keep] + a)
        hashes.append(value[found[keep]])
    return np.concatenate([*places, np.zeros(0, np.int64)]), np.concatenate([*hashes, np.zeros(0, U64)])


def names(columns: list[np.ndarray]) -> np.ndarray:
    """Rank of every row among rows compared column by column: sort triples, name them, recurse on the names."""
    while len(columns) > 1:
        columns = [name_triples(columns[i : i + 3]) for i in range(0, len(columns), 3)]
    return columns[0]


def name_triples(columns: list[np.ndarray]) -> np.ndarray:
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for column in columns:
        new[1:] |= column[order[1:]] != column[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def prefix_classes(keys: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Entry [m, i]: class of row i by key and the first m bytes of its context, m = 0 .. SIDE."""
    padded = np.zeros((len(keys), -(-SIDE // 8) * 8), np.uint8)
    padded[:, :SIDE] = context
    words = padded.view(">u8")
    order = np.argsort(names([keys, *[words[:, i].astype(U64) for i in range(words.shape[1])]]), kind="stable")
    same = context[order[1:]] == context[order[:-1]]
    common = np.where(same.all(axis=1), SIDE, same.argmin(axis=1))
    common[keys[order[1:]] != keys[order[:-1]]] = -1
    out = np.empty((SIDE + 1, len(keys)), np.int64)
    for m in range(SIDE + 1):
        out[m, order] = np.concatenate([[0], np.cumsum(common < m)])
    return out


class SuffixJob(_anchors.Job):
    result = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    window_kinds = [np.int64, np.int64]
    kinds = [(np.uint8, SIDE), (np.uint8, SIDE), (np.uint8, 2), (np.int64, 1), (np.int64, 1)]

    def anchors(self, block):
        block = by_id(block)
        places, hashes = sampled(block)
        text = zstandard.ZstdCompressor(level=6).compress(block.data.tobytes())
        doc = np.searchsorted(block.offsets, places, "right")
        around = block.data, np.maximum(places - SIDE, block.offsets[doc - 1]), np.minimum(places + LENGTH, block.offsets[doc])
        return hashes, around, [pack(places), np.asarray(block.offsets, np.int64).tobytes(), text, *_anchors.ids_to_bytes(block.ids)]

    def hashes(self, state):
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(state[2]), np.uint8) if len(state[2]) else np.zeros(0, np.uint8)
        self.places = unpack(state[0], np.int64)
        self.found = hash_spans(self.data, self.places, self.places + GRAM)
        return self.found

    def surroundings(self, state, shared):
        _, offsets, text, ids, nulls = state
        hashes, places, offsets, data = self.found[shared], self.places[shared], np.frombuffer(offsets, np.int64), self.data
        doc = np.searchsorted(offsets, places, "right") - 1
        pending = np.zeros(len(offsets) - 1, bool)
        pending[doc] = True
        digests = [b"" if p else hashlib.sha256(data[a:b].tobytes()).digest() for p, a, b in zip(pending, offsets[:-1], offsets[1:], strict=True)]
        left = np.minimum(places - offsets[doc], SIDE)
        right = np.minimum(offsets[doc + 1] - places - GRAM, SIDE)
        wide = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(SIDE, np.uint8)])
        step, windows = np.arange(SIDE), np.lib.stride_tricks.sliding_window_view(wide, SIDE)
        before, after = windows[places][:, ::-1].copy(), windows[places + SIDE + GRAM].copy()
        before[step >= left[:, None]] = 0
        after[step >= right[:, None]] = 0
        room = np.column_stack([left, right]).astype(np.uint8)
        if len(places):
            first, where, _ = _anchors.first_equal(hashes, before, after, room)
        else:
            first, where = np.zeros(0, np.int64), np.zeros(0, np.int64)
        again = np.ones(len(places), np.uint8)
        again[first] = 0
        doc_id = np.where(np.frombuffer(nulls, np.uint8), np.iinfo(np.int64).min, np.frombuffer(ids, np.int64))[doc]
        columns = [before[first], after[first], room[first], doc_id[first], places[first]]
        # Only documents with shared samples go on.
        lengths = np.where(pending, np.diff(offsets), 0)
        moved = np.concatenate([[0], np.cumsum(lengths)])
        kept = data[np.repeat(pending, np.diff(offsets))]
        new = [
            pack(moved[doc] + places - offsets[doc]), pack(where), pack(again), room.tobytes(), moved.astype(np.int64).tobytes(), np.asarray(offsets, np.int64).tobytes(),
            zstandard.ZstdCompressor(level=6).compress(kept.tobytes()), b"".join(digests), pending.tobytes(), ids, nulls,
        ]
        return hashes[first], columns, new

    def judge(self, keys, columns, blocks):
        before, after, room, doc_id, place = columns
        order = np.lexsort((place.ravel(), blocks, doc_id.ravel()))  # document order
        keys, before, after, left, right = keys[order], before[order], after[order], room[order, 0], room[order, 1]
        lefts, rights = prefix_classes(keys, before), prefix_classes(keys, after)
        masks = np.zeros(len(keys), U64)
        for d in range(SIDE + 1):
            whole = np.flatnonzero((left >= d) & (right >= SIDE - d))
            pair = lefts[d, whole] * len(keys) + rights[SIDE - d, whole]
            _, first = np.unique(pair, return_index=True)
            repeat = np.ones(len(whole), bool)
            repeat[first] = False
            masks[whole[repeat]] |= U64(1 << d)
        out = np.empty_like(masks)
        out[order] = masks
        return out

    def gather(self, columns, rows, group, first):
        return [columns[3][rows[first]], columns[4][rows[first]]]

    def decide(self, keys, columns, blocks):
        doc_id, place = columns
        order = np.lexsort((place, blocks, doc_id))  # document order
        _, first = _anchors.distinct(keys[order])
        out = np.zeros(len(keys), np.uint8)
        out[order[first]] = 1
        return out

    def repeats(self, answers, group, first):
        return ~(first & answers[group])

    def finish(self, state, masks):
        places, where, again, room, offsets, whole_offsets, text, digests, pending, ids, nulls = state
        places, where, again = unpack(places, np.int64), unpack(where, np.int64), unpack(again, np.uint8).astype(bool)
        room = np.frombuffer(room, np.uint8).reshape(-1, 2)
        offsets, sizes = np.frombuffer(offsets, np.int64), np.diff(np.frombuffer(whole_offsets, np.int64))
        pending = np.frombuffer(pending, bool)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
        mask = masks[where] if len(where) else np.zeros(0, U64)
        starts = []
        for d in range(SIDE + 1):
            fits = (room[:, 0] >= d) & (room[:, 1] >= SIDE - d)
            hit = fits & (again | ((mask >> U64(d)) & U64(1)).astype(bool))
            starts.append(places[hit] - d)
        gone = _anchors.covered(np.concatenate(starts), LENGTH, len(data))
        removed = np.concatenate([[0], np.cumsum(gone)])
        rises = gone.copy()
        rises[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        rises[inner] = gone[inner]
        spans = np.concatenate([[0], np.cumsum(rises)])
        shas, at = [], 0
        for i in range(len(sizes)):
            if pending[i]:
                a, b = offsets[i], offsets[i + 1]
                shas.append(hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest())
            else:
                shas.append(digests[at : at + 32].hex())
                at += 32
        return pa.table(
            {"doc_id": _anchors.ids_from_bytes(ids, nulls), "n_bytes": sizes, "n_removed": np.diff(removed[offsets]), "n_spans": np.diff(spans[offsets]), "kept_sha256": pa.array(shas, pa.string())}
        )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = _anchors.HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    return _anchors.run(docs, SuffixJob, id_col, text_col, BLOCK, hot)


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))

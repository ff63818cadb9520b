"""Language-model scoring with a weighted backoff automaton learned from the corpus.

States are n-grams seen in training, arcs carry log10 probabilities, and a state's failure
arc leads to its next shorter suffix with a backoff weight.  A text is read once from
left to right: where the current state has no arc for the next token, failure arcs
are followed, adding their weights; the root has an arc for every token.

Weights: the root is the additively smoothed unigram model; an arc of a longer
state h is (c(h, w) + m * p(w | shorter)) / (c(h) + m), its failure weight
m / (c(h) + m), where m is the corpus mean of distinct continuations per state.

Counts come from all training documents and the model is never gathered anywhere:
every block of documents sends its distinct n-grams to hash buckets (one packed row per
bucket), a bucket adds up the training counts of all blocks, and every block gets back the
counts of exactly its own n-grams, from which it builds the part of the automaton
that its documents can visit.

N-grams are told apart by 64-bit hashes.  Null text counts as empty: one token,
the end.  A null id counts as an empty string where documents are held out.  Repeated
rows train and are scored as often as they occur.  Without training rows all counts are
zero.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm._common import NOT_WHITE, U64, buckets, cuts, hash_spans, lower, mix, new_block_id, pack, read, text_blocks, unpack, words
from llm.registry import query

START, END = U64(0x51A27), U64(0xE2D11)
ROW = "block bigint, bucket int, keys array<binary>, counts array<binary>, totals array<bigint>, docs binary, tokens binary, vocabulary binary"
COLUMNS = ["block", "bucket", "keys", "counts", "totals", "docs", "tokens", "vocabulary"]
KINDS = [pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]


def as_table(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in KINDS]
    return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, KINDS, strict=True)], COLUMNS)


def ngram_keys(tokens: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For orders 1 .. ``order``: (positions where such an n-gram ends, its key).  ``first``: start of each token's document."""
    out, key = [], mix(tokens)
    places = np.arange(len(tokens))
    out.append((places, key))
    for n in range(2, order + 1):
        longer = np.zeros_like(key)
        longer[1:] = mix(key[:-1] * U64(0xD6E8FEB86659FD93) + tokens[1:] + U64(n))
        key = longer
        at = np.flatnonzero(places - first >= n - 1)
        out.append((at, key[at]))
    return out


def score_texts(docs: DataFrame, order: int = 2, held_out_every: int = 10, id_col: str = "doc_id", text_col: str = "text", base: float = 0.1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    many = buckets(docs.sparkSession)
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % held_out_every == 0
    rows = docs.select(F.struct(F.col(id_col).cast("bigint").alias("id"), held.alias("held")).alias("key"), F.col(text_col).alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = new_block_id()
        for part in text_blocks(batches):
            data = lower(part.data)
            starts, ends, before = words(data, part.offsets, NOT_WHITE)
            hashes = hash_spans(data, starts, ends)
            lengths = np.diff(before) + 2  # start and end marks
            after = np.cumsum(lengths)
            tokens = np.empty(int(after[-1]), U64)
            tokens[np.arange(len(hashes)) + 1 + 2 * np.repeat(np.arange(len(part)), np.diff(before))] = hashes
            tokens[after - lengths], tokens[after - 1] = START, END
            first = np.repeat(after - lengths, lengths)
            train = ~np.array([key["held"] for key in part.ids])
            taught = np.repeat(train, lengths)
            keys, counts = [], []
            for at, key in ngram_keys(tokens, first, order):
                unique, where = np.unique(key, return_inverse=True)
                count = np.bincount(where[taught[at]], minlength=len(unique))
                bounds = cuts(unique, many)
                keys.append((unique, bounds))
                counts.append(count)
            for b in range(many):
                row_keys = [pack(u[x[b] : x[b + 1]]) for u, x in keys]
                row_counts = [pack(n[x[b] : x[b + 1]]) for n, (_, x) in zip(counts, keys, strict=True)]
                yield as_table([(block, b, row_keys, row_counts, None, None, None, None)])
            vocabulary, index, often = np.unique(tokens, return_inverse=True, return_counts=True)
            common_first = np.argsort(-often, kind="stable")
            number = np.empty(len(vocabulary), np.uint32)
            number[common_first] = np.arange(len(vocabulary), dtype=np.uint32)
            ids = np.array([-1 if key["id"] is None else key["id"] for key in part.ids], np.int64)
            null = np.array([key["id"] is None for key in part.ids], np.int64)
            about = np.stack([ids, null, train.astype(np.int64), lengths]).tobytes()
            # This row travels with one of the buckets and is handed on unchanged.
            yield as_table([(block, block % many, None, None, None, about, pack(number[index]), vocabulary[common_first].tobytes())])
            block += 1

    def add_up(table: pa.Table) -> pa.Table:
        whole = table.column("docs").is_valid()
        travelling, rows = table.filter(whole), table.filter(pc.invert(whole)).select(["block", "keys", "counts"]).to_pylist()
        answers: list[list[bytes]] = [[] for _ in rows]
        totals = []
        for n in range(order):
            keys = [unpack(r["keys"][n], U64) for r in rows]
            counts = np.concatenate([unpack(r["counts"][n], np.int64) for r in rows])
            unique, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(unique), np.int64)
            np.add.at(total, where, counts)
            real = unique != mix(np.array([START]))[0] if n == 0 else slice(None)
            totals += [int(total[real].sum()), int((total[real] > 0).sum())]
            every = total[where]
            for i, values in enumerate(np.split(every, np.cumsum([len(k) for k in keys])[:-1])):
                answers[i].append(pack(values))
        bucket = table.column("bucket")[0].as_py()
        answered = as_table([(r["block"], bucket, None, a, totals, None, None, None) for r, a in zip(rows, answers, strict=True)])
        return pa.concat_tables([pa.Table.from_batches([answered]), travelling.cast(answered.schema)])

    result = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def traverse(table: pa.Table) -> pa.Table:
        whole = table.column("docs").is_valid()
        own, answers = table.filter(whole).select(["docs", "tokens", "vocabulary"]).to_pylist()[0], table.filter(pc.invert(whole)).sort_by("bucket")
        ids, null, train, lengths = np.frombuffer(own["docs"], np.int64).reshape(4, -1)
        tokens = np.frombuffer(own["vocabulary"], U64)[unpack(own["tokens"], np.uint32)]
        totals = np.array(answers.column("totals").to_pylist()).sum(axis=0)
        parts = answers.column("counts").to_pylist()
        after = np.cumsum(lengths)
        begin = after - lengths
        levels = ngram_keys(tokens, np.repeat(begin, lengths), order)
        # Per order: the state of every position (-1: none), counts, arc and failure weights of every state.
        state, count, arc, fail = [], [], [], []
        n_train, n_types = totals[0], totals[1]
        for n, (at, key) in enumerate(levels):
            unique, first_at, where = np.unique(key, return_index=True, return_inverse=True)
            c = np.concatenate([unpack(p[n], np.int64) for p in parts])
            place = np.full(len(tokens), -1, np.int64)
            place[at] = where
            rep = at[first_at]
            if n == 0:
                weight = np.log10((c + base) / (n_train + base * (n_types + 1)))
            else:
                m = max(totals[2 * n + 1] / max(totals[2 * n - 1], 1), 1e-3)
                history = count[-1][state[-1][rep - 1]]
                shorter = 10.0 ** arc[-1][state[-1][rep]]
                weight = np.log10(np.where(c > 0, (c + m * shorter) / (history + m), 1.0))
                fail.append(np.log10(m / (count[-1] + m)))
            state.append(place)
            count.append(c)
            arc.append(weight)
        score, base_score, known = np.zeros(len(lengths)), np.zeros(len(lengths)), np.zeros(len(lengths), np.int64)
        by_length = np.argsort(-lengths, kind="stable")
        ordered = lengths[by_length]
        depth = np.where(count[0][state[0][begin]] > 0, min(1, order - 1), 0)  # tokens of history the current state holds
        for step in range(1, int(ordered[0]) if len(ordered) else 0):
            live = by_length[: np.searchsorted(-ordered, -step, "left")]
            at = begin[live] + step
            level, todo, add = depth[live], np.ones(len(live), bool), np.zeros(len(live))
            for n in range(order - 1, 0, -1):
                here = np.flatnonzero(todo & (level == n))
                if not len(here):
                    continue
                s = state[n][at[here]]
                arcs = count[n][s] > 0
                hit, miss = here[arcs], here[~arcs]
                add[hit] += arc[n][s[arcs]]
                todo[hit] = False
                level[hit] = min(n + 1, order - 1)
                add[miss] += fail[n - 1][state[n - 1][at[miss] - 1]]
                level[miss] = n - 1
            s = state[0][at]
            seen = count[0][s] > 0
            add[todo] += arc[0][s[todo]]
            level[todo] = np.where(seen[todo], min(1, order - 1), 0)
            depth[live] = level
            score[live] += add
            base_score[live] += arc[0][s]
            known[live] += seen
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=null.astype(bool)), "held_out": train == 0, "n_tokens": lengths - 1, "n_known": known,
                "train_tokens": np.full(len(ids), n_train), "base_score": base_score, "score": score,
            }
        )

    answered = rows.mapInArrow(emit, ROW).groupBy("bucket").applyInArrow(add_up, ROW)
    return answered.groupBy("block").applyInArrow(traverse, result)


@query("op7_lm_scoring")
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))

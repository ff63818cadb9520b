"""Toxicity by a classifier chain over hashed word and word-prefix features.

Categories are predicted one after the other; the model of a category also gets the
probabilities of all earlier ones.  In training those are out-of-fold predictions,
so that a later model does not trust an earlier one more than it deserves.

1. *Feature choice.*  Features are words and word prefixes standing at least so many times in a text.
   Chosen are, per category, all that tell its classes apart by a z-score of at least ``Z_FLOOR`` in the labelled
   sample (aggregated in Spark) and the best ``AT_LEAST`` in any case, the best ``PER_CATEGORY`` if there are more; for out-of-fold predictions the fold takes no part in the choice.
2. *Fit.*  L2-regularised logistic models on presence of chosen features, on a
   sample of at most ``max_labelled`` labelled documents (smallest id hashes), which is
   the bound of everything that reaches the driver.
3. *Prediction.*  One pass over all whole texts; nothing is shuffled.

A text counts as toxic when the last category's probability reaches the
threshold that maximises F1 on out-of-fold predictions, among those that catch at least ``LEAST_CAUGHT`` labelled
texts and are right about ``LEAST_PRECISION`` of what they catch.  With few labels there may be none; then the threshold is 0.5.

Texts without any feature chosen for the last category, among them null, empty and wordless ones, get the models'
base probabilities and are never toxic.  Repeated rows are judged alike.  Labels that are null do not train their
category; without a labelled row of both classes the category's probability is its share
(0 where there are none), and if that is the last category, no text is toxic.  Columns named like the added ones are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm._common import ALNUM, U64, Block, hash_spans, lower, mix, read, store, text_blocks, words
from llm.registry import query

PREFIXES = (4, 5, 6, 7)
#: Least z-score of a chosen feature, and the most features of a category (a bound of the driver's memory).
Z_FLOOR = 3.0  # a word in three texts, all of the class, has it where the class is at most a quarter
PER_CATEGORY = 20_000
#: The best so many are chosen whatever their z-score, since small samples reach no high one.
AT_LEAST = 150
FOLDS = 4
#: Text that a task looks at at a time.
BLOCK_BYTES = 4 << 20
#: What a threshold must do on out-of-fold predictions.
LEAST_CAUGHT, LEAST_PRECISION = 10, 0.5
#: Threshold that no probability reaches.
NEVER = 2.0


def block_features(block: Block, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document number, feature) pairs, sorted.

    A feature is a hashed word or prefix that stands at least 1, 2, 3 or 4 times in the document; the
    low two bits tell how often.  With ``chosen`` (sorted) only those, by their number in it.
    """
    data = lower(block.data)
    starts, ends, before = words(data, block.offsets, ALNUM)
    owner = np.repeat(np.arange(len(block)), np.diff(before))
    if chosen is not None:
        wanted = np.unique(chosen & ~U64(3))
        sieve = np.zeros(1 << 16, bool)
        sieve[((wanted >> U64(2)) & U64(0xFFFF)).astype(np.int64)] = True
    docs, features = [], []
    for length in (0, *PREFIXES):
        use = slice(None) if not length else ends - starts > length
        a, b = starts[use], ends[use]
        hashes = hash_spans(data, a, a + length if length else b)
        hashes = mix(hashes + U64(length)) & ~U64(3)
        doc = owner[use]
        if chosen is not None:
            hit = sieve[((hashes >> U64(2)) & U64(0xFFFF)).astype(np.int64)]
            hashes, doc = hashes[hit], doc[hit]
            hit = np.isin(hashes, wanted)
            hashes, doc = hashes[hit], doc[hit]
        docs.append(doc)
        features.append(hashes)
    doc, feature = np.concatenate(docs), np.concatenate(features)
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    firsts = np.flatnonzero(new)
    levels = np.minimum(np.diff(np.append(firsts, len(doc))), 4)
    doc, feature = np.repeat(doc[firsts], levels), np.repeat(feature[firsts], levels)
    feature = feature + (np.arange(len(doc)) - np.repeat(np.cumsum(levels) - levels, levels)).astype(U64)
    if chosen is not None:
        place = np.searchsorted(chosen, feature)
        place[place == len(chosen)] = 0
        hit = chosen[place] == feature if len(chosen) else np.zeros(len(feature), bool)
        doc, feature = doc[hit], place[hit].astype(U64)
    return doc, feature


def choose_features(sample: DataFrame, categories: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sorted features, for every fold (then for none) which of them are chosen without looking at it, and which for the last category.

    A category's features are those whose presence differs between its classes by a z-score of at least ``Z_FLOOR``.
    """
    size = len(categories)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(2).to_numpy().astype(np.int64)  # fold, then per category: no, yes, unknown
            for i in range(size):
                label = batch.column(3 + i).to_numpy(zero_copy_only=False).astype(float)
                cell = cell * 3 + np.where(np.isnan(label), 2, label > 0.5).astype(np.int64)
            done, cells = 0, FOLDS * 3**size
            for block in text_blocks(iter([batch]), BLOCK_BYTES):
                doc, feature = block_features(block)
                values, where = np.unique(feature, return_inverse=True)
                both, n = np.unique(where * cells + cell[done : done + len(block)][doc], return_counts=True)
                done += len(block)
                yield pa.RecordBatch.from_arrays([pa.array(values[both // cells].view(np.int64)), pa.array(both % cells), pa.array(n)], ["feature", "cell", "n"])

    counted = sample.select("doc_id", "text", "fold", *categories).mapInArrow(count, "feature bigint, cell bigint, n bigint")
    fold = F.floor(F.col("cell") / 3**size)
    code = [F.floor(F.col("cell") / 3 ** (size - 1 - i)) % 3 for i in range(size)]
    cells = [(i, k) for i in range(size) for k in range(FOLDS)]
    part = lambda k, test: F.sum(F.when((fold == k) & test, F.col("n")).otherwise(0))
    sums = counted.groupBy("feature").agg(*[part(k, code[i] == 1).alias(f"pos{i}_{k}") for i, k in cells], *[part(k, code[i] < 2).alias(f"all{i}_{k}") for i, k in cells])
    enough = [sum(F.col(f"all{i}_{k}") for k in range(FOLDS)) >= 3 for i in range(size)]  # of texts labelled in a category
    sums = store(sums.filter(functools.reduce(Column.__or__, enough)), "toxicity-features")
    totals = {(r.fold, i): (r[f"p{i}"] or 0, r[f"n{i}"]) for r in sample.groupBy("fold").agg(*[x for i, c in enumerate(categories) for x in (F.sum(c).alias(f"p{i}"), F.count(c).alias(f"n{i}"))]).collect() for i in range(size)}
    picked: list[set[int]] = []
    for left_out in (*range(FOLDS), None):
        picked.append(set())
        last: set[int] = set()
        for i in range(size):
            folds = [k for k in range(FOLDS) if k != left_out]
            p, n = (sum(totals.get((k, i), (0, 0))[j] for k in folds) for j in (0, 1))
            if not 0 < p < n:
                continue
            positive, every = (sum(F.col(f"{kind}{i}_{k}") for k in folds) for kind in ("pos", "all"))
            mean = every / F.lit(float(n))
            difference = positive / F.lit(float(p)) - (every - positive) / F.lit(float(n - p))
            z = F.abs(difference) / F.sqrt(mean * (1 - mean) * (1.0 / p + 1.0 / (n - p)) + 1e-9)
            best = sums.filter(every >= 3).orderBy(F.desc(z), "feature").limit(PER_CATEGORY).select("feature", z.alias("z")).collect()
            good = {r.feature for place, r in enumerate(best) if place < AT_LEAST or r.z >= Z_FLOOR}
            picked[-1] |= good
            last = good if i == size - 1 else last
    chosen = np.sort(np.array(sorted(set().union(*picked)), np.int64).view(U64))
    *masks, of_last = [np.isin(chosen, np.array(sorted(x), np.int64).view(U64)) for x in (*picked, last)]
    return chosen, masks, of_last


class Linear:
    """Logistic model on present features and dense inputs."""

    def __init__(self, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.weights, self.dense, self.bias = weights, dense, bias

    def predict(self, doc: np.ndarray, feature: np.ndarray, rows: int, dense: np.ndarray) -> np.ndarray:
        margin = np.bincount(doc, self.weights[feature], minlength=rows) + self.bias + dense @ self.dense
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    @classmethod
    def fit(cls, doc: np.ndarray, feature: np.ndarray, dense: np.ndarray, y: np.ndarray, size: int, l2: float = 0.5, steps: int = 250) -> Linear:
        share = y.mean() if len(y) else 0.0
        model = cls(np.zeros(size), np.zeros(dense.shape[1]), 0.0)
        if not 0 < share < 1:
            model.bias = 30.0 if share else -30.0
            return model
        model.bias = float(np.log(share / (1 - share)))
        squares = [np.full(size, 1e-8), np.full(dense.shape[1], 1e-8), 1e-8]
        for _ in range(steps):  # Adagrad on the whole sample
            wrong = model.predict(doc, feature, len(y), dense) - y
            steps_ = [np.bincount(feature, wrong[doc], minlength=size) + l2 * model.weights, dense.T @ wrong + l2 * model.dense, wrong.sum()]
            for i, g in enumerate(steps_):
                squares[i] = squares[i] + g * g
            model.weights -= 0.3 * steps_[0] / np.sqrt(squares[0])
            model.dense -= 0.3 * steps_[1] / np.sqrt(squares[1])
            model.bias -= 0.3 * steps_[2] / np.sqrt(squares[2])
        return model


class Chain:
    """Linear models in sequence over chosen features."""

    def __init__(self, categories: list[str], chosen: np.ndarray, of_last: np.ndarray, models: list[Linear], threshold: float):
        self.categories, self.chosen, self.of_last, self.models, self.threshold = categories, chosen, of_last, models, threshold

    def predict(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, and which documents show any feature chosen for the last category."""
        doc, feature = block_features(block, self.chosen)
        dense = np.zeros((len(block), 0))
        for model in self.models:
            p = model.predict(doc, feature.astype(np.int64), len(block), dense)
            dense = np.column_stack([dense, p])
        return dense, np.bincount(doc[self.of_last[feature.astype(np.int64)]], minlength=len(block)) > 0


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap that maximises F1 of ``p >= threshold``; 0.5 where none catches enough with enough precision."""
    order = np.argsort(-p, kind="stable")
    p, hit, many = p[order], np.cumsum(y[order]), np.arange(1, len(p) + 1)
    last = np.append(p[1:] != p[:-1], True)
    fair = last & (hit >= LEAST_CAUGHT) & (hit >= LEAST_PRECISION * many)
    if not fair.any():
        return 0.5
    i = int(np.argmax(np.where(fair, 2 * hit / (many + hit[-1]), -1)))
    return float((p[i] + (p[i + 1] if i + 1 < len(p) else 0.0)) / 2)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_labelled: int = 6_000) -> Chain:
    """Fit on at most ``max_labelled`` labelled rows.  ``categories``: name to a 0/1 expression over ``labels``, in order."""
    names = list(categories)
    known = labels.filter(F.col("doc_id").isNotNull()).select("doc_id", *[c.cast("double").alias(n) for n, c in categories.items()])
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(max_labelled)
    picked = picked.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int"))
    sample = store(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "toxicity-sample")  # at most max_labelled short rows
    chosen, picks, of_last = choose_features(sample, names)

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for block in text_blocks(iter([batch]), BLOCK_BYTES):
                doc, feature = block_features(block, chosen)
                cut = np.searchsorted(doc, np.arange(len(block) + 1))
                rows = pa.array([feature[a:b].astype(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64()))
                part = batch.slice(done, len(block))
                yield pa.RecordBatch.from_arrays([part.column(0), rows, *part.columns[2:]], ["doc_id", "features", "fold", *names])
                done += len(block)

    rows = sample.select("doc_id", "text", "fold", *names).mapInArrow(compact, "doc_id bigint, features array<bigint>, fold int, " + ", ".join(f"`{n}` double" for n in names)).toArrow()
    order = np.argsort(np.array(rows.column("doc_id").to_pylist(), np.int64), kind="stable")
    features = [np.array(x, np.int64) for x in rows.column("features").to_pylist()]
    features = [features[i] for i in order]
    fold = np.array(rows.column("fold").to_pylist(), np.int64)[order]
    dense, models, threshold = np.zeros((len(order), 0)), [], NEVER

    def pairs(which: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chosen_rows = [features[i][pick[features[i]]] for i in which]
        return np.repeat(np.arange(len(which)), [len(x) for x in chosen_rows]), np.concatenate([*chosen_rows, np.zeros(0, np.int64)])

    for name in names:
        y = rows.column(name).to_numpy()[order]
        usable = ~np.isnan(y)
        p = np.zeros(len(y))
        for k in range(FOLDS):
            train, out = np.flatnonzero(usable & (fold != k)), np.flatnonzero(fold == k)
            p[out] = Linear.fit(*pairs(train, picks[k]), dense[train], y[train], len(chosen)).predict(*pairs(out, picks[k]), len(out), dense[out])
        train = np.flatnonzero(usable)
        models.append(Linear.fit(*pairs(train, picks[-1]), dense[train], y[train], len(chosen)))
        threshold = best_threshold(p[train], y[train]) if 0 < y[train].sum() < len(train) else NEVER
        dense = np.column_stack([dense, p])
    return Chain(names, chosen, of_last, models, threshold)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """All columns of ``docs`` with ``p_<category>`` and ``toxic``."""
    names = [f"p_{c}" for c in chain.categories]
    plain = docs.drop(*names, "toxic", "_text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    kept = plain.columns
    position = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        for batch in batches:
            done = 0
            text = batch.column(position)
            for block in text_blocks(iter([pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), text], ["row", "text"])]), BLOCK_BYTES):
                p, shown = chain.predict(block)
                part = batch.slice(done, len(block))
                done += len(block)
                toxic = (p[:, -1] >= chain.threshold) & shown
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(p[:, i]) for i in range(p.shape[1])], pa.array(toxic)], [*kept, *names, "toxic"])

    return plain.mapInArrow(run, ", ".join([fields, *[f"`{n}` double" for n in names], "toxic boolean"]))


def label_categories() -> dict[str, Column]:
    """The chain over the label table: low quality first, then toxic."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def judged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with probabilities and verdict; the chain is fitted on the labelled rows of the documents table."""
    chain = fit_chain(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), label_categories())
    return score(docs, chain)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir).select("doc_id", "p_low_quality", "p_toxic", "toxic")

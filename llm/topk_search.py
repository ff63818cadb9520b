"""Exact top-k inner-product search by no-random-access aggregation of sorted lists.

Candidates are cut into blocks.  In a block every dimension has its list of
components, sorted; a query reads lists downwards where its weight is positive
and upwards where it is negative, all lists in equal steps.  What has been read
of a candidate adds to both bounds of its score; for what has not, the list's
frontier bounds it from above and the list's far end from below.  Reading stops
as soon as no outsider's upper bound reaches the k-th best lower bound; only then
are the scores of those that remain resolved.  The k-th best so far is carried
from block to block.  A list is never probed for one candidate.

Bounds are sums of integers below 2**53, hence exact in double arithmetic.  Where the components of a block and its
queries could give larger sums, all its scores are computed in 64-bit integers instead; scores or components beyond these are an error.

Vectors that are null or hold null or non-finite components take no part, nor
do those whose length differs from the most common rule: all vectors that meet
must have one length, else an error is raised.  Ties go to the smaller id.
Repeated ids are separate candidates, but never their own query's.  Empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm._common import read
from llm.registry import query

QUERY_BLOCK = 1024
BLOCK_ROWS = 4096
STEPS = (0.3, 0.55, 0.75, 0.9)
#: Integers below this are exact as doubles.
EXACT = 2.0**53


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id, v``: integer components of every vector that takes part."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.coalesce(bad, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")
    )


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if rows and len(flat) % rows:
        raise ValueError("vectors differ in length")
    return flat.reshape(rows, -1)


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, scores) of each query's best k in the block; ``floor`` (k-th best so far) rises in place."""
    n, d = x.shape
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty((n, d), np.int32)
    np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
    ordered = np.take_along_axis(x, order, axis=0)
    up, down = np.maximum(q, 0.0).T, np.minimum(q, 0.0).T
    own = query_ids[None, :] == ids[:, None]
    last = min(k, n) - 1
    alive = None  # stays so if everything has to be read, as in a block of one row
    for depth in STEPS:
        read_to = min(n, max(1, int(np.ceil(depth * n))))
        if read_to == n:
            break
        high, low = rank >= n - read_to, rank < read_to  # read downwards, read upwards
        top, bottom = ordered[n - read_to], ordered[read_to - 1]  # frontiers
        upper = np.where(high, x, top) @ up + np.where(low, x, bottom) @ down
        lower = np.where(high, x, ordered[0]) @ up + np.where(low, x, ordered[-1]) @ down
        lower[own] = -np.inf
        upper[own] = -np.inf
        reach = np.partition(lower, n - 1 - last, axis=0)[n - 1 - last] if n >= k else np.full(len(q), -np.inf)
        np.maximum(floor, reach, out=floor)
        alive = upper >= floor
        if alive.sum(axis=0).mean() <= 8 * k:
            break
    else:
        alive = None
    out = []
    if alive is None:  # everything was read: all scores are known
        scores = x @ q.T
        scores[own] = -np.inf
        if n > k:
            np.maximum(floor, np.partition(scores, n - k, axis=0)[n - k], out=floor)
        alive = (scores >= floor) & ~own
        picked = ((np.flatnonzero(alive[:, j]), None) for j in range(len(q)))
        resolved = [(rows, scores[rows, j]) for j, (rows, _) in enumerate(picked)]
    else:
        resolved = [(rows := np.flatnonzero(alive[:, j] & ~own[:, j]), x[rows] @ q[j]) for j in range(len(q))]
    for j, (rows, score) in enumerate(resolved):
        best = np.lexsort((ids[rows], -score))[:k]
        rows, score = rows[best], score[best]
        if len(rows) == k:
            floor[j] = max(floor[j], score[-1])
        out.append((rows, score))
    return out


def search_large(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Like ``search_block`` for components whose sums of products double arithmetic would round."""
    if np.abs(x).max() * np.abs(q).max() * x.shape[1] >= 2.0**63 or max(np.abs(x).max(), np.abs(q).max()) >= EXACT:
        raise ValueError("components are too large for 64-bit scores")
    whole, out = x.astype(np.int64), []
    for number, weights in zip(query_ids, q.astype(np.int64), strict=True):
        rows = np.flatnonzero(ids != number)
        score = whole[rows] @ weights
        best = np.lexsort((ids[rows], -score))[:k]
        out.append((rows[best], score[best]))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of each query, other than rows of its own id.

    Queries go out in blocks of at most about ``QUERY_BLOCK`` rows, each against all candidates.
    """
    spark = vectors.sparkSession
    candidates, asked = usable(vectors, id_col, vec_col, scale), usable(queries, id_col, vec_col, scale).dropDuplicates(["id"])
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    schema = "query_id bigint, vec_id bigint, score bigint"
    found = None
    for number in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow()
        if not rows.num_rows:
            continue
        query_ids = rows.column("id").to_numpy()
        sent = spark.sparkContext.broadcast((query_ids, matrix(rows.column("v").combine_chunks(), len(query_ids))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            query_ids, q = sent.value
            floor = np.full(len(query_ids), -np.inf)

            def search(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
                if x.shape[1] != q.shape[1]:
                    raise ValueError("vectors differ in length")
                large = x.size and np.abs(x).max() * np.abs(q).max() * x.shape[1] >= EXACT
                best = search_large(ids, x, query_ids, q, k) if large else search_block(ids, x, query_ids, q, k, floor)
                counts = [len(rows) for rows, _ in best]
                rows = np.concatenate([rows for rows, _ in best])
                score = np.concatenate([score for _, score in best])
                return pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, counts)), pa.array(ids[rows]), pa.array(score.astype(np.int64))], ["query_id", "vec_id", "score"])

            held, many = [], 0
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(start, BLOCK_ROWS)
                    held.append((part.column(0).to_numpy(), matrix(part.column(1), part.num_rows)))
                    many += part.num_rows
                    if many >= BLOCK_ROWS:
                        yield search(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
                        held, many = [], 0
            if many:
                yield search(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))

        part = candidates.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


@query("op8_topk_search", SQL)
def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))

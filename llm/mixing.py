"""Mixing sources to target weights by Poisson replication.

A document of source s is written as often as a Poisson variable with mean
``weight_s * total size / size_s`` says (weights normalised to one), found by
inverting the distribution at a number in [0, 1) that is hashed from seed and
document id: the same document gets the same count in every run.  A mean above
``PIECE`` is the sum of equal smaller means, each inverted with its own hash, so
that no exponential underflows.  Copies are ordered by a second hash over the whole
output.  Size is characters plus one for each document.

Everything is SQL expressions.  Per source there is one row; documents meet it by
an equi-join that Spark turns into a broadcast when the source table is small and
splits by skew otherwise.  Nothing is sampled beyond the operator's own law.

Null source is a source; null text counts as empty; a null id hashes as the empty
string; repeated rows are counted and replicated alike; an empty table gives an
empty result.  Columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm._common import read
from llm.registry import query

PIECE = 16.0
#: P(Poisson(16) > 100) is far below the resolution of the hash (2**-52).
LONGEST = 100


def hashed(seed: int, label: str, *parts: Column) -> Column:
    """Hex digest of seed, label and parts."""
    return F.md5(F.concat_ws("|", F.lit(f"{seed}:{label}"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def unit(digest: Column) -> Column:
    """Number in [0, 1) from the first 52 bits of a digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: DataFrame | None, power: float, source_col: str, text_col: str) -> DataFrame:
    """``source, pieces, cdf``: distribution function of one piece at 0, 1, ...; weights default to size ** power."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.length(F.coalesce(text_col, F.lit(""))) + 1).cast("double").alias("size"))
    if weights is None:
        sized = sizes.withColumn("weight", F.pow("size", F.lit(power)))
    else:
        given = weights.select(F.col("source").alias("given"), F.col("weight").cast("double"))
        sized = sizes.join(given, F.col("source").eqNullSafe(F.col("given")), "left").drop("given").fillna(0.0, ["weight"])
    every = Window.partitionBy(F.lit(0))  # one row per source
    rates = sized.withColumn("rate", F.when(F.col("weight") > 0, F.col("weight") / F.sum("weight").over(every) * F.sum("size").over(every) / F.col("size")).otherwise(0.0))
    pieces = rates.withColumn("pieces", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("pieces")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    return pieces.select("source", "rate", "pieces", F.aggregate(F.sequence(F.lit(1), F.lit(LONGEST)), start, step)["cdf"].alias("cdf"))


def replicate(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of every copy, with ``replica`` (from 0) and ``shuffle_key``, unordered."""
    rates = source_rates(docs, weights, power, source_col, text_col).withColumnRenamed("source", "_source")
    placed = docs.drop("replica", "shuffle_key", "_source").join(rates, F.col(source_col).eqNullSafe(F.col("_source")))
    # Every piece is hashed once, then compared with the whole distribution function.
    drawn = F.transform(F.sequence(F.lit(1), F.col("pieces")), lambda piece: unit(hashed(seed, "count", F.col(id_col), piece)))
    count = F.aggregate(drawn, F.lit(0), lambda total, u: total + F.size(F.filter("cdf", lambda c: c <= u)))
    copies = placed.withColumn("_copies", count).filter("_copies > 0").withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    return copies.withColumn("shuffle_key", hashed(seed, "order", F.col(id_col), F.col("replica"))).drop("_source", "rate", "pieces", "cdf", "_copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``replicate`` in global hash order: partitions are ranges of ``shuffle_key``, sorted inside."""
    return replicate(docs, **options).repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")


SQL = """
WITH sizes AS (
  SELECT source, CAST(sum(length(coalesce(text, '')) + 1) AS DOUBLE) AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, pow(size, 0.5) / sum(pow(size, 0.5)) OVER () * sum(size) OVER () / size AS rate FROM sizes
), pieces AS (
  SELECT source, CAST(greatest(ceil(rate / 16.0), 1) AS INTEGER) AS pieces, rate / greatest(ceil(rate / 16.0), 1) AS mean FROM rates
), steps AS (
  SELECT source, pieces, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS f
  FROM pieces, (SELECT unnest(range(0, 101)) AS k)
), cdf AS (SELECT source, pieces, list(f ORDER BY k) AS cdf FROM steps GROUP BY source, pieces),
drawn AS (
  SELECT doc_id, d.source, cdf, CAST(('0x' || substr(md5('17:count|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || piece), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM (SELECT doc_id, d.source, cdf, unnest(range(1, pieces + 1)) AS piece FROM documents d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source) d
), counted AS (SELECT doc_id, source, sum(len([c FOR c IN cdf IF c <= u])) AS copies FROM drawn GROUP BY doc_id, source)
SELECT doc_id, source, CAST(replica AS INTEGER) AS replica, md5('17:order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || replica) AS shuffle_key
FROM (SELECT doc_id, source, unnest(range(0, CAST(copies AS BIGINT))) AS replica FROM counted)
"""


@query("op5_poisson_mixing", SQL)
def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "replica", "shuffle_key")

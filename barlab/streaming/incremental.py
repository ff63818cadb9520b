"""All timeframes from one growing folder, with a high-water mark per pair.

Every micro-batch is scanned once and reduced to partial bars of the finest timeframe; those are
fanned out and merged with the partial bars that earlier batches left open.  A bucket is
closed when its pair, not the whole stream, has reached a later bucket of that timeframe.

State is two small tables per batch: open partial bars, and per pair the latest time, the late rows and whether it has
failed.  A batch reads its predecessor's tables only, so its cost follows its own rows, however
long the history.  Everything a batch writes lies in folders named by its id and
is replaced when the batch is repeated: a restart in the middle leaves no row twice.

A row is late if its bucket of the finest timeframe is closed already.  Its pair fails from that batch on and gives no bars;
the other pairs go on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from barlab.functions.timeframes import bucket_start, seconds_of, utc
from barlab.operators.resample import as_candles, targets_for
from barlab.schemas import CANDLE_SCHEMA, TIMEFRAME_SECONDS

_MOMENT = "struct<timestamp:timestamp,seq:bigint>"
_PARTS = f"pair string, timeframe string, timestamp timestamp, opened {_MOMENT}, open double, high double, low double, closed {_MOMENT}, close double, spread_sum double, spread_rows bigint, rows bigint, volume double"
_MARKS = "pair string, latest timestamp, late bigint, failed boolean"


@dataclass(frozen=True)
class Build:
    """Where a stream builds to, and what it reads: ticks, or bars of ``source_timeframe``."""

    root: str
    source_timeframe: str = "tick"
    timeframes: tuple[str, ...] | None = None

    @property
    def names(self) -> list[str]:
        return targets_for(self.source_timeframe, list(self.timeframes) if self.timeframes else None)

    def folder(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch={batch}"

    # --- one batch ---

    def parts(self, rows: DataFrame) -> DataFrame:
        """Partial bars of the finest timeframe, from the only pass over the rows; ``latest`` row of each."""
        rows = rows.withColumn("timestamp", utc(F.col("timestamp")))
        has = lambda name: F.col(name) if name in rows.columns else F.lit(None)
        moment = F.struct("timestamp", F.coalesce(has("seq").cast("bigint"), F.lit(0).cast("bigint")).alias("seq"))
        name = dict.fromkeys(("open", "high", "low", "close"), "mid") if self.source_timeframe == "tick" else {n: n for n in ("open", "high", "low", "close")}
        at = lambda column: F.when(F.col(name[column]).isNotNull(), moment)
        return rows.groupBy("pair", bucket_start(F.col("timestamp"), TIMEFRAME_SECONDS[self.names[0]]).alias("bucket")).agg(
            F.min(at("open")).alias("opened"),
            F.min_by(name["open"], at("open")).alias("open"),
            F.max(name["high"]).alias("high"),
            F.min(name["low"]).alias("low"),
            F.max(at("close")).alias("closed"),
            F.max_by(name["close"], at("close")).alias("close"),
            F.sum(has("spread").cast("double")).alias("spread_sum"),
            F.count(has("spread")).alias("spread_rows"),
            F.count(F.lit(1)).alias("rows"),
            F.sum(has("volume").cast("double")).alias("volume"),
            F.max("timestamp").alias("latest"),
        )

    def take(self, rows: DataFrame, batch: int) -> None:
        """Close what the rows close; safe to repeat."""
        spark = rows.sparkSession
        before_open, before_marks = self._table(spark, "open", batch - 1, _PARTS), self._table(spark, "marks", batch - 1, _MARKS)
        self._write(self.parts(rows), "parts", batch)
        parts = spark.read.parquet(self.folder("parts", batch))
        finest = TIMEFRAME_SECONDS[self.names[0]]
        known = parts.join(before_marks.withColumnsRenamed({"latest": "mark", "late": "late_before"}), "pair", "left")
        late = F.coalesce(F.col("bucket") < bucket_start(F.col("mark"), finest), F.lit(False))
        now = known.groupBy("pair").agg(F.max("latest").alias("reached"), F.sum(F.when(late, F.col("rows")).otherwise(0)).alias("late_now"))
        marks = before_marks.join(now, "pair", "full").select(
            "pair",
            F.greatest("latest", "reached").alias("latest"),
            (F.coalesce("late", F.lit(0)) + F.coalesce("late_now", F.lit(0))).alias("late"),
            (F.coalesce("failed", F.lit(False)) | (F.coalesce("late_now", F.lit(0)) > 0)).alias("failed"),
        )
        self._write(marks, "marks", batch)
        marks = self._table(spark, "marks", batch, _MARKS).where("NOT failed").select("pair", F.col("latest").alias("reached"))
        fanned = parts.drop("latest").withColumn("timeframe", F.explode(F.array(*[F.lit(n) for n in self.names])))
        fanned = fanned.withColumn("timestamp", bucket_start(F.col("bucket"), seconds_of(F.col("timeframe")))).drop("bucket")
        merged = (
            before_open.unionByName(fanned)
            .groupBy("pair", "timeframe", "timestamp")
            .agg(
                F.min("opened").alias("opened"),
                F.min_by("open", "opened").alias("open"),
                F.max("high").alias("high"),
                F.min("low").alias("low"),
                F.max("closed").alias("closed"),
                F.max_by("close", "closed").alias("close"),
                *[F.sum(name).alias(name) for name in ("spread_sum", "spread_rows", "rows", "volume")],
            )
            .join(marks, "pair")
            .withColumn("done", F.col("timestamp") < bucket_start(F.col("reached"), seconds_of(F.col("timeframe"))))
        )
        self._write(merged.drop("reached"), "merged", batch)
        merged = spark.read.parquet(self.folder("merged", batch))
        self._write(self._bars(merged.where("done")), "bars", batch)
        self._write(merged.where("NOT done").drop("done"), "open", batch)

    def _bars(self, parts: DataFrame) -> DataFrame:
        ticks = self.source_timeframe == "tick"
        extra: dict[str, Column] = {
            "spread": F.try_divide(F.col("spread_sum"), F.col("spread_rows")),
            "tick_count": F.when(F.lit(ticks), F.col("rows")),
            "volume": F.when(F.lit(not ticks), F.col("volume")),
            "source_kind": F.lit("ticks" if ticks else "bars"),
            "source_timeframe": F.lit(self.source_timeframe),
        }
        return as_candles(parts.dropna(subset=["open", "high", "low", "close"]).withColumns(extra))

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(self.folder(table, batch))

    def _table(self, spark: SparkSession, table: str, batch: int, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(self.folder(table, batch)) if batch >= 0 else spark.createDataFrame([], schema)

    # --- the stream ---

    def run_available(self, rows: DataFrame) -> StreamingQuery:
        """Process everything that is there, batch by batch, and stop; batch ids live in the checkpoint beside the tables."""
        writer = rows.writeStream.option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True)
        query = writer.foreachBatch(lambda batch, number: self.take(batch, number)).start()
        query.awaitTermination()
        return query

    def last_batch(self, spark: SparkSession) -> int:
        """Number of the last batch written, -1 if none."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/open")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return -1
        return max((int(s.getPath().getName().split("=")[1]) for s in system.listStatus(path) if "=" in s.getPath().getName()), default=-1)

    # --- results ---

    def marks(self, spark: SparkSession) -> DataFrame:
        """``pair, latest, late, failed`` as the last batch left them."""
        return self._table(spark, "marks", self.last_batch(spark), _MARKS)

    def closed(self, spark: SparkSession) -> DataFrame:
        """Closed bars of pairs that have not failed."""
        if self.last_batch(spark) < 0:
            return spark.createDataFrame([], CANDLE_SCHEMA)
        schema = T.StructType([*CANDLE_SCHEMA.fields, T.StructField("batch", T.IntegerType())])
        bars = spark.read.schema(schema).parquet(f"{self.root}/bars").where(F.col("batch") <= self.last_batch(spark)).drop("batch")
        return bars.join(self.marks(spark).where("failed").select("pair"), "pair", "left_anti").select(*CANDLE_SCHEMA.names)

    def flushed(self, spark: SparkSession) -> DataFrame:
        """Closed bars, and the open buckets as they stand: the end of the input."""
        return self.closed(spark).unionByName(self._bars(self._table(spark, "open", self.last_batch(spark), _PARTS)))

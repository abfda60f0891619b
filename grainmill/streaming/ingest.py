"""Incremental ingest with Structured Streaming.

Each micro-batch is filtered, counted and deduplicated against the accepted table, then appended. A batch writes its
own partition, by its id, and replaces it when replayed; so a batch that fails half-way leaves no trace and the stream's
checkpoint is the place to resume from. The accepted table and, beside it, the index of near dedup are the state; a batch
signs its own records only, and nothing grows in executors' memory. A damaged part of the index is found by its manifest
and built anew from the accepted table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from grainmill.operators import dedup
from grainmill.operators.corpus import chain, funnel, reasons
from grainmill.operators.near_index import NearIndex
from grainmill.session import Written
from grainmill.sources.files import exists


def accepted_before(spark: SparkSession, path: str, batch: int, schema) -> DataFrame:
    """Accepted records of earlier batches."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col("batch") < batch)


class Ingest:
    """Stream of records -> filter chain -> exact dedup -> (optional) first-wins near dedup -> accepted table."""

    def __init__(self, spark: SparkSession, out: str, tests: Callable[[], list], order: str, text: str, tokens: Callable | None = None):
        self.spark, self.out, self.tests, self.order, self.text, self.tokens = spark, out.rstrip("/"), tests, order, text, tokens
        self.near = NearIndex(spark, f"{self.out}/near_index") if tokens is not None else None

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.out}/{name}/batch={batch}")

    def step(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch; replaying it gives the same table."""
        keep, tests = Written(self.spark), self.tests()
        judged = keep(chain(rows.withColumn("sha256", F.sha2(F.col(self.text), 256)), tests), "judged")
        passed = judged.where("reject_reason is null")
        before = accepted_before(self.spark, f"{self.out}/accepted", batch, StructType([*passed.schema.fields, StructField("batch", LongType())])).drop("batch")
        fresh = keep(dedup.unseen(dedup.exact(passed, self.order), before), "fresh")
        if self.near is not None:
            named = fresh.withColumn("_t", self.tokens(F.col(self.text)))
            decided = self.near.add(named, batch, self.order, "_t").withColumnRenamed("order", self.order)
            rejected = decided.where("not accepted").join(fresh.select(self.order, "sha256"), self.order)
            self._write(rejected.select(self.order, "sha256", "cluster"), "near_duplicates", batch)
            fresh = fresh.join(decided.where("accepted").select(self.order), self.order, "left_semi")
        self._write(fresh, "accepted", batch)
        self._write(funnel(judged, [t[0] for t in tests]), "funnel", batch)
        self._write(reasons(judged), "reasons", batch)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """All that is there, then stops; run again to go on."""
        return stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def accepted(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.out}/accepted").parquet(f"{self.out}/accepted").drop("batch")

    def repair(self) -> list[int]:
        """Batches whose near-dedup index was damaged; each is built anew from its accepted records."""
        if self.near is None:
            return []
        bad = self.near.damaged()
        path = f"{self.out}/accepted"
        for batch in bad:
            rows = self.spark.read.option("basePath", path).parquet(path).where(F.col("batch") == batch)
            self.near.rebuild(rows.withColumn("_t", self.tokens(F.col(self.text))), batch, self.order, "_t")
        return bad

    def progress(self) -> DataFrame:
        """Totals of the funnel over all batches."""
        return self.spark.read.parquet(f"{self.out}/funnel").groupBy("rank", "stage").agg(F.sum("n").alias("n"))


def distinct_stream(stream: DataFrame, keys: list[str], event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Stateful dedup of a stream; with an event time its state is bounded by the watermark."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys) if event_time else stream.dropDuplicates(keys)


def counters(query: StreamingQuery) -> dict[str, int]:
    """Rows and batches so far, from the query's own progress."""
    done = query.recentProgress
    return {"batches": len(done), "rows": sum(p["numInputRows"] for p in done)}

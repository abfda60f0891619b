"""Partial summaries of a running stream, and a tail of them.

Counters are observed on the rows that pass, at no extra pass over them. A listener appends them, a row per micro-batch, to
a progress table that anyone can read while the stream runs, follow from where they stopped, or add up at the end."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from grainmill.sources.files import exists

SCHEMA = "query string, batch bigint, at string, rows bigint, seconds double, counters map<string,bigint>"


def observed(rows: DataFrame, name: str = "progress", **counters: Column) -> DataFrame:
    """Rows as they are, with aggregates (of bigint) taken along the way."""
    return rows.observe(name, *(c.cast("bigint").alias(k) for k, c in counters.items()))


class ProgressTable(StreamingQueryListener):
    """`spark.streams.addListener(ProgressTable(spark, path))`; batches without rows add nothing."""

    def __init__(self, spark: SparkSession, path: str, name: str = "progress"):
        self.spark, self.path, self.name = spark, path, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        counters = {k: int(v) for k, v in (p.get("observedMetrics") or {}).get(self.name, {}).items() if v is not None}
        if not counters and not p.get("numInputRows"):
            return
        row = (p.get("name") or p["id"], p["batchId"], p["timestamp"], int(p["numInputRows"]), p.get("batchDuration", 0) / 1000, counters)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").json(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def progress(spark: SparkSession, path: str) -> DataFrame:
    """A row per query and batch; one that was run again counts once, with its last report."""
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).json(path)
    last = F.max_by(F.struct("at", "rows", "seconds", "counters"), "at")
    return rows.groupBy("query", "batch").agg(last.alias("p")).select("query", "batch", "p.*")


def tail(spark: SparkSession, path: str, after: int = -1, query: str | None = None) -> DataFrame:
    """Reports of batches after one, in order."""
    rows = progress(spark, path).where(F.col("batch") > after)
    return (rows if query is None else rows.where(F.col("query") == query)).orderBy("batch", "query")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(query, counter, n) over all batches so far."""
    rows = progress(spark, path)
    return rows.select("query", F.explode("counters").alias("counter", "n")).groupBy("query", "counter").agg(F.sum("n").alias("n"))

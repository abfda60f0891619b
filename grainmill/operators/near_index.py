"""First-wins near dedup over an index that is kept between batches.

The index holds the bands of accepted records, each with its one owner: two accepted records never share a band. It is
bucketed by band and partitioned by batch, so a batch shuffles its own bands only, each meets one owner at most, and a
record with an older owner is rejected at once. The rest of the batch is settled in rounds: a record that comes first in all
of its bands is accepted, all others of those bands are rejected. In a round a band is its least record, a minimum with
map-side combine, so work is linear in a band's records however many share it. What is left below `SINGLE` rows goes to one
task, in order.

A manifest holds each partition's checksums. A partition that is lost, torn or repeated is found by them and built anew
from the accepted records of that batch alone.

Records come in order over batches: all of a batch are later than those before, and `order` is unique. A record without
tokens is accepted and has no bands. A batch that is given again replaces what it left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators.dedup import bands, minhash
from grainmill.session import Written, delete
from grainmill.sources.buckets import Buckets, Manifest

#: Rows (record, band) that one task may settle in order; more take rounds of joins.
SINGLE = 1_000_000


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Accepted records of (order, band) rows that come by order."""
    taken: set[int] = set()
    at, mine = None, []
    out: list[int] = []

    def close() -> None:
        if at is not None and taken.isdisjoint(mine):
            taken.update(mine)
            out.append(at)

    for batch in batches:
        for order, band in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if order != at:
                close()
                at, mine = order, []
            mine.append(band)
    close()
    yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["order"])


def settle(entries: DataFrame, keep: Written, single: int = SINGLE) -> DataFrame:
    """Accepted `order`s of (order, band) rows: a record is accepted iff it shares no band with an earlier accepted one."""
    shared = entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    left = keep(entries.join(shared, "band", "left_semi"), "left")
    alone = keep(entries.select("order").distinct().join(left.select("order").distinct(), "order", "left_anti"), "alone")
    accepted = [alone]
    while (n := left.count()) > single:
        first = left.groupBy("band").agg(F.min("order").alias("first"))
        wins = keep(left.join(first, "band").groupBy("order").agg(F.min(F.col("first") == F.col("order")).alias("wins")).where("wins").select("order"), "winners")
        over = left.join(left.join(wins, "order", "left_semi").select("band").distinct(), "band", "left_semi").select("order").distinct()
        was, left = left, keep(left.join(over, "order", "left_anti"), "left")
        keep.drop(was)
        accepted.append(wins)
    if n:
        accepted.append(left.coalesce(1).sortWithinPartitions("order").select("order", "band").mapInArrow(_in_order, "order bigint"))
    out = accepted[0]
    for some in accepted[1:]:
        out = out.unionByName(some)
    return keep(out, "accepted")


class NearIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, single: int = SINGLE):
        self.spark, self.path, self.single = spark, path.rstrip("/"), single
        self.index = Buckets(spark, f"{self.path}/bands", "band BIGINT, owner BIGINT", "band", "batch", buckets)
        self.manifest = Manifest(spark, f"{self.path}/manifest")

    def _entries(self, records: DataFrame, order: str, tokens: str) -> DataFrame:
        signed = minhash(records, order, tokens).where("signature is not null")
        return signed.select(F.col(order).cast("bigint").alias("order"), F.explode(F.array_distinct(bands(F.col("signature")))).alias("band"))

    def add(self, records: DataFrame, batch: int, order: str, tokens: str) -> DataFrame:
        """(order, accepted, cluster) of the batch's records; cluster is the earliest accepted record that one meets."""
        keep = Written(self.spark)
        entries = keep(self._entries(records, order, tokens), "entries")
        old = self.index.read().where(F.col("batch") < batch)
        met = keep(self.index.meet(entries).join(old, "band").groupBy("order").agg(F.min("owner").alias("cluster")), "met")
        rest = entries.join(met, "order", "left_anti")
        accepted = settle(rest, keep, self.single)
        owners = keep(rest.join(accepted, "order", "left_semi").select("band", F.col("order").alias("owner")), "owners")
        late = rest.join(owners, "band").where("owner < order").groupBy("order").agg(F.min("owner").alias("cluster"))
        rejected = met.unionByName(late)
        found = records.select(F.col(order).cast("bigint").alias("order")).join(rejected, "order", "left")
        decided = keep(found.select("order", F.col("cluster").isNull().alias("accepted"), F.coalesce("cluster", "order").alias("cluster")), "decided")
        self.index.replace(owners, batch)
        self.manifest.record(owners, batch)
        for some in (entries, met, accepted, owners):
            keep.drop(some)
        return decided

    def drop(self) -> None:
        self.index.forget()
        delete(self.spark, self.path)

    def damaged(self) -> list[int]:
        """Batches whose bands are not those that were written."""
        self.spark.catalog.refreshTable(self.index.name)
        return self.manifest.damaged(self.index.read(), "batch")

    def rebuild(self, accepted: DataFrame, batch: int, order: str, tokens: str) -> None:
        """The bands of one batch, from its accepted records; they are checked against the manifest."""
        entries = Written(self.spark)(self._entries(accepted, order, tokens).select("band", F.col("order").alias("owner")), "owners")
        self.index.replace(entries, batch)
        if batch in self.damaged():
            raise ValueError(f"the accepted records of batch {batch} are not those that the index was built from")

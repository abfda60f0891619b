"""Connected components of an edge table, by alternating large-star and small-star steps.

Each task first contracts its own edges. What is left is counted: up to SINGLE edges are settled by one task, of that
bounded size; beyond, every step is joins and aggregations with map-side combine: a hub of many edges is split by the skew join and its
minimum is pre-aggregated, so no group is gathered in one task. Labels and edges never reach the driver; it only
reads a count and a checksum per round."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.session import Written

EDGES = "a bigint, b bigint"


#: Edges that one task may settle alone; more take the alternating steps.
SINGLE = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges (node, smallest node reachable) of a task's own edges: fewer, shallower edges for the same
    components. Held edges are bounded: stars of a full table go out and start anew."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        at = x
        while (up := parent.setdefault(at, at)) != at:
            at = up
        while x != at:
            parent[x], x = at, parent[x]
        return at

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 2 * SINGLE:
            yield stars()
    yield stars()


def components(spark: SparkSession, edges: DataFrame, keep: Written | None = None) -> DataFrame:
    """(node, component) for each node of `edges` (a, b bigint), component being the smallest node reachable.

    Null ends and self loops link nothing; repeated edges count once; no edges give an empty table."""
    keep = keep or Written(spark)
    edges = edges.selectExpr("greatest(a, b) a", "least(a, b) b").where("a > b").distinct()
    now = keep(edges.mapInArrow(_forest, EDGES).distinct(), "edges")
    if now.count() <= SINGLE:
        out = keep(now.coalesce(1).mapInArrow(_forest, EDGES), "components")
        keep.drop(now)
        return out.select(F.col("a").alias("node"), F.col("b").alias("component"))
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        was, now = now, keep(small, "edges")
        keep.drop(was)

"""Embedding near-dedup: int8 tile products with rigorous error bounds.

Each unit vector x is s*q + r with integer q in -127..127 and its own scale s; e = |r| is computed exactly, so
|<x, y> - s_x s_y <q_x, q_y>| <= e_x + e_y + e_x e_y. Tiles of integer products (exact in float32 while
127^2 * dimensions < 2^24, else in float64) give every pair a lower and an upper bound on its cosine: pairs certainly
above or below the threshold are settled, the few in between are recomputed in double precision.

All pairs are compared, in tiles of vector blocks, each tile a task of bounded memory. Equal vectors are one node with
a count, so a group of copies costs one row; a tile returns per vector its number of linked vectors and its smallest
label within the tile, never the pairs, so a dense group costs as many rows as it has vectors.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of different
lengths never link. Repeated rows are separate vectors. Rows with a null id are returned with a null component unless
linked to one with an id. An empty table gives an empty result. Only the named columns are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.components import components
from grainmill.session import Written

#: Vectors in a block: a tile of two blocks is what a task holds.
BLOCK = 4096
ROWS = 512
SLACK = 1e-9


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vec): vec is the vector's doubles as bytes, null if it links with nothing; -0 counts as 0."""
    for batch in batches:
        out = []
        for v in batch.column(1):
            x = np.array(v.as_py(), np.float64) if v.is_valid and not v.values.null_count else None
            good = x is not None and len(x) and np.isfinite(x).all() and x.any()
            out.append((x + 0.0).tobytes() if good else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vec"])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, integer parts, scales and error norms (rounded up) of the rows of x."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    rest = unit - scale[:, None] * q
    return unit, q, scale, np.sqrt((rest * rest).sum(axis=1)) + SLACK


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of (i, j) with cosine of x[i] and y[j] >= threshold."""
    ux, qx, sx, ex = quantise(x)
    uy, qy, sy, ey = quantise(y)
    kind = np.float32 if 127 * 127 * x.shape[1] < 1 << 24 else np.float64
    qx, qy = qx.astype(kind), np.ascontiguousarray(qy.astype(kind).T)
    top_e, top_s = ey.max(), sy.max()
    for at in range(0, len(qx), ROWS):
        end = min(at + ROWS, len(qx))
        tile = qx[at:end] @ qy
        slack = ex[at:end] + top_e + ex[at:end] * top_e + SLACK
        least = (threshold - slack) / (sx[at:end] * top_s)
        least = np.where(threshold - slack > 0, least, -np.inf)
        rows, cols = np.nonzero(tile >= least.astype(kind)[:, None] * (1 - 1e-6))
        rows += at
        about = sx[rows] * sy[cols] * tile[rows - at, cols].astype(np.float64)
        slack = ex[rows] + ey[cols] + ex[rows] * ey[cols] + SLACK
        keep = about - slack >= threshold
        unsure = np.nonzero(~keep & (about + slack >= threshold))[0]
        for k in range(0, len(unsure), 1 << 15):
            some = unsure[k : k + (1 << 15)]
            a, b = x[rows[some]], y[cols[some]]
            keep[some] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))) >= threshold
        yield rows[keep], cols[keep]


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number in each number's component under edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component, kept) per row of `vectors`."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    keep = Written(spark)
    rows = keep(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")).mapInArrow(_nodes, "id bigint, vec binary").withColumn("key", F.md5("vec")), "vectors")
    grouped = rows.where("vec is not null").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    nodes = keep(grouped.withColumn("node", F.xxhash64("key")), "nodes")
    n_blocks = max(1, -(-nodes.count() // block))

    def tile(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        own = np.array(group.column("own").to_pylist())
        node = np.array(group.column("node").to_pylist(), np.int64)
        copies = np.array(group.column("copies").to_pylist(), np.int64)
        raw = [v.as_buffer() for v in group.column("vec")]
        size = np.array([v.size for v in raw])
        links = np.zeros(len(node), np.int64)
        ends: list[np.ndarray] = []
        for dim in np.unique(size):
            left, right = np.nonzero((own == i) & (size == dim))[0], np.nonzero((own == j) & (size == dim))[0]
            if not len(left) or not len(right):
                continue
            x, y = (np.stack([np.frombuffer(raw[k], np.float64) for k in side]) for side in (left, right))
            for a, b in linked_pairs(x, y, threshold):
                a, b = left[a], right[b]
                if i == j:
                    a, b = a[a != b], b[a != b]
                links += np.bincount(a, weights=copies[b], minlength=len(node)).astype(np.int64)
                if i != j:
                    links += np.bincount(b, weights=copies[a], minlength=len(node)).astype(np.int64)
                ends.append(np.stack([a, b]))
        a, b = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
        label = _labels(len(node), a, b)
        some = np.nonzero(links)[0]
        return pa.table({"node": node[some], "links": links[some], "to": node[label[some]]})

    own = F.pmod("node", F.lit(n_blocks)).cast("int")
    dealt = nodes.select("node", "copies", "vec", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other"))
    dealt = dealt.select("node", "copies", "vec", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    tiles = keep(dealt.groupBy("i", "j").applyInArrow(tile, "node bigint, links bigint, to bigint"), "links")

    found = components(spark, tiles.select(F.col("node").alias("a"), F.col("to").alias("b")), keep)
    degree = tiles.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("key", "node", "least", "copies").join(found, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("smallest"))
    named = named.join(least, "component").select("key", "smallest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id", "key").join(named, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component")).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))


def op5_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainmill.session import table

    out = near_duplicates(spark, table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")

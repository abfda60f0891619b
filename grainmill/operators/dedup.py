"""Exact and near dedup of a corpus in acceptance order.

Near duplicates are collisions in any band of a MinHash signature (128 values, 14 bands of 9 rows for a threshold of
0.7). A record is accepted iff it collides with no earlier accepted record: greedy and order dependent, so neither
components nor pairwise minima give it; near_index settles it. Shingles are hashed by CRC-32, which all engines know."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.text import let, shingles
from grainmill.session import new_path

PERMUTATIONS, BANDS, ROWS, PRIME = 128, 14, 9, (1 << 31) - 1


def _coefficients(n: int) -> list[tuple[int, int]]:
    """Multipliers and offsets of the permutations, from a linear congruential sequence."""
    x, out = 20240229, []
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            pair.append((x >> 33) % (PRIME - 1) + 1)
        out.append((pair[0], pair[1]))
    return out


def least_values(hashes: np.ndarray, n: int = PERMUTATIONS) -> np.ndarray:
    """Least value of hashes below PRIME under each permutation; products stay within 62 bits."""
    a, b = (np.array(c, np.uint64)[:, None] for c in zip(*_coefficients(n), strict=True))
    out = np.full(n, PRIME, np.uint64)
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096].astype(np.uint64)[None, :]
        out = np.minimum(out, ((a * h + b) % np.uint64(PRIME)).min(axis=1))
    return out.astype(np.int64)


def minhash(records: DataFrame, order: str, tokens: str, width: int = 5, n: int = PERMUTATIONS) -> DataFrame:
    """(order, signature) of each record's token shingles; null without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = (v.values.to_numpy() if v.is_valid else () for v in batch.column(1))
            signed = [least_values(h, n) if len(h) else None for h in hashed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.list_(pa.int64()))], names=[order, "signature"])

    kind = records.schema[order].dataType.simpleString()
    hashes = F.transform(shingles(F.col(tokens), width), lambda s: F.crc32(s.cast("binary")) % PRIME)
    return records.select(order, hashes.alias("hashes")).mapInArrow(run, f"{order} {kind}, signature array<bigint>")


def bands(signature: Column, n: int = BANDS, rows: int = ROWS) -> Column:
    """Array of band keys."""
    return let(signature, lambda s: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.xxhash64(b, F.slice(s, b * rows + 1, rows))))


def exact(records: DataFrame, order: str, hash_col: str = "sha256") -> DataFrame:
    """The first record per hash in the given order: a minimum with map-side combine."""
    keep = records.groupBy(hash_col).agg(F.min(order).alias(order))
    return records.join(keep, [hash_col, order], "left_semi")


def unseen(records: DataFrame, accepted: DataFrame, hash_col: str = "sha256") -> DataFrame:
    """Records whose hash no accepted record has; a near duplicate's hash is not remembered."""
    return records.join(accepted.select(hash_col), hash_col, "left_anti")


def duplicate_counts(rows: DataFrame, key: str, top: int = 10) -> DataFrame:
    """The most repeated keys."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), key).limit(top)


def near(spark: SparkSession, records: DataFrame, order: str, tokens: str) -> DataFrame:
    """Adds `accepted` and `cluster`, the earliest accepted record that a rejected one collides with; records without
    tokens collide with nothing. One batch into a new index."""
    from grainmill.operators.near_index import NearIndex

    index = NearIndex(spark, new_path(spark, "near"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    decided = index.add(records, 0, order, tokens)
    index.drop()
    return records.join(decided.withColumnRenamed("order", order), order)


def cluster_sizes(decided: DataFrame) -> DataFrame:
    """Members of each accepted record's cluster, itself included."""
    return decided.groupBy("cluster").agg(F.count("*").alias("size"))

"""Confidence intervals by a Poisson bootstrap, and McNemar's exact test.

Each row has a weight in each replicate, a Poisson(1) draw from a hash of seed, replicate and the row's key, so a resample
needs no shuffle of rows: weighted sums are aggregates with map-side combine, one row per group, replicate and task, and
another run, order or engine gives the same intervals. Pairing is by weight: both sides of a row get the same one, so the
interval of a difference is paired.

Null values leave their row out. A replicate in which a group has no weight counts for nothing; a group without rows is
not in the result."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.stats import incomplete_beta

#: Eight of 32 hex digits a replicate: replicates that share a digest.
SHARED = 4


def thresholds() -> list[int]:
    """Below which of these a 32-bit number lies gives a Poisson(1) draw."""
    out, total, term = [], 0.0, math.exp(-1)
    for k in range(12):
        total += term
        out.append(math.floor(total * 4294967296))
        term /= k + 1
    return out


def _draw(digest: Column, nth: int) -> Column:
    u = F.conv(F.substring(digest, 8 * nth + 1, 8), 16, 10).cast("bigint")
    return sum(((u >= t).cast("bigint") for t in thresholds()), F.lit(0).cast("bigint"))


def replicates(rows: DataFrame, by: list[str], key: str, value: str, n: int = 100, seed: int = 42) -> DataFrame:
    """(by, replicate, mean): the weighted mean of `value` in each of n (a multiple of 4) replicates."""
    if n % SHARED:
        raise ValueError(f"replicates come in multiples of {SHARED}")
    used = rows.where(F.col(value).isNotNull())
    block = used.select(*by, F.col(value).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(n // SHARED - 1))).alias("_b"), F.col(key).cast("string").alias("_k"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_b").cast("string"), F.col("_k")))
    drawn = block.withColumn("_d", digest).select(*by, "_v", "_b", *(_draw(F.col("_d"), i).alias(f"_w{i}") for i in range(SHARED)))
    sums = drawn.groupBy(*by, "_b").agg(*(F.sum(F.col(f"_w{i}") * F.col("_v")).alias(f"_s{i}") for i in range(SHARED)), *(F.sum(f"_w{i}").alias(f"_n{i}") for i in range(SHARED)))
    each = F.array(*(F.struct((F.col("_b") * SHARED + i).alias("replicate"), (F.col(f"_s{i}") / F.when(F.col(f"_n{i}") > 0, F.col(f"_n{i}"))).alias("mean")) for i in range(SHARED)))
    return sums.select(*by, F.explode(each).alias("_r")).select(*by, "_r.*")


def interval(rows: DataFrame, by: list[str], key: str, value: str, n: int = 100, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(by, n_rows, mean, low, high): order statistics of the replicates' means at both tails of `level`."""
    means = replicates(rows, by, key, value, n, seed).where("mean is not null")
    held = means.groupBy(*by).agg(F.sort_array(F.collect_list("mean")).alias("_m"))  # n numbers
    at = lambda share: F.element_at("_m", F.greatest(F.ceil(F.size("_m") * F.lit(share)), F.lit(1)).cast("int"))
    tail = (1 - level) / 2
    whole = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n_rows"), F.avg(value).alias("mean"))
    bounds = held.select(*by, at(tail).alias("low"), at(1 - tail).alias("high"))
    same = [whole[b].eqNullSafe(bounds[b]) for b in by]
    return whole.join(bounds, same).select(*(whole[b] for b in by), "n_rows", "mean", "low", "high")


def exact_p(a: Column, b: Column) -> Column:
    """Two-sided probability of a split as uneven as a : b among a + b fair coins; 1 without any."""

    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: int, y: int) -> float:
            low, n = min(x, y), x + y
            return 1.0 if 2 * low >= n else min(1.0, 2 * incomplete_beta(n - low, low + 1, 0.5))

        return pd.Series([one(int(x), int(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return f(a, b)


def mcnemar(rows: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """(by, n, only_first, only_second, p): rows right under one reading alone. first, second: booleans."""
    a, b = F.col(first), F.col(second)
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"))
    return out.withColumn("p", exact_p(F.col("only_first"), F.col("only_second")))

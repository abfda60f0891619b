"""Set operations over variants of a dataset, exact-size samples and splits, and dense numbering.

Intersections and their reports are aggregations by key. Samples and splits of exact size order by a hash of the key
through a two-level rank: only counts per hash bucket are summed in one place, and rows are numbered within buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.session import Written


def dense_rank_by_hash(rows: DataFrame, hashed: Column, ties: list[str], name: str = "rank", digits: int = 3) -> DataFrame:
    """Adds a dense number from 0 in order of a hex hash. Buckets are its first digits (16 ** digits at most)."""
    rows = rows.withColumns({"_h": hashed, "_b": F.substring(hashed, 1, digits)})
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_b").orderBy("_h", *ties))
    return rows.withColumn("_k", inside).join(F.broadcast(counts), "_b").withColumn(name, (F.col("_before") + F.col("_k") - 1).cast("bigint")).drop("_h", "_b", "_k", "_before")


def seeded_hash(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def sample(rows: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """Exactly `size` rows (all, if there are fewer) in order of a seeded hash of the key."""
    return dense_rank_by_hash(rows, seeded_hash(seed, key), [key], "_rank").where(F.col("_rank") < size).drop("_rank")


def split(rows: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds `split`: exactly ceil(share * n) rows are validation."""
    ranked = dense_rank_by_hash(rows, seeded_hash(seed, key), [key], "_rank")
    total = rows.agg(F.count("*").alias("_total"))
    return ranked.crossJoin(F.broadcast(total)).withColumn("split", F.when(F.col("_rank") < F.ceil(F.col("_total") * F.lit(share)), "validation").otherwise("train")).drop("_rank", "_total")


def intersection(variants: DataFrame, key: str, variant: str) -> DataFrame:
    """Keys that all variants hold. variants: a row per (variant, key), repeats allowed."""
    n = variants.agg(F.count_distinct(variant).alias("_n"))
    held = variants.groupBy(key).agg(F.count_distinct(variant).alias("_held"))
    return held.crossJoin(F.broadcast(n)).where("_held = _n").select(key)


def mismatches(variants: DataFrame, key: str, variant: str, first: str) -> DataFrame:
    """Against the first variant: how many keys each other variant lacks or has besides."""
    names = variants.select(variant).distinct().where(F.col(variant) != first)
    mine = variants.where(F.col(variant) == first).select(key).distinct()
    others = variants.where(F.col(variant) != first).select(variant, key).distinct()
    total = mine.agg(F.count("*").alias("_total"))
    shared = others.join(mine.withColumn("_in", F.lit(1)), key, "left").groupBy(variant).agg(F.count("_in").alias("_shared"), F.count("*").alias("_own"))
    return names.join(shared, variant).crossJoin(F.broadcast(total)).select(variant, (F.col("_total") - F.col("_shared")).alias("n_only_first"), (F.col("_own") - F.col("_shared")).alias("n_only_other"))


def harmonise(cells: DataFrame, cell: str = "cell", split_col: str = "split", idx: str = "idx") -> DataFrame:
    """Each (split, idx) of the union: whether all cells hold it, and which don't. A cell without any row of a split is
    an error, as the intersection would be empty for a reason that no one meant."""
    names = cells.agg(F.array_sort(F.collect_set(cell)).alias("_all"))  # a handful of names
    held = cells.groupBy(split_col, idx).agg(F.array_sort(F.collect_set(cell)).alias("_held"))
    out = held.crossJoin(F.broadcast(names)).withColumn("missing", F.array_join(F.array_except("_all", "_held"), ","))
    return out.select(split_col, idx, (F.col("missing") == "").alias("kept"), "missing")


def missing_splits(cells: DataFrame, cell: str = "cell", split_col: str = "split") -> DataFrame:
    """Cells that lack a split altogether."""
    pairs = cells.select(cell).distinct().crossJoin(cells.select(split_col).distinct())
    return pairs.join(cells.select(cell, split_col).distinct(), [cell, split_col], "left_anti")


def cell_sizes(cells: DataFrame, cell: str = "cell", split_col: str = "split", idx: str = "idx") -> DataFrame:
    """Per split: cells, union, intersection and dropped."""
    n = cells.groupBy(split_col).agg(F.count_distinct(cell).alias("n_cells"))
    by = cells.groupBy(split_col, idx).agg(F.count_distinct(cell).alias("held"))
    out = by.join(n, split_col).groupBy(split_col, "n_cells").agg(F.count("*").alias("n_union"), F.count_if(F.col("held") == F.col("n_cells")).alias("n_intersection"))
    return out.withColumn("n_dropped", F.col("n_union") - F.col("n_intersection"))


def running_cap(rows: DataFrame, position: str, size: str, most: int, total: int) -> DataFrame:
    """Rows up to the one that would cross `total`, in order of position; rows larger than `most` are passed over. Sums
    are two-level: by range of positions, then within the range."""
    fits = rows.where(F.col(size) <= most)
    width = F.col("_width")
    bounds = fits.agg(F.min(position).alias("_lo"), (F.greatest((F.max(position) - F.min(position)) / 1024, F.lit(1.0))).alias("_width"))
    cut = fits.crossJoin(F.broadcast(bounds)).withColumn("_b", F.floor((F.col(position) - F.col("_lo")) / width)).drop("_lo", "_width")
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy("_b").agg(F.sum(size).alias("_s")).select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = F.sum(size).over(W.partitionBy("_b").orderBy(position).rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn("_in", inside).join(F.broadcast(sums), "_b").withColumn("running", F.col("_before") + F.col("_in")).where(F.col("running") <= total).drop("_b", "_in", "_before")


def numbered(rows: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """A dense number from 0 in the given order: ranges are numbered apart and offset by the sizes of those before."""
    ranged = Written(rows.sparkSession)(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_k", inside).join(F.broadcast(sizes), "_p").withColumn(name, (F.col("_before") + F.col("_k") - 1).cast("bigint")).drop("_p", "_k", "_before")


def first_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order: a minimum with map-side combine, not a window over the key's rows."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    picked = rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return picked.select(*key, "_r.*").select(*rows.columns)


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("bigint")).where(F.col(name) <= n)

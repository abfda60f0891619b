"""Validation of dataset variants by content, without joining them.

One aggregation per (config, split) counts rows, sums 128-bit hashes of paths and of (path, content), and takes token
statistics. Equal sums mean equal multisets, so variants that are as they should be cost one pass and no shuffle of rows,
whatever their size. Only variants whose sums differ from the first one's are looked at by path, to name what is wrong.

A variant's `code_en` must be the first variant's `code` at each path. Null paths and contents are values of their own.
Splits that a variant lacks count as empty. Repeats within the first variant are looked for by path, as sums can't show
what has nothing to differ from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.datasets import ValidationError


def _sums(name: str, *parts: Column) -> list[Column]:
    """Two sums of 64-bit hashes with different seeds, next to each other 128 bits a row."""
    return [F.sum(F.xxhash64(F.lit(salt), *parts).cast("decimal(38,0)")).alias(f"{name}_{salt}") for salt in (1, 2)]


def profile(rows: DataFrame, first: str, path: str = "file_path") -> DataFrame:
    """Per (config, split): n, hash sums of paths and contents, token statistics. rows: config, split, path, code,
    code_en, token_count."""
    content = F.when(F.col("config") == first, F.col("code")).otherwise(F.col("code_en"))
    t = F.col("token_count")
    return rows.groupBy("config", "split").agg(
        F.count("*").alias("n"), *_sums("paths", F.col(path)), *_sums("contents", F.col(path), content),
        F.count_if(t.isNull()).alias("null_tokens"), F.coalesce(F.sum(t), F.lit(0)).alias("total_tokens"), F.coalesce(F.round(F.avg(t), 1), F.lit(0.0)).alias("mean_tokens"), F.coalesce(F.min(t), F.lit(0)).alias("min_tokens"), F.coalesce(F.max(t), F.lit(0)).alias("max_tokens"),
    )


def report(rows: DataFrame, first: str, expected: int, path: str = "file_path") -> DataFrame:
    """The profile of each (config, split) with `paths_match` and `contents_match` against the first variant's split, and
    `size_ok` of the whole variant against `expected`."""
    held = profile(rows, first, path)
    other = held.where(F.col("config") == first).drop("config")
    theirs = other.select("split", *(F.col(c).alias(f"first_{c}") for c in other.columns if c.startswith(("paths_", "contents_"))), F.col("n").alias("first_n"))
    whole = held.groupBy("config").agg((F.sum("n") == expected).alias("size_ok"))
    configs = held.select("config").distinct()
    cells = configs.crossJoin(held.select("split").distinct())  # names of variants and splits: a handful
    out = cells.join(held, ["config", "split"], "left").join(theirs, "split", "left").join(whole, "config")

    def same(name: str) -> Column:
        return F.col("n").eqNullSafe(F.col("first_n")) & F.col(f"{name}_1").eqNullSafe(F.col(f"first_{name}_1")) & F.col(f"{name}_2").eqNullSafe(F.col(f"first_{name}_2"))

    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "null_tokens", "total_tokens", "min_tokens", "max_tokens", "mean_tokens")}
    return out.select("config", "split", "size_ok", same("paths").alias("paths_match"), same("contents").alias("contents_match"), *(c.alias(n) for n, c in zero.items()))


def faults(rows: DataFrame, first: str, found: DataFrame | None = None, path: str = "file_path") -> DataFrame:
    """(config, split, path, fault) with fault one of lost, extra, repeated, changed; `repeated` also for the first
    variant. `found`: a report, of which only configs that don't match are read again."""
    suspects = None
    if found is not None:
        suspects = [r["config"] for r in found.where("not (paths_match and contents_match)").select("config").distinct().collect()]
    content = F.when(F.col("config") == first, F.col("code")).otherwise(F.col("code_en"))
    hashed = rows.select("config", "split", F.col(path).alias("path"), F.struct(*(F.xxhash64(F.lit(s), content) for s in (1, 2))).alias("h"))
    mine = hashed.where(F.col("config") == first)
    others = hashed.where(F.col("config").isin(suspects)) if suspects is not None else hashed.where(F.col("config") != first)
    counts = lambda df: df.groupBy("config", "split", "path").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    base, held = counts(mine), counts(others)
    wanted = base.select(F.col("split").alias("s"), F.col("path").alias("p"), F.col("n").alias("first_n"), F.col("low").alias("first_low"), F.col("high").alias("first_high"))
    named = held.select("config").distinct()
    at = F.col("split").eqNullSafe(F.col("s")) & F.col("path").eqNullSafe(F.col("p"))
    met = held.join(wanted, at, "left")
    here = met.select("config", "split", "path", F.when(F.col("first_n").isNull(), "extra").when((F.col("low") != F.col("first_low")) | (F.col("high") != F.col("first_high")), "changed").when(F.col("n") > F.col("first_n"), "repeated").when(F.col("n") < F.col("first_n"), "lost").alias("fault")).where("fault is not null")
    due = wanted.crossJoin(named).select("config", F.col("s").alias("split"), F.col("p").alias("path"))  # a row per path and suspect
    has = held.select("config", F.col("split").alias("s"), F.col("path").alias("p"))
    lost = due.join(has.withColumnRenamed("config", "c"), (F.col("config") == F.col("c")) & at, "left_anti").withColumn("fault", F.lit("lost"))
    twice = base.where("n > 1").select("config", "split", "path", F.lit("repeated").alias("fault"))
    return here.unionByName(lost).unionByName(twice)


def require(rows: DataFrame, first: str, expected: int, path: str = "file_path") -> DataFrame:
    """The report of valid variants; raises, with the faults by kind, if one is not."""
    found = report(rows, first, expected, path)
    bad = found.where("not (size_ok and paths_match and contents_match)").count()
    named = faults(rows, first, found, path).groupBy("config", "fault").count().orderBy("config", "fault").collect()
    if bad or named:
        raise ValidationError("; ".join([f"{bad} splits fail", *(f"{r['config']}: {r['count']} {r['fault']}" for r in named)]))
    return found

"""Building, validating and packaging aligned dataset variants, and the ledger of a translation run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators import sets

NO_IDX = -1


class ValidationError(ValueError):
    """A dataset that must not be written."""


def token_stats(rows: DataFrame, by: list[str], tokens: str = "token_count") -> DataFrame:
    """Totals without nulls; none give 0."""
    t = F.col(tokens)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(t), F.lit(0)).cast("bigint").alias("total"), F.coalesce(F.round(F.avg(t), 1), F.lit(0.0)).alias("mean"), F.coalesce(F.min(t), F.lit(0)).cast("bigint").alias("least"), F.coalesce(F.max(t), F.lit(0)).cast("bigint").alias("most"), F.count_if(t.isNull()).alias("n_null")
    )


def with_original(rows: DataFrame, originals: DataFrame, path: str = "file_path") -> DataFrame:
    """Each row with its original's text by path; a missing one is '', not null."""
    return rows.join(originals.select(path, F.col("code").alias("code_en")), path, "left").withColumn("code_en", F.coalesce("code_en", F.lit("")))


def with_metadata(rows: DataFrame, meta: DataFrame, default_license: str = "unknown") -> DataFrame:
    """Licence and idx by relative path, else by base name (the last row wins per key); no match gives the default
    licence and idx -1. An empty licence that is there stays."""
    base = F.element_at(F.split("file_path", "/", -1), -1)
    by_path = meta.select(F.col("file_path").alias("_k"), F.col("license").alias("_l1"), F.col("idx").alias("_i1"), "pos")
    by_path = by_path.groupBy("_k").agg(F.max(F.struct("pos", "_l1", "_i1")).alias("_m1"))
    by_name = meta.groupBy(F.col("filename").alias("_f")).agg(F.max(F.struct("pos", F.col("license").alias("_l2"), F.col("idx").alias("_i2"))).alias("_m2"))
    out = rows.withColumn("_base", base).join(by_path, F.col("file_path") == F.col("_k"), "left").join(by_name, F.col("_base") == F.col("_f"), "left")
    license_, idx = F.coalesce("_m1._l1", "_m2._l2", F.lit(default_license)), F.coalesce("_m1._i1", "_m2._i2", F.lit(NO_IDX))
    return out.withColumns({"license": license_, "idx": idx.cast("bigint")}).drop("_k", "_f", "_m1", "_m2", "_base")


def members(rows: DataFrame, keys: DataFrame, key: str = "idx") -> DataFrame:
    """Rows whose key is listed; -1 never is."""
    return rows.where(F.col(key) != NO_IDX).join(keys.select(key), key, "left_semi")


def compare_code(reference: DataFrame, other: DataFrame, key: str = "file_path") -> DataFrame:
    """Paths of `other` whose text is not found in the reference or differs from it."""
    out = other.select(key, F.col("code_en").alias("_o")).join(reference.select(key, F.col("code").alias("_r"), F.lit(1).alias("_in")), key, "left")
    status = F.when(F.col("_in").isNull(), "not_found").when(~F.col("_o").eqNullSafe(F.col("_r")), "differs").otherwise("same")
    return out.select(key, status.alias("status"))


def validate_subsets(variants: DataFrame, variant: str, key: str, size: int, first: str) -> DataFrame:
    """One row per variant and check with the number of offending rows (0 passes)."""
    per = variants.groupBy(variant).agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"))
    common = sets.intersection(variants, key, variant).withColumn("_common", F.lit(1))
    outside = variants.join(common, key, "left").groupBy(variant).agg(F.count_if(F.col("_common").isNull()).alias("outside"))
    checks = F.array(F.struct(F.lit("row_count").alias("check"), F.abs(F.col("n") - size).alias("bad")), F.struct(F.lit("duplicates").alias("check"), (F.col("n") - F.col("d")).alias("bad")), F.struct(F.lit("set_equality").alias("check"), F.col("outside").alias("bad")))
    return per.join(outside, variant).select(variant, F.explode(checks).alias("c")).select(variant, "c.*")


def blend(native: DataFrame, translated: DataFrame, used: DataFrame | None, target: int, key: str = "file_path", seed: int = 42) -> DataFrame:
    """All native rows (sampled to the target if there are more) filled up with sampled translated rows whose path no
    earlier run used; source_type tells them apart, and native rows have no English side."""
    n = native.count()
    own = native if n <= target else sets.sample(native, key, target, seed)
    free = translated if used is None else translated.join(used.select(key), key, "left_anti")
    fill = sets.sample(free, key, max(0, target - n), seed)
    return own.withColumns({"source_type": F.lit("native"), "code_en": F.lit(None).cast("string")}).unionByName(fill.withColumn("source_type", F.lit("translated")), allowMissingColumns=True)


def validate_blend(rows: DataFrame, target: int, key: str = "file_path") -> DataFrame:
    native = F.col("source_type") == "native"
    return rows.agg(
        (F.count("*") - target).alias("size_off"), (F.count("*") - F.count_distinct(key)).alias("n_repeated"), F.count_if(native).alias("n_native"), F.count_if(~native).alias("n_translated"), F.count_if(native & F.col("code_en").isNotNull()).alias("n_native_english"), F.count_if(~native & F.col("code_en").isNull()).alias("n_translated_bare"), F.count_if(F.col("token_count").isNull()).alias("n_null_tokens")
    )


def require(report: DataFrame, bad: str = "bad") -> None:
    """Refuses a dataset with offending rows; reads one number."""
    n = report.agg(F.sum(bad)).first()[0]
    if n:
        raise ValidationError(f"{n} rows fail validation")


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def retokenised(old: DataFrame, count: Column, key: str = "file_path") -> DataFrame:
    """Old and new token counts side by side."""
    return old.withColumn("new_count", count).select(key, F.col("token_count").alias("old_count"), "new_count", (F.col("new_count") - F.col("token_count")).alias("change"))


def ledger(universe: DataFrame, valid: DataFrame, errors: DataFrame, summary: DataFrame, key: list[str]) -> DataFrame:
    """Status of every item of the universe: valid, failed (an error and no valid output), else pending."""
    out = universe.join(valid.select(*key, F.lit(True).alias("_valid")).distinct(), key, "left").join(errors.select(*key, F.lit(True).alias("_error")).distinct(), key, "left").join(summary, key, "left")
    ok, bad = F.coalesce("_valid", F.lit(False)), F.coalesce("_error", F.lit(False))
    return out.withColumns({"status": F.when(ok, "valid").when(bad, "failed").otherwise("pending"), "attempted": ok | bad, "valid": ok}).drop("_valid", "_error")


def coverage(led: DataFrame, by: list[str]) -> DataFrame:
    return led.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if("attempted").alias("n_attempted")).withColumn("share", F.col("n_valid") / F.col("n"))


def manifest(rows: DataFrame, width: int = 3) -> DataFrame:
    """(idx, filename, file_path, license) of rows numbered by idx; names are padded to a minimum width."""
    return rows.select("idx", F.format_string(f"%0{width}d.py", "idx").alias("filename"), "file_path", "license")


def completed(manifest_rows: DataFrame, done: DataFrame) -> DataFrame:
    """Manifest rows of finished files."""
    return manifest_rows.join(done.select("file_path"), "file_path", "left_semi")


def remaining(work: DataFrame, done: DataFrame, key: str = "file_path") -> DataFrame:
    """Work without finished items; failures aren't remembered, so they are tried again."""
    return work.join(done.select(key), key, "left_anti")

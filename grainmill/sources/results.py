"""Results files: JSON objects whose keys name cells and whose values are arrays of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.operators.evaluation import parse_cell_key

ANSWER = "array<struct<raw_output:string, gold:string, pred:string, correct:boolean>>"
NOT_CELLS = ("summary", "parse_failure_rates")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): a whole file a row."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def answers(files: DataFrame) -> DataFrame:
    """One row per answer of each cell; entries that aren't arrays of answers with a raw_output are passed over before
    their type is looked at."""
    entries = files.select("path", F.explode(F.from_json("value", "map<string,variant>")).alias("cell", "v"))
    arrays = entries.where(~F.col("cell").isin(*NOT_CELLS) & F.startswith(F.schema_of_variant("v"), F.lit("ARRAY<")))
    rows = arrays.select("path", "cell", F.posexplode(F.from_json(F.to_json("v"), ANSWER)).alias("pos", "r")).where("r.raw_output is not null")
    where = parse_cell_key(F.col("cell"))
    return rows.select("path", "cell", *(c.alias(n) for n, c in where.items()), F.col("pos").cast("bigint").alias("pos"), "r.*")


def summaries(files: DataFrame) -> DataFrame:
    """(path, cell, acc, count, correct) of summary maps with keys <cell>_acc, _count, _correct."""
    flat = files.select("path", F.explode(F.from_json("value", "map<string,double>")).alias("key", "value"))
    parts = flat.select("path", F.regexp_extract("key", "^(.*)_(acc|count|correct)$", 1).alias("cell"), F.regexp_extract("key", "^(.*)_(acc|count|correct)$", 2).alias("metric"), "value").where("cell != ''")
    return parts.groupBy("path", "cell").pivot("metric", ["acc", "count", "correct"]).agg(F.first("value"))


def canonical(files: DataFrame, key: list[str], dir_seed: Column, name_seed: Column, policy: str = "prefer") -> DataFrame:
    """One file per key. 'prefer': one whose folder and name agree on the seed, else the first by path; 'drop': strays
    go; 'trust': the folder decides, whatever the name says."""
    agree = dir_seed.eqNullSafe(name_seed)
    if policy == "drop":
        files = files.where(agree)
    order = [F.when(agree, 0).otherwise(1), F.col("path")] if policy == "prefer" else [F.col("path")]
    return files.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def with_originals(refined: DataFrame, original: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    """Refined summaries with the original ones: 'left' keeps gaps, 'inner' drops them."""
    return refined.join(original, key, how)


def refined_name(name: Column) -> Column:
    """Name of the refined summary of a results or summary file; other names give null."""
    return F.when(F.regexp_like(name, F.lit(r"_(results|summary)\.json$")), F.regexp_replace(name, r"_(results|summary)\.json$", "_summary_reparsed.json"))


def file_coordinates(path: Column) -> dict[str, Column]:
    """condition and seed of the folder, seed and template of the file's name."""
    return {
        "condition": F.nullif(F.regexp_extract(path, r"([^/]+)/seed-?([A-Za-z0-9]+)/[^/]+$", 1), F.lit("")),
        "dir_seed": F.nullif(F.regexp_extract(path, r"/seed-?([A-Za-z0-9]+)/[^/]+$", 1), F.lit("")),
        "name_seed": F.nullif(F.regexp_extract(path, r"_seed([A-Za-z0-9]+)_[^/]*$", 1), F.lit("")),
        "template": F.nullif(F.regexp_extract(path, r"template(\d+)", 1), F.lit("")),
    }

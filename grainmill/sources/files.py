"""Sources: files and tables as DataFrames, with the fallbacks and guards that ingest needs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from grainmill.functions.text import first_present
from grainmill.operators.sets import first_by, numbered
from grainmill.sources.prefetch import in_order


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files: int = 16) -> DataFrame:
    """A file stream with so many files a micro-batch at most; its checkpoint is the place to resume from."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def with_position(rows: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Rows with their number in a stable order; files alone have none."""
    return numbered(rows, order, name)


def after(rows: DataFrame, position: str, offset: int) -> DataFrame:
    """Resumes past an offset."""
    return rows.where(F.col(position) > offset)


#: Rows handed on at once while blobs are fetched.
HYDRATED = 64


def hydrate(rows: DataFrame, fetch: Callable[[], Callable[[str], bytes | None]], blob: str = "blob_id", encoding: str = "src_encoding", content: str = "content", workers: int = 8) -> DataFrame:
    """Adds the content that fetch()(blob id) yields: unzipped if it is gzip, decoded by its encoding with replacement.
    fetch() builds a client per worker. Each task fetches up to 2 * workers blobs ahead, which finish in any order, and hands
    rows on as they came. Rows that can't be fetched go; rows without a blob id stay, without content."""
    import gzip

    def one(get: Callable[[str], bytes | None], row: tuple) -> tuple:
        *held, key, kind = row
        if not key:
            return (*held, None), True
        try:
            raw = get(key)
            if raw is not None and raw[:2] == b"\x1f\x8b":
                raw = gzip.decompress(raw)
            return (*held, None if raw is None else raw.decode(kind or "utf-8", errors="replace")), raw is not None
        except (OSError, EOFError, LookupError):
            return (*held, None), False

    names = [*rows.columns, content]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken = ((*row, row[at], row[kind]) for frame in frames for row in frame.itertuples(index=False, name=None))
        held = []
        for row, there in in_order(taken, fetch, one, workers):
            if there:
                held.append(row)
            if len(held) >= HYDRATED:
                yield pd.DataFrame(held, columns=names)
                held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    at, kind = rows.columns.index(blob), rows.columns.index(encoding)
    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(content, StringType())]))


def source_files(spark: SparkSession, root: str, glob: str = "*.py", limit: int | None = None) -> DataFrame:
    """(file_path, code, readable) of files below a root: paths relative to it, undecodable ones without code."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), f"^\\Q{base}\\E/+", "")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = raw.select(path.alias("file_path"), text.alias("code"), text.isNotNull().alias("readable"))
    return rows.orderBy("file_path").limit(limit) if limit else rows


def split_file(spark: SparkSession, uri: str, split: str) -> DataFrame | None:
    """A split's table under either of its customary names; a missing split is None, not an error."""
    return next((spark.read.parquet(p) for p in (f"{uri}/{split}-00000-of-00001.parquet", f"{uri}/{split}.parquet") if exists(spark, p)), None)


def first_readable(spark: SparkSession, paths: list[str], read: Callable[[str], DataFrame]) -> DataFrame | None:
    """The first of several places that is there."""
    return next((read(p) for p in paths if exists(spark, p)), None)


def keyed_csv(spark: SparkSession, path: str, key: str, order: str | None = None) -> DataFrame:
    """A CSV (quoted line feeds allowed) with one row per key, the last one; a missing key column is an error."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if key not in rows.columns:
        raise ValueError(f"{path} has no column {key}")
    rows = rows.withColumn("pos", F.col(order) if order else F.monotonically_increasing_id())
    return first_by(rows.withColumn("_last", -F.col("pos")), [key], ["_last"]).drop("_last")


def idx_set(rows: DataFrame, column: str = "idx") -> DataFrame:
    """Whole numbers of a text column; blank and bad ones go."""
    return rows.select(F.trim(column).try_cast("bigint").alias("idx")).where("idx is not null").distinct()


def keep_list(lines: DataFrame, strict: bool = False, line: str = "value") -> DataFrame:
    """Numbers of a list with comments after '#', a '.py' ending allowed. Strict: a bad line or an empty list is an
    error; else bad lines go."""
    plain = F.regexp_replace(F.trim(F.element_at(F.split(F.col(line), "#", 2), 1)), r"\.py$", "")
    rows = lines.select(plain.alias("raw"), plain.try_cast("bigint").alias("idx")).where("raw != ''")
    if strict:
        bad, n = rows.agg(F.count_if(F.col("idx").isNull()), F.count("*")).first()
        if bad or not n:
            raise ValueError(f"{bad} bad lines" if bad else "empty list")
    return rows.where("idx is not null").select("idx").distinct()


def tsv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """Tab-separated values; numbers may carry a plus sign."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    return rows.withColumns({c: signed(F.col(c)) for c in numbers})


def signed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\+", "").try_cast("double")


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read-through: built and written once, then read."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def logical(rows: DataFrame, fields: dict[str, list[str]], defaults: dict[str, object] | None = None) -> DataFrame:
    """Logical fields from the first of several source columns that is neither null nor ''."""
    return rows.select(*(first_present(*(c for c in names if c in rows.columns), default=(defaults or {}).get(field)).alias(field) for field, names in fields.items()))


def listing(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, name) of files below a root whose name matches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.regexp_like("name", F.lit(pattern)))




def local_files(root: str, suffix: str = ".py") -> list[str]:
    """Paths of files below a local root, sorted; links that lead out of it are passed over."""
    base = Path(root).resolve()
    return sorted(str(p) for p in base.rglob(f"*{suffix}") if p.is_file() and p.resolve().is_relative_to(base))

"""A bucketed table in a folder that grows by partitions, and manifests that tell a whole partition from a damaged one.

A join by the bucket key reads such a table without a shuffle, whatever its size, so what comes in by batches moves only
its own rows. Partitions are replaced whole, so a batch that is written again leaves one copy. The catalog entry belongs
to the session; any session that opens the folder makes its own and finds the partitions."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.session import delete, reach
from grainmill.sources.files import exists


class Buckets:
    def __init__(self, spark: SparkSession, path: str, columns: str, key: str, part: str, n: int = 64):
        """columns: DDL without the partition column `part` (bigint); n: buckets, fixed for the life of the folder."""
        reach(spark)
        self.spark, self.path, self.key, self.part, self.n = spark, path.rstrip("/"), key, part, n
        self.columns = [c.strip().split()[0] for c in columns.split(",")]
        self.name = f"buckets_{md5(self.path.encode()).hexdigest()}"
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} ({columns}, {part} BIGINT) USING parquet PARTITIONED BY ({part}) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{self.path}'")
            if exists(spark, self.path):
                spark.catalog.recoverPartitions(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def meet(self, rows: DataFrame) -> DataFrame:
        """Rows dealt as the buckets are, ready to be joined by the key."""
        return rows.repartition(self.n, self.key)

    def replace(self, rows: DataFrame, value: int) -> None:
        """These rows become the partition; no rows leave none."""
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({self.part} = {value})")
        delete(self.spark, f"{self.path}/{self.part}={value}")
        dealt = self.meet(rows.select(*self.columns).withColumn(self.part, F.lit(value).cast("bigint")))
        dealt.write.mode("append").insertInto(self.name)

    def forget(self) -> None:
        """Drops the session's entry; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def checksum(columns: list[str]) -> tuple[Column, Column, Column]:
    """Count, sum and exclusive or of row hashes: equal for equal rows in any order and any number of files."""
    h = F.xxhash64(*columns)
    return F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("total"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("mixed")


class Manifest:
    """A row per partition of a table: its checksums when it was written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def record(self, rows: DataFrame, part: int) -> None:
        rows.agg(*checksum(sorted(rows.columns))).write.mode("overwrite").parquet(f"{self.path}/part={part}")

    def damaged(self, found: DataFrame, part: str) -> list[int]:
        """Partitions of `found`, or recorded ones that it lacks, whose rows are not those recorded."""
        columns = sorted(c for c in found.columns if c != part)
        now = found.groupBy(F.col(part).alias("part")).agg(*checksum(columns))
        was = self.spark.read.schema("n bigint, total decimal(38,0), mixed bigint, part bigint").option("basePath", self.path).parquet(self.path)
        empty = F.lit(0)
        both = was.alias("w").join(now.alias("f"), "part", "full").select("part", *(F.coalesce(F.col(f"{s}.{c}"), empty).alias(f"{s}_{c}") for s in "wf" for c in ("n", "total", "mixed")))
        bad = both.where("w_n <> f_n or w_total <> f_total or w_mixed <> f_mixed")
        return sorted(r["part"] for r in bad.select("part").collect())

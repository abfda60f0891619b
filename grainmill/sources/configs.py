"""Datasets kept by configuration and split, one folder or several files each, as one DataFrame.

Every (config, split) is a branch of a union with its names as literals. A filter on them is folded before anything is
read, so other configurations are not opened; filters on columns, as on a language, are pushed into the files that are.
Both layouts in use are read: `config/split.parquet` or `config/split-00000-of-00002.parquet`, and
`config=x/split=y` as partitioned writes leave it. With a schema, no footer is read while planning."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPLIT = re.compile(r"(?:split=)?([A-Za-z0-9_]+?)(?:-\d+-of-\d+)?(?:\.parquet)?")


def _names(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    named = [(f.getPath().getName(), f.getPath().toString()) for f in found]
    return sorted((n, p) for n, p in named if not n.startswith(("_", ".")))


def splits(spark: SparkSession, root: str) -> dict[tuple[str, str], list[str]]:
    """Paths of each (config, split) below a root."""
    out: dict[tuple[str, str], list[str]] = {}
    for config, folder in _names(spark, root):
        for name, path in _names(spark, folder):
            if m := SPLIT.fullmatch(name):
                out.setdefault((config.removeprefix("config="), m[1]), []).append(path)
    return out


def load(spark: SparkSession, root: str, schema: StructType | str, configs: list[str] | None = None, parts: list[str] | None = None) -> DataFrame:
    """Rows of all (or the named) configurations and splits, with `config` and `split`. Names that are not there are an
    error, as a load of nothing would pass unseen."""
    found = splits(spark, root)
    for wanted, at in ((configs, 0), (parts, 1)):
        if wanted is not None and (lost := sorted(set(wanted) - {k[at] for k in found})):
            raise FileNotFoundError(f"{root} has no {('configuration', 'split')[at]} {', '.join(lost)}")
    some = [(k, p) for k, p in sorted(found.items()) if (configs is None or k[0] in configs) and (parts is None or k[1] in parts)]
    if not some:
        raise FileNotFoundError(f"{root} holds no configuration")
    branches = [spark.read.schema(schema).parquet(*paths).withColumns({"config": F.lit(c), "split": F.lit(s)}) for (c, s), paths in some]
    return reduce(DataFrame.unionByName, branches)


def write(rows: DataFrame, root: str) -> None:
    """A folder per configuration and split, by the columns of these names; rows are dealt so that a split has a few
    files and a large one is spread (`repartition` by both names and a salt would cap the number, AQE balances it)."""
    dealt = rows.hint("rebalance", F.col("config"), F.col("split"))
    dealt.write.mode("overwrite").partitionBy("config", "split").parquet(root)

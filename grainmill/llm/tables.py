"""Input columns of the llm queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainmill.session import table


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))

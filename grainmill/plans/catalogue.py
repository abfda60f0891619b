"""All queries of the engine's own operators, and their SQL.

A query's name starts with the ids of the operators that it applies. Doubles are rounded to 6 places at the very end,
counts are bigints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.plans import corpus_queries, evaluation_queries, report_queries, table_queries

Query = Callable[[SparkSession, str], DataFrame]


def tidy(df: DataFrame) -> DataFrame:
    """Integers as bigint, doubles rounded, no negative zero."""
    cols = []
    for f in df.schema:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        elif kind in ("double", "float", "decimal"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _tidied(query: Query) -> Query:
    return lambda spark, sf_dir: tidy(query(spark, sf_dir))


_ALL = corpus_queries.QUERIES | evaluation_queries.QUERIES | report_queries.QUERIES | table_queries.QUERIES
QUERIES: dict[str, Query] = {name: _tidied(query) for name, (query, _) in _ALL.items()}
ORACLE: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
FLAGSHIP = "a01_f10_funnel"

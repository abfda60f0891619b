"""Queries that SQL expresses, against DuckDB; and all queries on the smallest driver tables."""

import duckdb
import pytest

from grainmill.llm import queries
from tests.test_oracle import DATA, TABLES, table


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, str(DATA)).toPandas(), con.execute(queries.ORACLE[name]).fetchdf()
    assert table(got) == table(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op11_search"}))
def test_one_row_per_input_row(spark, name):
    source = {"op5_embedding_dups": "embeddings", "op6_main_text": "pages"}.get(name, "documents")
    assert queries.QUERIES[name](spark, str(DATA)).count() == spark.read.parquet(f"{DATA}/{source}.parquet").count()

"""Every query with SQL against DuckDB, on the smallest driver tables; the others run and are covered elsewhere."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from grainmill.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, np.ndarray | list):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | float | np.number):
        return round(float(v), 6) + 0.0
    return v


def table(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, str(DATA)).toPandas()
    want = duck.execute(catalogue.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_mappings_match_sql_on_texts_without_words(spark, tmp_path):
    """Texts without an ASCII letter, of one word, empty and null ones, and rows without an id."""
    rows = [(i, t) for i, t in enumerate([x for x in ("Éé", "12 34\n!", "", None, "one", "Éa b", "two words") for _ in range(2)])]
    rows += [(None, "no id here"), (None, "ñ"), (None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = catalogue.QUERIES["x15_strip_mappings"](spark, str(tmp_path)).toPandas(), con.execute(catalogue.ORACLE["x15_strip_mappings"]).fetchdf()
    assert table(got) == table(want)


def on_odd_texts(spark, tmp_path, name, texts):
    """A query's rows and its SQL's, as they are, over documents of these texts."""
    rows = [(i, t, f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLE[name])
    names = [c[0] for c in want.description]
    got = catalogue.QUERIES[name](spark, str(tmp_path)).select(*names).collect()
    return sorted(map(repr, map(tuple, got))), sorted(map(repr, want.fetchall()))


def test_shingles_match_sql_on_texts_without_words(spark, tmp_path):
    got, want = on_odd_texts(spark, tmp_path, "w10_shingles", ["", " ", " \n\n ", None, "\t", "one", "a b c d", " a b\nc  d e ", "a b c d e f"])
    assert got == want


def test_overview_matches_sql_on_empty_and_null_texts(spark, tmp_path):
    """By source: an empty text among others, texts alone, a null text among others, null texts alone."""
    got, want = on_odd_texts(spark, tmp_path, "a38_overview", ["", "abc xyz", None, None, "abcd", "ez", "ab zz", None, " ", "x" * 4000, "e" * 4000, None])
    assert got == want
    assert sum("nan" in row for row in got) == 1

import random

import pytest

CLASH = ["id", "key", "fp", "n", "component", "size", "src", "node", "doc", "tree", "ids"]


def invented(seed: int, n: int) -> str:
    """Invented prose."""
    r = random.Random(seed)
    parts = ["ka", "mo", "ti", "sel", "ra", "un", "ve", "dor", "lin", "pa", "gro", "ste"]
    words = ["".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if r.random() < 0.1 else w for w in words)


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): copies, near copies, blanks, nulls, ties, one long text."""
    texts = [invented(i, 40 + 7 * i) for i in range(24)]
    near = texts[3].split(" ")
    near[10] = "changed"
    texts += [texts[0], texts[0].upper(), " ".join(near), "", " \n\t", None, "one", "One two", "x" * 5000, invented(99, 30_000), "a\n\na\nb" + "\n" + texts[5], texts[5] + " tail."]
    return [(i * 3, t, "en", None if i % 7 == 0 else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    rows = corpus()
    rows += [rows[1], (None, rows[2][1], "en", "src1", 1), (None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame = spark.createDataFrame(rows, schema)
    for c in CLASH:
        from pyspark.sql import functions as F

        frame = frame.withColumn(c, F.lit("clash"))
    return frame.repartition(3).cache()


@pytest.fixture(scope="session")
def plain(spark):
    """The same texts with unique ids and the columns of documents only."""
    return spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

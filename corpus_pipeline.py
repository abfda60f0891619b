"""A corpus pipeline of llm operators: toxicity filter, line dedup, near-dedup, mixing to target weights, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents.
ORACLE_SQL is None: SQL can't express learned scores or merge-dropout. Rows that repeat
an id with another text are documents of their own, and near-dedup keeps one row of each group whatever its id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import lines, mixing, pieces, simhash, toxicity
from grainmill.session import Written, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of this input's documents."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar lines one occurrence stays; n_chars is counted anew."""
    out = lines.dedup(spark, docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (SimHash, then shared shingles for the rest; five-word shingles, similarity
    0.8 or more)."""
    keep = Written(spark)
    whole = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))  # so no column clashes with those here
    rows = keep(docs.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("h"), whole.alias("whole")), "rows")  # written, so a row has one number
    text, doc_id = (F.col(f"whole.c{docs.columns.index(c)}").alias(c) for c in ("text", "doc_id"))
    groups = simhash.near_texts(spark, rows.select("row", text), "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "row"))
    named = keep(rows.select("row", doc_id, "h").join(groups, F.col("row") == F.col("id")).select("row", "doc_id", "h", "component"), "named")
    stay = named.groupBy("component").agg(first["row"].alias("row"))
    gone = keep(named.join(stay, "row", "left_anti").select("row"), "gone")
    keep.only(rows, gone)
    kept = rows.join(F.broadcast(gone) if gone.count() <= simhash.SMALL else gone, "row", "left_anti")
    return kept.select(*(F.col(f"whole.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: a row for each pass over a document, its text cut to what the pass takes, in the
    order of the schedule."""
    return mixing.mixed_documents(spark, docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) with merge-dropout."""
    import public_tokenizers

    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("toxicity", without_toxic), ("line_dedup", without_repeated_lines), ("near_dedup", without_near_copies), ("mixing", mixed), ("pieces", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Written(spark)(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Document fingerprints: a Merkle tree over sections and paragraphs, by DataFrame functions only.

A section is a line with its line ends; its paragraphs (leaves) are runs up to a sentence end, cut after 40 code points
where no sentence ends, so a leaf's borders depend on the text near it alone. A leaf's digest is XXH64 of its text, a
section's digest is SHA-256 of its leaf digests, the root is SHA-256 of the section digests. Equal roots mean equal
texts; where roots differ, `diff` follows differing sections to differing leaves, and the likeness of two trees is the
Dice coefficient of their distinct leaf digests.

Null texts count as empty: an empty text has no sections, one root, and likeness 1 to another empty text. Rows with a
null id sort before all others. Among rows that repeat an id, the one of the smallest root stands for the "next
document" of its predecessor. An empty table gives an empty result. Only the named columns are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.session import Written

SECTION = r"[^\n]*\n+|[^\n]+"
PARAGRAPH = r"[^.!?\n]{1,40}[.!?\n]*|[.!?\n]+"
NO_ID = -(1 << 63)


def _pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tree(text: Column) -> Column:
    """Array of sections, each an array of its leaf digests."""
    return F.transform(_pieces(text, SECTION), lambda s: F.transform(_pieces(s, PARAGRAPH), lambda p: F.xxhash64(p)))


def section_digests(nodes: Column) -> Column:
    return F.transform(nodes, lambda leaves: F.sha2(F.array_join(F.transform(leaves, lambda d: F.hex(d)), ","), 256))


def root(nodes: Column) -> Column:
    return F.sha2(F.array_join(section_digests(nodes), ","), 256)


def leaves(nodes: Column) -> Column:
    return F.array_distinct(F.flatten(nodes))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of distinct leaf digests, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def diff(a: Column, b: Column) -> Column:
    """Places (section, paragraph; from 0) of leaves of tree `a` that tree `b` lacks; sections that `b` has are not
    entered."""
    there, held = section_digests(b), leaves(b)
    entered = F.zip_with(a, section_digests(a), lambda nodes, digest: F.when(F.array_contains(there, digest), F.array().cast("array<bigint>")).otherwise(nodes))
    return F.flatten(
        F.transform(
            entered,
            lambda nodes, s: F.filter(
                F.transform(nodes, lambda d, p: F.struct(s.alias("section"), p.alias("paragraph"), F.array_contains(held, d).alias("same"))),
                lambda x: ~x["same"],
            ),
        )
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, tree) per row."""
    nodes = tree(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), nodes.alias("tree")).select("id", root(F.col("tree")).alias("fingerprint"), "tree")


def successors(ids: DataFrame, keep: Written) -> DataFrame:
    """(key, n, next) of distinct (key, n): the next greater key, and after the last the first. Keys are dealt by range
    and looked at within a range; only one row per range is ordered in one task."""
    ranged = keep(ids.repartitionByRange("key").select("*", F.spark_partition_id().alias("p")), "ranges")
    heads = ranged.groupBy("p").agg(F.min("key").alias("head"))
    heads = heads.select("p", F.lead("head").over(W.orderBy("p")).alias("after"), F.min("head").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("first"))
    near = ranged.withColumn("next", F.lead("key").over(W.partitionBy("p").orderBy("key")))
    return near.join(heads, "p").select("key", "n", F.coalesce("next", "after", "first").alias("next"))


def edits(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against itself edited (its last quarter replaced by the head of the next document)."""
    keep = Written(spark)
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    after = keep(successors(base.groupBy("key").agg(F.max(F.length("text")).alias("n")), keep), "successors")

    trees = base.withColumn("tree", tree(F.col("text"))).select("key", "text", root(F.col("tree")).alias("fp"), leaves(F.col("tree")).alias("leaves"))
    # Both uses of `trees` read the same columns dealt by the same key, so they share one exchange of the texts.
    heads = trees.join(after.select(F.col("next").alias("key"), F.col("key").alias("to"), (F.col("n") / 4).cast("bigint").alias("quarter")), "key")
    heads = heads.groupBy("to").agg(F.min(F.struct("fp", F.expr("substring(text, 1, cast(quarter as int))").alias("head"), "leaves")).alias("next"))
    both = trees.join(heads.select(F.col("to").alias("key"), "next"), "key")
    n = F.length("text")
    kept = (n - F.floor(n / 4)).cast("int")
    edited = F.concat(F.expr("left(text, cast(length(text) - floor(length(text) / 4) as int))"), F.expr("left(next.head, cast(floor(length(text) / 4) as int))"))
    out = both.select("key", n.cast("bigint").alias("n_chars"), "fp", "leaves", "next", kept.alias("kept"), edited.alias("edited"))
    out = out.withColumn("edited_tree", tree(F.col("edited")))
    return out.select(
        F.when(F.col("key") != NO_ID, F.col("key")).alias("id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        root(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), leaves(F.col("edited_tree"))).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next.leaves")).alias("near_next"),
        F.col("next.fp").alias("next_fingerprint"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainmill.llm.tables import documents

    return edits(spark, documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")

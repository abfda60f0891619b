"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share a multiple of all words; a target
stops at `most` times its source's words and the excess is reshared by weight (water filling, in closed form).
Schedule: slot t draws the point frac((t + 1/2) * golden ratio) and maps it through the cumulative targets to a source;
the slots of a source are ranked. Each source takes its target to the word: it has as many slots as its blocks need, of
which the last block may be a part; slots that the points give beyond that go, and slots that they leave out (a few of
a source, as the points are even, or the only one of a small source) follow at the end. Blocks: the documents of a source, shuffled by a keyed hash, form a stream of words
that repeats up to `most` times and is cut into blocks of equal token counts; slot and block meet by (source, rank).
The mix is read in slot order: a document has the first slot that takes words of it, `mixed_documents` comes out sorted by
slot over ranges of slots, and `gaps` tells how far any prefix of the schedule is from the targets.

The number of points is a parameter that sets how fine the schedule is and nothing else: block sizes follow the data, and
the schedule (that many rows, plus a few per source) is the only thing sorted in one task. Positions in a stream are two-level prefix sums over
(source, hash bucket), so a source with a third of all rows is spread over all buckets.

Null texts and texts of white space have size 0, take nothing and lose nothing. Repeated rows are separate documents;
in their source's stream rows of one key go by doc_id, size and text, so the files' layout decides only between equal rows.
A source without words has target 0. An empty table gives empty results. Only doc_id, text and source are read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.session import Written

GOLDEN = (sqrt(5) - 1) / 2
SLOTS = 1 << 17
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """rows: rid, doc_id, src, size; sources: src, source_size, target, slots; schedule: slot, src, rank;
    pieces: slot, src, rank, rid, pass, from_word, to_word (words of the document that the slot takes, half open)."""

    rows: DataFrame
    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame
    block: int


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(src, source_size, weight, target) of (src, source_size); src is 's' and the name, or 'n' for null."""
    order = W.orderBy(F.col("src") == "n", "src")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    everyone = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "src")
    level = (
        ranked.withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everyone) * F.lit(float(share)))
        .withColumn("capped_before", F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("weight_from", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.coalesce("capped_before", F.lit(0.0))) / F.col("weight_from"))
    )
    # The first source, in order of cap by weight, whose cap isn't reached sets the level for all from it on.
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "src", "level"))).over(everyone)
    return level.withColumn("set", first["level"]).select("src", "source_size", "weight", F.when(F.col("set").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("set") * F.col("weight"))).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, slots: int = SLOTS, seed: int = 42, keep: Written | None = None, carry: tuple[str, ...] = ()) -> Mix:
    """`carry` names further columns of docs to keep in `rows`."""
    keep = keep or Written(spark)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    src = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    rows = keep(
        docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", src.alias("src"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), key.alias("key"), F.substring(key, 1, 3).alias("bucket"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"), *carry),
        "sizes",
    )
    buckets = keep(rows.groupBy("src", "bucket").agg(F.sum("size").alias("words")), "buckets")
    goal = keep(targets(buckets.groupBy("src").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")

    total = goal.agg(F.sum("target")).first()[0] or 0.0
    block = max(1, -int(-total // slots))
    n = -int(-total // block)
    upto = W.orderBy(F.col("src") == "n", "src").rowsBetween(W.unboundedPreceding, -1)
    lows = goal.where("target > 0").select(F.coalesce(F.sum("target").over(upto) / F.lit(total or 1.0), F.lit(0.0)).alias("u"), F.lit(-1).cast("bigint").alias("slot"), "src")
    point = (F.col("id") + 0.5) * F.lit(GOLDEN)
    points = spark.range(n).select((point - F.floor(point)).alias("u"), F.col("id").alias("slot"), F.lit(None).cast("string").alias("src"))
    owner = F.last("src", ignorenulls=True).over(W.orderBy("u", "slot").rowsBetween(W.unboundedPreceding, 0))
    drawn = lows.unionByName(points).withColumn("src", owner).where("slot >= 0").select("slot", "src")
    ranked = keep(drawn.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy("slot")).cast("bigint") - 1), "ranked")
    ends = F.least(F.round("target"), F.floor(F.col("source_size") * F.lit(float(most)))).cast("bigint")
    needs = goal.select("src", "source_size", "target", ends.alias("end")).withColumn("slots", F.ceil(F.col("end") / block).cast("bigint"))
    counted = needs.join(ranked.groupBy("src").agg(F.count("*").alias("drawn")), "src", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("bigint"))
    late = counted.where("slots > drawn").select("src", F.explode(F.sequence("drawn", F.col("slots") - 1)).alias("rank"))
    late = late.select((F.row_number().over(W.orderBy("rank", F.col("src") == "n", "src")) - 1 + n).cast("bigint").alias("slot"), "src", "rank")
    schedule = keep(ranked.join(needs.select("src", "slots"), "src").where("rank < slots").select("slot", "src", "rank").unionByName(late), "schedule")
    sources = needs

    before = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.select("src", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset")).join(sources, "src")
    inside = W.partitionBy("src", "bucket").orderBy("key", "doc_id", "size", "tie", "rid").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.select("rid", "doc_id", "src", "bucket", "key", "size", "tie").withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).where("size > 0").join(offsets, ["src", "bucket"])
    passes = F.sequence(F.lit(0).cast("bigint"), F.floor((F.greatest("end", F.lit(1)) - 1) / F.col("source_size")))
    spans = (
        placed.where("end > 0")
        .select("rid", "src", "end", "size", (F.col("start") + F.col("offset")).alias("start"), "source_size", F.explode(passes).alias("pass"))
        .withColumn("lo", F.col("start") + F.col("pass") * F.col("source_size"))
        .withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("end")))
        .where("lo < hi")
        .select("rid", "src", "pass", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))).alias("rank"))
    )
    pieces = spans.join(schedule, ["src", "rank"]).select(
        "slot", "src", "rank", "rid", "pass", (F.greatest("lo", F.col("rank") * block) - F.col("lo")).alias("from_word"), (F.least("hi", (F.col("rank") + 1) * block) - F.col("lo")).alias("to_word")
    )
    return Mix(rows, sources, schedule, pieces, block)


def taken(mixed: Mix) -> DataFrame:
    """(rid, taken, first_slot, n_pieces): words that the mix takes of a row, repeats counted, the first slot that takes
    some, and in how many pieces."""
    return mixed.pieces.groupBy("rid").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_pieces"))


def gaps(mixed: Mix) -> DataFrame:
    """(src, gap): the largest difference, over all prefixes of the schedule, between the slots that a source has and its
    share of them. It is reached where a slot of the source comes or just before, so one pass over its ranks tells."""
    everyone = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shares = mixed.sources.select("src", (F.col("target") / F.sum("target").over(everyone)).alias("share"))
    place = F.row_number().over(W.orderBy("slot")) - 1  # slots that no block needed leave no holes
    at = mixed.schedule.withColumn("place", place).join(shares, "src")
    after, before = F.abs(F.col("rank") + 1 - (F.col("place") + 1) * F.col("share")), F.abs(F.col("rank") - F.col("place") * F.col("share"))
    return at.groupBy("src").agg(F.max(F.greatest(after, before)).alias("gap"))


def _cut(text_at: int):
    """Cuts the text of rows (columns of the documents, first word, end, words of the whole text) and drops the last three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            width = batch.num_columns - 3
            texts = []
            for text, lo, hi, size in zip(*(batch.column(c).to_pylist() for c in (text_at, width, width + 1, width + 2)), strict=True):
                if text and (lo > 0 or hi < size):
                    begin, last = 0, len(text)
                    for k, m in enumerate(word.finditer(text)):
                        if k == lo:
                            begin = m.start()
                        if k == hi - 1:
                            last = m.end()
                            break
                    text = text[begin:last]
                texts.append(text)
            yield batch.select(range(width)).set_column(text_at, batch.schema.field(text_at), pa.array(texts, batch.schema.field(text_at).type))

    return run


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of `docs`: a row for each pass over a document, its text cut to the words
    that the pass takes, in the order of the slots that first take them; rows without words stay as they are, at the end.
    n_chars, if there, is counted anew."""
    keep = Written(spark)
    whole = docs.columns
    source = docs.select("doc_id", "text", "source", F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(whole))).alias("_row"))
    mixed = mix(spark, source, keep=keep, carry=("_row",), **options)
    spans = mixed.pieces.groupBy("rid", "pass").agg(F.min("from_word").alias("lo"), F.max("to_word").alias("hi"), F.min("slot").alias("slot"))
    rows = mixed.rows.select("rid", "size", "_row")
    took = rows.where("size > 0").join(spans, "rid")
    zero = F.lit(0).cast("bigint")
    none = rows.where("size = 0").select("*", zero.alias("pass"), zero.alias("lo"), zero.alias("hi"), F.lit(None).cast("bigint").alias("slot"))
    ordered = took.unionByName(none).orderBy(F.col("slot").asc_nulls_last(), "pass", "rid")
    flat = ordered.select(*(F.col(f"_row.c{i}").alias(f"c{i}") for i in range(len(whole))), "lo", "hi", "size")
    out = flat.mapInArrow(_cut(whole.index("text")), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in whole else out


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_slot is the first slot of the schedule that takes words of the document (null: none does), n_pieces the
    number of its pieces in the mix."""
    from grainmill.llm.tables import documents

    keep = Written(spark)
    mixed = mix(spark, documents(spark, sf_dir, "doc_id", "text", "source"), keep=keep)
    took = taken(mixed)
    return (
        mixed.rows.join(mixed.sources, "src")
        .join(took, "rid", "left")
        .select("doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_slot", F.coalesce("n_pieces", F.lit(0)).cast("bigint").alias("n_pieces"))
    )

"""Target-distribution importance resampling, scored without exploding documents.

Higher-order functions turn each text into the array of its features' hash buckets, written once. Counts per bucket of
the corpus and of the target texts are sums with map-side combine, at most `buckets` rows a task, and they alone are
shuffled by feature. Their log ratios (`buckets` of them, a fixed size) become one literal array, and a document's weight
is the floored mean of its entries at the document's buckets: an aggregate inside the row. A draw without replacement in
proportion to exp(weight / 1000) takes the highest weights after each got Gumbel noise from a keyed hash of its id, so
reruns agree. Ranks are two-level: ranges of scores are numbered apart and offset by the sizes of those before.

Null, empty and wordless texts have no features and weight 0; they count as documents but are too short to be drawn (if
`least` is above 0). Repeated rows are documents of their own, with equal scores and ranks next to each other; ties go to
the smaller id, null ids last (a null id hashes as an empty one). An empty corpus gives an empty result, empty targets give
gains from smoothing alone. Only the named columns are read, and those in `carry` kept."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.text import let
from grainmill.operators.sets import numbered
from grainmill.session import Written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000


def words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased and all else as it is."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def features(held: Column, longest: int = 1) -> Column:
    """All runs of 1 to `longest` consecutive words, joined by one space."""
    if longest == 1:
        return held

    def runs(w: Column, n: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(held, lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: runs(w, n))))


def bucket_array(held: Column, longest: int = 1, buckets: int = BUCKETS) -> Column:
    """Bucket of every feature, repeats kept."""
    return F.transform(features(held, longest), lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))


def counted(bucketed: DataFrame) -> dict[int, int]:
    """Features per bucket: as many entries as there are buckets, at most."""
    rows = bucketed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return {r["bucket"]: r["n"] for r in rows.collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """1000 times the smoothed log ratio of a bucket's share of the target to its share of the corpus, floored."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def weight_of(bucketed: Column, gain: list[int]) -> Column:
    """Floored mean of the gains at these buckets, 0 without any. The literal is folded into one array by the optimizer."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate(bucketed, F.lit(0).cast("bigint"), lambda acc, b: acc + F.element_at(table, b + 1))
    n = F.size(bucketed).cast("bigint")
    return let(total, lambda t: F.when(n > 0, ((t - F.pmod(t, n)) / n).cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def noise(ident: Column, seed: str) -> Column:
    """1000 times a standard Gumbel draw, floored, keyed by seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(
    spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    buckets: int = BUCKETS, longest: int = 1, least: int = 20, percent: int = 10, seed: str = "2024", carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, n_features, n_words, weight, score, rank, and `carried`, a struct, if asked for) per row of docs; rank is null
    unless the row is drawn: floor(percent / 100 * N) of the N rows of `least` words or more are."""
    keep = Written(spark)
    extra = [F.struct(*carry).alias("carried")] if carry else []
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), words(F.col(text_col)).alias("words"), *extra)
    held = keep(texts.select("id", F.size("words").alias("n_words"), bucket_array(F.col("words"), longest, buckets).alias("buckets"), *(["carried"] if carry else [])), "buckets")
    aim = target.select(bucket_array(words(F.col(target_col)), longest, buckets).alias("buckets"))
    gain = gains(counted(held), counted(aim), buckets)

    weighed = held.select("id", F.size("buckets").cast("bigint").alias("n_features"), F.col("n_words").cast("bigint").alias("n_words"), weight_of(F.col("buckets"), gain).alias("weight"), *(["carried"] if carry else []))
    scored = keep(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumns({"_low": -F.col("score"), "_none": F.col("id").isNull()}), "scored")
    keep.drop(held)

    able = scored.where(F.col("n_words") >= least)
    drawn = percent * able.count() // 100
    ranked = numbered(able, ["_low", "_none", "id"], "_at")
    ranked = ranked.withColumn("rank", F.when(F.col("_at") < drawn, F.col("_at") + 1)).drop("_at")
    rest = scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).drop("_low", "_none")


def drawn_documents(spark: SparkSession, docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, with its columns."""
    out = resample(spark, docs, target, carry=tuple(docs.columns), **options)
    return out.where("rank is not null").select("carried.*")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainmill.llm.tables import documents
    from grainmill.session import table

    out = resample(spark, documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")

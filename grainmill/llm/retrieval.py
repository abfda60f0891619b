"""Ranked lexical search: dual-sorted wavelet trees per shard, exact top-k.

Build: documents become rows of distinct terms with counts, written once; their totals give the corpus statistics and the
number of shards (so many postings a shard), and rows are dealt to shards at random, so a hot source or long documents
spread. A task turns one shard into a wavelet tree of its postings, lists in order of falling impact, and a lexicon with
the range of each term. Within a shard documents are numbered by their commonest term and their length, so
that alike documents share subtrees and bounds are tight. Search: the queries' terms meet the lexicon, which gives document
frequencies and ranges; each (shard, block of queries) is then one search of bounded size, and the shards' best k rows meet
in a top-k per query. Only statistics reach the driver.

The score is a sum over a query's distinct terms of weight * impact in 64-bit integers: impact = (10^9 tf) div
(1000 tf + k1 m), m = 100 - b + (b n N) div L, weight = floor(1000 ln((2N + 2) / (2df + 1))).

Null and empty texts, and texts without terms, are not documents of the statistics and are never found. Queries without
known terms have no rows. Repeated rows are documents (or queries) of their own. Ties go to the smaller id, null ids last.
Empty tables give empty results. Only the named columns are read."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.llm import wavelet
from grainmill.llm.words import pack, release, slices, unpack
from grainmill.session import Written, new_path

#: Letters and digits of ASCII and all bytes of other characters.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Postings and documents of a shard, about; queries of a block.
POSTINGS, DOCUMENTS, BLOCK = 2_000_000, 1 << 17, 256
TERMS = "id bigint, n bigint, terms array<string>, counts array<int>"
FOUND = "query bigint, id bigint, score bigint"


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        held = [Counter(TERM.findall(t.encode("utf-8", "surrogatepass").lower())) if t else {} for t in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
        terms = pa.array([w for h in held for w in h], pa.binary()).cast(pa.string())
        counts = np.fromiter((c for h in held for c in h.values()), np.int32, int(ends[-1]))
        n = [sum(h.values()) for h in held]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(counts))], names=["id", "n", "terms", "counts"])


def terms_of(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts): the distinct terms of each text, their counts, and the sum of those."""
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(_terms, TERMS)


@dataclass
class Index:
    """Table below `path`: a row per (shard, term) with the range lo .. hi, and one per shard with its tree."""

    spark: SparkSession
    path: str
    documents: int
    tokens: int
    shards: int

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        about = spark.read.parquet(f"{path}/about").first()
        return Index(spark, path, about["documents"], about["tokens"], about["shards"])

    def _table(self) -> DataFrame:
        return self.spark.read.schema("shard int, term string, lo bigint, hi bigint, tree binary").parquet(f"{self.path}/shards")

    def lexicon(self) -> DataFrame:
        return self._table().where("term is not null").select("shard", "term", "lo", "hi")

    def trees(self) -> DataFrame:
        return self._table().where("tree is not null").select("shard", "tree")


def impacts_of(counts: np.ndarray, n: np.ndarray, documents: int, tokens: int, k1: int, b: int) -> np.ndarray:
    m = 100 - b + (b * n * documents) // tokens
    return (1_000_000_000 * counts) // (1000 * counts + k1 * m)


def _shard(documents: int, tokens: int, k1: int, b: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        lists = group.column("terms").combine_chunks()
        size = pc.list_value_length(lists).to_numpy()
        coded = lists.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        term = rank[coded.indices.to_numpy()]
        counts = group.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
        n = group.column("n").to_numpy()

        owner = np.repeat(np.arange(len(n)), size)
        top = np.maximum.reduceat(counts, np.cumsum(size) - size)
        is_top = counts == top[owner]
        commonest = np.full(len(n), len(order), np.int64)
        np.minimum.at(commonest, owner[is_top], term[is_top])
        number = np.empty(len(n), np.int64)
        by = np.lexsort((n, commonest))
        number[by] = np.arange(len(n))

        impact = impacts_of(counts, n[owner], documents, tokens, k1, b)
        doc = number[owner]
        sort = np.lexsort((doc, -impact, term))
        ends = np.cumsum(np.bincount(term, minlength=len(order)))
        ids = group.column("id")
        none = ids.is_null().to_numpy()[by].astype(np.uint8)
        held = ids.fill_null(0).to_numpy()[by]
        tree = _framed(wavelet.build(doc[sort], impact[sort], len(n)), pack(held, none))
        shard = group.column("shard")[0].as_py()
        names = coded.dictionary.take(pa.array(order))
        rows = len(order)
        out = pa.table(
            {
                "shard": pa.array([shard] * (rows + 1), pa.int32()),
                "term": pa.concat_arrays([names, pa.nulls(1, pa.string())]),
                "lo": pa.array([*np.concatenate([[0], ends[:-1]]).tolist(), None], pa.int64()),
                "hi": pa.array([*ends.tolist(), None], pa.int64()),
                "tree": pa.concat_arrays([pa.nulls(rows, pa.binary()), pa.array([tree], pa.binary())]),
            }
        )
        release()
        return out

    return run


def _framed(tree: bytes, ids: bytes) -> bytes:
    return len(tree).to_bytes(8, "little") + tree + ids


def _unframed(blob: bytes) -> tuple[wavelet.Tree, np.ndarray, np.ndarray]:
    end = 8 + int.from_bytes(blob[:8], "little")
    ids, none = unpack(blob[end:])
    return wavelet.Tree(blob[8:end]), ids, none.astype(bool)


def build(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, postings: int = POSTINGS, k1: int = 20, b: int = 50) -> Index:
    """k1 in tenths and b in hundredths of the usual parameters (20 is 2.0, 50 is 0.5)."""
    keep, path = Written(spark), (path or new_path(spark, "index")).rstrip("/")
    rows = keep(terms_of(docs, id_col, text_col).where("n > 0"), "terms")
    total = rows.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    shards = max(1, -(-total["postings"] // postings), -(-total["documents"] // DOCUMENTS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    made = dealt.groupBy("shard").applyInArrow(_shard(total["documents"], total["tokens"], k1, b), "shard int, term string, lo bigint, hi bigint, tree binary")
    made.write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/shards")
    about = {"documents": total["documents"], "tokens": total["tokens"], "shards": shards}
    spark.createDataFrame([about], "documents bigint, tokens bigint, shards bigint").write.mode("overwrite").parquet(f"{path}/about")
    keep.drop(rows)
    return Index(spark, path, **about)


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(asked: pa.Table, trees: pa.Table) -> pa.Table:
        if not asked.num_rows or not trees.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        tree, ids, none = _unframed(trees.column("tree")[0].as_py())
        names, query = np.unique(asked.column("query").to_numpy(), return_inverse=True)
        key = np.empty(len(ids), np.int64)
        key[np.lexsort((ids, none))] = np.arange(len(ids))
        q, score, doc = wavelet.search(tree, query, *(asked.column(c).to_numpy() for c in ("weight", "lo", "hi")), key, k)
        out = pa.table({"query": names[q], "id": pa.array(ids[doc], mask=none[doc]), "score": score})
        del tree
        release()
        return out

    return run


def search(spark: SparkSession, index: Index, queries: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 50, block: int = BLOCK) -> DataFrame:
    """(item, rank, id, score): for each row of `queries` its k best documents with a score above 0."""
    keep = Written(spark)
    items = keep(terms_of(queries, item_col, text_col).select(F.monotonically_increasing_id().alias("query"), F.col("id").alias("item"), "terms"), "queries")
    blocks = max(1, -(-items.count() // block))
    asked = items.select("query", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), F.explode("terms").alias("term"))
    found = keep(index.lexicon().join(asked.select("term").distinct(), "term"), "ranges")
    n = F.lit(float(2 * index.documents + 2))
    weights = found.groupBy("term").agg(F.floor(1000 * F.log(n / (2 * F.sum(F.col("hi") - F.col("lo")) + 1))).cast("bigint").alias("weight"))
    ranges = asked.join(weights, "term").join(found, "term").where("weight > 0").select("shard", "block", "query", "weight", "lo", "hi")
    trees = index.trees().select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "tree")
    best = ranges.groupBy("shard", "block").cogroup(trees.groupBy("shard", "block")).applyInArrow(_search(k), FOUND)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.col("id").isNull(), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(items.select("query", "item"), "query").select("item", "rank", "id", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainmill.llm.tables import documents
    from grainmill.session import table

    out = search(spark, build(spark, documents(spark, sf_dir)), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")

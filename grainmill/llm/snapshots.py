"""Exact dedup over immutable snapshots that static binary-fuse filters screen.

Each batch becomes a snapshot: a lean table of its rows, its distinct texts in exact buckets (a table bucketed by digest),
and one filter per shard of the digests that no older snapshot holds. A new batch is grouped within itself: a group
is a minimum with map-side combine, so copies meet as one row per task. Its distinct digests then go to the shards of older
filters, one row each; what a filter lets through joins that snapshot's bucket, bytes against bytes, and links to it if
they are equal. Nothing is written to an older snapshot, and its texts are shuffled once, when they come in.

Texts are equal when identical without the characters of `[\\x20\\x09-\\x0D]`. Equality is always settled on bytes: rows of a
batch whose digests are equal but whose texts are not (the least and the greatest text of a digest differ) are numbered as
variants of that digest, so results are exact for any digest; the default is SHA-256.

Null texts count as empty, and all blank texts are equal. Of equal texts the longest original stays, then the smallest id,
null ids last; of rows that agree in all that, the first by row number. Empty tables give empty results. Only the named
columns are read, so others may clash."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.llm import fuse
from grainmill.session import Written, delete, new_path, reach

BLANK = r"[\x20\x09-\x0D]+"
#: Digests in a shard of a filter: what one task builds at once.
SHARD = 1 << 18


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _build(group: pa.Table) -> pa.Table:
    blob = fuse.build(group.column("key").to_numpy())
    return pa.table({"shard": group.column("shard")[:1], "blob": pa.array([blob], pa.binary())})


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (snapshot, shard), the filter first, so a task holds one filter at a time."""
    at, blob = None, None
    for batch in batches:
        snapshot, shard = (batch.column(c).to_numpy() for c in (0, 1))
        key = batch.column(2).fill_null(0).to_numpy()
        keep = np.zeros(len(key), bool)
        cuts = np.nonzero((np.diff(snapshot) != 0) | (np.diff(shard) != 0))[0] + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
            if at != (place := (int(snapshot[lo]), int(shard[lo]))):
                at, blob = place, None
            if batch.column(4)[lo].is_valid:
                blob, lo = batch.column(4)[lo].as_py(), lo + 1
            if blob is not None and lo < hi:
                keep[lo:hi] = fuse.probe(blob, key[lo:hi])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["snapshot", "digest"]).filter(pa.array(keep))


class Archive:
    """Snapshots below a shared folder. Another session opens the same folder and goes on with the next batch."""

    def __init__(self, spark: SparkSession, path: str | None = None, digest: Callable[[Column], Column] = sha256, shard: int = SHARD):
        self.spark, self.path, self.digest, self.shard = spark, (path or new_path(spark, "archive")).rstrip("/"), digest, shard
        reach(spark)
        self.snapshots: list[dict] = []
        from grainmill.sources.files import exists

        while exists(spark, f"{self.path}/{len(self.snapshots)}/about/_SUCCESS"):
            self.snapshots.append(spark.read.parquet(f"{self.path}/{len(self.snapshots)}/about").first().asDict())
            self._register(len(self.snapshots) - 1)

    def _at(self, k: int, what: str) -> str:
        return f"{self.path}/{k}/{what}"

    def _name(self, k: int) -> str:
        return f"exact_{md5(self.path.encode()).hexdigest()}_{k}"

    def _register(self, k: int) -> None:
        if not self.spark.catalog.tableExists(self._name(k)):
            n = self.snapshots[k]["buckets"]
            self.spark.sql(f"CREATE TABLE {self._name(k)} (digest BINARY, variant INT, text STRING, mixed BOOLEAN) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{self._at(k, 'texts')}'")

    def _texts(self, k: int) -> DataFrame:
        return self.spark.table(self._name(k))

    def _read(self, what: str, upto: int | None = None) -> DataFrame:
        """A table of all snapshots, or of those before one."""
        n = len(self.snapshots) if upto is None else upto
        return self.spark.read.parquet(*(self._at(k, what) for k in range(n)))

    def _write(self, rows: DataFrame, k: int, what: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._at(k, what))
        return self.spark.read.schema(rows.schema).parquet(self._at(k, what))

    def _store(self, texts: DataFrame, k: int, n: int, mode: str) -> None:
        texts.write.format("parquet").mode(mode).bucketBy(n, "digest").sortBy("digest").option("path", self._at(k, "texts")).saveAsTable(self._name(k))

    def add(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """One batch becomes the next snapshot. One that failed half-way is written anew when added again."""
        k, keep = len(self.snapshots), Written(self.spark)
        base = batch.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("n_chars"), normalised(F.col(text_col)).alias("text"))
        rows = base.withColumn("digest", self.digest(F.col("text")))
        # As many buckets as the aggregate has partitions: each task then writes whole buckets, without another shuffle.
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        least, most = F.min("text"), F.max("text")
        found = rows.groupBy("digest").agg(least.alias("text"), (least != most).alias("mixed"))
        self._store(found.select("digest", F.lit(0).alias("variant"), "text", "mixed"), k, buckets, "overwrite")
        mixed = self._texts(k).where("mixed").select("digest")
        rows = rows.withColumn("variant", F.lit(0))
        if mixed.limit(1).count():
            number = F.row_number().over(W.partitionBy("digest").orderBy("text")) - 1
            odd = keep(rows.join(mixed, "digest", "left_semi").select("digest", "text").distinct().withColumn("variant", number), "variants")
            self._store(odd.where("variant > 0").select("digest", "variant", "text", F.lit(False).alias("mixed")), k, buckets, "append")
            rows = rows.drop("variant").join(odd, ["digest", "text"], "left").withColumn("variant", F.coalesce("variant", F.lit(0)))
        members = rows.select(F.lit(k).alias("snapshot"), F.monotonically_increasing_id().alias("row"), "id", "n_chars", "digest", "variant")
        self._write(members, k, "members")

        links = self._write(self._links(k, keep), k, "links")
        fresh = keep(links.where(F.col("root") == k).select("digest").distinct().select(F.xxhash64("digest").alias("key")), "fresh")
        shards = max(1, -(-fresh.count() // self.shard))
        filters = fresh.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_build, "shard int, blob binary")
        self._write(filters.select(F.lit(k).alias("snapshot"), "shard", "blob"), k, "filters")
        about = {"buckets": buckets, "shards": shards}
        self.spark.createDataFrame([about], "buckets int, shards int").write.mode("overwrite").parquet(self._at(k, "about"))
        self.snapshots.append(about)
        keep.drop(fresh)

    def positives(self, digests: DataFrame) -> DataFrame:
        """(snapshot, digest) that the snapshots' filters let through, of distinct digests."""
        key = F.xxhash64("digest")
        dealt = [digests.select(F.lit(s).alias("snapshot"), F.pmod(key, F.lit(a["shards"])).cast("int").alias("shard"), key.alias("key"), "digest", F.lit(None).cast("binary").alias("blob")) for s, a in enumerate(self.snapshots)]
        both = self._read("filters").select("snapshot", "shard", F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("binary").alias("digest"), "blob")
        for some in dealt:
            both = both.unionByName(some)
        sent = both.repartition("snapshot", "shard").sortWithinPartitions("snapshot", "shard", F.col("blob").isNull())
        return sent.mapInArrow(_screen, "snapshot int, digest binary")

    def _links(self, k: int, keep: Written) -> DataFrame:
        """(snapshot, digest, variant, root, root_variant): the snapshot that first held each distinct text of batch k."""
        mine = self._texts(k)
        hits = None
        if self.snapshots:
            passed = keep(self.positives(mine.select("digest").distinct()), "positives")
            for s in range(len(self.snapshots)):
                old = self._texts(s).select("digest", F.col("variant").alias("root_variant"), F.col("text").alias("old"))
                some = mine.join(passed.where(F.col("snapshot") == s).select("digest"), "digest", "left_semi").join(old, "digest").where("text = old").select("digest", "variant", F.lit(s).alias("root"), "root_variant")
                hits = some if hits is None else hits.unionByName(some)
        if hits is None:
            return mine.select(F.lit(k).alias("snapshot"), "digest", "variant", F.lit(k).alias("root"), F.col("variant").alias("root_variant"))
        first = hits.groupBy("digest", "variant").agg(F.min(F.struct("root", "root_variant")).alias("r"))
        out = mine.select("digest", "variant").join(first, ["digest", "variant"], "left")
        return out.select(F.lit(k).alias("snapshot"), "digest", "variant", F.coalesce("r.root", F.lit(k)).alias("root"), F.coalesce("r.root_variant", "variant").alias("root_variant"))

    def decisions(self) -> DataFrame:
        """(id, keep_id, group_size, kept, digest) per row of all batches. Only ids, lengths and digests are shuffled."""
        if not self.snapshots:
            return self.spark.createDataFrame([], "id bigint, keep_id bigint, group_size bigint, kept boolean, digest binary")
        members, links = self._read("members"), self._read("links")
        text, root = ["snapshot", "digest", "variant"], ["root", "digest", "root_variant"]
        best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("none"), "id", "snapshot", "row"))
        own = members.groupBy(*text).agg(F.count("*").alias("n"), best.alias("best")).join(links, text)
        total = own.groupBy(*root).agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
        found = links.join(total, root).select(*text, "group_size", "best")
        kept = (F.col("best.snapshot") == F.col("snapshot")) & (F.col("best.row") == F.col("row"))
        return members.join(found, text).select("id", F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), "digest")

    def drop(self) -> None:
        for k in range(len(self.snapshots)):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(k)}")
        delete(self.spark, self.path)
        self.snapshots = []


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, **options) -> DataFrame:
    """Decisions for one table, taken in as so many batches by a hash of the id; the archive goes, the result is written."""
    archive = Archive(spark, **options)
    for b in range(batches):
        archive.add(docs.where(F.pmod(F.xxhash64(id_col), F.lit(batches)) == b), id_col, text_col)
    out = Written(spark)(archive.decisions(), "decisions")
    archive.drop()
    return out


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainmill.llm.tables import documents

    out = dedup(spark, documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))

"""Token-ID output: documents encoded with a public tokenizer into Simple-8b shard files, and read back.

Texts are dealt by ranges of doc_id and sorted inside a range, so shard k holds the k-th range and shards end to end
are in ascending doc_id order (nulls first; repeated ids ordered by text). A task encodes and writes its shard in
runs of blocks, under a name of its own attempt; the manifest, written when all tasks have ended, lists the names
that count, so retried or speculative tasks leave nothing that is read. Readers get the manifest alone.

A null or empty text is one end id. Repeated rows are repeated documents. An empty table gives an empty result. Only
the named columns are read."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.llm.simple8b import Reader, Writer
from grainmill.llm.words import Numbering, Ragged, slices, sums_by
from grainmill.session import Written, new_path

END = 1
#: Distinct chunks remembered by a Python worker, a bound on its memory only.
REMEMBERED = 1_000_000
#: Words encoded by one call; their ids are told apart by the word-end mark.
TOGETHER = 512
#: A full stop or comma after a letter is a chunk of its own to the tokenizer as well. The mark comes first, as it is what is searched for.
STOP = re.compile(rb"([.,])(?<=[a-z].)(?=[\x20\x09-\x0D]|$)")
#: A capital that a mark may follow: the tokenizer composes the two before it lowers case.
MARKED = re.compile(rb"[A-Z][\x80-\xff]")


class ChunkEncoder:
    """Encodes texts by their white-space-free chunks, each distinct chunk once. The tokenizer drops white space before
    it merges and lowers case, so a text's ids are those of its chunks, and chunks of ASCII may have A-Z lowered, as may
    others where nothing can join a capital. Texts that may hold a special token (they match by case) are cut at white
    space only."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.known, self.ids = Numbering(), Ragged(np.uint32)
        self.known[b""] = 0  # no chunk is empty: 0 is the end of a text
        self.ids.extend([[END]])

    def _learn(self, chunks: list[bytes]) -> None:
        texts = [c.decode() for c in chunks]
        lens = np.zeros(len(texts), np.int64)
        found: list[tuple[list[int], np.ndarray]] = []  # places of chunks, and their ids end to end
        words = [i for i, t in enumerate(texts) if t.isalpha()]
        rest = [i for i, t in enumerate(texts) if not t.isalpha()]
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts[i] for i in some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.nonzero(self.ends[ids])[0] + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                lens[some] = np.diff(ends, prepend=0)
                found.append((some, ids))
            else:  # a word that the tokenizer cuts
                rest += some
        runs = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)]
        lens[rest] = [len(r) for r in runs]
        found.append((rest, np.array([i for r in runs for i in r], np.uint32)))
        starts, flat = np.cumsum(lens) - lens, np.zeros(int(lens.sum()), np.uint32)
        for at, ids in found:
            n = lens[at]
            flat[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        self.ids.add(flat, lens)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each text's followed by END, and their counts."""
        if len(self.known) > REMEMBERED:
            self._reset()
        chunks: list[bytes] = []
        sizes = []
        for text in texts:
            if raw := text.encode() if text else b"":
                if b"<|" not in raw:
                    raw = b" ".join([c.lower() if c.isascii() else c for c in raw.split()]) if not raw.isascii() and MARKED.search(raw) else raw.lower()
                    raw = STOP.sub(rb" \1", raw)
                chunks += raw.split()
            chunks.append(b"")
            sizes.append(len(chunks))
        numbers = self.known.numbers(chunks)
        self._learn(self.known.take_fresh())
        ids, lens = self.ids.gather(numbers)
        return ids, sums_by(lens, np.diff(sizes, prepend=0))


_encoders: dict[str, ChunkEncoder] = {}


def encoder_of(path: str) -> ChunkEncoder:
    """One per Python worker and file: what it has learned serves the worker's next tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: Written | None = None) -> DataFrame:
    """Writes shard files below `folder` (default: the shared folder); returns their manifest
    (shard, path, n_docs, n_ids)."""
    folder = folder or new_path(spark, "tokens")
    keep = keep or Written(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        system, where = _filesystem(folder)
        encoder = writer = out = None
        path = f"{where}/shard-{shard:06d}-{task.taskAttemptId()}.s8b"
        for batch in slices(batches):
            if writer is None:
                system.create_dir(where, recursive=True)
                out = system.open_output_stream(path)
                encoder, writer = encoder_of(tokenizer), Writer(out)
            ids, counts = encoder(batch.column(1).to_pylist())
            writer.add(batch.column(0).to_pylist(), counts, ids.astype(np.uint64))
        if writer is not None:
            total = writer.close()
            out.close()
            row = [[shard], [path], [len(writer.doc_ids)], [total]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["shard", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    return keep(ranged.mapInArrow(run, "shard bigint, path string, n_docs bigint, n_ids bigint"), "manifest").withColumn("folder", F.lit(folder))


def read_tokens(spark: SparkSession, manifest: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from shard files; with `digest`, ids_crc32 in place of the ids. start counts the
    ids of all documents before; the manifest has one row per shard, so its running sum is small."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    shards = manifest.withColumn("start", F.coalesce(before, F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, folder in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "folder")), strict=True):
                system, _ = _filesystem(folder)
                with system.open_input_file(path) as file:
                    reader = Reader(file, file.size())
                    rows: list[tuple] = []
                    for doc_id, ids in reader.documents():
                        small = ids.astype("<u4")
                        rows.append((doc_id, start, len(ids), zlib.crc32(small.tobytes()) if digest else small.astype(np.int64)))
                        start += len(ids)
                        if len(rows) == 1024:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        last = pa.int64() if digest else pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), last), strict=True)], names=["doc_id", "start", "n_tokens", name])

    name = "ids_crc32" if digest else "ids"
    return shards.select("shard", "path", "start", "folder").repartitionByRange(n, "shard").mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {name} {'bigint' if digest else 'array<bigint>'}")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from grainmill.llm.tables import documents

    manifest = write_tokens(spark, documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, manifest, digest=True)

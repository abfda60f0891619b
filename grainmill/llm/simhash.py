"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint has 64 bits, 8 positional bytes. Two fingerprints that differ in at most k < 8 bits share at least
8 - k positional bytes, so the index posts each fingerprint under combinations of its positional bytes (a prefix of
the positions is enough), tallies the positional bytes that a pair shares, keeps pairs that reach 8 - k and verifies
them. Links are found in two passes that together lose none and emit no group's pairs:

1. every posting list links its members to its smallest member (a star, linear in the list);
2. lists whose members are still in different components are joined with themselves across components only.

Near copies of texts (`near_texts`) are found by this index first, then by shared shingles of prefixes for the rest.

Empty, null and one-word texts have fingerprints like any other; equal fingerprints are one node, so copies cost
nothing. Ties and repeated rows collapse into that node; rows with a null id take the component of their fingerprint
but never name it. An empty table gives an empty result. Only the named columns are read, so others may clash."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.components import components
from grainmill.llm.words import pack, release, slices, steps_of, unpack, words_of
from grainmill.session import Written

BYTES = 8
#: Shingles whose bits are counted at once, to bound memory for texts of any length.
CHUNK = 1 << 16


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Runs of `width` words joined by a space; fewer words give the whole sequence, none give nothing."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    return [joined[i:j] for i, j in zip((ends - lens)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def hashes(items: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, seed) for x in items], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; no hashes give 0. Signed, as Spark's bigint is."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) of every row; fp is the SimHash of all word shingles of the whole text, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(hashes(shingles(words_of(t), width), seed)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, fp bigint")


def _byte(x: Column, p: int) -> Column:
    return F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255))


def _shared(x: Column, y: Column) -> Column:
    """Tally of the positional bytes that two fingerprints share."""
    diff = x.bitwiseXOR(y)
    return sum(((_byte(diff, p) == 0).cast("int") for p in range(1, BYTES)), (_byte(diff, 0) == 0).cast("int"))


def _combos(min_shared: int, width: int = 3) -> list[tuple[int, ...]]:
    """Position sets to post under: a pair sharing min_shared of all positions shares `width` of this prefix."""
    width = min(width, min_shared)
    return list(combinations(range(BYTES - (min_shared - width)), width))


#: Arrays of keys, one key a node, or pairs of keys and the places of their nodes. Binary columns come as lists.
Keys = Callable[[dict[str, np.ndarray]], Iterator[np.ndarray | tuple[np.ndarray, np.ndarray]]]
#: Bytes of a key in a column of marks, and what sets such keys apart from others.
MARK, MARKED = 5, 1 << 41
#: Keys of open lists by which pairs that share several are told.
LEAST = 8
#: Nodes whose postings a task deals out at once, and postings that it matches at once.
DEALT, MATCHED = 1 << 16, 1 << 20


def marks_of(keys: np.ndarray) -> bytes:
    """The high bits of 64-bit hashes, MARK bytes each."""
    return (keys >> np.uint64(64 - 8 * MARK)).view(np.uint8).reshape(-1, 8)[:, :MARK].tobytes()


def by_marks(marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Posting keys of a column of marks, and the place of each key's node."""
    held = np.frombuffer(b"".join(marks), np.uint8).reshape(-1, MARK)
    keys = np.zeros((len(held), 8), np.uint8)
    keys[:, :MARK] = held
    return keys.view(np.int64)[:, 0] + MARKED, np.repeat(np.arange(len(marks)), [len(m) // MARK for m in marks])


def by_bytes(fps: list[str], min_shared: int) -> tuple[Keys, Callable[[str, str], Column]]:
    """Posting keys and pair test of the byte-position index over the fingerprint columns `fps`."""
    combos = _combos(min_shared)

    def keys(nodes: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
        for f, name in enumerate(fps):
            places = nodes[name].view(np.uint8).reshape(-1, BYTES).astype(np.int64)
            for c, combo in enumerate(combos):
                key = np.full(len(places), f * len(combos) + c, np.int64)
                for p in combo:
                    key = (key << 8) | places[:, p]
                yield key

    def enough(x: str, y: str) -> Column:
        some = F.lit(False)
        for name in fps:
            some = some | (_shared(F.col(x + name), F.col(y + name)) >= min_shared)
        return some

    return keys, enough


def blobs(key: np.ndarray, node: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, data): postings dealt by a hash of their key; data is their keys and node ids."""
    part = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    part = (part % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((key, part))
    key, node, part = key[order], node[order], part[order]
    cuts = np.searchsorted(part, np.arange(parts + 1))
    some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
    data = [pack(steps_of(key[cuts[p] : cuts[p + 1]].view(np.uint64)), node[cuts[p] : cuts[p + 1]]) for p in some]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])


def shares(spark: SparkSession) -> int:
    """Parts that postings are dealt to."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def posted(spark: SparkSession, nodes: DataFrame, prints: list[str], keys: Keys) -> DataFrame:
    """Dealt postings of nodes (id, prints), by the tasks that hold them. keys gives posting keys from arrays of
    the prints, an array per posting."""
    return nodes.select("id", *prints).mapInArrow(_deal(prints, keys, shares(spark)), "part int, data binary")


def _deal(prints: list[str], keys: Keys, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blobs of the postings of many nodes at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            nodes = {name: c.to_pylist() if pa.types.is_binary(c.type) else np.ascontiguousarray(c.to_numpy(), np.int64) for name in prints for c in [table.column(name)]}
            ids = table.column("id").to_numpy()
            posted = [p if isinstance(p, tuple) else (p, slice(None)) for p in keys(nodes)]
            return blobs(np.concatenate([k for k, _ in posted]), np.concatenate([ids[at] for _, at in posted]), parts)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= DEALT:
                yield out()
        if held:
            yield out()
        release()

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) of postings whose key has more than one node. Held are one head per key and a run of postings, so a list of
    any length streams through: its head goes out with the first posting that meets it. A node that is posted again under
    its key goes out once per run, and not as its own company."""
    heads = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]  # key, node, has gone out

    def settle(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        nonlocal heads
        key = np.concatenate([np.cumsum(h[0], dtype=np.uint64).view(np.int64) for h in held])
        node = np.concatenate([h[1] for h in held])
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (node[1:] == node[:-1])
        if len(heads[0]):
            at = np.minimum(np.searchsorted(heads[0], key), len(heads[0]) - 1)
            again |= (heads[0][at] == key) & (heads[1][at] == node)
        key, node = key[~again], node[~again]
        first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        distinct = key[first]
        at = np.minimum(np.searchsorted(heads[0], distinct), max(len(heads[0]) - 1, 0))
        known = heads[0][at] == distinct if len(heads[0]) else np.zeros(len(distinct), bool)
        met = known | (size > 1)
        goes = np.repeat(met, size)
        late = at[known][~heads[2][at[known]]] if known.any() else np.zeros(0, np.int64)
        out = np.concatenate([key[goes], heads[0][late]]), np.concatenate([node[goes], heads[1][late]])
        heads[2][late] = True
        fresh = ~known
        merged = [np.concatenate([old, new]) for old, new in zip(heads, (distinct[fresh], node[first][fresh], (size > 1)[fresh]), strict=True)]
        order = np.argsort(merged[0], kind="stable")
        heads = [m[order] for m in merged]
        return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["key", "id"])

    held, n = [], 0
    for batch in batches:
        for blob in batch.column(1):
            held.append(unpack(blob.as_py()))
            n += len(held[-1][1])
            if n >= MATCHED:
                yield settle(held)
                held, n = [], 0
    if held:
        yield settle(held)
    release()


def links(spark: SparkSession, nodes: DataFrame, dealt: DataFrame, near: Callable[[str, str], Column], verify: Callable[[DataFrame, Written], DataFrame] | None = None, keep: Written | None = None, known: DataFrame | None = None, take: Callable[[DataFrame], None] | None = None, match: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = _match) -> DataFrame:
    """(node, component) of nodes joined by verified links.

    nodes: id bigint, unique, and what near reads, written to a table; dealt: their postings, as blobs. Pairs that share a
    key are candidates if near(prefix a, prefix b) holds on their columns; verify, if given, filters pairs (a, b) further.
    known: (node, component) linked already, of which no pair within a component is looked at again. take is given
    the members of lists (key, id, ..) before pairs are verified; match turns blobs into (key, id) of lists. Tables written on
    the way are removed as soon as they are read."""
    keep, own = keep or Written(spark), Written(spark)
    cols = nodes.columns
    if known is not None:
        nodes = nodes.join(known.withColumnRenamed("component", "was"), nodes.id == known.node, "left").select(*cols, F.coalesce("was", "id").alias("was"))
        cols = nodes.columns

    def paired(left: DataFrame, right: DataFrame, on: Column, name: str) -> DataFrame:
        found = left.join(right, on & near("x_", "y_"))
        out = own(found.select(F.greatest("x_id", "y_id").alias("a"), F.least("x_id", "y_id").alias("b")).distinct(), name)
        if not verify or not out.limit(1).count():
            return out
        used = Written(spark)
        true = own(verify(out, used), f"{name}-verified")
        used.only()
        own.drop(out)
        return true

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))

    members = own(dealt.repartition(shares(spark) // 2, "part").mapInArrow(match, "key bigint, id bigint").join(nodes, "id").select("key", *cols), "members")
    if take:
        take(members)
    heads = members.groupBy("key").agg(F.min(F.struct("id", *(c for c in cols if c != "id"))).alias("h"), F.count("*").alias("size"))
    apart = F.col("x_was") != F.col("y_was") if known is not None else F.col("x_id") != F.col("y_id")
    edges = paired(named(members, "x_"), named(heads.select("key", "h.*"), "y_"), (F.col("x_key") == F.col("y_key")) & apart, "stars")
    if known is not None:
        edges = edges.unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
    found = components(spark, edges, own)

    # A list of two was settled by its star; any longer one that still holds two components is compared across them.
    longer = members.join(heads.where("size > 2").select("key"), "key", "left_semi")
    marked = own(longer.join(found, longer.id == found.node, "left").select("key", *cols, F.coalesce("component", "id").alias("component")), "marked")
    own.drop(members)
    mixed = marked.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    open_lists = own(marked.join(mixed, "key", "left_semi").distinct(), "open")
    own.drop(marked)
    once = F.lit(True)
    if verify:  # a pair under several keys is wanted once: under the least of those that are among the first keys of both
        some = open_lists.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LEAST).alias("least"))
        open_lists = own(open_lists.join(some, "id"), "open-keys")
        once = F.coalesce(F.array_min(F.array_intersect("x_least", "y_least")), F.col("x_key")) >= F.col("x_key")
    x, y = named(open_lists, "x_"), named(open_lists, "y_")
    second = paired(x, y, (F.col("x_key") == F.col("y_key")) & (F.col("x_component") < F.col("y_component")) & once, "across")
    out = keep(components(spark, edges.unionByName(second), own) if second.limit(1).count() else found, "links")
    own.only()
    return out


def _close(x: str, y: str, max_bits: int) -> Column:
    return F.bit_count(F.col(f"{x}fp").bitwiseXOR(F.col(f"{y}fp"))) <= max_bits


def hamming_components(spark: SparkSession, fps: DataFrame, max_bits: int = 4, keep: Written | None = None) -> DataFrame:
    """(fp, component) of distinct fingerprints: links at <= max_bits differing bits; component is the smallest
    non-null id reachable. `fps`: (id, fp), read more than once, so written to a table."""
    if not 0 <= max_bits < BYTES:
        raise ValueError("a byte-position index guarantees shared bytes only below 8 differing bits")
    keep = keep or Written(spark)
    nodes = keep(fps.groupBy("fp").agg(F.min("id").alias("id")).where("id is not null"), "nodes").select("id", "fp")
    keys, enough = by_bytes(["fp"], BYTES - max_bits)
    found = links(spark, nodes, posted(spark, nodes.repartition(shares(spark) // 2, "id"), ["fp"], keys), lambda x, y: enough(x, y) & _close(x, y, max_bits), keep=keep)
    return nodes.join(found, nodes.id == found.node, "left").select("fp", F.coalesce("component", "id").alias("component"))


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """One row per row of `docs`: (id, fp, component)."""
    keep = Written(spark)
    fps = keep(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    found = hamming_components(spark, fps, max_bits, keep)
    return fps.join(found, "fp", "left").select("id", "fp", "component")


# -- near-duplicate texts by shingle similarity, for pipelines ------------------------------------------------------


#: Cells that count how common shingles are, and shares that they are summed in.
CELLS, SHARES = 1 << 22, 64


def _shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; equal shingles have equal ones."""
    words = hashes(words_of(text), 0)
    if not len(words):
        return words
    h = np.zeros(max(1, len(words) - width + 1), np.uint64)
    for k in range(min(width, len(words))):
        h = (h ^ words[k : k + len(h)]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return np.unique(h * np.uint64(0x94D049BB133111EB))


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(42)).astype(np.int64)


def _commonness(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """For each cell, the power of two up to which its shingles are counted, in texts. The table has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in slices(batches):
            cells += np.bincount(np.concatenate([_cell(_shingle_hashes(t, width)) for t in batch.column(0).to_pylist()]), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SHARES), pa.int32()), pa.array([pack(c) for c in np.split(cells, SHARES)], pa.binary())], names=["share", "cells"])

    def total(group: pa.Table) -> pa.Table:
        cells = sum(unpack(b.as_py())[0] for b in group.column("cells"))
        return pa.table({"share": group.column("share")[:1], "cells": pa.array([pack(np.ceil(np.log2(cells + 1)).astype(np.uint8))], pa.binary())})

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "share int, cells binary").groupBy("share").applyInArrow(total, "share int, cells binary")
    levels = np.zeros((SHARES, CELLS // SHARES), np.uint8)
    for r in parts.collect():
        levels[r.share] = unpack(bytes(r.cells))[0]
    return levels.reshape(-1)


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float, levels) -> DataFrame:
    """(id, key, n, fp, marks, tally): key identifies the sequence of words, n counts distinct shingles, fp is their SimHash as
    `fingerprints` makes it, marks are those of the prefix: the n - ceil(threshold * n) + 1 shingles that come first, rare ones before common ones. Two sets whose
    Jaccard similarity reaches the threshold share one, whatever the order is, as long as it is the same for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for t in batch.column(1).to_pylist():
                h = _shingle_hashes(t, width)
                first = h[np.argsort(levels.value[_cell(h)], kind="stable")[: len(h) - int(np.ceil(threshold * len(h) - 1e-9)) + 1]]
                words = words_of(t)
                rows.append([xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63), len(h), fingerprint(hashes(shingles(words, 4), 42)), marks_of(first), tally(h)])
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True))], names=["id", "key", "n", "fp", "marks", "tally"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, key bigint, n bigint, fp bigint, marks binary, tally binary")


#: Ids of texts to verify that are broadcast at most; beyond, they are joined by shuffle.
SMALL = 200_000
#: Cells of a byte that the shingles of one text are counted in.
TALLY = 128


def tally(h: np.ndarray) -> bytes:
    """How many of a text's distinct shingles fall into each cell, up to 255."""
    return np.minimum(np.bincount((h >> np.uint64(57)).astype(np.int64), minlength=TALLY), 255).astype(np.uint8).tobytes()


def _may_link(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (a, b, p, m, q, n), tallies and counts of shingles, the pairs (a, b) that may reach the threshold. Tallies differ by no
    more than the sets do, and those of a link by (1 - threshold) / (1 + threshold) of both sizes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, TALLY).astype(np.int16) for c in (2, 4))
            both = batch.column(3).to_numpy() + batch.column(5).to_numpy()
            apart = np.abs(p - q).sum(1, dtype=np.int64)
            yield batch.select([0, 1]).filter(pa.array(apart <= (1 - threshold) / (1 + threshold) * both + 1e-6, pa.bool_()))

    return run


def _jaccard_filter(docs: DataFrame, tallies: DataFrame, id_col: str, text_col: str, width: int, threshold: float) -> Callable[[DataFrame, Written], DataFrame]:
    """Filters pairs by their shingle sets; tallies (id, n, tally) tell most of the others apart before texts are read."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = [np.unique(hashes(shingles(words_of(t), width), 0)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], names=["id", "held"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= threshold * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def verify(pairs: DataFrame, keep: Written) -> DataFrame:
        x, y = (tallies.select(F.col("id").alias(end), F.col("tally").alias(t), F.col("n").alias(n)) for end, t, n in (("a", "p", "m"), ("b", "q", "n")))
        pairs = keep(pairs.join(x, "a").join(y, "b").select("a", "b", "p", "m", "q", "n").mapInArrow(_may_link(threshold), "a bigint, b bigint"), "likely")
        named = keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "named")
        few = F.broadcast(named) if named.count() <= SMALL else named
        texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(few, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(sets, "id bigint, held binary")
        full = pairs.join(texts.select(F.col("id").alias("a"), F.col("held").alias("p")), "a").join(texts.select(F.col("id").alias("b"), F.col("held").alias("q")), "b")
        return full.select("a", "b", "p", "q").mapInArrow(test, "a bigint, b bigint")

    return verify


def near_texts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, max_bits: int = 4) -> DataFrame:
    """(id, component) per row: groups of texts linked by a Jaccard similarity of word shingles >= threshold.

    SimHashes that differ in at most max_bits bits are found first, by the byte-position index. For links that SimHash
    doesn't see, texts of different groups so far are candidates if they share a shingle of their prefixes, which no link
    lacks. Every candidate of either index is verified on its shingle sets, unless counts of its shingles tell that it is no link.
    Texts of equal words are one node. Rows with a null id keep a null component unless their words equal those of a row
    with one. Null and empty texts are one node, as they have equal (no) words."""
    keep = Written(spark)
    levels = spark.sparkContext.broadcast(_commonness(docs, text_col, width))
    rows = keep(_sketches(docs, id_col, text_col, width, threshold, levels), "sketches")
    nodes = keep(rows.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("marks").alias("marks"), F.first("tally").alias("tally")).where("id is not null"), "nodes")
    named = keep(rows.select("id", "key"), "keys")
    keep.drop(rows)

    def near(x: str, y: str) -> Column:
        return F.least(F.col(x + "n"), F.col(y + "n")) >= F.greatest(F.col(x + "n"), F.col(y + "n")) * threshold

    def keys(nodes: dict[str, list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield by_marks(nodes["marks"])

    verify = _jaccard_filter(docs, nodes.select("id", "n", "tally"), id_col, text_col, width, threshold)
    by_fp, enough = by_bytes(["fp"], BYTES - max_bits)
    close = links(spark, nodes.select("id", "n", "fp"), posted(spark, nodes, ["fp"], by_fp), lambda x, y: enough(x, y) & _close(x, y, max_bits) & near(x, y), verify, keep)
    found = links(spark, nodes.select("id", "n"), posted(spark, nodes, ["marks"], keys), near, verify, keep, known=close)
    groups = nodes.join(found, nodes.id == found.node, "left").select("key", F.coalesce("component", "id").alias("component"))
    out = keep(named.join(groups, "key", "left").select("id", "component"), "groups")
    keep.only(out)
    return out


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainmill.llm.tables import documents

    out = near_duplicates(spark, documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))



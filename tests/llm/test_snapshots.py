"""Exact dedup by snapshots, filters and buckets against a brute-force version."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill.llm import fuse, snapshots


def weak(text):
    """A digest of two bits, so that nearly all texts collide."""
    return F.unhex(F.lpad(F.hex(F.pmod(F.length(text), F.lit(4))), 2, "0"))


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", "", t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        best = min(g)
        out.append((i, None if best[1] else best[2], len(g)))
    return sorted(out, key=str)


def decided(frame):
    return sorted(((r["id"], r["keep_id"], r["group_size"]) for r in frame.collect()), key=str)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=400), st.lists(st.integers(-(2**63), 2**63 - 1), max_size=50))
def test_filters_miss_no_key(keys, others):
    blob = fuse.build(np.array(keys, np.int64))
    assert fuse.probe(blob, np.array(keys, np.int64)).all()
    passed = fuse.probe(blob, np.array(others, np.int64))
    assert all(passed[i] for i, o in enumerate(others) if o in set(keys))


def test_filters_let_one_in_256_pass_and_take_few_bytes():
    r = np.random.default_rng(3)
    keys, others = (r.integers(-(2**63), 2**63 - 1, n) for n in (50_000, 200_000))
    blob = fuse.build(keys)
    assert fuse.probe(blob, keys).all() and 0.5 / 256 < fuse.probe(blob, others).mean() < 2 / 256
    assert len(blob) < 1.25 * len(keys)


@pytest.mark.parametrize("batches", [1, 3])
@pytest.mark.parametrize("digest", [snapshots.sha256, weak])
def test_equals_brute_force(spark, docs, batches, digest):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = snapshots.dedup(spark, docs, batches=batches, digest=digest)
    assert decided(got) == brute(rows)
    kept = [r for r in got.collect() if r["kept"]]
    assert len(kept) == len({norm(t) for _, t in rows}) and all(r["id"] == r["keep_id"] for r in kept)


def test_sha256_is_of_the_normalised_text(spark, docs):
    want = {(r.doc_id, hashlib.sha256(norm(r.text).encode()).digest()) for r in docs.select("doc_id", "text").collect()}
    assert {(r["id"], bytes(r["digest"])) for r in snapshots.dedup(spark, docs).collect()} == want


def test_ties_hot_groups_and_repeated_rows(spark):
    hot = [(i, "a  b" if i == 700 else "a b" if i % 2 else "ab") for i in range(900)]
    rows = [*hot, (7, "a b"), (7, "a b"), (None, "a   b"), (3, None), (4, " \n"), (5, "c")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = snapshots.dedup(spark, frame)
    assert decided(got) == brute(rows)
    assert sum(r["kept"] for r in got.collect()) == 3
    same = spark.createDataFrame([(1, "x y")] * 5, "doc_id bigint, text string")
    assert [sum(r["kept"] for r in snapshots.dedup(spark, same).collect()), snapshots.dedup(spark, same).first()["group_size"]] == [1, 5]


def test_archive_goes_on_in_another_session(spark, docs, empty, tmp_path):
    path = f"file://{tmp_path}/archive"
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    snapshots.Archive(spark, path).add(docs)
    before = sorted(p for p in tmp_path.rglob("*.parquet"))
    spark.catalog.dropTempView("none")
    spark.sql(f"DROP TABLE {snapshots.Archive(spark, path)._name(0)}")  # a new session has no such table
    again = snapshots.Archive(spark, path)
    assert len(again.snapshots) == 1
    again.add(docs.where("doc_id % 2 = 0"))
    again.add(empty)
    assert decided(again.decisions()) == brute(rows + [r for r in rows if r[0] is not None and r[0] % 2 == 0])
    assert set(before) <= set(tmp_path.rglob("*.parquet"))  # older snapshots are never written to
    links = spark.read.parquet(f"{path}/1/links")
    assert links.where("root = 1").count() == 0


def test_filters_decide_what_is_compared(spark, tmp_path):
    first = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], "doc_id bigint, text string")
    archive = snapshots.Archive(spark, f"file://{tmp_path}/archive", shard=500)
    archive.add(first)
    assert archive.snapshots[0]["shards"] == 6
    digests = spark.range(2990, 9000).select(snapshots.sha256(snapshots.normalised(F.concat(F.lit("text "), "id"))).alias("digest"))
    passed = archive.positives(digests).count()
    assert 10 <= passed < 10 + 6000 / 256 * 2


def test_empty_tables(spark, empty):
    assert snapshots.dedup(spark, empty).count() == 0
    assert snapshots.Archive(spark).decisions().count() == 0

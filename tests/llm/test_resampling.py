"""Importance resampling against a brute-force version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grainmill.llm import resampling

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, aims, buckets=10_000, longest=1, least=20, percent=10, seed="2024"):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    held = [(i, *runs(t, longest)) for i, t in rows]
    s = Counter(place(f) for _, _, fs in held for f in fs)
    t = Counter(place(f) for a in aims for f in runs(a, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in s}
    out = []
    for i, w, fs in held:
        weight = sum(gain[place(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return out


def table(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("options", [{}, {"longest": 3, "buckets": 64, "percent": 50}, {"least": 0, "percent": 100, "seed": "7"}])
def test_equals_brute_force(spark, docs, options):
    aims = spark.createDataFrame([("Ka mo TI selra, un-ve dor! año Ñandú",), (None,), ("",), ("ka ka ka",)], "text string")
    got = resampling.resample(spark, docs, aims, **options).drop("carried")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, [r.text for r in aims.collect()], **options)
    assert got.columns == ["id", "n_features", "n_words", "weight", "score", "rank"]
    assert table(got.collect()) == table(want)


def test_repeats_ties_and_empty_tables(spark, docs, empty):
    aims = spark.createDataFrame([], "text string")
    text = " ".join(f"w{i}" for i in range(30))
    same = spark.createDataFrame([(5, text)] * 4 + [(None, text)] * 3 + [(9, "short")], "doc_id bigint, text string")
    got = resampling.resample(spark, same, aims, percent=100).collect()
    assert sorted(r["rank"] for r in got if r["n_words"] >= 20) == list(range(1, 8))
    assert [r["rank"] for r in got if r["id"] == 9] == [None]
    assert resampling.resample(spark, empty, aims).count() == 0
    again = resampling.resample(spark, same.repartition(3), aims, percent=100).collect()
    assert table(got) == table(again)


def test_drawn_documents_keep_clashing_columns_and_the_target_moves_the_draw(spark):
    rows = [(i, " ".join((["near"] if i % 2 else ["far"]) * 25 + [f"w{i}"]), "a", "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string, buckets string")
    aims = spark.createDataFrame([("near " * 500,)], "text string")
    got = resampling.drawn_documents(spark, docs, aims)
    assert got.columns == docs.columns and got.count() == 40
    assert got.where(F.col("doc_id") % 2 == 1).count() > 35


def test_gains_are_one_literal(spark):
    frame = spark.range(1).select(F.array(F.lit(0), F.lit(2)).alias("b")).repartition(2)
    got = frame.select(resampling.weight_of(F.col("b"), [-3, 5, 0]).alias("w"))
    assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.first()["w"] == -2

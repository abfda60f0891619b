"""The near-dedup index over batches: equal to one run in order, linear in hot bands, repaired from its manifest."""

import random

import pytest
from pyspark.sql import functions as F

from grainmill.operators import dedup, near_index
from grainmill.session import Written
from grainmill.sources.buckets import Manifest


def records(spark, n=120):
    r = random.Random(5)
    base = [[f"w{r.randrange(500)}" for _ in range(60)] for _ in range(25)]
    rows = []
    for i in range(n):
        words = list(base[r.randrange(25)])
        for _ in range(r.randrange(4)):
            words[r.randrange(60)] = f"x{r.randrange(9)}"
        rows.append((i, [] if i % 17 == 0 else words))
    return spark.createDataFrame(rows, "i bigint, t array<string>")


def brute(signatures):
    """First wins over whole band lists, one record after another."""
    taken, out = [], {}
    for i, sig in signatures:
        mine = {(b, tuple(sig[b * 9 : b * 9 + 9])) for b in range(14)} if sig else set()
        met = [o for o, theirs in taken if mine & theirs]
        out[i] = (not met, min(met, default=i))
        if not met:
            taken.append((i, mine))
    return out


@pytest.mark.parametrize("single", [0, 10**6])
def test_batches_equal_one_run_and_brute_force(spark, tmp_path, single):
    rows = records(spark)
    want = brute([(r.i, r.signature) for r in dedup.minhash(rows, "i", "t").orderBy("i").collect()])
    index = near_index.NearIndex(spark, f"file://{tmp_path}/near", 4, single)
    got = {}
    for k in range(3):
        for _ in range(1 + (k == 1)):  # the second batch is given twice
            part = index.add(rows.where(F.floor(F.col("i") / 50) == k), k, "i", "t").collect()
        got |= {r["order"]: (r["accepted"], r["cluster"]) for r in part}
    assert got == want
    assert {r.i: (r.accepted, r.cluster) for r in dedup.near(spark, rows, "i", "t").collect()} == want


def test_a_batch_does_not_shuffle_the_index(spark, tmp_path):
    index = near_index.NearIndex(spark, f"file://{tmp_path}/near", 4)
    index.add(records(spark), 0, "i", "t")
    joined = index.index.meet(spark.range(9).select(F.col("id").alias("band"))).hint("merge").join(index.index.read(), "band")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_work_is_linear_in_a_hot_band(spark):
    n = 4000
    entries = spark.range(n).select(F.col("id").alias("order"), F.explode(F.array(F.lit(7), F.col("id") + 100, F.floor(F.col("id") / 2) + 10**6)).alias("band"))
    keep = Written(spark)
    made = []
    inner = keep.__call__
    counted = lambda df, name: (made.append((name, (out := inner(df, name)).count())), out)[1]

    class Counting:
        drop = staticmethod(lambda df: None)
        __call__ = staticmethod(counted)

    assert [r.order for r in near_index.settle(entries, Counting(), 0).collect()] == [0]
    assert sum(c for _, c in made) < 5 * n


def test_damage_is_found_and_only_that_is_built_anew(spark, tmp_path):
    rows = records(spark)
    index = near_index.NearIndex(spark, f"file://{tmp_path}/near", 4)
    decided = [index.add(rows.where(F.floor(F.col("i") / 40) == k), k, "i", "t").collect() for k in range(3)]
    whole = sorted(map(tuple, index.index.read().collect()))
    assert index.damaged() == []
    torn = next((tmp_path / "near/bands/batch=1").glob("*.parquet"))
    torn.unlink()
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "near/bands/batch=0").iterdir()}
    assert index.damaged() == [1]
    with pytest.raises(ValueError, match="batch 1"):
        index.rebuild(rows.where("i = 41"), 1, "i", "t")
    accepted = [r["order"] for r in decided[1] if r["accepted"]]
    index.rebuild(rows.where(F.col("i").isin(accepted)), 1, "i", "t")
    assert index.damaged() == [] and sorted(map(tuple, index.index.read().collect())) == whole
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "near/bands/batch=0").iterdir()} == untouched


def test_manifest_tells_order_from_content(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 7).alias("v"), F.lit(3).cast("bigint").alias("p"))
    m = Manifest(spark, f"file://{tmp_path}/m")
    m.record(rows.drop("p"), 3)
    assert m.damaged(rows.repartition(5), "p") == []
    for bad in (rows.where("id <> 4"), rows.unionByName(rows.where("id = 4")), rows.withColumn("v", F.when(F.col("id") == 4, 9).otherwise(F.col("v"))), rows.limit(0)):
        assert m.damaged(bad, "p") == [3]

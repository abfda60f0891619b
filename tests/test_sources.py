"""Look-ahead, rate over tasks, configurations and splits, language detection."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from grainmill.operators import batches, language
from grainmill.sources import configs, files
from grainmill.sources.prefetch import in_order

DATA = "/root/testdata/sf0.01"


# -- look-ahead ----------------------------------------------------------------------------------------------------------


def test_results_keep_their_order_and_the_window_is_bounded():
    taken, running, most, lock = [], [0], [0], threading.Lock()

    def items():
        for i in range(60):
            taken.append(i)
            yield i

    def call(_, i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.03 if i % 4 == 0 else 0.001)
        with lock:
            running[0] -= 1
        return i

    for got, want in zip(in_order(items(), lambda: None, call, workers=3), range(60), strict=True):
        assert got == want and len(taken) <= got + 6
    assert most[0] == 3


def test_calls_overlap_and_workers_have_their_own_clients():
    began = time.monotonic()
    owners = list(in_order(range(40), object, lambda client, _: (time.sleep(0.02), id(client))[1], workers=8))
    assert time.monotonic() - began < 0.6 and 1 < len(set(owners)) <= 8
    assert list(in_order([], object, lambda c, x: x)) == []


def test_an_error_comes_in_its_turn_and_stops_the_rest():
    done = []

    def call(_, i):
        if i == 5:
            raise ValueError("five")
        done.append(i)
        return i

    got = []
    with pytest.raises(ValueError, match="five"):
        for x in in_order(range(1000), lambda: None, call, workers=2):
            got.append(x)
    assert got == [0, 1, 2, 3, 4] and len(done) < 20


def test_hydrate_skips_failed_fetches_and_keeps_order(spark):
    rows = spark.range(300).select(F.when(F.col("id") % 50 != 7, F.concat(F.lit("b"), "id")).alias("blob_id"), F.lit("utf-8").alias("src_encoding"), "id").coalesce(2)

    def fetch():
        def get(key):
            n = int(key[1:])
            if n % 10 == 3:
                raise OSError("lost")
            time.sleep(0.002 if n % 7 else 0.02)
            return f"text {n}".encode()

        return get

    got = [(r.id, r.content) for r in files.hydrate(rows, fetch, workers=4).collect()]
    assert got == [(i, None if i % 50 == 7 else f"text {i}") for i in range(300) if i % 10 != 3]


# -- rate ----------------------------------------------------------------------------------------------------------------


def test_slots_of_tasks_never_meet():
    for now, last in ((1000.0, 0.0), (1000.01, 1000.0), (1000.49, 1000.49)):
        slots = sorted(batches.next_slot(now, last, t, 4, 0.1) for t in range(4))
        assert all(b - a > 0.099 for a, b in zip(slots, slots[1:], strict=False)) and slots[0] >= now - 1e-6 and slots[0] > last - 1e-6
    at, seen = 50.0, []
    for _ in range(5):  # a task that is never late uses each of its turns
        at = batches.next_slot(at, at, 1, 2, 0.25)
        seen.append(at)
    assert [round(b - a, 6) for a, b in zip(seen, seen[1:], strict=False)] == [0.5] * 4


def test_gap_holds_over_all_tasks(spark):
    rows = spark.range(16).select(F.concat(F.lit("f"), "id").alias("file_path"), F.lit("x").alias("code"))
    got = batches.translate(rows, lambda: lambda _: repr(time.time()), gap=0.2, tasks=3).withColumn("task", F.spark_partition_id()).collect()
    at = sorted(float(r.output) for r in got)
    assert len(at) == 16 and len({r.task for r in got}) == 3
    assert min(b - a for a, b in zip(at, at[1:], strict=False)) > 0.1  # the gap, less the time that a call takes to begin


# -- configurations and splits ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('configs')}"
    rows = spark.range(200).select("id", F.when(F.col("id") % 2 == 0, "en").otherwise("es").alias("lang"), F.concat(F.lit("c"), F.col("id") % 3).alias("config"), F.when(F.col("id") % 10 == 0, "validation").otherwise("train").alias("split"))
    configs.write(rows, path)
    return path


SCHEMA = "id bigint, lang string"


def test_split_files_are_written_and_read(spark, root):
    assert set(configs.splits(spark, root)) == {(f"c{i}", s) for i in range(3) for s in ("train", "validation")}
    got = {(r.id, r.config, r.split) for r in configs.load(spark, root, SCHEMA).collect()}
    assert got == {(i, f"c{i % 3}", "validation" if i % 10 == 0 else "train") for i in range(200)}
    assert configs.load(spark, root, SCHEMA, ["c1"], ["validation"]).count() == sum(i % 3 == 1 for i in range(0, 200, 10))
    with pytest.raises(FileNotFoundError, match="c9"):
        configs.load(spark, root, SCHEMA, ["c9"])


def test_other_configurations_are_not_opened_and_filters_are_pushed(spark, root):
    some = configs.load(spark, root, SCHEMA).where("config = 'c1' and lang = 'es'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "config=c0" not in plan and "EqualTo(lang,es)" in plan
    from pathlib import Path

    broken = [p for p in Path(root.removeprefix("file://")).glob("config=c2/*/*.parquet")]
    for p in broken:
        p.rename(p.with_suffix(".kept"))
        p.write_bytes(b"no parquet")
    assert some.count() == sum(i % 3 == 1 and i % 2 == 1 for i in range(200))
    for p in broken:
        p.with_suffix(".kept").rename(p)


def test_numbered_files_of_a_split(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "one").mkdir()
    for k in range(2):
        pq.write_table(pa.table({"id": [k], "lang": ["en"]}), tmp_path / f"one/train-0000{k}-of-00002.parquet")
    pq.write_table(pa.table({"id": [7], "lang": ["ur"]}), tmp_path / "one/test.parquet")
    got = {(r.id, r.config, r.split) for r in configs.load(spark, f"file://{tmp_path}", SCHEMA).collect()}
    assert got == {(0, "one", "train"), (1, "one", "train"), (7, "one", "test")}


# -- language ------------------------------------------------------------------------------------------------------------


def test_held_out_accuracy_by_language(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text", language.buckets("text").alias("buckets")).cache()
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language.train(rows.where(~out))
    told = rows.where(out & F.col("buckets").isNotNull()).withColumn("told", model.detect("buckets"))
    by = {r.lang: r.right for r in told.groupBy("lang").agg(F.avg((F.col("told") == F.col("lang")).cast("double")).alias("right")).collect()}
    assert set(by) == {"de", "en", "es", "fr"} and min(by.values()) > 0.9
    assert rows.select(model.detect("buckets").alias("x"), F.length("text").alias("n")).where("n < 50 and x is not null").count() == 0


def test_short_texts_ties_and_empty_models(spark):
    rows = spark.createDataFrame([("a", "w" * 60), ("b", "w" * 60), (None, "zz " * 40), ("a", "short"), ("a", None), ("a", "1 2 3 " * 20)], "lang string, text string").select("lang", "text", language.buckets("text").alias("buckets"))
    told = [r[0] for r in rows.select(language.train(rows).detect("buckets")).collect()]
    assert told[:2] == ["a", "a"] and told[3:] == [None, None, None]
    none = language.train(rows.limit(0))
    assert none.languages == [] and rows.select(none.detect("buckets").alias("x")).where("x is not null").count() == 0

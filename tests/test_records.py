"""Record files, progress tables, bootstrap and McNemar."""

import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from grainmill.operators import bootstrap
from grainmill.sources import files, records
from grainmill.streaming import progress


# -- one file per record ---------------------------------------------------------------------------------------------------


def listed(path):
    return sorted(p.name for p in path.rglob("*") if p.is_file() and "files" in p.parts)


def rows_of(spark, n, first=0):
    return spark.range(first, first + n).select(F.format_string("%09d_r.py", "id").alias("name"), F.concat(F.lit("code ñ "), "id").alias("content"), (F.col("id") * 2).alias("stars"), F.lit(None).cast("string").alias("license")).repartition(3)


def test_files_and_sidecars_appear_together(spark, tmp_path):
    records.register(spark)
    uri = f"file://{tmp_path}/out"
    for first in (0, 20):
        rows_of(spark, 20, first).write.format(records.NAME).option("path", uri).mode("append").save()
    assert listed(tmp_path / "out") == [f"{i:09d}_r.py" for i in range(40)]
    meta = {p.name: json.loads(p.read_text()) for p in (tmp_path / "out").rglob("*.json")}
    assert meta["000000007_r.py.json"] == {"name": "000000007_r.py", "stars": 14, "license": None}
    assert next((tmp_path / "out").rglob("000000007_r.py")).read_text() == "code ñ 7"
    assert len(list((tmp_path / "out").glob("job-*"))) == 2 and not list((tmp_path / "out/_staging").iterdir())
    lines = [x for p in (tmp_path / "out").rglob("metadata.csv") for x in p.read_text().splitlines()[1:]]
    assert len(lines) == 40
    rows_of(spark, 3).write.format(records.NAME).option("path", uri).mode("overwrite").save()
    assert listed(tmp_path / "out") == [f"{i:09d}_r.py" for i in range(3)]


def test_failed_job_leaves_nothing(spark, tmp_path):
    records.register(spark)
    bad = rows_of(spark, 30).withColumn("content", F.when(F.col("stars") == 40, F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format(records.NAME).option("path", f"file://{tmp_path}/out").mode("append").save()
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="name and content"):
        spark.range(2).write.format(records.NAME).option("path", f"file://{tmp_path}/out").mode("append").save()


def test_retried_task_leaves_one_copy(tmp_path):
    writer = records.RecordWriter(f"file://{tmp_path}/out", StructType.fromDDL("name string, content string"), False)
    rows = [{"name": "a", "content": "x"}, {"name": "b", "content": None}]
    lost, won = writer.write(iter(rows)), writer.write(iter(rows))  # the first attempt's executor went
    assert lost.folder != won.folder
    writer.commit([won, None])
    assert listed(tmp_path / "out") == ["a", "b"]


# -- progress ------------------------------------------------------------------------------------------------------------


def test_progress_table_adds_up_to_the_final_counts(spark, tmp_path):
    for k in range(4):
        spark.range(k * 100, k * 100 + 50 + k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    path = f"file://{tmp_path}/progress"
    listener = progress.ProgressTable(spark, path)
    spark.streams.addListener(listener)
    try:
        seen = progress.observed(files.stream(spark, f"{tmp_path}/in", "id bigint", files=1), n=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
        query = seen.writeStream.queryName("counting").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
        for _ in range(60):
            if progress.tail(spark, path).count() >= 4:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {(r.query, r.counter): r.n for r in progress.totals(spark, path).collect()} == {("counting", "n"): out.count(), ("counting", "even"): out.where("id % 2 = 0").count()}
    batches = [r.batch for r in progress.tail(spark, path).collect()]
    assert batches == [0, 1, 2, 3]  # a row per batch, written while the stream ran
    assert [r.batch for r in progress.tail(spark, path, after=1, query="counting").collect()] == [2, 3]
    assert progress.tail(spark, f"{path}-none").count() == 0


# -- bootstrap -------------------------------------------------------------------------------------------------------------


def test_intervals_are_reproducible_and_cover(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 != 49, (F.crc32(F.col("id").cast("string").cast("binary")) % 10 < 6).cast("bigint")).alias("v"))
    a = sorted(map(tuple, bootstrap.interval(rows, ["g"], "id", "v", n=200).collect()))
    assert a == sorted(map(tuple, bootstrap.interval(rows.repartition(7), ["g"], "id", "v", n=200).collect()))
    assert a != sorted(map(tuple, bootstrap.interval(rows, ["g"], "id", "v", n=200, seed=1).collect()))
    for _, n, mean, low, high in a:
        assert n == 980 and low < mean < high and 0.04 < high - low < 0.085  # 2 * 1.96 * sqrt(0.24 / 980) is 0.061


def test_weights_are_poisson(spark):
    rows = spark.range(5000).select("id", F.lit(1).alias("g"), F.lit(1).alias("v"))
    digest = F.md5(F.col("id").cast("string"))
    held = {r[0]: r[1] for r in rows.groupBy(bootstrap._draw(digest, 2)).count().collect()}
    assert abs(held[0] / 5000 - 0.368) < 0.03 and abs(held[1] / 5000 - 0.368) < 0.03 and abs(held[2] / 5000 - 0.184) < 0.03
    assert abs(sum(k * n for k, n in held.items()) / 5000 - 1) < 0.06
    with pytest.raises(ValueError, match="multiples"):
        bootstrap.replicates(rows, ["g"], "id", "v", n=10)


@pytest.mark.parametrize("a, b, want", [(0, 0, 1.0), (5, 5, 1.0), (1, 9, 22 / 1024), (0, 6, 2 / 64), (10, 2, 2 * (1 + 12 + 66) / 4096)])
def test_mcnemar_is_exact(spark, a, b, want):
    rows = spark.createDataFrame([("k", True, False)] * a + [("k", False, True)] * b + [("k", True, True)], "g string, x boolean, y boolean")
    r = bootstrap.mcnemar(rows, ["g"], "x", "y").first()
    assert (r.n, r.only_first, r.only_second) == (a + b + 1, a, b) and r.p == pytest.approx(want, abs=1e-12)

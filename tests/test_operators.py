"""Dedup, sets, datasets, batches, sources, sinks and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from grainmill.functions.text import shingles
from grainmill.operators import batches, corpus, datasets, dedup, near_index, sets
from grainmill.operators import answers as ans
from grainmill.operators import evaluation as ev
from grainmill.session import Written
from grainmill.sources import files, results, sinks
from grainmill.streaming.ingest import Ingest, counters, distinct_stream


# -- dedup -----------------------------------------------------------------------------------------------------------------


def greedy(nodes, pairs):
    hit = {n: set() for n in nodes}
    for later, earlier in pairs:
        hit[later].add(earlier)
    accepted = set()
    for n in sorted(nodes):
        if not hit[n] & accepted:
            accepted.add(n)
    return accepted


@pytest.mark.parametrize("seed", range(3))
def test_first_wins_is_greedy(spark, seed):
    r = random.Random(seed)
    pairs = {(max(a, b), min(a, b)) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(70)) if a != b} | {(k + 1, k) for k in range(100, 120)}
    rows = [(n, band) for band, pair in enumerate(sorted(pairs)) for n in pair]
    nodes = {n for p in pairs for n in p}
    for single in (0, 40, 10**6):  # rounds alone, rounds and one task, one task
        got = near_index.settle(spark.createDataFrame(rows, "order bigint, band bigint"), Written(spark), single).collect()
        assert sorted(x.order for x in got) == sorted(greedy(nodes, pairs))


def test_near_dedup_keeps_the_earliest_of_copies(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, words), (2, words), (3, [*words[:59], "x"]), (4, list(reversed(words))), (5, []), (6, []), (7, ["a"]), (8, ["a"])]
    got = {r.i: (r.accepted, r.cluster) for r in dedup.near(spark, spark.createDataFrame(rows, "i bigint, t array<string>"), "i", "t").collect()}
    assert got[1] == (True, 1) and got[2] == (False, 1) and got[4] == (True, 4) and got[5] == got[5] and got[5][0] and got[6][0] and got[7] == (True, 7) and got[8] == (False, 7)
    assert dedup.near(spark, spark.createDataFrame([], "i bigint, t array<string>"), "i", "t").count() == 0


def test_minhash_estimates_similarity(spark):
    words = [f"w{i}" for i in range(400)]
    rows = spark.createDataFrame([(1, words), (2, [*words[:390], *(f"z{i}" for i in range(10))])], "i bigint, t array<string>")
    a, b = (r.signature for r in dedup.minhash(rows, "i", "t").orderBy("i").collect())
    same = sum(x == y for x, y in zip(a, b, strict=True)) / dedup.PERMUTATIONS
    assert rows.select(F.size(shingles(F.col("t")))).first()[0] == 396 and abs(same - 386 / 406) < 0.12


def test_partitioning_does_not_matter(spark):
    rows = spark.createDataFrame([(i, f"k{i % 37}", i * 31 % 101) for i in range(500)], "i bigint, k string, v bigint")
    for f in (lambda x: sets.sample(x, "i", 50), lambda x: sets.split(x, "i"), lambda x: sets.numbered(x, ["v", "i"]), lambda x: sets.running_cap(x, "i", "v", 90, 9000), lambda x: sets.first_by(x, ["k"], ["v", "i"])):
        assert sorted(map(tuple, f(rows.repartition(1)).collect())) == sorted(map(tuple, f(rows.repartition(7)).collect()))
    assert sets.sample(rows, "i", 900).count() == 500 and sets.split(rows.limit(0), "i").count() == 0


def test_harmonise_invariants(spark):
    rows = spark.createDataFrame([(c, s, i) for c, keep in (("a", 2), ("b", 3)) for s in ("train", "validation") for i in range(40) if i % keep], "cell string, split string, idx bigint")
    out = sets.harmonise(rows)
    sizes = {r.split: r for r in sets.cell_sizes(rows).collect()}
    for s in ("train", "validation"):
        assert sizes[s].n_intersection + sizes[s].n_dropped == sizes[s].n_union == out.where(F.col("split") == s).count()
    assert sets.missing_splits(rows).count() == 0 and sets.missing_splits(rows.where("cell = 'a' or split = 'train'")).collect()[0].cell == "b"


# -- corpus, datasets --------------------------------------------------------------------------------------------------------


def test_funnel_is_monotone_and_adds_up(spark):
    from grainmill.plans.corpus_queries import STAGES, judged

    chained = judged(spark, "/root/testdata/sf0.001")
    counts = [r.n for r in corpus.funnel(chained, STAGES).orderBy("rank").collect()]
    assert counts == sorted(counts, reverse=True) and counts[0] == sum(r.n for r in corpus.reasons(chained).collect())
    assert counts[-1] == chained.where("reject_reason is null").count()


def test_licenses(spark):
    cases = [(["GPL-3.0", "MIT"], "MIT"), (["other"], None), ([], None), ([" Apache_2.0 "], "Apache-2.0"), (["commercial MIT"], None), (["", "isc"], "ISC"), (None, None)]
    got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, n array<string>").select("i", corpus.license_of(F.col("n")).alias("l")).orderBy("i").collect()
    assert [r.l for r in got] == [y for _, y in cases]


def test_validation_refuses(spark, tmp_path):
    bad = spark.createDataFrame([("a", 1)], "check string, bad bigint")
    with pytest.raises(datasets.ValidationError):
        sinks.write_dataset(spark.range(3), str(tmp_path / "x"), bad)
    rows = spark.range(4).selectExpr("id", "'c' config", "if(id < 3, 'train', 'validation') split")
    sinks.write_dataset(rows, str(tmp_path / "x"), bad.where("bad = 0"))
    assert spark.read.parquet(str(tmp_path / "x")).where("split = 'train'").count() == 3
    assert datasets.missing_columns(rows, ["id", "none"]) == ["none"]


def test_blend_with_enough_native_rows(spark):
    native = spark.createDataFrame([(f"n{i}", "c", 1) for i in range(9)], "file_path string, code string, token_count bigint")
    out = datasets.blend(native, native.withColumn("code_en", F.lit("e")).limit(0), None, 5)
    assert out.count() == 5 and out.where("code_en is not null").count() == 0


def test_decomposition_and_confusion_sums(spark):
    from grainmill.plans.bindings import answers

    rows = answers(spark, "/root/testdata/sf0.001")
    facts = ev.cells(rows)
    parts = ev.decomposition(facts, "building-5k", ["baseline"])
    assert parts.where("abs(delta_base - delta_anchor - delta_specific) > 1e-12").count() == 0
    table = ans.confusion(rows, ["a", "b", "c"], ["condition"])
    assert table.where("pred_a + pred_b + pred_c + pred_none != n_gold").count() == 0


# -- batches -----------------------------------------------------------------------------------------------------------------


def test_translate_retries_and_reports(spark):
    def make():
        seen = {}

        def call(x):
            seen[x] = seen.get(x, 0) + 1
            if x == "flaky" and seen[x] < 3:
                raise OSError
            if x == "bad":
                raise ValueError
            if x == "down":
                raise OSError
            return x.upper()

        return call

    rows = spark.createDataFrame([(x, x) for x in ("ok", "flaky", "bad", "down")], "file_path string, code string")
    got = {r.file_path: (r.output, r.error_type, r.retries) for r in batches.translate(rows, make).collect()}
    assert got == {"ok": ("OK", None, 0), "flaky": ("FLAKY", None, 2), "bad": (None, "ValueError", 0), "down": (None, "OSError", 3)}


def test_budget_stops_and_keeps_what_is_done(spark):
    rows = spark.createDataFrame([(f"f{i}", "x") for i in range(30)], "file_path string, code string")
    done = rows.where("file_path in ('f0', 'f1')")

    def split(left):
        return [left.where(F.pmod(F.xxhash64("file_path"), F.lit(3)) == k) for k in range(3)]

    out, code = batches.paced(rows, done, lambda part: batches.translate(part, lambda: str.lower), split, batches.Budget(most_cost=0.05 * 3))
    assert code == batches.Budget.COST and len(out) == 1
    out, code = batches.paced(rows, done, lambda part: batches.translate(part, lambda: lambda x: x), split, batches.Budget())
    assert code == batches.Budget.OK and sum(o.count() for o in out) == 28
    ticks = iter(range(100))
    assert batches.Budget(most_seconds=1, clock=lambda: next(ticks)).verdict() == batches.Budget.CLOCK


# -- sources and sinks ---------------------------------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.py").write_text("é = 1")
    (tmp_path / "y.py").write_bytes(b"\xff\xfe\x00bad")
    got = {r.file_path: (r.code, r.readable) for r in files.source_files(spark, str(tmp_path)).collect()}
    assert got == {"a/x.py": ("é = 1", True), "y.py": (None, False)}
    assert files.split_file(spark, str(tmp_path), "train") is None
    spark.range(3).write.parquet(str(tmp_path / "train.parquet"))
    assert files.split_file(spark, str(tmp_path), "train").count() == 3
    (tmp_path / "m.csv").write_text('idx,v\n1,"two\nlines"\n1,last\n,none\nx,bad\n')
    keyed = files.keyed_csv(spark, str(tmp_path / "m.csv"), "idx")
    assert {r.idx: r.v for r in keyed.collect() if r.idx} == {"1": "last", "x": "bad"}
    assert [r.idx for r in files.idx_set(keyed).collect()] == [1]
    with pytest.raises(ValueError):
        files.keyed_csv(spark, str(tmp_path / "m.csv"), "other")
    with pytest.raises(ValueError):
        files.keep_list(spark.createDataFrame([("x",)], "value string"), strict=True)
    calls = []
    for _ in range(2):
        files.cached(spark, str(tmp_path / "c"), lambda: calls.append(1) or spark.range(2))
    assert len(calls) == 1
    assert files.listing(spark, str(tmp_path), r"\.py$").count() == 2


def test_hydrate(spark):
    import gzip

    blobs = {"a": gzip.compress("hällo".encode()), "b": b"caf\xe9", "c": None}
    rows = spark.createDataFrame([("a", "utf-8"), ("b", "latin-1"), ("c", None), ("d", None)], "blob_id string, src_encoding string")

    def fetch():
        def get(k):
            if k == "d":
                raise OSError
            return blobs[k]

        return get

    assert {r.blob_id: r.content for r in files.hydrate(rows, fetch).collect()} == {"a": "hällo", "b": "café"}


def test_results_files(spark, tmp_path):
    cell = "template1_topic_data=ur_instr=zh"
    folder = tmp_path / "cond/seed-42"
    folder.mkdir(parents=True)
    answers = [{"raw_output": "سفر", "gold": "travel", "pred": None, "correct": False}, {"raw_output": "旅行", "gold": "travel", "pred": "travel", "correct": True}]
    (folder / "template1_seed42_results.json").write_text(json.dumps({"summary": {"x": 0.5}, "parse_failure_rates": {"x": 0}, "note": "text", "empty": [], "odd": [{"a": 1}], cell: answers}, ensure_ascii=False))
    (folder / "template1_seed42_summary.json").write_text(json.dumps({f"{cell}_acc": 0.5, f"{cell}_count": 2, f"{cell}_correct": 1, "noise": 3}))
    read = results.read_texts(spark, f"{tmp_path}/cond/seed-42/*_results.json")
    rows = results.answers(read).orderBy("pos").collect()
    assert [(r.raw_output, r.pred, r.benchmark, r.data, r.instr, r.template) for r in rows] == [("سفر", None, "topic", "ur", "zh", "1"), ("旅行", "travel", "topic", "ur", "zh", "1")]
    s = results.summaries(results.read_texts(spark, f"{tmp_path}/cond/seed-42/*_summary.json")).collect()
    assert [(r.cell, r.acc, r["count"], r.correct) for r in s] == [(cell, 0.5, 2.0, 1.0)]
    paths = spark.createDataFrame([("/r/cond/seed-42/template1_seed7_results.json",), ("/r/cond/seed-42/template1_seed42_results.json",)], "path string")
    where = results.file_coordinates(F.col("path"))
    named = paths.select("path", *(c.alias(n) for n, c in where.items()))
    for policy, want in (("prefer", "seed42"), ("drop", "seed42"), ("trust", "seed42")):
        picked = results.canonical(named, ["condition", "dir_seed", "template"], F.col("dir_seed"), F.col("name_seed"), policy).collect()
        assert len(picked) == 1 and want in picked[0].path
    assert spark.range(1).select(results.refined_name(F.lit("a_summary.json"))).first()[0] == "a_summary_reparsed.json"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.12345, -0.00001, None), (2, 1.0, 0.5, 0.25)], "i bigint, a double, d double, s double")
    got = rows.orderBy("i").select(sinks.fixed("a"), sinks.points("d"), sinks.percent("a"), sinks.with_spread(F.col("d"), F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("0.1235" if got[0][0] == "0.1235" else "0.1234", "+0.0", "12.3", "+0.0"), ("1.0000", "+50.0", "100.0", "+50.0 ± 25.0")]
    sinks.write_tsv(rows, str(tmp_path / "t"), plain=("a",), signed=("d",))
    assert files.tsv(spark, str(tmp_path / "t"), ["a", "d"]).orderBy("i").first().d == 0.0
    assert sinks.markdown(rows.select("i")).count("\n") == 3 and r"\toprule" in sinks.latex(rows.select("i"), "c", "l")
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(9), most=5)
    assert sinks.publish(spark, rows, str(tmp_path / "p"), dry_run=True) == "new" == sinks.publish(spark, rows, str(tmp_path / "p"))
    assert sinks.publish(spark, rows, str(tmp_path / "p")) == "skip" and sinks.publish(spark, rows, str(tmp_path / "p"), overwrite=True) == "overwrite"
    name = spark.range(1).select(sinks.record_name(F.lit(7), F.lit("o/r"), F.lit("d/x.y.py"), F.lit("ab" * 32))).first()[0]
    assert name == "000000007_o-r_x.y_abababababab"
    assert len(sinks.provenance(sinks)["grainmill.sources.sinks"]) == 64


# -- streaming -----------------------------------------------------------------------------------------------------------------


def test_stream_ingest_equals_batch_and_resumes(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    n = docs.count()
    for k in range(3):
        docs.where(F.floor(F.col("doc_id") * 3 / n) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def tests():
        return [("content", "failed_parse", corpus.has_content("text")), ("length", "failed_length", F.length("text") > 100)]

    job = Ingest(spark, str(tmp_path / "out"), tests, "doc_id", "text")
    for _ in range(2):  # the second finds nothing new
        query = job.start(files.stream(spark, f"{tmp_path}/in", docs.schema, files=1), f"{tmp_path}/cp")
        query.awaitTermination(120)
    want = dedup.exact(docs.where("length(text) > 100").withColumn("sha256", F.sha2("text", 256)), "doc_id")
    assert sorted(r.sha256 for r in job.accepted().collect()) == sorted(r.sha256 for r in want.collect())
    assert {r.rank: r.n for r in job.progress().collect()}[0] == n
    job.step(docs.limit(5), 1)  # a batch that is replayed replaces what it wrote
    assert job.accepted().groupBy("sha256").count().where("count > 1").count() == 0


def test_stream_near_dedup(spark, tmp_path):
    a = " ".join(f"w{i}" for i in range(80))
    rows = spark.createDataFrame([(1, a), (2, a + " tail"), (3, "other text entirely here")], "i bigint, text string")
    job = Ingest(spark, str(tmp_path / "o"), lambda: [("content", "failed_parse", corpus.has_content("text"))], "i", "text", lambda t: F.split(t, " "))
    job.step(rows.where("i = 1"), 0)
    job.step(rows.where("i > 1"), 1)
    assert sorted(r.i for r in job.accepted().collect()) == [1, 3]


def test_distinct_stream(spark, tmp_path):
    spark.createDataFrame([(1,), (1,), (2,)], "k bigint").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = distinct_stream(files.stream(spark, f"{tmp_path}/in", "k bigint"), ["k"])
    query = out.writeStream.format("memory").queryName("distinct_keys").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("distinct_keys").count() == 2 and counters(query)["rows"] == 3

"""Subset validation names planted losses, repeats and changes, and passes what is whole."""

import pytest

from grainmill.operators import subsets
from grainmill.operators.datasets import ValidationError

SCHEMA = "config string, split string, file_path string, code string, code_en string, token_count bigint"


def variants(spark, edit=lambda rows: rows):
    first = [("a", "train" if i % 5 else "validation", f"p{i}", f"text {i}", None, i) for i in range(50)]
    other = [("b", s, p, "translated", c, None if t == 3 else t) for _, s, p, c, _, t in first]
    return spark.createDataFrame(first + edit(other), SCHEMA).repartition(4)


def flags(found):
    return {(r.config, r.split): (r.size_ok, r.paths_match, r.contents_match, r.n) for r in found.collect()}


def test_whole_variants_pass(spark):
    found = subsets.require(variants(spark), "a", 50)
    assert flags(found) == {("a", "train"): (True, True, True, 40), ("a", "validation"): (True, True, True, 10), ("b", "train"): (True, True, True, 40), ("b", "validation"): (True, True, True, 10)}
    r = {(x.config, x.split): x for x in found.collect()}["b", "train"]
    assert (r.null_tokens, r.min_tokens, r.max_tokens, r.total_tokens) == (1, 1, 49, sum(i for i in range(50) if i % 5 and i != 3))


def swapped(rows):
    a, b = rows[11], rows[12]
    rows[11], rows[12] = (*a[:4], b[4], a[5]), (*b[:4], a[4], b[5])
    return rows


@pytest.mark.parametrize(
    "edit, want",
    [
        (swapped, {("train", "p11", "changed"), ("train", "p12", "changed")}),
        (lambda r: r[:7] + r[8:], {("train", "p7", "lost")}),
        (lambda r: r + [r[9]], {("train", "p9", "repeated")}),
        (lambda r: r[1:] + [r[1]], {("validation", "p0", "lost"), ("train", "p1", "repeated")}),  # the count stays right
        (lambda r: r + [("b", "train", None, "x", None, None)], {("train", None, "extra")}),
        (lambda r: [x for x in r if x[1] == "train"], {("validation", f"p{i}", "lost") for i in range(0, 50, 5)}),
    ],
)
def test_planted_faults_are_named(spark, edit, want):
    rows = variants(spark, edit)
    found = subsets.report(rows, "a", 50)
    named = subsets.faults(rows, "a", found)
    assert {(r.split, r.path, r.fault) for r in named.collect()} == want
    assert {r.config for r in found.where("not (paths_match and contents_match)").collect()} == {"b"}
    with pytest.raises(ValidationError, match="b: "):
        subsets.require(rows, "a", 50)


def test_repeats_in_the_first_variant_and_empty_tables(spark):
    rows = variants(spark).unionByName(variants(spark).where("file_path = 'p4'"))
    assert {(r.config, r.path, r.fault) for r in subsets.faults(rows, "a", subsets.report(rows, "a", 50)).collect()} == {("a", "p4", "repeated")}
    none = spark.createDataFrame([], SCHEMA)
    assert subsets.report(none, "a", 0).count() == 0 and subsets.faults(none, "a").count() == 0


def test_whole_variants_are_not_shuffled_by_path(spark):
    plan = subsets.report(variants(spark), "a", 50)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(config" in plan and "hashpartitioning(file_path" not in plan

"""Truth tables of text helpers, extractors and statistics."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill.functions import code, labels, stats, text


def values(spark, cases, *columns):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string").select("i", *(c.alias(f"c{k}") for k, c in enumerate(columns))).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows]


def test_topics(spark):
    cases = {
        "travel": ("travel", "single"), "Sports!": ("sports", "single"), "science and technology": ("science/technology", "single"), "politics, health": (None, "multi_category"), "I say travel here": ("travel", "fallback"),
        "答案是health": ("health", "fallback"), "科学与技术": ("science/technology", "single"), "صحت": ("health", "single"), "السياسة": ("politics", "single"), "viajes": ("travel", "single"), "": (None, "none"), "hm": (None, "none"),
        "sport & sports": ("sports", "single"), "geography\nsports": ("geography", "single"), "travel or sports": (None, "none"), "(politics).": ("politics", "single"), "science / technology / AI / physics": ("science/technology", "single"),
    }
    assert values(spark, cases, labels.topic("x"), labels.topic_via("x")) == list(cases.values())


def test_topics_at_inference(spark):
    cases = {"science/physics": "science/technology", "physics": "science/technology", "ciencia y tecnología": "science/technology", "a travel text": "travel", "sport": "sports", "salud": None, "science and technology": "science/technology"}
    assert values(spark, cases, labels.topic_at_inference("x")) == list(cases.values())


def test_inference_labels(spark):
    cases = {
        "Entailment": ("entailment", "tier1_english"), "no contradiction": ("contradiction", "tier1_english"), "蕴含": ("entailment", "tier1_native"), "neutra": ("neutral", "tier1_native"), "答案是entailment": ("entailment", "tier2_cjk_glued"), "答案是neutral": ("neutral", "tier1_native"),
        "没有entailment": (None, "none"), "没有任何关系": ("neutral", "tier3_paraphrase"), "否定": ("contradiction", "tier3_paraphrase"), "": (None, "none"), "x\nneutral": (None, "none"), "推断": ("entailment", "tier3_paraphrase"),
    }
    assert values(spark, cases, labels.inference("x"), labels.inference_via("x")) == list(cases.values())
    assert values(spark, ["neutro", "答案是entailment", "neutral"], labels.inference_legacy("x"), labels.inference_at_inference("x")) == [(None, "neutral"), (None, None), ("neutral", "neutral")]


def test_choices(spark):
    cases = {"B": ("B", "bare_letter"), "it is b": ("B", "letter_in_text"), "ANSWER:C": ("C", "letter_in_text"), "answerc": ("C", "answer_prefix"), "e": ("E", "bare_letter"), "none": (None, "none"), "a cat": ("A", "letter_in_text"), "\n D": ("D", "bare_letter")}
    assert values(spark, cases, labels.choice("x"), labels.choice_via("x")) == list(cases.values())
    assert values(spark, ["E", "d"], labels.choice("x", "ABCD")) == [None, "D"]


def test_extract_by_benchmark_and_outcomes(spark):
    rows = spark.createDataFrame([("topic", "travel", "travel"), ("choice5", "b", "C"), ("inference", "?", "neutral"), ("choice4", "E", None)], "b string, a string, gold string")
    label, via = labels.extract("b", "a")
    got = rows.select(label.alias("pred"), via.alias("via"), "gold").select("pred", "via", labels.outcome("pred", "gold"), labels.correct("pred", "gold"), labels.correct_at_inference("pred", "gold")).collect()
    assert [tuple(r) for r in got] == [("travel", "single", "correct", True, True), ("B", "bare_letter", "wrong_label", False, False), (None, "none", "parse_fail", False, False), (None, "none", "parse_fail", False, True)]


def test_gold(spark):
    assert values(spark, ["0", " Neutral ", "2"], labels.gold("inference", "x")) == ["entailment", "neutral", "contradiction"]
    assert values(spark, ["1", " b"], labels.gold("choice4", "x")) == ["A", "B"]
    assert values(spark, [" Travel "], labels.gold("topic", "x")) == ["travel"]


PIECES = ["a", "B", " ", "\n", "\r\n", "\r", "\x0b", "\x1c", "\x85", " ", "　", "é", "\t"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=30, max_size=30))
def test_lines_and_stripping_as_in_python(spark, cases):
    got = values(spark, cases, text.line_count("x"), text.strip("x"), text.one_line("x"))
    assert got == [(len(c.splitlines()), c.strip(), " ".join(c.split())) for c in cases]


def test_small_helpers(spark):
    assert values(spark, ["a b/c", "--", "x.Y_z"], text.slug("x")) == ["a-b-c", "item", "x.Y_z"]
    assert values(spark, ["\nx", " Two  words \nz"], text.raw_first_line("x"), text.first_line("x")) == [("", "x"), ("two words", "Two  words")]
    assert values(spark, ["a b c", "", "a b c d e f"], F.size(text.shingles(F.filter(F.split("x", " "), lambda w: w != ""), 5))) == [1, 0, 2]


def test_code_facts_never_fail(spark):
    cases = ["def f(a):\n    '''Doc.'''\n    return a + b  # why", "x = (", "\0", None, "", "class A: pass\n", "import a as b\ntry:\n  pass\nexcept E as e:\n  print(x.y, k=1)", "(" * 5000, "a\r\nb = 1\r"]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string").select("i", code.code_facts("x").alias("f")).orderBy("i").collect()
    facts = [r.f for r in got]
    assert [f.parses for f in facts][:7] == [True, False, False, False, True, True, True] and [f.defines for f in facts][:6] == [True, False, False, False, False, True]
    assert facts[0].remarks == "why Doc." and facts[0].names.count("a") == 2
    assert sorted(facts[6].names) == sorted(["b", "e", "E", "x", "y", "k"])


def test_categories(spark):
    names = {"__init__": "dunder", "self": "convention", "T": "typing_special", "x": "single_letter", "_p": "private_convention", "MAX": "constant_style", "mixedCase": "other", "__q": "other"}
    assert values(spark, names, code.category(F.col("x"))) == list(names.values())


# Two-sided probabilities from published tables.
STUDENT = {(2.0, 10): 0.07338803, (12.706, 1): 0.05000, (2.776, 4): 0.05002, (0.0, 5): 1.0, (5.0, 30): 0.0000231}


def test_tail_probabilities():
    assert all(abs(stats.student_tail(t, df) - p) < 2e-5 for (t, df), p in STUDENT.items())
    assert abs(stats.normal_tail(1.959964) - 0.05) < 1e-6
    assert abs(stats.student_tail(1.3, 1e6) - stats.normal_tail(1.3)) < 1e-6
    assert math.isclose(stats.incomplete_beta(2, 3, 0.4), 0.5248, abs_tol=1e-9)


def test_significance_without_variance(spark):
    rows = [("baseline", "none", t, "topic", "en", "en", 10, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0) for t in "12"] + [("c", s, t, "topic", "en", "en", 10, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0) for s in ("1", "2") for t in "12"]
    facts = spark.createDataFrame(rows, "condition string, seed string, template string, benchmark string, data string, instr string, n bigint, orig_acc double, rep_acc double, orig_pf double, rep_pf double, delta_acc double, delta_pf double")
    r = stats.significance(facts).first()
    assert r.one_sample_t is None and r.one_sample_p is None and r.welch_t is None and r.z == 0.0 and r.z_p == 1.0 and r.mark == ""


@pytest.mark.parametrize("n", [1, 19, 20, 99, 100, 1000])
def test_order_statistics(spark, n):
    from grainmill.operators.batches import TAILS, order_statistics

    data = [float((i * 7919) % n) for i in range(n)]
    row = order_statistics(spark.createDataFrame([("g", x) for x in data], "g string, v double"), ["g"], "v", TAILS, 10).first()
    s = sorted(data)
    assert (row.p95, row.p99) == (s[int(n * 0.95)] if n >= 20 else s[-1], s[int(n * 0.99)] if n >= 100 else s[-1])

"""Labelled tables against a plain computation over the same cells."""

import random
from statistics import mean, stdev

import pytest

from grainmill.operators import labelled

PLAN = labelled.Plan(
    conditions=["base", "p-5k", "p-20k", "q-5k", "q-20k"], benchmarks=["one", "two"], langs=["en", "es", "zh"], thresholds={"one": 0.05, "two": 0.01},
    ladders={"es": ["p-5k", "q-20k"]}, pairs={"es": ("p-5k", "q-5k"), "zh": ("p-20k", "absent")}, transfer=["p-5k", "q-5k"], flips=["one"],
)


@pytest.fixture(scope="module")
def cells():
    r, out, base = random.Random(2), [], {}
    for c in PLAN.conditions[1:]:
        for seed in ("1", "2", "3") if c.endswith("5k") else ("1",):
            for template in "12":
                for b in PLAN.benchmarks:
                    for data in PLAN.langs:
                        for instr in PLAN.langs:
                            if (c, b, instr) == ("q-20k", "two", "zh"):
                                continue  # a hole
                            place = (template, b, data, instr)
                            bo, br = base.setdefault(place, (round(r.random(), 3), round(r.random(), 3)))
                            lift = 0.6 if c == "q-5k" and b == "one" else 0.0
                            co, cr = round(min(1.0, r.random() + lift), 3), round(max(0.0, r.random() - lift), 3)
                            out.append((c, seed, *place, bo, br, co, cr, co - bo, cr - br))
    return out


@pytest.fixture(scope="module")
def got(spark, cells):
    schema = "condition string, seed string, template string, benchmark string, data string, instr string, base_orig double, base_rep double, cond_orig double, cond_rep double, delta_orig double, delta_rep double"
    frame = labelled.tables(spark, spark.createDataFrame(cells, schema).repartition(5), PLAN).cache()
    return frame, {(x.tab, x.line, x.col): x for x in frame.collect()}


def values(cells, field, **keys):
    names = ("condition", "seed", "template", "benchmark", "data", "instr", "base_orig", "base_rep", "cond_orig", "cond_rep", "delta_orig", "delta_rep")
    return [c[names.index(field)] for c in cells if all(c[names.index(k)] == v for k, v in keys.items())]


def test_layout_is_whole_and_holes_stay(got):
    _, by = got
    assert len({t for t, _, _ in by}) == 3 * 2 + 3 + 1 + 1 + 1 + 1 + 1
    assert len([1 for t, _, _ in by if t == "accuracy-one"]) == 5 * 3
    hole = by["accuracy-two", "q-20k", "zh"]
    assert hole.value is None and hole.text == "--" and hole.n_seeds == 1


def test_values_by_grain(got, cells):
    _, by = got
    near = lambda x: pytest.approx(x, abs=1e-8)
    assert by["accuracy-one", "p-5k", "es"].value == near(mean(values(cells, "cond_rep", condition="p-5k", benchmark="one", instr="es")))
    assert by["readings-two", "q-5k", "en orig"].value == near(mean(values(cells, "cond_orig", condition="q-5k", benchmark="two", instr="en")))
    assert by["native", "p-5k", "two zh"].value == near(mean(values(cells, "cond_rep", condition="p-5k", benchmark="two", instr="zh", data="zh")))
    assert by["english", "p-5k", "two zh"].value == near(mean(values(cells, "cond_rep", condition="p-5k", benchmark="two", instr="en", data="zh")))
    base = {(t, d): v for t in "12" for d in PLAN.langs for v in values(cells, "base_rep", template=t, data=d, benchmark="two", instr="zh")}
    assert by["accuracy-two", "base", "zh"].value == near(mean(base.values()))
    assert by["headroom", "two", "mean"].value == near(mean(by["headroom", "two", x].value for x in PLAN.langs))
    assert by["transfer", "q-5k", "one"].value == near(mean(values(cells, "delta_rep", condition="q-5k", benchmark="one", instr="en")))


def test_ladder_has_deviation_over_seeds(got, cells):
    _, by = got
    at = {"benchmark": "one", "data": "es", "instr": "es"}
    start = mean({t: values(cells, "base_rep", template=t, **at)[0] for t in "12"}.values())
    seeds = [mean(values(cells, "cond_rep", condition="p-5k", seed=s, **at)) for s in "123"]
    x = by["ladder-es", "p-5k", "one"]
    assert (x.value, x.spread, x.n_seeds) == (pytest.approx(mean(seeds) - start, abs=1e-8), pytest.approx(stdev(seeds), abs=1e-8), 3)
    assert " ± " in x.text and by["ladder-es", "q-20k", "one"].spread is None
    assert by["ladder-es", "base", "one"].value == pytest.approx(start, abs=1e-8) and by["ladder-es", "base", "one"].text.endswith("%")


def test_marks(got, cells):
    _, by = got
    for (tab, _, col), x in by.items():
        if tab.startswith("delta-"):
            assert x.mark == ("bold" if x.value is not None and abs(x.value) > PLAN.thresholds[tab[6:]] else "")
        if tab == "transfer":
            assert x.mark == ("bold" if x.value > 0.02 else "italic" if x.value < -0.02 else "")
        if tab == "pairs" and col == "gap":
            assert x.mark == ("bold" if x.value is not None and abs(x.value) > 0.05 else "")
    assert by["pairs", "zh one", "gap"].value is None
    flips = {line for t, line, _ in by if t == "flips-one"}
    avg = lambda c, f: mean(values(cells, f, condition=c, benchmark="one"))
    assert flips == {c for c in PLAN.conditions[1:] if avg(c, "delta_orig") > 0 and avg(c, "delta_rep") < -0.005} and "q-5k" in flips
    assert by["flips-one", "q-5k", "n_cells"].text == "54" and by["flips-one", "q-5k", "delta_rep"].line_at == 0
    assert by["readings-one", "q-5k", "es rep"].mark == "bold"
    best = [x for (t, _, c), x in by.items() if t == "native" and c == "one es" and x.best]
    assert len(best) == 1 and best[0].line != "base"


def test_lines(got):
    frame, by = got
    lines = {(x.tab, x.line): x.latex for x in labelled.lines(frame).collect()}
    assert lines["accuracy-two", "q-20k"].startswith("q-20k & 1 & ") and lines["accuracy-two", "q-20k"].endswith("& --")
    assert lines["accuracy-two", "base"].startswith("base & -- & ") and r"\%" in lines["accuracy-two", "base"]
    assert r"\textbf{" in lines["flips-one", "q-5k"] or r"\textbf{" in lines["readings-one", "q-5k"]
    assert r"$\pm$" in lines["ladder-es", "p-5k"]

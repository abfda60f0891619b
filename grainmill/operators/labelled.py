"""Labelled tables of an evaluation, in long form: one row per table, line and column.

One scan of the cells against their baseline gives all groupings at once: each cell also stands for the baseline at its
place, repeats of that fall together, and GROUPING SETS yield means by every grain that a table needs. What remains has
the size of the tables' layout, which parameters fix: it is joined to those means, and derived columns (row means, gaps,
shifts) and marks are windows over a table's lines and columns.

Cells without observations stay, with null values and the text '--'. Deviations need two seeds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.session import Written
from grainmill.sources.sinks import fixed, percent, points, with_spread

LAYOUT = "tab string, line string, line_at int, col string, col_at int, condition string, benchmark string, instr string, data string, measure string, threshold double"
#: A sign flips only if both deltas are this far from zero; catalogued flips need this much of the refined delta.
FLIP, WOBBLE = 0.01, 0.005
#: Points that a gap or a transfer must pass to be marked.
GAP, TRANSFER = 0.05, 0.02
#: Means are rounded to so many places, so that sums in another order give the same ties, marks and texts.
PLACES = 9


@dataclass(frozen=True)
class Plan:
    """conditions: the baseline first; thresholds: by benchmark, for deltas; ladders: a language's conditions in order;
    pairs: a language's two conditions head to head; transfer: conditions looked at under `english` instructions;
    flips: benchmarks whose sign flips are catalogued."""

    conditions: list[str]
    benchmarks: list[str]
    langs: list[str]
    thresholds: dict[str, float]
    ladders: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[str, tuple[str, str]] = field(default_factory=dict)
    transfer: list[str] = field(default_factory=list)
    flips: list[str] = field(default_factory=list)
    english: str = "en"

    def layout(self) -> list[tuple]:
        out: list[tuple] = []

        def put(tab, lines, cols) -> None:
            """lines: names with their keys; cols: names, keys and measures; a column's keys complete those of the line."""
            for i, (line, a) in enumerate(lines):
                for j, (col, b, measure) in enumerate(cols):
                    keys = a | b
                    out.append((tab, line, i, col, j, *(keys.get(k) for k in ("condition", "benchmark", "instr", "data")), measure, keys.get("threshold")))

        base, *others = self.conditions
        every, trained = ([(c, {"condition": c}) for c in cs] for cs in (self.conditions, others))
        both = [(b, lang) for b in self.benchmarks for lang in self.langs]
        for b in self.benchmarks:
            at = {"benchmark": b}
            put(f"accuracy-{b}", every, [(x, at | {"instr": x}, "rep") for x in self.langs])
            put(f"readings-{b}", every, [(f"{x} {m}", at | {"instr": x}, m) for x in self.langs for m in ("orig", "rep")])
            put(f"delta-{b}", trained, [(x, at | {"instr": x, "threshold": self.thresholds[b]}, "delta_rep") for x in self.langs])
        put("native", every, [(f"{b} {x}", {"benchmark": b, "instr": x, "data": x}, "rep") for b, x in both])
        put("english", every, [(f"{b} {x}", {"benchmark": b, "instr": self.english, "data": x}, "rep") for b, x in both])
        put("native-delta", trained, [(f"{b} {x}", {"benchmark": b, "instr": x, "data": x}, "delta_rep") for b, x in both])
        put("headroom", [(b, {"condition": base, "benchmark": b}) for b in self.benchmarks], [*((x, {"instr": x}, "rep") for x in self.langs), ("mean", {}, "mean")])
        for lang, conditions in self.ladders.items():
            at = {"instr": lang, "data": lang}
            put(f"ladder-{lang}", [(c, at | {"condition": c}) for c in (base, *conditions)], [(b, {"benchmark": b}, "ladder") for b in self.benchmarks])
        lines = [(f"{lang} {b}", {"benchmark": b, "instr": lang}, pair) for lang, pair in self.pairs.items() for b in self.benchmarks]
        for i, (line, keys, pair) in enumerate(lines):
            for j, (col, condition, measure) in enumerate((("first", pair[0], "delta_rep"), ("second", pair[1], "delta_rep"), ("gap", None, "gap"))):
                out.append(("pairs", line, i, col, j, condition, keys["benchmark"] if condition else None, keys["instr"] if condition else None, None, measure, None))
        put("transfer", [(c, {"condition": c, "instr": self.english}) for c in self.transfer], [(b, {"benchmark": b}, "transfer") for b in self.benchmarks])
        for b in self.flips:
            put(f"flips-{b}", [(c, {"condition": c, "benchmark": b}) for c in others], [("n_cells", {}, "n"), ("delta_orig", {}, "flip_orig"), ("delta_rep", {}, "flip_rep"), ("shift", {}, "shift")])
        return out


def _grains(versus: DataFrame, base: str) -> DataFrame:
    """Means by each grain; `grain` is the grouping id over (benchmark, instr, data, seed), its bits set for what is pooled."""
    mine = F.struct("condition", "seed", F.col("cond_orig").alias("orig"), F.col("cond_rep").alias("rep"), "delta_orig", "delta_rep")
    none = F.lit(None).cast("double")
    other = F.struct(F.lit(base).alias("condition"), F.lit("none").alias("seed"), F.col("base_orig").alias("orig"), F.col("base_rep").alias("rep"), none.alias("delta_orig"), none.alias("delta_rep"))
    rows = versus.select("template", "benchmark", "instr", "data", F.explode(F.array(mine, other)).alias("c")).select("template", "benchmark", "instr", "data", "c.*")
    cells = rows.groupBy("condition", "seed", "template", "benchmark", "instr", "data").agg(*(F.min(c).alias(c) for c in ("orig", "rep", "delta_orig", "delta_rep")))
    key = ["condition", "benchmark", "instr", "data", "seed"]
    sets = [key[:1] + ["seed"], key[:2], key[:3], key[:4], key]
    means = [F.round(F.avg(c), PLACES).alias(c) for c in ("orig", "rep", "delta_orig", "delta_rep")]
    return cells.groupingSets([[F.col(k) for k in s] for s in sets], *key).agg(F.grouping_id(*key).alias("grain"), F.count("*").alias("n"), *means)


def tables(spark: SparkSession, versus: DataFrame, plan: Plan) -> DataFrame:
    """(tab, line, line_at, col, col_at, value, spread, n_seeds, mark, best, text) of cells against their baseline."""
    base = plan.conditions[0]
    grains = Written(spark)(_grains(versus, base), "grains")
    keys = ["condition", "benchmark", "instr", "data"]
    means = grains.where(F.col("grain").isin(0b00111, 0b00011, 0b00001)).select(*keys, "n", "orig", "rep", "delta_orig", "delta_rep")
    seeds = grains.where(F.col("grain") == 0b01110).groupBy("condition").agg(F.count("*").alias("n_seeds"))
    matched = grains.where((F.col("grain") == 0) & (F.col("data") == F.col("instr"))).groupBy(*keys).agg(F.round(F.avg("rep"), PLACES).alias("over_seeds"), F.round(F.stddev_samp("rep"), PLACES).alias("over_spread"))
    start = means.where(F.col("condition") == base).select(*keys[1:], F.col("rep").alias("start"))

    out = spark.createDataFrame(plan.layout(), LAYOUT)
    for side in (means, matched):
        named = side.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in side.columns if c not in keys))
        out = out.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*(f"_{k}" for k in keys))
    named = start.select(*(F.col(k).alias(f"_{k}") for k in keys[1:]), "start")
    out = out.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys[1:]], "left").drop(*(f"_{k}" for k in keys[1:])).join(seeds, "condition", "left")

    is_base, measure = F.col("condition") == base, F.col("measure")
    ladder = F.when(is_base, F.col("rep")).otherwise(F.col("over_seeds") - F.col("start"))
    plain = {"orig": F.col("orig"), "rep": F.col("rep"), "delta_rep": F.col("delta_rep"), "transfer": F.col("delta_rep"), "ladder": ladder, "n": F.coalesce("n", F.lit(0)).cast("double"), "flip_orig": F.col("delta_orig"), "flip_rep": F.col("delta_rep")}
    out = out.withColumn("value", F.coalesce(*(F.when(measure == m, c) for m, c in plain.items())))

    line = W.partitionBy("tab", "line_at")
    of = lambda m: F.max(F.when(measure == m, F.col("value"))).over(line)
    at = lambda j: F.max(F.when(F.col("col_at") == j, F.col("value"))).over(line)
    derived = {"mean": F.avg("value").over(line), "gap": at(0) - at(1), "shift": F.abs(of("flip_orig") - of("flip_rep"))}
    out = out.withColumns({f"_{m}": c for m, c in (derived | {"was": of("flip_orig"), "is": of("flip_rep")}).items()})
    value = F.coalesce("value", *(F.when(measure == m, F.col(f"_{m}")) for m in derived))
    flipped = F.col("tab").startswith("flips-")
    out = out.withColumn("value", F.round(value, PLACES)).where(~flipped | ((F.col("_was") > 0) & (F.col("_is") < -WOBBLE)))
    falling = F.dense_rank().over(W.partitionBy("tab").orderBy("_is", "line_at")) - 1
    out = out.withColumn("line_at", F.when(flipped, falling).otherwise(F.col("line_at")))

    v, o, r = F.col("value"), F.col("delta_orig"), F.col("delta_rep")
    flip = ((o > FLIP) & (r < -FLIP)) | ((o < -FLIP) & (r > FLIP))
    bold = (
        (F.col("tab").startswith("readings-") & (measure == "rep") & ~is_base & flip)
        | (F.col("tab").startswith("delta-") & (F.abs(v) > F.col("threshold")))
        | ((measure == "gap") & (F.abs(v) > GAP))
        | ((measure == "transfer") & (v > TRANSFER))
    )
    mark = F.when(bold, "bold").when((measure == "transfer") & (v < -TRANSFER), "italic").otherwise("")
    trained = F.when(~F.coalesce(is_base, F.lit(False)), v)
    best = F.coalesce(trained == F.max(trained).over(W.partitionBy("tab", "col_at")), F.lit(False))
    spread = F.when((measure == "ladder") & ~is_base, F.col("over_spread"))
    return out.withColumns({"mark": mark, "best": best, "spread": spread}).select(
        "tab", "line", "line_at", "col", "col_at", "value", "spread", F.when(~is_base, F.col("n_seeds")).alias("n_seeds"), "mark", "best", _text(v, spread, measure, is_base).alias("text")
    )


def _text(v: Column, spread: Column, measure: Column, is_base: Column) -> Column:
    share = measure.isin("orig", "rep", "mean") | ((measure == "ladder") & is_base)
    four = measure.isin("flip_orig", "flip_rep")
    return F.when(v.isNull(), "--").when(share, F.concat(fixed(F.round(v * 100, 1), 1), F.lit("%"))).when(measure == "n", v.cast("bigint").cast("string")).when(four, fixed(v, 4, True)).when(measure == "shift", fixed(v, 4)).otherwise(with_spread(v, spread))


def lines(cells: DataFrame) -> DataFrame:
    """(tab, line_at, line, latex): each table's lines, cells in order, marked."""
    body = F.replace(F.replace("text", F.lit("%"), F.lit("\\%")), F.lit("±"), F.lit("$\\pm$"))
    marked = F.when(F.col("mark") == "bold", F.concat(F.lit("\\textbf{"), body, F.lit("}"))).when(F.col("mark") == "italic", F.concat(F.lit("\\textit{"), body, F.lit("}"))).otherwise(body)
    held = cells.groupBy("tab", "line_at", "line").agg(F.max("n_seeds").alias("n"), F.array_sort(F.collect_list(F.struct("col_at", marked.alias("text")))).alias("cells"))  # a line of a table
    seeds = F.coalesce(F.col("n").cast("string"), F.lit("--"))
    return held.select("tab", "line_at", "line", F.concat_ws(" & ", "line", seeds, F.array_join(F.transform("cells", lambda c: c["text"]), " & ")).alias("latex"))

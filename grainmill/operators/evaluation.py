"""From scored answers to comparison tables.

Rows: one scored answer with its cell (condition, seed, template, benchmark, data, instr), gold label, the label read
while generating (orig_pred) and the refined one (pred). Cells are collapsed before anything is counted or compared:
templates inside a seed, seeds inside a cell; observation counts and cell counts are kept apart. Every table is an
aggregation with map-side combine over a cell table that no longer grows with the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CELL = ["condition", "seed", "template", "benchmark", "data", "instr"]
PLACE = ["template", "benchmark", "data", "instr"]
#: Deltas within this of zero are ties; the floors of the sign verdict, of brittle templates and of recoveries.
TIE, FLOOR, BRITTLE, HIGH, VERDICT = 1e-6, 0.005, 0.10, 0.05, 0.01
BASELINE = "baseline"


def long(c: Column) -> Column:
    return c.cast("bigint")


def cells(rows: DataFrame) -> DataFrame:
    """Accuracy and parse-failure rate per cell under both readings. While generating, a missing label equals a missing
    gold; refined, a missing label is never right."""
    right = (F.col("orig_pred").eqNullSafe(F.col("gold"))).cast("double")
    refined = F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)).cast("double")
    out = rows.groupBy(*CELL).agg(
        F.count("*").alias("n"),
        F.avg(right).alias("orig_acc"),
        F.avg(refined).alias("rep_acc"),
        F.avg(F.col("orig_pred").isNull().cast("double")).alias("orig_pf"),
        F.avg(F.col("pred").isNull().cast("double")).alias("rep_pf"),
    )
    return out.withColumn("delta_acc", F.col("rep_acc") - F.col("orig_acc")).withColumn("delta_pf", F.col("rep_pf") - F.col("orig_pf"))


def changed(facts: DataFrame, least: float = 1e-9) -> DataFrame:
    """Cells whose accuracy or failure rate the refined reading moves."""
    return facts.where((F.abs("delta_acc") > least) | (F.abs("delta_pf") > least))


def legacy_scores(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Accuracy over rows with an answer only."""
    some = rows.where(F.coalesce(F.col("raw_output"), F.lit("")) != "")
    return some.groupBy(*CELL).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)).cast("double")), digits).alias("acc"))


def cell_key(facts: DataFrame) -> DataFrame:
    """The key string that names a cell within a results file."""
    return facts.withColumn("cell", F.format_string("template%s_%s_data=%s_instr=%s", "template", "benchmark", "data", "instr"))


def parse_cell_key(key: Column) -> dict[str, Column]:
    """Coordinates of a key string; null where it isn't one."""
    pattern = r"^template(\d+)_([a-z0-9]+)_data=([a-z]{2})_instr=([a-z]{2})$"
    return {name: F.nullif(F.regexp_extract(key, pattern, k + 1), F.lit("")) for k, name in enumerate(PLACE)}


# -- against a baseline ------------------------------------------------------------------------------------------------


def baseline_of(facts: DataFrame, name: str = BASELINE, prefix: str = "base") -> DataFrame:
    """One row per place: means over the condition's observations."""
    return facts.where(F.col("condition") == name).groupBy(*PLACE).agg(F.avg("orig_acc").alias(f"{prefix}_orig"), F.avg("rep_acc").alias(f"{prefix}_rep"))


def vs_baseline(facts: DataFrame, name: str = BASELINE) -> DataFrame:
    """Each other cell with the baseline at its place; places without a baseline go."""
    out = facts.where(F.col("condition") != name).join(baseline_of(facts, name), PLACE)
    return out.select(*CELL, "n", "base_orig", "base_rep", F.col("orig_acc").alias("cond_orig"), F.col("rep_acc").alias("cond_rep"), "orig_pf", "rep_pf").withColumns(
        {"delta_orig": F.col("cond_orig") - F.col("base_orig"), "delta_rep": F.col("cond_rep") - F.col("base_rep")}
    )


def _won(c: str) -> Column:
    return F.col(c) > TIE


def _lost(c: str) -> Column:
    return F.col(c) < -TIE


def win_loss(versus: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Means, wins, losses and flips by each grouping set; columns not grouped by are 'ALL'."""
    keys = sorted({k for s in sets for k in s})
    out = versus.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(
        F.count("*").alias("n_observations"),
        *(F.avg(c).alias(f"mean_{c}") for c in ("base_orig", "base_rep", "cond_orig", "cond_rep", "delta_orig", "delta_rep")),
        *(long(F.count_if(test(f"delta_{side}"))).alias(f"n_{name}_{side}") for side in ("orig", "rep") for name, test in (("wins", _won), ("losses", _lost))),
        F.count_if(_won("delta_orig") & _lost("delta_rep")).alias("n_win_to_loss"),
        F.count_if(_lost("delta_orig") & _won("delta_rep")).alias("n_loss_to_win"),
        *(F.grouping(k).alias(f"all_{k}") for k in keys),
    )
    return _all(out, keys)


def _all(out: DataFrame, keys: list[str]) -> DataFrame:
    return out.withColumns({k: F.when(F.col(f"all_{k}") == 1, F.lit("ALL")).otherwise(F.col(k)) for k in keys}).drop(*(f"all_{k}" for k in keys))


def group_stats(facts: DataFrame, by: list[str]) -> DataFrame:
    """Sixteen statistics for each value of each single key, in one pass over grouping sets."""
    out = facts.groupingSets([[F.col(k)] for k in by], *by).agg(
        F.count("*").alias("n_observations"),
        *(f(c).alias(f"{name}_{c}") for c in ("delta_acc", "delta_pf") for name, f in (("mean", F.avg), ("median", F.median), ("max", F.max), ("min", F.min))),
        F.count_if(_won("delta_acc")).alias("n_improved"),
        F.count_if(_lost("delta_acc")).alias("n_regressed"),
        F.count_if(F.abs("delta_acc") <= TIE).alias("n_flat"),
        *(F.avg(c).alias(f"mean_{c}") for c in ("orig_acc", "rep_acc", "orig_pf", "rep_pf")),
        *(F.grouping(k).alias(f"g_{k}") for k in by),
    )
    which = None
    for k in by:
        which = F.when(F.col(f"g_{k}") == 0, F.struct(F.lit(k).alias("axis"), F.col(k).alias("value"))) if which is None else which.when(F.col(f"g_{k}") == 0, F.struct(F.lit(k).alias("axis"), F.col(k).alias("value")))
    return out.select(which.alias("w"), *(c for c in out.columns if c not in by and not c.startswith("g_"))).select("w.axis", "w.value", "*").drop("w")


def crosstab(facts: DataFrame, a: str, b: str) -> DataFrame:
    return facts.groupBy(a, b).agg(F.count("*").alias("n_observations"), F.avg("delta_acc").alias("mean_delta_acc"), F.avg("delta_pf").alias("mean_delta_pf"))


def headline(facts: DataFrame) -> DataFrame:
    """One row. The largest drop of the failure rate is the smallest delta."""
    return facts.agg(
        F.count("*").alias("n_observations"),
        F.count_distinct("condition").alias("n_conditions"),
        F.avg("orig_acc").alias("mean_orig_acc"),
        F.avg("rep_acc").alias("mean_rep_acc"),
        F.avg("orig_pf").alias("mean_orig_pf"),
        F.avg("rep_pf").alias("mean_rep_pf"),
        F.median("delta_acc").alias("median_delta_acc"),
        F.max("delta_acc").alias("max_delta_acc"),
        F.min("delta_acc").alias("min_delta_acc"),
        F.min("delta_pf").alias("max_delta_pf_drop"),
        F.count_if(_won("delta_acc")).alias("n_improved"),
        F.count_if(_lost("delta_acc")).alias("n_regressed"),
        F.count_if(F.abs("delta_acc") <= TIE).alias("n_flat"),
        *(F.count_if(F.abs("delta_acc") > x).alias(f"n_moved_{int(100 * x)}pp") for x in (0.01, 0.05, 0.10)),
    )


# -- conditions, seeds, templates ---------------------------------------------------------------------------------------


def attributes(facts: DataFrame, dimension: DataFrame) -> DataFrame:
    """With the condition's target language, volume and family ('' if unknown) and the matched flags."""
    out = facts.join(F.broadcast(dimension), "condition", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in dimension.columns if c != "condition"})
    return out.withColumns({"matched_diagonal": F.when(F.col("data") == F.col("instr"), "y").otherwise("n"), "matched_instr": F.when(F.col("target_lang") == F.col("instr"), "y").otherwise("n")})


def template_pairs(facts: DataFrame) -> DataFrame:
    """Both templates of a seed's cell side by side, where both ran."""
    key = [c for c in CELL if c != "template"]
    out = facts.groupBy(*key).pivot("template", ["1", "2"]).agg(F.first("rep_acc").alias("acc"), F.first("n").alias("n"))
    return out.where("`1_acc` is not null and `2_acc` is not null").select(*key, F.col("1_acc").alias("t1_acc"), F.col("2_acc").alias("t2_acc"), (F.col("2_acc") - F.col("1_acc")).alias("delta_t2_t1"), F.col("1_n").alias("t1_n"), F.col("2_n").alias("t2_n"))


def same_language(facts: DataFrame, dimension: DataFrame, anchors: list[str]) -> DataFrame:
    """For each target language the conditions trained on it and the anchors, at every place: mean over seeds."""
    means = facts.groupBy("condition", *PLACE).agg(F.avg("rep_acc").alias("mean_acc"), F.count("*").alias("n_seeds"))
    langs = dimension.where("target_lang != ''").select(F.col("target_lang").alias("target")).distinct()
    wanted = langs.crossJoin(dimension.select("condition", "target_lang")).where((F.col("target_lang") == F.col("target")) | F.col("condition").isin(anchors)).select("target", "condition")
    return means.join(F.broadcast(wanted), "condition").select("target", "condition", *PLACE, F.when(F.col("data") == F.col("instr"), "y").otherwise("n").alias("matched_diagonal"), "mean_acc", "n_seeds")


def volume_pairs(facts: DataFrame, dimension: DataFrame) -> DataFrame:
    """The two data volumes of a family at every place, where both ran."""
    means = facts.join(F.broadcast(dimension), "condition").where("family != ''").groupBy("family", *PLACE).pivot("volume", ["5k", "20k"]).agg(F.avg("rep_acc"))
    return means.where("`5k` is not null and `20k` is not null").select("family", *PLACE, F.col("5k").alias("acc_5k"), F.col("20k").alias("acc_20k"), (F.col("20k") - F.col("5k")).alias("delta"))


def decomposition(facts: DataFrame, anchor: str, exclude: list[str], name: str = BASELINE) -> DataFrame:
    """cond - base = (anchor - base) + (cond - anchor) at every place and seed that has both."""
    base, other = baseline_of(facts, name).select(*PLACE, "base_rep"), baseline_of(facts, anchor, "anchor").select(*PLACE, "anchor_rep")
    out = facts.where(~F.col("condition").isin(exclude)).join(base, PLACE).join(other, PLACE)
    return out.select(*CELL, "base_rep", "anchor_rep", F.col("rep_acc").alias("cond_rep"), (F.col("rep_acc") - F.col("base_rep")).alias("delta_base"), (F.col("anchor_rep") - F.col("base_rep")).alias("delta_anchor"), (F.col("rep_acc") - F.col("anchor_rep")).alias("delta_specific"))


def impact_matrix(facts: DataFrame, name: str = BASELINE) -> DataFrame:
    """Means by (condition, data, instr); the baseline's mean is over the condition's rows."""
    return vs_baseline(facts, name).groupBy("condition", "data", "instr").agg(F.count("*").alias("n_observations"), F.avg("cond_rep").alias("mean_acc"), F.avg("base_rep").alias("mean_base"), F.avg("delta_rep").alias("mean_delta"))


def seed_variance(facts: DataFrame) -> DataFrame:
    """Over the seeds of a cell; one seed has no deviation (null)."""
    acc = F.col("rep_acc")
    return facts.groupBy("condition", *PLACE).agg(
        F.count("*").alias("n_seeds"), F.avg(acc).alias("mean_acc"), F.stddev_samp(acc).alias("std_acc"), F.min(acc).alias("min_acc"), F.max(acc).alias("max_acc"), F.sum("n").alias("n_rows"), long(F.sum(F.round(acc * F.col("n")))).alias("n_correct")
    )


def unstable_signs(versus: DataFrame) -> DataFrame:
    """Cells whose mean delta over seeds is within two deviations of zero."""
    out = versus.groupBy("condition", *PLACE).agg(F.avg("delta_rep").alias("mean_delta"), F.stddev_samp("delta_rep").alias("sigma"), F.count("*").alias("n_seeds"))
    return out.where("abs(mean_delta) < 2 * sigma")


def template_robustness(facts: DataFrame) -> DataFrame:
    """Gap between templates per seed, mean over the seeds of a cell, then by condition ('ALL') and by benchmark."""
    gaps = template_pairs(facts).withColumn("gap", F.abs("delta_t2_t1"))
    per_cell = gaps.groupBy("condition", "benchmark", "data", "instr").agg(F.avg("gap").alias("gap"), F.count("*").alias("seeds"))
    out = per_cell.groupingSets([[F.col("condition")], [F.col("condition"), F.col("benchmark")]], "condition", "benchmark").agg(
        F.count("*").alias("n_cells"), F.min("seeds").alias("lo"), F.max("seeds").alias("hi"), F.avg("gap").alias("mean_gap"), F.median("gap").alias("median_gap"), F.max("gap").alias("max_gap"), F.count_if(F.col("gap") > BRITTLE).alias("n_brittle"), F.grouping("benchmark").alias("all_benchmark")
    )
    seeds = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")))
    return _all(out, ["benchmark"]).withColumn("seeds_per_cell", seeds).withColumn("frac_brittle", F.col("n_brittle") / F.col("n_cells")).drop("lo", "hi")


def benchmark_breakdown(facts: DataFrame, name: str = BASELINE) -> DataFrame:
    versus = vs_baseline(facts, name).withColumn("matched_diagonal", F.when(F.col("data") == F.col("instr"), "y").otherwise("n"))
    keys = ["condition", "benchmark", "matched_diagonal"]
    out = versus.groupingSets([[F.col(k) for k in keys], [F.col(k) for k in keys[:2]]], *keys).agg(
        F.count("*").alias("n_observations"), F.avg("delta_rep").alias("mean_delta"), F.median("delta_rep").alias("median_delta"), F.min("delta_rep").alias("min_delta"), F.max("delta_rep").alias("max_delta"), F.grouping("matched_diagonal").alias("all_matched_diagonal")
    )
    return _all(out, ["matched_diagonal"])


def recovery(facts: DataFrame) -> DataFrame:
    """Parse failures that the refined reading recovers, by condition ('ALL') and by benchmark."""
    got = facts.withColumn("recovery", F.col("orig_pf") - F.col("rep_pf"))
    out = got.groupingSets([[F.col("condition")], [F.col("condition"), F.col("benchmark")]], "condition", "benchmark").agg(
        F.count("*").alias("n_observations"), F.avg("recovery").alias("mean_recovery"), F.median("recovery").alias("median_recovery"), F.max("recovery").alias("max_recovery"), F.count_if(F.col("recovery") > HIGH).alias("n_high"), F.grouping("benchmark").alias("all_benchmark")
    )
    return _all(out, ["benchmark"])


def top_recoveries(facts: DataFrame, n: int = 50) -> DataFrame:
    """A ranking of the n largest recoveries; the full key breaks ties."""
    top = facts.withColumn("recovery", F.round(F.col("orig_pf") - F.col("rep_pf"), 9)).orderBy(F.desc("recovery"), *CELL).limit(n)
    return top.withColumn("rank", long(F.row_number().over(W.orderBy(F.desc("recovery"), *CELL)))).select("rank", *CELL, "recovery")


# -- verdicts ------------------------------------------------------------------------------------------------------------


def transition(before: Column | str, after: Column | str, floor: float = FLOOR) -> Column:
    """How a delta's sign and size change from one reading to the other."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (before, after))
    return (
        F.when((F.abs(a) < floor) & (F.abs(b) < floor), "neutral")
        .when((a > 0) & (b < 0), "flip_w2l")
        .when((a < 0) & (b > 0), "flip_l2w")
        .when((a > 0) == (b > 0), F.when(F.abs(b) < F.abs(a), "deflated").when(b > 0, "positive").otherwise("negative"))
        .otherwise("neutral")
    )


def verdict(before: str, after: str) -> Column:
    return F.when(_won(before) & _lost(after), "win_to_loss").when(_lost(before) & _won(after), "loss_to_win")


def flips(versus: DataFrame) -> DataFrame:
    """Catalogue of cells whose verdict against the baseline turns around."""
    out = versus.withColumn("verdict", verdict("delta_orig", "delta_rep")).where("verdict is not null")
    return out.select(*CELL, "delta_orig", "delta_rep", (F.col("delta_rep") - F.col("delta_orig")).alias("shift"), "verdict")


def flips_by_condition(versus: DataFrame, buffer: float = VERDICT) -> DataFrame:
    """Mean deltas by (condition, benchmark) with the turned-around ones beyond the buffer marked."""
    out = versus.groupBy("condition", "benchmark").agg(F.avg("delta_orig").alias("mean_orig"), F.avg("delta_rep").alias("mean_rep"), F.count_if(F.abs("delta_rep") > FLOOR).alias("n_material"))
    return out.withColumn("turned", (F.signum("mean_orig") * F.signum("mean_rep") < 0) & (F.abs("mean_orig") > buffer) & (F.abs("mean_rep") > buffer))


def movers(facts: DataFrame, column: str, n: int, down: bool = False) -> DataFrame:
    """The n cells that move most; the full key breaks ties."""
    order = F.round(F.col(column), 9)
    return facts.orderBy(order.asc() if down else order.desc(), *CELL).limit(n).select(*CELL, F.col(column).alias("moved"))


def quadrants(versus: DataFrame) -> DataFrame:
    a, b = F.signum("delta_orig"), F.signum("delta_rep")
    which = F.when((a == 0) | (b == 0), "on_axes").otherwise(F.concat(F.when(a > 0, "up").otherwise("down"), F.lit("_"), F.when(b > 0, "up").otherwise("down")))
    return versus.groupBy(which.alias("quadrant")).agg(F.count("*").alias("n"))


def grid(facts: DataFrame, rows: list[str], column: str, values: list[str], value: str = "rep_acc") -> DataFrame:
    """A pivot of means with a column for each listed value."""
    return facts.groupBy(*rows).pivot(column, values).agg(F.avg(value))


def matched_stats(facts: DataFrame, dimension: DataFrame) -> DataFrame:
    """Matched-instruction accuracy: templates averaged inside a seed, then mean and deviation over seeds."""
    matched = attributes(facts, dimension).where("matched_instr = 'y'")
    per_seed = matched.groupBy("condition", "benchmark", "seed").agg(F.avg("rep_acc").alias("acc"))
    return per_seed.groupBy("condition", "benchmark").agg(F.avg("acc").alias("mean_acc"), F.stddev_samp("acc").alias("std_acc"), F.count("*").alias("n_seeds"))


def variance_table(facts: DataFrame) -> DataFrame:
    """Variance of per-seed means by condition and benchmark, over all data languages ('ALL') and by each."""
    sets = [[F.col(c) for c in ("condition", "benchmark", "seed")], [F.col(c) for c in ("condition", "benchmark", "seed", "data")]]
    per_seed = _all(facts.groupingSets(sets, "condition", "benchmark", "seed", "data").agg(F.avg("rep_acc").alias("acc"), F.grouping("data").alias("all_data")), ["data"])
    return per_seed.groupBy("condition", "benchmark", "data").agg(F.count("*").alias("n_seeds"), F.avg("acc").alias("mean_acc"), F.stddev_samp("acc").alias("std_acc"), F.min("acc").alias("min_acc"), F.max("acc").alias("max_acc"))


def paired_by_seed(facts: DataFrame, a: str, b: str) -> DataFrame:
    """Difference of two conditions at equal seed and place."""
    one, two = (facts.where(F.col("condition") == c).select("seed", *PLACE, F.col("rep_acc").alias(n)) for c, n in ((a, "acc_a"), (b, "acc_b")))
    return one.join(two, ["seed", *PLACE]).withColumn("difference", F.col("acc_a") - F.col("acc_b"))


def regression_counts(versus: DataFrame) -> DataFrame:
    """Conditions by how many cells fall below the baseline, most first."""
    return versus.groupBy("condition").agg(F.count_if(_lost("delta_rep")).alias("n_regressed"), F.count("*").alias("n_observations")).withColumn("share", F.col("n_regressed") / F.col("n_observations"))

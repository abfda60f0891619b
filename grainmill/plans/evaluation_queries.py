"""Queries from scored answers to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import labels, stats
from grainmill.operators import answers as ans
from grainmill.operators import bootstrap
from grainmill.operators import evaluation as ev
from grainmill.operators import prompts as pr
from grainmill.plans.bindings import ANSWERS, CELLS, DIMENSION, LABELS, VERSUS, answers, dimension
from grainmill.session import table
from grainmill.sources.results import answers as parse_answers

CELL = "condition, seed, template, benchmark, data, instr"
PLACE = "template, benchmark, data, instr"


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def facts(spark, d):
    return ev.cells(answers(spark, d))


def versus(spark, d):
    return ev.vs_baseline(facts(spark, d))


QUERIES: dict = {}


def add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = (query, sql)


_CELL_COLS = ", ".join(r(c, c) for c in ("orig_acc", "rep_acc", "orig_pf", "rep_pf", "delta_acc", "delta_pf"))
add("a12_a13_cells", facts, f"WITH {CELLS} SELECT {CELL}, n, {_CELL_COLS} FROM cells")
add("a13_changed_cells", lambda s, d: ev.changed(facts(s, d)), f"WITH {CELLS} SELECT {CELL}, n, {_CELL_COLS} FROM cells WHERE abs(delta_acc) > 1e-9 OR abs(delta_pf) > 1e-9")
add("a14_legacy_scores", lambda s, d: ev.legacy_scores(answers(s, d)), f"WITH {ANSWERS} SELECT {CELL}, count(*) AS n, {r('avg(coalesce(pred = gold, false)::int::double)', 'acc')} FROM er WHERE raw_output <> '' GROUP BY ALL")
add("x29_cell_keys", lambda s, d: ev.cell_key(facts(s, d)).select("condition", "seed", "cell", *(c.alias(f"k_{n}") for n, c in ev.parse_cell_key(F.col("cell")).items())), f"WITH {CELLS} SELECT condition, seed, 'template' || template || '_' || benchmark || '_data=' || data || '_instr=' || instr AS cell, template AS k_template, benchmark AS k_benchmark, data AS k_data, instr AS k_instr FROM cells")

_V = ", ".join(r(c, c) for c in ("base_orig", "base_rep", "cond_orig", "cond_rep", "orig_pf", "rep_pf", "delta_orig", "delta_rep"))
add("j01_vs_baseline", versus, f"WITH {VERSUS} SELECT {CELL}, n, {_V} FROM versus")
_WL = ", ".join(
    ["count(*) AS n_observations"]
    + [r(f"avg({c})", f"mean_{c}") for c in ("base_orig", "base_rep", "cond_orig", "cond_rep", "delta_orig", "delta_rep")]
    + [f"count(*) FILTER (delta_{s} {op}) AS n_{n}_{s}" for s in ("orig", "rep") for n, op in (("wins", "> 1e-6"), ("losses", "< -1e-6"))]
    + ["count(*) FILTER (delta_orig > 1e-6 AND delta_rep < -1e-6) AS n_win_to_loss", "count(*) FILTER (delta_orig < -1e-6 AND delta_rep > 1e-6) AS n_loss_to_win"]
)


def _all(*cols: str) -> str:
    return ", ".join(f"CASE WHEN grouping({c}) = 1 THEN 'ALL' ELSE {c} END AS {c}" for c in cols)


add("a18_win_loss", lambda s, d: ev.win_loss(versus(s, d), [["condition"], ["condition", "benchmark"], ["condition", "instr"]]), f"WITH {VERSUS} SELECT {_all('condition', 'benchmark', 'instr')}, {_WL} FROM versus GROUP BY GROUPING SETS ((condition), (condition, benchmark), (condition, instr))")
_GS = ", ".join(
    ["count(*) AS n_observations"]
    + [r(f"{f}({c})", f"{n}_{c}") for c in ("delta_acc", "delta_pf") for n, f in (("mean", "avg"), ("median", "median"), ("max", "max"), ("min", "min"))]
    + ["count(*) FILTER (delta_acc > 1e-6) AS n_improved", "count(*) FILTER (delta_acc < -1e-6) AS n_regressed", "count(*) FILTER (abs(delta_acc) <= 1e-6) AS n_flat"]
    + [r(f"avg({c})", f"mean_{c}") for c in ("orig_acc", "rep_acc", "orig_pf", "rep_pf")]
)
_AXES = ("benchmark", "instr", "data", "condition", "template")
add("a15_group_stats", lambda s, d: ev.group_stats(facts(s, d), list(_AXES)), f"WITH {CELLS} " + " UNION ALL ".join(f"SELECT '{a}' AS axis, {a} AS value, {_GS} FROM cells GROUP BY {a}" for a in _AXES))
add("a16_crosstab", lambda s, d: ev.crosstab(facts(s, d), "condition", "benchmark"), f"WITH {CELLS} SELECT condition, benchmark, count(*) AS n_observations, {r('avg(delta_acc)', 'mean_delta_acc')}, {r('avg(delta_pf)', 'mean_delta_pf')} FROM cells GROUP BY 1, 2")
add(
    "a17_headline",
    lambda s, d: ev.headline(facts(s, d)),
    f"WITH {CELLS} SELECT count(*) AS n_observations, count(DISTINCT condition) AS n_conditions, {r('avg(orig_acc)', 'mean_orig_acc')}, {r('avg(rep_acc)', 'mean_rep_acc')}, {r('avg(orig_pf)', 'mean_orig_pf')}, {r('avg(rep_pf)', 'mean_rep_pf')}, {r('median(delta_acc)', 'median_delta_acc')}, {r('max(delta_acc)', 'max_delta_acc')}, {r('min(delta_acc)', 'min_delta_acc')}, {r('min(delta_pf)', 'max_delta_pf_drop')}, count(*) FILTER (delta_acc > 1e-6) AS n_improved, count(*) FILTER (delta_acc < -1e-6) AS n_regressed, count(*) FILTER (abs(delta_acc) <= 1e-6) AS n_flat, "
    + ", ".join(f"count(*) FILTER (abs(delta_acc) > {x}) AS n_moved_{int(100 * x)}pp" for x in (0.01, 0.05, 0.10))
    + " FROM cells",
)
_DIAG = "CASE WHEN data = instr THEN 'y' ELSE 'n' END"
add("j09_f15_attributes", lambda s, d: ev.attributes(facts(s, d), dimension(s)).select(*ev.CELL, "target_lang", "volume", "matched_diagonal", "matched_instr"), f"WITH {CELLS}, {DIMENSION} SELECT {CELL}, coalesce(target_lang, '') AS target_lang, coalesce(volume, '') AS volume, {_DIAG} AS matched_diagonal, CASE WHEN coalesce(target_lang, '') = instr THEN 'y' ELSE 'n' END AS matched_instr FROM cells LEFT JOIN dim USING (condition)")
_PAIRS = "pairs AS (SELECT a.condition, a.seed, a.benchmark, a.data, a.instr, a.rep_acc AS t1_acc, b.rep_acc AS t2_acc, b.rep_acc - a.rep_acc AS delta_t2_t1, a.n AS t1_n, b.n AS t2_n FROM cells a JOIN cells b USING (condition, seed, benchmark, data, instr) WHERE a.template = '1' AND b.template = '2')"
add("j11_template_pairs", lambda s, d: ev.template_pairs(facts(s, d)), f"WITH {CELLS}, {_PAIRS} SELECT condition, seed, benchmark, data, instr, {r('t1_acc', 't1_acc')}, {r('t2_acc', 't2_acc')}, {r('delta_t2_t1', 'delta_t2_t1')}, t1_n, t2_n FROM pairs")
add("a19_j10_same_language", lambda s, d: ev.same_language(facts(s, d), dimension(s), ["baseline", "building-5k"]), f"WITH {CELLS}, {DIMENSION}, m AS (SELECT condition, {PLACE}, avg(rep_acc) AS a, count(*) AS n_seeds FROM cells GROUP BY ALL), w AS (SELECT l.target, c.condition FROM (SELECT DISTINCT target_lang AS target FROM dim WHERE target_lang <> '') l JOIN dim c ON c.target_lang = l.target OR c.condition IN ('baseline', 'building-5k')) SELECT target, condition, {PLACE}, {_DIAG} AS matched_diagonal, {r('a', 'mean_acc')}, n_seeds FROM m JOIN w USING (condition)")
add("j12_volume_pairs", lambda s, d: ev.volume_pairs(facts(s, d), dimension(s)), f"WITH {CELLS}, {DIMENSION}, m AS (SELECT family, volume, {PLACE}, avg(rep_acc) AS a FROM cells JOIN dim USING (condition) WHERE family <> '' GROUP BY ALL) SELECT family, {PLACE}, {r('x.a', 'acc_5k')}, {r('y.a', 'acc_20k')}, {r('y.a - x.a', 'delta')} FROM m x JOIN m y USING (family, {PLACE}) WHERE x.volume = '5k' AND y.volume = '20k'")
add("j08_decomposition", lambda s, d: ev.decomposition(facts(s, d), "building-5k", ["baseline", "building-5k", "building-20k"]), f"WITH {VERSUS}, anchor AS (SELECT {PLACE}, avg(rep_acc) AS anchor_rep FROM cells WHERE condition = 'building-5k' GROUP BY ALL) SELECT {CELL}, {r('base_rep', 'base_rep')}, {r('anchor_rep', 'anchor_rep')}, {r('cond_rep', 'cond_rep')}, {r('cond_rep - base_rep', 'delta_base')}, {r('anchor_rep - base_rep', 'delta_anchor')}, {r('cond_rep - anchor_rep', 'delta_specific')} FROM versus JOIN anchor USING ({PLACE}) WHERE condition NOT IN ('building-5k', 'building-20k')")
add("a20_impact_matrix", lambda s, d: ev.impact_matrix(facts(s, d)), f"WITH {VERSUS} SELECT condition, data, instr, count(*) AS n_observations, {r('avg(cond_rep)', 'mean_acc')}, {r('avg(base_rep)', 'mean_base')}, {r('avg(delta_rep)', 'mean_delta')} FROM versus GROUP BY 1, 2, 3")
add("a21_seed_variance", lambda s, d: ev.seed_variance(facts(s, d)), f"WITH {CELLS} SELECT condition, {PLACE}, count(*) AS n_seeds, {r('avg(rep_acc)', 'mean_acc')}, {r('stddev_samp(rep_acc)', 'std_acc')}, {r('min(rep_acc)', 'min_acc')}, {r('max(rep_acc)', 'max_acc')}, sum(n)::bigint AS n_rows, sum(round(rep_acc * n))::bigint AS n_correct FROM cells GROUP BY ALL")
add("m09_unstable_signs", lambda s, d: ev.unstable_signs(versus(s, d)), f"WITH {VERSUS} SELECT condition, {PLACE}, {r('avg(delta_rep)', 'mean_delta')}, {r('stddev_samp(delta_rep)', 'sigma')}, count(*) AS n_seeds FROM versus GROUP BY ALL HAVING abs(avg(delta_rep)) < 2 * stddev_samp(delta_rep)")
_GAP = f"{_PAIRS}, gaps AS (SELECT condition, benchmark, data, instr, avg(abs(delta_t2_t1)) AS gap, count(*) AS seeds FROM pairs GROUP BY ALL)"
add("a22_template_robustness", lambda s, d: ev.template_robustness(facts(s, d)), f"WITH {CELLS}, {_GAP} SELECT condition, {_all('benchmark')}, count(*) AS n_cells, {r('avg(gap)', 'mean_gap')}, {r('median(gap)', 'median_gap')}, {r('max(gap)', 'max_gap')}, count(*) FILTER (gap > 0.10) AS n_brittle, CASE WHEN min(seeds) = max(seeds) THEN min(seeds)::varchar ELSE min(seeds) || '-' || max(seeds) END AS seeds_per_cell, {r('count(*) FILTER (gap > 0.10) / count(*)', 'frac_brittle')} FROM gaps GROUP BY GROUPING SETS ((condition), (condition, benchmark))")
add("a23_benchmark_breakdown", lambda s, d: ev.benchmark_breakdown(facts(s, d)), f"WITH {VERSUS}, v AS (SELECT *, {_DIAG} AS matched_diagonal FROM versus) SELECT condition, benchmark, {_all('matched_diagonal')}, count(*) AS n_observations, {r('avg(delta_rep)', 'mean_delta')}, {r('median(delta_rep)', 'median_delta')}, {r('min(delta_rep)', 'min_delta')}, {r('max(delta_rep)', 'max_delta')} FROM v GROUP BY GROUPING SETS ((condition, benchmark, matched_diagonal), (condition, benchmark))")
_REC = "rec AS (SELECT *, orig_pf - rep_pf AS recovery FROM cells)"
add("a24_recovery", lambda s, d: ev.recovery(facts(s, d)), f"WITH {CELLS}, {_REC} SELECT condition, {_all('benchmark')}, count(*) AS n_observations, {r('avg(recovery)', 'mean_recovery')}, {r('median(recovery)', 'median_recovery')}, {r('max(recovery)', 'max_recovery')}, count(*) FILTER (recovery > 0.05) AS n_high FROM rec GROUP BY GROUPING SETS ((condition), (condition, benchmark))")
add("w11_top_recoveries", lambda s, d: ev.top_recoveries(facts(s, d)), f"WITH {CELLS}, k AS (SELECT {CELL}, round(orig_pf - rep_pf, 9) AS recovery FROM cells) SELECT row_number() OVER (ORDER BY recovery DESC, {CELL}) AS rank, {CELL}, {r('recovery', 'recovery')} FROM k QUALIFY rank <= 50")
_VERDICT = "CASE WHEN delta_orig > 1e-6 AND delta_rep < -1e-6 THEN 'win_to_loss' WHEN delta_orig < -1e-6 AND delta_rep > 1e-6 THEN 'loss_to_win' END"
add("x31_flips", lambda s, d: ev.flips(versus(s, d)), f"WITH {VERSUS} SELECT {CELL}, {r('delta_orig', 'delta_orig')}, {r('delta_rep', 'delta_rep')}, {r('delta_rep - delta_orig', 'shift')}, {_VERDICT} AS verdict FROM versus WHERE {_VERDICT} IS NOT NULL")
_TRANS = "CASE WHEN abs(delta_orig) < 0.005 AND abs(delta_rep) < 0.005 THEN 'neutral' WHEN delta_orig > 0 AND delta_rep < 0 THEN 'flip_w2l' WHEN delta_orig < 0 AND delta_rep > 0 THEN 'flip_l2w' WHEN (delta_orig > 0) = (delta_rep > 0) THEN CASE WHEN abs(delta_rep) < abs(delta_orig) THEN 'deflated' WHEN delta_rep > 0 THEN 'positive' ELSE 'negative' END ELSE 'neutral' END"
add("a35_transitions", lambda s, d: versus(s, d).groupBy("benchmark", "condition").agg(F.avg("delta_orig").alias("delta_orig"), F.avg("delta_rep").alias("delta_rep")).withColumn("transition", ev.transition("delta_orig", "delta_rep")), f"WITH {VERSUS}, g AS (SELECT benchmark, condition, avg(delta_orig) AS delta_orig, avg(delta_rep) AS delta_rep FROM versus GROUP BY ALL) SELECT benchmark, condition, {r('delta_orig', 'delta_orig')}, {r('delta_rep', 'delta_rep')}, {_TRANS} AS transition FROM g")
add("a34_flips_by_condition", lambda s, d: ev.flips_by_condition(versus(s, d)), f"WITH {VERSUS}, g AS (SELECT condition, benchmark, avg(delta_orig) AS o, avg(delta_rep) AS p, count(*) FILTER (abs(delta_rep) > 0.005) AS n_material FROM versus GROUP BY ALL) SELECT condition, benchmark, {r('o', 'mean_orig')}, {r('p', 'mean_rep')}, n_material, (sign(o) * sign(p) < 0) AND abs(o) > 0.01 AND abs(p) > 0.01 AS turned FROM g")
add("t05_movers", lambda s, d: ev.movers(facts(s, d), "delta_acc", 25), f"WITH {CELLS} SELECT {CELL}, {r('delta_acc', 'moved')} FROM cells ORDER BY round(delta_acc, 9) DESC, {CELL} LIMIT 25")
add("t05_losers", lambda s, d: ev.movers(facts(s, d), "delta_acc", 25, down=True), f"WITH {CELLS} SELECT {CELL}, {r('delta_acc', 'moved')} FROM cells ORDER BY round(delta_acc, 9), {CELL} LIMIT 25")
_Q = "CASE WHEN sign(delta_orig) = 0 OR sign(delta_rep) = 0 THEN 'on_axes' ELSE (CASE WHEN delta_orig > 0 THEN 'up' ELSE 'down' END) || '_' || (CASE WHEN delta_rep > 0 THEN 'up' ELSE 'down' END) END"
add("a36_quadrants", lambda s, d: ev.quadrants(versus(s, d)), f"WITH {VERSUS} SELECT {_Q} AS quadrant, count(*) AS n FROM versus GROUP BY 1")
add("a32_grid", lambda s, d: ev.grid(facts(s, d), ["condition"], "instr", ["en", "es", "zh", "ur"]), f"WITH {CELLS} SELECT condition, " + ", ".join(f"round(avg(rep_acc) FILTER (instr = '{x}'), 6) + 0.0 AS \"{x}\"" for x in ("en", "es", "zh", "ur")) + " FROM cells GROUP BY 1")
add("a33_matched_stats", lambda s, d: ev.matched_stats(facts(s, d), dimension(s)), f"WITH {CELLS}, {DIMENSION}, p AS (SELECT condition, benchmark, seed, avg(rep_acc) AS a FROM cells JOIN dim USING (condition) WHERE target_lang = instr GROUP BY ALL) SELECT condition, benchmark, {r('avg(a)', 'mean_acc')}, {r('stddev_samp(a)', 'std_acc')}, count(*) AS n_seeds FROM p GROUP BY ALL")
add("a39_variance_table", lambda s, d: ev.variance_table(facts(s, d)), f"WITH {CELLS}, p AS (SELECT condition, benchmark, seed, {_all('data')}, avg(rep_acc) AS a FROM cells GROUP BY GROUPING SETS ((condition, benchmark, seed), (condition, benchmark, seed, cells.data))) SELECT condition, benchmark, data, count(*) AS n_seeds, {r('avg(a)', 'mean_acc')}, {r('stddev_samp(a)', 'std_acc')}, {r('min(a)', 'min_acc')}, {r('max(a)', 'max_acc')} FROM p GROUP BY ALL")
add("j17_paired_by_seed", lambda s, d: ev.paired_by_seed(facts(s, d), "building-5k", "household-5k"), f"WITH {CELLS} SELECT seed, {PLACE}, {r('a.rep_acc', 'acc_a')}, {r('b.rep_acc', 'acc_b')}, {r('a.rep_acc - b.rep_acc', 'difference')} FROM cells a JOIN cells b USING (seed, {PLACE}) WHERE a.condition = 'building-5k' AND b.condition = 'household-5k'")
add("t09_regression_counts", lambda s, d: ev.regression_counts(versus(s, d)), f"WITH {VERSUS} SELECT condition, count(*) FILTER (delta_rep < -1e-6) AS n_regressed, count(*) AS n_observations, {r('count(*) FILTER (delta_rep < -1e-6) / count(*)', 'share')} FROM versus GROUP BY 1")

# -- answers -------------------------------------------------------------------------------------------------------------

_SAID = "said AS (SELECT *, nullif(lower(trim(regexp_replace(split_part(raw_output, chr(10), 1), '\\s+', ' ', 'g'))), '') AS said FROM er)"
_RIGHT = "coalesce(pred = gold, false)"
_BY = "condition, benchmark"


def _top(col: str, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT {_BY}, {col} AS {name}_v, count(*) AS {name}_k FROM said WHERE {col} IS NOT NULL GROUP BY {_BY}, {col}) QUALIFY row_number() OVER (PARTITION BY {_BY} ORDER BY {name}_k DESC, {name}_v) = 1)"


add(
    "a25_constant_output",
    lambda s, d: ans.constant_output(answers(s, d), ["condition", "benchmark"]),
    f"WITH {ANSWERS}, {_SAID}, {_top('pred', 'tp')}, {_top('said', 'tr')}, g AS (SELECT {_BY}, count(*) AS n, count(*) FILTER ({_RIGHT}) AS n_right, any_value(tp_v) AS top_pred, coalesce(any_value(tp_k), 0) AS top_pred_count, any_value(tr_v) AS top_raw, coalesce(any_value(tr_k), 0) AS top_raw_count, count(*) FILTER ({_RIGHT} AND pred = tp_v) AS n_right_pred, count(*) FILTER ({_RIGHT} AND said = tr_v) AS n_right_raw FROM said LEFT JOIN tp USING ({_BY}) LEFT JOIN tr USING ({_BY}) GROUP BY ALL) "
    f"SELECT *, {r('top_pred_count / n', 'top_pred_share')}, {r('top_raw_count / n', 'top_raw_share')}, {r('CASE WHEN n_right > 0 THEN n_right_pred / n_right ELSE 0 END', 'right_via_pred')}, {r('CASE WHEN n_right > 0 THEN n_right_raw / n_right ELSE 0 END', 'right_via_raw')} FROM g",
)
_CONF = ", ".join(f"count(*) FILTER (pred = '{x}') AS pred_{x}" for x in LABELS)
add(
    "a26_a27_confusion",
    lambda s, d: ans.confusion(answers(s, d), list(LABELS), ["condition", "benchmark"]),
    f"WITH {ANSWERS}, n AS (SELECT {_BY}, count(*) AS n_cell FROM er GROUP BY ALL), k AS (SELECT {_BY}, gold, count(*) AS n_gold, {_CONF}, count(*) FILTER (pred IS NULL) AS pred_none, count(*) FILTER (pred = gold) AS n_right FROM er GROUP BY ALL) SELECT {_BY}, n_cell, gold, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_gold", *(f"pred_{x}" for x in LABELS), "pred_none", "n_right"))
    + f", {r('n_right / n_gold', 'recall')} FROM n CROSS JOIN (SELECT unnest(['a','b','c']) AS gold) LEFT JOIN k USING ({_BY}, gold)",
)
_OUT = "CASE WHEN pred IS NULL THEN 'parse_fail' WHEN pred = gold THEN 'correct' ELSE 'wrong_label' END"
_VIA = "CASE WHEN item % 2 = 0 THEN 'even' ELSE 'odd' END"
_MULTI = "len(string_split(regexp_replace(raw_output, '^\\s+|\\s+$', '', 'g'), chr(10))) > 1"
add("a28_buckets", lambda s, d: ans.buckets(answers(s, d).withColumn("via", F.when(F.col("item") % 2 == 0, "even").otherwise("odd")), ["benchmark"]), f"WITH {ANSWERS} SELECT benchmark, {_OUT} AS outcome, {_VIA} AS via, count(*) AS n, count(*) FILTER ({_MULTI}) AS n_multiline FROM er GROUP BY ALL")
_FORM = "trim(split_part(regexp_replace(raw_output, '^\\s+|\\s+$', '', 'g'), chr(10), 1))"
add("a29_surface_forms", lambda s, d: ans.surface_forms(answers(s, d), ["benchmark"]), f"WITH {ANSWERS} SELECT benchmark, {_FORM} AS form, count(*) AS n, count(DISTINCT ({CELL})) AS n_cells, " + ", ".join(f"count(*) FILTER ({_OUT} = '{k}') AS n_{k}" for k in ("correct", "wrong_label", "parse_fail")) + " FROM er GROUP BY ALL")
add("a30_prefix_clusters", lambda s, d: ans.prefix_clusters(answers(s, d), 8), f"WITH {ANSWERS} SELECT left(trim(regexp_replace(raw_output, '\\s+', ' ', 'g')), 8) AS prefix, count(*) AS n FROM er GROUP BY 1")
add("a40_edge", lambda s, d: ans.edge(answers(s, d), ["condition", "benchmark"], list(LABELS)), f"WITH {ANSWERS} SELECT {_BY}, count(*) AS n, {r(f'avg({_RIGHT}::int::double)', 'acc')}, {r('avg((pred IS NOT NULL)::int::double)', 'parsed')}, {r(' + '.join(f'''(count(*) FILTER (pred = '{x}') / count(*)) * (count(*) FILTER (gold = '{x}') / count(*))''' for x in LABELS), 'null_acc')}, {r(f'avg({_RIGHT}::int::double) - avg((pred IS NOT NULL)::int::double) / 3', 'edge')} FROM er GROUP BY ALL")
add("a41_label_shares", lambda s, d: ans.label_shares(answers(s, d), ["condition"]), f"WITH {ANSWERS}, k AS (SELECT condition, coalesce(pred, 'none') AS label, count(*) AS n FROM er GROUP BY 1, 2) SELECT condition, label, n, (sum(n) OVER (PARTITION BY condition))::bigint AS total, {r('n / sum(n) OVER (PARTITION BY condition)', 'share')} FROM k")
add("a41_item_agreement", lambda s, d: ans.agreement_by_item(answers(s, d).withColumn("item", F.col("item") % 997), ["item"]), f"WITH {ANSWERS} SELECT item % 997 AS item, count(*) AS n, bool_and({_RIGHT}) AS all_right, NOT bool_or({_RIGHT}) AS all_wrong, {r('avg((pred <> gold)::int::double)', 'error_share')} FROM er GROUP BY 1")
add("j18_transitions", lambda s, d: ans.transitions(answers(s, d).select("item", F.col("orig_pred").alias("pred")), answers(s, d), ["item"]), f"WITH {ANSWERS} SELECT coalesce(a.orig_pred, 'none') AS from_pred, coalesce(b.pred, 'none') AS to_pred, count(*) AS n FROM er a JOIN er b USING (item) GROUP BY 1, 2")
add("j16_cross_check", lambda s, d: ans.cross_check(ev.legacy_scores(answers(s, d)).select(*ev.CELL, "acc"), facts(s, d).where("n % 4 > 0").select(*ev.CELL, F.round(F.col("rep_acc") + F.when(F.col("n") % 5 == 0, 0.01).otherwise(0.0), 6).alias("published")), ev.CELL), f"WITH {CELLS}, x AS (SELECT {CELL}, round(rep_acc, 6) AS acc, CASE WHEN n % 4 > 0 THEN round(rep_acc + CASE WHEN n % 5 = 0 THEN 0.01 ELSE 0.0 END, 6) END AS published FROM cells) SELECT {CELL}, {r('acc', 'acc')}, {r('published', 'published')} FROM x WHERE published IS NULL OR abs(acc - published) > 1e-9")
add("v06_self_test", lambda s, d: ans.disagreements(answers(s, d), "orig_pred", "pred"), f"WITH {ANSWERS} SELECT count(*) AS n, count(*) FILTER (orig_pred IS DISTINCT FROM pred) AS n_differ FROM er")

# -- statistics ------------------------------------------------------------------------------------------------------------

_STATS = f"""{VERSUS}, cond AS (SELECT condition, benchmark, data, instr, count(*) AS n_cond, avg(cond_rep) AS cond_acc, var_samp(cond_rep) AS var_cond, sum(cond_rep * n) AS right_cond, sum(n) AS rows_cond FROM versus GROUP BY ALL),
bb AS (SELECT condition, benchmark, data, instr, count(*) AS n_base, avg(base_rep) AS base_acc, var_samp(base_rep) AS var_base FROM (SELECT DISTINCT condition, {PLACE}, base_rep FROM versus) GROUP BY ALL),
sd AS (SELECT condition, benchmark, data, instr, count(*) AS n_seeds, avg(a) AS seed_mean, stddev_samp(a) AS seed_sigma FROM (SELECT condition, benchmark, data, instr, seed, avg(cond_rep) AS a FROM versus GROUP BY ALL) GROUP BY ALL),
bs AS (SELECT benchmark, data, instr, sum(n) AS rows_base, sum(rep_acc * n) AS right_base FROM cells WHERE condition = 'baseline' GROUP BY ALL),
st AS (SELECT *, var_cond / n_cond AS ec, var_base / n_base AS eb, (right_cond + right_base) / (rows_cond + rows_base) AS pool FROM cond JOIN bb USING (condition, benchmark, data, instr) JOIN sd USING (condition, benchmark, data, instr) JOIN bs USING (benchmark, data, instr))"""
_TWO = "n_cond >= 2 AND n_base >= 2"
_STAT_COLS = ", ".join(
    [
        r("base_acc", "base_acc"), r("cond_acc", "cond_acc"), r("100 * (cond_acc - base_acc)", "delta_pp"), r("100 * seed_sigma", "seed_sigma_pp"),
        r("CASE WHEN seed_sigma > 0 THEN (seed_mean - base_acc) / (seed_sigma / sqrt(n_seeds)) END", "one_sample_t"), "CASE WHEN n_seeds >= 2 THEN n_seeds - 1 ELSE 0 END::bigint AS one_sample_df",
        r(f"CASE WHEN {_TWO} AND ec + eb > 0 THEN (cond_acc - base_acc) / sqrt(ec + eb) END", "welch_t"), r(f"CASE WHEN {_TWO} AND ec * ec / (n_cond - 1) + eb * eb / (n_base - 1) > 0 THEN (ec + eb) * (ec + eb) / (ec * ec / (n_cond - 1) + eb * eb / (n_base - 1)) END", "welch_df"),
        r("CASE WHEN pool * (1 - pool) > 0 THEN (right_cond / rows_cond - right_base / rows_base) / sqrt(pool * (1 - pool) * (1 / rows_cond + 1 / rows_base)) END", "z"),
    ]
)
add("m01_m02_m03_comparisons", lambda s, d: stats.comparisons(facts(s, d)), f"WITH {_STATS} SELECT condition, benchmark, data, instr, n_seeds, rows_cond::bigint AS n_rows_cond, rows_base::bigint AS n_rows_base, {_STAT_COLS} FROM st")
add("m04_significance", lambda s, d: stats.significance(facts(s, d)), None)
add("m06_significance_summary", lambda s, d: stats.significance_summary(stats.significance(facts(s, d))), None)
add("x34_scale_bound", lambda s, d: versus(s, d).groupBy("condition").agg(stats.scale_bound("delta_rep").alias("bound")), f"WITH {VERSUS} SELECT condition, round(CASE WHEN quantile_cont(abs(delta_rep), 0.95) = 0 THEN 1e-3 ELSE quantile_cont(abs(delta_rep), 0.95) END, 6) + 0.0 AS bound FROM versus GROUP BY 1")

# -- extractors, on an answer per document ---------------------------------------------------------------------------------------

TOPIC_CASES = ["travel", "Science and Technology", "politics / technology", "the answer is travel", "答案是travel", "科学和技术", "ciencia y tecnología.", "salud", "nothing", "", "sports, sport; sports", "a\ntravel", " \n health ", "[geography]", "sports and health"]
INFERENCE_CASES = ["Entailment.", "neutral", "it is a contradiction", "答案是entailment", "没有entailment", "没有明显的关系", "矛盾", "neutra", "等同", "none", "", "contradictions", "x\nneutral", "否定"]
CHOICE_CASES = ["A", "the answer is b.", "Answer: C", "ANSWERD", "banana", "E", "answer - e", "", "\nD) x", "abc", "(c)"]
_STRIP = "regexp_replace(answer, '^\\s+|\\s+$', '', 'g')"


def _literal(case: str) -> str:
    return "'" + case.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _spoken(cases: list[str]) -> str:
    """An answer per document: a case above the text, within its first line, or the text alone."""
    case = f"[{', '.join(map(_literal, cases))}][(doc_id // 3) % {len(cases)} + 1]"
    return f"c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {case} || chr(10) || text WHEN 1 THEN text ELSE split_part(text, ' ', 1) || ' / ' || {case} || ' ' || text END AS answer FROM documents)"


def _cases(spark, d, cases, label, via):
    case = F.element_at(F.array(*(F.lit(c) for c in cases)), (F.floor(F.col("doc_id") / 3) % len(cases) + 1).cast("int"))
    i = F.col("doc_id") % 3
    answer = F.when(i == 0, F.concat(case, F.lit("\n"), "text")).when(i == 1, F.col("text")).otherwise(F.concat(F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" / "), case, F.lit(" "), "text"))
    return table(spark, d, "documents").select("doc_id", answer.alias("answer")).select("doc_id", label("answer").alias("label"), via("answer").alias("via"))


_EDGE = " \t.,:;!?()\\[\\]{}\"''،۔。"
_FIRST = f"l AS (SELECT doc_id, answer, trim(split_part({_STRIP}, chr(10), 1)) AS line FROM c)"
_MAP = "MAP {" + ", ".join(f"'{form}': '{label}'" for label, forms in labels.TOPIC_FORMS.items() for form in forms) + "}"
_JOINED = "line"
for _word in labels.CONJUNCTIONS:
    _JOINED = f"replace({_JOINED}, '{_word}', '/')"


def _trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^[{_EDGE}]+|[{_EDGE}]+$', '', 'g')"


add(
    "x22_x23_topic",
    lambda s, d: _cases(s, d, TOPIC_CASES, labels.topic, labels.topic_via),
    f"WITH {_spoken(TOPIC_CASES)}, {_FIRST}, t AS (SELECT doc_id, {_trimmed('line')} AS line FROM l), n AS (SELECT doc_id, line, list_distinct(list_filter(list_transform(regexp_split_to_array({_JOINED}, '{labels.SEPARATORS}'), lambda p: {_MAP}[lower(trim({_trimmed('trim(p)')}))]), lambda x: x IS NOT NULL)) AS named, list_filter([{', '.join(repr(t) for t in labels.TOPICS)}], lambda t: contains(lower(line), t)) AS inside FROM t) "
    "SELECT doc_id, CASE WHEN len(named) = 1 THEN named[1] WHEN len(named) = 0 AND len(inside) = 1 THEN inside[1] END AS label, CASE WHEN len(named) >= 2 THEN 'multi_category' WHEN len(named) = 1 THEN 'single' WHEN len(inside) = 1 THEN 'fallback' ELSE 'none' END AS via FROM n",
)


def _inference_sql() -> tuple[str, str]:
    tiers = [
        ("tier1_english", [(f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_]){x}([^\\p{{L}}\\p{{N}}_]|$)')", x) for x in labels.INFERENCE]),
        ("tier1_native", [(f"contains(low, '{k}')", v) for k, v in labels.INFERENCE_FORMS.items()]),
        ("tier2_cjk_glued", [(f"NOT (contains(line, '没有') OR contains(line, '沒有')) AND contains(low, '{x}')", x) for x in labels.INFERENCE]),
        ("tier3_paraphrase", [(f"regexp_matches(line, '{p}')", x) for p, x in labels.PARAPHRASES]),
    ]
    label = "CASE " + " ".join(f"WHEN {t} THEN '{x}'" for _, cases in tiers for t, x in cases) + " END"
    via = "CASE " + " ".join(f"WHEN {' OR '.join(f'({t})' for t, _ in cases)} THEN '{name}'" for name, cases in tiers) + " ELSE 'none' END"
    return label, via


_INF = _inference_sql()
add("x19_x20_inference", lambda s, d: _cases(s, d, INFERENCE_CASES, labels.inference, labels.inference_via), f"WITH {_spoken(INFERENCE_CASES)}, {_FIRST}, n AS (SELECT doc_id, line, lower(line) AS low FROM l) SELECT doc_id, {_INF[0]} AS label, {_INF[1]} AS via FROM n")
_LONE = "regexp_extract(line, '(^|[^\\p{L}\\p{N}_])([ABCDE])([^\\p{L}\\p{N}_]|$)', 2)"
_AFTER = "regexp_extract(line, 'ANSWER\\s*[:\\-]?\\s*([ABCDE])', 1)"
add("x24_x25_choice", lambda s, d: _cases(s, d, CHOICE_CASES, labels.choice, labels.choice_via), f"WITH {_spoken(CHOICE_CASES)}, {_FIRST}, n AS (SELECT doc_id, upper(line) AS line FROM l), m AS (SELECT doc_id, line, {_LONE} AS lone, {_AFTER} AS after FROM n) SELECT doc_id, CASE WHEN lone <> '' THEN lone WHEN after <> '' THEN after END AS label, CASE WHEN lone <> '' AND line = lone THEN 'bare_letter' WHEN lone <> '' THEN 'letter_in_text' WHEN after <> '' THEN 'answer_prefix' ELSE 'none' END AS via FROM m")


def _results_file(spark, d):
    """A results file built from the answers, and read back."""
    named = ev.cell_key(answers(spark, d)).groupBy("condition", "seed", "cell").agg(F.sort_array(F.collect_list(F.struct("item", "raw_output", "gold", F.col("orig_pred").alias("pred")))).alias("rows"))
    files = named.select(F.concat_ws("/", "condition", "seed").alias("path"), F.concat(F.lit('{"summary": {"x_acc": 0.5}, "'), "cell", F.lit('": '), F.to_json("rows"), F.lit("}")).alias("value"))
    return parse_answers(files).groupBy("path", "cell", "template", "benchmark", "data", "instr").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("gold")).alias("n_right"))


add("s11_x39_results_json", _results_file, f"WITH {ANSWERS} SELECT concat_ws('/', condition, seed) AS path, 'template' || template || '_' || benchmark || '_data=' || data || '_instr=' || instr AS cell, template, benchmark, data, instr, count(*) AS n, count(*) FILTER (orig_pred = gold) AS n_right FROM er GROUP BY ALL")
add("x26_first_lines", lambda s, d: ans.surface_forms(table(s, d, "conversations").select(F.col("text").alias("raw_output"), "role", F.lit("x").alias("gold"), F.lit(None).cast("string").alias("pred"), "conv_id"), ["role"], ["conv_id"]).select("role", "form", "n", "n_cells"), "SELECT role, trim(split_part(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), 1)) AS form, count(*) AS n, count(DISTINCT conv_id) AS n_cells FROM conversations GROUP BY ALL")

# -- prompts and the evaluation matrix --------------------------------------------------------------------------------------

_DIM = ", ".join("('" + t + "', '" + i + "', '" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for b, t, i, p in pr.templates() if b == "topic")
add("x28_p03_prompts", lambda s, d: pr.prompts(s, table(s, d, "benchmark"), "topic").select("item_id", "template", "instr", F.md5("prompt").alias("prompt")), f"SELECT item_id, template, instr, md5(replace(pattern, '{{text}}', text)) AS prompt FROM benchmark CROSS JOIN (VALUES {_DIM}) t(template, instr, pattern)")


def _padded(spark, d):
    rows = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", "text", (F.col("conv_id") % 7).alias("batch"))
    return pr.padded(pr.tokenised(rows, lambda c: F.transform(F.split(c, " "), lambda w: F.length(w)), "text", 16), "batch", -1)


add("x36_x37_v09_padding", lambda s, d: _padded(s, d).select("conv_id", "turn", F.array_join("input_ids", ",").alias("ids"), F.array_join("attention_mask", ",").alias("mask")), "WITH t AS (SELECT conv_id, turn, conv_id % 7 AS batch, list_transform(string_split(text, ' ')[1:16], lambda w: length(w)) AS ids FROM conversations WHERE text IS NOT NULL), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) - len(ids) AS gap FROM t) SELECT conv_id, turn, array_to_string(list_concat(list_transform(range(gap), lambda x: -1), ids), ',') AS ids, array_to_string(list_concat(list_transform(range(gap), lambda x: 0), list_transform(ids, lambda x: 1)), ',') AS mask FROM m")
_FAMILIES = ("building", "furniture", "household", "machinery")
_LANGS = ["en", "es", "zh", "ur"]
_MATRIX = [("baseline", ["none"], _LANGS, _LANGS), *((f"{f}-{v}", ["42", "123", "456"], _LANGS, _LANGS) for f in _FAMILIES for v in ("5k", "20k"))]


def _matrix(s, d):
    """Evaluations planned, and how many of them have answers."""
    planned = pr.matrix(s, _MATRIX, ["topic", "inference", "choice5"])
    key = ["condition", "seed", "template", "benchmark", "data", "instr"]
    done = facts(s, d).select(*key, "n")
    return planned.join(done, key, "left").groupBy("condition", "seed", "benchmark").agg(F.count("*").alias("n_planned"), F.count("n").alias("n_done"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_answers"))


add(
    "g03_matrix",
    _matrix,
    f"""WITH {CELLS}, c AS (SELECT 'baseline' AS condition, 'none' AS seed UNION ALL SELECT f || '-' || v, s FROM (VALUES ('building'), ('furniture'), ('household'), ('machinery')) a(f), (VALUES ('5k'), ('20k')) b(v), (VALUES ('42'), ('123'), ('456')) t(s)),
  p AS (SELECT condition, seed, template, benchmark, data, instr FROM c, (VALUES ('1'), ('2')) t(template), (VALUES ('topic'), ('inference'), ('choice5')) b(benchmark), (VALUES ('en'), ('es'), ('zh'), ('ur')) x(data), (VALUES ('en'), ('es'), ('zh'), ('ur')) y(instr))
  SELECT condition, seed, benchmark, count(*) AS n_planned, count(n) AS n_done, coalesce(sum(n), 0)::BIGINT AS n_answers FROM p LEFT JOIN cells USING (condition, seed, template, benchmark, data, instr) GROUP BY ALL""",
)
add("a37_prompt_effect", lambda s, d: pr.prompt_effect(facts(s, d), "building-5k"), f"WITH {CELLS}, m AS (SELECT condition, benchmark, avg(rep_acc) FILTER (template = '1') AS t1, avg(rep_acc) FILTER (template = '2') AS t2 FROM cells GROUP BY 1, 2) SELECT m.condition, m.benchmark, {r('coalesce(m.t1, 0)', 'bar_t1')}, {r('coalesce(m.t2, 0)', 'bar_t2')}, {r('m.t2 - m.t1', 'effect')}, {r('m.t1 - a.t1', 'heat')} FROM m LEFT JOIN m a ON a.condition = 'building-5k' AND a.benchmark = m.benchmark")


# -- resampling ------------------------------------------------------------------------------------------------------------


def _scored(s, d):
    right = F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))
    was = F.col("orig_pred").eqNullSafe(F.col("gold"))
    return answers(s, d).select("condition", "benchmark", "item", right.alias("right"), was.alias("was"), (right.cast("bigint") - was.cast("bigint")).alias("gain"))


_DRAWN = f"""WITH {ANSWERS},
bounds AS (SELECT list(floor(c * 4294967296)::BIGINT) AS b FROM (SELECT sum(exp(-1) / factorial(k::INT)) OVER (ORDER BY k) AS c FROM range(12) t(k))),
scored AS (SELECT condition, benchmark, item, coalesce(pred = gold, false)::INT - (orig_pred IS NOT DISTINCT FROM gold)::INT AS gain FROM er),
digests AS (SELECT condition, benchmark, gain, blk, md5('42|' || blk || '|' || item) AS h FROM scored, range(25) t(blk)),
numbers AS (SELECT condition, benchmark, gain, blk * 4 + nth AS replicate, list_reduce(list_prepend(0, list_transform(range(8 * nth + 1, 8 * nth + 9), lambda p: instr('0123456789abcdef', substr(h, p, 1)) - 1))::BIGINT[], lambda x, y: x * 16 + y) AS u FROM digests, range(4) t(nth)),
drawn AS (SELECT condition, benchmark, replicate, gain, len(list_filter(b, lambda t: u >= t)) AS w FROM numbers, bounds),
means AS (SELECT condition, benchmark, sum(w * gain) / sum(w)::DOUBLE AS m FROM drawn GROUP BY condition, benchmark, replicate HAVING sum(w) > 0),
held AS (SELECT condition, benchmark, list_sort(list(m)) AS l FROM means GROUP BY 1, 2)"""
add(
    "m10_bootstrap",
    lambda s, d: bootstrap.interval(_scored(s, d), ["condition", "benchmark"], "item", "gain"),
    f"{_DRAWN} SELECT condition, benchmark, n_rows, {r('mean', 'mean')}, {r('l[greatest(ceil(len(l) * 0.025), 1)::INT]', 'low')}, {r('l[greatest(ceil(len(l) * 0.975), 1)::INT]', 'high')} FROM held JOIN (SELECT condition, benchmark, count(*) AS n_rows, avg(gain) AS mean FROM scored GROUP BY 1, 2) USING (condition, benchmark)",
)
add(
    "m10_mcnemar",
    lambda s, d: bootstrap.mcnemar(_scored(s, d), ["condition", "benchmark"], "right", "was"),
    f"""WITH {ANSWERS}, c AS (SELECT condition, benchmark, count(*) AS n, count(*) FILTER (ok AND NOT was) AS only_first, count(*) FILTER (was AND NOT ok) AS only_second FROM (SELECT condition, benchmark, coalesce(pred = gold, false) AS ok, orig_pred IS NOT DISTINCT FROM gold AS was FROM er) GROUP BY 1, 2)
  SELECT *, round(CASE WHEN 2 * least(only_first, only_second) >= only_first + only_second THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(only_first, only_second) + 1), lambda i: exp(lgamma(only_first + only_second + 1) - lgamma(i + 1) - lgamma(only_first + only_second - i + 1) - (only_first + only_second) * ln(2))))) END, 6) + 0.0 AS p FROM c""",
)

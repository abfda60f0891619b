"""The labelled tables over the bound answers, and their SQL."""

from __future__ import annotations

from grainmill.operators import evaluation as ev
from grainmill.operators import labelled
from grainmill.plans.bindings import VERSUS, answers

FAMILIES = {"en": "building", "es": "furniture", "zh": "household", "ur": "machinery"}
PLAN = labelled.Plan(
    conditions=["baseline", *(f"{f}-{v}" for f in FAMILIES.values() for v in ("5k", "20k"))],
    benchmarks=["topic", "inference", "choice5"],
    langs=["en", "es", "zh", "ur"],
    thresholds={"topic": 0.08, "inference": 0.04, "choice5": 0.03},
    ladders={lang: ["building-5k", "building-20k", f"{FAMILIES[lang]}-5k", f"{FAMILIES[lang]}-20k"] for lang in ("es", "zh", "ur")},
    pairs={lang: (f"{FAMILIES[lang]}-5k", f"{FAMILIES[lang]}-20k") for lang in ("es", "zh", "ur")},
    transfer=[f"{f}-5k" for f in FAMILIES.values()],
    flips=["topic", "inference", "choice5"],
)


def _cells(spark, sf_dir):
    return labelled.tables(spark, ev.vs_baseline(ev.cells(answers(spark, sf_dir))), PLAN)


_SQL = f"""WITH {VERSUS},
cond AS (SELECT * FROM (VALUES ('baseline', 0), ('building-5k', 1), ('building-20k', 2), ('furniture-5k', 3), ('furniture-20k', 4), ('household-5k', 5), ('household-20k', 6), ('machinery-5k', 7), ('machinery-20k', 8)) t(condition, c)),
ben AS (SELECT * FROM (VALUES ('topic', 0, 0.08), ('inference', 1, 0.04), ('choice5', 2, 0.03)) t(benchmark, b, threshold)),
lng AS (SELECT * FROM (VALUES ('en', 0), ('es', 1), ('zh', 2), ('ur', 3)) t(lang, l)),
fam AS (SELECT * FROM (VALUES ('en', 'building'), ('es', 'furniture'), ('zh', 'household'), ('ur', 'machinery')) t(lang, family)),
base_cells AS (SELECT template, benchmark, data, instr, min(base_orig) AS orig, min(base_rep) AS rep FROM versus GROUP BY ALL),
u AS (SELECT condition, seed, template, benchmark, data, instr, cond_orig AS orig, cond_rep AS rep, delta_orig, delta_rep FROM versus UNION ALL SELECT 'baseline', 'none', template, benchmark, data, instr, orig, rep, NULL, NULL FROM base_cells),
g AS (SELECT condition, benchmark, instr, data, count(*) AS n, round(avg(orig), 9) AS orig, round(avg(rep), 9) AS rep, round(avg(delta_orig), 9) AS d_orig, round(avg(delta_rep), 9) AS d_rep FROM u GROUP BY GROUPING SETS ((condition, benchmark), (condition, benchmark, instr), (condition, benchmark, instr, data))),
g2 AS (SELECT * FROM g WHERE instr IS NULL), g3 AS (SELECT * FROM g WHERE instr IS NOT NULL AND data IS NULL), g4 AS (SELECT * FROM g WHERE data IS NOT NULL),
per_seed AS (SELECT condition, benchmark, data, seed, round(avg(rep), 9) AS rep FROM u WHERE data = instr GROUP BY ALL),
matched AS (SELECT condition, benchmark, data, round(avg(rep), 9) AS mean, round(stddev_samp(rep), 9) AS spread FROM per_seed GROUP BY ALL),
seeds AS (SELECT condition, count(DISTINCT seed) AS n_seeds FROM versus GROUP BY 1),
flip AS (SELECT benchmark, condition, n, d_orig, d_rep, dense_rank() OVER (PARTITION BY benchmark ORDER BY d_rep, c) - 1 AS nth FROM g2 JOIN cond USING (condition) WHERE d_orig > 0 AND d_rep < -0.005 AND condition <> 'baseline'),
x AS (
SELECT 'accuracy-' || benchmark AS tab, condition AS line, c AS line_at, lang AS col, l AS col_at, condition, rep AS value, NULL::DOUBLE AS spread, '' AS mark, 'share' AS kind FROM cond, lng, ben LEFT JOIN (SELECT condition AS q, benchmark AS w, instr AS e, rep FROM g3) ON q = condition AND w = benchmark AND e = lang
UNION ALL SELECT 'readings-' || benchmark, condition, c, lang || ' ' || m, 2 * l + (m = 'rep')::INT, condition, CASE m WHEN 'orig' THEN orig ELSE rep END, NULL, CASE WHEN m = 'rep' AND condition <> 'baseline' AND ((d_orig > 0.01 AND d_rep < -0.01) OR (d_orig < -0.01 AND d_rep > 0.01)) THEN 'bold' ELSE '' END, 'share'
  FROM cond, lng, (VALUES ('orig'), ('rep')) t(m), ben LEFT JOIN (SELECT condition AS q, benchmark AS w, instr AS e, orig, rep, d_orig, d_rep FROM g3) ON q = condition AND w = benchmark AND e = lang
UNION ALL SELECT 'delta-' || benchmark, condition, c - 1, lang, l, condition, d_rep, NULL, CASE WHEN abs(d_rep) > threshold THEN 'bold' ELSE '' END, 'points' FROM cond, lng, ben LEFT JOIN (SELECT condition AS q, benchmark AS w, instr AS e, d_rep FROM g3) ON q = condition AND w = benchmark AND e = lang WHERE c > 0
UNION ALL SELECT 'native', condition, c, benchmark || ' ' || lang, 4 * b + l, condition, rep, NULL, '', 'share' FROM cond, lng, ben LEFT JOIN (SELECT condition AS q, benchmark AS w, instr AS e, data AS r, rep FROM g4) ON q = condition AND w = benchmark AND e = lang AND r = lang
UNION ALL SELECT 'english', condition, c, benchmark || ' ' || lang, 4 * b + l, condition, rep, NULL, '', 'share' FROM cond, lng, ben LEFT JOIN (SELECT condition AS q, benchmark AS w, instr AS e, data AS r, rep FROM g4) ON q = condition AND w = benchmark AND e = 'en' AND r = lang
UNION ALL SELECT 'native-delta', condition, c - 1, benchmark || ' ' || lang, 4 * b + l, condition, d_rep, NULL, '', 'points' FROM cond, lng, ben LEFT JOIN (SELECT condition AS q, benchmark AS w, instr AS e, data AS r, d_rep FROM g4) ON q = condition AND w = benchmark AND e = lang AND r = lang WHERE c > 0
UNION ALL SELECT 'headroom', benchmark, b, lang, l, 'baseline', rep, NULL, '', 'share' FROM ben, lng LEFT JOIN (SELECT benchmark AS w, instr AS e, rep FROM g3 WHERE condition = 'baseline') ON w = benchmark AND e = lang
UNION ALL SELECT 'headroom', benchmark, b, 'mean', 4, 'baseline', (SELECT avg(rep) FROM g3 WHERE condition = 'baseline' AND g3.benchmark = ben.benchmark AND instr IN ('en', 'es', 'zh', 'ur')), NULL, '', 'share' FROM ben
UNION ALL SELECT 'ladder-' || lang, condition, nth, benchmark, b, condition, CASE WHEN nth = 0 THEN start ELSE mean - start END, CASE WHEN nth > 0 THEN spread END, '', CASE WHEN nth = 0 THEN 'share' ELSE 'points' END
  FROM (SELECT lang, unnest(['baseline', 'building-5k', 'building-20k', family || '-5k', family || '-20k']) AS condition, unnest([0, 1, 2, 3, 4]) AS nth FROM fam WHERE lang <> 'en'), ben
  LEFT JOIN (SELECT condition AS q, benchmark AS w, data AS r, mean, spread FROM matched) ON q = condition AND w = benchmark AND r = lang LEFT JOIN (SELECT benchmark AS w2, instr AS e2, data AS r2, rep AS start FROM g4 WHERE condition = 'baseline') ON w2 = benchmark AND e2 = lang AND r2 = lang
UNION ALL SELECT 'pairs', lang || ' ' || benchmark, 3 * (l - 1) + b, col, col_at, CASE col WHEN 'first' THEN family || '-5k' WHEN 'second' THEN family || '-20k' END, CASE col WHEN 'first' THEN one WHEN 'second' THEN two ELSE one - two END, NULL, CASE WHEN col = 'gap' AND abs(round(one - two, 9)) > 0.05 THEN 'bold' ELSE '' END, 'points'
  FROM (SELECT lang, l, family, benchmark, b, (SELECT d_rep FROM g3 WHERE condition = family || '-5k' AND g3.benchmark = ben.benchmark AND instr = lang) AS one, (SELECT d_rep FROM g3 WHERE condition = family || '-20k' AND g3.benchmark = ben.benchmark AND instr = lang) AS two FROM lng JOIN fam USING (lang), ben WHERE lang <> 'en'), (VALUES ('first', 0), ('second', 1), ('gap', 2)) t(col, col_at)
UNION ALL SELECT 'transfer', condition, (c - 1) // 2, benchmark, b, condition, d_rep, NULL, CASE WHEN d_rep > 0.02 THEN 'bold' WHEN d_rep < -0.02 THEN 'italic' ELSE '' END, 'points' FROM cond, ben LEFT JOIN (SELECT condition AS q, benchmark AS w, d_rep FROM g3 WHERE instr = 'en') ON q = condition AND w = benchmark WHERE c % 2 = 1
UNION ALL SELECT 'flips-' || benchmark, condition, nth, col, col_at, condition, CASE col_at WHEN 0 THEN n WHEN 1 THEN d_orig WHEN 2 THEN d_rep ELSE abs(d_orig - d_rep) END, NULL, '', CASE col_at WHEN 0 THEN 'n' WHEN 3 THEN 'four' ELSE 'signed' END FROM flip, (VALUES ('n_cells', 0), ('delta_orig', 1), ('delta_rep', 2), ('shift', 3)) t(col, col_at)),
y AS (SELECT * REPLACE (round(value, 9) AS value), CASE WHEN condition IS DISTINCT FROM 'baseline' THEN round(value, 9) END AS trained, round(round(value, 9) * 100, 1) + 0.0 AS pp FROM x)
SELECT tab, line, line_at::BIGINT AS line_at, col, col_at::BIGINT AS col_at, round(value, 6) + 0.0 AS value, round(spread, 6) + 0.0 AS spread, n_seeds, mark, coalesce(trained = max(trained) OVER (PARTITION BY tab, col_at), false) AS best,
  CASE WHEN value IS NULL THEN '--' WHEN kind = 'share' THEN printf('%.1f', pp) || '%' WHEN kind = 'n' THEN value::BIGINT::VARCHAR WHEN kind = 'four' THEN printf('%.4f', value) WHEN kind = 'signed' THEN printf('%+.4f', value) ELSE printf('%+.1f', CASE WHEN pp = 0 THEN 0.0 ELSE pp END) || CASE WHEN spread IS NULL THEN '' ELSE ' ± ' || printf('%.1f', spread * 100) END END AS text
FROM y LEFT JOIN (SELECT condition AS q, n_seeds FROM seeds) ON q = condition"""

QUERIES = {"b08_labelled_tables": (_cells, _SQL)}

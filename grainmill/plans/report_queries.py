"""Queries of the report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import code
from grainmill.operators import reports
from grainmill.plans.bindings import CELLS
from grainmill.plans.corpus_queries import docs, sources
from grainmill.plans.evaluation_queries import facts, r
from grainmill.session import table

QUERIES: dict = {}


def add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = (query, sql)


_WORD = "[^ \\n]+"


def _words(s, d):
    return docs(s, d).select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(_WORD), 0).alias("words"))


def _frequencies(s, d):
    each = _words(s, d).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("total"))
    return reports.ranked_names(each, "word", "total")


add("w02_print_ranks", _frequencies, "SELECT word, total, row_number() OVER (ORDER BY total DESC, word) AS rank FROM (SELECT word, count(*) AS total FROM (SELECT unnest(regexp_extract_all(lower(text), '[^ \\n]+')) AS word FROM documents) GROUP BY word)")
add("u05_distinct_words", lambda s, d: reports.distinct_values(_words(s, d), ["doc_id"], "words", "word").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("word").alias("first")), "SELECT doc_id, count(*) AS n, min(word) AS first FROM (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^ \\n]+')) AS word FROM documents)) GROUP BY doc_id")
add("t02_custom_order", lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n")).withColumn("place", reports.place_in("flag", ("R", "N"))), "SELECT l_returnflag AS flag, count(*) AS n, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS place FROM lineitem GROUP BY ALL")


def _splits(s, d):
    whole = docs(s, d)
    train = whole.where("doc_id % 10 <> 0").select("doc_id", "lang", "source")
    held = whole.where("doc_id % 10 = 0").select("doc_id", "lang", "n_chars")
    return reports.union_of({"train": train, "validation": held})


add("u04_s17_union_of_splits", _splits, "SELECT doc_id, lang, CASE WHEN doc_id % 10 <> 0 THEN source END AS source, CASE WHEN doc_id % 10 = 0 THEN n_chars END AS n_chars, CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents")
add("v07_repeated_labels", lambda s, d: reports.repeated(table(s, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")), ["host"]), "SELECT host, count(*) AS n FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages) GROUP BY host HAVING count(*) > 1")


def _preflight(s, d):
    return reports.outside(docs(s, d), {"ids": F.col("doc_id").isNotNull(), "texts": F.col("text") != "", "counts": F.length("text") == F.col("n_chars"), "langs": F.col("lang").isNotNull()})


add("v04_v08_checks", _preflight, """SELECT 'ids' AS "check", count(*) FILTER (doc_id IS NULL) AS n_bad FROM documents UNION ALL SELECT 'texts', count(*) FILTER (coalesce(text, '') = '') FROM documents UNION ALL SELECT 'counts', count(*) FILTER (length(text) IS DISTINCT FROM n_chars OR text IS NULL) FROM documents UNION ALL SELECT 'langs', count(*) FILTER (lang IS NULL) FROM documents""")
_KEYS = "condition, seed, template, benchmark, data, instr"
add("t06_picked_cells", lambda s, d: reports.picks(facts(s, d)), f"""WITH {CELLS}, fall AS (SELECT * FROM cells WHERE delta_acc < -0.05 ORDER BY round(delta_pf, 9) DESC, {_KEYS} LIMIT 1),
lift AS (SELECT * FROM cells WHERE delta_acc > 0.10 ORDER BY round(delta_pf, 9), {_KEYS} LIMIT 1),
low AS (SELECT * FROM cells ANTI JOIN fall USING ({_KEYS}) ORDER BY round(delta_acc, 9), {_KEYS} LIMIT 1)
SELECT 'lift' AS pick, {_KEYS}, {r('delta_acc', 'delta_acc')}, {r('delta_pf', 'delta_pf')} FROM lift UNION ALL SELECT 'regression', {_KEYS}, {r('delta_acc', 'delta_acc')}, {r('delta_pf', 'delta_pf')} FROM fall UNION ALL SELECT 'lowest', {_KEYS}, {r('delta_acc', 'delta_acc')}, {r('delta_pf', 'delta_pf')} FROM low""")
add("t09_top_files", lambda s, d: reports.top_by(docs(s, d).where("n_chars > 0"), F.length(F.regexp_replace("text", "[^a-e]", "")) / F.col("n_chars"), ["doc_id"]), "SELECT doc_id, round(length(regexp_replace(text, '[^a-e]', '', 'g')) / n_chars, 6) AS measure FROM documents WHERE n_chars > 0 ORDER BY round(length(regexp_replace(text, '[^a-e]', '', 'g')) / n_chars, 9) DESC, doc_id LIMIT 20")
_MAP = {"def": "definir", "return": "devolver", "if": "si"}
add("x13_translatable_tokens", lambda s, d: sources(s, d).select("doc_id", reports.translatable(code.code_facts("code")["tokens"], _MAP).alias("n")), "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 1 WHEN doc_id % 9 = 1 THEN 0 ELSE 2 END AS n FROM documents")
add("x35_cell_labels", lambda s, d: facts(s, d).select("condition", "seed", "template", "benchmark", "data", "instr", reports.cell_label(F.upper(F.substring("condition", 1, 2))).alias("label"), reports.scale_points(F.col("delta_acc") * 100, F.col("delta_pf") * 100).alias("points")), f"WITH {CELLS}, h AS (SELECT *, greatest(abs(delta_acc * 100), abs(delta_pf * 100)) AS half FROM cells) SELECT {_KEYS}, upper(left(condition, 2)) || ' ' || benchmark || '·' || data || '→' || instr || ' t' || template AS label, (CASE WHEN half <= 12 THEN round_even(half, 0) ELSE 5 * round_even(half / 5, 0) END)::BIGINT AS points FROM h")
add("x38_token_counts", lambda s, d: docs(s, d).select("doc_id", F.regexp_count("text", F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\r\\f\\x0B]")).alias("n_tokens")), "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\r\\f\\x0B]')) AS n_tokens FROM documents")

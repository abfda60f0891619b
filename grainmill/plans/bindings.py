"""The engine's inputs, bound to the driver tables, and the same bindings as SQL.

Answers: line items with their order and customer; the customer's segment names the condition, line and order numbers
the rest of the cell, and labels follow from keys, so that all cells, missing labels and both readings occur.
Records: documents with a path, stars and licence names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.session import table

LANGS = ("en", "es", "zh", "ur")
LABELS = ("a", "b", "c")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at % len(values) + 1).cast("int"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = items.join(orders, items.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    base = F.col("c_mktsegment") == "AUTOMOBILE"
    gold = _pick(LABELS, F.col("l_suppkey"))
    return rows.select(
        F.when(base, "baseline").otherwise(F.concat(F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "-5k").otherwise("-20k"))).alias("condition"),
        F.when(base, "none").otherwise(_pick(("42", "123", "456"), F.col("l_linenumber"))).alias("seed"),
        F.when(F.col("l_linestatus") == "F", "1").otherwise("2").alias("template"),
        F.when(F.col("l_returnflag") == "A", "topic").when(F.col("l_returnflag") == "N", "inference").otherwise("choice5").alias("benchmark"),
        _pick(LANGS, F.col("c_nationkey")).alias("data"),
        _pick(LANGS, F.col("l_orderkey")).alias("instr"),
        gold.alias("gold"),
        F.when(F.col("l_partkey") % 6 != 0, _pick(LABELS, F.col("l_partkey"))).alias("orig_pred"),
        F.when(F.col("l_partkey") % 11 == 0, F.lit(None).cast("string")).when(F.col("l_quantity") > 40, gold).otherwise(_pick(LABELS, F.col("l_partkey"))).alias("pred"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"),
        F.concat(F.when(F.col("l_partkey") % 5 == 0, "\n").otherwise(""), F.lit(" Answer  "), F.col("l_partkey") % 17, F.when(F.col("l_partkey") % 3 == 0, "\nmore").otherwise("")).alias("raw_output"),
    )


ANSWERS = """er AS (
  SELECT CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'baseline' ELSE lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN '-5k' ELSE '-20k' END END AS condition,
    CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'none' ELSE ['42','123','456'][l_linenumber % 3 + 1] END AS seed,
    CASE WHEN l_linestatus = 'F' THEN '1' ELSE '2' END AS template,
    CASE l_returnflag WHEN 'A' THEN 'topic' WHEN 'N' THEN 'inference' ELSE 'choice5' END AS benchmark,
    ['en','es','zh','ur'][c_nationkey % 4 + 1] AS data, ['en','es','zh','ur'][l_orderkey % 4 + 1] AS instr,
    ['a','b','c'][l_suppkey % 3 + 1] AS gold,
    CASE WHEN l_partkey % 6 <> 0 THEN ['a','b','c'][l_partkey % 3 + 1] END AS orig_pred,
    CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_quantity > 40 THEN ['a','b','c'][l_suppkey % 3 + 1] ELSE ['a','b','c'][l_partkey % 3 + 1] END AS pred,
    l_orderkey * 10 + l_linenumber AS item,
    CASE WHEN l_partkey % 5 = 0 THEN chr(10) ELSE '' END || ' Answer  ' || (l_partkey % 17) || CASE WHEN l_partkey % 3 = 0 THEN chr(10) || 'more' ELSE '' END AS raw_output
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

CELLS = (
    ANSWERS
    + """, cells AS (
  SELECT *, rep_acc - orig_acc AS delta_acc, rep_pf - orig_pf AS delta_pf FROM (
    SELECT condition, seed, template, benchmark, data, instr, count(*) AS n,
      avg((orig_pred IS NOT DISTINCT FROM gold)::int::double) AS orig_acc, avg(coalesce(pred = gold, false)::int::double) AS rep_acc,
      avg((orig_pred IS NULL)::int::double) AS orig_pf, avg((pred IS NULL)::int::double) AS rep_pf
    FROM er GROUP BY ALL))"""
)

VERSUS = (
    CELLS
    + """, base AS (SELECT template, benchmark, data, instr, avg(orig_acc) AS base_orig, avg(rep_acc) AS base_rep FROM cells WHERE condition = 'baseline' GROUP BY ALL),
  versus AS (SELECT c.*, base_orig, base_rep, orig_acc AS cond_orig, rep_acc AS cond_rep, orig_acc - base_orig AS delta_orig, rep_acc - base_rep AS delta_rep
    FROM cells c JOIN base USING (template, benchmark, data, instr) WHERE condition <> 'baseline')"""
)


def dimension(spark: SparkSession) -> DataFrame:
    """Target language, volume and family of each condition."""
    families = {"building": "en", "furniture": "es", "household": "zh", "machinery": "ur"}
    rows = [("baseline", "", "", "")] + [(f"{f}-{v}", lang, v, f) for f, lang in families.items() for v in ("5k", "20k")]
    return spark.createDataFrame(rows, "condition string, target_lang string, volume string, family string")


DIMENSION = """dim AS (SELECT * FROM (VALUES ('baseline','','',''), ('building-5k','en','5k','building'), ('building-20k','en','20k','building'), ('furniture-5k','es','5k','furniture'), ('furniture-20k','es','20k','furniture'),
  ('household-5k','zh','5k','household'), ('household-20k','zh','20k','household'), ('machinery-5k','ur','5k','machinery'), ('machinery-20k','ur','20k','machinery')) t(condition, target_lang, volume, family))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    kind = F.when(d % 11 == 0, F.array(F.lit("GPL-3.0"))).when(d % 11 == 1, F.array(F.lit("AGPL"), F.lit("MIT"))).when(d % 11 == 2, F.array().cast("array<string>")).when(d % 11 == 3, F.array(F.lit(" Apache_2.0 "), F.lit("isc"))).otherwise(F.array(F.lit(" MIT ")))
    return docs.select(
        "doc_id",
        F.col("text").alias("content"),
        kind.alias("licenses"),
        F.pmod(d * 7919, F.lit(101)).alias("stars"),
        F.concat("source", F.when(d % 13 == 0, "/tests/x").otherwise("/src/"), d, F.lit(".txt")).alias("path"),
        (d % 29 == 0).alias("declared_generated"),
        "lang",
        "source",
        "n_chars",
    )


RECORDS = """rec AS (SELECT doc_id, text AS content, (doc_id * 7919) % 101 AS stars,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN 'MIT' WHEN doc_id % 11 = 2 THEN NULL WHEN doc_id % 11 = 3 THEN 'Apache-2.0' ELSE 'MIT' END AS license,
    doc_id % 13 = 0 AS is_test, doc_id % 29 = 0 AS declared, lang, source, n_chars,
    source || CASE WHEN doc_id % 13 = 0 THEN '/tests/x' ELSE '/src/' END || doc_id || '.txt' AS path FROM documents)"""

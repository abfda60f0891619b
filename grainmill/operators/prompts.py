"""Prompts for benchmark rows, their token columns, and the matrix of evaluations to run.

Prompts are a dimension of templates (benchmark, template, language) joined to the rows; the wording is data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# What is asked, by benchmark and language.
ASKS = {
    "inference": {"en": "Say how the two sentences relate: entailment, neutral or contradiction.", "es": "Di qué relación hay entre las dos frases: entailment, neutral o contradiction.", "zh": "请判断两句话的关系：entailment、neutral 或 contradiction。", "ur": "بتائیں دونوں جملوں کا تعلق کیا ہے: entailment، neutral یا contradiction۔"},
    "topic": {"en": "Name the topic of the text.", "es": "Nombra el tema del texto.", "zh": "请说出文章的主题。", "ur": "متن کا موضوع بتائیں۔"},
    "choice5": {"en": "Answer with one letter, A to E.", "es": "Responde con una letra, de A a E.", "zh": "请用 A 到 E 中的一个字母回答。", "ur": "A سے E تک ایک حرف میں جواب دیں۔"},
    "choice4": {"en": "Read the passage and answer with one letter, A to D.", "es": "Lee el pasaje y responde con una letra, de A a D.", "zh": "阅读短文，用 A 到 D 中的一个字母回答。", "ur": "عبارت پڑھیں اور A سے D تک ایک حرف میں جواب دیں۔"},
}
FIELDS = {"inference": ("premise", "hypothesis"), "topic": ("text",), "choice5": ("stem", "options"), "choice4": ("passage", "question", "options")}


def templates() -> list[tuple[str, str, str, str]]:
    """(benchmark, template, instr, pattern): template 1 asks first, template 2 asks last."""
    out = []
    for benchmark, asks in ASKS.items():
        body = "\n".join(f"{name.capitalize()}: {{{name}}}" for name in FIELDS[benchmark])
        for lang, ask in asks.items():
            out += [(benchmark, "1", lang, f"{ask}\n{body}\nAnswer:"), (benchmark, "2", lang, f"{body}\n{ask}\nAnswer:")]
    return out


def prompts(spark: SparkSession, rows: DataFrame, benchmark: str, langs: list[str] | None = None) -> DataFrame:
    """A row for each row, template and instruction language, with the filled-in prompt. The dimension has at most 32
    rows, so it is broadcast."""
    dim = spark.createDataFrame([t[1:] for t in templates() if t[0] == benchmark and (langs is None or t[2] in langs)], "template string, instr string, pattern string")
    out = F.col("pattern")
    for name in FIELDS[benchmark]:
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return rows.crossJoin(F.broadcast(dim)).withColumn("prompt", out).drop("pattern")


def flat_choices(rows: DataFrame, question: str = "question", key: str = "answerKey") -> DataFrame:
    """Nested questions as stem, lettered options and gold letter."""
    letters = F.transform(F.col(f"{question}.choices.text"), lambda t, i: F.concat(F.substring(F.lit("ABCDE"), i + 1, F.lit(1)), F.lit(") "), t))
    return rows.select("*", F.col(f"{question}.stem").alias("stem"), F.array_join(letters, " ").alias("options"), F.upper(F.trim(key)).alias("gold"))


def tokenised(rows: DataFrame, encode: Callable[[Column], Column], text: str = "prompt", most: int = 1024) -> DataFrame:
    """Adds input_ids, cut to `most`, and attention_mask; encode maps a text column to an array of ids."""
    ids = F.slice(encode(F.col(text)), 1, most)
    return rows.withColumn("input_ids", ids).withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))


def padded(rows: DataFrame, batch: str, pad: int = 0) -> DataFrame:
    """Ids and masks padded on the left to the longest of their batch."""
    longest = F.max(F.size("input_ids")).over(W.partitionBy(batch))
    gap = longest - F.size("input_ids")
    filled = {c: F.concat(F.array_repeat(F.lit(v), gap), F.col(c)) for c, v in (("input_ids", pad), ("attention_mask", 0))}
    return rows.withColumns(filled)


def matrix(spark: SparkSession, conditions: list[tuple[str, list[str], list[str], list[str]]], benchmarks: list[str]) -> DataFrame:
    """Evaluations to run: condition x its seeds x template x its data languages x its instruction languages x
    benchmark. conditions: (name, seeds, data languages, instruction languages)."""
    dim = spark.createDataFrame(conditions, "condition string, seeds array<string>, datas array<string>, instrs array<string>")
    out = dim.select("condition", F.explode("seeds").alias("seed"), "datas", "instrs").select("condition", "seed", F.explode("datas").alias("data"), "instrs").select("condition", "seed", "data", F.explode("instrs").alias("instr"))
    return out.withColumn("template", F.explode(F.array(F.lit("1"), F.lit("2")))).withColumn("benchmark", F.explode(F.array(*(F.lit(b) for b in benchmarks))))


def parallel(rows: DataFrame, langs: DataFrame) -> DataFrame:
    """Every row once for each language: the work of a batch run over parallel languages."""
    return rows.crossJoin(F.broadcast(langs))


def by_tier(rows: DataFrame, share: Column, tier: Column, by: list[str]) -> DataFrame:
    """Corpus overview: rows, characters and mean share by source and tier."""
    return rows.select(*by, tier.alias("tier"), share.alias("share"), F.length("text").alias("n_chars")).groupBy(*by, "tier").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.avg("share").alias("mean_share"))


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Counts by equal-width bin; below and above are bins 0 and bins + 1."""
    return rows.groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def prompt_effect(facts: DataFrame, anchor: str) -> DataFrame:
    """Means by (condition, benchmark) and template, the effect of the prompt, and the distance to an anchor condition;
    a score that is missing is 0 in the bars and null in the heat map."""
    means = facts.groupBy("condition", "benchmark").pivot("template", ["1", "2"]).agg(F.avg("rep_acc"))
    own = means.select("condition", "benchmark", F.col("1").alias("t1"), F.col("2").alias("t2"))
    base = own.where(F.col("condition") == anchor).select("benchmark", F.col("t1").alias("a1"))
    out = own.join(base, "benchmark", "left")
    return out.select("condition", "benchmark", F.coalesce("t1", F.lit(0.0)).alias("bar_t1"), F.coalesce("t2", F.lit(0.0)).alias("bar_t2"), (F.col("t2") - F.col("t1")).alias("effect"), (F.col("t1") - F.col("a1")).alias("heat"))

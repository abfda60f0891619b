"""What answers say: constant outputs, confusion, match buckets, surface forms, agreement and leakage.

Rows carry their cell columns, raw_output, gold and pred. Modes and top lists break ties by value; labels that were
never predicted still have their column, gold labels without rows still have their row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.labels import outcome
from grainmill.functions.text import first_line, is_multiline, one_line, raw_first_line
from grainmill.operators.evaluation import CELL


def _mode(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Most frequent non-null value per group and its count; of equals the least value. Counts are pre-aggregated, and
    the pick is a maximum, so a group of many values is not gathered."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    least = counts.groupBy(*by).agg(F.max("k").alias(f"{name}_count"))
    picked = counts.join(least, by).where(F.col("k") == F.col(f"{name}_count"))
    return picked.groupBy(*by).agg(F.min(value).alias(name), F.max("k").alias(f"{name}_count"))


def constant_output(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How far a cell's answers collapse into one label or one surface form, and how many right answers that gives.
    Missing labels and empty answers are no mode but count in n."""
    by = by or CELL
    said = rows.withColumn("said", F.nullif(raw_first_line("raw_output"), F.lit("")))
    right = F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))
    out = said.join(_mode(said, by, "pred", "top_pred"), by, "left").join(_mode(said, by, "said", "top_raw"), by, "left")
    out = out.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(right).alias("n_right"),
        F.first("top_pred").alias("top_pred"),
        F.coalesce(F.first("top_pred_count"), F.lit(0)).alias("top_pred_count"),
        F.first("top_raw").alias("top_raw"),
        F.coalesce(F.first("top_raw_count"), F.lit(0)).alias("top_raw_count"),
        F.count_if(right & (F.col("pred") == F.col("top_pred"))).alias("n_right_pred"),
        F.count_if(right & (F.col("said") == F.col("top_raw"))).alias("n_right_raw"),
    )

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return out.withColumns({"top_pred_share": share("top_pred_count", "n"), "top_raw_share": share("top_raw_count", "n"), "right_via_pred": share("n_right_pred", "n_right"), "right_via_raw": share("n_right_raw", "n_right")})


def confusion(rows: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """One row per cell and gold label, a column per predicted label and pred_none. Unexpected golds have no row of
    their own but stay in n_cell."""
    by = by or CELL
    golds = F.explode(F.array(*(F.lit(x) for x in labels))).alias("gold")
    spine = rows.groupBy(*by).agg(F.count("*").alias("n_cell")).select(*by, "n_cell", golds)
    counts = rows.groupBy(*by, "gold").agg(F.count("*").alias("n_gold"), *(F.count_if(F.col("pred") == x).alias(f"pred_{x}") for x in labels), F.count_if(F.col("pred").isNull()).alias("pred_none"), F.count_if(F.col("pred") == F.col("gold")).alias("n_right"))
    numbers = ["n_gold", *(f"pred_{x}" for x in labels), "pred_none", "n_right"]
    out = spine.join(counts, [*by, "gold"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
    return out.withColumn("recall", F.when(F.col("n_gold") > 0, F.col("n_right") / F.col("n_gold")))


def tier_counts(rows: DataFrame, tiers: list[str], by: list[str] | None = None) -> DataFrame:
    """Answers by the tier that read them (column via)."""
    return rows.groupBy(*(by or CELL)).agg(F.count("*").alias("n"), *(F.count_if(F.col("via") == t).alias(f"n_{t}") for t in tiers))


def buckets(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows by outcome and match."""
    return rows.withColumn("outcome", outcome("pred", "gold")).groupBy(*by, "outcome", "via").agg(F.count("*").alias("n"), F.count_if(is_multiline("raw_output")).alias("n_multiline"))


def surface_forms(rows: DataFrame, by: list[str], cell: list[str] | None = None, least: int = 1) -> DataFrame:
    """First lines with how often they occur, in how many cells, and their outcomes."""
    seen = rows.withColumns({"form": first_line("raw_output"), "outcome": outcome("pred", "gold"), "_cell": F.struct(*(cell or CELL))})
    kinds = ("correct", "wrong_label", "parse_fail")
    out = seen.groupBy(*by, "form").agg(F.count("*").alias("n"), F.count_distinct("_cell").alias("n_cells"), *(F.count_if(F.col("outcome") == k).alias(f"n_{k}") for k in kinds))
    return out.where(F.col("n") >= least)


def prefix_clusters(rows: DataFrame, width: int = 20) -> DataFrame:
    """Answers on one line, grouped by their first characters."""
    return rows.groupBy(F.left(one_line("raw_output"), F.lit(width)).alias("prefix")).agg(F.count("*").alias("n"))


def label_shares(rows: DataFrame, by: list[str]) -> DataFrame:
    """Distribution of predicted labels within a group."""
    counts = rows.groupBy(*by, F.coalesce("pred", F.lit("none")).alias("label")).agg(F.count("*").alias("n"))
    return counts.join(rows.groupBy(*by).agg(F.count("*").alias("total")), by).withColumn("share", F.col("n") / F.col("total"))


def edge(rows: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    """Accuracy against guessing: edge = accuracy - parsed share / labels; null = sum over labels of the product of the
    predicted and the gold share."""
    n = F.count("*")
    out = rows.groupBy(*by).agg(
        n.alias("n"),
        F.avg(F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)).cast("double")).alias("acc"),
        F.avg(F.col("pred").isNotNull().cast("double")).alias("parsed"),
        reduce(lambda a, b: a + b, ((F.count_if(F.col("pred") == x) / n) * (F.count_if(F.col("gold") == x) / n) for x in labels)).alias("null_acc"),
    )
    return out.withColumn("edge", F.col("acc") - F.col("parsed") / len(labels))


def agreement_by_item(rows: DataFrame, item: list[str]) -> DataFrame:
    """Items that all conditions get right, or none."""
    right = F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))
    return rows.groupBy(*item).agg(F.count("*").alias("n"), F.bool_and(right).alias("all_right"), (~F.bool_or(right)).alias("all_wrong"), F.avg((F.col("pred") != F.col("gold")).cast("double")).alias("error_share"))


def transitions(before: DataFrame, after: DataFrame, item: list[str]) -> DataFrame:
    """Predictions of the same item under two conditions."""
    a, b = (df.select(*item, F.coalesce("pred", F.lit("none")).alias(n)) for df, n in ((before, "from_pred"), (after, "to_pred")))
    return a.join(b, item).groupBy("from_pred", "to_pred").agg(F.count("*").alias("n"))


def cross_check(computed: DataFrame, published: DataFrame, key: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows whose published accuracy is missing or differs."""
    out = computed.join(published, key, "left")
    return out.where(F.col("published").isNull() | (F.abs(F.col("acc") - F.col("published")) > tolerance))


def disagreements(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Self-test: how many rows two readings of the same answer differ on."""
    return rows.agg(F.count("*").alias("n"), F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias("n_differ"))


def leaking(rows: DataFrame, text: str, keywords: list[str], common: tuple[str, ...] = ()) -> DataFrame:
    """Rows holding any keyword, and how often the first of them occurs at least twice; common words are left out."""
    words = [k for k in keywords if k not in common]
    hits = F.array_compact(F.array(*(F.when(F.contains(F.col(text), F.lit(k)), F.lit(k)) for k in words)))
    nested = reduce(lambda a, b: a | b, (F.size(F.split(F.col(text), rf"\Q{k}\E", -1)) - 1 >= 2 for k in words))
    return rows.withColumns({"hits": hits, "nested": nested}).where(F.size("hits") > 0)


def contradictions(rows: DataFrame, extract, text: str = "raw_output") -> DataFrame:
    """Rows whose first line names one label and whose other lines name another."""
    lines = F.split(F.col(text), "\n", -1)
    rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), " ")
    out = rows.where(F.size(lines) >= 2).withColumns({"first_label": extract(lines[0]), "later_label": extract(rest)})
    return out.where("first_label is not null and later_label is not null and first_label != later_label")

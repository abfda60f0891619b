"""Small operators behind reports: custom orders, ranks, picks, unions of splits, labels and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.sets import numbered


def place_in(value: Column | str, order: tuple[str, ...]) -> Column:
    """Place of a value in a stated order, from 0; values outside it, and null, come after all others."""
    at = F.array_position(F.array(*(F.lit(v) for v in order)), F.col(value) if isinstance(value, str) else value)
    return F.when(at.isNull() | (at == 0), F.lit(len(order))).otherwise(at - 1).cast("bigint")


def ranked_names(counts: DataFrame, name: str, total: str) -> DataFrame:
    """Adds rank, from 1: largest total first, ties by name. Ranges are numbered apart, so no task holds all names."""
    ordered = numbered(counts.withColumn("_down", -F.col(total)), ["_down", name], "rank")
    return ordered.withColumn("rank", F.col("rank") + 1).drop("_down")


def distinct_values(rows: DataFrame, keys: list[str], values: str, name: str = "value") -> DataFrame:
    """A row for each different value of an array column; null and empty arrays give none."""
    return rows.select(*keys, F.explode(F.array_distinct(values)).alias(name))


def union_of(parts: dict[str, DataFrame], name: str = "split") -> DataFrame:
    """All rows of named splits or sources, as a bag; columns that one lacks are null there."""
    tagged = [df.withColumn(name, F.lit(k)) for k, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row; empty if the keys are unique."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def outside(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, n_bad) of each stated condition; a null counts as bad."""
    bad = rows.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(k) for k, ok in checks.items()))
    return bad.select(F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k in checks)), F.array(*(F.col(k) for k in checks)))).alias("check", "n_bad"))


def picks(facts: DataFrame, moved: str = "delta_acc", failed: str = "delta_pf") -> DataFrame:
    """The cells that a scatter plot names: the largest lift (accuracy up by over 0.10, least parse failures), the largest
    regression (down by over 0.05, most failures) and the lowest accuracy change but for the cell already picked. Ties
    go by the cell's keys."""
    cell = ["condition", "seed", "template", "benchmark", "data", "instr"]
    by = [F.col(c) for c in cell]
    lift = facts.where(F.col(moved) > 0.10).orderBy(F.round(failed, 9), *by).limit(1)
    fall = facts.where(F.col(moved) < -0.05).orderBy(F.round(failed, 9).desc(), *by).limit(1)
    low = facts.join(F.broadcast(fall.select(*cell)), cell, "left_anti").orderBy(F.round(moved, 9), *by).limit(1)  # one row
    return union_of({"lift": lift, "regression": fall, "lowest": low}, "pick").select("pick", *cell, moved, failed)


def top_by(rows: DataFrame, measure: Column, keys: list[str], n: int = 20) -> DataFrame:
    """The n rows of the largest measure, ties by key."""
    return rows.withColumn("measure", measure).orderBy(F.round("measure", 9).desc(), *keys).limit(n).select(*keys, "measure")


def scale_points(lowest: Column, highest: Column) -> Column:
    """Half the range of an axis as a whole number of points: of one up to 12, of five beyond; halves go to even."""
    half = F.greatest(F.abs(lowest), F.abs(highest))
    step = F.when(half <= 12, F.lit(1)).otherwise(F.lit(5))
    return (step * F.bround(half / step)).cast("bigint")


def cell_label(short: Column) -> Column:
    """A cell in short: its condition's short name, benchmark, languages and template."""
    return F.concat(short, F.lit(" "), F.col("benchmark"), F.lit("·"), F.col("data"), F.lit("→"), F.col("instr"), F.lit(" t"), F.col("template"))


def translatable(tokens: Column, words: dict[str, str]) -> Column:
    """How many tokens are words that the map translates."""
    return F.size(F.filter(tokens, lambda t: t.isin(*words))).cast("bigint")

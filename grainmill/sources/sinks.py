"""Sinks: tables by configuration and split, delimited text with fixed precision, manifests, and publication plans."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.text import preview, slug
from grainmill.operators.datasets import require
from grainmill.sources.files import exists


def write_dataset(rows: DataFrame, path: str, report: DataFrame | None = None, by: tuple[str, ...] = ("config", "split")) -> None:
    """Parquet by configuration and split; refuses rows that failed validation."""
    if report is not None:
        require(report)
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def record_name(index: Column, repo: Column, path: Column, sha: Column) -> Column:
    """File name of a record: padded index, repository, stem and the head of its hash."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/", -1), -1), r"(?<=.)\.[^.]*$", "")
    return F.format_string("%09d_%s_%s_%s", index, slug(repo, "repo"), slug(stem, "file"), F.left(sha, F.lit(12)))


def write_records(rows: DataFrame, path: str) -> None:
    """Accepted records as a table, with metadata alone beside it."""
    rows.write.mode("append").parquet(f"{path}/records")
    rows.drop("content").write.mode("append").option("header", True).csv(f"{path}/metadata")


def fixed(x: Column | str, digits: int = 4, sign: bool = False) -> Column:
    """A number in text with so many digits; null is ''."""
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.format_string(f"%{'+' if sign else ''}.{digits}f", c + F.lit(0.0)), F.lit(""))


def percent(x: Column | str, digits: int = 1) -> Column:
    return fixed((F.col(x) if isinstance(x, str) else x) * 100, digits)


def points(x: Column | str, digits: int = 1) -> Column:
    """A difference in percentage points with its sign; what rounds to zero is +0."""
    c = F.round((F.col(x) if isinstance(x, str) else x) * 100, digits)
    return fixed(F.when(c == 0, F.lit(0.0)).otherwise(c), digits, True)


def with_spread(x: Column, std: Column, digits: int = 1) -> Column:
    return F.when(std.isNull(), points(x, digits)).otherwise(F.concat(points(x, digits), F.lit(" ± "), percent(std, digits)))


def write_tsv(rows: DataFrame, path: str, plain: tuple[str, ...] = (), signed: tuple[str, ...] = ()) -> None:
    """Numbers stay numbers until here."""
    out = rows.withColumns({c: fixed(c) for c in plain} | {c: fixed(c, sign=True) for c in signed})
    out.write.mode("overwrite").option("header", True).option("sep", "\t").option("emptyValue", "").csv(path)


def markdown(rows: DataFrame, most: int = 500) -> str:
    """A report table of a bounded frame."""
    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError("too many rows for a report")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in held])


def latex(rows: DataFrame, caption: str, label: str, most: int = 500) -> str:
    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError("too many rows for a report")
    body = [" & ".join("--" if x is None else str(x).replace("_", r"\_").replace("%", r"\%") for x in r) + r" \\" for r in held]
    head = " & ".join(rf"\textbf{{{c}}}".replace("_", r"\_") for c in rows.columns) + r" \\"
    return "\n".join([r"\begin{table}", r"\begin{tabular}{" + "l" * len(rows.columns) + "}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", r"\end{table}"])


def write_json(spark: SparkSession, facts: dict, path: str) -> None:
    """A small document, keys in order, in place at once."""
    text = json.dumps(facts, sort_keys=True, ensure_ascii=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def provenance(*modules) -> dict[str, str]:
    """SHA-256 of the source of the modules that made a result."""
    return {m.__name__: hashlib.sha256(Path(m.__file__).read_bytes()).hexdigest() for m in modules}


def publication_plan(planned: DataFrame, present: DataFrame, overwrite: bool = False, key: str = "path") -> DataFrame:
    """What a publication would do with each file: new, overwrite or skip (the default for what is there)."""
    out = planned.join(present.select(key, F.lit(True).alias("_there")).distinct(), key, "left")
    there = F.coalesce("_there", F.lit(False))
    return out.withColumn("action", F.when(~there, "new").when(F.lit(overwrite), "overwrite").otherwise("skip")).drop("_there")


def publish(spark: SparkSession, rows: DataFrame, path: str, overwrite: bool = False, dry_run: bool = False) -> str:
    """Writes a table unless it is there, or says what it would do."""
    action = "overwrite" if exists(spark, path) and overwrite else "skip" if exists(spark, path) else "new"
    if not dry_run and action != "skip":
        rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return action


def side_by_side(a: str, b: str, lines: int = 30) -> Column:
    """A preview of two texts."""
    return F.concat(F.lit("```\n"), preview(a, lines), F.lit("\n```\n\n```\n"), preview(b, lines), F.lit("\n```\n"))


def metadata(outcomes: DataFrame) -> DataFrame:
    """Provenance of finished files (ok or resumed)."""
    return outcomes.where(F.col("status").isin("ok", "resumed")).select("idx", F.format_string("%03d.py", "idx").alias("filename"), "file_path", "license")

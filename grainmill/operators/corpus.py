"""Corpus filters: one ordered chain that names a record's first failure and the stage it reached, and its funnel.

All tests that are plain expressions come before the one that parses, which is a single vectorised UDF per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import col, head_lines, let, line_count, split_lines, strip

# Licences, the words that reject one, headers of generated files, and the order of stages.
PERMISSIVE = {
    "apache-2.0": "Apache-2.0", "apache 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "mit": "MIT",
    "bsd-2-clause": "BSD-2-Clause", "bsd 2-clause": "BSD-2-Clause", "bsd 2 clause": "BSD-2-Clause", 'bsd-2-clause "simplified"': "BSD-2-Clause",
    "bsd-3-clause": "BSD-3-Clause", "bsd 3-clause": "BSD-3-Clause", "bsd 3 clause": "BSD-3-Clause", 'bsd-3-clause "new" or "revised"': "BSD-3-Clause",
    "isc": "ISC", "unlicense": "Unlicense",
}
REJECTED = ("gpl", "lgpl", "agpl", "proprietary", "commercial", "unknown", "other", "no license")
GENERATED = ("# generated by", "# auto-generated", "# this file is automatically generated", "# do not edit")
STAGES = ("content", "license", "parse", "length", "stars", "generated", "definitions", "tests")


def license_of(names: Column) -> Column:
    """First permissive licence of an array of names; names with a rejecting word are passed over."""
    known = F.create_map(*(F.lit(x) for pair in PERMISSIVE.items() for x in pair))

    def spelled(raw: Column) -> Column:
        name = F.lower(strip(raw))
        bad = F.lit(False)
        for word in REJECTED:
            bad = bad | F.contains(name, F.lit(word))
        return F.when((name != "") & ~bad, F.coalesce(F.try_element_at(known, name), F.try_element_at(known, F.replace(name, F.lit("_"), F.lit("-")))))

    return F.try_element_at(F.array_compact(F.transform(names, spelled)), F.lit(1))


def has_content(x: Column | str) -> Column:
    return F.coalesce(F.regexp_like(col(x), F.lit(r"[^\s\x1c-\x1f\x85\p{Z}]")), F.lit(False))


def is_generated(x: Column | str) -> Column:
    """A generated-file header among the first five lines after leading white space."""
    lines = head_lines(F.regexp_replace(col(x), r"^[\s\x1c-\x1f\x85\p{Z}]+", ""), 5)

    def header(line: Column) -> Column:
        text, some = F.lower(strip(line)), F.lit(False)
        for start in GENERATED:
            some = some | F.startswith(text, F.lit(start))
        return some

    return F.exists(lines, header)


def is_mostly_comments(x: Column | str, threshold: float = 0.8) -> Column:
    """More than this share of lines blank or starting with a hash; empty text is."""
    marked = r"^[\s\x1c-\x1f\x85\p{Z}]*(#|$)"
    share = let(split_lines(x), lambda lines: F.size(F.filter(lines, lambda line: F.regexp_like(line, F.lit(marked)))) / F.size(lines))
    return F.when(col(x) == "", F.lit(True)).otherwise(share > threshold)


def is_test_path(path: Column | str) -> Column:
    parts = F.split(col(path), "/", -1)
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    return F.regexp_like(stem, F.lit("^[tT]est_")) | F.arrays_overlap(parts, F.array(F.lit("test"), F.lit("tests")))


def chain(records: DataFrame, tests: list[tuple[str, str, Column]]) -> DataFrame:
    """Adds reject_reason (of the first failing test, else null) and stage_reached (rank of the last stage passed).
    tests: (stage, reason, passes)."""
    reason, rank = None, None
    for k, (_, why, passes) in enumerate(tests):
        failed = ~F.coalesce(passes, F.lit(False))
        reason = F.when(failed, why) if reason is None else reason.when(failed, why)
        rank = F.when(failed, F.lit(k)) if rank is None else rank.when(failed, F.lit(k))
    return records.withColumns({"reject_reason": reason, "stage_reached": rank.otherwise(F.lit(len(tests)))})


def ingest_tests(parses: Column | None = None, defines: Column | None = None, min_lines: int = 10, max_lines: int = 1000, min_stars: int = 21, include_tests: bool = False, **names: Callable | str) -> list[tuple[str, str, Column]]:
    """The chain over columns content, licenses, stars, path, declared_generated; parses and defines come from the code
    UDF where content is source code."""
    content = names.get("content", "content")
    out = [("content", "failed_parse", has_content(content)), ("license", "failed_license", license_of(F.col("licenses")).isNotNull())]
    if parses is not None:
        out.append(("parse", "failed_parse", parses))
    out += [
        ("length", "failed_length", line_count(content).between(min_lines, max_lines)),
        ("stars", "failed_stars", F.coalesce(F.col("stars") >= min_stars, F.lit(False))),
        ("generated", "failed_autogenerated", ~(F.coalesce(F.col("declared_generated"), F.lit(False)) | is_generated(content))),
    ]
    if defines is not None:
        out.append(("definitions", "failed_no_definitions", defines))
    if not include_tests:
        out.append(("tests", "failed_test_file", ~is_test_path("path")))
    return out


def funnel(chained: DataFrame, stages: list[str]) -> DataFrame:
    """Records that got through each stage, in long form; one aggregation."""
    counts = chained.agg(F.count("*").alias("c0"), *(F.count_if(F.col("stage_reached") > k).alias(f"c{k + 1}") for k in range(len(stages))))
    rows = F.array(F.struct(F.lit(0).alias("rank"), F.lit("processed").alias("stage"), F.col("c0").alias("n")), *(F.struct(F.lit(k + 1).alias("rank"), F.lit(s).alias("stage"), F.col(f"c{k + 1}").alias("n")) for k, s in enumerate(stages)))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def reasons(chained: DataFrame) -> DataFrame:
    return chained.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def size_gate(records: DataFrame, text: str, min_lines: int = 5, max_bytes: int = 100_000, parses: Column | None = None) -> DataFrame:
    """Disjoint reject reasons of the stress run, in order: too_large, too_short, syntax."""
    tests = [("large", "too_large", F.octet_length(text) <= max_bytes), ("short", "too_short", line_count(text) >= min_lines)]
    return chain(records, tests + ([("syntax", "syntax", parses)] if parses is not None else []))


def sanitise(records: DataFrame, text: str, least: int = 10, most: int = 1 << 20) -> DataFrame:
    """Adds error_type (null if fine) and the text with line feeds only. Sizes are bytes, limits inclusive."""
    size = F.octet_length(text)
    error = F.when(F.col(text).isNull(), "OSError").when(size > most, "FileTooLarge").when(size < least, "FileTooSmall").when(F.contains(F.col(text), F.lit("\0")), "Sanitization")
    return records.withColumns({"error_type": error, "clean": F.regexp_replace(text, "\r\n?", "\n")})


def is_inside(path: Column | str) -> Column:
    """A relative path that stays below its root once '.' and '..' are resolved."""
    steps = F.filter(F.split(col(path), "/", -1), lambda p: ~p.isin("", "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda a, p: F.struct((a["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), (a["ok"] & ((p != "..") | (a["d"] > 0))).alias("ok")))
    return ~F.startswith(col(path), F.lit("/")) & depth["ok"]


def script_share(x: Column | str, low: str = "\\x{4e00}", high: str = "\\x{9fff}") -> Column:
    """Share of a text's characters within a code range."""
    return F.when(F.length(col(x)) > 0, F.length(F.regexp_replace(col(x), f"[^{low}-{high}]", "")) / F.length(col(x))).otherwise(F.lit(0.0))


def script_tier(x: Column | str) -> Column:
    """Bands of the share: A above a tenth, B above a hundredth, C from a thousandth, else D."""
    share = script_share(x)
    return F.when(share > 0.1, "A").when(share > 0.01, "B").when(share >= 0.001, "C").otherwise("D")

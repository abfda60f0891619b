"""Source code: one parse per row in a vectorised UDF whose struct answers every question about it.

Whatever a text holds, the UDF returns: code that can't be read has parses = false and empty lists."""

from __future__ import annotations

import ast
import builtins
import io
import keyword
import tokenize
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

UNREADABLE = (SyntaxError, UnicodeDecodeError, ValueError, RecursionError, MemoryError, tokenize.TokenError)
SKIPPED = {tokenize.ENCODING, tokenize.ENDMARKER, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.COMMENT}
RESERVED = set(keyword.kwlist) | set(keyword.softkwlist) | {n for n in dir(builtins) if not (n.startswith("__") and n.endswith("__"))}
CONVENTION = ("self", "cls", "args", "kwargs")
TYPING = ("T", "K", "V", "U", "P", "T_co", "T_contra", "K_co", "V_co")
SCHEMA = StructType(
    [StructField("parses", BooleanType()), StructField("defines", BooleanType()), StructField("tokens", ArrayType(StringType())), StructField("names", ArrayType(StringType())), StructField("remarks", StringType())]
)


def _tokens(source: str) -> list[tokenize.TokenInfo]:
    """As far as they can be read."""
    out: list[tokenize.TokenInfo] = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(source.replace("\r\n", "\n").replace("\r", "\n")).readline):
            out.append(t)
    except UNREADABLE:
        pass
    return out


def _name(node: ast.AST) -> str | None:
    match node:
        case ast.Name():
            return node.id
        case ast.arg() | ast.keyword():
            return node.arg
        case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef() | ast.ExceptHandler():
            return node.name
        case ast.Attribute():
            return node.attr
        case ast.alias():
            return node.asname
    return None


def read(source: str | None) -> dict:
    """parses, defines (a function or class), tokens without layout and comments, identifiers but for keywords and
    builtins, and the words of comments and docstrings."""
    out = {"parses": False, "defines": False, "tokens": [], "names": [], "remarks": ""}
    if source is None:
        return out
    tokens = _tokens(source)
    out["tokens"] = [s for t in tokens if t.type not in SKIPPED and (s := t.string.strip())]
    remarks = [t.string.lstrip("#").strip() for t in tokens if t.type == tokenize.COMMENT]
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
        nodes = list(ast.walk(tree))
        docs = [d for n in nodes if isinstance(n, ast.Module | ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and (d := ast.get_docstring(n))]
    except UNREADABLE:
        return out | {"remarks": " ".join(remarks)}
    out |= {"parses": True, "defines": any(isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) for n in nodes)}
    return out | {"names": [x for n in nodes if (x := _name(n)) and x not in RESERVED], "remarks": " ".join([*remarks, *docs])}


@F.pandas_udf(SCHEMA)
def code_facts(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read(x) for x in source], columns=["parses", "defines", "tokens", "names", "remarks"])


def category(name: Column) -> Column:
    """Seven kinds of identifier, first match wins."""
    return (
        F.when(F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__")) & (F.length(name) > 4), "dunder")
        .when(name.isin(*CONVENTION), "convention")
        .when(name.isin(*TYPING), "typing_special")
        .when(F.regexp_like(name, F.lit(r"^\p{L}$")), "single_letter")
        .when(F.startswith(name, F.lit("_")) & ~F.startswith(name, F.lit("__")), "private_convention")
        .when(F.regexp_like(name, F.lit(r"\p{Lu}")) & ~F.regexp_like(name, F.lit(r"\p{Ll}")), "constant_style")
        .otherwise("other")
    )


def identifier_table(files, code: str = "code"):
    """Identifiers with total and file counts, share of parsed files and kind."""
    facts = files.select(code_facts(F.col(code)).alias("f"))
    parsed = facts.where("f.parses")
    total = parsed.agg(F.count("*").alias("_files"))
    # Each occurrence counts for the total, each different name once more for the file; one shuffle adds up both.
    said = F.transform("f.names", lambda x: F.struct(x.alias("name"), F.lit(1).alias("n"), F.lit(0).alias("file")))
    once = F.transform(F.array_distinct("f.names"), lambda x: F.struct(x.alias("name"), F.lit(0).alias("n"), F.lit(1).alias("file")))
    names = parsed.select(F.inline(F.concat(said, once)))
    out = names.groupBy("name").agg(F.sum("n").alias("total"), F.sum("file").alias("n_files"))
    share = F.round(100.0 * F.col("n_files") / F.greatest(F.col("_files"), F.lit(1)), 1)
    return out.crossJoin(F.broadcast(total)).select("name", "total", "n_files", share.alias("pct_files"), category(F.col("name")).alias("category"))


# Frequent words of four languages, for the default language detector.
STOP_WORDS = {
    "en": "the of and to in is that it for with as was on are by this be at from or an".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "fr": "le la les de des et un une du en que qui dans pour pas sur par est au plus avec".split(),
    "es": "el la los las de que y en un una por con para se del no es al lo como más".split(),
}


def _among(names: list[str]):
    return lambda w: w.isin(*names)


def detect_language(text: Column, least: int = 50) -> Column:
    """Language whose stop words are most frequent (of equals the first by name); null for short or unknown text. A
    default that any other detector, as a Column function, may replace."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    scores = F.array_sort(F.array(*(F.struct((-F.size(F.filter(words, _among(s)))).alias("k"), F.lit(lang).alias("lang")) for lang, s in sorted(STOP_WORDS.items()))))
    return F.when((F.length(text) >= least) & (scores[0]["k"] < 0), scores[0]["lang"])


def language_shares(rows, lang: str):
    """Detected languages with their share, and whether English."""
    counts = rows.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count(lang).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select("lang", "n", (100.0 * F.col("n") / F.col("_total")).alias("pct"), (F.col("lang") == "en").alias("is_english"))

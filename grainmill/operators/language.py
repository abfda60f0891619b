"""Language detection by hashed character n-grams, trained and applied by column expressions.

A text's features are the first and the last three letters of each of its words, hashed to a fixed number of buckets,
one half of them for heads and one for tails. Training counts them per language, a sum with map-side combine of at most languages * buckets rows
a task; the table of log shares (a fixed size) becomes literal arrays, and a text's score in a language is an
aggregate over its own bucket array. Scores are integers, so any engine and any order give the same.

Texts under `LEAST` characters (white space at the ends aside), without letters, and nulls have no language (null). Ties go
to the first language in order. Rows without a language teach nothing; a table without any makes a model that detects none."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import let, strip

BUCKETS, LEAST = 4096, 50
#: A model is a literal of so many languages' buckets at most.
MOST_LANGUAGES = 64


def buckets(text: Column | str) -> Column:
    """Array of the buckets of all words' edges; null where the text is too short to tell."""
    c = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))
    place = lambda s: F.crc32(s.cast("binary")) % (BUCKETS // 2)
    both = F.flatten(F.transform(words, lambda w: F.array(place(F.left(w, F.lit(3))).cast("int"), (place(F.right(w, F.lit(3))) + BUCKETS // 2).cast("int"))))
    return F.when(F.length(strip(c)) >= LEAST, both)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    logs: list[list[int]]

    def detect(self, held: Column | str) -> Column:
        """The language of a bucket array."""
        c = F.col(held) if isinstance(held, str) else held
        if not self.languages:
            return F.lit(None).cast("string")

        def score(table: list[int]) -> Column:
            literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded to one array
            return F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, b: acc + F.element_at(literal, b + 1))

        scored = F.array(*(F.struct(score(t).alias("score"), F.lit(-i).alias("at"), F.lit(name).alias("name")) for i, (name, t) in enumerate(zip(self.languages, self.logs, strict=True))))
        return F.when(F.size(c) > 0, let(F.array_max(scored), lambda best: best["name"]))


def train(rows: DataFrame, language: str = "lang", held: str = "buckets") -> Model:
    """Log shares, in thousandths, of buckets per language with half a count added to each."""
    counts = rows.where(F.col(language).isNotNull()).select(language, F.explode(held).alias("bucket")).groupBy(language, "bucket").agg(F.count("*").alias("n"))
    names = sorted(r[0] for r in rows.where(F.col(language).isNotNull() & (F.size(held) > 0)).select(language).distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    seen = {(r[0], r["bucket"]): r["n"] for r in counts.collect()}
    total = {name: sum(seen.get((name, b), 0) for b in range(BUCKETS)) for name in names}
    return Model(names, [[math.floor(1000 * math.log((seen.get((name, b), 0) + 0.5) / (total[name] + 0.5 * BUCKETS))) for b in range(BUCKETS)] for name in names])

"""Text helpers as Column expressions, with the semantics of Unicode-aware string methods.

White space is stripped by its Unicode class, lines break at every Unicode line boundary, and word borders are
look-arounds over letters, digits and underscore, as plain trim, split and \\b differ between engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
LINE_BREAK = "(?:\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029])"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), f"^{SPACE}+|{SPACE}+$", "")


def strip_chars(x: Column | str, chars: str) -> Column:
    """Without these characters at either end."""
    inside = "".join(f"\\x{{{ord(c):x}}}" for c in chars)
    return F.regexp_replace(col(x), f"^[{inside}]+|[{inside}]+$", "")


def split_lines(x: Column | str) -> Column:
    """Lines without their breaks; a final break opens no further line; empty text has none."""
    return let(F.split(col(x), LINE_BREAK, -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def head_lines(x: Column | str, n: int) -> Column:
    """The first n lines, without looking at the rest."""
    return F.slice(F.split(col(x), LINE_BREAK, n + 1), 1, n)


def line_count(x: Column | str) -> Column:
    """Breaks, and a last line without one."""
    return F.regexp_count(col(x), F.lit(LINE_BREAK)) + F.regexp_like(col(x), F.lit(rf"(?s).(?<!{LINE_BREAK})\z")).cast("int")


def first_line(x: Column | str) -> Column:
    """First line of the stripped text, stripped again."""
    return strip(F.element_at(F.split(strip(x), "\n", -1), 1))


def raw_first_line(x: Column | str) -> Column:
    """First line as it stands, white space collapsed and lower case: a leading line feed gives ''."""
    return F.lower(one_line(F.element_at(F.split(col(x), "\n", -1), 1)))


def one_line(x: Column | str) -> Column:
    return strip(F.regexp_replace(col(x), f"{SPACE}+", " "))


def is_multiline(x: Column | str) -> Column:
    return F.size(F.split(strip(x), "\n", -1)) > 1


def slug(x: Column | str, fallback: str = "item") -> Column:
    """Runs of other characters become one hyphen; a text without any usable character becomes `fallback`."""
    kept = F.regexp_replace(F.regexp_replace(strip(x), "[^a-zA-Z0-9._-]+", "-"), "^[-._]+|[-._]+$", "")
    return F.when(kept == "", F.lit(fallback)).otherwise(kept)


def tolerant_int(x: Column | str, default: int = 0) -> Column:
    """A number in any spelling, cut to an integer; anything else gives the default."""
    return F.coalesce(strip(col(x).cast("string")).try_cast("double"), F.lit(float(default))).cast("bigint")


def first_present(*xs: Column | str, default: object = None) -> Column:
    """First that is neither null nor ''."""
    return F.coalesce(*(F.when(col(x) != "", col(x)) for x in xs), F.lit(default))


def byte_size(x: Column | str) -> Column:
    return F.octet_length(col(x))


def has_word(x: Column | str, word: str) -> Column:
    """`word` as a whole word, with borders that know all letters and digits."""
    return F.regexp_like(col(x), F.lit(rf"(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])"))


def padded_name(idx: Column | str, width: int = 3, suffix: str = ".py") -> Column:
    """Zero-padded file name; the width is a minimum."""
    return F.format_string(f"%0{width}d{suffix}", col(idx))


def first_differing_line(a: Column | str, b: Column | str) -> Column:
    """Number (from 1) of the first line that differs, terminators included; null if the texts are equal."""
    x, y = (F.regexp_extract_all(col(c), F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0)) for c in (a, b))
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    return F.when(col(a) == col(b), F.lit(None).cast("int")).otherwise(F.array_position(same, False).cast("int"))


def strip_mappings(x: Column | str) -> tuple[Column, Column]:
    """A translator's labelled mapping original_name_<a>_translated_name_<b> reduced to <b>, and how many there were."""
    pattern = r"(?U)original_name_(\w+?)_translated_name_(\w+)"
    return F.regexp_replace(col(x), pattern, "$2"), F.regexp_count(col(x), F.lit(pattern))


def english_words(x: Column | str, translated: dict[str, str]) -> Column:
    """Translated keywords back in English, longest translation first, as whole words; later ones see earlier output."""
    out = col(x)
    for english, word in sorted(translated.items(), key=lambda kv: (-len(kv[1]), kv[0])):
        if word and word != english:
            out = F.regexp_replace(out, rf"(?U)(?<!\w)\Q{word}\E(?!\w)", english)
    return out


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once: an expression that stands inside a lambda is worked out anew for every element."""
    return F.transform(F.array(x), f)[0]


def shingles(tokens: Column, width: int = 5) -> Column:
    """Runs of `width` tokens; fewer give one shingle, none give none."""

    def runs(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, width), " "))

    return let(tokens, lambda t: F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(runs(t)))


def preview(x: Column | str, lines: int = 30) -> Column:
    return F.array_join(F.slice(F.split(col(x), "\n", -1), 1, lines), "\n")

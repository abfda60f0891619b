"""Label extraction from free-form answers, as Column expressions.

Three families: topics (one of seven categories), inference labels (entailment, contradiction, neutral) and choices
(a letter). Each has the extractor used while generating and a refined one that reads native-language answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions.text import col, first_line, has_word, strip, strip_chars

# Categories, labels, and the surface forms that name them.
TOPICS = ("science/technology", "travel", "politics", "sports", "health", "entertainment", "geography")
TOPIC_FORMS = {
    "science/technology": [
        "science/technology", "science", "technology", "physics", "chemistry", "transportation", "telecommunications", "internet security", "interactive design", "ai",
        "سائنس", "ٹکنالوجی", "تکنالوجی", "ٹیکنالوجی", "تکنولوجی", "علم", "تکنیک", "انٹرایکٹو ڈیزائن", "سیٹیلائٹ فون", "انٹرنیٹ پراکسی", "ٹرانسپورٹیشن",
        "科学", "技术", "ciencia", "tecnología", "tecnologia", "التكنولوجيا", "تكنولوجيا",
    ],
    "travel": ["travel", "سفر", "سیاحت", "مسافرت", "مسافر", "公共交通", "旅行", "旅游", "viajes", "viaje"],
    "politics": ["politics", "سیاست", "政治", "política", "politica", "السياسة", "سياسة"],
    "sports": ["sports", "sport", "کھیل", "سپورٹس", "体育", "deportes", "الرياضة", "رياضة"],
    "health": ["health", "صحت", "salud"],
    "entertainment": ["entertainment", "تفریح", "娱乐", "entretenimiento"],
    "geography": ["geography", "地理"],
}
CONJUNCTIONS = (" and ", " y ", " e ", " و ", "和", "与")
SEPARATORS = "[/،,&;+]"
EDGES = " \t.,:;!?()[]{}\"'،۔。"
PLAIN_EDGES = " .,:;!?()[]{}\"'"
SCIENCE_PHRASES = ("سائنس/ٹکنالوجی", "سائنس/تکنالوجی", "سیاست/تکنالوجی", "science/تکنیک", "science/تکنالوجی", "科学/技术", "ciencia/tecnología", "ciencia y tecnología")
SCIENCE_TOPICS = ("physics", "chemistry", "transportation", "telecommunications", "internet security", "interactive design", "ai")
TOPIC_ALIASES = {"science": "science/technology", "technology": "science/technology", "science and technology": "science/technology", "sport": "sports"}

INFERENCE = ("entailment", "contradiction", "neutral")
INFERENCE_FORMS = {
    "蕴含": "entailment", "蕴涵": "entailment", "矛盾": "contradiction", "中立": "neutral",
    "implicación": "entailment", "implicacion": "entailment", "contradicción": "contradiction", "contradiccion": "contradiction", "neutro": "neutral", "neutra": "neutral",
    "لازمی": "entailment", "لازم آتی ہے": "entailment", "انضمامیت": "entailment", "تردید": "contradiction", "غیرجانبدار": "neutral",
}
NEGATIONS = ("没有", "沒有")
PARAPHRASES = (
    ("没有.{0,8}关系", "neutral"),
    ("没有.{0,8}关联", "neutral"),
    ("没有.{0,8}联系", "neutral"),
    ("کوئی.{0,15}تعلق.{0,8}نہیں", "neutral"),
    ("否定", "contradiction"),
    ("直接结果|自然结果|必然结果", "entailment"),
    ("推论|推断", "entailment"),
    ("等同|等价", "entailment"),
)
INFERENCE_CODES = {"0": "entailment", "1": "neutral", "2": "contradiction"}


def _first(cases: list[tuple[Column, Column | str | None]]) -> Column:
    """Value of the first case that holds, else null."""
    out = None
    for test, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def _lookup(forms: dict[str, list[str]]) -> Column:
    return F.create_map(*(F.lit(x) for label, names in forms.items() for name in names for x in (name, label)))


# -- topics ----------------------------------------------------------------------------------------------------------


def _topic_line(x: Column | str) -> Column:
    return strip_chars(first_line(x), EDGES)


def _topics_named(line: Column) -> Column:
    """Distinct categories that the pieces of a line name."""
    joined = line
    for word in CONJUNCTIONS:
        joined = F.replace(joined, F.lit(word), F.lit("/"))
    forms = _lookup(TOPIC_FORMS)
    pieces = F.transform(F.split(joined, SEPARATORS, -1), lambda p: F.try_element_at(forms, F.lower(strip(strip_chars(strip(p), EDGES)))))
    return F.array_distinct(F.array_compact(pieces))


def _topics_within(line: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.contains(F.lower(line), F.lit(t)), F.lit(t)) for t in TOPICS)))


def topic(x: Column | str) -> Column:
    """Refined: the one category named by the pieces of the first line; several are a hedge and give null; none falls
    back to the one category name within the line."""
    line = _topic_line(x)
    named, within = _topics_named(line), _topics_within(line)
    return F.when(F.size(named) == 1, named[0]).when((F.size(named) == 0) & (F.size(within) == 1), within[0])


def topic_via(x: Column | str) -> Column:
    line = _topic_line(x)
    named = F.size(_topics_named(line))
    return F.when(named >= 2, "multi_category").when(named == 1, "single").when(F.size(_topics_within(line)) == 1, "fallback").otherwise("none")


def topic_at_inference(x: Column | str) -> Column:
    line = F.lower(strip_chars(first_line(x), PLAIN_EDGES))
    science = F.startswith(line, F.lit("science/")) | F.startswith(line, F.lit("science /")) | line.isin(*SCIENCE_TOPICS)
    for phrase in SCIENCE_PHRASES:
        science = science | F.contains(line, F.lit(phrase))
    return _first([(science, TOPICS[0]), *((F.contains(line, F.lit(t)), t) for t in TOPICS), *((line == k, v) for k, v in TOPIC_ALIASES.items())])


# -- inference labels ------------------------------------------------------------------------------------------------


def _inference_tiers(x: Column | str) -> list[tuple[str, list[tuple[Column, str]]]]:
    line = first_line(x)
    low = F.lower(line)
    denied = F.lit(False)
    for word in NEGATIONS:
        denied = denied | F.contains(line, F.lit(word))
    return [
        ("tier1_english", [(has_word(low, label), label) for label in INFERENCE]),
        ("tier1_native", [(F.contains(low, F.lit(form)), label) for form, label in INFERENCE_FORMS.items()]),
        ("tier2_cjk_glued", [(~denied & F.contains(low, F.lit(label)), label) for label in INFERENCE]),
        ("tier3_paraphrase", [(F.regexp_like(line, F.lit(pattern)), label) for pattern, label in PARAPHRASES]),
    ]


def inference(x: Column | str) -> Column:
    """Refined: an English label as a word, a native label, an English label glued to other script unless the line
    denies it, then paraphrases in order."""
    return _first([case for _, cases in _inference_tiers(x) for case in cases])


def inference_via(x: Column | str) -> Column:
    tests = []
    for name, cases in _inference_tiers(x):
        some = F.lit(False)
        for test, _ in cases:
            some = some | test
        tests.append((some, name))
    return F.coalesce(_first(tests), F.lit("none"))


def inference_at_inference(x: Column | str) -> Column:
    return _first([case for _, cases in _inference_tiers(x)[:2] for case in cases])


def inference_legacy(x: Column | str) -> Column:
    """As while generating, without the gendered Spanish forms of neutral."""
    english, native = (cases for _, cases in _inference_tiers(x)[:2])
    return _first(english + [c for c, form in zip(native, INFERENCE_FORMS, strict=True) if form not in ("neutro", "neutra")])


# -- choices ---------------------------------------------------------------------------------------------------------


def _choice_line(x: Column | str) -> Column:
    return first_line(F.upper(col(x)))


def _choice_matches(x: Column | str, letters: str) -> tuple[Column, Column, Column]:
    line = _choice_line(x)
    lone = F.regexp_extract(line, rf"(?<![\p{{L}}\p{{N}}_])([{letters}])(?![\p{{L}}\p{{N}}_])", 1)
    after = F.regexp_extract(line, rf"ANSWER\s*[:\-]?\s*([{letters}])", 1)
    return line, lone, after


def choice(x: Column | str, letters: str = "ABCDE") -> Column:
    _, lone, after = _choice_matches(x, letters)
    return F.when(lone != "", lone).when(after != "", after)


def choice_via(x: Column | str, letters: str = "ABCDE") -> Column:
    line, lone, after = _choice_matches(x, letters)
    return F.when((lone != "") & (line == lone), "bare_letter").when(lone != "", "letter_in_text").when(after != "", "answer_prefix").otherwise("none")


#: benchmark -> (label, how it was matched), each a function of the answer column.
EXTRACTORS: dict[str, tuple[Callable[[Column | str], Column], Callable[[Column | str], Column]]] = {
    "topic": (topic, topic_via),
    "inference": (inference, inference_via),
    "choice5": (lambda x: choice(x, "ABCDE"), lambda x: choice_via(x, "ABCDE")),
    "choice4": (lambda x: choice(x, "ABCD"), lambda x: choice_via(x, "ABCD")),
}


def extract(benchmark: Column | str, answer: Column | str) -> tuple[Column, Column]:
    """Label and match of the extractor that the row's benchmark names."""
    label = _first([(col(benchmark) == b, f(answer)) for b, (f, _) in EXTRACTORS.items()])
    via = _first([(col(benchmark) == b, g(answer)) for b, (_, g) in EXTRACTORS.items()])
    return label, via


def outcome(pred: Column | str, gold: Column | str) -> Column:
    return F.when(col(pred).isNull(), "parse_fail").when(col(pred) == col(gold), "correct").otherwise("wrong_label")


def correct(pred: Column | str, gold: Column | str) -> Column:
    """Refined rule: a missing label is never correct."""
    return F.coalesce(col(pred) == col(gold), F.lit(False))


def correct_at_inference(pred: Column | str, gold: Column | str) -> Column:
    """While generating, a missing label equals a missing gold."""
    return col(pred).eqNullSafe(col(gold))


def gold(benchmark: str, x: Column | str) -> Column:
    """Gold labels in one spelling."""
    plain = strip(col(x).cast("string"))
    if benchmark == "inference":
        codes = F.create_map(*(F.lit(v) for pair in INFERENCE_CODES.items() for v in pair))
        return F.coalesce(F.try_element_at(codes, plain), F.lower(plain))
    if benchmark == "choice4":
        return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in zip("1234", "ABCD", strict=True) for v in pair)), plain), F.upper(plain))
    return F.upper(plain) if benchmark == "choice5" else F.lower(plain)



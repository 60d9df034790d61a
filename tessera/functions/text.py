"""Scalar text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a search token.
SEARCH_TOKEN = r"([\p{L}\p{N}_\-/\.]+)"
#: Words that make a sentence a rule: fixed values.
RULE_KEYWORDS = ("must", "shall", "should", "required", "must not", "shall not", "обязан", "должен", "необходимо", "обязательно", "не должен", "запрещено")
#: Substrings that negate a rule: fixed values.
NEGATION_KEYWORDS = ("must not", "shall not", "not ", "не ", "не должен", "запрещено", "forbidden", "forbid")
#: Ordered keyword sets of the fragment types: fixed values.
FRAGMENT_TYPES = (
    ("api", ("api", "endpoint", "openapi", "swagger")),
    ("integration", ("integration", "message broker", "event", "queue")),
    ("component", ("component", "service", "module", "backend", "frontend")),
    ("rule", RULE_KEYWORDS),
    ("requirement", ("requirement", "constraint", "должен", "обязан", "must")),
    ("glossary", ("term", "definition", "glossary")),
)
#: Ordered keyword sets of the rule categories: fixed values.
RULE_CATEGORIES = (
    ("api", ("api", "endpoint", "openapi", "swagger")),
    ("integration", ("integration", "queue", "event", "message")),
    ("component", ("component", "module", "service")),
    ("technology", ("technology", "postgres", "docker", "kubernetes", "python")),
    ("notation", ("notation", "diagram", "archimate", "uml")),
    ("governance", ("governance", "approval", "operator", "audit")),
)


def word_count(text: Column) -> Column:
    """Runs of non-space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def search_tokens(text: Column) -> Column:
    """Lower-cased search tokens of two characters and more, in order; null text has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SEARCH_TOKEN), F.lit(1))
    return F.transform(F.filter(found, lambda t: F.char_length(t) > 1), F.lower)


def budget_tokens(text: Column) -> Column:
    """The estimate of a token budget: words and an eighth of the characters, one at least."""
    return F.greatest(F.lit(1), word_count(text) + F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 8))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncated(text: Column, limit: int) -> Column:
    """Squeezed text; where it is longer than ``limit``, cut with an ellipsis."""
    s = squeezed(text)
    return F.when(F.char_length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…")))


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text), r"[^a-z0-9а-яё]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, 80)


def sentences(text: Column, shortest: int = 20, longest: int | None = 1400, limit: int | None = None) -> Column:
    """Sentences and bullets of each line, without bullet signs around them: those of ``shortest`` characters and more; longer than ``longest`` they end in an ellipsis, without it they stay whole."""
    bare = lambda s: F.regexp_replace(s, r"^[ \-•]+|[ \-•]+$", "")
    lines = F.transform(F.split(text, r"[\r\n]+"), lambda line: bare(squeezed(line)))
    parts = F.flatten(F.transform(lines, lambda line: F.split(line, r"(?<=[.!?;])\s+|\s+•\s+")))
    kept = F.filter(F.transform(parts, lambda s: bare(s)), lambda s: F.char_length(s) >= shortest)
    cut = kept if longest is None else F.transform(kept, lambda s: truncated(s, longest))
    return cut if limit is None else F.slice(cut, 1, limit)


def summary(text: Column) -> Column:
    """The first two sentences in 800 characters; else the start of the text."""
    # a line's sentences are made only while there are fewer than two; their ends beyond 800 characters don't count
    more = lambda found, line: F.when(F.size(found) > 1, found).otherwise(F.concat(found, sentences(line, longest=None)))
    two = F.aggregate(F.split(text, r"[\r\n]+"), F.array().cast("array<string>"), more, lambda found: F.concat_ws(" ", F.slice(found, 1, 2)))
    return F.substring(F.coalesce(F.nullif(two, F.lit("")), squeezed(text)), 1, 800)


def marker_text(text: Column) -> Column:
    """Text for marker search: case-folded, squeezed."""
    return squeezed(F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ё", "е"))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def first_class(text: Column, classes: Sequence[tuple[str, Sequence[str]]], other: str) -> Column:
    """The first class of which a keyword is in the text."""
    low = F.lower(text)
    return F.coalesce(*[F.when(contains_any(low, words), F.lit(name)) for name, words in classes], F.lit(other))


def fragment_type(text: Column) -> Column:
    return first_class(text, FRAGMENT_TYPES, "other")


def rule_category(text: Column) -> Column:
    return first_class(text, RULE_CATEGORIES, "architecture")


def has_negation(text: Column, markers: Sequence[str] = NEGATION_KEYWORDS) -> Column:
    return contains_any(F.lower(text), markers)


def rule_severity(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(contains_any(low, ("must not", "shall not", "запрещено")), "critical")
        .when(contains_any(low, ("must", "shall", "должен", "обязан")), "major")
        .when(contains_any(low, ("should", "рекомендуется")), "minor")
        .otherwise("info")
    )


def modal_strength(text: Column) -> Column:
    low = F.lower(text)
    return F.when(contains_any(low, ("must", "shall", "обязан", "должен")), "strong").when(contains_any(low, ("should", "рекомендуется")), "advisory").otherwise("neutral")


def rule_confidence(text: Column, keywords: Sequence[str] = RULE_KEYWORDS, negations: Sequence[str] = NEGATION_KEYWORDS) -> Column:
    """0.6, and 0.1 for any text, 0.05 for a negation, 0.15 for over 8 words, 0.1 for a keyword; 0.99 at most."""
    terms = [(squeezed(text) != "", 0.1), (has_negation(text, negations), 0.05), (word_count(text) > 8, 0.15), (contains_any(F.lower(text), keywords), 0.1)]
    return F.least(F.lit(0.99), reduce(lambda a, b: a + b, [F.when(c, v).otherwise(0.0) for c, v in terms], F.lit(0.6)))


def _without(text: Column, words: Sequence[str]) -> Column:
    """Lower-cased words of a text, without punctuation and without some words."""
    clean = squeezed(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]+", " "))
    return F.array_join(F.filter(F.split(clean, " "), lambda w: ~w.isin(*words)), " ")


def canonical_signature(text: Column, modal: Sequence[str] = ("must", "shall", "should", "required", "обязан", "должен", "необходимо", "обязательно")) -> Column:
    """Lower-cased words without modal ones."""
    return _without(text, modal)


def conflict_signature(text: Column, quantity: Sequence[str] = ("not", "не", "more", "than", "one", "single", "multiple", "many", "only"), modal: Sequence[str] | None = None) -> Column:
    """The canonical signature without words of polarity and quantity."""
    return _without(canonical_signature(text) if modal is None else canonical_signature(text, modal), quantity)


def page_signature(text: Column) -> Column:
    """SHA-1 of the words of a page without short numbers."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")
    return F.sha1(F.substring(squeezed(F.regexp_replace(words, r"(?U)\b\d{1,4}\b", " ")), 1, 4000))


def version_key(version: Column, parts: int = 4) -> Column:
    """A version as integers padded to ``parts``; arrays compare in order."""
    numbers = F.transform(F.slice(F.regexp_extract_all(version, F.lit(r"(\d+)"), F.lit(1)), 1, parts), lambda x: x.cast("int"))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), parts)), 1, parts)


def json_object(text: Column) -> Column:
    """The first JSON object of a text: in a fence, as the whole, or between its braces; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.when(F.startswith(F.ltrim(text), F.lit("{")), text)), F.try_parse_json(F.nullif(braces, F.lit(""))))

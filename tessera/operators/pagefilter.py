"""Why a page of text says nothing: empty, of little information, repeated, a table of contents, a legal notice.

Defined results: a null text is empty; of pages with one signature that of the smallest id
stays; a page with several reasons has the first in the order above.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

#: Phrases and patterns: fixed values.
FOOTER = ("all rights reserved", "evaluation copy", "not for redistribution")
DISCLAIMER = ("legal disclaimer", "отказ от ответственности")
CONTENTS = ("table of contents", "содержание")
CONTENTS_LINE = r"(?i)\.{3,}|\s(?:[ivxlcdm]+|\d{1,4})$"


def _hits(text: Column, phrases: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(p)).cast("int") for p in phrases], F.lit(0))


def is_contents(text: Column) -> Column:
    """Six lines or more of which enough end in a page number or have dotted leaders."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    n, k = F.size(lines), F.size(F.filter(lines, lambda s: F.regexp_like(X.squeezed(s), F.lit(CONTENTS_LINE))))
    titled = X.contains_any(F.lower(text), CONTENTS)
    return (n >= 6) & F.when(titled, (k >= 5) | (k / n >= 0.45)).otherwise((k >= 8) & (k / n >= 0.55))


def is_legal(text: Column, legal: Sequence[str], domain: Sequence[str]) -> Column:
    """A short evaluation footer, or legal phrases without, or with far more than, signs of a domain."""
    low = F.lower(text)
    words = F.regexp_count(low, F.lit(r"[\p{L}\p{N}_]+"))
    hits = _hits(low, legal)
    footer = (_hits(low, FOOTER) == len(FOOTER)) & (words <= 90)
    told = (hits >= 2) | X.contains_any(low, DISCLAIMER)
    return footer | told & ((_hits(low, domain) == 0) | (hits >= 5) | (hits / F.greatest(words, F.lit(1)) >= 0.08))


def classified(docs: DataFrame, legal: Sequence[str], domain: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, reason)`` of every row; null where a page has something to say.

    Only ids and signatures are shuffled: the first id of a signature is an aggregate
    joined back, so a signature that a third of all pages have is one row there.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    compact = X.squeezed(text)
    tokens = F.regexp_count(compact, F.lit(r"[\p{L}\p{N}_]+"))
    low = (tokens <= 4) & ~F.regexp_like(compact, F.lit(r"\p{L}"))
    early = F.when(compact == "", "empty_page").when(low, "low_information_page")
    late = F.when(is_contents(text), "table_of_contents").when(is_legal(compact, legal, domain), "legal_disclaimer")
    rows = docs.select(F.col(id_col), early.alias("early"), late.alias("late"), X.page_signature(compact).alias("signature"))
    first = rows.where("early is null").groupBy("signature").agg(F.min(id_col).alias("first"))
    joined = rows.join(first, "signature", "left")
    repeated = F.when(F.col(id_col) > F.col("first"), "duplicate_page")
    return joined.select(id_col, F.coalesce("early", repeated, "late").alias("reason"))

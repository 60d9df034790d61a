"""Elements of a vocabulary in sections, and their alignment with what a section allows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elements(text: Column, aliases: Iterable[tuple[str, str]]) -> Column:
    """The sorted elements of ``(element, alias)`` pairs whose alias stands in the text as a phrase."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    hits = [F.when(F.contains(padded, F.lit(f" {alias.lower()} ")), F.lit(element)) for element, alias in aliases]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))


def align(sections: DataFrame, allowed: DataFrame, aliases: Iterable[tuple[str, str]], section: str = "section", text: str = "text") -> DataFrame:
    """The sections with ``found``, ``disallowed`` and ``aligned`` (has an allowed element).

    ``allowed`` holds section and an array ``elements``; a section without a row, or with an
    empty one, allows everything and is aligned if it has text. A null text has no elements.
    """
    rows = sections.withColumn("found", F.coalesce(elements(F.col(text), aliases), F.array().cast("array<string>"))).join(allowed, section, "left")
    listed = F.coalesce(F.size("elements") > 0, F.lit(False))
    told = F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")) != "", F.lit(False))
    disallowed = F.when(listed, F.array_except("found", "elements")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("disallowed", disallowed).withColumn("aligned", F.when(listed, F.arrays_overlap("found", "elements")).otherwise(told)).drop("elements")


def alignment_counts(aligned: DataFrame, key: str = "solution_id") -> DataFrame:
    """``(key, layered, disallowed, weak)``: how many sections a solution has, with disallowed elements, and without allowed ones."""
    return aligned.groupBy(key).agg(F.count(F.lit(1)).alias("layered"), F.count_if(F.size("disallowed") > 0).alias("disallowed"), F.count_if(~F.col("aligned")).alias("weak"))

"""Near-equal bodies: equal, contained with little more, or with a matching ratio near one."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import squeezed

RATIO = 0.98


@F.pandas_udf("double")
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="float64")


def contained(a: Column, b: Column, least: int = 120) -> Column:
    """The shorter body, of ``least`` characters or more, lies in the longer, which has at most 5 % (or 32) more."""
    short, long = F.least(F.char_length(a), F.char_length(b)), F.greatest(F.char_length(a), F.char_length(b))
    return (short >= least) & (long - short <= F.greatest(F.lit(32), (short * 0.05).cast("int"))) & (F.contains(a, b) | F.contains(b, a))


def near_equal(a: Column, b: Column) -> Column:
    """Whether two bodies are the same but for details; null and empty bodies never are, unequal ones under 120 characters neither.

    The matching ratio is only computed for bodies whose lengths allow it.
    """
    x, y = F.lower(squeezed(a)), F.lower(squeezed(b))
    short, long = F.least(F.char_length(x), F.char_length(y)), F.greatest(F.char_length(x), F.char_length(y))
    # the ratio is 2 m / (a + b) with m at most the shorter length
    possible = (short >= 120) & (2 * short / F.greatest(short + long, F.lit(1)) >= RATIO)
    ratio = _ratio(F.when(possible, x), F.when(possible, y))
    return F.coalesce((short > 0) & ((x == y) | contained(x, y) | (ratio >= RATIO)), F.lit(False))


def first_matches(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, near_equal, first_match)`` of every row of ``(conv_id, turn, text)``.

    A body is held against all earlier bodies of its conversation that match none
    themselves; ``first_match`` is the turn of the first it is near. Equal bodies
    are one; of the others, pairs whose lengths allow it are compared.
    """
    body = F.lower(squeezed(F.col("text")))
    in_order = Window.partitionBy("conv_id", "body").orderBy("turn", "text")
    rows = turns.select("conv_id", "turn", "text", F.when(body != "", body).alias("body")).withColumn("nth", F.row_number().over(in_order))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    bodies = rows.where("body is not null and nth = 1").select("conv_id", "turn", "body", at.alias("at"), F.char_length("body").alias("n"))
    long = bodies.where("n >= 120")
    old = long.select("conv_id", F.col("body").alias("a"), F.struct("at", "turn").alias("old"), F.col("n").alias("m"))
    # the widest difference of contained bodies, or of the ratio
    fit = F.abs(F.col("n") - F.col("m")) <= F.greatest(F.lit(32), F.least("n", "m") * 0.05)
    pairs = long.join(old, "conv_id").where((F.col("old.at") < F.col("at")) & fit)
    edges = pairs.where(near_equal(F.col("a"), F.col("body"))).select("conv_id", F.struct("at", "old").alias("e"))
    none = F.array().cast("array<struct<at:int,old:struct<at:int,turn:" + turns.schema["turn"].dataType.simpleString() + ">>>")
    met = lambda found, e: F.exists(found, lambda m: (m["at"] == e["at"]) | (m["at"] == e["old"]["at"]))
    kept = F.aggregate(F.array_sort(F.collect_list("e")), none, lambda found, e: F.when(met(found, e), found).otherwise(F.concat(found, F.array(e))))
    matched = edges.groupBy("conv_id").agg(kept.alias("found")).select("conv_id", F.explode("found").alias("e"))
    matched = matched.select("conv_id", F.col("e.at").alias("at"), F.col("e.old.turn").alias("match"))
    first = bodies.join(matched, ["conv_id", "at"], "left").select("conv_id", "body", F.col("turn").alias("first"), "match")
    match = F.coalesce("match", F.when(F.col("nth") > 1, F.col("first")))
    return rows.join(first, ["conv_id", "body"], "left").select("conv_id", "turn", match.isNotNull().alias("near_equal"), match.alias("first_match"))

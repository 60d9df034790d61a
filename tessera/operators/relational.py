"""Read-side relational operators: latest rows, duplicates, scopes, checks of references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import MET
from .shared import written


def conjunction(equalities: Mapping[str, object]) -> Column:
    """Equality with every value that is given; values of None add nothing."""
    return reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in equalities.items() if v is not None], F.lit(True))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; give ``order`` a unique last column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def capped_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def next_number(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def status_counts(df: DataFrame, keys: Sequence[str], status: str) -> DataFrame:
    """Rows by key and status; a null status counts in no status."""
    return df.where(F.col(status).isNotNull()).groupBy(*keys, status).agg(F.count(F.lit(1)).alias("n"))


def zero_filled_pivot(df: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str]) -> DataFrame:
    """A column with the count of each kind, zero where there is none."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference isn't among the parents."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def scoped(df: DataFrame, key: str, selected: DataFrame | None) -> DataFrame:
    """Rows of the selected keys; all rows without a selection."""
    return df if selected is None else df.join(selected.select(key).distinct(), key, "left_semi")


def nearest_above(asked: DataFrame, known: DataFrame, product: str, version: str) -> DataFrame:
    """The smallest known version above the asked one of the same product, null if none.

    Both sides are merged and read backwards in order, one shuffle without a pair of
    rows: ``asked`` holds product, version and ``id``; ``known`` product and version.
    """
    both = asked.select("id", product, F.col(version).alias("v")).unionByName(known.select(F.lit(None).cast(asked.schema["id"].dataType).alias("id"), product, F.col(version).alias("v")))
    above = F.min(F.when(F.col("id").isNull(), F.col("v"))).over(Window.partitionBy(product).orderBy("v").rangeBetween(1, Window.unboundedFollowing))
    return both.withColumn("above", above).where("id is not null").select("id", product, F.col("v").alias(version), "above")


def multi_search(df: DataFrame, text: Column, tokens: Sequence[str]) -> DataFrame:
    """Rows in whose text, without case and with ``_`` and ``-`` as spaces, every token occurs."""
    hay = F.translate(F.lower(text), "ё_-", "е  ")
    return df.where(reduce(lambda a, b: a & b, [F.contains(hay, F.lit(t.lower())) for t in tokens], F.lit(True)))


def precedence(status: Column, order: Sequence[str]) -> Column:
    """The aggregate that is the first of ``order`` among the statuses."""
    rank = F.coalesce(*[F.when(status == s, F.lit(k)) for k, s in enumerate(order)], F.lit(len(order)))
    return F.element_at(F.array(*map(F.lit, order), F.lit(None).cast("string")), (F.min(rank) + 1).cast("int"))


def weighted_score(severity: Column, status: Column) -> Column:
    """The aggregate 0 to 100: severities weigh 1, 2, 4, 6 (3 if unknown), statuses count 1, 1, .55, 0.

    Statuses count in whole hundredths, so that no order of summing decides a tie, which goes to the even number.
    """
    weight = F.when(severity == "info", 1).when(severity == "minor", 2).when(severity == "major", 4).when(severity == "critical", 6).otherwise(3)
    share = F.when(status.isin("passed", "not_applicable"), 100).when(status == "warning", 55).otherwise(0)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.sum(weight * share) / F.sum(weight))))


def shared_tokens(left: DataFrame, right: DataFrame, key: str, other: str, token: str, most: int = MET) -> DataFrame:
    """``(key, other, shared)``: how many rows of tokens ``(key, token)`` and ``(other, token)`` meet for each pair.

    What meets is dealt by ``key`` before the join, in tasks of about ``most`` rows: they grow in number with
    the pairs, not in size.
    """
    right = written(right)
    count = lambda df, name: df.groupBy(token).agg(F.count(F.lit(1)).alias(name))
    rows = count(left, "a").join(count(right, "b"), token).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n")).first()["n"]
    dealt = left.repartition(max(1, -(-rows // most)), key)
    return dealt.join(right, token).groupBy(key, other).agg(F.count(F.lit(1)).alias("shared"))

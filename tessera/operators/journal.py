"""Roll-ups of runs and stage samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean(value: Column, places: int = 3) -> Column:
    """The mean without nulls; null for none."""
    return F.bround(F.avg(value), places)


def stage_metrics(samples: DataFrame, keys: Sequence[str] = ("stage",), last: int = 3) -> DataFrame:
    """Count, sum, mean, largest, last value, first start, last finish, and the ``last`` samples in order of time.

    ``samples`` holds the keys, ``id``, ``started`` and ``duration``. Only the last samples
    of a stage are gathered, whatever its size.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("started"), F.desc("id"))
    recent = samples.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last)
    tail = recent.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("started", "id", "duration"))), lambda s: s["duration"]).alias("last_samples"))
    finish = F.unix_micros(F.col("started").cast("timestamp")) + (F.col("duration") * 1_000_000).cast("bigint")
    whole = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.sum("duration"), 3).alias("total"),
        F.round(F.avg("duration"), 3).alias("avg"),
        F.max("duration").alias("max"),
        F.max_by("duration", F.struct("started", "id")).alias("last"),
        F.min(F.unix_micros(F.col("started").cast("timestamp"))).alias("first_start_us"),
        F.max(finish).alias("last_finish_us"),
    )
    return whole.join(tail, list(keys))


def ratio(part: Column, whole: Column, places: int = 4) -> Column:
    """A share whose divisor is one at least."""
    return F.round(part / F.greatest(whole, F.lit(1)), places)

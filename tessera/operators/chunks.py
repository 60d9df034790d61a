"""Chunking and token budgets over tables of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import chunking


#: Bytes of texts that are cut at once; a longer text is cut alone.
BLOCK = 1 << 20


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """A batch in slices of texts of about ``most`` bytes: a batch may hold any number of them."""
    start, held = 0, 0
    for row, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if row > start and held + n > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind_col: str | None = None, **options) -> DataFrame:
    """``(id, number, title, content, location, tokens)``: the chunks of every text where it lies."""
    kind = F.col(kind_col) if kind_col else F.lit("other")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), kind.alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, "text")):
            found = [chunking.chunk(t, k, **options) for t, k in zip(batch.column("text").to_pylist(), batch.column("kind").to_pylist(), strict=True)]
            at = pa.array([r for r, parts in enumerate(found) for _ in parts], pa.int64())
            flat = [c for parts in found for c in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(at),
                    pa.array([c.number for c in flat], pa.int64()),
                    pa.array([c.title for c in flat], pa.string()),
                    pa.array([c.content for c in flat], pa.string()),
                    pa.array([c.location for c in flat], pa.string()),
                    pa.array([chunking.words(c.content) for c in flat], pa.int64()),
                ],
                ["id", "number", "title", "content", "location", "tokens"],
            )

    schema = f"id {source.schema['id'].dataType.simpleString()}, number bigint, title string, content string, location string, tokens bigint"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def distribution(found: DataFrame, *keys: str) -> DataFrame:
    """Count, mean, largest, smallest and total tokens of chunks, and the share with a title."""
    return found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.round(F.avg("tokens"), 2).alias("avg_tokens"),
        F.max("tokens").alias("max_tokens"),
        F.min("tokens").alias("min_tokens"),
        F.sum("tokens").alias("total_tokens"),
        F.round(F.count_if(F.coalesce("title", F.lit("")) != "") / F.count(F.lit(1)), 4).alias("title_coverage"),
    )


def within_budget(sizes: Column, budget: int) -> Column:
    """Of sizes in order, the flags of those that a greedy budget takes: a fold over one array."""
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast("array<boolean>").alias("taken"))

    def step(state: Column, size: Column) -> Column:
        fits = size <= state["left"]
        return F.struct((state["left"] - F.when(fits, size).otherwise(0)).cast("bigint").alias("left"), F.concat(state["taken"], F.array(fits)).alias("taken"))

    return F.aggregate(sizes, start, step, lambda s: s["taken"])

"""Versions of a document collection: deltas, carry-forward, content-addressed reuse.

A version is a table of ``(doc_id, checksum, ...)``. Every operator is an equi-join on
the document or the checksum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def diff(before: DataFrame, after: DataFrame, key: str = "doc_id", compared: Sequence[str] = ("checksum",)) -> DataFrame:
    """``(key, change)``: added, removed, changed or unchanged; nulls compare as values."""
    a = before.select(key, F.struct(*compared).alias("a"), F.lit(True).alias("was"))
    b = after.select(key, F.struct(*compared).alias("b"), F.lit(True).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, change.alias("change"))


def deleted(before: DataFrame, seen: DataFrame, scanned: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Earlier documents of the scanned sources that weren't seen now."""
    return before.join(scanned.select(source).distinct(), source, "left_semi").join(seen.select(key), key, "left_anti")


def carried(before: DataFrame, scanned: DataFrame, after: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Earlier documents out of scope that the new version lacks."""
    return before.join(scanned.select(source).distinct(), source, "left_anti").join(after.select(key), key, "left_anti")


def reuse(after: DataFrame, before: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, decision, reuse_id)``: what a document takes over.

    The same document with the same checksum, or a new document whose checksum any
    earlier one has, is unchanged and takes that one's artefacts; a known document
    with another checksum is changed; the rest are new.
    """
    by_sum = before.groupBy("checksum").agg(F.min(key).alias("same"))
    old = before.select(key, F.col("checksum").alias("old_sum"), F.lit(True).alias("known"))
    rows = after.join(old, key, "left").join(by_sum, "checksum", "left")
    same = F.coalesce(F.col("checksum") == F.col("old_sum"), F.lit(False))
    reused = F.when(same, F.col(key)).when(F.col("known").isNull(), F.col("same"))
    decision = F.when(reused.isNotNull(), "unchanged").when(F.col("known"), "changed").otherwise("new")
    return rows.select(key, decision.alias("decision"), reused.alias("reuse_id"))


def embedding_key(parts: Sequence[Column]) -> Column:
    """A key of what an embedding depends on."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n", *parts), 256))


def fingerprint(fields: Sequence[Column]) -> Column:
    """SHA-256 of canonical JSON; name the fields in their order."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def ordered_hash(rows: DataFrame, key: str, value: str, name: str = "hash") -> DataFrame:
    """``(key, n, hash)``: the number of each key's values, and SHA-256 of them in order, joined by commas.

    The hash runs over the sorted rows as a stream, so a key may have any number of values. Null values
    are left out, a null key is a key.
    """
    kind = rows.schema[key].dataType.simpleString()
    kept = rows.select(F.col(key).alias("k"), F.col(value).cast("string").alias("v")).where("v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, last, count, running = False, None, 0, None
        for batch in batches:
            keys, counts, hashes = [], [], []
            for k, v in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if open_ and k == last:
                    running.update(b",")
                else:
                    if open_:
                        keys.append(last)
                        counts.append(count)
                        hashes.append(running.hexdigest())
                    open_, last, count, running = True, k, 0, hashlib.sha256()
                running.update(v.encode())
                count += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("k").type), pa.array(counts, pa.int64()), pa.array(hashes, pa.string())], ["k", "n", name])
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([count], pa.int64()), pa.array([running.hexdigest()])], ["k", "n", name])

    return kept.repartition("k").sortWithinPartitions("k", "v").mapInArrow(run, f"k {kind}, n bigint, {name} string").withColumnRenamed("k", key)

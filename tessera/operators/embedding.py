"""Embedding providers, and a store of the vectors that were made.

A provider is a function from a list of texts to a list of vectors; providers are registered
under names, so that a profile (provider, model, length of vectors) can be a plain parameter.
Tasks send texts to it in batches of the profile's size, made smaller where texts are long. A
batch that fails is tried again in the ladder's next smaller sizes.

The store is a table of vectors by embedding key, which names text and profile. A search
needs only the vectors that the store lacks; they are made once for equal texts.

Defined results: null and blank texts count as empty and are sent like others; a provider
that gives another number of vectors, or vectors of another length, is an error, and so is
one that also fails on single texts; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import embeddings
from tessera.operators.versions import embedding_key

Provider = Callable[[list[str]], Sequence[Sequence[float]]]
_PROVIDERS: dict[str, Callable[[Profile], Provider]] = {}


@dataclass(frozen=True)
class Profile:
    provider: str
    length: int
    model: str = "default"
    batch: int = 64
    #: how batches are cut: ``whole``, all texts at once; ``fixed``; ``laddered``, by their average length
    cut: str = "fixed"
    #: average characters of a text from which a laddered batch holds at most so many: fixed values
    ladder: tuple[tuple[int, int], ...] = ((6000, 4), (3000, 8), (0, 16))


def register_provider(name: str, make: Callable[[Profile], Provider]) -> None:
    """Make a provider known; ``make`` runs once in each task that needs it."""
    _PROVIDERS[name] = make


register_provider("statistical", lambda profile: lambda texts: embeddings(pd.Series(texts), profile.length))


def batch_size(profile: Profile, texts: Sequence[str]) -> int:
    """How many of these texts are sent at once."""
    if profile.cut == "whole":
        return max(1, len(texts))
    if profile.cut == "fixed" or not texts:
        return max(1, profile.batch)
    average = sum(map(len, texts)) / len(texts)
    return max(1, min(profile.batch, next(n for least, n in profile.ladder if average >= least)))


def encoded(profile: Profile, provider: Provider, texts: list[str]) -> list[list[float]]:
    """The vectors of texts, in batches; a batch that fails is cut to the next smaller size."""
    sizes = sorted({n for _, n in profile.ladder} | {1}, reverse=True)

    def send(part: list[str]) -> list[list[float]]:
        try:
            out = [list(map(float, v)) for v in provider(part)]
        except Exception:
            smaller = next((n for n in sizes if n < len(part)), 0)
            if not smaller:
                raise
            return [v for at in range(0, len(part), smaller) for v in send(part[at : at + smaller])]
        if len(out) != len(part) or any(len(v) != profile.length for v in out):
            raise ValueError(f"{profile.provider} gave {len(out)} vectors for {len(part)} texts, or not of length {profile.length}")
        return out

    size = batch_size(profile, texts)
    return [v for at in range(0, len(texts), size) for v in send(texts[at : at + size])]


def encode(rows: DataFrame, profile: Profile, text_col: str = "text", name: str = "embedding") -> DataFrame:
    """``rows`` with the vector of each text."""
    make = _PROVIDERS[profile.provider]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make(profile)
        for batch in batches:
            vectors = encoded(profile, provider, [t or "" for t in batch.column(text_col).to_pylist()])
            yield batch.append_column(name, pa.array(vectors, pa.list_(pa.float64())))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{columns}, {name} array<double>")


def key_of(profile: Profile, text: Column) -> Column:
    """The key of a text's vector under a profile."""
    return embedding_key([F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(profile.provider), F.lit(profile.model), F.lit(str(profile.length))])


class VectorStore:
    """Vectors by key in a folder of Parquet; runs append, equal vectors of two runs count once."""

    SCHEMA = "embedding_key string, embedding array<double>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def vectors(self) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def add(self, texts: DataFrame, profile: Profile, text_col: str = "text") -> None:
        """Make and append the vectors that the store lacks."""
        keyed = texts.select(key_of(profile, F.col(text_col)).alias("embedding_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        new = keyed.join(self.vectors().select("embedding_key"), "embedding_key", "left_anti").groupBy("embedding_key").agg(F.first("text").alias("text"))
        encode(new, profile).select("embedding_key", "embedding").write.mode("append").parquet(self.path)

    def embedded(self, rows: DataFrame, profile: Profile, text_col: str = "text") -> DataFrame:
        """``rows`` with their vectors, of which the missing ones are made first."""
        self.add(rows, profile, text_col)
        known = self.vectors().groupBy("embedding_key").agg(F.first("embedding").alias("embedding"))
        return rows.withColumn("embedding_key", key_of(profile, F.col(text_col))).join(known, "embedding_key").drop("embedding_key")

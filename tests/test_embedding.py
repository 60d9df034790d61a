"""Batches of embedding providers, retries, and the vector store."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.hashing import embeddings
from tessera.operators import embedding as E


class Counting:
    """A provider that notes the sizes of its batches and fails on batches larger than ``most`` or on ``bad`` texts."""

    def __init__(self, length, most=10**6, bad=None):
        self.length, self.most, self.bad, self.sizes = length, most, bad, []

    def __call__(self, texts):
        self.sizes.append(len(texts))
        if len(texts) > self.most or self.bad in texts:
            raise RuntimeError("too much")
        return [[float(len(t))] * self.length for t in texts]


@pytest.mark.parametrize(
    ("cut", "chars", "sizes"),
    [("laddered", 10, [16, 16, 8]), ("laddered", 3000, [8] * 5), ("laddered", 6000, [4] * 10), ("fixed", 6000, [40]), ("whole", 6000, [40])],
)
def test_batches_follow_the_length(cut, chars, sizes):
    provider = Counting(3)
    out = E.encoded(E.Profile("x", 3, cut=cut), provider, ["t" * chars] * 40)
    assert provider.sizes == sizes and out == [[float(chars)] * 3] * 40


def test_failing_batches_get_smaller():
    provider = Counting(2, most=4)
    assert E.encoded(E.Profile("x", 2, cut="laddered"), provider, ["a", "bb"] * 10) == [[1.0, 1.0], [2.0, 2.0]] * 10
    assert provider.sizes == [16, 8, 4, 4, 8, 4, 4, 4]
    with pytest.raises(RuntimeError):
        E.encoded(E.Profile("x", 2), Counting(2, bad="bb"), ["a", "bb"])
    with pytest.raises(ValueError, match="length 3"):
        E.encoded(E.Profile("x", 3), Counting(2), ["a"])
    assert E.encoded(E.Profile("x", 2), Counting(2), []) == []


def test_encode_and_store(spark, tmp_path):
    profile = E.Profile("statistical", 16, cut="whole")
    rows = spark.createDataFrame([(1, "one text", "x"), (2, "another text", "y"), (3, "one text", "z"), (4, None, "w"), (5, "", "v")], "id int, text string, embedding_key string").drop("embedding_key")
    want = {r.id: embeddings(__import__("pandas").Series([r.text or ""]), 16)[0] for r in rows.collect()}
    assert all(np.allclose(r.embedding, want[r.id]) for r in E.encode(rows, profile).collect())
    store = E.VectorStore(spark, str(tmp_path / "vectors"))
    got = {r.id: r.embedding for r in store.embedded(rows, profile).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    assert store.vectors().count() == 3
    # only what is new is made, and another profile has keys of its own
    store.add(rows.union(spark.createDataFrame([(6, "third")], "id int, text string")), profile)
    assert store.vectors().count() == 4
    store.add(rows, E.Profile("statistical", 8, cut="whole"))
    assert store.vectors().groupBy(F.size("embedding").alias("n")).count().orderBy("n").collect() == [(8, 3), (16, 4)]
    assert store.embedded(rows.limit(0), profile).count() == 0

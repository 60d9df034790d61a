"""Near-duplicate embeddings by collision-counting projections.

Vectors of one label are projected on ``projections`` random directions, and each
projection is sorted. Around each query vector a window of the sorted values is
taken per projection; a vector that falls into at least ``collisions`` of the
windows is a candidate, and candidates are verified by their cosine in double
precision. The least count is calibrated: a pair at the threshold collides in one
window with a probability known from the normal distribution, and the count is
the largest that such a pair reaches with probability ``recall`` or more. Pairs
with larger cosines collide more often.

A label's vectors are dealt out before that, so that no task gets a whole large
label: ``b`` sign bits of random directions name a cell, with ``b`` set so that an
average cell has about ``cell`` vectors, in as many independent tables as keep a
pair at the threshold together in one of them with probability ``recall`` or more.
A pair that shares cells of several tables counts in the first. A cell that is
still large (many near copies) is dealt in blocks, and each pair of blocks is a
task of its own. Tasks return a count for each vector and a spanning forest of
their links, never all pairs.

Equal vectors of a label are one vector with a weight.

Defined results: vectors are compared only under equal labels; a null label, and a
vector that is null, empty, zero or holds a null or non-finite component, links
with nothing; vectors of different lengths don't link; repeated rows with one id
count as copies; null ids take part and name no component; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from math import acos, ceil, comb, erf, log, log2, pi, sqrt
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialized, only
from .components import connected_components

#: Vectors of a cell's block; a task compares two blocks.
BLOCK = 4096


def within(cosine: float, width: float) -> float:
    """Chance that a normal projection of two unit vectors' difference is at most ``width``."""
    return erf(width / sqrt(2 - 2 * cosine) / sqrt(2))


def least_count(p: float, projections: int, recall: float) -> int:
    """The largest count that a binomial reaches with probability ``recall`` or more."""
    tail, k = 1.0, 0
    while k < projections:
        tail -= comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail < recall:
            return k
        k += 1
    return k


def directions(seed: int, count: int, length: int) -> np.ndarray:
    return np.random.default_rng([seed, length]).standard_normal((count, length))


def cell_plan(count: int, cell: int, threshold: float, recall: float) -> tuple[int, int]:
    """Sign bits and tables for a label of ``count`` vectors."""
    bits = max(0, ceil(log2(max(1, count) / cell)))
    if not bits:
        return 0, 1
    together = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(1 - recall) / log(1 - together))


def candidates(values: np.ndarray, queries: np.ndarray, width: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that meet in at least ``least`` windows; both arrays hold a column per projection."""
    n, (q, m) = len(values), queries.shape
    order = np.argsort(values, axis=0, kind="stable")
    low = np.empty((q, m), np.int64)
    high = np.empty((q, m), np.int64)
    for j in range(m):
        column = values[order[:, j], j]
        low[:, j] = np.searchsorted(column, queries[:, j] - width, "left")
        high[:, j] = np.searchsorted(column, queries[:, j] + width, "right")
    ranked = np.ascontiguousarray(order.T)
    left, right = [], []
    for i in range(q):
        met = np.concatenate([ranked[j, low[i, j] : high[i, j]] for j in range(m)])
        found = np.flatnonzero(np.bincount(met, minlength=n) >= least)
        left.append(np.full(len(found), i))
        right.append(found)
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each vertex's tree."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _cells(distinct: DataFrame, threshold: float, recall: float, cell: int, seed: int) -> DataFrame:
    """``(v, label, weight, embedding, signs, t, key)``: each distinct vector once per table of its label."""
    sizes = distinct.groupBy("label", F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("count"))
    keyed = distinct.withColumn("dim", F.size("embedding")).join(sizes, ["label", "dim"])
    out = "v bigint, label string, weight bigint, embedding array<double>, dim int, signs array<bigint>, t int, key bigint"

    def run(batches):
        for pdf in batches:
            for (dim, count), part in pdf.groupby(["dim", "count"]):
                bits, tables = cell_plan(int(count), cell, threshold, recall)
                x = np.array(part.embedding.tolist(), np.float64)
                signs = np.zeros((len(part), tables), np.int64)
                for t in range(tables):
                    if bits:
                        above = x @ directions(seed + 1 + t, bits, int(dim)).T > 0
                        signs[:, t] = above @ (1 << np.arange(bits))
                for t in range(tables):
                    yield pd.DataFrame(
                        {"v": part.v, "label": part.label, "weight": part.weight, "embedding": part.embedding, "dim": part.dim, "signs": list(signs), "t": t, "key": signs[:, t]}
                    )

    return keyed.select("v", "label", "weight", "embedding", "dim", "count").mapInPandas(run, out)


def _blocks(cells: DataFrame, block: int) -> DataFrame:
    """Deal the vectors of each cell in blocks and send each block to every pair of blocks it is in."""
    sizes = cells.groupBy("label", "dim", "t", "key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks"))
    dealt = cells.join(sizes, ["label", "dim", "t", "key"]).withColumn("mine", F.pmod(F.xxhash64("v"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    return dealt.withColumn("other", other).withColumn("first", F.least("mine", "other")).withColumn("second", F.greatest("mine", "other"))


def near_duplicates(
    embeddings: DataFrame,
    threshold: float = 0.93,
    projections: int = 32,
    width: float = 0.25,
    recall: float = 0.97,
    cell: int = 2048,
    block: int = BLOCK,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row.

    ``width`` is half a window in units of a standard normal projection of unit vectors.
    """
    source = only(embeddings, id=id_col, embedding=vector_col, label=label_col).withColumn("label", F.col("label").cast("string")).withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = materialized(source.withColumn("ok", F.coalesce(_valid(F.col("embedding")) & F.col("label").isNotNull(), F.lit(False))), "rows")
    distinct = rows.where("ok").groupBy("label", "embedding").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("weight"))
    # v names a vector, by a number of its own where the ids are null
    distinct = materialized(distinct.withColumn("least", F.col("v")).withColumn("v", F.monotonically_increasing_id()), "vectors")
    least = least_count(within(threshold, width), projections, recall)

    def compare(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        _, dim, t, _, first, second = key
        unit = np.array(pdf.embedding.tolist(), np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        a, b = np.flatnonzero(pdf.mine.values == first), np.flatnonzero(pdf.mine.values == second)
        values = unit @ directions(seed, projections, int(dim)).T
        left, right = candidates(values[b], values[a], width, least)
        left, right = a[left], b[right]
        ok = (left < right) if first == second else np.ones(len(left), bool)
        signs = np.array(pdf.signs.tolist())
        for earlier in range(int(t)):
            ok &= signs[left, earlier] != signs[right, earlier]
        left, right = left[ok], right[ok]
        cosine = np.empty(len(left))
        for k in range(0, len(left), 1 << 16):
            cosine[k : k + (1 << 16)] = np.einsum("ij,ij->i", unit[left[k : k + (1 << 16)]], unit[right[k : k + (1 << 16)]])
        left, right = left[cosine >= threshold], right[cosine >= threshold]
        weight = pdf.weight.values
        links = np.bincount(left, weight[right], len(pdf)) + np.bincount(right, weight[left], len(pdf))
        root = forest(len(pdf), left, right)
        found = links > 0
        return pd.DataFrame({"v": pdf.v.values[found], "links": links[found].astype(np.int64), "root": pdf.v.values[root[found]]})

    blocks = _blocks(materialized(_cells(distinct, threshold, recall, cell, seed), "cells"), block)
    blocks = blocks.select("label", "dim", "t", "key", "first", "second", "v", "weight", "embedding", "signs", "mine")
    found = materialized(blocks.groupBy("label", "dim", "t", "key", "first", "second").applyInPandas(compare, "v bigint, links bigint, root bigint"), "found")
    counts = found.groupBy("v").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("v").alias("a"), F.col("root").alias("b"))).select("v", "component")
    named = distinct.join(counts, "v", "left").join(classes, "v", "left").withColumn("component", F.coalesce("component", "v"))
    # written first, so that the join of a large component can be split
    roots = materialized(named.groupBy("component").agg(F.min("least").alias("component_id")), "roots")
    named = materialized(named.join(roots, "component").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "named")
    linked = rows.where("ok").join(named, ["label", "embedding"]).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def digests(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings)


ORACLE_SQL = """
WITH RECURSIVE l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93),
r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.c)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.c) AS component_id, e.vec_id = min(r.c) AS kept FROM embeddings e JOIN r ON r.v = e.vec_id GROUP BY e.vec_id
"""

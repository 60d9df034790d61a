"""Near-duplicates by SimHash: byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes. Fingerprints at ``distance`` d or fewer
differing bits share at least 8 - d of them, the guaranteed minimum of matches.
A list of one positional byte would hold a 256th of all fingerprints, so the count is
made in the index: each fingerprint is posted under every choice of 8 - d positions with
the bytes there. Two that meet in a list have the minimum of matches, two that don't have
fewer; no pair below the minimum is ever formed. The positional bytes that a pair shares
tell in which list it meets first, where it is verified by its differing bits.

Equal fingerprints are one entry of the index. A list of up to ``pair_limit``
fingerprints is paired. Longer lists, as of a large group of near copies, are not:
their members are joined by balls instead. Two fingerprints at d or fewer bits
have a common point within d/2 bits of both, and any two fingerprints within d/2
bits of one point are linked; so a star over each point's fingerprints has
exactly the components of all pairs, with rows in proportion to the members.

Defined results: words are split at ASCII white space and lower-cased A-Z; fewer
words than a shingle give the whole sequence as the one shingle; null, empty and
blank texts have fingerprint zero, which links like any other; rows with a null
id get a fingerprint and the component of their fingerprint, but name none;
repeated rows are each returned; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialized, only
from .components import connected_components

#: Shingle hashes whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of a whole text as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        hashes = digest(b" ".join(words), seed)
    else:
        joined = b" ".join(words)
        ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)])
    table = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(table), BLOCK):
        ones += np.unpackbits(table[k : k + BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(table)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp bigint)`` of every whole text."""
    source = only(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], ["id", "fp"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp bigint")


def _postings(fps: DataFrame, shared: int) -> DataFrame:
    """``(key, fp)``: the fingerprint under each choice of ``shared`` positional bytes."""

    def key(number: int, positions: tuple[int, ...]) -> Column:
        value = F.lit(number).cast("bigint")
        for p in positions:
            value = F.shiftleft(value, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("bigint")))
        return value

    keys = [key(n, p) for n, p in enumerate(combinations(range(8), shared))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _matches(a: Column, b: Column) -> Column:
    """A bit for each of the 8 positional bytes that ``a`` and ``b`` share."""
    x = a.bitwiseXOR(b)
    bits = [F.when(F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255).cast("bigint")) == 0, 1 << p).otherwise(0) for p in range(8)]
    return reduce(lambda m, n: m + n, bits)


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _first_meeting(key: Column, a: Column, b: Column, shared: int) -> Column:
    """Whether the list of ``key`` is the first that holds both, so that a pair counts once."""
    choices = list(combinations(range(8), shared))
    earlier = F.array(*[F.lit(sum(1 << p for p in range(max(c)) if p not in c)) for c in choices])
    number = F.shiftrightunsigned(key, 8 * shared).cast("int")
    return _matches(a, b).bitwiseAND(F.get(earlier, number)) == 0


def _balls(fps: DataFrame, radius: int) -> DataFrame:
    """Star edges over the fingerprints within ``radius`` bits of each point near one."""
    zero = F.array(F.lit(0).cast("bigint"))
    one = F.concat(zero, F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)]))
    flips = one
    for _ in range(radius - 1):
        flips = F.array_distinct(F.flatten(F.transform(flips, lambda x: F.transform(one, lambda y: x.bitwiseXOR(y)))))
    points = fps.select("fp", F.explode(flips).alias("m"))
    points = points.select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
    # a point has at most as many fingerprints as a ball has points
    found = points.groupBy("point").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
    return found.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b").distinct()


def links(fps: DataFrame, distance: int = 4, pair_limit: int = 256) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints with the components of all pairs at ``distance`` bits or fewer."""
    if distance % 2 or not 2 <= distance <= 6:
        raise ValueError("distance must be 2, 4 or 6")
    # few bytes make many postings: spread them over all tasks first
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = _postings(fps.repartition(spread, "fp"), 8 - distance)
    lists = materialized(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
    # the lists grow with the table: merge at every size, never broadcast
    members = materialized(postings.join(lists.hint("merge"), "key"), "members")
    some = members.where(F.col("n") <= pair_limit)
    a, b = F.col("a"), F.col("b")
    meet = some.select("key", F.col("fp").alias("a")).join(some.select("key", F.col("fp").alias("b")), "key").where("a < b")
    pairs = meet.where(_near(a, b, distance) & _first_meeting(F.col("key"), a, b, 8 - distance)).select("a", "b")
    many = members.where(F.col("n") > pair_limit).select("fp").distinct()
    return pairs.union(_balls(many, distance // 2)).distinct()


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp bigint, component_id)`` of every row; component_id is the smallest id reachable by links."""
    marked = materialized(fingerprints(docs, width, id_col, text_col), "fingerprints")
    fps = materialized(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    classes = connected_components(links(fps.select("fp"), distance)).select(F.col("v").alias("fp"), "component")
    known = fps.join(classes, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # written first, so that the join of a large component can be split
    roots = materialized(known.groupBy("component").agg(F.min("least").alias("component_id")), "roots")
    named = known.join(roots, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

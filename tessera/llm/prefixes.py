"""The prefix trie of conversations, from padded turn-id matrices in range shards.

A turn is reduced to a 128-bit id of its role and text and to its word count; texts
don't move further. The sequences of ids are dealt out by range of (sequence,
conversation), so that the conversations below a node are neighbours. Each shard lays
its sequences out as padded matrices of turn numbers, a block of columns at a time,
orders them by ``numpy.lexsort`` and OR-accumulates the change masks of neighbouring
rows along the columns: where a mask begins, a node begins. ``reduceat`` then sums up
every depth.

Nodes above a shard's first or last row may go on in other shards. They leave the
shard as parts under a key of their prefix and recombine: parts of a key are summed; a
node's subtree is the sum, over the paths of first and last rows that pass through it,
of what the path owns from there down (a node is owned by its first path). The
members that end at a node are hashed in order, shard by shard, as a stream.

Memory: a shard holds the ids of about ``shard_turns`` turns, and a block of columns
only pads rows that are still equal to a neighbour. A conversation's ids must fit a row
(20 bytes a turn). To range-deal, Spark samples about 100 sequences a shard.

Defined results: rows with a null conv_id belong to no conversation and are left out;
turns are ordered by turn, nulls first, and rows of equal turn by the hex MD5 of
``<bytes of role>:<role><text>``; null roles and texts are empty, and rows that repeat
are turns of their own; a conversation without turns ends at the root; an empty table
gives no nodes, not even a root; texts of any length count whole; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialized, only

#: Columns of a padded matrix.
BLOCK = 16
EMPTY = hashlib.sha256(b"").hexdigest()


def _half(md5: Column, at: int) -> Column:
    return F.conv(F.substring(md5, at, 16), 16, -10).cast("bigint")


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, seq)``: each conversation's turns in order, as ``(hi, lo, words)``."""
    rows = only(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv is not null").fillna("", ["role", "text"])
    md5 = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    rows = rows.select("conv", "turn", md5.alias("m"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"))
    turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "m", "words"))).alias("turns"))
    return turns.select("conv", F.transform("turns", lambda t: F.struct(_half(t["m"], 1).alias("hi"), _half(t["m"], 17).alias("lo"), t["words"].alias("words"))).alias("seq"))


def rebuilt(seqs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``(conv, seq)``: the first h turns become those of the conversation ``conv - conv % every``; h: crc32 of the id, modulo ``most``."""
    heads = seqs.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.slice("seq", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    both = seqs.withColumn("base", F.col("conv") - F.col("conv") % every).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("seq", 1, 0))
    own = F.slice("seq", h + 1, F.size("seq"))
    return both.select("conv", F.concat(head, own).alias("seq"))


def ordered(codes: np.ndarray, offsets: np.ndarray, conv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by (codes, conv), and of each the number of codes that it shares with the row before.

    Row i has the codes (from 1) from ``offsets[i]`` to ``offsets[i + 1]``.
    """
    lens = np.diff(offsets)
    order = np.argsort(conv, kind="stable")
    shared = np.zeros(len(conv), np.int64)
    tied = np.ones(len(conv), bool)
    tied[:1] = False
    at = 0
    while True:
        # rows of groups that are equal so far, if one of the group goes on
        group = np.cumsum(~tied) - 1
        goes_on = np.bincount(group, lens[order] > at, minlength=1) > 0
        many = np.bincount(group, minlength=1) > 1
        here = np.flatnonzero((goes_on & many)[group]) if len(conv) else np.zeros(0, np.int64)
        if not len(here):
            return order, shared
        rows, group = order[here], group[here]
        width = int(min(BLOCK, lens[rows].max() - at))
        matrix = np.zeros((len(rows), width), np.int64)
        for j in range(width):
            has = lens[rows] > at + j
            matrix[has, j] = codes[offsets[rows[has]] + at + j]
        by = np.lexsort((*matrix.T[::-1], group))
        rows, matrix = rows[by], matrix[by]
        change = np.ones(matrix.shape, bool)
        change[1:] = matrix[1:] != matrix[:-1]
        first = np.ones(len(rows), bool)
        first[1:] = group[1:] != group[:-1]
        change[:, 0] |= first
        np.logical_or.accumulate(change, axis=1, out=change)
        alike = width - change.sum(axis=1)
        order[here] = rows
        shared[here] = np.where(first, shared[here], np.minimum(at + alike, lens[rows]))
        tied[:] = False
        tied[here] = alike == width
        at += width


def _path_keys(hi: np.ndarray, lo: np.ndarray) -> list[str]:
    """A key for each prefix of one row, the empty one included."""
    raw, running, keys = np.stack((hi, lo), 1).astype("<i8"), hashlib.md5(), []
    for turn in raw:
        keys.append(running.hexdigest())
        running.update(turn.tobytes())
    return [*keys, running.hexdigest()]


def _ends(conv: np.ndarray) -> bytes:
    return ",".join(map(str, conv.tolist())).encode()


FIELDS = (
    "edge boolean, first boolean, last boolean, key string, parent_key string, shard int, conv_id bigint, depth bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, ends_sha256 string, ends binary"
)


def shard_nodes(conv: np.ndarray, hi: np.ndarray, lo: np.ndarray, words: np.ndarray, offsets: np.ndarray, shard: int) -> Iterator[dict[str, list]]:
    """The nodes of one shard, a depth at a time from the deepest.

    Nodes above the first or last row (``edge``) hold what belongs to them without
    their edge children, and ``ends``; the others are whole. ``parent_key`` is set
    where the parent is an edge node.
    """
    rank = np.lexsort((lo, hi))
    new = np.ones(len(rank), bool)
    new[1:] = (hi[rank][1:] != hi[rank][:-1]) | (lo[rank][1:] != lo[rank][:-1])
    codes = np.empty(len(rank), np.int64)
    codes[rank] = np.cumsum(new)
    order, shared = ordered(codes, offsets, conv)
    conv, lens, begin = conv[order], np.diff(offsets)[order], offsets[:-1][order]
    first_keys, last_keys = (_path_keys(hi[begin[r] : begin[r] + lens[r]], lo[begin[r] : begin[r] + lens[r]]) for r in (0, -1))
    rows, node_of, levels = np.arange(len(conv)), np.zeros(len(conv), np.int64), []
    for depth in range(int(lens.max()) + 1):
        rows = rows[lens[rows] >= depth]
        start = shared[rows] < depth
        start[0] = True
        pos = np.flatnonzero(start)
        head = rows[pos]
        level = {
            "parent": node_of[head],
            "head": head,
            "n": np.add.reduceat(np.ones(len(rows), np.int64), pos),
            "least": np.minimum.reduceat(conv[rows], pos),
            "ends": np.add.reduceat((lens[rows] == depth).astype(np.int64), pos),
            "words": words[begin[head] + depth - 1] if depth else np.zeros(1, np.int64),
        }
        node_of[rows] = np.cumsum(start) - 1
        first, last = np.zeros(len(pos), bool), np.zeros(len(pos), bool)
        first[0], last[-1] = lens[0] >= depth, lens[-1] >= depth
        levels.append(level | {"first": first, "last": last, "edge": first | last})
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        x = levels[depth]
        size, edge = len(x["n"]), x["edge"]
        children = leaves = saved = np.zeros(size, np.int64)
        if below:
            closed = ~below["edge"]
            of = below["parent"][closed]
            children = np.bincount(of, minlength=size)
            leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(leaves, of, below["leaves"][closed])
            np.add.at(saved, of, below["saved"][closed])
        x["leaves"] = leaves + ((children == 0) & ~edge)
        x["saved"] = saved + np.where(edge, 0, (x["n"] - 1) * x["words"])
        key = np.full(size, None, object)
        key[x["last"]], key[x["first"]] = last_keys[depth] if depth < len(last_keys) else None, first_keys[depth] if depth < len(first_keys) else None
        # the parent's key where the parent is an edge node, else its smallest member
        above, parent_key, parent_conv = levels[depth - 1] if depth else None, [None] * size, [None] * size
        if above:
            up = x["parent"]
            keys = np.full(len(above["n"]), None, object)
            if above["last"][-1]:
                keys[-1] = last_keys[depth - 1]
            if above["first"][0]:
                keys[0] = first_keys[depth - 1]
            parent_key = keys[up].tolist()
            parent_conv = [None if k else c for k, c in zip(parent_key, above["least"][up].tolist(), strict=True)]
        ends = [_ends(conv[h : h + e]) if e else b"" for h, e in zip(x["head"].tolist(), x["ends"].tolist(), strict=True)]
        yield {
            "edge": edge, "first": x["first"], "last": x["last"], "key": key.tolist(), "parent_key": parent_key, "shard": [shard] * size, "conv_id": x["least"], "depth": [depth] * size, "parent_conv_id": parent_conv,
            "n_convs": x["n"], "n_children": children, "n_leaves": x["leaves"], "saved_tokens": x["saved"], "words": x["words"],
            "ends_sha256": [None if g else hashlib.sha256(b).hexdigest() if b else EMPTY for g, b in zip(edge.tolist(), ends, strict=True)], "ends": [b if g and b else None for g, b in zip(edge.tolist(), ends, strict=True)],
        }
        below = x


def _schema() -> pa.Schema:
    kinds = {"boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, FIELDS.split(", "))])


def _in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema()
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found).combine_chunks()
    seq = table.column("seq").combine_chunks()
    turns = seq.flatten()
    offsets = np.concatenate(([0], np.cumsum(np.asarray(seq.value_lengths()).astype(np.int64))))
    parts = (np.asarray(turns.field(k)).astype(np.int64) for k in ("hi", "lo", "words"))
    waiting: list[pa.RecordBatch] = []
    for level in shard_nodes(np.asarray(table.column("conv")).astype(np.int64), *parts, offsets, table.column("shard")[0].as_py()):
        waiting.append(pa.RecordBatch.from_arrays([pa.array(level[f.name], f.type) for f in schema], schema=schema))
        if len(waiting) == 64:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting = []
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, ends_sha256)`` from rows in order of (key, shard): one running hash, whatever a key's number of rows."""
    key, running = None, None
    for batch in batches:
        keys, hashes = [], []
        for k, part in zip(batch.column("key").to_pylist(), batch.column("ends"), strict=True):
            if k != key:
                if running:
                    keys.append(key)
                    hashes.append(running.hexdigest())
                key, running = k, hashlib.sha256()
            else:
                running.update(b",")
            running.update(part.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running.hexdigest()])], ["key", "ends_sha256"])


def _recombined(edge: DataFrame) -> DataFrame:
    """The edge nodes, whole, with their key and their parent's."""
    least = F.min(2 * F.col("shard") + F.when(F.col("first"), 0).otherwise(1)).alias("owner")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = materialized(edge.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.max("words").alias("words"), least, *sums), "edges")
    below = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    nodes = nodes.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    own = nodes.select("key", "owner", (F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint")).alias("leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    path = F.filter(F.array(F.when(F.col("first"), 2 * F.col("shard")), F.when(F.col("last"), 2 * F.col("shard") + 1)), lambda p: p.isNotNull())
    paths = edge.select("key", "depth", F.explode(path).alias("path")).join(own, "key")
    down = Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    mine = F.col("owner") == F.col("path")
    summed = paths.select("key", F.sum(F.when(mine, F.col("leaves")).otherwise(0)).over(down).alias("l"), F.sum(F.when(mine, F.col("saved")).otherwise(0)).over(down).alias("s"))
    summed = summed.groupBy("key").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    ends = edge.where("ends is not null").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_stream_hashes, "key string, ends_sha256 string")
    whole = nodes.drop("n_leaves", "saved_tokens").join(summed, "key").join(ends, "key", "left")
    return whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))


def trie(seqs: DataFrame, shard_turns: int = 50_000) -> DataFrame:
    """The nodes of the prefix trie of ``(conv, seq)``: one row for each distinct prefix, the empty one included."""
    seqs = materialized(seqs, "sequences")
    turns = seqs.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    dealt = seqs.repartitionByRange(max(1, -(-turns // shard_turns)), "seq", "conv")
    parts = materialized(dealt.select("conv", "seq", F.spark_partition_id().alias("shard")).mapInArrow(_in_shards, FIELDS), "nodes")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = materialized(_recombined(parts.where("edge")), "recombined")
    above = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    inner = parts.where("not edge and parent_key is null").select(columns)
    below = parts.where("not edge and parent_key is not null").join(above, "parent_key").withColumn("parent_conv_id", F.col("above")).select(columns)
    edges = whole.join(above, "parent_key", "left").withColumn("parent_conv_id", F.col("above")).select(columns)
    return inner.union(below).union(edges)


def digests(conversations: DataFrame) -> DataFrame:
    return trie(rebuilt(sequences(conversations)))


ORACLE_SQL = r"""
WITH tab AS (SELECT list(v ORDER BY i) AS tb FROM (SELECT i, list_reduce([CAST(i AS BIGINT)] || range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) AS r(i))),
turns AS (SELECT conv_id AS c, turn, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, CAST(c AS VARCHAR) AS s, list(m ORDER BY turn NULLS FIRST, m) AS ms, list(w ORDER BY turn NULLS FIRST, m) AS ws FROM turns GROUP BY c),
h AS (SELECT own.*, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT)), lambda a, b: xor(a // 256, tb[xor(a % 256, b) + 1])), 4294967295) % 4 AS h FROM own, tab),
again AS (SELECT h.c, coalesce(b.ms[1:h], []) || h.ms[h + 1:] AS ms, coalesce(b.ws[1:h], []) || h.ws[h + 1:] AS ws FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20),
pre AS (SELECT c, d, array_to_string(ms[1:d], ',') AS k, array_to_string(ms[1:d - 1], ',') AS pk, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS w, d = len(ms) AS ends FROM (SELECT *, unnest(range(len(ms) + 1)) AS d FROM again)),
node AS (SELECT d, k, min(pk) AS pk, min(c) AS conv_id, count(*) AS n, max(w) AS w, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM pre GROUP BY d, k),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
whole AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, k)),
sub AS (SELECT e AS d, CASE WHEN e = 0 THEN '' ELSE substr(k, 1, 33 * e - 1) END AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * w) AS saved FROM (SELECT *, unnest(range(d + 1)) AS e FROM whole) GROUP BY ALL)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children, sub.n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM whole x JOIN sub USING (d, k) LEFT JOIN whole p ON p.d = x.d - 1 AND p.k = x.pk
"""

"""Packing documents into sequences of fixed length.

First-fit decreasing with a tournament tree of the free space in the bins, run
independently in randomised groups: every piece of a document goes to a group by
a hash of its row in the table of pieces, which is written first so that a retry
deals alike. The number of groups grows with the ids, so that a group has a bounded
number of them whatever the table's size, however long one document is and however
many rows share an id. What first-fit leaves open is closed by dissolving the emptiest
bins and cutting their pieces to the gaps, so a group has as few sequences as
its tokens allow: less than one sequence of padding a group.

Defined results: a null or empty text is its end token alone; a null id is kept;
repeated rows are each packed; documents of any length are packed whole (those
of more than one sequence are cut first); an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import AMBIGUOUS_SPACE, PATTERN, Cache, byte_symbols, hold
from .common import materialized, only

#: Ids in a group, about, and groups in a task.
GROUP_IDS, GROUPS = 1_500_000, 16
_PIECES = "id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary"


class Tokens:
    """Ids of texts by the merges of a ``tokenizer.json``, run by tiktoken."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = byte_symbols()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(as_byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.ordinary = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        #: type code of an id
        self.code = "H" if max(spec["model"]["vocab"].values(), default=0) < 1 << 16 > max(special.values(), default=0) else "I"
        self.pieces = Cache(lambda p: array(self.code, self.ordinary(p)).tobytes())

    def _plain(self, text: str) -> bytes:
        if AMBIGUOUS_SPACE.search(text):
            return array(self.code, self.ordinary(text)).tobytes()
        head, *rest = text.split(" ")
        pieces = self.pieces
        return (pieces[head] if head else b"") + b"".join([pieces[" " + p] for p in rest])

    def __call__(self, text: str | None) -> bytes:
        """Unsigned ids, of 16 bits where the vocabulary allows, else of 32."""
        if not text:
            return b""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.split_special.split(text)
        return b"".join(array(self.code, [self.special[p]]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts) if p)


_loaded: dict[str, Tokens] = {}


def _tokens(path: str) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    hold(_loaded[path].pieces)
    return _loaded[path]


class FreeSpace:
    """A tournament tree: each inner node holds the larger free space of its two."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """The first bin with room for ``size``; there must be one."""
        node, tree, leaves = 1, self.tree, self.leaves
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        return node - leaves

    def take(self, bin_: int, size: int) -> None:
        tree, node = self.tree, bin_ + self.leaves
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size; equal sizes go in their order."""
    free, bins = FreeSpace(max(1, len(sizes)), capacity), [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        bins[k] = free.first(sizes[k])
        free.take(bins[k], sizes[k])
    return bins


def pack(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Parts ``(piece, from, length, bin, offset)`` in bins numbered from 0.

    First-fit decreasing, then the emptiest bins that the free space of the
    others can hold are dissolved into it, cutting where needed.
    """
    held: dict[int, list[tuple[int, int, int]]] = {}
    for k, b in enumerate(first_fit_decreasing(sizes, capacity)):
        held.setdefault(b, []).append((k, 0, sizes[k]))
    filled = {b: sum(n for _, _, n in parts) for b, parts in held.items()}
    surplus = (len(held) * capacity - sum(filled.values())) // capacity
    order = sorted(held, key=lambda b: (filled[b], b))
    gone, gaps = order[:surplus], [b for b in reversed(order[surplus:]) if filled[b] < capacity]
    todo = [part for b in gone for part in held.pop(b)][::-1]
    for b in gaps:
        while todo and filled[b] < capacity:
            k, at, n = todo.pop()
            m = min(n, capacity - filled[b])
            held[b].append((k, at, m))
            filled[b] += m
            if m < n:
                todo.append((k, at + m, n - m))
    out = []
    for new, b in enumerate(sorted(held)):
        offset = 0
        for k, at, n in held[b]:
            out.append((k, at, n, new, offset))
            offset += n
    return out


def pieces_of(docs: DataFrame, vocabulary: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of at most ``length`` ids of every whole document with its end token."""
    source = only(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(vocabulary)
        end = array(tokens.code, [end_id]).tobytes()
        width = array(tokens.code).itemsize
        step = width * length
        for batch in batches:
            rows, starts, totals, parts = [], [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                ids = tokens(text) + end
                for s in range(0, len(ids), step):
                    rows.append(r)
                    starts.append(s // width)
                    totals.append(len(ids) // width)
                    parts.append(ids[s : s + step])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(rows, pa.int64())),
                    pa.array(starts, pa.int64()),
                    pa.array([len(p) // width for p in parts], pa.int64()),
                    pa.array(totals, pa.int64()),
                    pa.array(parts, pa.binary()),
                ],
                ["id", "start", "length", "doc_tokens", "ids"],
            )

    return source.mapInArrow(run, _PIECES.format(kind=kind))


def pack_documents(
    docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", group_ids: int = GROUP_IDS
) -> DataFrame:
    """Pack all documents: one row per piece, ``(id, start, length, doc_tokens, sequence_id, offset, ids)``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers, ``start``
    the number of its document's ids before it, ``offset`` its place in the sequence.
    """
    pieces = materialized(pieces_of(docs, vocabulary, length, end_id, id_col, text_col), "pieces")
    kind = pieces.schema["id"].dataType.simpleString()
    groups = max(1, -(-(pieces.agg(F.sum("length")).first()[0] or 0) // group_ids))
    pieces = pieces.withColumn("row", F.monotonically_increasing_id())
    pieces = pieces.withColumn("g", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))
    # tasks grow in number with the groups, not in size
    tasks = max(min(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), groups // GROUPS)

    def pack_group(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("id", "ascending"), ("start", "ascending"), ("row", "ascending")])
        g, ids = group.column("g")[0].as_py(), group.column("ids").to_pylist()
        parts = pack(group.column("length").to_pylist(), length)
        rows = pa.array([p[0] for p in parts], pa.int64())
        at = pa.array([p[1] for p in parts], pa.int64())
        widths = [len(x) // n for x, n in zip(ids, group.column("length").to_pylist(), strict=True)]
        wide = [np.frombuffer(ids[k], f"<u{widths[k]}", n, widths[k] * a).astype("<u4").tobytes() for k, a, n, _, _ in parts]
        return pa.table(
            {
                "id": group.column("id").take(rows),
                "start": pa.compute.add(group.column("start").take(rows), at),
                "length": pa.array([p[2] for p in parts], pa.int64()),
                "doc_tokens": group.column("doc_tokens").take(rows),
                "sequence_id": pa.array([(g << 32) + p[3] for p in parts], pa.int64()),
                "offset": pa.array([p[4] for p in parts], pa.int64()),
                "ids": pa.array(wide, pa.binary()),
            }
        )

    packed = pieces.repartition(tasks, "g").groupBy("g").applyInArrow(pack_group, f"id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
    return packed.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The pieces of ``documents`` with a checksum of their ids in place of them."""
    packed = pack_documents(docs, vocabulary)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

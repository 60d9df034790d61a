"""Removal of repeated passages by Rabin-Karp hashes of fixed-length word windows.

Every window of ``width`` words is judged. The windows' rolling hashes are
counted in Spark: a hash's smallest document id is kept, and a window that also
starts in a document with a smaller id is repeated. Repeated windows merge into
maximal intervals of words, which are removed.

Windows that can't repeat are left out of the count beforehand, exactly: of each
window the least hash of its ``anchor``-word grams is taken. Equal windows have
equal anchors, so only windows whose anchor occurs in two documents are counted.
An anchor serves many neighbouring windows, so this costs a small part of the
rows that all windows would. A text that has the same words as one with a smaller
id is repeated as a whole and takes no part in the count. Window hashes are two
independent 64-bit sums.

Defined results: words are split at ASCII white space and stay unchanged; a null
or empty text has no words; a text shorter than a window keeps all its words;
rows with a null id lose nothing and take nothing; rows that share an id are each
judged, and don't repeat one another; texts of any length are hashed whole, in
blocks; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Cache, hold
from .common import materialized, only

#: Odd multipliers of the rolling sums, modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words of one text that are hashed at once.
BLOCK = 1 << 18


class Rolling:
    """Window hashes of arrays of word hashes: a difference of prefix sums, moved back by an inverse power."""

    def __init__(self, base: int):
        self.up, self.down = (self.powers(b) for b in (base, pow(base, -1, 1 << 64)))

    @staticmethod
    def powers(base: int) -> np.ndarray:
        x = np.full(BLOCK + 1, base, np.uint64)
        x[0] = 1
        return x.cumprod(dtype=np.uint64)

    def __call__(self, words: np.ndarray, width: int) -> np.ndarray:
        """The hash of each window; ``words`` has at most :data:`BLOCK` entries and at least ``width``."""
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=sums[1:])
        return (sums[width:] - sums[:-width]) * self.down[: len(words) - width + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x


class Windows:
    """Hashes of a text's windows; made once per Python worker."""

    def __init__(self):
        self.hashes = Cache(lambda w: xxhash.xxh64_intdigest(w, 1))
        self.rolling = [Rolling(b) for b in BASES]

    def blocks(self, words: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray]]:
        """Word hashes in blocks that overlap so that each window lies in exactly one."""
        for at in range(0, max(0, len(words) - width + 1), BLOCK - width + 1):
            part = words[at : at + BLOCK]
            yield at, np.fromiter(map(self.hashes.__getitem__, part), np.uint64, len(part))

    def anchors(self, words: list[bytes], width: int, gram: int) -> Iterator[tuple[int, np.ndarray]]:
        for at, block in self.blocks(words, width):
            yield at, sliding_least(mixed(self.rolling[0](block, gram)), width - gram + 1)

    def of(self, words: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for at, block in self.blocks(words, width):
            yield at, self.rolling[0](block, width), self.rolling[1](mixed(block), width)


_made: list[Windows] = []


def windows() -> Windows:
    if not _made:
        _made.append(Windows())
    hold(_made[0].hashes)
    return _made[0]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _anchors(source: DataFrame, width: int, gram: int, kind: str) -> DataFrame:
    """``(id, k, whole, anchor, more)``: the distinct anchors of every text that has a window,
    and in a row with ``whole`` a 128-bit hash of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = windows()
        for batch in batches:
            rows, whole, found, more = [], [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                words = _words(text)
                if len(words) < width:
                    continue
                a = np.unique(np.concatenate([np.unique(a) for _, a in made.anchors(words, width, gram)]))
                high, low = divmod(xxhash.xxh3_128_intdigest(b" ".join(words)), 1 << 64)
                n = len(a) + 1
                rows.append(np.full(n, r))
                whole.append(np.arange(n) == 0)
                found.append(np.concatenate((np.array([high], np.uint64), a)))
                more.append(np.array([low] + [0] * (n - 1), np.uint64))
            if not rows:
                continue
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("k").take(at), pa.array(np.concatenate(whole)), *(pa.array(np.concatenate(x).view(np.int64)) for x in (found, more))],
                ["id", "k", "whole", "anchor", "more"],
            )

    return source.where("id is not null").mapInArrow(run, f"id {kind}, k bigint, whole boolean, anchor bigint, more bigint")


def _shared_windows(joined: DataFrame, width: int, gram: int, kind: str) -> DataFrame:
    """``(id, k, pos, h1, h2)`` of the windows with an anchor in ``shared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = windows()
        for batch in batches:
            shared = batch.column("shared")
            values, offsets = shared.values.to_numpy(), shared.offsets.to_numpy()
            rows, pos, one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for r, text in enumerate(batch.column("text").to_pylist()):
                words, mine = _words(text), values[offsets[r] : offsets[r + 1]].view(np.uint64)
                for (at, a), (_, h1, h2) in zip(made.anchors(words, width, gram), made.of(words, width), strict=True):
                    here = np.flatnonzero(np.isin(a, mine))
                    rows.append(np.full(len(here), r))
                    pos.append(here + at)
                    one.append(h1[here])
                    two.append(h2[here])
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("k").take(at), pa.array(np.concatenate(pos)), pa.array(np.concatenate(one).view(np.int64)), pa.array(np.concatenate(two).view(np.int64))],
                ["id", "k", "pos", "h1", "h2"],
            )

    return joined.mapInArrow(run, f"id {kind}, k bigint, pos bigint, h1 bigint, h2 bigint")


def _cut(joined: DataFrame, width: int) -> DataFrame:
    """Merge the repeated windows of each text into intervals and keep the other words."""
    carried = [f for f in joined.schema.fields if f.name not in ("text", "repeats")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, spans, kept = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("repeats").to_pylist(), strict=True):
                words = _words(text)
                starts = np.unique(np.array(found or [], np.int64))
                out, left, at = [], [], 0
                if len(starts) and starts[0] < 0:
                    out, at = [{"start": 0, "end": len(words)}], len(words)
                elif len(starts):
                    breaks = np.flatnonzero(np.diff(starts) > width)
                    firsts = starts[np.concatenate(([0], breaks + 1))]
                    lasts = starts[np.concatenate((breaks, [len(starts) - 1]))] + width
                    for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
                        out.append({"start": a, "end": b})
                        left += words[at:a]
                        at = b
                left += words[at:]
                totals.append(len(words))
                removed.append(len(words) - len(left))
                spans.append(out)
                kept.append(b" ".join(left).decode())
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in carried), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kinds), pa.array(kept, pa.string())],
                [*(f.name for f in carried), "n_words", "n_removed", "spans", "kept"],
            )

    found = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    more = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(found)), T.StructField("kept", T.StringType())]
    return joined.mapInArrow(run, T.StructType([*carried, *more]))


def remove_repeats(docs: DataFrame, width: int = 50, anchor: int = 25, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``(id, n_words, n_removed, spans, kept)`` of every row.

    ``spans`` are the maximal removed intervals in words, ``kept`` the other words
    joined by one space. ``carry`` adds ``row``, a struct of the row's own columns.
    """
    source = only(docs, id=id_col, text=text_col).withColumn("k", F.xxhash64("text"))
    kind = source.schema["id"].dataType.simpleString()
    anchors = materialized(_anchors(source, width, anchor, kind), "anchors")
    wholes = anchors.where("whole").select("id", "k", "anchor", "more")
    least = materialized(wholes.groupBy("anchor", "more").agg(F.min("id").alias("m"), F.max("id").alias("x")).where("m < x").select("anchor", "more", "m"), "wholes")
    copies = materialized(wholes.join(least, ["anchor", "more"]).where("id > m").select("id", "k"), "copies")
    anchors = anchors.where("not whole").join(copies, ["id", "k"], "left_anti").select("id", "k", "anchor")
    common = anchors.groupBy("anchor").agg(F.min("id").alias("m"), F.max("id").alias("x")).where("m < x").select("anchor")
    common = materialized(common, "common")
    mine = materialized(anchors.join(common, "anchor"), "shared").groupBy("id", "k").agg(F.collect_set("anchor").alias("shared"))
    found = materialized(_shared_windows(source.join(mine, ["id", "k"]).select("id", "k", "text", "shared"), width, anchor, kind), "windows")
    first = found.groupBy("h1", "h2").agg(F.min("id").alias("m"), F.max("id").alias("x")).where("m < x").select("h1", "h2", "m")
    # as a table of its own, so that a hash in very many documents is split in the join
    first = materialized(first, "first")
    repeats = materialized(found.join(first, ["h1", "h2"]).where("id > m").select("id", "k", "pos"), "repeats")
    repeats = repeats.groupBy("id", "k").agg(F.collect_set("pos").alias("repeats"))
    # every word of a copy lies in a repeated window
    repeats = repeats.unionByName(copies.select("id", "k", F.array(F.lit(-1).cast("bigint")).alias("repeats")).distinct())
    if carry:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), row).withColumn("k", F.xxhash64("text"))
    cut = _cut(source.join(repeats, ["id", "k"], "left").drop("k"), width)
    return cut.withColumnRenamed("id", id_col)


def digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, p, sha256(array_to_string(ws[p:p + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d WHERE len(ws) >= 50)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
rep AS (SELECT DISTINCT doc_id, p FROM win JOIN least USING (h) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, p + o AS i FROM rep, range(50) AS r(o)),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
k AS (SELECT w.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY w.i) FILTER (gone.i IS NULL) AS kept FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

"""Byte-pair encoding and decoding.

A word's symbols form a doubly linked list; a priority queue holds the merges
that are possible now, by rank and then by place. Taking an entry whose
symbols have meanwhile changed (a stale entry) does nothing. Decoding
concatenates the vocabulary's byte strings.

Every text is encoded where it lies (``mapInArrow``): no shuffle, memory for one
Arrow batch and for caches of bounded size.

Defined results: a null text counts as empty and has no ids; an empty text has
no ids; texts of any length are encoded whole; repeated rows are each encoded;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

#: The pattern of byte-level BPE that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space between two other spaces or before the end: there, pieces between
#: single spaces can't be split on their own.
AMBIGUOUS_SPACE = regex.compile(r"(?<=[\s\x1c-\x1f\x85]) (?=[\s\x1c-\x1f\x85]|\Z)")
#: Cached entries of a generation, of which a cache holds two. It bounds the
#: memory of a Python worker and changes no result.
CACHE_ENTRIES = 200_000
#: Longer pieces are encoded each time.
CACHE_LENGTH = 64


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by rule:
    printable Latin-1 bytes stand for themselves, the others count up from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The caches of this Python worker that hold entries.
_held: list[Cache] = []


def hold(*caches: Cache) -> None:
    """A task begins with these caches: those of other steps, which ran in this worker before, are emptied."""
    for other in [c for c in _held if not any(c is mine for mine in caches)]:
        other.clear()
        other.old = {}
    _held[:] = caches


class Cache(dict):
    """Values made on demand; when full, the entries become the old generation and
    come back only as they are used again. Workers outlive tasks: see :func:`hold`."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class ByteBPE:
    """A tokenizer read from a byte-level BPE ``tokenizer.json``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.strings = {i: bytes(as_byte[c] for c in s) for s, i in vocab.items()}
        self.first = [vocab[c] for c, _ in sorted(as_byte.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN).findall
        self.word_cache = Cache(lambda w: array("I", self.merge(w.encode())).tobytes())
        self.piece_cache = Cache(lambda p: b"".join(map(self.word_cache.__getitem__, self.words(p))))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the merge of lowest rank first, the leftmost of equals."""
        ids = [self.first[b] for b in word]
        n, merges = len(ids), self.merges
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        if not heap:
            return ids
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> bytes:
        if AMBIGUOUS_SPACE.search(text):
            return b"".join(map(self.word_cache.__getitem__, self.words(text)))
        head, *rest = text.split(" ")
        found = b"".join(map(self.word_cache.__getitem__, self.words(head)))
        # no word spans the start of a single space, so the pieces are independent
        return found + b"".join([self.piece_cache[" " + piece] for piece in rest])

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as unsigned 32-bit integers in native (little-endian) order."""
        if not text:
            return b""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.split_special.split(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts) if p)

    def decode(self, ids: bytes) -> str:
        """The text of ids; unknown ids stand for nothing."""
        values = array("I")
        values.frombytes(ids)
        strings = self.strings
        try:
            joined = b"".join(map(strings.__getitem__, values))
        except KeyError:
            joined = b"".join(strings.get(i, b"") for i in values)
        return joined.decode("utf-8", errors="replace")


_loaded: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """The tokenizer, read once per Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    hold(_loaded[path].word_cache, _loaded[path].piece_cache)
    return _loaded[path]


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: ``(id, ids binary, n_tokens, decoded)``.

    ``ids`` holds little-endian unsigned 32-bit integers.
    """
    source = only(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(bpe.decode, ids), pa.string())],
                ["id", "ids", "n_tokens", "decoded"],
            )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids binary, n_tokens bigint, decoded string").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids binary, n_tokens)`` of every whole text."""
    source = only(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["id", "ids", "n_tokens"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids binary, n_tokens bigint").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, decoded)`` of every row of ids; null ids decode to the empty text."""
    source = only(encoded, id=id_col, ids=ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            texts = [bpe.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "decoded"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The digest columns of the round trip of ``documents``."""
    return round_trip(docs, vocabulary).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )

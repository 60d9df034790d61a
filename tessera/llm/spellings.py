"""Spelling variants by search schemes on bidirectional FM-indexes of the vocabulary.

Words and their numbers of uses are counted with DataFrame functions. The vocabulary
is then dealt out twice by range, by word and by reversed word, in shards of about
``shard_chars`` letters. A shard's words, each between delimiters, are indexed
in both directions: a Burrows-Wheeler transform of the text and of its reverse,
with rank tables, whose two intervals of suffix ranks move together. A pattern can so
grow at either end.

A word one edit from another shares its first or its second half with it. So each
word is searched twice. The first search matches delimiter and first half exactly, and
extends across the second half to the closing delimiter with one error; it runs in the
shards whose range holds words of that beginning. The second search matches the second half
and the delimiter exactly and extends to the left, in the shards of that ending. What
both find counts once, in the first. The rank of a matched suffix is the number of the
word. A task returns a count and the best word for each query, never pairs.

Memory: a shard's indexes take about ``8 * letters * alphabet`` bytes; queries stream past
them, and a shard with many queries is dealt again in blocks of ``block_queries``.
The first and last word of each shard reach the driver, and the shards' numbers of queries.

Defined results: words are maximal runs of ASCII letters and U+00C0 to U+00FF, whole
texts are read, only A-Z is lower-cased; null texts have none; a null id counts as empty text in
the checksum; each row counts, repeated ones too; of near words with equal counts the smallest in
code-point order is the form; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialized, only

LETTER = r"[A-Za-zÀ-ÿ]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Cells of a padded matrix of queries.
CELLS = 1 << 19


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: the words of at least ``least_length`` letters and ``least_count`` uses.

    In one of ``every`` pairs of document and word, by checksum, the word loses a letter.
    """
    # shorter runs can't become long enough, so they aren't cut out
    runs = only(docs, id=id_col, text=text_col).select("id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTER}{{{least_length},}}"), F.lit(0))).alias("run"))
    low, own = F.lower("run"), F.col("run")
    # lower is fast and right unless it would change a letter beyond A-Z
    word = F.when((F.octet_length("run") == F.char_length("run")) | (low == own), low).otherwise(F.translate("run", UPPER, UPPER.lower()))
    runs = runs.select("id", word.alias("w"))
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "w").cast("binary"))
    at = (h % F.char_length("w")).cast("int")
    cut = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.char_length("w")))
    words = runs.select(F.when(h % every == 0, cut).otherwise(F.col("w")).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """The order of the suffixes, by doubling."""
    rank, step = codes.astype(np.int64), 1
    while True:
        nxt = np.zeros(len(rank), np.int64)
        nxt[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        new = np.zeros(len(key), np.int64)
        new[1:] = np.cumsum(np.diff(key[order]) != 0)
        rank = np.empty(len(key), np.int64)
        rank[order] = new
        if new[-1] == len(key) - 1:
            return order
        step *= 2


class Side:
    """One direction: how often each symbol, and each smaller one, comes before a rank in the transform."""

    def __init__(self, codes: np.ndarray, size: int):
        before = codes[suffix_array(codes) - 1]
        self.below = np.zeros((len(codes) + 1, size + 1), np.int32)
        self.below[np.arange(1, len(codes) + 1), before + 1] = 1
        np.cumsum(self.below, axis=0, out=self.below)
        np.cumsum(self.below, axis=1, out=self.below)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=size))))


class Index:
    """A bidirectional FM-index over sorted distinct words of one-byte letters, each between delimiters (symbol 0)."""

    def __init__(self, words: list[bytes]):
        text = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        symbols = np.unique(text)
        self.size = len(symbols)
        #: of each byte its symbol; ``size`` where the words don't have it
        self.symbol = np.full(256, self.size, np.int64)
        self.symbol[symbols] = np.arange(self.size)
        codes = self.symbol[text]
        #: intervals grow to the left on ``sides[0]``, to the right on ``sides[1]``
        self.sides = (Side(codes, self.size), Side(codes[::-1], self.size))

    def grown(self, side: int, at: tuple[np.ndarray, np.ndarray], n: np.ndarray, c: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """Patterns with the ranks ``at`` (forward, reverse) and ``n`` places, longer by symbols ``c``; last: which are left."""
        c = np.minimum(c, self.size)
        known = c < self.size
        below, c = self.sides[side].below, np.where(known, c, 0)
        lo, hi = at[side], at[side] + n
        start, smaller = below[lo, c], below[hi, c] - below[lo, c]
        before = below[lo, c + 1] - start
        m = np.where(known, below[hi, c + 1] - below[lo, c + 1] - smaller, 0)
        own, other = self.sides[side].first[c] + before, at[1 - side] + smaller
        left = np.flatnonzero(m)
        moved = (own[left], other[left])
        return moved if side == 0 else moved[::-1], m[left], left

    def children(self, side: int, at: tuple[np.ndarray, np.ndarray], n: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """All longer patterns but those by a delimiter; last: of which pattern, and by which symbol."""
        below = self.sides[side].below
        lo = below[at[side]]
        smaller = below[at[side] + n] - lo
        m = np.diff(smaller, axis=1)
        m[:, 0] = 0
        of, c = np.nonzero(m)
        own = self.sides[side].first[c] + lo[of, c + 1] - lo[of, c]
        other = at[1 - side][of] + smaller[of, c]
        return (own, other) if side == 0 else (other, own), m[of, c].astype(np.int64), of, c

    def search(self, side: int, exact: np.ndarray, exact_lens: np.ndarray, rest: np.ndarray, rest_lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, word)``: words that have a query's exact half and are one edit off in the other.

        ``exact`` holds bytes in order of growth away from the other half; both it and
        ``rest``, which grows to ``side``, are closed by a delimiter within their lengths.
        """
        q = np.arange(len(exact))
        total = len(self.sides[0].below) - 1
        at, n = (np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)), np.full(len(q), total)
        for i in range(exact.shape[1]):
            goes = i < exact_lens[q]
            done = ~goes
            moved, m, left = self.grown(1 - side, (at[0][goes], at[1][goes]), n[goes], self.symbol[exact[q[goes], i]])
            at = tuple(np.concatenate((x[done], y)) for x, y in zip(at, moved, strict=True))
            n, q = np.concatenate((n[done], m)), np.concatenate((q[done], q[goes][left]))
        codes = self.symbol[rest]
        none = np.zeros(0, np.int64)
        # patterns without and with an error, each at place i of the rest
        e, en, eq = (none, none), none, none
        found_q, found_w = [none], [none]
        for i in range(rest.shape[1]):
            goes = i < rest_lens[q]
            at, n, q = (at[0][goes], at[1][goes]), n[goes], q[goes]
            if not len(q) and not len(eq):
                break
            c = codes[q, i]
            child, cn, of, by = self.children(side, at, n)
            other = by != c[of]
            child, cn, of = (child[0][other], child[1][other]), cn[other], of[other]
            # a letter more: one equal to the next is taken as coming after it
            e, en, eq = tuple(np.concatenate((x, y)) for x, y in zip(e, child, strict=True)), np.concatenate((en, cn)), np.concatenate((eq, q[of]))
            e, en, left = self.grown(side, e, en, codes[eq, i])
            eq = eq[left]
            ended = i == rest_lens[eq] - 1
            found_q.append(eq[ended])
            found_w.append(e[0][ended] - 1)
            e, en, eq = (e[0][~ended], e[1][~ended]), en[~ended], eq[~ended]
            # another letter; a letter less, the last of a run
            inner = i < rest_lens[q] - 1
            changed = inner[of]
            less = inner & (rest[q, np.minimum(i + 1, rest.shape[1] - 1)] != rest[q, i])
            e = tuple(np.concatenate((x, y[changed], z[less])) for x, y, z in zip(e, child, at, strict=True))
            en, eq = np.concatenate((en, cn[changed], n[less])), np.concatenate((eq, q[of][changed], q[less]))
            at, n, left = self.grown(side, at, n, c)
            q = q[left]
        return np.concatenate(found_q), np.concatenate(found_w)


def _padded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(p) + 1 for p in parts])
    width = int(lens.max())
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width), lens


def near_words(indexes: list[tuple[Index, int]], words: list[bytes], queries: list[bytes], search: int) -> tuple[np.ndarray, np.ndarray]:
    """``(query, word)`` numbers of the near words by one of the two searches; indexes come with the number of their first word."""
    got_q, got_w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    order = sorted(range(len(queries)), key=lambda k: len(queries[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(queries[order[end]]) <= CELLS:
            end += 1
        part = [queries[k] for k in order[at:end]]
        first, second = [u[: len(u) // 2] for u in part], [u[len(u) // 2 :] for u in part]
        numbers = np.array(order[at:end])
        for index, base in indexes:
            if search == 1:
                q, w = index.search(1, *_padded([x[::-1] for x in first]), *_padded(second))
            else:
                q, w = index.search(0, *_padded(second), *_padded([x[::-1] for x in first]))
                # the first search has those that also begin like the query
                new = np.fromiter((not words[b + base].startswith(first[a]) for a, b in zip(q.tolist(), w.tolist(), strict=True)), bool, len(q))
                q, w = q[new], w[new]
            got_q.append(numbers[q])
            got_w.append(w + base)
        at = end
    return np.concatenate(got_q), np.concatenate(got_w)


def _indexed(words: list[bytes], most: int) -> list[tuple[Index, int]]:
    """Indexes of at most ``most`` letters each, but for longer words."""
    out, at = [], 0
    while at < len(words):
        end, held = at + 1, len(words[at])
        while end < len(words) and held + len(words[end]) <= most:
            held += len(words[end])
            end += 1
        out.append((Index(words[at:end]), at))
        at = end
    return out


def _searched(shard_chars: int):
    """``(word, n_near, form, form_n)`` of the queries, from rows ordered by (search, shard, block, is_query, word)."""

    def best(words: list[bytes], counts: list[int], indexes, search: int, asked: list[bytes]) -> pa.RecordBatch:
        q, w = near_words(indexes, words, asked, search)
        n = np.array(counts, np.int64)[w] if len(w) else np.zeros(0, np.int64)
        by = np.lexsort((w, -n, q))
        q, w, n = q[by], w[by], n[by]
        pos = np.flatnonzero(np.diff(q, prepend=-1))
        found = np.diff(np.append(pos, len(q)))
        texts = lambda part: [x.decode("latin-1") for x in part]
        return pa.RecordBatch.from_arrays(
            [pa.array(texts([asked[k] for k in q[pos]]), pa.string()), pa.array(found, pa.int64()), pa.array(texts([words[k] for k in w[pos]]), pa.string()), pa.array(n[pos], pa.int64())],
            ["word", "n_near", "form", "form_n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, counts, indexes = None, [], [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("search", "shard", "block", "is_query")], 1)
            texts = [x.encode("latin-1") for x in batch.column("word").to_pylist()]
            numbers = batch.column("n").to_pylist()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(texts)] if texts else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                here = tuple(keys[a, :3])
                if here != key:
                    key, words, counts, indexes = here, [], [], None
                if not keys[a, 3]:
                    words += texts[a:b]
                    counts += numbers[a:b]
                    continue
                if indexes is None:
                    indexes = _indexed(words, 2 * shard_chars)
                yield best(words, counts, indexes, int(key[0]), texts[a:b])

    return run


def _dealt(words: DataFrame, search: int, shards: int, block_queries: int) -> tuple[DataFrame, int]:
    """The rows of one search, each shard's words and its queries, and into how many groups they are dealt."""
    ordered = words.withColumn("by", F.col("word") if search == 1 else F.reverse("word")).repartitionByRange(shards, "by")
    held = materialized(ordered.withColumn("shard", F.spark_partition_id()), "shards")
    bounds = held.groupBy("shard").agg(F.min("by").alias("lo"), F.max("by").alias("hi")).orderBy("shard").collect()
    number, lows, highs = [r.shard for r in bounds], [r.lo for r in bounds], [r.hi for r in bounds]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, to = [], []
            for r, by in enumerate(batch.column("by").to_pylist()):
                half = by[: len(by) // 2 if search == 1 else len(by) - len(by) // 2]
                for k in range(bisect_left(highs, half), bisect_right(lows, half + "\U0010ffff")):
                    rows.append(r)
                    to.append(number[k])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), batch.column("word").take(at), batch.column("n").take(at)], ["shard", "word", "n"])

    asked = materialized(held.select("by", "word", "n").mapInArrow(ask, "shard int, word string, n bigint"), "queries")
    blocks = {r["shard"]: -(-r["c"] // block_queries) for r in asked.groupBy("shard").agg(F.count(F.lit(1)).alias("c")).collect()}
    if not blocks:
        return held.limit(0).selectExpr("1 as search", "shard", "0 as block", "1 as is_query", "word", "n"), 1
    many = F.element_at(F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]), F.col("shard"))
    columns = [F.lit(search).alias("search"), "shard", F.col("block").cast("int").alias("block")]
    index = held.select("shard", "word", "n", F.explode(F.sequence(F.lit(0), many - 1)).alias("block")).select(*columns, F.lit(0).alias("is_query"), "word", "n")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("word"), many)).select(*columns, F.lit(1).alias("is_query"), "word", "n")
    return index.union(asked), sum(blocks.values())


def variants(words: DataFrame, ratio: int = 5, shard_chars: int = 1 << 17, block_queries: int = 20_000) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every row of ``(word, n)``; words are distinct and of one-byte letters."""
    words = materialized(words.select("word", "n"), "vocabulary")
    size = words.agg(F.sum(F.char_length("word") + 1).alias("chars"), F.max("n").alias("most"), F.min("n").alias("least")).first()
    shards = max(1, -(-(size["chars"] or 0) // shard_chars))
    (one, groups), (two, more) = (_dealt(words, k, shards, block_queries) for k in (1, 2))
    dealt = one.union(two).repartition(groups + more, "search", "shard", "block").sortWithinPartitions("search", "shard", "block", "is_query", "word")
    found = materialized(dealt.mapInArrow(_searched(shard_chars), "word string, n_near bigint, form string, form_n bigint"), "found")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form"))).alias("best"))
    enough = -F.col("best.n") >= ratio * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"))
    out = materialized(out, "forms")
    links = out.where("form is not null").select("word", F.col("form").alias("root"))
    # each form has `ratio` times the uses, so no path is longer than this; a round doubles what is followed
    longest = ceil(log(max(1, (size["most"] or 1) / (size["least"] or 1)), ratio)) + 1 if ratio > 1 else 64
    for _ in range(ceil(log2(longest)) if longest > 1 else 0):
        nxt = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialized(links.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return out.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digests(docs: DataFrame) -> DataFrame:
    return variants(vocabulary(docs))


ORACLE_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS tb FROM (SELECT i, list_reduce([CAST(i AS BIGINT)] || range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) AS r(i))),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT w, k, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + unicode(c) // 64 AS BIGINT), CAST(128 + unicode(c) % 64 AS BIGINT)] END)) AS bs FROM runs),
h AS (SELECT w, k, xor(list_reduce([CAST(4294967295 AS BIGINT)] || bs, lambda a, b: xor(a // 256, tb[xor(a % 256, b) + 1])), 4294967295) AS h FROM bytes, tab),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
del AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM del a JOIN del b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT del.word, words.word FROM del JOIN words ON del.rest = words.word
  UNION SELECT words.word, del.word FROM del JOIN words ON del.rest = words.word),
best AS (SELECT near.word, count(*) AS n_near, min(struct_pack(m := -o.n, other := near.other)) AS b FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
forms AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * n THEN b.other END AS form, CASE WHEN -b.m >= 5 * n THEN -b.m END AS form_n FROM words LEFT JOIN best USING (word)),
path AS (SELECT word, word AS last, 0 AS step FROM forms UNION ALL SELECT path.word, forms.form, step + 1 FROM path JOIN forms ON forms.word = path.last WHERE forms.form IS NOT NULL),
roots AS (SELECT word, max_by(last, step) AS root FROM path GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

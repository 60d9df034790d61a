"""Spelling variants against plain edit distances, counts against plain loops."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import spellings as s


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts, ratio=5):
    forms, near_words = {}, {}
    for w in counts:
        near_words[w] = [v for v in counts if near(w, v)]
        best = min(near_words[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n, len(near_words[w]), counts.get(forms[w])))
    return out


def plain_words(docs, least_length, least_count):
    found = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += len(w) >= least_length
    return {w: n for w, n in found.items() if n >= least_count}


def some_words(r, n):
    """Words over few letters, so that many are near; with runs, hot beginnings and endings, long ones."""
    out = {"".join(r.choice("abé") for _ in range(r.randint(6, 8))) for _ in range(n)}
    out |= {"aaaaaa" + "".join(r.choice("abcÿ") for _ in range(r.randint(0, 5))) for _ in range(n // 3)}
    out |= {"".join(r.choice("abÉ") for _ in range(r.randint(0, 5))) + "bbbbbb" for _ in range(n // 3)}
    long = "ab" * 700
    return sorted(out | {long, long + "a", long[1:], long[:600] + "é" + long[600:], "z" * 90, "z" * 91})


def test_suffix_array():
    r = random.Random(1)
    for _ in range(50):
        codes = np.array([r.randint(0, 2) for _ in range(r.randint(1, 60))])
        assert s.suffix_array(codes).tolist() == sorted(range(len(codes)), key=lambda k: codes[k:].tolist())


def test_searches_find_each_near_word_once():
    r = random.Random(2)
    for _ in range(25):
        words = [w.encode("latin-1") for w in some_words(r, 60)]
        asked = [*words, *(w.encode("latin-1") for w in some_words(r, 30)), b"qqqqqq", "aaaaaaþ".encode("latin-1")]
        indexes = s._indexed(words, r.choice([50, 10**6]))
        got = Counter()
        for search in (1, 2):
            q, w = s.near_words(indexes, words, asked, search)
            got.update(zip(q.tolist(), w.tolist(), strict=True))
        assert got == Counter((q, w) for q, a in enumerate(asked) for w, b in enumerate(words) if near(a, b))


@pytest.mark.parametrize(("shard_chars", "block_queries"), [(200, 30), (1 << 17, 20_000)])
def test_variants_equal_plain(spark, shard_chars, block_queries):
    r = random.Random(4)
    counts = {w: 5 * r.choice([1, 1, 5, 6, 26, 150, 700]) for w in some_words(r, 200)}
    frame = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n bigint, shard int")
    got = s.variants(frame, shard_chars=shard_chars, block_queries=block_queries).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == plain_variants(counts)


def test_vocabulary_equals_plain(spark, make, awkward):
    r = random.Random(6)
    words = ["École", "Überzeugung", "ÉCOLES", "naïvement", "abcdef", "Abcdef", "short", "×÷×÷×÷", "x" * 300, "longerword"]
    docs = [*awkward, *((k, " ".join(r.choice(words) + r.choice(["", "-", "7", "Ā"]) for _ in range(60))) for k in range(200, 300))]
    for length, count in ((6, 5), (3, 1)):
        got = s.vocabulary(make(docs), length, count).collect()
        assert {r.word: r.n for r in got} == plain_words(docs, length, count) and len(got) == len({r.word for r in got})


def test_whole_operator_and_empty(spark, make, awkward):
    docs = [*awkward, *((k, "Straße Strasse Strassen Strasßen " * (k % 7)) for k in range(500, 600))]
    got = s.digests(make(docs))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and {tuple(r) for r in got.collect()} == plain_variants(plain_words(docs, 6, 5))
    assert s.digests(make([])).count() == 0 == s.digests(make([(1, None), (2, "a b")])).count()

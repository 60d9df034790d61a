"""Benchmark phrases in documents against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from tessera.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(items, width):
    for item, text in items:
        ws = words(text)
        for s in range(max(1, len(ws) - width + 1) if ws else 0):
            yield item, ws[s : s + width]


def plain(docs, items, width):
    out = Counter()
    for i, text in docs:
        ws, hit, names = words(text), set(), set()
        for item, w in windows(items, width):
            for p in range(len(ws) - len(w) + 1):
                if ws[p : p + len(w)] == w:
                    hit |= set(range(p, p + len(w)))
                    names |= {str(item)} if item is not None else set()
        out[(i, len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))] += 1
    return out


@pytest.fixture(scope="module")
def cases(spark, make):
    r = random.Random(7)
    alphabet = ["a", "b", "É", "é", "Ab", "c3", "x"]
    text = lambda n: "".join(r.choice(alphabet) + r.choice([" ", ", ", "\n", "--", " "]) for _ in range(n))
    long = text(40)
    items = [(9, long), (1, text(5)), (10, text(4)), (2, text(3)), (2, text(2)), (3, "x"), (4, ""), (5, None), (None, text(2)), (7, " ".join("a" for _ in range(9))), (8, "c3 É"), (1, "unseen words only here")]
    docs = [(k, text(r.randint(0, 30))) for k in range(60)]
    docs += [(None, text(20)), (None, None), (100, ""), (101, items[1][1].upper()), (105, " ".join(words(long)[7:30])), (102, "a " * 400), (103, f"{text(300)} {items[1][1]} {text(300)}"), docs[5], docs[5], (5, text(9)), (104, "x")]
    frame = spark.createDataFrame([(i, t, 1, "n", 2) for i, t in items], "item_id bigint, text string, b int, term string, n int")
    return docs, items, make(docs), frame


@pytest.mark.parametrize(("width", "gram", "rare"), [(4, 2, 2), (3, 1, 1), (4, 3, 2), (10, 2, 2)])
def test_equals_plain(cases, width, gram, rare):
    docs, items, frame, wanted = cases
    rows = d.contaminated(frame, wanted, width, gram, rare).collect()
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in rows)
    assert got == plain(docs, items, width)


def test_digests(cases):
    docs, items, frame, wanted = cases
    assert Counter(map(tuple, d.digests(frame, wanted).collect())) == plain(docs, items, 10)


def test_phrases_are_maximal_runs(cases):
    docs, items, frame, wanted = cases
    got = {tuple(r) for r in d.phrase_matches(frame, wanted, 4).collect()}
    want = set()
    for i, text in docs:
        ws = words(text)
        for item, t in items:
            own = words(t)
            for delta in range(-len(own), len(ws)):
                same = [p for p in range(len(own)) if 0 <= p + delta < len(ws) and own[p] == ws[p + delta]]
                for p in same:
                    if p - 1 not in same:
                        n = next(k for k in range(len(own) + 1) if p + k not in same)
                        if n >= min(4, len(own)):
                            want.add((i, item, p + delta, p, n))
    assert got == want


@pytest.mark.parametrize("span", [3, 6])
def test_proximity(cases, span):
    docs, items, frame, wanted = cases
    got = {tuple(r) for r in d.proximity_matches(frame, wanted, span).collect()}
    want = set()
    for i, text in docs:
        ws = words(text)
        for item, t in items:
            own = set(words(t))
            if own and len(own) <= span:
                want |= {(i, item, p) for p in range(len(ws)) if ws[p] in own and own <= set(ws[p : p + span])}
    assert got == want


def test_empty_tables(spark, cases):
    docs, _, frame, wanted = cases
    assert d.digests(frame.limit(0), wanted).count() == 0
    rows = d.digests(frame, wanted.limit(0)).collect()
    assert len(rows) == len(docs) and not any(r.contaminated or r.n_items for r in rows)

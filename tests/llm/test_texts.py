"""Packing, SimHash, substrings, exact duplicates and BPE against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tessera.llm import bpe, exact, packing, simhash, substrings

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_merges_equal_the_library(tokenizer):
    own, r = bpe.loaded(VOCABULARY), random.Random(3)
    alphabet = ["a", "B", "é", "1", "²", "中", " ", "  ", "\n", "\t", "\x85", "\xa0", "\u2028", "\x1c", "'s", "'S", "!", "🙂", "<|endoftext|>", "<|endof", " the"]
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 12)))
        want = ids_of(tokenizer, text)
        assert own.encode(text) == raw(want), text
        assert own.decode(raw(want)) == tokenizer.decode(want, skip_special_tokens=False)
    assert own.encode("ab" * 50_000) == raw(ids_of(tokenizer, "ab" * 50_000))
    assert own.decode(raw([99_999, 64])) == own.decode(raw([64]))


def test_packing_tokens_equal_the_library(tokenizer, awkward):
    own = packing.Tokens(VOCABULARY)
    for _, t in awkward:
        assert np.frombuffer(own(t), "<u2").tolist() == ids_of(tokenizer, t)


def test_round_trip(spark, make, awkward, tokenizer):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(make(awkward), VOCABULARY).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == Counter((i, len(x := ids_of(tokenizer, t)), sha(raw(x)), sha((t or "").encode())) for i, t in awkward)
    encoded = bpe.encode(make(awkward), VOCABULARY)
    assert Counter(r.decoded for r in bpe.decode(encoded, VOCABULARY).collect()) == Counter(t or "" for _, t in awkward)


def test_cache_turns_over():
    seen = []
    cache = bpe.Cache(lambda w: seen.append(w) or w)
    for k in range(bpe.CACHE_ENTRIES + 5):
        cache[str(k)]
    assert len(cache) <= bpe.CACHE_ENTRIES and cache["0"] == "0" and len(seen) == bpe.CACHE_ENTRIES + 5


def test_first_fit_decreasing_equals_plain():
    r = random.Random(1)
    for _ in range(200):
        sizes, free, want = [r.randint(1, 50) for _ in range(r.randint(0, 40))], [], {}
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            b = next((b for b, f in enumerate(free) if f >= sizes[k]), len(free))
            if b == len(free):
                free.append(50)
            free[b] -= sizes[k]
            want[k] = b
        assert packing.first_fit_decreasing(sizes, 50) == [want[k] for k in range(len(sizes))]
        parts = packing.pack(sizes, 50)
        assert len({p[3] for p in parts}) == -(-sum(sizes) // 50)
        assert all(sum(p[2] for p in parts if p[0] == k) == n for k, n in enumerate(sizes))


def test_pieces_hold_each_id_once(spark, make, awkward, tokenizer):
    rows = packing.pack_documents(make(awkward), VOCABULARY, length=256, group_ids=5_000).collect()
    texts = Counter(raw([*ids_of(tokenizer, t), 1]) for _, t in awkward)
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    assert sum(len(r.ids) for r in rows) == sum(len(x) * n for x, n in texts.items())
    whole = Counter()
    for (_, total), parts in by_doc.items():
        copies = sum(p.length for p in parts) // total
        starts = sorted(parts, key=lambda p: p.start)
        if copies == 1:
            whole[b"".join(p.ids for p in starts)] += 1
    assert all(texts[x] for x in whole) and sum(whole.values()) >= len(awkward) - 6


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(points, near):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in points:
        for b in points:
            if a < b and near(a, b):
                root[find(b)] = find(a)
    return {p: find(p) for p in points}


def test_simhash_components(spark, make, awkward):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.digests(make(awkward)).collect())
    fps = [plain_fingerprint(t) for _, t in awkward]
    root = components(set(fps), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), f in zip(awkward, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert got == Counter((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(awkward, fps, strict=True))


@pytest.mark.parametrize("limit", [2, 1000])
def test_links_of_dense_groups(spark, limit):
    """Chains and clouds around a few points: the balls of long lists give the components of all pairs."""
    r = random.Random(9)
    points = set()
    for _ in range(4):
        base = r.getrandbits(64)
        points.add(base)
        for _ in range(25):
            points.add(base := base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in points]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), pair_limit=limit)
    found = {p: p for p in points}
    from tessera.llm.components import connected_components

    for row in connected_components(edges).collect():
        found[row.v % (1 << 64)] = row.component
    want = components(points, lambda a, b: (a ^ b).bit_count() <= 4)
    sets = lambda m: {frozenset(p for p in m if m[p] == c) for c in set(m.values())}
    assert sets(found) == sets(want)


def plain_removal(rows, width=50):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (t or "").encode().split()
        for p in range(len(words) - width + 1):
            first.setdefault(tuple(words[p : p + width]), i)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = set()
        for p in range(len(words) - width + 1):
            if i is not None and first[tuple(words[p : p + width])] < i:
                gone |= set(range(p, p + width))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_substrings(spark, make, awkward):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(make(awkward)).collect())
    assert got == plain_removal(awkward)
    assert sum(r[2] for r in got) > 6000


def test_substrings_in_blocks(spark, make, awkward, monkeypatch):
    made = substrings.Windows()
    words = (awkward[11][1]).encode().split()
    whole = [np.concatenate(x) for x in zip(*((a, b) for _, a, b in made.of(words, 50)), strict=True)]
    monkeypatch.setattr(substrings, "BLOCK", 512)
    small = substrings.Windows()
    parts = [np.concatenate(x) for x in zip(*((a, b) for _, a, b in small.of(words, 50)), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True)) and len(parts[0]) == len(words) - 49


def test_spans_and_carried_rows(spark, make, awkward):
    for r in substrings.remove_repeats(make(awkward), carry=True).collect():
        words = (r.row.text or "").split(" ") if r.n_removed else []
        assert r.row.doc_id == r.doc_id and sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False)) and (not words or r.n_words == len((r.row.text or "").encode().split()))


def norm(t):
    import re

    return re.sub(r"[ \t\n\x0b\x0c\r]+", " ", t or "")


def test_exact(spark, make, awkward):
    rows = exact.exact_duplicates(make(awkward)).collect()
    groups = {}
    for i, t in awkward:
        groups.setdefault(norm(t), []).append(i)
    want = Counter()
    for i, t in awkward:
        g = groups[norm(t)]
        want[i, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups) and all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_exact_in_many_batches(spark, make, awkward):
    docs = make(awkward).repartition(5)
    one, many = (Counter((r.doc_id, r.keep_id, r.group_size) for r in exact.exact_duplicates(docs, files_per_batch=n).collect()) for n in (None, 1))
    assert one == many


def test_colliding_digests_are_regrouped(spark, make, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact.F, "sha2", lambda c, n: F.substring(F.hex(c), 1, 1))
    rows = exact.exact_duplicates(make([(1, "aa"), (2, "ab"), (3, "ab"), (4, "zz"), (5, "aa")])).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows} == {1: (1, 2, True), 2: (2, 2, True), 3: (2, 2, False), 4: (4, 1, True), 5: (1, 2, False)}


@pytest.mark.parametrize("op", [lambda d: bpe.digests(d, VOCABULARY), lambda d: packing.digests(d, VOCABULARY), simhash.digests, substrings.digests, exact.exact_duplicates])
def test_empty_table(spark, make, op):
    assert op(make([])).collect() == []

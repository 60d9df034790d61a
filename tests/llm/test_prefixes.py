"""The prefix trie against plain dictionaries, over few and many shards."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import prefixes


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            m = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, m, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    words = lambda p: len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0

    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words(p) + sum(saved[q] for q in children[p])
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    )


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, conv int, seq string, shard int")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    texts = ["a b", "c", "", "d e f", None, " ", "a b c"]
    out = []
    for c in [*range(0, 130), 400, 401, 419]:
        if r.random() < 0.9:
            out += [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(texts)) for t in range(r.choice([1, 1, 2, 3, 6]))]
    out += [(c, t, "user", "same line") for c in range(200, 260) for t in range(45)]  # copies deeper than a block
    out += [(c, t, "user", f"same line{c % 3 if t == 37 else ''}") for c in range(300, 320) for t in range(40)]
    out += [(5000, t, "user", f"{t}") for t in range(300)]
    out += [(None, 1, "user", "nobody"), (7, 1, "user", "tie"), (7, 1, "user", "also"), (7, 1, "user", "also"), (500, 0, "user", "only"), (501, 0, "x", "one")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("shard_turns", [40, 700, 10**6])
def test_equals_plain(spark, rows, shard_turns):
    found = prefixes.trie(prefixes.rebuilt(prefixes.sequences(frame(spark, rows))), shard_turns)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, found.select(columns).collect())) == plain(rows)


def test_order_and_shared_codes():
    r = random.Random(11)
    for _ in range(60):
        seqs = [[r.randint(1, 2)] * r.choice([0, 1, 15, 16, 17, 33]) + [r.randint(1, 3) for _ in range(r.randint(0, 3))] for _ in range(r.randint(1, 25))]
        conv = np.array(r.sample(range(100), len(seqs)))
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in seqs])))
        order, shared = prefixes.ordered(np.array([x for s in seqs for x in s], np.int64), offsets, conv)
        assert order.tolist() == sorted(range(len(seqs)), key=lambda i: (seqs[i], conv[i]))
        for a, b, n in zip(order, order[1:], shared[1:], strict=False):
            want = next((k for k, (x, y) in enumerate(zip(seqs[a], seqs[b], strict=False)) if x != y), min(len(seqs[a]), len(seqs[b])))
            assert n == want


def test_empty(spark):
    assert prefixes.digests(frame(spark, [])).count() == 0 == prefixes.digests(frame(spark, [(None, 1, "user", "x")])).count()

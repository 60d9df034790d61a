"""The pipeline against a plain version of its stages on one small table."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
from test_shingles import plain_set, similar
from test_texts import VOCABULARY, components, ids_of, norm, raw
from tokenizers import Tokenizer

from tessera.llm import packing, quality


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    keep = {r.doc_id for r in quality.classify(docs, labels).where("keep").collect()}
    first = P.drop_poor(spark, docs, sf)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == keep

    second = P.drop_copies(spark, first, sf)
    least = {}
    for i in sorted(keep):
        least.setdefault(norm(rows[i]), i)
    assert second.columns == docs.columns and sorted(r.doc_id for r in second.collect()) == sorted(least.values())

    third = P.drop_near_copies(spark, second, sf)
    sets = {i: plain_set(rows[i]) for i in least.values()}
    root = components(sets, lambda i, j: similar(sets[i], sets[j]))
    stay = {}
    for i in sorted(sets):
        stay.setdefault(root[i], i)
    assert third.columns == docs.columns and sorted(r.doc_id for r in third.collect()) == sorted(stay.values())

    fourth = P.drop_repeats(spark, third, sf)
    seen, want = {}, {}
    for i in sorted(stay.values()):
        words = rows[i].encode().split()
        windows = [tuple(words[p : p + 50]) for p in range(len(words) - 49)]
        gone = {q for p, w in enumerate(windows) if seen.setdefault(w, i) < i for q in range(p, p + 50)}
        if not gone or len(gone) < len(words):
            want[i] = b" ".join(w for k, w in enumerate(words) if k not in gone).decode() if gone else rows[i]
    got = {r.doc_id: (r.text, r.n_chars) for r in fourth.collect()}
    assert fourth.columns == docs.columns and got == {i: (t, len(t)) for i, t in want.items()}

    tokenizer = Tokenizer.from_file(VOCABULARY)
    packed = P.pack(spark, fourth, sf).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in packed if r.start == 0) == Counter((i, len(ids_of(tokenizer, t)) + 1) for i, t in want.items())
    assert sum(r.length for r in packed) == sum(len(raw(ids_of(tokenizer, t))) // 4 + 1 for t in want.values())
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset)
    assert Counter(map(key, P.run(spark, sf).collect())) == Counter(map(key, packed))
    assert len(P.made()) >= 2 and packing.GROUP_IDS > 0


def test_repeated_and_null_rows(spark, make, awkward):
    docs = make(awkward)
    copies = P.drop_copies(spark, docs, "").collect()
    assert len(copies) == len({norm(t) for _, t in awkward})
    near = P.drop_near_copies(spark, docs, "")
    assert near.columns == docs.columns
    # one row of each group: rows without an id are copies like others
    sets = [plain_set(t) for _, t in awkward]
    root = components(range(len(sets)), lambda i, j: similar(sets[i], sets[j]))
    assert near.count() == len({root[k] for k in range(len(sets))})
    alone = [(None, "quite another text that nothing is like at all"), (None, "and one more such text with other words in it"), (1, "first text of some words here"), (None, "first text of some words here")]
    assert sorted(r.text for r in P.drop_near_copies(spark, make(alone), "").collect()) == sorted(t for _, t in alone[:3])
    assert P.drop_repeats(spark, docs, "").columns == docs.columns
    for stage in (P.drop_copies, P.drop_near_copies, P.drop_repeats, P.pack):
        assert stage(spark, make([]), "").count() == 0

"""Chunking, hashing, fusion and metrics on small values."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import chunking as C
from tessera.functions import text as X
from tessera.functions.hashing import AXES, embeddings
from tessera.operators import chunks, retrieval

words = st.lists(st.text("abcde.", min_size=1, max_size=8), min_size=1, max_size=400)


@settings(max_examples=60, deadline=None)
@given(words)
def test_chunks_lose_no_word(tokens):
    text = " ".join(tokens)
    found = C.chunk(text, overlap=0, most=200)
    assert " ".join(c.content for c in found).split() == text.split()
    assert all(C.words(c.content) <= 400 for c in found)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(0, 40))
def test_windows_cover_and_advance(sizes, overlap):
    units = [" ".join([f"w{k}"] * n) for k, n in enumerate(sizes)]
    found = C.windows(units, 50, overlap)
    assert set("\n\n".join(found).split("\n\n")) == set(units)
    assert all(len(w.split("\n\n")) == 1 or C.words(w) <= 50 for w in found)


def test_sections_and_kinds():
    text = "before\n# One\nalpha beta\n1.2 Two\n- first\n- second"
    assert [h for h, _ in C.sections(text)] == ["", "# One", "1.2 Two"]
    assert C.paragraphs("x\n- a\n- b") == ["x", "a", "b"]
    assert [c.content for c in C.chunk("GET /a list them all\nPOST /b make one", "api", overlap=0)] == ["GET /a list them all\n\nPOST /b make one"]
    assert C.chunk(None) == C.chunk("  ") == []
    assert C.table_blocks("a | b\nc | d\nplain") == ["a | b\nc | d", "plain"]


def test_compaction_budget_adaptive():
    assert C.compacted(["a b", "c d", "e f", "g h"], 2) == ["a b\n\nc d", "e f\n\ng h"]
    assert C.budgeted([5, 9, 3, 2], 10) == [0, 2, 3]
    assert C.adaptive(100, 400, 1200) == (400, 1200)
    assert C.adaptive(10_000_000, 400, 1200)[0] == 1800


def plain_embedding(text, length):
    """One token after the other."""
    uses = {}
    for t in re.findall(r"[\w\-/\.]+", text or ""):
        uses[t.lower()] = uses.get(t.lower(), 0) + 1
    out = [0.0] * length
    for t, n in uses.items():
        stands = [t] + [t[k : k + 3] for k in range(len(t) - 2)] + ([t[:5], t[-5:]] if len(t) > 4 else [])
        for k, part in enumerate(stands, 1):
            number = sum(ord(c) * 131 ** (len(part) - 1 - i) for i, c in enumerate(part))
            out[number % length] += (-1) ** sum(map(ord, part)) * (0.5 + 0.5 * n / max(uses.values())) / k
        for axis, words in enumerate(AXES):
            if axis < length:
                out[axis] += 0.75 * (t in words)
    norm = sum(x * x for x in out) ** 0.5
    return [x / norm if norm else 0.0 for x in out]


def test_hash_embedding():
    texts = ["", None, "!?", "api service api", "Die größte Änderung x/y-z v1.2 must", "ab abcd abcde обязан " * 9]
    for length in (4, 16, 64):
        got = embeddings(pd.Series(texts, index=range(5, 5 + len(texts))), length)
        assert np.allclose(got, [plain_embedding(t, length) for t in texts], atol=1e-12)
    assert embeddings(pd.Series([], dtype=object), 8).shape == (0, 8)


def test_fusion(spark):
    lists = [["a", "b", "c"], ["b", "a"], ["b"]]
    frames = [spark.createDataFrame([(1, d, r) for r, d in enumerate(x, 1)], "query_id int, doc_id string, rank int") for x in lists]
    got = [r.doc_id for r in retrieval.fuse(frames).orderBy("fusion", ascending=False).collect()]
    assert got == ["b", "a", "c"]


def test_evaluation(spark):
    predicted = spark.createDataFrame([(1, "x", 1), (1, "f2", 2), (1, "d3", 3)], "query_id int, doc_id string, rank int")
    targets = spark.createDataFrame([(1, "f2", 1.0), (1, "d3", 1.0), (2, "z", 1.0)], "query_id int, doc_id string, relevance double")
    rows = {r.query_id: r for r in retrieval.evaluate(predicted, targets).collect()}
    assert (rows[1].recall_10, rows[1].mrr_10) == (1.0, 0.5)
    assert (rows[2].recall_10, rows[2].ndcg_10, rows[2].hit_10) == (0.0, 0.0, 0.0)


def test_policies():
    assert retrieval.policy("verification").name == "verification" and retrieval.policy(None).name == "generation"


@pytest.mark.parametrize(
    ("said", "kind", "severity", "strength"),
    [("The endpoint must not fail", "api", "critical", "strong"), ("A queue should drain", "integration", "minor", "advisory"), ("Запрещено всё", "rule", "critical", "neutral"), ("nothing", "other", "info", "neutral")],
)
def test_rules_of_text(spark, said, kind, severity, strength):
    from pyspark.sql import functions as F

    t = F.col("t")
    row = spark.createDataFrame([(said,)], "t string").select(X.fragment_type(t), X.rule_severity(t), X.modal_strength(t)).first()
    assert tuple(row) == (kind, severity, strength)


def test_signatures(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("The API must not be open.",), ("the api MUST be open",)], "t string")
    assert df.select(X.conflict_signature(F.col("t"))).distinct().count() == 1
    assert df.select(X.canonical_signature(F.col("t"))).distinct().count() == 2


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=12))
def test_budget_fold_equals_scan(sizes):
    # the column fold is held against the plain one in test_budget_column
    taken = C.budgeted(sizes, 60)
    assert sum(sizes[k] for k in taken) <= 60


def test_budget_column(spark):
    from pyspark.sql import functions as F

    sizes = [[30, 40, 20, 10], [], [61, 60]]
    rows = spark.createDataFrame([(s,) for s in sizes], "s array<bigint>").select(chunks.within_budget(F.col("s"), 60)).collect()
    assert [[k for k, f in enumerate(r[0]) if f] for r in rows] == [C.budgeted(s, 60) for s in sizes]


def test_hash_embedding_memory_is_of_one_block():
    # every word is another one, as in tables of much junk
    texts = pd.Series([" ".join(f"w{i}x{k}" for k in range(200)) + " " + "long" * 40 for i in range(400)])
    alone = embeddings(texts[-3:], 16)
    tracemalloc.start()
    got = embeddings(texts, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20, peak
    assert np.array_equal(got[-3:], alone) and np.allclose(got[7], plain_embedding(texts[7], 16), atol=1e-12)


def test_nearest_in_tiles_equals_all_pairs(spark):
    g = np.random.default_rng(3)
    known = np.round(g.normal(size=(500, 4)), 1)
    known[100:200] = known[:100]  # ties
    known[7] = 0
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(known)], "vec_id bigint, embedding array<double>")
    asked = frame.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.nearest(frame, asked, 9, query_block=8, vector_block=150, tile=128).collect()}
    norms = np.linalg.norm(known, axis=1, keepdims=True)
    unit = np.divide(known, norms, out=np.zeros_like(known), where=norms > 0)
    want = {}
    for q in range(0, 500, 20):
        scores = np.round(np.maximum(0.0, unit @ unit[q]), 8)
        want |= {(q, n + 1): int(i) for n, i in enumerate(np.lexsort((np.arange(500), -scores))[:9])}
    assert got == want


def test_bm25_counts_after_dealing_and_in_bounded_tasks(spark, monkeypatch):
    texts = spark.createDataFrame([(i, "", f"red {'blue ' * (i % 4)} w{i % 7}") for i in range(60)], "doc_id bigint, title string, content string")
    asked = spark.createDataFrame([(1, "red blue w3"), (2, "blue blue w5 none"), (3, "")], "query_id bigint, query_text string")
    posted = retrieval.postings(texts, retrieval.query_terms(asked))
    assert "keys=[doc_id" not in posted._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_COL")[-1]
    want = sorted(map(tuple, retrieval.bm25(texts, asked).collect()))
    monkeypatch.setattr(retrieval, "MET", 16)
    scores = retrieval.bm25(texts, asked)
    assert sorted(map(tuple, scores.collect())) == want and len(want) > 100


def test_chunks_are_made_in_blocks_of_texts():
    import pyarrow as pa

    from tessera.operators import chunks as C

    texts = ["a" * 600, None, "", "b" * 600, "c" * 5000, "d" * 10, "e" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = [p.column("text").to_pylist() for p in C.blocks(batch, "text", 1000)]
    assert parts == [["a" * 600, None, ""], ["b" * 600], ["c" * 5000], ["d" * 10, "e" * 10]]
    assert not list(C.blocks(batch.slice(0, 0), "text"))


def test_postings_are_counted_in_tasks_of_so_many_characters(spark, monkeypatch):
    texts = spark.createDataFrame([(i, "red", f"red {'blue ' * (i % 4)} w{i % 7}") for i in range(90)], "doc_id bigint, title string, content string")
    asked = spark.createDataFrame([(1, "red blue w3"), (2, "blue w5 none")], "query_id bigint, query_text string")
    want = sorted(map(tuple, retrieval.bm25(texts, asked).collect()))
    chars, parts, written = sum(len(f"{r.title} {r.content}") for r in texts.collect()), [], retrieval.written
    monkeypatch.setattr(retrieval, "CHARS", 100)
    monkeypatch.setattr(retrieval, "written", lambda df: parts.append((df.columns, df.rdd.getNumPartitions())) or written(df))
    assert sorted(map(tuple, retrieval.bm25(texts, asked).collect())) == want
    assert [n for columns, n in parts if "tf" in columns] == [-(-chars // 100)]


def test_leading_rows_hold_all_that_ranks(spark, monkeypatch):
    g = np.random.default_rng(5)
    rows = [(None if k % 4 == 3 else k % 4, k, float(g.integers(0, 12)), float(g.integers(0, 3))) for k in range(800)]
    scores = spark.createDataFrame(rows, "query_id int, doc_id bigint, lexical double, overlap double").coalesce(2)
    monkeypatch.setattr(retrieval, "SCORES", 16)
    found = retrieval.leading(scores, {"lexical": 5, "overlap": 7})
    assert found.schema == scores.schema and found.count() <= 2 * 4 * (5 + 7)
    for column, limit in (("lexical", 5), ("overlap", 7)):
        assert sorted(map(str, retrieval.ranked(found, column, limit).collect())) == sorted(map(str, retrieval.ranked(scores, column, limit).collect()))
    assert retrieval.leading(scores.limit(0), {"lexical": 5}).count() == 0


def test_fused_keeps_no_table_of_all_scores(spark, monkeypatch):
    g = np.random.default_rng(7)
    text = lambda k: " ".join(f"w{x}" for x in g.zipf(1.4, 12) % 40) + f" u{k % 50}"
    texts = spark.createDataFrame([(i, f"t{i % 9}", text(i)) for i in range(300)], "doc_id bigint, title string, content string")
    asked = spark.createDataFrame([(i, text(i) + f" t{i}") for i in range(4)], "query_id bigint, query_text string")
    scores = {(r.query_id, r.doc_id): r for r in retrieval.bm25(texts, asked).collect()}
    embed, both = retrieval.hash_embedding(64), "concat_ws(' ', title, content)"
    vectors, asking = texts.selectExpr("doc_id", f"{both} AS t").select("doc_id", embed("t").alias("embedding")), asked.select("query_id", embed("query_text").alias("embedding"))
    lists = {(r.query_id, r.doc_id): [r["rank"]] for r in retrieval.nearest(vectors, asking, 36, "doc_id").collect()}
    for column in ("lexical", "overlap"):
        for q in range(4):
            best = sorted((-r[column], d) for (k, d), r in scores.items() if k == q)[:36]
            for n, (_, d) in enumerate(best, 1):
                lists.setdefault((q, d), []).append(n)
    want = {}
    for q in range(4):
        best = sorted((-round(sum(1 / (60 + n) for n in ranks), 10), d) for (k, d), ranks in lists.items() if k == q)[:24]
        want |= {(q, d): n for n, (_, d) in enumerate(best, 1)}
    sizes, written = [], retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df: sizes.append((df.columns, df.count())) or written(df))
    got = {(r.query_id, r.doc_id): r for r in retrieval.fused(texts, asked).collect()}
    assert {k: r["rank"] for k, r in got.items()} == want
    for k, r in got.items():
        known = scores.get(k)
        assert (r.lexical, r.overlap) == pytest.approx((known.lexical, known.overlap) if known else (0.0, 0.0), abs=1e-7)
    assert len(scores) > 1000 and max(n for columns, n in sizes if "lexical" in columns) <= 4 * 2 * 36

"""Folds of check results, and nested snapshots."""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from tessera import registry
from tessera.operators import relational as O
from tessera.plans import rulebook

WEIGHTS = {"info": 1, "minor": 2, "major": 4, "critical": 6, "other": 3}
SHARES = {"passed": Fraction(1), "warning": Fraction(55, 100), "failed": Fraction(0)}


def test_weighted_score_is_exact_at_ties(spark):
    kinds = [(s, t) for s in WEIGHTS for t in SHARES]
    every = [c for n in (1, 2, 3, 4) for c in combinations_with_replacement(kinds, n)]
    rows = [(k, s, t) for k, c in enumerate(every) for s, t in c]
    frame = spark.createDataFrame(rows, "protocol int, severity string, status string")
    got = {r.protocol: r.score for r in frame.groupBy("protocol").agg(O.weighted_score(F.col("severity"), F.col("status")).alias("score")).collect()}
    want = {k: float(round(100 * sum(WEIGHTS[s] * SHARES[t] for s, t in c) / sum(WEIGHTS[s] for s, _ in c))) for k, c in enumerate(every)}
    assert got == want


def test_source_snapshot_nests_all_documents_of_a_source(spark, tmp_path):
    spark.createDataFrame([(i, None if i % 3 == 0 else "a") for i in range(0, 5000, 7)], "doc_id bigint, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1), (14, 0), (21, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.source: r for r in registry.queries()["source_snapshot"](spark, str(tmp_path)).collect()}
    ids = {None: list(range(0, 5000, 21)), "a": [i for i in range(0, 5000, 7) if i % 3]}
    assert {k: r.doc_ids for k, r in got.items()} == ids
    assert {k: (r.documents, r.processed) for k, r in got.items()} == {None: (len(ids[None]), 1), "a": (len(ids["a"]), 2)}


def test_rulebook_is_one_small_plan(spark, sf):
    found = rulebook.facts(spark, sf)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the parts are made before, and meet without a join
    assert "Join" not in plan and len(plan) < 30_000
    assert found.count() == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()


def test_shared_tokens_grow_in_tasks(spark):
    rows = [(k, w) for k in range(40) for w in ("ab", "cd", "ef")[: 1 + k % 3]]
    brands = [(b, w) for b in "xyz" for w in ("ab", "ef", "gh")]
    left, right = spark.createDataFrame(rows, "k int, w string"), spark.createDataFrame(brands, "b string, w string")
    found = O.shared_tokens(left, right, "k", "b", "w", most=20)
    want = {(k, b): sum(w in ("ab", "ef") for j, w in rows if j == k) for k in range(40) for b in "xyz"}
    assert {(r.k, r.b): r.shared for r in found.collect()} == want
    # 159 rows meet: eight tasks, in which each key lies whole
    assert found.rdd.getNumPartitions() == 8

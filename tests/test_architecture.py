"""Layers, consistency, section order and task trace of small solutions, against plain versions."""

from __future__ import annotations

import pytest

from tessera.operators import architecture as A

COMPONENTS = "solution_id int, component_id string, name string, description string, layer string, external boolean"
INTEGRATIONS = "solution_id int, from_id string, to_id string, protocol string"
SECTIONS = "solution_id int, section string, text string, sort_order int"
ROWS = [
    (1, "a", "Claims desk", None, "b", False), (1, "c", "Portal", None, "t", False),
    (2, "a", "Claims", None, "b", False), (2, "c", "Portal", None, "t", None),
    (3, "a", "Claims ledger", None, "b", False), (3, "c", "Portal", "keeps the ledger", "t", False),
    (4, "a", "Claims", None, "b", False), (4, "a", "Claims", None, "b", False), (4, None, "", None, "b", None),
    (5, "c", "Portal", None, "t", True),
    (6, "a", "system", None, "b", False), (6, "c", "System", None, "t", False),
    (7, "a", "X", None, "b", False), (7, "c", "yz", None, "t", False),
]
JOINTS = [(2, "c", "a", "REST"), (2, "c", "a", "REST"), (4, "a", "gone", None), (5, None, "c", "file")]
TEXTS = [(1, "b", "Unlike.\nThe claims  desk uses the portal; Portal alone", 2), (6, "b", "Nothing here", 1), (6, "t", None, 2), (7, "t", "a x is used with yz", 1), (3, "t", "claims ledger. uses. portal", 1)]


@pytest.fixture(scope="module")
def solution(spark):
    return [spark.createDataFrame(rows, kinds) for rows, kinds in ((ROWS, COMPONENTS), (JOINTS, INTEGRATIONS), (TEXTS, SECTIONS))]


def test_layers(solution):
    got = {r.solution_id: (r.relation, r.edge, r.overlap, r.status) for r in A.layer_links(*solution, "b", "t", A.BUSINESS_TO_APPLICATION).collect()}
    assert got == {
        1: (True, False, False, "passed"),
        2: (False, True, False, "passed"),
        3: (False, False, True, "passed"),
        4: (False, False, False, "warning"),
        5: (False, False, False, "not_applicable"),
        6: (False, False, False, "warning"),
        7: (True, False, False, "passed"),
    }
    assert {r.solution_id: r.status for r in A.layer_links(*solution, "b", "t", ("uses",), missing="failed").collect()}[4] == "failed"


def test_consistency(spark, solution):
    says = spark.createDataFrame([(1, "Без API"), (2, "решение без интеграций, только пакетный обмен"), (5, "без внешних систем"), (6, None)], "solution_id int, text string")
    got = {r.solution_id: (r.duplicates, r.dangling, r.contradictions, r.status) for r in A.consistency(*solution, says).collect()}
    assert got == {1: (0, 0, 0, "passed"), 2: (0, 0, 2, "failed"), 3: (0, 0, 0, "passed"), 4: (1, 1, 0, "failed"), 5: (0, 1, 1, "failed"), 6: (0, 0, 0, "passed"), 7: (0, 0, 0, "passed")}


def test_claims_in_sections_count_without_statements(spark, solution):
    text = spark.createDataFrame([(2, "b", "API не требуется", 1), (3, "b", "без api", 1), (3, "t", "the API", 2)], SECTIONS)
    none = spark.createDataFrame([], "solution_id int, text string")
    got = {r.solution_id: r.contradictions for r in A.consistency(solution[0], solution[1], text, none).collect()}
    assert got[2] == 1 and got[3] == 1 and got[1] == 0


def test_components_without_ids_and_solutions_without_components(spark):
    components = spark.createDataFrame([(1, None, "a", "d", "b", False), (1, None, "c", "d", "t", False), (2, "x", "a", "d", "b", False)], COMPONENTS)
    integrations = spark.createDataFrame([(1, "p", "q", "http"), (2, "x", "q", "http"), (3, "p", "q", "http")], INTEGRATIONS)
    sections = spark.createDataFrame([(4, "b", "без интеграций", 1), (3, "b", "без интеграций", 1)], SECTIONS)
    none = spark.createDataFrame([], "solution_id int, text string")
    got = {r.solution_id: tuple(r)[1:] for r in A.consistency(components, integrations, sections, none).collect()}
    assert got == {1: (0, 0, 0, "passed"), 2: (0, 1, 0, "failed"), 3: (0, 0, 1, "failed"), 4: (0, 0, 0, "passed")}


def test_a_shared_technology_links_layers(spark):
    components = spark.createDataFrame([(1, "a", "one", "d", "b", False, "Kafka, Redis"), (1, "b", "two", "e", "t", False, "redis 7"), (2, "a", "one", "d", "b", False, None), (2, "b", "two", "e", "t", False, "redis 7")], COMPONENTS + ", technology_stack string")
    none = [spark.createDataFrame([], kinds) for kinds in (INTEGRATIONS, SECTIONS)]
    assert {r.solution_id: r.overlap for r in A.layer_links(components, *none, "b", "t", ("uses",)).collect()} == {1: True, 2: False}


def test_order(spark):
    rows = [(1, "b", "", 1), (1, "a", "", 2), (1, "zz", "", 0), (2, "a", "", 1), (2, "c", "", 1), (2, "a", "", 9), (3, "zz", "", 1), (4, "b", "", None), (4, "c", "", 3)]
    got = {r.solution_id: (r.missing, r.observed, r.in_order) for r in A.section_order(spark.createDataFrame(rows, SECTIONS), ("a", "b", "c")).collect()}
    assert got == {1: (["c"], ["b", "a"], False), 2: (["b"], ["a", "c"], True), 3: (["a", "b", "c"], [], True), 4: (["a"], ["b", "c"], True)}


def test_trace(spark, solution):
    tasks = spark.createDataFrame([(1, "Which portal for this"), (3, "with that"), (4, None), (6, "nothing"), (7, "unheard")], "solution_id int, text string")
    got = {r.solution_id: (r.tokens, r.names, r.texts, r.status) for r in A.task_trace(tasks, solution[0], solution[2]).collect()}
    assert got == {1: (1, 1, 1, "passed"), 3: (0, 0, 0, "warning"), 4: (0, 0, 0, "warning"), 6: (1, 0, 1, "passed"), 7: (1, 0, 0, "warning")}


def test_empty_tables(spark):
    c, i, s = [spark.createDataFrame([], kinds) for kinds in (COMPONENTS, INTEGRATIONS, SECTIONS)]
    t = spark.createDataFrame([], "solution_id int, text string")
    assert A.layer_links(c, i, s, "b", "t", ("uses",)).count() == A.consistency(c, i, s, t).count() == A.section_order(s, ("a",)).count() == A.task_trace(t, c, s).count() == 0


def test_relations_shuffle_a_fragment_once(spark, monkeypatch):
    layers = spark.createDataFrame([(1, f"l{k:02}x", "b") for k in range(9)] + [(1, f"r{k:02}x", "t") for k in range(9)] + [(2, "only", "b"), (2, " R00X ", "t"), (2, None, "t"), (2, "", "b")], "solution_id int, name string, layer string")
    said = [(1, "it uses l00x and r08x"), (1, "uses l01x"), (2, "uses r00x? only uses it"), (3, "uses l00x and r00x"), (2, None)]
    sections = spark.createDataFrame(said, "solution_id int, text string")
    for names in (512, 2):  # one block of names, and several
        monkeypatch.setattr(A, "NAMES", names)
        found = A._relations(layers, sections, ("uses",), "b", "t", "solution_id")
        assert {r.solution_id for r in found.collect()} == {1}
    # no row for each place of a fragment
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in text

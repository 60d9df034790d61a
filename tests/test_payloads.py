"""Payloads of awkward shapes, with known components."""

from __future__ import annotations

import json

import pytest

from tessera.operators import payloads as P


def row(name, role=None, boundary=None, external=None, stack=None, faces=(), merged=1, coerced=0, dropped=0):
    return (name, role, boundary, external, stack, list(faces), merged, coerced, dropped)


CASES = [
    ({"components": ["A  b", " ", 5, None, {"name": "C"}]}, [row("A b"), row("C")]),
    ({"payload": {"componentModel": {"nodes": [{"Component Name": "X", "isExternal": True, "Stack": "Java"}]}}}, [row("X", external=True, stack="Java")]),
    ({"Modules": [{"title": "X", "purpose": 7, "scope": "data", "external": "НЕТ", "technologies": {"a": "Redis", "b": "Kafka", "c": "Redis"}, "apis": ["/a", "/b", "/a"], "Extra-Field": 1, "more": 2}]},
     [row("X", "7", "data", False, "Redis, Kafka", ["/a", "/b"], coerced=3, dropped=2)]),
    # one key: the first that has a field gives it
    ({"components": [{"name": "Order-Service"}, {"name": "order service", "role": "Takes orders", "interface": "x;y"}, {"name": "ORDER SERVICE", "role": "Other", "interfaces": ["y", "z"]}]},
     [row("Order-Service", "Takes orders", faces=["x", "y", "z"], merged=3, coerced=1)]),
    # empty aliases give way to later ones
    ({"components": [{"component_name": " ", "title": "T", "description": "", "details": "d"}]}, [row("T", "d")]),
    ({"component": {"name": "Only one"}}, [row("Only one")]),
    ({"something": {"else": []}}, []),
    ({}, []),
]


@pytest.fixture(scope="module")
def got(spark):
    texts = [(k, json.dumps(p, ensure_ascii=False), "x") for k, (p, _) in enumerate(CASES)] + [(90, None, "x"), (91, "no json { here", "x"), (92, "[1, 2]", "x"), (93, 'So:\n```json\n{"components": ["F"]}\n```', "x")]
    out = {}
    for r in P.components(spark.createDataFrame(texts, "id int, text string, v string")).orderBy("id", "position").collect():
        out.setdefault(r.id, []).append((r.position, tuple(r)[2:]))
    return out


@pytest.mark.parametrize("k", range(len(CASES)))
def test_cases(got, k):
    assert got.get(k, []) == list(enumerate(CASES[k][1], 1)), json.dumps(CASES[k][0])


def test_texts_without_payload(spark, got):
    assert not {90, 91, 92} & set(got) and got[93] == [(1, row("F"))]
    assert P.components(spark.createDataFrame([], "id int, text string")).count() == 0

"""The automaton against plain search; answers and tasks with known outcomes; nulls and empty tables."""

from __future__ import annotations

import random

import pytest

from tessera.functions.automaton import Automaton
from tessera.operators import readiness as R


def test_automaton_equals_search():
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abя") for _ in range(n))
    for _ in range(200):
        groups = {str(g): [word(r.randint(1, 5)) for _ in range(r.randint(0, 4))] for g in range(6)}
        automaton, text = Automaton(groups), word(r.randint(0, 30))
        assert automaton.groups(text) == [g for g, ps in groups.items() if any(p in text for p in ps)]


CASES = [
    ("goal", "Сократить время обработки заявок на 30%", "ready", ["objective", "subject", "business_effect"], False),
    ("goal", "Автоматизировать процесс", "partial", ["objective", "subject"], False),
    ("goal", "Просто так", "insufficient", [], False),
    ("goal", "several longer English words here", "insufficient", ["subject"], False),
    ("context", "Сейчас работает CRM", "ready", ["current_state", "scope_entity"], False),
    ("context", "Сейчас много ошибок", "ready", ["current_state", "pain_point"], False),
    ("context", "Система с ошибками", "partial", ["scope_entity", "pain_point"], False),
    ("constraints", "Жестких ограничений нет", "ready", ["constraint_category", "constraint_detail"], True),
    ("constraints", "Бюджет и регламент", "ready", ["constraint_category"], False),
    ("constraints", "Нужен бюджет", "partial", ["constraint_category"], False),
    ("constraints", "не более двух", "partial", ["constraint_detail"], False),
    ("integrations", "Без интеграций", "ready", ["counterparty", "exchange_mode"], True),
    ("integrations", "SAP по REST", "ready", ["counterparty", "exchange_mode"], False),
    ("integrations", "Oracle", "partial", ["counterparty"], False),
    ("expected_output", "Схема", "ready", ["artifact_type"], False),
    ("expected_output", "схема " + "слово " * 12, "partial", ["artifact_type"], False),
    ("expected_output", "на выходе схема " + "слово " * 12, "ready", ["artifact_type"], False),
    ("nfr", "NFR нет", "ready", ["security", "availability", "performance", "operations"], True),
    ("nfr", "мониторинг " + "слово " * 12, "partial", ["operations"], False),
    ("nfr", "нефункциональные: мониторинг " + "слово " * 12, "ready", ["operations"], False),
    ("nfr", "TLS, failover, latency " + "слово " * 12, "ready", ["security", "availability", "performance"], False),
    ("goal", "  НЕ   ЗНАЮ ", "insufficient", [], False),
    ("nfr", None, "insufficient", [], False),
    ("nfr", " \n ", "insufficient", [], False),
]


def test_answers(spark):
    frame = spark.createDataFrame([(k, c, t, 1) for k, (c, t, *_) in enumerate(CASES)], "k int, code string, text string, facts_ int")
    got = {r.k: r for r in R.answer_aspects(frame).collect()}
    for k, (code, text, status, found, negative) in enumerate(CASES):
        r = got[k]
        assert (r.status, r.found_aspects, r.explicit_negative) == (status, found, negative), (code, text, r)
        assert r.missing_aspects == [a for a in R.LABELS[code] if a not in found]
        assert r.low_signal == (text is not None and " ".join(text.lower().split()) in R.LOW_SIGNAL)
    assert got[len(CASES) - 1].normalized is None
    assert R.answer_aspects(frame.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tasks(spark):
    everything = "Сократить время обработки заявок. Сейчас система с ошибками. Бюджет не более 5. SAP по REST. На выходе схема HLD. NFR: мониторинг."
    schema = "task string, text string, notes array<string>, answers map<string,string>, context string, expected_output string"
    rows = [
        ("all", everything, None, None, None, None),
        ("none", None, None, None, None, None),
        ("notes", "Сократить время обработки заявок", [" ", "Сейчас система с ошибками", "Бюджет не более 5"], {"integrations": "Без интеграций", "nfr": "мониторинг и бэкап"}, None, "Схема"),
        ("weak", "", None, {"goal": "todo", "integrations": "Oracle"}, "Сейчас работает CRM", None),
    ]
    return spark.createDataFrame(rows, schema)


def test_tasks(tasks):
    got = {r.task: r for r in R.assess(tasks).collect()}
    assert got["all"].ready and got["all"].missing == [] == got["all"].questions
    assert not got["none"].ready and got["none"].missing == list(R.CODES)
    assert got["none"].questions[2] == "Ограничения и обязательные условия. Уточните детали: 1. какие именно ограничения важны; 2. в чём выражается ограничение;"
    assert got["notes"].ready and got["notes"].notes == 2 and got["notes"].substantive == ["integrations", "nfr"]
    weak = got["weak"]
    assert weak.missing == ["goal", "constraints", "integrations", "expected_output", "nfr"] and weak.notes == 1 and weak.substantive == ["integrations"]
    assert weak.questions[2] == "Интеграции с системами, API, сервисами или данными. Уточните детали: 1. какой обмен или интерфейс ожидается;"
    assert R.assess(tasks.limit(0)).count() == 0

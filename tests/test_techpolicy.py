"""Technology policies: cases with known outcomes."""

from __future__ import annotations

import pytest

from tessera.operators import techpolicy as P

CASES = [
    ("Для всех серверов требуется установка Ubuntu 20.04 LTS.", "Ubuntu 20.04 LTS Запрещено\nUbuntu 22.04 LTS Разрешено", "failed", ["ubuntu 20.04 lts < 22.04"]),
    ("Для всех серверов требуется установка Ubuntu 20.04 LTS.", "Стандарт по операционным системам. Ubuntu 20.04 LTS Запрещено.", "failed", ["ubuntu 20.04 lts"]),
    ("Для всех серверов требуется установка Ubuntu 20.04 LTS.", "Ubuntu все версии ниже 22.04 Запрещено\nUbuntu 22.04 LTS Разрешено", "failed", ["ubuntu 20.04 lts < 22.04"]),
    ("Целевой сервер использует Debian 13.", "Debian все версии ниже 11 Запрещено\nDebian 13 Разрешено", "passed", []),
    ("Целевой сервер использует Debian 10.", "Debian все версии ниже 11 Запрещено\nDebian 13 Разрешено", "failed", ["debian 10 < 11"]),
    ("We run Java 8 and PostgreSQL 9.6", "Java:\nbefore 11 must not be used; PostgreSQL 9.6.1 is deprecated", "failed", ["java 8 < 11"]),
    ("We run RHEL 7.9", "RHEL 7.9\nне рекомендуется", "failed", ["rhel 7.9"]),
    ("Legacy Widget Server is kept", "Legacy Widget Server — запрещено", "failed", ["legacy widget server"]),
    ("Nothing of note", "Кедр", "warning", []),
    (None, None, "warning", []),
    ("Debian 10.0.0", "debian versions below 10 are forbidden", "passed", []),
    ("Red Hat 8, AlmaLinux 9", "Red Hat Enterprise Linux and alma linux lower than 9.1 are not recommended", "failed", ["almalinux 9 < 9.1", "red hat 8 < 9.1"]),
]


@pytest.fixture(scope="module")
def got(spark):
    solutions = spark.createDataFrame([(k, s, 1) for k, (s, *_) in enumerate(CASES)], "solution int, text string, policy int")
    policies = spark.createDataFrame([(k, p) for k, (_, p, *_) in enumerate(CASES)], "policy int, text string")
    pairs = spark.createDataFrame([(k, k) for k in range(len(CASES))] * 2 + [(None, 1), (1, None)], "solution int, policy int")
    return {r.solution: r for r in P.conflicts(solutions, policies, pairs).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_cases(got, k):
    assert (got[k].status, got[k].hits) == CASES[k][2:], CASES[k]


def test_pairs_once_and_empty(spark, got):
    assert len(got) == len(CASES)
    none = spark.createDataFrame([], "solution int, policy int, text string")
    assert P.conflicts(none, none, none).count() == 0 == P.policy_index(none).count()


def test_lines_are_parsed_once_and_for_pairs_only(spark):
    policies = spark.createDataFrame([(k, p) for k, (_, p, *_) in enumerate(CASES)], "policy int, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # no filter repeats the making of lines
    assert not any("Filter" in x and "[\\n\\r;]" in x for x in plan(P.policy_index(policies)))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = policies.select("policy", "text")
    parsed = P.policy_index
    try:
        P.policy_index = lambda p: parsed(p.mapInArrow(count, p.schema))
        solutions = spark.createDataFrame([(0, CASES[0][0])], "solution int, text string")
        assert [r.policy for r in P.conflicts(solutions, counted, spark.createDataFrame([(0, 1)], "solution int, policy int")).collect()] == [1]
    finally:
        P.policy_index = parsed
    assert seen.value < len(CASES)

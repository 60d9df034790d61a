"""Every query of the library and its SQL, by name."""

from __future__ import annotations

from tessera.plans import facts, journal, knowledge, pages, payloads, readers, readiness, relational, rows, rulebook, search, solutions, techpolicy, texts, versions
from tessera.plans.base import QUERIES, SQL

MODULES = (facts, journal, knowledge, pages, payloads, readers, readiness, relational, rows, rulebook, search, solutions, techpolicy, texts, versions)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)

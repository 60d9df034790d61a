"""The rulebook: 28 checks of a described solution, scored and folded.

A solution is one row of facts; every rule is an SQL expression over them, so all
rules are one projection without a shuffle, and the same expressions run on any SQL
engine. Statuses: passed, warning, failed, not_applicable, not_determined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import relational as O
from tessera.operators.shared import written

from . import solutions, techpolicy
from .base import SQL, query, table

#: Patterns of the non-functional rules: fixed values. "ha" is a bare substring.
NFR = {
    "VR-NFR-01": ("security", "secure", "authentication", "authorization", "auth", "oauth", "sso", "mfa", "rbac", "tls", "ssl", "encryption", "шифр", "безопас", "аутенти", "авториз", "доступ", "роль", "персональн"),
    "VR-NFR-02": ["availability", "fault tolerance", "failover", "ha", "replication", "redundancy", "resilience", "доступност", "отказоуст", "резервирован", "реплика", "кластер"],
    "VR-NFR-03": ("performance", "latency", "throughput", "rps", "load", "scalability", "scale", "cache", "sla", "производ", "задерж", "нагруз", "масштаб", "кэш"),
    "VR-NFR-04": ("monitoring", "observability", "metrics", "logs", "logging", "tracing", "alert", "prometheus", "grafana", "монитор", "наблюдаем", "метрик", "лог", "трасс", "алерт", "оповещ"),
    "VR-NFR-05": ["backup", "restore", "recovery", "rpo", "rto", "disaster recovery", "archive", "резервн", "бэкап", "восстанов", "аварийн"],
}


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _present(present: str, otherwise: str = "failed") -> str:
    return f"CASE WHEN {present} THEN 'passed' ELSE '{otherwise}' END"


def _basis(have: str, expected: str, contradiction: str, linked: str) -> str:
    """A normative rule: without its basis it depends on the materials; with it on contradictions and links."""
    return (
        f"CASE WHEN NOT ({have}) AND NOT ({expected}) THEN 'not_applicable' WHEN NOT ({have}) AND materials > 0 THEN 'warning' WHEN NOT ({have}) THEN 'not_determined' "
        f"WHEN {contradiction} THEN 'failed' WHEN {linked} THEN 'passed' ELSE 'warning' END"
    )


def rules(goal=("goal", "цель", "результат"), context=("context", "контекст", "as is"), api=("api", "rest", "grpc", "soap", "webhook", "интеграц"), data=("data", "данн")) -> list[tuple[str, str, str, str]]:
    """``(code, group, severity, expression)``; the vocabularies are parameters."""
    return [
        ("VR-TEC-01", "technical", "critical", "CASE WHEN state IS NULL THEN 'not_determined' WHEN state = 'published' THEN 'passed' ELSE 'failed' END"),
        ("VR-TEC-02", "technical", "critical", _present("version IS NOT NULL")),
        ("VR-TEC-03", "technical", "critical", "CASE WHEN missing_packages = 0 THEN 'passed' WHEN materials > 0 THEN 'warning' ELSE 'failed' END"),
        ("VR-TEC-04", "technical", "critical", _present("greatest(basis, selected) > 0")),
        ("VR-STR-01", "structure", "major", _present(f"(task <> '' OR {any_of('body', goal)}) AND (sections > 0 OR {any_of('body', context)})")),
        ("VR-STR-02", "structure", "major", "CASE WHEN assumptions > 0 AND constraints > 0 THEN 'passed' WHEN assumptions + constraints > 0 THEN 'warning' ELSE 'failed' END"),
        ("VR-STR-03", "structure", "major", "CASE WHEN components = 0 THEN 'failed' WHEN components = 1 THEN 'warning' ELSE 'passed' END"),
        ("VR-STR-04", "structure", "major", f"CASE WHEN integrations = 0 AND NOT {any_of('body', api)} THEN 'not_applicable' WHEN integrations = 0 THEN 'failed' WHEN incomplete > 0 OR disclosure = 0 THEN 'warning' ELSE 'passed' END"),
        ("VR-STR-05", "structure", "major", "CASE WHEN risks = 0 THEN 'failed' WHEN risks = 1 OR next_steps = 0 THEN 'warning' ELSE 'passed' END"),
        ("VR-STR-06", "structure", "critical", _present("missing_sections = 0")),
        ("VR-STR-07", "structure", "critical", _present("misplaced_sections = 0")),
        ("VR-NRM-01", "normative", "major", _basis("basis > 0", "missing_packages > 0", "contradictions > 0", "selected > 0 OR with_refs > 0")),
        ("VR-NRM-02", "normative", "major", _basis("basis > 0", "missing_packages > 0", "contradictions > 0 OR disallowed > 0", "layered > 0 AND weak = 0")),
        ("VR-NRM-03", "normative", "critical", _basis("technology_status IS NOT NULL", "missing_packages > 1", "technology_status = 'failed'", "technology_status = 'passed'")),
        ("VR-NRM-04", "normative", "minor", _basis("selected > 0", "missing_packages > 1", "false", "with_refs > 0")),
        ("VR-NRM-05", "normative", "critical", _present("disallowed = 0")),
        ("VR-NRM-06", "normative", "major", "CASE WHEN layered = 0 THEN 'failed' WHEN weak > 0 THEN 'warning' ELSE 'passed' END"),
        ("VR-CNS-01", "consistency", "major", _present("duplicates = 0 AND dangling = 0 AND contradictions = 0")),
        ("VR-CNS-02", "consistency", "major", "CASE WHEN sections = 0 THEN 'failed' WHEN with_refs = sections THEN 'passed' WHEN with_refs > 0 THEN 'warning' ELSE 'failed' END"),
        ("VR-CNS-03", "consistency", "major", "CASE WHEN business = 0 THEN 'not_applicable' WHEN components > 0 AND linked_business > 0 THEN 'passed' ELSE 'warning' END"),
        ("VR-CNS-04", "consistency", "major", "CASE WHEN components = 0 THEN 'not_applicable' WHEN technology = 0 THEN 'failed' WHEN linked_technology > 0 THEN 'passed' ELSE 'warning' END"),
        ("VR-CNS-05", "consistency", "major", _present(f"{any_of('body', data)} AND components >= 2", "warning")),
        ("VR-CNS-06", "consistency", "major", _present("traced > 0", "warning")),
        *((code, "nfr", "major", _present(any_of("body", words), "warning")) for code, words in NFR.items()),
    ]


def check(facts: DataFrame, key: str = "doc_id", **vocabulary) -> DataFrame:
    """``(key, rule, rule_group, severity, status)``: every rule for every row of facts."""
    results = [F.struct(F.lit(c).alias("rule"), F.lit(g).alias("rule_group"), F.lit(s).alias("severity"), F.expr(e).alias("status")) for c, g, s, e in rules(**vocabulary)]
    return facts.select(key, F.explode(F.array(*results)).alias("r")).select(key, "r.*")


def protocol(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of folded status, score and counts for each solution."""
    order = ("not_determined", "failed", "warning", "passed")
    status = F.when(F.col("status") == "not_applicable", "passed").otherwise(F.col("status"))
    return results.withColumn("s", status).groupBy(key).agg(
        O.precedence(F.col("s"), order).alias("status"),
        O.weighted_score(F.col("severity"), F.col("status")).alias("score"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "warning").alias("warnings"),
    )


#: Vocabulary that occurs in the given texts.
WORDS = dict(goal=("the ", "der "), context=("and ", "und "), api=("only",), data=("of ", "de "))


def facts(spark, sf: str) -> DataFrame:
    """Conversations as solutions, as in ``solutions``; what that doesn't count goes by the id."""
    c = table(spark, sf, "conversations")
    long, lines = F.char_length("text") > 150, F.contains("text", F.lit("\n"))
    n = lambda x: F.count_if(x)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.lower("text").alias("t")))), lambda x: x["t"]), " ")
    g = c.groupBy(F.col("conv_id").alias("doc_id")).agg(
        body.alias("body"),
        F.count(F.lit(1)).alias("sections"),
        n(F.col("role") == "assistant").alias("components"),
        n(lines).alias("integrations"),
        n(lines & ~long).alias("incomplete"),
        n(F.col("role") == "system").alias("basis"),
        n(long).alias("with_refs"),
        F.max("turn").alias("last"),
    )
    linked = lambda name: (F.col("relation") | F.col("edge") | F.col("overlap")).cast("int").alias(name)
    key = F.col("solution_id").alias("doc_id")
    # each has at most one row for a solution
    counted = [
        solutions.layer_links(spark, sf).select(key, F.col("left_n").alias("business"), linked("linked_business")),
        solutions.technology_links(spark, sf).select(key, F.col("right_n").alias("technology"), linked("linked_technology")),
        solutions.solution_consistency(spark, sf).select(key, "duplicates", "dangling", "contradictions"),
        solutions.section_order(spark, sf).select(key, F.size("missing").alias("missing_sections"), (~F.col("in_order")).cast("int").alias("misplaced_sections")),
        solutions.task_trace(spark, sf).select(key, (F.col("names") + F.col("texts")).alias("traced")),
        solutions.section_alignment(spark, sf).select(key, "layered", "disallowed", "weak"),
        techpolicy.technology_conflicts(spark, sf).select(F.col("solution").alias("doc_id"), F.col("status").alias("technology_status")),
    ]
    # each is made by itself: one plan of all is more than a driver should hold; they meet in one grouping, not in a join each
    parts = [written(part) for part in [g, *counted]]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [parts[0].withColumn("known", F.lit(True)), *[part.where("doc_id IS NOT NULL") for part in parts[1:]]])
    g = both.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in both.columns if c != "doc_id"]).where("known")
    i = F.col("doc_id")
    return g.select(
        "doc_id", "body", "sections", "components", "integrations", "incomplete", "basis", "with_refs", "duplicates", "dangling", "contradictions", "missing_sections", "misplaced_sections", "business", "linked_business", "technology", "linked_technology",
        F.coalesce("traced", F.lit(0)).alias("traced"),
        F.when(i % 5 == 0, F.lit(None)).when(i % 5 == 1, "draft").otherwise("published").alias("state"), F.when(i % 7 != 0, i).alias("version"),
        (i % 3).alias("missing_packages"), (i % 4).alias("materials"), (i % 2).alias("selected"), F.when(i % 6 == 0, "").otherwise("task").alias("task"),
        (i % 3).alias("assumptions"), (i % 2).alias("constraints"), F.col("components").alias("disclosure"), F.greatest(F.lit(0), F.col("last") - 1).alias("risks"), (i % 3).alias("next_steps"),
        "layered", "disallowed", "weak", "technology_status",
    )


FACTS_SQL = f"""g AS (SELECT conv_id AS doc_id, string_agg(lower(text), ' ' ORDER BY turn, lower(text)) AS body, count(*) AS sections, count(*) FILTER (role = 'assistant') AS components,
  count(*) FILTER (contains(text, chr(10))) AS integrations, count(*) FILTER (contains(text, chr(10)) AND length(text) <= 150) AS incomplete, count(*) FILTER (role = 'system') AS basis,
  count(*) FILTER (length(text) > 150) AS with_refs, max(turn) AS last FROM conversations GROUP BY ALL),
l1 AS ({SQL["layer_links"]}), l2 AS ({SQL["technology_links"]}), k AS ({SQL["solution_consistency"]}), o AS ({SQL["section_order"]}), t AS ({SQL["task_trace"]}), sa AS ({SQL["section_alignment"]}), tp AS ({SQL["technology_conflicts"]}),
f AS (SELECT g.doc_id, body, sections, components, integrations, incomplete, basis, with_refs, duplicates, dangling, contradictions, len(missing) AS missing_sections, CASE WHEN in_order THEN 0 ELSE 1 END AS misplaced_sections,
  l1.left_n AS business, CAST(l1.relation OR l1.edge OR l1.overlap AS INT) AS linked_business, l2.right_n AS technology, CAST(l2.relation OR l2.edge OR l2.overlap AS INT) AS linked_technology, coalesce(names + texts, 0) AS traced,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'draft' ELSE 'published' END AS state,
  CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS version, doc_id % 3 AS missing_packages, doc_id % 4 AS materials, doc_id % 2 AS selected, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'task' END AS task,
  doc_id % 3 AS assumptions, doc_id % 2 AS constraints, components AS disclosure, greatest(0, last - 1) AS risks, doc_id % 3 AS next_steps, layered, disallowed, weak, tp.status AS technology_status
  FROM g LEFT JOIN sa ON sa.solution_id = doc_id LEFT JOIN tp ON tp.solution = doc_id LEFT JOIN l1 ON l1.solution_id = doc_id LEFT JOIN l2 ON l2.solution_id = doc_id LEFT JOIN k ON k.solution_id = doc_id LEFT JOIN o ON o.solution_id = doc_id LEFT JOIN t ON t.solution_id = doc_id)"""
_RULES_SQL = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS rule, '{g}' AS rule_group, '{s}' AS severity, {e} AS status FROM f" for c, g, s, e in rules(**WORDS))


@query(f"WITH {FACTS_SQL} {_RULES_SQL}")
def rulebook(spark, sf):
    """2.K: every rule for every solution."""
    return check(facts(spark, sf), **WORDS)


@query(f"""WITH {FACTS_SQL}, r AS ({_RULES_SQL}), w AS (SELECT *, CASE status WHEN 'not_determined' THEN 1 WHEN 'failed' THEN 2 WHEN 'warning' THEN 3 ELSE 4 END AS k,
CASE severity WHEN 'minor' THEN 2 WHEN 'major' THEN 4 WHEN 'critical' THEN 6 ELSE 3 END::DOUBLE AS w, CASE status WHEN 'passed' THEN 1 WHEN 'not_applicable' THEN 1 WHEN 'warning' THEN 0.55 ELSE 0 END::DOUBLE AS m FROM r)
SELECT doc_id, ['not_determined', 'failed', 'warning', 'passed'][min(k)] AS status, round_even(100 * sum(w * m) / sum(w), 0) AS score, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'warning') AS warnings FROM w GROUP BY ALL""")
def rulebook_protocol(spark, sf):
    """3.3, D23, D24: the folded protocol of every solution."""
    return protocol(check(facts(spark, sf), **WORDS))


@query(f"WITH {FACTS_SQL}, r AS ({_RULES_SQL}) SELECT rule_group, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'passed') AS passed FROM r GROUP BY ALL")
def rulebook_groups(spark, sf):
    """Counts of statuses of each group of rules."""
    return O.zero_filled_pivot(check(facts(spark, sf), **WORDS), ["rule_group"], "status", ("failed", "warning", "passed"))

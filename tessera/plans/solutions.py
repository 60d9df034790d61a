"""Conversations as described solutions: what rules count in their components, integrations, sections and task.

A turn is a component and a section: its first word the name, its last the description,
its role the layer. A turn of several lines is an integration with the next turn.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import architecture as A
from tessera.operators import ontology

from .base import query, table

CANONICAL = ("system", "user", "assistant")
PATTERNS = ("only", "was ")
#: Claims that occur in the given texts, in place of the fixed ones.
CLAIMS = dict(no_integrations=("only",), no_api=("none of",), only_internal=("entre",), only_batch=("was of",), online=("th",))


def _tables(spark, sf):
    c = table(spark, sf, "conversations").withColumnRenamed("conv_id", "solution_id")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    components = c.select("solution_id", F.col("turn").alias("component_id"), F.get(words, F.lit(0)).alias("name"), F.try_element_at(words, F.lit(-1)).alias("description"), F.col("role").alias("layer"), F.contains("text", F.lit("?")).alias("external"))
    integrations = c.where(F.contains("text", F.lit("\n"))).select("solution_id", F.col("turn").alias("from_id"), (F.col("turn") + 1).alias("to_id"), F.substring("text", 1, 12).alias("protocol"))
    sections = c.select("solution_id", F.col("role").alias("section"), "text", F.col("turn").alias("sort_order"))
    return components, integrations, sections


_COMPONENTS = """comp AS (SELECT conv_id AS s, turn AS id, role AS layer, regexp_extract_all(lower(text), '[a-z]+') AS w, contains(text, '?') AS external FROM conversations),
c AS (SELECT s, id, layer, external, w[1] AS name, w[-1] AS description FROM comp),
i AS (SELECT conv_id AS s, turn AS a, turn + 1 AS b, substr(text, 1, 12) AS protocol FROM conversations WHERE contains(text, chr(10)))"""


def _links_sql(left: str, right: str, missing: str) -> str:
    return rf"""WITH {_COMPONENTS},
f AS (SELECT DISTINCT conv_id AS s, trim(regexp_replace(unnest(regexp_split_to_array(lower(text), '[\n.;:!?]+')), '\s+', ' ', 'g')) AS t FROM conversations WHERE role IN ('{left}', '{right}')),
rel AS (SELECT DISTINCT f.s FROM f JOIN c x ON x.s = f.s AND x.layer = '{left}' AND contains(f.t, x.name) JOIN c y ON y.s = f.s AND y.layer = '{right}' AND contains(f.t, y.name) WHERE contains(t, 'only') OR contains(t, 'was ')),
ed AS (SELECT DISTINCT i.s FROM i JOIN c x ON x.s = i.s AND x.id = i.a JOIN c y ON y.s = i.s AND y.id = i.b WHERE (x.layer = '{left}' AND y.layer = '{right}') OR (x.layer = '{right}' AND y.layer = '{left}')),
tok AS (SELECT s, layer, unnest([name, description]) AS t FROM c),
ov AS (SELECT DISTINCT x.s FROM tok x JOIN tok y USING (s, t) WHERE x.layer = '{left}' AND y.layer = '{right}' AND length(t) >= 4 AND t NOT IN ('business', 'application', 'technology', 'service', 'system', 'process', 'component', 'role', 'office', 'node', 'runtime', 'cluster', 'platform', 'module', 'adapter', 'gateway', 'layer')),
n AS (SELECT s, count(*) FILTER (layer = '{left}') AS left_n, count(*) FILTER (layer = '{right}') AS right_n FROM c GROUP BY s),
o AS (SELECT *, s IN (FROM rel) AS relation, s IN (FROM ed) AS edge, s IN (FROM ov) AS overlap FROM n)
SELECT s AS solution_id, left_n, right_n, relation, edge, overlap, CASE WHEN left_n = 0 THEN 'not_applicable' WHEN right_n = 0 THEN '{missing}' WHEN relation OR edge OR overlap THEN 'passed' ELSE 'warning' END AS status FROM o"""


@query(_links_sql("user", "assistant", "warning"))
def layer_links(spark, sf):
    """C18-C20, VR-CNS-03: whether business and application are connected by text, edge or shared token."""
    return A.layer_links(*_tables(spark, sf), "user", "assistant", PATTERNS)


@query(_links_sql("assistant", "system", "failed"))
def technology_links(spark, sf):
    """C18-C20, VR-CNS-04: the same between application and technology, which must be there."""
    return A.layer_links(*_tables(spark, sf), "assistant", "system", PATTERNS, missing="failed")


@query(f"""WITH {_COMPONENTS},
st AS (SELECT conv_id AS s, role = 'system' AS stated, lower(text) AS t FROM conversations),
cl AS (SELECT s, t, stated, count(*) FILTER (stated) OVER (PARTITION BY s) AS k FROM st),
said AS (SELECT s, bool_or(contains(t, 'only')) AS no_joints, bool_or(contains(t, 'none of')) AS no_api, bool_or(contains(t, 'entre')) AS internal, bool_or(contains(t, 'was of')) AS batch FROM cl WHERE stated OR k = 0 GROUP BY s),
api AS (SELECT s, bool_or(contains(t, 'api')) AS api FROM st GROUP BY s),
j AS (SELECT s, count(*) AS joints, count(*) FILTER (NOT EXISTS (FROM c WHERE c.s = i.s AND c.id = i.a) OR NOT EXISTS (FROM c WHERE c.s = i.s AND c.id = i.b)) AS dangling, bool_or(contains(lower(protocol), 'th')) AS online FROM i GROUP BY s),
n AS (SELECT s, count(*) - (count(DISTINCT name) + CAST(bool_or(name IS NULL) AS INT)) AS duplicates, bool_or(external) AS external FROM c GROUP BY s),
r AS (SELECT s, duplicates, coalesce(dangling, 0) AS dangling, CAST(no_joints AND coalesce(joints, 0) > 0 AS INT) + CAST(no_api AND api AS INT) + CAST(internal AND (external OR coalesce(joints, 0) > 0) AS INT) + CAST(batch AND coalesce(online, false) AS INT) AS contradictions
  FROM n JOIN said USING (s) JOIN api USING (s) LEFT JOIN j USING (s))
SELECT s AS solution_id, duplicates, dangling, contradictions, CASE WHEN duplicates = 0 AND dangling = 0 AND contradictions = 0 THEN 'passed' ELSE 'failed' END AS status FROM r""")
def solution_consistency(spark, sf):
    """H50, VR-CNS-01: duplicate names, dangling ends, and claims that the facts contradict."""
    components, integrations, sections = _tables(spark, sf)
    return A.consistency(components, integrations, sections, sections.where("section = 'system'"), **CLAIMS)


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS place FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY ALL),
o AS (SELECT conv_id, list(role ORDER BY place, role) AS observed, list(role ORDER BY CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END) AS expected FROM f GROUP BY ALL)
SELECT conv_id AS solution_id, list_filter(['system', 'user', 'assistant'], lambda r: NOT list_contains(observed, r)) AS missing, observed, observed = expected AS in_order FROM o""")
def section_order(spark, sf):
    """VR-STR-06, VR-STR-07: required sections that are missing, and whether the others stand in order."""
    return A.section_order(_tables(spark, sf)[2], CANONICAL)


@query(r"""WITH t AS (SELECT conv_id AS s, min(text) AS text FROM conversations WHERE role = 'user' GROUP BY ALL),
k AS (SELECT s, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zа-я0-9_\-]{4,}'), lambda x: NOT list_contains(['which', 'that', 'with', 'from', 'this', 'для', 'надо', 'нужно', 'будет', 'система'], x))))[1:24] AS w FROM t),
a AS (SELECT conv_id AS s, regexp_extract(lower(text), '[a-z]+') AS name, lower(text) AS text FROM conversations WHERE role = 'assistant'),
n AS (SELECT s, count(DISTINCT name) AS names FROM a JOIN (SELECT s, unnest(w) AS t FROM k) USING (s) WHERE contains(name, t) GROUP BY ALL),
x AS (SELECT s, count(*) AS texts FROM a JOIN k USING (s) WHERE len(list_filter(w, lambda t: contains(text, t))) > 0 GROUP BY ALL)
SELECT s AS solution_id, len(w) AS tokens, coalesce(names, 0) AS names, coalesce(texts, 0) AS texts, CASE WHEN coalesce(names, 0) + coalesce(texts, 0) > 0 THEN 'passed' ELSE 'warning' END AS status FROM k LEFT JOIN n USING (s) LEFT JOIN x USING (s)""")
def task_trace(spark, sf):
    """VR-CNS-06: whether the words of the question come back in the answers."""
    components, _, sections = _tables(spark, sf)
    return A.task_trace(sections.where("section = 'user'"), components.where("layer = 'assistant'"), sections.where("section = 'assistant'"))


#: Elements with their names, and what the sections allow, by words of the given texts.
ALIASES = (("Limit", "only"), ("Limit", "none of"), ("Place", "entre"), ("Place", "to the"), ("Actor", "they"), ("Actor", "the"))
ALLOWED = {"user": ("Actor", "Place"), "assistant": ("Actor", "Limit")}


@query("""WITH p AS (SELECT conv_id AS s, role, text, ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ' AS t FROM conversations),
e AS (SELECT s, role, text, contains(t, ' only ') OR contains(t, ' none of ') AS lim, contains(t, ' entre ') OR contains(t, ' to the ') AS pla, contains(t, ' they ') OR contains(t, ' the ') AS act FROM p),
r AS (SELECT s, CASE role WHEN 'user' THEN lim WHEN 'assistant' THEN pla ELSE false END AS bad, CASE role WHEN 'user' THEN act OR pla WHEN 'assistant' THEN act OR lim ELSE length(trim(text)) > 0 END AS fine FROM e)
SELECT s AS solution_id, count(*) AS layered, count(*) FILTER (bad) AS disallowed, count(*) FILTER (NOT coalesce(fine, false)) AS weak FROM r GROUP BY s""".replace("\\\\", "\\"))
def section_alignment(spark, sf):
    """VR-NRM-02, 05, 06: sections with elements that they don't allow, and without any that they do."""
    sections = _tables(spark, sf)[2]
    allowed = spark.createDataFrame([(k, list(v)) for k, v in ALLOWED.items()], "section string, elements array<string>")
    return ontology.alignment_counts(ontology.align(sections, allowed, ALIASES))

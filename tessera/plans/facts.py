"""Typed facts, page filters, coverage, guidance, telemetry and other small reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import extraction as E
from tessera.operators import pagefilter as PF

from .base import FRAGMENTS_SQL, SQL, fragments, query, table

#: Markers that the invented prose of the test tables has: the catalogue is a parameter of the operators.
CATALOGUE = {
    "risk": (("idiot", "trash"), ()),
    "constraint": (("all rights reserved", "only"), ()),
    "rule": (("licensed", "must"), ("distribut",)),
    "integration": (("with", "avec"), ()),
    "technology": (("apache", "version"), ()),
    "architecture": (("entre", "from"), ("principle",)),
}
_SENTENCES = r"list_filter(list_transform(flatten(list_transform(regexp_split_to_array(text, '[\r\n]+'), lambda b: string_split(regexp_replace(regexp_replace(trim(trim(regexp_replace(b, '\s+', ' ', 'g')), ' -•'), ' • ', chr(1), 'g'), '([.!?;]) ', '\1' || chr(1), 'g'), chr(1)))), lambda s: trim(s, ' -•')), lambda s: length(s) >= 20)"
_NORMAL = r"' ' || trim(regexp_replace(lower(s), '[^\p{L}\p{N}_]+', ' ', 'g')) || ' '"
_RELATION = r"(?i)([A-ZА-Я][\p{L}\p{N}_ .\-/]{1,80})\s*(?:->|→|to)\s*([A-ZА-Я][\p{L}\p{N}_ .\-/]{1,80})"


def _has(category: str) -> str:
    whole, prefixes = CATALOGUE[category]
    return "(" + " OR ".join([f"contains(n, ' {m} ')" for m in whole] + [f"contains(n, ' {p}')" for p in prefixes]) + ")"


_ITEMS = rf"""WITH s0 AS (SELECT doc_id, doc_id % 5 = 3 AS normative, {_SENTENCES} AS l FROM documents),
s1 AS (SELECT doc_id, normative, unnest(l) AS s, unnest(range(len(l))) AS position FROM s0),
s2 AS (SELECT *, {_NORMAL} AS n, regexp_matches(s, '{_RELATION}') AS related FROM s1),
st AS (SELECT *, substr(array_to_string(string_split(trim(regexp_replace(s, '\s+', ' ', 'g')), ' ')[1:8], ' '), 1, 120) AS title FROM s2),
it AS (SELECT doc_id, position, 'risk' AS item_type, title, s, 0.79 AS confidence FROM st WHERE {_has("risk")}
UNION ALL SELECT doc_id, position, 'constraint', title, s, 0.86 FROM st WHERE {_has("constraint")}
UNION ALL SELECT doc_id, position, CASE WHEN contains(lower(s), 'principle') THEN 'architectural_principle' WHEN normative THEN 'normative_rule' ELSE 'mandatory_requirement' END, title, s, CASE WHEN normative THEN 0.9 ELSE 0.82 END FROM st WHERE {_has("rule")}
UNION ALL SELECT doc_id, position, 'integration_requirement', title, s, 0.8 FROM st WHERE {_has("integration")}
UNION ALL SELECT doc_id, position, 'technology_standard', title, s, 0.78 FROM st WHERE {_has("technology")}
UNION ALL SELECT doc_id, position, CASE WHEN contains(lower(s), 'principle') THEN 'architectural_principle' ELSE 'term' END, title, s, 0.78 FROM st WHERE {_has("architecture")}
UNION ALL SELECT doc_id, position, 'entity_relation', trim(regexp_extract(s, '{_RELATION}', 1)) || ' -> ' || trim(regexp_extract(s, '{_RELATION}', 2)), s, 0.73 FROM st WHERE related)
"""


def _items(spark, sf):
    docs = table(spark, sf, "documents")
    return E.typed_items(docs, CATALOGUE, F.col("doc_id") % 5 == 3)


@query(_ITEMS + "SELECT doc_id, position, item_type, title, CAST(confidence AS DOUBLE) AS confidence FROM it")
def typed_facts(spark, sf):
    """Typed items and relations of all sentences of whole texts."""
    return _items(spark, sf).select("doc_id", F.col("position").cast("bigint").alias("position"), "item_type", "title", "confidence")


@query(_ITEMS + ", d AS (SELECT DISTINCT doc_id, item_type, lower(title), lower(s) FROM it) SELECT item_type, count(*) AS items, count(DISTINCT doc_id) AS documents FROM d GROUP BY ALL")
def item_counters(spark, sf):
    """Items once per document by type, title and content, counted by type."""
    return E.distinct_items(_items(spark, sf)).groupBy("item_type").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("doc_id").alias("documents"))


@query("""SELECT doc_id, CASE WHEN s IS NULL OR len(s) = 0 THEN substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 800) ELSE substr(array_to_string(s[1:2], ' '), 1, 800) END AS content, 'summary' AS item_type, 0::BIGINT AS ordinal
FROM (SELECT doc_id, text, """.replace("\\\\", "\\") + _SENTENCES + " AS s FROM documents) UNION ALL SELECT doc_id, s, item_type, row_number() OVER (PARTITION BY doc_id ORDER BY position, item_type, title) FROM (" + _ITEMS + "SELECT * FROM it)")
def document_memory(spark, sf):
    """A document's memory: the summary, then its items in order."""
    docs = table(spark, sf, "documents")
    head = docs.select("doc_id", X.summary(F.col("text")).alias("content"), F.lit("summary").alias("item_type"), F.lit(0).cast("bigint").alias("ordinal"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("position", "item_type", "title")).cast("bigint")
    return head.unionByName(_items(spark, sf).select("doc_id", "content", "item_type", at.alias("ordinal")))


@query(r"""WITH u AS (SELECT page_id, 'see GET ' || coalesce(nullif(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), ''), '/') || ' then POST /q' || page_id || ' or PATCH  /p, FORGET /x' AS t FROM pages)
SELECT page_id, unnest(regexp_extract_all(t, '\b(GET|POST|PUT|PATCH|DELETE)\s+(/\S+)', 1)) AS method, unnest(regexp_extract_all(t, '\b(GET|POST|PUT|PATCH|DELETE)\s+(/\S+)', 2)) AS path FROM u""")
def api_endpoints(spark, sf):
    """The endpoints that a text about a page's path names."""
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"://[^/?#]+([^?#]*)", 1), F.lit("")), F.lit("/"))
    said = F.concat(F.lit("see GET "), path, F.lit(" then POST /q"), "page_id", F.lit(" or PATCH  /p, FORGET /x"))
    return table(spark, sf, "pages").select("page_id", F.explode(E.endpoints(said)).alias("x")).select("page_id", "x.method", "x.path")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS l FROM documents), m AS (SELECT doc_id, trim(regexp_extract(trim(l), '^([A-ZА-Я][\p{L}\p{N}_\- /]{1,120})\s*(?:[:\-—]|is)\s*(.+)$', 1)) AS term, trim(regexp_extract(trim(l), '^([A-ZА-Я][\p{L}\p{N}_\- /]{1,120})\s*(?:[:\-—]|is)\s*(.+)$', 2)) AS definition FROM l)
SELECT doc_id, term, definition FROM m WHERE term <> '' AND len(regexp_extract_all(term, '\S+')) <= 10 AND length(definition) >= 8""")
def term_definitions(spark, sf):
    """Lines of whole texts that define a term."""
    return table(spark, sf, "documents").select("doc_id", F.explode(E.terms(F.col("text"))).alias("x")).select("doc_id", "x.term", "x.definition")


@query()
def entity_candidates(spark, sf):
    """A document's title and its runs of capitalised words, the first six in order."""
    title = F.substring(F.element_at(F.split("text", "\n"), 1), 1, 120)
    return table(spark, sf, "documents").select("doc_id", E.entities(title, F.col("text")).alias("entities"))


_RULE_WORDS = ("license", "only", "must", "reserved")


@query(r"""WITH p AS (SELECT doc_id, list_filter(string_split_regex(text, '\n\s*\n'), lambda p: trim(p) <> '') AS ps FROM documents),
c AS (SELECT doc_id, flatten(list_transform(ps, lambda p: list_filter(list_transform(string_split_regex(trim(p), '\n\s*(?:[-*•]|\d+[\).])\s+'), lambda b: trim(b)), lambda b: b <> ''))) AS cs FROM p),
r AS (SELECT doc_id, unnest(range(len(cs))) AS place, unnest(cs) AS rule FROM c),
k AS (SELECT *, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(rule), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('license', 'only', 'must', 'reserved')), ' ') AS signature FROM r WHERE regexp_matches(lower(rule), 'license|only|must|reserved')),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, signature ORDER BY place) AS nth FROM k) WHERE nth = 1),
g AS (SELECT *, CASE WHEN regexp_matches(lower(rule), 'api|endpoint|openapi|swagger') THEN 'api' WHEN regexp_matches(lower(rule), 'integration|queue|event|message') THEN 'integration' WHEN regexp_matches(lower(rule), 'component|module|service') THEN 'component'
  WHEN regexp_matches(lower(rule), 'technology|postgres|docker|kubernetes|python') THEN 'technology' WHEN regexp_matches(lower(rule), 'notation|diagram|archimate|uml') THEN 'notation' WHEN regexp_matches(lower(rule), 'governance|approval|operator|audit') THEN 'governance' ELSE 'architecture' END AS category FROM f)
SELECT doc_id, upper(substr(category, 1, 4)) || '-' || upper(right(doc_id::VARCHAR, 6)) || '-' || lpad((row_number() OVER (PARTITION BY doc_id, upper(substr(category, 1, 4)) ORDER BY place))::VARCHAR, 3, '0') AS code,
substr(trim(regexp_replace(rule, '\s+', ' ', 'g')), 1, 120) AS name, rule, category,
CASE WHEN regexp_matches(lower(rule), 'must not|shall not|запрещено') THEN 'critical' WHEN regexp_matches(lower(rule), 'must|shall|должен|обязан') THEN 'major' WHEN regexp_matches(lower(rule), 'should|рекомендуется') THEN 'minor' ELSE 'info' END AS severity, contains(lower(rule), 'not ') AS negated FROM g""")
def rule_extraction(spark, sf):
    """Rules of whole texts with their codes."""
    return E.normative_rules(table(spark, sf, "documents"), _RULE_WORDS, ("not ",)).drop("confidence")


_CONFLICT = r"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(rule), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('the', 'of', 'only', 'le', 'de')), ' ')"


@query(f"""WITH rules AS ({SQL["rule_extraction"]}), s AS (SELECT doc_id, code, {_CONFLICT} AS signature, negated FROM rules),
g AS (SELECT signature, count(*) AS rules, CASE WHEN bool_or(negated) AND NOT bool_and(negated) THEN 'polarity_conflict' ELSE 'duplicate_rule' END AS conflict FROM s GROUP BY signature HAVING count(*) > 1)
SELECT doc_id, code, signature, rules, conflict FROM s JOIN g USING (signature)""")
def rule_conflicts(spark, sf):
    """The extracted rules of whole texts that repeat or contradict another of their signature."""
    return E.rule_conflicts(E.normative_rules(table(spark, sf, "documents"), _RULE_WORDS, ("not ",)), quantity=("only",), modal=("the", "of", "le", "de"))


@query(f"""WITH {FRAGMENTS_SQL} SELECT doc_id, document_type, source_weight::DOUBLE AS source_weight, document_type = 'normative' OR fragment_type = 'rule' AS normative_flag, document_type = 'api' OR fragment_type = 'api' AS api_flag,
regexp_matches(lower(content), 'postgres|docker|kubernetes|python|redis|pgvector') AS technology_flag, sha1(content) AS content_hash FROM frag""")
def chunk_metadata(spark, sf):
    """What is kept beside a chunk."""
    f = fragments(spark, sf)
    kind, t = F.col("fragment_type"), F.col("document_type")
    technology = X.contains_any(F.lower("content"), ("postgres", "docker", "kubernetes", "python", "redis", "pgvector"))
    return f.select("doc_id", "document_type", "source_weight", ((t == "normative") | (kind == "rule")).alias("normative_flag"), ((t == "api") | (kind == "api")).alias("api_flag"), technology.alias("technology_flag"), F.sha1("content").alias("content_hash"))


#: Words of the four focuses of a query: fixed values.
FOCUS = {
    "integration_focus": ("integration", "интеграц", "api", "rest", "event", "queue", "webhook"),
    "technology_focus": ("docker", "kubernetes", "postgres", "redis", "python", "java", "runtime", "deployment", "infra"),
    "normative_focus": ("норм", "oda", "ig1242", "archimate", "compliance", "policy", "rule", "verification"),
    "component_focus": ("component", "boundary", "service", "module", "сервис", "компонент"),
}


@query("SELECT conv_id, turn, regexp_matches(lower(text), 'integration|интеграц|api|rest|event|queue|webhook') AS integration_focus, regexp_matches(lower(text), 'docker|kubernetes|postgres|redis|python|java|runtime|deployment|infra') AS technology_focus, regexp_matches(lower(text), 'норм|oda|ig1242|archimate|compliance|policy|rule|verification') OR role = 'assistant' AS normative_focus, regexp_matches(lower(text), 'component|boundary|service|module|сервис|компонент') AS component_focus FROM conversations")
def query_profile(spark, sf):
    """What a query is about; a verification (here: an assistant's turn) is always normative."""
    flags = {n: X.contains_any(F.lower("text"), w) for n, w in FOCUS.items()}
    flags["normative_focus"] = flags["normative_focus"] | (F.col("role") == "assistant")
    return table(spark, sf, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in flags.items()])


@query(f"""WITH {FRAGMENTS_SQL} SELECT doc_id, round(source_weight::DOUBLE * CASE WHEN fragment_type = 'component' THEN 1.18::DOUBLE ELSE 1 END * CASE WHEN document_type = 'technology' THEN 1.05::DOUBLE ELSE 1 END, 4) AS weight FROM frag""")
def weight_boost(spark, sf):
    """A fragment's weight, more for the asked section (here: component) and for methodology (here: technology)."""
    boost = F.when(F.col("fragment_type") == "component", 1.18).otherwise(1.0) * F.when(F.col("document_type") == "technology", 1.05).otherwise(1.0)
    return fragments(spark, sf).select("doc_id", F.round(F.col("source_weight") * boost, 4).alias("weight"))


@query("""WITH c AS (SELECT source, count(*) AS fragments, count(*) FILTER (lang = 'en') AS required, len(list_intersect(['de', 'en', 'pt'], list_distinct(list(lang)))) / 3 AS ratio FROM documents GROUP BY ALL)
SELECT source, round(ratio, 3) AS ratio, fragments >= 2 AND required >= 1 AND ratio >= 0.5 AS sufficient, fragments >= 2 AS sufficient_without_roles FROM c""")
def coverage_gate(spark, sf):
    """Whether what was found covers enough of the required roles (here: languages)."""
    roles = F.array(*map(F.lit, ("de", "en", "pt")))
    c = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("r"), F.size(F.array_intersect(roles, F.collect_set("lang"))).alias("k"))
    ratio = F.col("k") / 3
    return c.select("source", F.round(ratio, 3).alias("ratio"), ((F.col("n") >= 2) & (F.col("r") >= 1) & (ratio >= 0.5)).alias("sufficient"), (F.col("n") >= 2).alias("sufficient_without_roles"))


@query(f"""WITH {FRAGMENTS_SQL}, t AS (SELECT doc_id, title, document_type, fragment_type, unnest(list_distinct([fragment_type, document_type])) AS tag FROM frag), d AS (SELECT unnest(['api', 'component', 'technology', 'roadmap']) AS section),
k AS (SELECT tag, map_from_entries(list((document_type, n) ORDER BY document_type)) AS kinds FROM (SELECT tag, document_type, count(*) AS n FROM t GROUP BY ALL) GROUP BY tag),
ti AS (SELECT tag, list(title ORDER BY place)[1:5] AS titles FROM (SELECT tag, title, min(doc_id) AS place FROM t WHERE trim(title) <> '' GROUP BY ALL) GROUP BY tag),
c AS (SELECT tag, count(*) AS n, count(*) FILTER (document_type = 'technology') AS m FROM t GROUP BY tag)
SELECT section, coalesce(n, 0) AS fragments, coalesce(m, 0) AS methodology, coalesce(array_to_string(map_values(kinds), ','), '') AS kind_counts, coalesce(titles, []) AS titles FROM d LEFT JOIN c ON c.tag = section LEFT JOIN k ON k.tag = section LEFT JOIN ti ON ti.tag = section""")
def guidance_by_section(spark, sf):
    """Fragments of each section by their tags: counts, kinds, the first five titles; sections without any have zeros."""
    t = fragments(spark, sf).select("doc_id", "title", "document_type", F.explode(F.array_distinct(F.array("fragment_type", "document_type"))).alias("section"))
    kinds = t.groupBy("section", "document_type").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("document_type", "n"))).alias("kinds"))
    titles = t.where(F.trim("title") != "").groupBy("section", "title").agg(F.min("doc_id").alias("at"))
    first = titles.withColumn("r", F.row_number().over(Window.partitionBy("section").orderBy("at"))).where("r <= 5")
    first = first.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("at", "title"))).alias("titles"))
    counts = t.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("document_type") == "technology").alias("m"))
    sections = spark.sql("SELECT explode(array('api', 'component', 'technology', 'roadmap')) AS section")
    rows = sections.join(counts, "section", "left").join(kinds, "section", "left").join(first, "section", "left")
    return rows.select(
        "section", F.coalesce("n", F.lit(0)).alias("fragments"), F.coalesce("m", F.lit(0)).alias("methodology"),
        F.coalesce(F.array_join(F.transform("kinds", lambda x: x["n"].cast("string")), ","), F.lit("")).alias("kind_counts"),
        F.coalesce(F.transform("titles", lambda x: x["title"]), F.array().cast("array<string>")).alias("titles"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AS excluded FROM events")
def excluded_sources(spark, sf):
    """The flag of a metadata key (here: k above 50)."""
    return table(spark, sf, "events").select("event_id", (F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint") > 50).alias("excluded"))


@query("""WITH pairs AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem),
asked AS (SELECT o_custkey AS a, o_orderkey % 200 AS b, o_orderkey FROM orders)
SELECT o_orderkey, EXISTS (SELECT 1 FROM pairs WHERE pairs.a = least(asked.a, asked.b) AND pairs.b = greatest(asked.a, asked.b)) AS linked FROM asked""")
def undirected_links(spark, sf):
    """C20: whether an edge joins two sides in either direction: edges are turned to one direction, then one semi join."""
    ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).select(*ends).distinct()
    asked = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 200).alias("b")).select("o_orderkey", *ends)
    return asked.join(edges.withColumn("linked", F.lit(True)), ["a", "b"], "left").select("o_orderkey", F.coalesce("linked", F.lit(False)).alias("linked"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda s: s <> '') AS c FROM documents),
r AS (SELECT doc_id, 0 AS k, 0::BIGINT AS cursor, NULL::BIGINT AS start FROM l UNION ALL
SELECT doc_id, k + 1, CASE WHEN place > 0 THEN cursor + place - 1 + length(chunk) ELSE cursor END, CASE WHEN place > 0 THEN cursor + place - 1 END FROM (SELECT r.doc_id, k, cursor, c[k + 1] AS chunk, instr(substr(text, cursor + 1), substr(c[k + 1], 1, 80)) AS place FROM r JOIN l USING (doc_id) WHERE k < len(c)))
SELECT doc_id, k - 1 AS chunk, start FROM r WHERE k > 0""")
def chunk_offsets(spark, sf):
    """Where each line of a text begins, searched from where the one before ended."""
    lines = F.filter(F.split("text", "\n"), lambda s: s != "")
    found = table(spark, sf, "documents").select("doc_id", F.posexplode(E.start_offsets(F.col("text"), lines)).alias("chunk", "start"))
    return found.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.col("start").cast("bigint").alias("start"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, user_id::VARCHAR AS user_id FROM events")
def json_safe(spark, sf):
    """Values that JSON has no type for, as strings."""
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.col("user_id").cast("string").alias("user_id"))


@query("""WITH r AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500), c AS (SELECT event_type, count(*) AS n FROM r GROUP BY ALL)
SELECT count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed, round(avg(CASE WHEN event_type <> 'error' THEN value END), 3) AS mean_value, round(count(*) FILTER (event_type = 'error') / greatest(count(*), 1), 3) AS failed_share,
(SELECT array_to_string(list(event_type || '=' || n ORDER BY event_type), ',') FROM c) AS by_status, max(value) AS longest FROM r""")
def metrics_snapshot(spark, sf):
    """Counts, means and distribution of the last 500 rows, which is the feature's window."""
    last = table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    by = last.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("event_type") != "error", F.col("value"))).alias("s"), F.count(F.when(F.col("event_type") != "error", F.col("value"))).alias("k"), F.max("value").alias("m"))
    failed = F.coalesce(F.sum(F.when(F.col("event_type") == "error", F.col("n"))), F.lit(0))
    pairs = F.array_sort(F.collect_list(F.concat_ws("=", "event_type", F.col("n").cast("string"))))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("runs"), failed.alias("failed"), F.round(F.sum("s") / F.sum("k"), 3).alias("mean_value"),
        F.round(failed / F.greatest(F.sum("n"), F.lit(1)), 3).alias("failed_share"), F.array_join(pairs, ",").alias("by_status"), F.max("m").alias("longest"),
    )


@query("""WITH j AS (SELECT event_id, '{"backend": "' || event_type || '", "timings": {"vector_ms": ' || value || ', "load_ms": null}, "counts": {"fused": ' || event_id % 7 || '}}' AS d FROM events)
SELECT event_id, json_extract_string(d, '$.backend') AS backend, CAST(json_extract_string(d, '$.timings.vector_ms') AS DOUBLE) AS vector_ms, coalesce(CAST(json_extract_string(d, '$.timings.load_ms') AS DOUBLE), 0) AS load_ms, CAST(json_extract_string(d, '$.counts.fused') AS BIGINT) AS fused FROM j""")
def retrieval_telemetry(spark, sf):
    """Nested diagnostics of a search as flat columns; missing timings are zero."""
    said = F.to_json(F.struct(F.col("event_type").alias("backend"), F.struct(F.col("value").alias("vector_ms")).alias("timings"), F.struct((F.col("event_id") % 7).alias("fused")).alias("counts")))
    d = F.from_json(said, "backend string, timings struct<vector_ms double, load_ms double>, counts struct<fused bigint>")
    return table(spark, sf, "events").select("event_id", d.alias("d")).select("event_id", "d.backend", "d.timings.vector_ms", F.coalesce("d.timings.load_ms", F.lit(0.0)).alias("load_ms"), "d.counts.fused")


_LEGAL, _DOMAIN = ("all rights reserved", "licensed under", "without warranty", "copyright"), ("the ", "und ")


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS compact FROM documents),
k AS (SELECT *, regexp_extract_all(compact, '[\p{L}\p{N}_]+') AS tokens, sha1(substr(trim(regexp_replace(regexp_replace(' ' || regexp_replace(lower(compact), '[^\p{L}\p{N}_]+', '  ', 'g') || ' ', ' \d{1,4} ', ' ', 'g'), '\s+', ' ', 'g')), 1, 4000)) AS signature,
  list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS lines, contains(lower(x), 'table of contents') OR contains(lower(x), 'содержание') AS titled,
  len(list_filter(['all rights reserved', 'licensed under', 'without warranty', 'copyright'], lambda m: contains(lower(compact), m))) AS legal, len(list_filter(['the ', 'und '], lambda m: contains(lower(compact), m))) AS domain FROM t),
f AS (SELECT *, len(tokens) <= 4 AND NOT regexp_matches(array_to_string(tokens, ''), '\p{L}') AS low, len(list_filter(lines, lambda l: regexp_matches(regexp_replace(l, '\s+', ' ', 'g'), '(?i)\.{3,}|\s(?:[ivxlcdm]+|\d{1,4})$'))) AS toc FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN compact <> '' AND NOT low THEN signature ELSE doc_id::VARCHAR END ORDER BY doc_id) AS nth FROM f)
SELECT doc_id, CASE WHEN compact = '' THEN 'empty_page' WHEN low THEN 'low_information_page' WHEN nth > 1 THEN 'duplicate_page'
  WHEN len(lines) >= 6 AND CASE WHEN titled THEN toc >= 5 OR toc / len(lines) >= 0.45 ELSE toc >= 8 AND toc / len(lines) >= 0.55 END THEN 'table_of_contents'
  WHEN contains(lower(compact), 'all rights reserved') AND contains(lower(compact), 'evaluation copy') AND contains(lower(compact), 'not for redistribution') AND len(tokens) <= 90 THEN 'legal_disclaimer'
  WHEN (legal >= 2 OR contains(lower(compact), 'legal disclaimer') OR contains(lower(compact), 'отказ от ответственности')) AND (domain = 0 OR legal >= 5 OR legal / greatest(len(tokens), 1) >= 0.08) THEN 'legal_disclaimer' END AS reason FROM n""")
def skippable_pages(spark, sf):
    """Why a page says nothing: empty, low, repeated, contents, legal; null for the others."""
    return PF.classified(table(spark, sf, "documents"), legal=_LEGAL, domain=_DOMAIN)


@query("""WITH q AS (SELECT conv_id, turn AS asked, text AS quote, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 2)) AS qt FROM conversations WHERE role = 'user' AND length(trim(text)) >= 12),
f AS (SELECT conv_id, turn, text, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 2)) AS ft FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, asked, turn, CASE WHEN contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(quote), '\\s+', ' ', 'g'))) THEN length(trim(regexp_replace(quote, '\\s+', ' ', 'g'))) WHEN len(list_intersect(qt, ft)) >= greatest(3, least(len(qt), 6) // 2) THEN len(list_intersect(qt, ft)) ELSE 0 END AS score FROM q JOIN f USING (conv_id))
SELECT conv_id, asked, arg_max(turn, (score, -turn)) AS turn, max(score) AS score FROM s WHERE score > 0 GROUP BY ALL""".replace("\\\\", "\\"))
def argmax_match(spark, sf):
    """The answer that holds a quote, or shares most of its words; one aggregate per quote."""
    c = table(spark, sf, "conversations")
    q = c.where("role = 'user'").select("conv_id", F.col("turn").alias("asked"), F.col("text").alias("quote")).where(F.char_length(F.trim("quote")) >= 12)
    rows = q.join(c.where("role = 'assistant'").select("conv_id", "turn", "text"), "conv_id")
    score = E.quote_score(F.col("quote"), F.col("text"))
    best = rows.select("conv_id", "asked", "turn", score.alias("score")).where("score > 0").groupBy("conv_id", "asked").agg(F.max(F.struct("score", (-F.col("turn")).alias("t"))).alias("m"))
    return best.select("conv_id", "asked", (-F.col("m.t")).alias("turn"), F.col("m.score").alias("score"))


@query()
def chunk_importance(spark, sf):
    """How much each document's paragraphs say."""
    rows = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("c")).select("doc_id", F.element_at("c", 1).alias("title"), F.size("c").alias("total"), F.posexplode("c").alias("chunk", "content"))
    rows = E.with_sentences(rows, F.col("content"), CATALOGUE, 12)
    score = E.importance(F.col("sentences"), F.col("content"), F.col("title"), F.lit("section"), F.col("chunk"), F.col("total"), CATALOGUE)
    return rows.select("doc_id", "chunk", F.round(score, 6).alias("importance"))

"""Queries of the knowledge side: listings, scopes, selections, classifiers, graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import relational as O
from tessera.operators import versions as V

from . import versions as P
from .base import query, table


@query(f"""WITH {P._V1}, {P._V2}, pr AS (SELECT doc_id, count(*) AS runs FROM labels GROUP BY ALL)
SELECT v2.doc_id, CASE WHEN v1.doc_id IS NULL THEN 'new' WHEN v1.checksum = v2.checksum THEN 'unchanged' ELSE 'changed' END AS state, coalesce(runs, 0) AS runs FROM v2 LEFT JOIN v1 ON v1.doc_id = v2.doc_id LEFT JOIN pr ON pr.doc_id = v2.doc_id
UNION ALL SELECT v1.doc_id, CASE WHEN v1.doc_id % 4 = 1 THEN 'archived' ELSE 'deleted' END, 0 FROM v1 WHERE doc_id NOT IN (SELECT doc_id FROM v2)""")
def document_listing(spark, sf):
    """The documents of a version with their changes, and tombstones of those it lost."""
    old, new = P.before(spark, sf), P.after(spark, sf)
    runs = table(spark, sf, "labels").groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"))
    was = old.select("doc_id", F.col("checksum").alias("old"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("checksum"), "unchanged").otherwise("changed")
    now = new.join(was, "doc_id", "left").join(runs, "doc_id", "left").select("doc_id", state.alias("state"), F.coalesce("runs", F.lit(0)).cast("bigint").alias("runs"))
    gone = old.join(new.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.when(F.col("doc_id") % 4 == 1, "archived").otherwise("deleted").alias("state"), F.lit(0).cast("bigint").alias("runs"))
    return now.unionByName(gone)


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN o_orderkey END AS selected, o_orderkey AS active, o_orderstatus FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY ALL) ON c_custkey = o_custkey)
SELECT c_custkey, coalesce(selected, CASE WHEN o_orderstatus IN ('F', 'O') THEN active END, -1) AS scope FROM s""")
def effective_scope(spark, sf):
    """The selected version, else the active one if it may be chosen, else none."""
    latest = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderkey", "o_orderstatus")).alias("o"))
    rows = table(spark, sf, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
    selected = F.when(F.col("c_custkey") % 3 == 0, F.col("o.o_orderkey"))
    active = F.when(F.col("o.o_orderstatus").isin("F", "O"), F.col("o.o_orderkey"))
    return rows.select("c_custkey", F.coalesce(selected, active, F.lit(-1)).alias("scope"))


@query("""WITH c AS (SELECT l_orderkey, l_shipdate, max(l_linenumber) AS chunk FROM lineitem GROUP BY ALL)
SELECT i.l_orderkey, i.l_linenumber, chunk FROM lineitem i LEFT JOIN c ON c.l_orderkey = i.l_orderkey AND c.l_shipdate = i.l_shipdate WHERE i.l_quantity > 30""")
def chunk_remap(spark, sf):
    """Items to the last chunk at their location."""
    lines = table(spark, sf, "lineitem")
    last = lines.groupBy("l_orderkey", "l_shipdate").agg(F.max("l_linenumber").alias("chunk"))
    return lines.where("l_quantity > 30").join(last, ["l_orderkey", "l_shipdate"], "left").select("l_orderkey", "l_linenumber", "chunk")


@query("SELECT doc_id, 'v2' AS version, sha256('v2' || '|' || doc_id) AS new_key FROM documents WHERE source IN ('src4', 'src5') UNION ALL SELECT doc_id, 'v1', sha256('v1' || '|' || doc_id) FROM documents WHERE source IN ('src4', 'src5')")
def artifact_clone(spark, sf):
    """Artefacts copied into a new version under new keys."""
    old = table(spark, sf, "documents").where(F.col("source").isin("src4", "src5")).select("doc_id", F.lit("v1").alias("version"))
    both = old.unionByName(old.withColumn("version", F.lit("v2")))
    return both.withColumn("new_key", F.sha2(F.concat_ws("|", "version", F.col("doc_id").cast("string")), 256))


@query("""WITH a AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 4 = 0 THEN user_id % 9 END AS corr FROM events), r AS (SELECT DISTINCT user_id AS run FROM events),
h AS (SELECT run, event_id, ts FROM r JOIN a ON a.corr = r.run), f AS (SELECT run, event_id, ts FROM r JOIN a ON a.user_id = r.run WHERE run NOT IN (SELECT run FROM h)),
b AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts DESC, event_id) AS rn FROM (SELECT * FROM h UNION ALL SELECT * FROM f)) SELECT run, event_id FROM b WHERE rn <= 50""")
def run_detail(spark, sf):
    """Audit rows by correlation, else by target; the newest fifty of each run."""
    a = table(spark, sf, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 4 == 0, F.col("user_id") % 9).alias("corr"))
    runs = a.select(F.col("user_id").alias("run")).distinct()
    by_corr = a.where("corr is not null").join(runs, F.col("corr") == F.col("run")).select("run", "event_id", "ts")
    by_target = a.select(F.col("user_id").alias("run"), "event_id", "ts").join(by_corr.select("run").distinct(), "run", "left_anti")
    return O.capped_per_key(by_corr.unionByName(by_target), ["run"], [F.desc("ts"), F.asc("event_id")], 50).select("run", "event_id")


@query("""SELECT source, count(*) AS documents, list_sort(list(doc_id)) AS doc_ids, count(quality) AS processed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def source_snapshot(spark, sf):
    """Each source with its documents nested."""
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.array_sort(F.collect_list("doc_id")).alias("doc_ids"), F.count("quality").alias("processed"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'warning' ELSE 'info' END AS tone, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END, o_orderdate) AS created FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000""")
def run_notifications(spark, sf):
    """Tones and times of the visible runs."""
    rich = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    tone = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "warning").otherwise("info")
    created = F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")), "o_orderdate")
    return table(spark, sf, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey", tone.alias("tone"), created.alias("created"))


@query("""WITH c AS (SELECT source, count(*) AS fragments, count(*) FILTER (n_chars > 2000) AS long, count(*) FILTER (lang = 'de') AS german FROM documents GROUP BY ALL)
SELECT source, CASE WHEN fragments < 2 THEN 'no_fragments' WHEN long = 0 THEN 'no_candidates' WHEN german = 0 THEN 'filtered' ELSE 'found' END AS cause FROM c""")
def empty_cause(spark, sf):
    """The first cause that holds."""
    c = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 2000).alias("long"), F.count_if(F.col("lang") == "de").alias("de"))
    return c.select("source", F.when(F.col("n") < 2, "no_fragments").when(F.col("long") == 0, "no_candidates").when(F.col("de") == 0, "filtered").otherwise("found").alias("cause"))


@query("""WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), m AS (SELECT source, min(rank) FILTER (lang = 'de') AS de, min(rank) FILTER (lang = 'fr') AS fr FROM r GROUP BY ALL)
SELECT doc_id, CASE WHEN rank = de THEN 'required_basis' WHEN rank = fr THEN 'normative_match' ELSE 'score' END AS reason FROM r JOIN m USING (source) WHERE rank <= 12""")
def selection_reason(spark, sf):
    """The first of each kind names its reason."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    # the limit reaches below the shuffle; a first of its kind further down names no reason
    best = O.capped_per_key(docs, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 12)
    w = Window.partitionBy("source", "lang").orderBy(F.desc("n_chars"), "doc_id")
    first = F.row_number().over(w) == 1
    reason = F.when(first & (F.col("lang") == "de"), "required_basis").when(first & (F.col("lang") == "fr"), "normative_match").otherwise("score")
    return best.select("doc_id", reason.alias("reason"))


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS k FROM documents), o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, n_chars DESC, doc_id) AS pos FROM b)
SELECT doc_id, source, pos AS position FROM o WHERE pos <= 6""")
def one_per_section(spark, sf):
    """The best of every section first, then the best of the rest up to a limit."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    order = F.struct(-F.col("n_chars"), F.col("doc_id"))
    first = docs.groupBy("source", "lang").agg(F.min(order).alias("x")).select("source", F.lit(0).alias("later"), "x")
    # the six best of a source are enough to fill up with; those that are the best of a section come once
    rest = O.capped_per_key(docs, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 6).select("source", F.lit(1).alias("later"), order.alias("x"))
    both = first.unionByName(rest).groupBy("source", "x").agg(F.min("later").alias("later"))
    pos = F.row_number().over(Window.partitionBy("source").orderBy("later", "x"))
    return both.withColumn("p", pos).where("p <= 6").select(F.col("x.doc_id").alias("doc_id"), "source", F.col("p").cast("bigint").alias("position"))


@query("""WITH need AS (SELECT DISTINCT source FROM documents), have AS (SELECT DISTINCT source FROM documents WHERE lang = 'de'), miss AS (SELECT source FROM need WHERE source NOT IN (SELECT source FROM have))
SELECT source, min(doc_id) AS doc_id FROM documents WHERE source IN (SELECT source FROM miss) OR source = 'src7' GROUP BY ALL""")
def role_fallback(spark, sf):
    """The oldest fragment of each role that a selection lacks."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    have = docs.where("lang = 'de' and source <> 'src7'").select("source").distinct()
    return docs.join(have, "source", "left_anti").groupBy("source").agg(F.min("doc_id").alias("doc_id"))


@query("""WITH f AS (SELECT conv_id, min(turn) FILTER (role = 'system') AS s, min(turn) FILTER (role = 'user') AS u, min(turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY ALL)
SELECT conv_id, s AS source, u AS target, 'system-user' AS kind FROM f WHERE s IS NOT NULL AND u IS NOT NULL UNION ALL SELECT conv_id, u, a, 'user-assistant' FROM f WHERE u IS NOT NULL AND a IS NOT NULL""")
def default_edges(spark, sf):
    """Edges between the first members of fixed pairs of classes."""
    roles = ("system", "user", "assistant")
    f = table(spark, sf, "conversations").groupBy("conv_id").agg(*[F.min(F.when(F.col("role") == r, F.col("turn"))).alias(r) for r in roles])
    pairs = F.array(*[F.struct(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(f"{a}-{b}").alias("kind")) for a, b in zip(roles, roles[1:], strict=False)])
    return f.select("conv_id", F.explode(pairs).alias("e")).where("e.source is not null and e.target is not null").select("conv_id", "e.*")


@query("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn, text) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS first, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS last FROM conversations)
SELECT conv_id, turn, first = 1 OR last = 1 AS forced FROM r WHERE first = 1 OR last = 1 OR k <= 2""")
def forced_ends(spark, sf):
    """the first and the last chunk and the best of the others."""
    w = Window.partitionBy("conv_id")
    r = table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.row_number().over(w.orderBy(F.desc(F.char_length("text")), "turn", "text")).alias("k"),
        F.row_number().over(w.orderBy("turn", "text")).alias("first"),
        F.row_number().over(w.orderBy(F.desc("turn"), F.desc("text"))).alias("last"),
    )
    forced = (F.col("first") == 1) | (F.col("last") == 1)
    return r.where(forced | (F.col("k") <= 2)).select("conv_id", "turn", forced.alias("forced"))


@query("""SELECT conv_id, string_agg(role, '>' ORDER BY CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 10000 END, turn) AS ordered FROM conversations GROUP BY ALL""")
def canonical_order(spark, sf):
    """Parts in a fixed order, unknown ones last."""
    place = F.coalesce(*[F.when(F.col("role") == r, F.lit(k)) for k, r in enumerate(("system", "user", "assistant"), 1)], F.lit(10000))
    rows = F.array_sort(F.collect_list(F.struct(place.alias("p"), "turn", "role")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["role"]), ">").alias("ordered"))


@query("""SELECT doc_id, coalesce(CASE WHEN doc_id % 13 = 0 THEN 'explicit' END, CASE WHEN contains(lower(text), 'license') THEN 'normative' END, CASE WHEN lang = 'de' THEN 'technology_standard' WHEN source IN ('src1', 'src2') THEN 'template' END, 'reference_only') AS role FROM documents""")
def basis_roles(spark, sf):
    """The explicit role, else by words, else by type, else for reference only."""
    by_type = F.when(F.col("lang") == "de", "technology_standard").when(F.col("source").isin("src1", "src2"), "template")
    role = F.coalesce(F.when(F.col("doc_id") % 13 == 0, "explicit"), F.when(F.contains(F.lower("text"), F.lit("license")), "normative"), by_type, F.lit("reference_only"))
    return table(spark, sf, "documents").select("doc_id", role.alias("role"))


@query(r"""WITH m AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'HTTP 503 from host' WHEN 1 THEN 'Read timed out' WHEN 2 THEN 'file is too large: ' || value WHEN 3 THEN 'unsupported suffix' WHEN 4 THEN 'error ' || event_id ELSE event_type END AS message FROM events)
SELECT event_id, CASE WHEN contains(lower(message), 'timed out') THEN 'TIMEOUT' WHEN contains(lower(message), 'too large') THEN 'SIZE_LIMIT' WHEN contains(lower(message), 'unsupported') THEN 'UNSUPPORTED' WHEN regexp_matches(message, '\b[45]\d\d\b') THEN 'HTTP_ERROR' ELSE 'UNKNOWN' END AS code FROM m""")
def error_codes(spark, sf):
    """Ordered rules from message to code."""
    n = F.col("event_id") % 6
    message = (
        F.when(n == 0, "HTTP 503 from host").when(n == 1, "Read timed out").when(n == 2, F.concat(F.lit("file is too large: "), F.col("value").cast("string")))
        .when(n == 3, "unsupported suffix").when(n == 4, F.concat(F.lit("error "), F.col("event_id").cast("string"))).otherwise(F.col("event_type"))
    )
    low = F.lower("m")
    code = F.when(F.contains(low, F.lit("timed out")), "TIMEOUT").when(F.contains(low, F.lit("too large")), "SIZE_LIMIT").when(F.contains(low, F.lit("unsupported")), "UNSUPPORTED")
    return table(spark, sf, "events").select("event_id", message.alias("m")).select("event_id", code.when(F.col("m").rlike(r"\b[45]\d\d\b"), "HTTP_ERROR").otherwise("UNKNOWN").alias("code"))


@query(r"""WITH p AS (SELECT p_partkey, lower(p_type) || ' ' || p_size || '.' || p_partkey % 7 AS phrase, p_partkey % 5 = 0 AS prohibited FROM part)
SELECT p_partkey, regexp_extract(phrase, '^(\S+)', 1) AS product, list_transform(regexp_extract_all(regexp_extract(phrase, '(\d+(?:\.\d+)*)$', 1), '(\d+)', 1), lambda x: CAST(x AS INTEGER)) AS version, prohibited FROM p""")
def technology_policy(spark, sf):
    """Product and version out of a policy's phrase."""
    phrase = F.concat(F.lower("p_type"), F.lit(" "), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"))
    numbers = F.regexp_extract_all(F.regexp_extract("phrase", r"(\d+(?:\.\d+)*)$", 1), F.lit(r"(\d+)"), F.lit(1))
    rows = table(spark, sf, "part").select("p_partkey", phrase.alias("phrase"), (F.col("p_partkey") % 5 == 0).alias("prohibited"))
    return rows.select("p_partkey", F.regexp_extract("phrase", r"^(\S+)", 1).alias("product"), F.transform(numbers, lambda x: x.cast("int")).alias("version"), "prohibited")


@query("""WITH u AS (SELECT label AS space, count(*) AS used, max(vec_id) AS newest FROM embeddings GROUP BY ALL)
SELECT CAST(coalesce(max(CASE WHEN space = 99 THEN space END), max(CASE WHEN space = 3 THEN space END), arg_max(space, newest)) AS INTEGER) AS space FROM u""")
def embedding_space(spark, sf):
    """The version's space if used, else the active one, else the newest used."""
    u = table(spark, sf, "embeddings").groupBy(F.col("label").alias("space")).agg(F.max("vec_id").alias("newest"))
    pick = lambda n: F.max(F.when(F.col("space") == n, F.col("space")))
    return u.agg(F.coalesce(pick(99), pick(3), F.max_by("space", "newest")).alias("space"))


@query("""WITH f AS (SELECT doc_id, source, (CASE WHEN lang = 'en' THEN 5000 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 2000 ELSE 0 END + CASE WHEN n_chars > 1000 THEN 1000 ELSE 0 END + 250 * least(4, n_chars // 500)) - 0.001::DOUBLE * doc_id AS s FROM documents)
SELECT source, arg_max(doc_id, (round(s, 6), -doc_id)) AS doc_id FROM f WHERE s > 0 GROUP BY ALL""")
def section_fragment(spark, sf):
    """The fragment of the largest weighted score of each section, if any signal is there."""
    score = (
        F.when(F.col("lang") == "en", 5000).otherwise(0) + F.when(F.contains(F.lower("text"), F.lit("license")), 2000).otherwise(0)
        + F.when(F.col("n_chars") > 1000, 1000).otherwise(0) + 250 * F.least(F.lit(4), F.floor(F.col("n_chars") / 500)) - 0.001 * F.col("doc_id")
    )
    f = table(spark, sf, "documents").select("doc_id", "source", F.round(score, 6).alias("s")).where("s > 0")
    return f.groupBy("source").agg(F.max_by("doc_id", F.struct("s", (-F.col("doc_id")).alias("n"))).alias("doc_id"))


@query(f"""WITH {P._V1}, {P._V2}, b AS (SELECT source, min(checksum) AS c1 FROM v1 GROUP BY ALL), a AS (SELECT source, min(checksum) AS c2 FROM v2 GROUP BY ALL)
SELECT coalesce(a.source, b.source) AS source, c1 IS DISTINCT FROM c2 AS replaced FROM a FULL JOIN b ON a.source = b.source""")
def scope_change(spark, sf):
    """Sources whose first artefact was replaced."""
    first = lambda df, n: df.groupBy("source").agg(F.min("checksum").alias(n))
    found = V.diff(first(P.before(spark, sf), "checksum"), first(P.after(spark, sf), "checksum"), key="source")
    return found.select("source", (F.col("change") != "unchanged").alias("replaced"))


@query("SELECT doc_id, word_count, least(1800, greatest(400, CAST(ceil(n / 2560) AS BIGINT))) AS target, n >= 20000 AS large FROM (SELECT doc_id, strlen(text) AS n, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS word_count FROM documents)".replace("\\\\", "\\"))
def adaptive_chunking(spark, sf):
    """Bigger chunks for larger documents."""
    n = F.octet_length("text")
    words = F.size(F.split(X.squeezed(F.col("text")), " ")).cast("bigint")
    return table(spark, sf, "documents").select("doc_id", words.alias("word_count"), F.least(F.lit(1800), F.greatest(F.lit(400), F.ceil(n / 2560))).cast("bigint").alias("target"), (n >= 20000).alias("large"))


@query()
def near_duplicate_bodies(spark, sf):
    """Turns that are nearly an earlier distinct turn of their conversation, and the first such."""
    from tessera.functions.similar import first_matches

    return first_matches(table(spark, sf, "conversations").select("conv_id", "turn", "text"))


_PHRASE = "' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' '".replace("\\\\", "\\")


@query(f"""WITH e AS (SELECT doc_id, lang, list_filter(['Limit', 'Place', 'Terms'], lambda x: CASE x WHEN 'Limit' THEN contains({_PHRASE}, ' only ') WHEN 'Place' THEN contains({_PHRASE}, ' entre ') OR contains({_PHRASE}, ' to the ') ELSE contains({_PHRASE}, ' license ') END) AS found, coalesce(text ~ '(?s).*\\S.*', false) AS told FROM documents),
a AS (SELECT * FROM (VALUES ('en', ['Limit', 'Terms']), ('fr', ['Place'])) AS a(lang, elements))
SELECT doc_id, found, CASE WHEN elements IS NULL THEN [] ELSE list_filter(found, lambda x: NOT list_contains(elements, x)) END AS disallowed, CASE WHEN elements IS NULL THEN told ELSE len(list_intersect(found, elements)) > 0 END AS aligned FROM e LEFT JOIN a USING (lang)""")
def ontology_alignment(spark, sf):
    """H43, VR-NRM-02/05/06: elements of a vocabulary in texts, against what their section allows."""
    from tessera.operators import ontology

    aliases = (("Limit", "only"), ("Place", "entre"), ("Place", "to the"), ("Terms", "license"))
    allowed = spark.sql("SELECT * FROM VALUES ('en', array('Limit', 'Terms')), ('fr', array('Place')) AS a(lang, elements)")
    return ontology.align(table(spark, sf, "documents"), allowed, aliases, section="lang").select("doc_id", "found", "disallowed", "aligned")

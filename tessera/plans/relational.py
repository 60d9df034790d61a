"""Relational reads over the master-detail tables and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import relational as O

from .base import query, table


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE (o_orderstatus = 'O' OR o_custkey = 7 OR nullif(o_orderpriority, '5-LOW') IS NULL) AND o_totalprice >= 1000")
def visibility_or(spark, sf):
    """B1: a disjunction with a null test."""
    o = table(spark, sf, "orders")
    owner = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return o.where(((F.col("o_orderstatus") == "O") | (F.col("o_custkey") == 7) | owner.isNull()) & (F.col("o_totalprice") >= 1000)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def dynamic_filter(spark, sf):
    """B2: equalities of the given arguments only."""
    return table(spark, sf, "orders").where(O.conjunction({"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": None})).select("o_orderkey", "o_custkey")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click')")
def not_in_statuses(spark, sf):
    """B3."""
    return table(spark, sf, "events").where(~F.col("event_type").isin("view", "click")).select("event_id", "event_type")


@query("SELECT l_orderkey, count(*) AS lines, list_sort(list(l_linenumber)) AS numbers FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH') GROUP BY ALL")
def regroup_by_key(spark, sf):
    """The rows of many keys, as one list a key."""
    chosen = table(spark, sf, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = O.scoped(table(spark, sf, "lineitem"), "l_orderkey", chosen)
    return lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.array_sort(F.collect_list("l_linenumber")).alias("numbers"))


@query("""WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, c_nationkey FROM customer),
s AS (SELECT nullif(c_mktsegment, 'BUILDING') AS seg, count(*) AS members FROM customer GROUP BY 1)
SELECT c_custkey, c.seg, members FROM c JOIN s ON c.seg IS NOT DISTINCT FROM s.seg""")
def null_safe_match(spark, sf):
    """A join in which null equals null."""
    seg = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("seg")
    c = table(spark, sf, "customer").select("c_custkey", seg)
    s = c.groupBy(F.col("seg").alias("seg2")).agg(F.count(F.lit(1)).alias("members"))
    return c.join(s, F.col("seg").eqNullSafe(F.col("seg2"))).select("c_custkey", "seg", "members")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%an%' OR p_type ILIKE '%steel%'")
def ilike_any(spark, sf):
    """Any of several patterns without case."""
    return table(spark, sf, "part").where(F.col("p_name").ilike("%an%") | F.col("p_type").ilike("%steel%")).select("p_partkey", "p_name")


@query("SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90")
def json_predicate(spark, sf):
    """A predicate on a key of a JSON document."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").where(k >= 90).select("event_id", "user_id", k.alias("k"))


@query("""SELECT l_orderkey, l_linenumber, greatest(0, CAST(epoch(l_shipdate) AS BIGINT) - CAST(epoch(o_orderdate) AS BIGINT)) AS seconds
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 40""")
def duration(spark, sf):
    """Seconds between two times, none below zero."""
    lines = table(spark, sf, "lineitem").where("l_quantity >= 40").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    seconds = F.greatest(F.lit(0), F.unix_timestamp("l_shipdate") - F.unix_timestamp("o_orderdate"))
    return lines.select("l_orderkey", "l_linenumber", seconds.cast("bigint").alias("seconds"))


@query("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.code'), ''), nullif(event_type, 'view'), 'none') AS code FROM events")
def first_non_empty(spark, sf):
    """B9."""
    code = F.coalesce(F.nullif(F.get_json_object("props", "$.code"), F.lit("")), F.nullif(F.col("event_type"), F.lit("view")), F.lit("none"))
    return table(spark, sf, "events").select("event_id", code.alias("code"))


@query("SELECT user_id, coalesce(arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('error', 'click')), 'none') AS last_problem FROM events GROUP BY ALL")
def last_problem_step(spark, sf):
    """The last step that is a problem."""
    problem = F.when(F.col("event_type").isin("error", "click"), F.struct("ts", "event_id", "event_type"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.coalesce(F.max(problem).getField("event_type"), F.lit("none")).alias("last_problem"))


@query("SELECT event_id, CASE WHEN event_type = 'signup' THEN 'queued' WHEN event_type = 'purchase' AND value < 20 THEN 'incomplete' ELSE event_type END AS state FROM events")
def state_remap(spark, sf):
    """B11."""
    kind = F.col("event_type")
    state = F.when(kind == "signup", "queued").when((kind == "purchase") & (F.col("value") < 20), "incomplete").otherwise(kind)
    return table(spark, sf, "events").select("event_id", state.alias("state"))


@query("SELECT user_id, bool_or(event_type = 'signup' AND ts < TIMESTAMP '2024-01-29 00:00:00') AS overdue FROM events GROUP BY ALL")
def overdue_flag(spark, sf):
    """Whether any open row is older than a day at a given time."""
    old = F.col("ts") < F.lit("2024-01-29 00:00:00").cast(table(spark, sf, "events").schema["ts"].dataType)
    return table(spark, sf, "events").groupBy("user_id").agg(F.bool_or((F.col("event_type") == "signup") & old).alias("overdue"))


@query("SELECT doc_id, lang FROM documents WHERE contains(translate(lower(text), '_-', '  '), 'only') AND contains(translate(lower(text), '_-', '  '), 'the')")
def and_search(spark, sf):
    """Every token must occur."""
    return O.multi_search(table(spark, sf, "documents"), F.col("text"), ["only", "the"]).select("doc_id", "lang")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' AND lower(o_orderpriority) LIKE '%high%'")
def registry_filter(spark, sf):
    """Search, statuses and a range of dates."""
    o = table(spark, sf, "orders")
    when = lambda s: F.lit(s).cast(o.schema["o_orderdate"].dataType)
    return o.where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderdate") >= when("1995-01-01 00:00:00")) & (F.col("o_orderdate") < when("1997-01-01 00:00:00")) & F.contains(F.lower("o_orderpriority"), F.lit("high"))).select("o_orderkey")


@query("""WITH tr(from_state, to_state) AS (VALUES ('O', 'F'), ('O', 'P'), ('P', 'F')),
p AS (SELECT o_custkey, o_orderkey, o_orderstatus AS to_state, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS from_state FROM orders)
SELECT o_orderkey, p.from_state, p.to_state, tr.to_state IS NOT NULL AS allowed FROM p LEFT JOIN tr ON tr.from_state = p.from_state AND tr.to_state = p.to_state WHERE p.from_state IS NOT NULL""")
def lifecycle_transitions(spark, sf):
    """Successive states against the table of allowed transitions."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    steps = table(spark, sf, "orders").select("o_orderkey", F.lag("o_orderstatus").over(w).alias("from_state"), F.col("o_orderstatus").alias("to_state")).where("from_state is not null")
    allowed = F.struct("from_state", "to_state").isin(*[F.struct(F.lit(a).alias("from_state"), F.lit(b).alias("to_state")) for a, b in (("O", "F"), ("O", "P"), ("P", "F"))])
    return steps.select("o_orderkey", "from_state", "to_state", allowed.alias("allowed"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'archived' WHEN s_acctbal < 0 THEN 'disabled' WHEN s_nationkey = 3 THEN 'draft' WHEN s_acctbal > 9000 THEN 'unavailable' ELSE 'active' END AS status FROM supplier")
def availability_status(spark, sf):
    """The first state that holds."""
    status = F.when(F.col("s_suppkey") % 11 == 0, "archived").when(F.col("s_acctbal") < 0, "disabled").when(F.col("s_nationkey") == 3, "draft").when(F.col("s_acctbal") > 9000, "unavailable").otherwise("active")
    return table(spark, sf, "supplier").select("s_suppkey", status.alias("status"))


@query("""WITH vis AS (SELECT 'orders' AS kind, o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'part', p_partkey FROM part WHERE p_size > 40),
ev AS (SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN 'orders' ELSE 'part' END AS kind, event_id AS id FROM events)
SELECT event_id FROM ev WHERE user_id = 5 OR EXISTS (SELECT 1 FROM vis WHERE vis.kind = ev.kind AND vis.id = ev.id)""")
def polymorphic_visibility(spark, sf):
    """Rows whose target, of one of several kinds, is visible."""
    orders = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.lit("orders").alias("kind"), F.col("o_orderkey").alias("id"))
    parts = table(spark, sf, "part").where("p_size > 40").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"))
    events = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 2 == 0, "orders").otherwise("part").alias("kind"), F.col("event_id").alias("id"))
    seen = events.where("user_id <> 5").join(orders.unionByName(parts), ["kind", "id"], "left_semi")
    return events.where("user_id = 5").select("event_id").union(seen.select("event_id"))


@query("SELECT page_id, url[1:40] AS location, length(url) > 40 AS shortened FROM pages")
def fit_location(spark, sf):
    """A value cut to its column's length, with a flag."""
    return table(spark, sf, "pages").select("page_id", F.left("url", F.lit(40)).alias("location"), (F.char_length("url") > 40).alias("shortened"))


@query("SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size = 10")
def inner_join(spark, sf):
    """Equi-joins with a filter that reaches the scan."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part").where("p_size = 10"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'F') AND c_acctbal > 0) WHERE rn = 1")
def join_latest(spark, sf):
    """The latest matching row of each owner."""
    rich = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    found = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("O", "F")).join(rich, "o_custkey", "left_semi")
    return found.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("SELECT c_custkey, n_name, r_name, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def eager_load(spark, sf):
    """A left join counted before it is joined, with two small dimensions."""
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = table(spark, sf, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", "n_name", "r_name", F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"))


@query("""WITH pol AS (SELECT p_brand, max(p_size) AS below FROM part WHERE p_type LIKE '%STEEL%' OR p_size > 45 GROUP BY ALL)
SELECT p_partkey, part.p_brand, p_size, below FROM part JOIN pol ON part.p_brand = pol.p_brand AND p_size < below""")
def theta_below(spark, sf):
    """C14: versions below their product's bound; the equality keeps it a hash join."""
    parts = table(spark, sf, "part")
    policy = parts.where(F.col("p_type").like("%STEEL%") | (F.col("p_size") > 45)).groupBy("p_brand").agg(F.max("p_size").alias("below"))
    return parts.join(policy, "p_brand").where("p_size < below").select("p_partkey", "p_brand", "p_size", "below")


@query("""WITH k AS (SELECT DISTINCT p_brand, p_size FROM part), a AS (SELECT p_partkey AS id, p_brand, p_size FROM part)
SELECT id, a.p_brand, a.p_size, min(k.p_size) AS above FROM a LEFT JOIN k ON a.p_brand = k.p_brand AND k.p_size > a.p_size GROUP BY ALL""")
def nearest_above(spark, sf):
    """The next allowed version, as-of style."""
    parts = table(spark, sf, "part")
    asked = parts.select(F.col("p_partkey").alias("id"), "p_brand", "p_size")
    known = parts.select("p_brand", "p_size").distinct()
    return O.nearest_above(asked, known, "p_brand", "p_size")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)")
def orphan_refs(spark, sf):
    """References to rows that aren't there."""
    return O.orphans(table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part").where("p_size <= 45"), "p_partkey").select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND l_returnflag = 'R')")
def exists_not_exists(spark, sf):
    """Semi and anti join of one table."""
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    found = table(spark, sf, "supplier").join(lines, "s_suppkey", "left_semi")
    return found.join(lines.where("l_quantity = 50 and l_returnflag = 'R'"), "s_suppkey", "left_anti").select("s_suppkey")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE nullif(l_linestatus, 'F') IS DISTINCT FROM nullif(o_orderstatus, 'F')""")
def distinct_from(spark, sf):
    """Rows that differ from their parent, nulls compared."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.where(~F.nullif(F.col("l_linestatus"), F.lit("F")).eqNullSafe(F.nullif(F.col("o_orderstatus"), F.lit("F")))).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), c_mktsegment, 'default') AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def coalesce_update(spark, sf):
    """Values filled from a joined row, else a default."""
    rich = table(spark, sf, "customer").where("c_acctbal > 0")
    rows = table(spark, sf, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", F.coalesce(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), "c_mktsegment", F.lit("default")).alias("label"))


@query("""WITH a AS (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))) AS w FROM part),
c AS (SELECT DISTINCT p_brand, unnest(list_distinct(string_split(lower(p_type), ' '))) AS w FROM part)
SELECT a.p_partkey, c.p_brand, count(*) AS shared FROM a JOIN c USING (w) WHERE length(w) >= 4 GROUP BY ALL HAVING count(*) >= 2""")
def token_overlap(spark, sf):
    """Pairs that share three tokens of four letters, joined on the tokens."""
    words = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), " "))).alias("w")
    a = table(spark, sf, "part").select("p_partkey", words(F.concat_ws(" ", "p_name", "p_type")))
    c = table(spark, sf, "part").select("p_brand", words(F.col("p_type"))).distinct()
    return O.shared_tokens(a.where(F.char_length("w") >= 4), c, "p_partkey", "p_brand", "w").where("shared >= 2")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, sf):
    """The latest event of each user."""
    return O.first_per_key(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type NOT IN ('error', 'view')) WHERE rn = 1")
def latest_success(spark, sf):
    """E2."""
    ok = table(spark, sf, "events").where(~F.col("event_type").isin("error", "view"))
    return O.first_per_key(ok, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_orderdate END DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_finished(spark, sf):
    """The latest finished row, unfinished ones last."""
    finished = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return O.first_per_key(table(spark, sf, "orders"), ["o_custkey"], [finished.desc_nulls_last(), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT min(doc_id) AS oldest, max(doc_id) AS newest, count(*) AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def dedupe_newest(spark, sf):
    """Of rows with equal content the newest and the oldest."""
    groups = table(spark, sf, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("oldest"), F.max("doc_id").alias("newest"), F.count(F.lit(1)).alias("copies"))
    return groups.where("copies > 1").select("oldest", "newest", "copies")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def diversity_cap(spark, sf):
    """At most three of each key, in rank order."""
    return O.capped_per_key(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_custkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL AS current FROM orders")
def supersede_current(spark, sf):
    """Which row of a key is the current one."""
    from pyspark.sql import Window

    later = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", later.isNull().alias("current"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def offset_page(spark, sf):
    """one page in order."""
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(25)


@query("SELECT event_id, ts FROM events WHERE event_type = 'purchase' AND value > 50 ORDER BY ts DESC, event_id LIMIT 40")
def filter_then_limit(spark, sf):
    """the newest rows among those that pass."""
    return table(spark, sf, "events").where("event_type = 'purchase' and value > 50").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(40)


@query("SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size > 40 THEN 0 ELSE 1 END, p_brand, p_name, p_partkey) AS position FROM part QUALIFY position <= 30")
def flagged_order(spark, sf):
    """flagged rows first, then by name."""
    from pyspark.sql import Window

    top = table(spark, sf, "part").orderBy(F.when(F.col("p_size") > 40, 0).otherwise(1), "p_brand", "p_name", "p_partkey").limit(30)
    # thirty rows: the window is over the page, not over the table
    w = Window.orderBy(F.when(F.col("p_size") > 40, 0).otherwise(1), "p_brand", "p_name", "p_partkey")
    return top.select("p_partkey", F.row_number().over(w).cast("bigint").alias("position"))


@query("""SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS started FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 30)
UNION ALL SELECT * FROM (SELECT 'event', event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 30)
UNION ALL SELECT * FROM (SELECT 'line', l_orderkey * 10 + l_linenumber, l_shipdate FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber LIMIT 30)""")
def union_journal(spark, sf):
    """A bounded window of each of three kinds, in one shape."""

    def newest(df, kind, id_, at):
        return df.select(F.lit(kind).alias("kind"), id_.alias("id"), F.col(at).alias("started")).orderBy(F.desc("started"), "id").limit(30)

    orders = newest(table(spark, sf, "orders").where("o_orderstatus = 'P'"), "order", F.col("o_orderkey"), "o_orderdate")
    events = newest(table(spark, sf, "events").where("event_type = 'error'"), "event", F.col("event_id"), "ts")
    lines = newest(table(spark, sf, "lineitem").where("l_returnflag = 'R'"), "line", F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_shipdate")
    return orders.unionByName(events).unionByName(lines)


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48), b AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 48)
SELECT id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'common' END AS change FROM a FULL JOIN b USING (id)""")
def set_difference(spark, sf):
    """Keys that are added, removed or common."""
    keys = lambda flag, name: table(spark, sf, "lineitem").where((F.col("l_returnflag") == flag) & (F.col("l_quantity") > 48)).select(F.col("l_suppkey").alias("id")).distinct().withColumn(name, F.lit(True))
    both = keys("R", "a").join(keys("A", "b"), "id", "full")
    return both.select("id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("common").alias("change"))


@query("SELECT p_brand, arg_max(p_name, (length(p_name), -p_partkey)) AS name, max(p_retailprice) AS price, list_sort(list_distinct(list(p_type))) AS types FROM part GROUP BY ALL")
def merge_records(spark, sf):
    """One record a key; the longer text wins, the sets join."""
    best = F.max(F.struct(F.char_length("p_name").alias("n"), (-F.col("p_partkey")).alias("k"), "p_name")).getField("p_name")
    return table(spark, sf, "part").groupBy("p_brand").agg(best.alias("name"), F.max("p_retailprice").alias("price"), F.array_sort(F.collect_set("p_type")).alias("types"))


@query("SELECT lower(o_orderpriority) AS priority, list_sort(list_distinct(list(o_orderstatus))) AS statuses FROM orders GROUP BY ALL")
def distinct_sets(spark, sf):
    """The set of values of each key."""
    return table(spark, sf, "orders").groupBy(F.lower("o_orderpriority").alias("priority")).agg(F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"))

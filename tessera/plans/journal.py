"""Operational metrics over ``events``, ``orders``, ``lineitem`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import journal as J
from tessera.operators import relational as O

from .base import query, table


@query("SELECT o_custkey, coalesce(max(o_orderkey), 0) + 1 AS next FROM orders GROUP BY ALL")
def next_number(spark, sf):
    """D1."""
    return O.next_number(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey")


@query("SELECT user_id, s AS status, count(*) AS n FROM (SELECT user_id, nullif(event_type, 'view') AS s FROM events) WHERE s IS NOT NULL GROUP BY ALL")
def status_counts(spark, sf):
    """Counts by status, nulls in none."""
    rows = table(spark, sf, "events").select("user_id", F.nullif(F.col("event_type"), F.lit("view")).alias("status"))
    return O.status_counts(rows, ["user_id"], "status")


@query("""SELECT event_type, count(*) AS runs, round_even(avg(nullif(CASE WHEN value < 5 THEN NULL ELSE value END, NULL)), 3) AS avg_value,
round_even(count(*) FILTER (value < 5) / count(*), 3) AS empty_rate FROM events GROUP BY ALL""")
def quality_rollup(spark, sf):
    """Null-skipping means, and rates over all rows."""
    given = F.when(F.col("value") >= 5, F.col("value"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), J.mean(given).alias("avg_value"), F.bround(F.count_if(F.col("value") < 5) / F.count(F.lit(1)), 3).alias("empty_rate"))


@query("""WITH d AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY ALL),
l AS (SELECT user_id, arg_max(event_type, (round(v, 6), event_type)) AS longest FROM d GROUP BY ALL)
SELECT longest, count(*) AS users FROM l GROUP BY ALL""")
def longest_stage(spark, sf):
    """Histogram of each run's longest stage."""
    spent = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("v"))
    longest = spent.groupBy("user_id").agg(F.max_by("event_type", F.struct("v", "event_type")).alias("longest"))
    return longest.groupBy("longest").agg(F.count(F.lit(1)).alias("users"))


@query("""WITH s AS (SELECT event_type AS stage, event_id AS id, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
a AS (SELECT stage, count(*) AS count, round(sum(value), 3) AS total, round(avg(value), 3) AS avg, max(value) AS max, arg_max(value, (ts, id)) AS last,
min(epoch_us(ts)) AS first_start_us, max(epoch_us(ts) + CAST(trunc(value * 1000000) AS BIGINT)) AS last_finish_us FROM s GROUP BY ALL)
SELECT a.*, last_samples FROM a JOIN (SELECT stage, list(value ORDER BY ts, id) AS last_samples FROM s WHERE rn <= 3 GROUP BY ALL) USING (stage)""")
def stage_metrics(spark, sf):
    """The fold of stage samples."""
    samples = table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("event_id").alias("id"), F.col("ts").alias("started"), F.col("value").alias("duration"))
    return J.stage_metrics(samples)


@query("""SELECT user_id, count(*) AS steps, round(sum(value), 3) AS total, round(avg(value), 3) AS avg, arg_max(event_type, (value, event_id)) AS longest,
count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ALL""")
def stage_summary(spark, sf):
    """D13."""
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("steps"),
        F.round(F.sum("value"), 3).alias("total"),
        F.round(F.avg("value"), 3).alias("avg"),
        F.max_by("event_type", F.struct("value", "event_id")).alias("longest"),
        F.count_if(F.col("event_type") == "error").alias("failed"),
    )


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS processed, count(*) FILTER (event_type = 'view') AS reused, count(*) FILTER (event_type = 'error') AS failed, sum(value) AS seconds FROM events GROUP BY ALL)
SELECT user_id, round(reused / greatest(processed + reused, 1), 4) AS reuse_ratio, round(failed / greatest(processed + reused + failed, 1), 4) AS error_rate, round(seconds / greatest(processed, 1), 3) AS seconds_per_doc FROM c""")
def reuse_ratios(spark, sf):
    """Ratios with guarded divisors."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    c = table(spark, sf, "events").groupBy("user_id").agg(kind("purchase").alias("processed"), kind("view").alias("reused"), kind("error").alias("failed"), F.sum("value").alias("seconds"))
    p, r, f = F.col("processed"), F.col("reused"), F.col("failed")
    return c.select("user_id", J.ratio(r, p + r).alias("reuse_ratio"), J.ratio(f, p + r + f).alias("error_rate"), J.ratio(F.col("seconds"), p, 3).alias("seconds_per_doc"))


@query("""WITH c AS (SELECT lang, list_sort(list_distinct(list(source))) AS roles FROM documents GROUP BY ALL), q AS (SELECT ['src0', 'src3', 'src5', 'srcX'] AS required)
SELECT lang, len(roles) AS roles, list_sort(list_intersect(required, roles)) AS covered, list_sort(list_filter(required, lambda x: NOT list_contains(roles, x))) AS missing,
round(len(list_intersect(required, roles)) / 4, 3) AS ratio FROM c, q""")
def coverage_summary(spark, sf):
    """Required roles that are covered and missing."""
    required = F.array(*map(F.lit, ("src0", "src3", "src5", "srcX")))
    c = table(spark, sf, "documents").groupBy("lang").agg(F.collect_set("source").alias("r"))
    covered = F.array_sort(F.array_intersect(required, "r"))
    return c.select("lang", F.size("r").cast("bigint").alias("roles"), covered.alias("covered"), F.array_sort(F.array_except(required, "r")).alias("missing"), F.round(F.size(covered) / 4, 3).alias("ratio"))


@query("SELECT source, lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS long FROM documents GROUP BY ALL")
def candidate_histogram(spark, sf):
    """Conditional counts by two facets."""
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 1000).alias("long"))


_STATUS = "CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'warning' ELSE 'passed' END"
_SEVERITY = "CASE l_linenumber % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'minor' WHEN 2 THEN 'major' WHEN 3 THEN 'critical' ELSE 'other' END"


def _checks(spark, sf):
    """Line items as check results: an order is a protocol."""
    n = F.col("l_linenumber") % 5
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "warning").otherwise("passed")
    severity = F.when(n == 0, "info").when(n == 1, "minor").when(n == 2, "major").when(n == 3, "critical").otherwise("other")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("protocol"), (F.col("l_linenumber") % 4).alias("rule_group"), F.col("l_suppkey").alias("rule"), status.alias("status"), severity.alias("severity"))


_CHECKS = f"c AS (SELECT l_orderkey AS protocol, l_linenumber % 4 AS rule_group, l_suppkey AS rule, {_STATUS} AS status, {_SEVERITY} AS severity FROM lineitem)"


@query(f"WITH {_CHECKS} SELECT protocol, CASE min(CASE status WHEN 'failed' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END) WHEN 1 THEN 'failed' WHEN 2 THEN 'warning' ELSE 'passed' END AS status FROM c GROUP BY ALL")
def status_fold(spark, sf):
    """The status of highest precedence."""
    return _checks(spark, sf).groupBy("protocol").agg(O.precedence(F.col("status"), ("not_determined", "failed", "warning", "passed")).alias("status"))


@query(f"""WITH {_CHECKS}, w AS (SELECT protocol, CASE severity WHEN 'info' THEN 1 WHEN 'minor' THEN 2 WHEN 'major' THEN 4 WHEN 'critical' THEN 6 ELSE 3 END AS w, CASE status WHEN 'passed' THEN 100 WHEN 'warning' THEN 55 ELSE 0 END AS m FROM c)
SELECT protocol, round_even(greatest(0, least(100, sum(w * m)::DOUBLE / sum(w)::DOUBLE)), 0) AS score FROM w GROUP BY ALL""")
def weighted_score(spark, sf):
    """D24."""
    return _checks(spark, sf).groupBy("protocol").agg(O.weighted_score(F.col("severity"), F.col("status")).alias("score"))


@query(f"WITH {_CHECKS} SELECT rule_group, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'incomplete') AS incomplete, count(*) FILTER (status = 'passed') AS passed FROM c GROUP BY ALL")
def group_status_pivot(spark, sf):
    """D25."""
    return O.zero_filled_pivot(_checks(spark, sf), ["rule_group"], "status", ("failed", "warning", "incomplete", "passed"))


@query(f"WITH {_CHECKS} SELECT protocol, arg_max(severity, CASE severity WHEN 'info' THEN 1 WHEN 'minor' THEN 2 WHEN 'major' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END) AS severity FROM c WHERE status <> 'passed' GROUP BY ALL")
def max_severity(spark, sf):
    """The gravest severity that isn't passed."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, F.lit(k)) for k, s in ((1, "info"), (2, "minor"), (3, "major"), (4, "critical"))], F.lit(0))
    return _checks(spark, sf).where("status <> 'passed'").groupBy("protocol").agg(F.max_by("severity", rank).alias("severity"))


@query(f"""WITH {_CHECKS} SELECT protocol, count(*) AS checks, count(*) - count(DISTINCT rule) AS duplicates, count(*) FILTER (rule % 3 = 0) AS without_evidence, count(*) FILTER (status <> 'passed' AND rule % 3 <> 0) AS findings FROM c GROUP BY ALL""")
def protocol_completeness(spark, sf):
    """Duplicate rules and findings without evidence."""
    return _checks(spark, sf).groupBy("protocol").agg(
        F.count(F.lit(1)).alias("checks"),
        (F.count(F.lit(1)) - F.count_distinct("rule")).alias("duplicates"),
        F.count_if(F.col("rule") % 3 == 0).alias("without_evidence"),
        F.count_if((F.col("status") != "passed") & (F.col("rule") % 3 != 0)).alias("findings"),
    )


@query("""WITH o AS (SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS finished, max(o_orderdate) AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS latest_success FROM orders GROUP BY ALL)
SELECT c_custkey, coalesce(orders, 0) AS orders, coalesce(finished, 0) AS finished, latest, latest_success FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def base_statistics(spark, sf):
    """Counts and latest rows of each owner."""
    done = F.col("o_orderstatus") == "F"
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(done).alias("finished"),
        F.max("o_orderdate").alias("latest"),
        F.max(F.when(done, F.struct("o_orderdate", "o_orderkey"))).getField("o_orderkey").alias("latest_success"),
    )
    rows = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("orders", "finished")], "latest", "latest_success")


@query("""WITH r AS (SELECT source AS role, count(*) AS documents FROM documents WHERE lang <> 'de' GROUP BY ALL), q AS (SELECT DISTINCT source AS role FROM documents UNION SELECT 'srcX')
SELECT q.role, coalesce(documents, 0) AS documents, documents IS NULL AS missing FROM q LEFT JOIN r USING (role)""")
def basis_inventory(spark, sf):
    """Documents of each required role, missing roles with zero."""
    docs = table(spark, sf, "documents")
    have = docs.where("lang <> 'de'").groupBy(F.col("source").alias("role")).agg(F.count(F.lit(1)).alias("documents"))
    needed = docs.select(F.col("source").alias("role")).union(spark.sql("SELECT 'srcX' AS role")).distinct()
    return needed.join(have, "role", "left").select("role", F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"), F.col("documents").isNull().alias("missing"))


@query("SELECT source, failed, total, CASE WHEN failed = 0 THEN 'valid' WHEN failed * 4 > total THEN 'rejected' ELSE 'warning' END AS verdict FROM (SELECT source, count(*) FILTER (quality = 0) AS failed, count(*) AS total FROM documents JOIN labels USING (doc_id) GROUP BY ALL)")
def candidate_verdict(spark, sf):
    """Problems by source and a ladder of verdicts."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("failed"), F.count(F.lit(1)).alias("total"))
    verdict = F.when(F.col("failed") == 0, "valid").when(F.col("failed") * 4 > F.col("total"), "rejected").otherwise("warning")
    return rows.select("source", "failed", "total", verdict.alias("verdict"))


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY ALL HAVING count(*) = 1")
def having_unique(spark, sf):
    """Values that occur once."""
    return table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


@query("""WITH s AS (SELECT conv_id, count(*) AS sections, count(*) FILTER (length(text) > 200) AS with_refs, count(*) FILTER (length(text) > 200 AND role = 'assistant') AS grounded FROM conversations GROUP BY ALL)
SELECT conv_id, round_even(with_refs / sections, 3) AS coverage, round_even(grounded / greatest(with_refs, 1), 3) AS groundedness, with_refs / sections < 0.75 AS failed FROM s""")
def citation_coverage(spark, sf):
    """Shares of sections with references, and of those that are grounded."""
    long = F.char_length("text") > 200
    s = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(long).alias("r"), F.count_if(long & (F.col("role") == "assistant")).alias("g"))
    share = F.col("r") / F.col("n")
    return s.select("conv_id", F.bround(share, 3).alias("coverage"), F.bround(F.col("g") / F.greatest("r", F.lit(1)), 3).alias("groundedness"), (share < 0.75).alias("failed"))


@query("SELECT user_id, date_diff('second', max(ts), TIMESTAMP '2024-01-31 00:00:00') > 43200 AS stale FROM events GROUP BY ALL")
def heartbeat(spark, sf):
    """Whether the last sign of life is too old at a given time."""
    now = F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return table(spark, sf, "events").groupBy("user_id").agg((now - F.max(F.unix_timestamp("ts")) > 43200).alias("stale"))


@query("""WITH l AS (SELECT c_custkey, max(o_orderdate) AS synced FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY ALL)
SELECT c_custkey, synced IS NULL OR synced < TIMESTAMP '1998-08-01 00:00:00' - INTERVAL (CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 30 END) DAY AS due FROM l""")
def due_sources(spark, sf):
    """Never synced, or longer ago than the source's interval."""
    last = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max(F.unix_timestamp("o_orderdate")).alias("synced"))
    days = F.when(F.col("c_custkey") % 2 == 0, 7).otherwise(30)
    now = F.unix_timestamp(F.lit("1998-08-01 00:00:00").cast("timestamp"))
    due = F.col("synced").isNull() | (F.col("synced") < now - days * 86400)
    return table(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", due.alias("due"))


@query("SELECT event_id, value > 100 AS sla_breached, CAST(floor(value) AS BIGINT) AS elapsed, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def sla_check(spark, sf):
    """Limits, floored seconds, and times in ISO form."""
    return table(spark, sf, "events").select("event_id", (F.col("value") > 100).alias("sla_breached"), F.floor("value").alias("elapsed"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


@query("""WITH s(stage, ord) AS (VALUES ('view', 1), ('click', 2), ('signup', 3), ('purchase', 4)), r AS (SELECT DISTINCT user_id FROM events),
e AS (SELECT user_id, event_type AS stage, max(ts) AS seen FROM events GROUP BY ALL), f AS (SELECT user_id, bool_or(event_type = 'error' AND value > 150) AS bad, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END) AS reached FROM events GROUP BY ALL)
SELECT r.user_id, s.stage, CASE WHEN ord = reached AND bad THEN 'failed' WHEN e.seen IS NOT NULL OR ord < reached THEN 'completed' ELSE 'pending' END AS status
FROM r CROSS JOIN s JOIN f USING (user_id) LEFT JOIN e ON e.user_id = r.user_id AND e.stage = s.stage""")
def planned_steps(spark, sf):
    """The planned stages of each run with their status."""
    stages = ("view", "click", "signup", "purchase")
    kind = F.col("event_type")
    ordinal = F.coalesce(*[F.when(kind == s, F.lit(k)) for k, s in enumerate(stages, 1)])
    runs = table(spark, sf, "events").groupBy("user_id").agg(F.bool_or((kind == "error") & (F.col("value") > 150)).alias("bad"), F.max(ordinal).alias("reached"), F.collect_set("event_type").alias("seen"))
    plan = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(k).alias("ord")) for k, s in enumerate(stages, 1)]))
    rows = runs.withColumn("p", plan)
    done = F.array_contains("seen", F.col("p.stage")) | (F.col("p.ord") < F.col("reached"))
    status = F.when((F.col("p.ord") == F.col("reached")) & F.col("bad"), "failed").when(done, "completed").otherwise("pending")
    return rows.select("user_id", F.col("p.stage").alias("stage"), status.alias("status"))


@query("""WITH u AS (SELECT l_orderkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS used, l_linenumber, l_quantity FROM lineitem)
SELECT l_orderkey, l_linenumber, used <= 100 AS fits FROM u""")
def running_budget(spark, sf):
    """F8: a running total against a budget, in order; equal places share a total."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.sum("l_quantity").over(w) <= 100).alias("fits"))

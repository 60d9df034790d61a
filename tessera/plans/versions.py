"""Version maintenance over two states of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import relational as O
from tessera.operators import versions as V

from .base import query, table

#: Two versions: without each tenth document; and edited in each seventh.
_V1 = "v1 AS (SELECT doc_id, source, sha256(text) AS checksum FROM documents WHERE doc_id % 10 <> 0)"
_V2 = "v2 AS (SELECT doc_id, source, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS checksum FROM documents WHERE doc_id % 10 <> 1)"


def before(spark, sf):
    return table(spark, sf, "documents").where("doc_id % 10 <> 0").select("doc_id", "source", V.checksum(F.col("text")).alias("checksum"))


def after(spark, sf):
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").where("doc_id % 10 <> 1").select("doc_id", "source", V.checksum(edited).alias("checksum"))


_DIFF = f"""WITH {_V1}, {_V2}, d AS (SELECT coalesce(v1.doc_id, v2.doc_id) AS doc_id, CASE WHEN v1.doc_id IS NULL THEN 'added' WHEN v2.doc_id IS NULL THEN 'removed'
  WHEN v1.checksum IS NOT DISTINCT FROM v2.checksum THEN 'unchanged' ELSE 'changed' END AS change FROM v1 FULL JOIN v2 ON v1.doc_id = v2.doc_id)
"""


@query(_DIFF + "SELECT * FROM d")
def version_diff(spark, sf):
    """C10."""
    return V.diff(before(spark, sf), after(spark, sf))


@query(_DIFF + "SELECT doc_id % 20 AS source, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'unchanged') AS unchanged FROM d GROUP BY 1")
def delta_summary(spark, sf):
    """Counts of each kind of delta, zero-filled."""
    found = V.diff(before(spark, sf), after(spark, sf)).withColumn("source", F.col("doc_id") % 20)
    return O.zero_filled_pivot(found, ["source"], "change", ("added", "changed", "removed", "unchanged"))


_SCANNED = "sc AS (SELECT DISTINCT source FROM documents WHERE source IN ('src2', 'src3', 'src11'))"


def _scanned(spark, sf):
    return table(spark, sf, "documents").where(F.col("source").isin("src2", "src3", "src11")).select("source").distinct()


@query(f"WITH {_V1}, {_V2}, {_SCANNED} SELECT doc_id, source FROM v1 WHERE source IN (SELECT source FROM sc) AND doc_id NOT IN (SELECT doc_id FROM v2)")
def deleted_docs(spark, sf):
    """C11."""
    return V.deleted(before(spark, sf), after(spark, sf), _scanned(spark, sf)).select("doc_id", "source")


@query(f"WITH {_V1}, {_V2}, {_SCANNED} SELECT doc_id, source FROM v1 WHERE source NOT IN (SELECT source FROM sc) AND doc_id NOT IN (SELECT doc_id FROM v2)")
def carry_forward(spark, sf):
    """C12."""
    return V.carried(before(spark, sf), _scanned(spark, sf), after(spark, sf)).select("doc_id", "source")


@query(f"""WITH {_V1}, {_V2}, s AS (SELECT checksum, min(doc_id) AS same FROM v1 GROUP BY ALL),
r AS (SELECT v2.doc_id, v1.doc_id IS NOT NULL AS known, CASE WHEN v1.checksum = v2.checksum THEN v2.doc_id WHEN v1.doc_id IS NULL THEN same END AS reuse_id
FROM v2 LEFT JOIN v1 ON v1.doc_id = v2.doc_id LEFT JOIN s ON s.checksum = v2.checksum)
SELECT doc_id, CASE WHEN reuse_id IS NOT NULL THEN 'unchanged' WHEN known THEN 'changed' ELSE 'new' END AS decision, reuse_id FROM r""")
def checksum_reuse(spark, sf):
    """Content-addressed reuse."""
    return V.reuse(after(spark, sf), before(spark, sf))


@query(f"""WITH {_V1}, {_V2} SELECT source, count(*) AS documents, sha256(string_agg(checksum, ',' ORDER BY checksum)) AS version_hash FROM v2 GROUP BY ALL""")
def version_hash(spark, sf):
    """A source's documents and the hash of their sorted checksums."""
    return V.ordered_hash(after(spark, sf), "source", "checksum", "version_hash").withColumnRenamed("n", "documents")


@query("SELECT doc_id, 'sha256:' || sha256(concat_ws(chr(10), sha256(text), lang, source, 'chunking-1', 'space-1', '64', 'cosine')) AS embedding_key FROM documents")
def embedding_key(spark, sf):
    """What an embedding depends on, as one key."""
    parts = [F.sha2("text", 256), F.col("lang"), F.col("source"), F.lit("chunking-1"), F.lit("space-1"), F.lit("64"), F.lit("cosine")]
    return table(spark, sf, "documents").select("doc_id", V.embedding_key(parts).alias("embedding_key"))


@query("""SELECT o_orderkey, sha256('{"custkey":' || o_custkey || ',"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS fingerprint FROM orders""")
def fingerprint(spark, sf):
    """The fingerprint of a request."""
    fields = [F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")]
    return table(spark, sf, "orders").select("o_orderkey", V.fingerprint(fields).alias("fingerprint"))


@query("""WITH r AS (SELECT user_id * 7 + event_id % 3 AS key, event_id, sha256(event_type) AS fp, row_number() OVER (PARTITION BY user_id * 7 + event_id % 3 ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT key, event_id AS first_id, fp FROM r WHERE rn = 1)
SELECT r.event_id, first_id, CASE WHEN r.event_id = first_id THEN 'accepted' WHEN r.fp = f.fp THEN 'replayed' ELSE 'conflict' END AS outcome FROM r JOIN f USING (key)""")
def idempotent_submission(spark, sf):
    """I4: a repeated key with the same fingerprint is a replay, with another one a conflict."""
    rows = table(spark, sf, "events").select((F.col("user_id") * 7 + F.col("event_id") % 3).alias("key"), "event_id", "ts", F.sha2("event_type", 256).alias("fp"))
    first = rows.groupBy("key").agg(F.min(F.struct("ts", "event_id", "fp")).alias("f"))
    outcome = F.when(F.col("event_id") == F.col("f.event_id"), "accepted").when(F.col("fp") == F.col("f.fp"), "replayed").otherwise("conflict")
    return rows.join(first, "key").select("event_id", F.col("f.event_id").alias("first_id"), outcome.alias("outcome"))


@query("""WITH m AS (SELECT p_brand, max(p_partkey) AS latest FROM part GROUP BY ALL)
SELECT p_partkey, p_partkey = latest AS active, CASE WHEN p_partkey = latest THEN p_retailprice ELSE round(p_retailprice * 0.9, 2) END AS price FROM part JOIN m USING (p_brand)""")
def dimension_upsert(spark, sf):
    """One active row a code; earlier ones get new attributes."""
    parts = table(spark, sf, "part")
    latest = parts.groupBy("p_brand").agg(F.max("p_partkey").alias("latest"))
    active = F.col("p_partkey") == F.col("latest")
    return parts.join(latest, "p_brand").select("p_partkey", active.alias("active"), F.when(active, F.col("p_retailprice")).otherwise(F.round(F.col("p_retailprice") * 0.9, 2)).alias("price"))

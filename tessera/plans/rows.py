"""Queries over the row sink and the clone of a version."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.shared import shared_path
from tessera.sources.rows import Rows, clone

from .base import query, table


@query("""WITH ch AS (SELECT c_custkey AS k, 'insert' AS op, 5 AS seq, c_custkey, c_name || ' again' AS c_name, c_acctbal FROM customer WHERE c_custkey % 13 = 0
  UNION ALL SELECT -c_custkey, 'insert', 1, -c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT o_custkey, 'upsert', 100 + o_orderkey, o_custkey, 'order ' || o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_custkey, 'delete', 100 + o_orderkey, o_custkey, NULL, NULL FROM orders WHERE o_orderkey % 3 = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC, op DESC) AS nth FROM ch), m AS (SELECT * FROM l WHERE nth = 1)
SELECT coalesce(c.c_custkey, m.c_custkey) AS c_custkey, CASE WHEN m.op = 'upsert' OR c.c_custkey IS NULL THEN m.c_name ELSE c.c_name END AS c_name, CASE WHEN m.op = 'upsert' OR c.c_custkey IS NULL THEN m.c_acctbal ELSE c.c_acctbal END AS c_acctbal
FROM customer c FULL JOIN m ON m.k = c.c_custkey WHERE coalesce(m.op, '') <> 'delete'""")
def merged_rows(spark, sf):
    """Customers after inserts, upserts and deletes that follow from their orders."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    o = table(spark, sf, "orders")
    seq = (100 + F.col("o_orderkey")).cast("bigint").alias("seq")
    of = lambda op, seq: (F.lit(op).alias("op"), F.lit(seq).cast("bigint").alias("seq"))
    changes = c.where("c_custkey % 13 = 0").select(*of("insert", 5), "c_custkey", F.concat("c_name", F.lit(" again")).alias("c_name"), "c_acctbal")
    changes = changes.union(c.where("c_custkey % 7 = 0").select(*of("insert", 1), -F.col("c_custkey"), "c_name", "c_acctbal"))
    changes = changes.union(o.where("o_orderkey % 3 = 0").select(F.lit("upsert"), seq, "o_custkey", F.concat(F.lit("order "), "o_orderkey"), F.col("o_totalprice").cast("double")))
    changes = changes.union(o.where("o_orderkey % 3 = 1").select(F.lit("delete"), seq, "o_custkey", F.lit(None).cast("string"), F.lit(None).cast("double")))
    rows = Rows.create(c, shared_path(spark), ["c_custkey"], 16)
    rows.merge(changes)
    return rows.read()


_NEW = "substr(md5('v2:{0}:' || {1}), 1, 16)"


@query(f"""SELECT {_NEW.format("orders", "l_orderkey")} AS l_orderkey, l_linenumber, {_NEW.format("part", "l_partkey")} AS l_partkey, {_NEW.format("customer", "o_custkey")} AS o_custkey, c_name, n_name
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 > 0""")
def version_clone(spark, sf):
    """Customers of a version with their orders, line items and parts under new keys, joined by these."""
    t = lambda name: table(spark, sf, name)
    copies = clone(
        "v2",
        {
            "nation": (t("nation").select("n_nationkey", "n_name"), "n_nationkey", {}),
            "customer": (t("customer").where("c_custkey % 3 > 0").select("c_custkey", "c_nationkey", "c_name"), "c_custkey", {"c_nationkey": "nation"}),
            "part": (t("part").select("p_partkey"), "p_partkey", {}),
            "orders": (t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", {"o_custkey": "customer"}),
            "lineitem": (t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), None, {"l_orderkey": "orders", "l_partkey": "part"}),
        },
    )
    c = copies["customer"].join(copies["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    lines = copies["lineitem"].join(copies["part"], F.col("l_partkey") == F.col("p_partkey")).join(copies["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(c, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "c_name", "n_name")

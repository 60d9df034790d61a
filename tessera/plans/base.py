"""Registration of queries, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function ``(spark, sf_dir)`` under its name, with its SQL for DuckDB."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Types that the stand-in fragments take by their id.
DOCUMENT_TYPES = ("api", "architecture", "technology", "normative", "other")
FRAGMENT_KINDS = ("requirement", "component", "integration", "api", "rule", "other", "glossary")
SOURCE_WEIGHTS = {"normative": 1.2, "api": 1.1, "architecture": 1.05, "technology": 1.0, "other": 0.95}


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as fragments: the source is the document, the first line the title."""
    kind = _pick(DOCUMENT_TYPES, F.col("doc_id"))
    weight = F.lit(0.95)
    for name, value in SOURCE_WEIGHTS.items():
        weight = F.when(F.col("document_type") == name, value).otherwise(weight)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("document"),
        F.substring(F.element_at(F.split("text", "\n"), 1), 1, 120).alias("title"),
        F.col("text").alias("content"),
        kind.alias("document_type"),
        _pick(FRAGMENT_KINDS, F.col("doc_id")).alias("fragment_type"),
        (F.col("lang") == "en").alias("required_flag"),
    )
    return docs.withColumn("source_weight", weight)


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def tokens_sql(x: str) -> str:
    return rf"list_transform(list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_\-/\.]+'), lambda t: length(t) > 1), lambda t: lower(t))"


#: The same fragments and queries as common table expressions.
FRAGMENTS_SQL = """frag AS (
  SELECT doc_id, source AS document, substr(split_part(text, chr(10), 1), 1, 120) AS title, text AS content,
    ['api', 'architecture', 'technology', 'normative', 'other'][1 + doc_id % 5] AS document_type,
    ['requirement', 'component', 'integration', 'api', 'rule', 'other', 'glossary'][1 + doc_id % 7] AS fragment_type,
    lang = 'en' AS required_flag,
    CASE doc_id % 5 WHEN 0 THEN 1.1 WHEN 1 THEN 1.05 WHEN 2 THEN 1.0 WHEN 3 THEN 1.2 ELSE 0.95 END AS source_weight
  FROM documents)"""

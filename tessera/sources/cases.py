"""Evaluation cases and source manifests from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = (
    "dataset_name string, knowledge_version_id string, cases array<struct<case_id: string, query_text: string, use_case: string, section_code: string, top_k: int, "
    "expected_fragment_ids: array<string>, expected_document_ids: array<string>, relevance_by_fragment_id: map<string, double>, relevance_by_document_id: map<string, double>>>"
)
MANIFEST = "sources array<struct<code: string, uri: string, source_type: string, active: boolean>>"


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, targets and rejected cases of evaluation files.

    A target is ``fragment:<id>`` or ``document:<id>`` with the largest of the relevances
    given for it; an id in a list counts 1. A case without a query or a target with a
    relevance over 0 is rejected.
    """
    cases = spark.read.schema(CASES).option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")
    targets = None
    for kind in ("fragment", "document"):
        listed = cases.select("case_id", F.explode(f"expected_{kind}_ids").alias("id"), F.lit(1.0).alias("relevance"))
        given = cases.select("case_id", F.explode(f"relevance_by_{kind}_id").alias("id", "relevance"))
        both = listed.unionByName(given).select("case_id", F.concat(F.lit(f"{kind}:"), "id").alias("target"), "relevance")
        targets = both if targets is None else targets.unionByName(both)
    targets = targets.groupBy("case_id", "target").agg(F.max("relevance").alias("relevance")).where("relevance > 0")
    asked = F.trim(F.coalesce("query_text", F.lit(""))) != ""
    wanted = targets.select("case_id").distinct()
    fields = ["case_id", "query_text", F.coalesce("use_case", F.lit("generation")).alias("use_case"), "section_code", F.greatest(F.lit(1), F.coalesce("top_k", F.lit(10))).alias("top_k")]
    good = cases.where(asked).join(wanted, "case_id", "left_semi").select(*fields)
    bad = cases.join(good.select("case_id"), "case_id", "left_anti").select("case_id", F.when(asked, "no target").otherwise("no query").alias("reason"))
    return good, targets.join(good.select("case_id"), "case_id", "left_semi"), bad


def import_manifest(manifest: DataFrame, known: DataFrame) -> DataFrame:
    """``(code, uri, source_id, action)`` for each entry of a manifest.

    ``known`` holds source_id, code and uri. An entry is matched by code, else by uri;
    one that more than one known source fits is ambiguous and changes nothing.
    """
    entries = manifest.select("code", "uri").withColumn("entry", F.monotonically_increasing_id())
    by_code = entries.join(known.select("source_id", "code"), "code").select("entry", "source_id", F.lit(1).alias("way"))
    by_uri = entries.join(known.select("source_id", "uri"), "uri").select("entry", "source_id", F.lit(2).alias("way"))
    ways = by_code.unionByName(by_uri).groupBy("entry", "way").agg(F.count_distinct("source_id").alias("n"), F.min("source_id").alias("source_id"))
    best = ways.groupBy("entry").agg(F.min(F.struct("way", "n", "source_id")).alias("b"))
    action = F.when(F.col("b").isNull(), "insert").when(F.col("b.n") > 1, "ambiguous").otherwise("update")
    rows = entries.join(best, "entry", "left").withColumn("action", action)
    return rows.select("code", "uri", F.when(F.col("action") == "update", F.col("b.source_id")).alias("source_id"), "action")

"""Periodic, incremental ingestion: each run takes what is new and ends.

Documents arrive as Parquet files. A run decides per document by its checksum
whether artefacts are reused, and writes a version of its own per micro-batch. A
batch that runs again after a failure writes the same version again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import versions as V
from tessera.sources.files import read_versions, write_version


def sync(spark: SparkSession, arrivals: str, schema, out: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int | None = None) -> None:
    """Take all files of ``arrivals`` not taken before; returns when they are done.

    Rows hold doc_id and text. A version's rows hold doc_id, checksum, decision and
    reuse_id, and what ``enrich`` adds to the new and changed documents.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.select("doc_id", "text", V.checksum(F.col("text")).alias("checksum"))
        # of rows of one document in a batch the last text in order counts
        rows = rows.groupBy("doc_id").agg(F.max(F.struct("text", "checksum")).alias("r")).select("doc_id", "r.text", "r.checksum")
        before = known(spark, out, number)
        decided = V.reuse(rows.select("doc_id", "checksum"), before).join(rows, "doc_id")
        fresh = enrich(decided) if enrich else decided
        write_version(fresh.drop("text"), out, f"{number:08d}")

    query = reader.parquet(arrivals).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def known(spark: SparkSession, out: str, below: int | None = None) -> DataFrame:
    """The latest ``(doc_id, checksum)`` of every document, of versions below a number."""
    empty = spark.createDataFrame([], "doc_id bigint, checksum string")
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return empty
    rows = read_versions(spark, out).withColumn("v", F.col("version").cast("bigint"))
    rows = rows if below is None else rows.where(F.col("v") < below)
    return rows.groupBy("doc_id").agg(F.max_by("checksum", "v").alias("checksum"))


def idempotent(requests: DataFrame, key: str = "key", fingerprint: str = "fingerprint", order: str = "at") -> DataFrame:
    """Requests with their outcome: the first of a key is accepted, equal ones are replays, others conflicts."""
    first = requests.groupBy(key).agg(F.min(F.struct(order, fingerprint)).alias("f"))
    outcome = F.when((F.col(order) == F.col(f"f.{order}")) & (F.col(fingerprint) == F.col(f"f.{fingerprint}")), "accepted").when(F.col(fingerprint) == F.col(f"f.{fingerprint}"), "replayed").otherwise("conflict")
    return requests.join(first, key).select(*requests.columns, outcome.alias("outcome"))

"""Exact deduplication by stateful streaming.

Each row's normalised text is reduced to a SHA-256 digest. The rows arrive in a
stream whose keyed state lies on disk (RocksDB), never expires, and retains for
each digest the stable identifier and the content locator of the row that stays,
and a count. Rows that hit a known digest are then checked byte for byte: the
texts of groups of more than one row are laid beside the keeper's text and
compared in full. Rows that differ under an equal digest are grouped anew by
their whole text.

All work is DataFrame and streaming expressions; only the empty-or-not answer
about colliding digests reaches the driver.

Defined results: a null text counts as empty; texts are equal when they are the
same after each run of ASCII white space becomes one space; of equal texts the
row with the smallest id stays, null ids last, and of rows that repeat that id
one; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialized, only, shared_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ")


@contextmanager
def _set(spark: SparkSession, **conf: str):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _state(spark: SparkSession, arrivals: str, schema, files_per_batch: int | None) -> DataFrame:
    """``(digest, keep, n)`` after the whole stream of ``arrivals``; keep: the first of (null id, id, content, row)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    held = reader.parquet(arrivals).groupBy("digest").agg(F.min("locator").alias("keep"), F.count(F.lit(1)).alias("n"))
    out = shared_path(spark, "state")

    def save(batch: DataFrame, number: int) -> None:
        # a batch that runs again after a failure writes the same folder again
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    # a state partition is small; space laid out ahead for each one's logs would outweigh it
    conf = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    with _set(spark, **conf):
        query = held.writeStream.outputMode("update").option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).foreachBatch(save).start()
        query.awaitTermination()
    if query.exception():
        raise query.exception()
    # an update of a later batch has the larger count
    updates = spark.read.schema(held.schema).parquet(out) if query.lastProgress else spark.createDataFrame([], held.schema)
    return materialized(updates.groupBy("digest").agg(F.max_by("keep", "n").alias("keep"), F.max("n").alias("n")), "keepers")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` of every row.

    ``files_per_batch`` sets how many files of arrivals a micro-batch takes; the
    result is the same for any number.
    """
    spark = docs.sparkSession
    source = only(docs, id=id_col, text=text_col)
    # where a content is found: the row's id, which of the id's texts, and which of its repeats
    locator = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.xxhash64("text").alias("content"), F.monotonically_increasing_id().alias("row"))
    arrivals = source.select(F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("digest"), locator.alias("locator"))
    path = shared_path(spark, "arrivals")
    arrivals.write.parquet(path)
    arrived = spark.read.schema(arrivals.schema).parquet(path)
    keepers = _state(spark, path, arrivals.schema, files_per_batch)
    decided = arrived.join(keepers, "digest").select(
        F.col("locator.id").alias("id"), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("locator.row") == F.col("keep.row")).alias("kept"), F.col("digest").alias("text_sha256")
    )
    other = _collisions(source, keepers)
    if not other.isEmpty():
        decided = _regrouped(decided, source, other)
    return decided.withColumnRenamed("id", id_col)


def _collisions(source: DataFrame, keepers: DataFrame) -> DataFrame:
    """Digests under which a row's bytes differ from the keeper's."""
    texts = source.select("id", F.xxhash64("text").alias("content"), normalised(F.col("text")).alias("bytes")).withColumn("digest", F.sha2(F.col("bytes").cast("binary"), 256))
    hits = materialized(texts.join(keepers.where("n > 1").select("digest", "keep"), "digest"), "hits")
    located = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("content") == F.col("keep.content"))
    kept = materialized(hits.where(located).groupBy("digest").agg(F.min("bytes").alias("kept_bytes")), "kept")
    # made distinct only after it is written, so that the join of a large group can be split
    return materialized(hits.join(kept, "digest").where("bytes <> kept_bytes").select("digest"), "collisions").distinct()


def _regrouped(decided: DataFrame, source: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of colliding digests, grouped by their whole texts."""
    texts = source.select("id", normalised(F.col("text")).alias("bytes")).withColumn("text_sha256", F.sha2(F.col("bytes").cast("binary"), 256))
    rows = materialized(texts.join(other.withColumnRenamed("digest", "text_sha256"), "text_sha256").withColumn("row", F.monotonically_increasing_id()), "regrouped")
    first = rows.groupBy("text_sha256", "bytes").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    again = rows.join(first, ["text_sha256", "bytes"]).select("id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256")
    return decided.join(other.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left_anti").select(*again.columns).union(again)


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

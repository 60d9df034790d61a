"""What several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the word operators split at.
ASCII_SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` where that is set. Only where it is unset in a
    local session (a test) is a local folder made and set for the session's context;
    on a cluster that is an error, as every machine would have a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tessera-", dir=os.environ.get("TMPDIR", "/tmp")))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


#: Folders of this driver's intermediate tables.
_made: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    folder = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    _made.append(folder)
    return f"{folder}/{name}"


def made() -> list[str]:
    """The folders of intermediate tables so far."""
    return list(_made)


def forget(spark: SparkSession, folders: list[str] | None = None) -> int:
    """Delete these folders, by default all of this driver's; call it when what was made of them is read or written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = 0
    for folder in made() if folders is None else folders:
        _made.remove(folder)
        path = jvm.org.apache.hadoop.fs.Path(folder)
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def materialized(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: what follows survives the loss of executors without
    the work before it being done again.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(docs: DataFrame, **columns: str) -> DataFrame:
    """``docs`` reduced to the named columns under new names: ``only(df, id="doc_id")``.

    Columns are resolved by exact name, so extra columns never clash.
    """
    return docs.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])

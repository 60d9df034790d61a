"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only in a local session without it (a test) a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tessera-", dir=os.environ.get("TMPDIR", "/tmp")))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Folders of this driver's intermediate tables.
_made: list[str] = []


def shared_path(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    _made.append(f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}")
    return _made[-1]


def forget(spark: SparkSession) -> int:
    """Delete this driver's intermediate tables; call it when what was made of them is read or written."""
    jvm, conf, gone = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table that is made once, however often it is read."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

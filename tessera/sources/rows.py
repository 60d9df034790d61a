"""A row sink: insert, update and delete in a table of Parquet files, by copy on write.

Rows are dealt to buckets by a hash of their key. A version of the table is a small file that
names, for each bucket, the write that holds it. A merge reads and rewrites only the buckets
that its changes touch, then creates the file of the next version; that it is created, and only if no
other writer was first, makes the whole merge visible at once. Earlier versions stay readable
until they are vacuumed; what a failed merge left behind is in no version.

Defined results: of several changes of a key the one with the largest ``seq`` counts (of equal ones,
any single one); ``insert`` of a key that exists, and ``update`` or ``delete`` of one that doesn't, change
nothing and are counted as rejected, ``upsert`` does what fits; an update gives the whole row;
null keys are keys like others; no changes give a version with the same rows.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer made the next version first."""


@dataclass(frozen=True)
class Merged:
    version: int
    buckets: int
    inserted: int
    updated: int
    deleted: int
    rejected: int


class Rows:
    """The table in folder ``root``; any store that Spark writes, if it creates files exclusively."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    @classmethod
    def create(cls, rows: DataFrame, root: str, keys: list[str], buckets: int = 64) -> Rows:
        """A new table of ``rows``, whose keys must be distinct; about ``buckets`` parts of it are rewritten apart."""
        made = cls(rows.sparkSession, root)
        held = made._write(rows.withColumn("_bucket", made._bucket(keys, buckets)), buckets)
        made._publish(0, {"keys": keys, "buckets": buckets, "schema": rows.schema.jsonValue(), "held": held})
        return made

    @staticmethod
    def _bucket(keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, buckets: int) -> dict[str, str]:
        """Write rows with their ``_bucket``; returns the folder of each bucket that has some."""
        name = f"write-{uuid.uuid4().hex}"
        rows.repartition(buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{name}")
        found = self._fs.listStatus(self._path(name))
        folders = (s.getPath().getName() for s in found if s.isDirectory())
        return {f.removeprefix("_bucket="): f"{name}/{f}" for f in folders if f.startswith("_bucket=")}

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path("")))
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"version-(\d+)\.json", n)))

    def _state(self, version: int | None = None) -> tuple[int, dict]:
        version = self.versions()[-1] if version is None else version
        stream = self._fs.open(self._path(f"version-{version:09d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, json.loads(text)

    def _publish(self, version: int, state: dict) -> None:
        path = self._path(f"version-{version:09d}.json")
        try:
            stream = self._fs.create(path, False)
        except Exception as e:
            if self._fs.exists(path):
                raise Conflict(f"version {version} exists") from e
            raise
        try:
            stream.write(json.dumps(state).encode())
        finally:
            stream.close()

    def _read(self, state: dict, buckets: list[str]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.root}/{state['held'][b]}" for b in buckets if b in state["held"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last."""
        _, state = self._state(version)
        return self._read(state, list(state["held"]))

    def merge(self, changes: DataFrame) -> Merged:
        """Apply ``(op, seq, the table's columns)``; op: insert, update, upsert or delete (of which only the key counts)."""
        version, state = self._state()
        keys, count = state["keys"], state["buckets"]
        columns = [f["name"] for f in state["schema"]["fields"]]
        last = changes.groupBy(*keys).agg(F.max_by(F.struct("op", *columns), F.struct("seq", "op")).alias("new")).withColumn("_bucket", self._bucket(keys, count))
        # at most as many numbers as buckets
        touched = sorted(str(r["_bucket"]) for r in last.select("_bucket").distinct().collect())
        old = self._read(state, touched).select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*columns).alias("old"))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
        both = old.join(last, same, "full")
        is_, was = F.col("new.op"), F.col("old").isNotNull()
        done = (
            F.when(is_.isNull(), "kept").when(is_.isin("insert", "upsert") & ~was, "inserted").when(is_.isin("update", "upsert") & was, "updated").when((is_ == "delete") & was, "deleted").otherwise("rejected")
        )
        rows = both.withColumn("_done", done).where(was | (F.col("_done") == "inserted") | (F.col("_done") == "rejected"))
        value = F.when(F.col("_done").isin("inserted", "updated"), F.struct(*[F.col(f"new.{c}").alias(c) for c in columns])).otherwise(F.col("old"))
        out = rows.select(value.alias("row"), "_done").withColumn("_bucket", self._bucket([f"row.{k}" for k in keys], count))
        kept = out.where((F.col("_done") != "deleted") & F.col("row").isNotNull()).select("row.*", "_bucket")
        counts = {r["_done"]: r["count"] for r in out.groupBy("_done").count().collect()}
        held = self._write(kept, min(count, max(1, len(touched)))) if touched else {}
        now = {b: f for b, f in state["held"].items() if b not in touched} | held
        self._publish(version + 1, state | {"held": now})
        return Merged(version + 1, len(touched), *(counts.get(k, 0) for k in ("inserted", "updated", "deleted", "rejected")))

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the last ``keep`` versions, and the writes that none of these names."""
        versions = self.versions()
        used = {f.split("/")[0] for v in versions[-keep:] for f in self._state(v)[1]["held"].values()}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"version-{v:09d}.json"), False)
        gone = 0
        for s in self._fs.listStatus(self._path("")):
            name = s.getPath().getName()
            if name.startswith("write-") and name not in used:
                gone += bool(self._fs.delete(s.getPath(), True))
        return gone


def new_key(version: str, table: str, key: Column) -> Column:
    """The key of a row's copy: of version, table and old key alone, so that every table finds it without a map and again on retry."""
    return F.when(key.isNotNull(), F.substring(F.md5(F.concat_ws(":", F.lit(version), F.lit(table), key.cast("string")).cast("binary")), 1, 16))


def clone(version: str, tables: dict[str, tuple[DataFrame, str | None, dict[str, str]]]) -> dict[str, DataFrame]:
    """Copies of tables under new keys: ``{name: (rows, key column or None, {foreign key column: table})}``.

    A row is copied if all that it refers to is (null refers to nothing), and points to the copies. Tables
    are given parents first.
    """
    out: dict[str, DataFrame] = {}
    alive: dict[str, DataFrame] = {}
    for name, (rows, key, refers) in tables.items():
        kept = rows
        for column, parent in refers.items():
            known = alive[parent].withColumnRenamed("_key", "_parent")
            none = kept.where(F.col(column).isNull())
            kept = kept.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_parent"), "left_semi").unionByName(none)
        if key:
            alive[name] = kept.select(F.col(key).alias("_key")).distinct()
        new = {column: new_key(version, parent, F.col(column)) for column, parent in refers.items()}
        if key:
            new[key] = new_key(version, name, F.col(key))
        out[name] = kept.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])
    return out

"""The row sink against a dictionary; versions, conflicts, vacuum; clones."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.sources.rows import Conflict, Rows, clone

SCHEMA = "k string, part int, v string"


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, seq int, k string, part int, v string")


def test_merges_equal_a_dictionary(spark, tmp_path):
    r = random.Random(5)
    held = {(None if k == 0 else str(k), k % 3): f"v{k}" for k in range(40)}
    rows = Rows.create(spark.createDataFrame([(k, p, v) for (k, p), v in held.items()], SCHEMA), str(tmp_path / "t"), ["k", "part"], 8)
    for turn in range(3):
        given, want = [], {"inserted": 0, "updated": 0, "deleted": 0, "rejected": 0}
        last = {}
        for seq in range(25):
            n = r.choice([0, *range(60)])
            key, op = (None if n == 0 else str(n), n % 3), r.choice(["insert", "update", "upsert", "delete"])
            given.append((op, seq, *key, f"t{turn}s{seq}"))
            last[key] = (op, f"t{turn}s{seq}")
        for key, (op, v) in last.items():
            was = key in held
            what = "deleted" if op == "delete" and was else "inserted" if op in ("insert", "upsert") and not was else "updated" if op in ("update", "upsert") and was else "rejected"
            want[what] += 1
            if what == "deleted":
                del held[key]
            elif what != "rejected":
                held[key] = v
        done = rows.merge(changes(spark, given))
        assert {k: getattr(done, k) for k in want} == want and done.version == turn + 1 and done.buckets <= 8
        got = [tuple(x) for x in rows.read().collect()]
        assert sorted(got, key=str) == sorted(((*k, v) for k, v in held.items()), key=str)


def test_only_touched_buckets_are_written(spark, tmp_path):
    rows = Rows.create(spark.createDataFrame([(str(k), 0, "a") for k in range(100)], SCHEMA), str(tmp_path / "t"), ["k"], 10)
    before = rows._state()[1]["held"]
    done = rows.merge(changes(spark, [("update", 1, "7", 0, "b")]))
    after = rows._state()[1]["held"]
    assert done.buckets == 1 and sum(before[b] != after[b] for b in before) == 1
    assert rows.read().where("v = 'b'").count() == 1 and rows.read(0).where("v = 'b'").count() == 0
    gone = rows.merge(changes(spark, [("delete", 1, str(k), 0, None) for k in range(100)]))
    assert gone.deleted == 100 and rows.read().count() == 0 and not rows._state()[1]["held"]
    assert rows.merge(changes(spark, [])).version == 3
    assert rows.vacuum() == 3 and rows.versions() == [3] and rows.read().count() == 0


def test_second_writer_conflicts(spark, tmp_path):
    rows = Rows.create(spark.createDataFrame([("a", 0, "a")], SCHEMA), str(tmp_path / "t"), ["k"], 2)
    state = rows._state()
    rows.merge(changes(spark, [("update", 1, "a", 0, "first")]))
    late = Rows(spark, str(tmp_path / "t"))
    late._state = lambda version=None: state
    with pytest.raises(Conflict):
        late.merge(changes(spark, [("update", 1, "a", 0, "late")]))
    assert [r.v for r in rows.read().collect()] == ["first"]
    # what the late writer wrote is in no version
    assert len(list(Path(tmp_path / "t").glob("write-*"))) == 3 and rows.vacuum(2) == 1


def test_clone_points_to_copies(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    kids = spark.createDataFrame([(10, 1, 20), (11, 9, None), (12, None, 20), (13, 2, 99)], "id int, parent int, other int")
    others = spark.createDataFrame([(20,)], "id int")
    leaves = spark.createDataFrame([(10,), (11,), (12,), (12,)], "kid int")
    got = clone("v", {"parents": (parents, "id", {}), "others": (others, "id", {}), "kids": (kids, "id", {"parent": "parents", "other": "others"}), "leaves": (leaves, None, {"kid": "kids"})})
    assert got["parents"].count() == 2 and got["kids"].count() == 2 and got["leaves"].count() == 3
    assert got["kids"].join(got["parents"].select("id"), got["kids"]["parent"] == got["parents"]["id"], "left_anti").where("parent is not null").count() == 0
    assert got["leaves"].join(got["kids"].selectExpr("id as i"), got["leaves"]["kid"] == F.col("i"), "left_anti").count() == 0
    assert not {r.id for r in got["parents"].collect()} & {"1", "2"}
    again = clone("v", {"parents": (parents, "id", {})})["parents"]
    assert sorted(again.collect()) == sorted(got["parents"].collect())

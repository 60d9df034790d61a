"""Readers, sinks and incremental ingestion on files made here."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from tessera.sources import files as S
from tessera.streaming import ingest


def _zip(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_scan_and_read(spark, tmp_path):
    root = tmp_path / "root"
    (root / "a/b/c").mkdir(parents=True)
    (root / "one.md").write_text("# T\nbody")
    (root / "a/two.json").write_text('{"b": 1}')
    (root / "a/three.html").write_text("<script>x</script><p>Hi &amp; all</p><p>two</p>")
    (root / "a/b/four.docx").write_bytes(_zip(**{"word/document.xml": "<w:d xmlns:w='u'><w:p><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:t>Tail</w:t></w:p></w:d>"}))
    (root / "a/b/five.xlsx").write_bytes(_zip(**{"xl/worksheets/sheet1.xml": "<s><row><c><v>1</v></c><c><v>2</v></c></row></s>"}))
    (root / "bad.json").write_text("{")
    (root / "bin.txt").write_bytes(b"\0" * 50 + bytes(range(1, 20)))
    (root / "skip.exe").write_text("x")
    (root / "a/b/c/deep.txt").write_text("too deep")
    (root / "six.archimate").write_text('<m><element type="Node" name="N"/><relationship source="a" target="b" type="Flow"/></m>')
    found = S.scan(spark, str(root))
    rows = {r.path.split("/")[-1]: r for r in S.read_documents(found).collect()}
    assert set(rows) == {"one.md", "two.json", "three.html", "four.docx", "five.xlsx", "bad.json", "bin.txt", "six.archimate"}
    assert rows["four.docx"].text == "Head\nTail" and rows["five.xlsx"].text == "1 | 2" and rows["three.html"].text == "Hi & all\ntwo"
    assert json.loads(rows["two.json"].text) == {"b": 1} and rows["six.archimate"].text.splitlines()[1] == "relationship Flow  a -> b"
    good, bad = S.quarantine(S.read_documents(found))
    assert {r.path.split("/")[-1] for r in bad.collect()} == {"bad.json", "bin.txt"} and good.count() == 6


def test_decoding():
    assert S.decoded("Привет, мир".encode("cp1251")) and S.decoded("naïve".encode()) == "naïve" and S.decoded(b"\0\1\2" * 30) is None


def test_url_list(spark):
    lines = spark.createDataFrame([("# no",), ("",), ("a/b.pdf",), ("/c",), ("http://10.0.0.1/x",), ("https://ok.org/",), ("http://localhost/",)], "value string")
    got = sorted(r.url for r in S.url_list(lines, "https://h.org/docs/list.txt").collect())
    assert got == ["https://h.org/c", "https://h.org/docs/a/b.pdf", "https://ok.org/"]


def test_publish(spark):
    now = spark.createDataFrame([("a", 1, "published", "x")], "artifact string, revision bigint, state string, body string")
    new = spark.createDataFrame([("a", "y"), ("b", "z")], "artifact string, body string")
    rows = sorted((r.artifact, r.revision, r.state) for r in S.publish(now, new).collect())
    assert rows == [("a", 1, "superseded"), ("a", 2, "published"), ("b", 1, "published")]


def test_incremental_sync(spark, tmp_path):
    arrivals, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "doc_id bigint, text string"
    spark.createDataFrame([(1, "one"), (2, "two")], schema).coalesce(1).write.parquet(arrivals)
    ingest.sync(spark, arrivals, schema, out, check)
    spark.createDataFrame([(1, "one"), (2, "2"), (3, "one")], schema).coalesce(1).write.mode("append").parquet(arrivals)
    ingest.sync(spark, arrivals, schema, out, check)
    second = {r.doc_id: (r.decision, r.reuse_id) for r in S.read_versions(spark, out).where(F.col("version").cast("int") == 1).collect()}
    assert second == {1: ("unchanged", 1), 2: ("changed", None), 3: ("unchanged", 1)}
    assert {r.doc_id for r in ingest.known(spark, out).collect()} == {1, 2, 3}


def test_idempotent(spark):
    rows = spark.createDataFrame([("k", "f", 1), ("k", "f", 2), ("k", "g", 3)], "key string, fingerprint string, at int")
    assert [r.outcome for r in ingest.idempotent(rows).orderBy("at").collect()] == ["accepted", "replayed", "conflict"]


def test_cases(spark, tmp_path):
    from tessera.sources import cases

    body = {
        "dataset_name": "d",
        "cases": [
            {"case_id": "1", "query_text": "q", "expected_fragment_ids": ["a"], "relevance_by_fragment_id": {"a": 0.5, "b": 2.0}, "top_k": 0},
            {"case_id": "2", "query_text": " ", "expected_document_ids": ["x"]},
            {"case_id": "3", "query_text": "q", "relevance_by_document_id": {"x": 0.0}},
        ],
    }
    (tmp_path / "c.json").write_text(json.dumps(body))
    good, targets, bad = cases.read_cases(spark, str(tmp_path / "c.json"))
    assert [(r.case_id, r.use_case, r.top_k) for r in good.collect()] == [("1", "generation", 1)]
    assert {(r.target, r.relevance) for r in targets.collect()} == {("fragment:a", 1.0), ("fragment:b", 2.0)}
    assert {(r.case_id, r.reason) for r in bad.collect()} == {("2", "no query"), ("3", "no target")}


def test_manifest(spark):
    from tessera.sources import cases

    known = spark.createDataFrame([(1, "a", "u1"), (2, "b", "u2"), (3, "c", "u2")], "source_id int, code string, uri string")
    entries = spark.createDataFrame([("a", "new"), ("x", "u1"), ("y", "u2"), ("z", "u9")], "code string, uri string")
    rows = {r.code: (r.source_id, r.action) for r in cases.import_manifest(entries, known).collect()}
    assert rows == {"a": (1, "update"), "x": (1, "update"), "y": (None, "ambiguous"), "z": (None, "insert")}


def test_progress_is_throttled():
    from tessera.streaming.control import Progress

    now, said = [0.0], []
    p = Progress(lambda *x: said.append(x), clock=lambda: now[0])
    p.offer("r", 0, 5)
    p.offer("r", 1, 5)
    now[0] = 2.5
    p.offer("r", 2, 5)
    p.offer("r", 3, 1, forced=True)
    assert said == [("r", 0, 5), ("r", 2, 15), ("r", 3, 16)]


def test_near_equal(spark):
    from tessera.functions.similar import near_equal

    body = "alpha beta gamma delta " * 10
    rows = [(body, body.upper()), (body, body + "more"), (body, body.replace("alpha", "alphq", 1)), (body, "other text"), (None, body), ("a b", "a b c")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(near_equal(F.col("a"), F.col("b"))).collect()]
    assert got == [True, True, True, False, False, False]

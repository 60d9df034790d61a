"""Readers with sections and the export sink: fixture files of every format, both ways of reading."""

from __future__ import annotations

import io
import json
import zipfile
from collections import Counter
from pathlib import Path

import pytest

from tessera.sources import export, sections as s

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def rows(kind, data):
    return [(r[4], r[5], r[6], r[7]) for r in s.parsed("x", kind, data)]


def word(*texts, style=None):
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{head}{''.join(f'<w:r><w:t>{t}</w:t></w:r>' for t in texts)}</w:p>"


def docx_file(body):
    styles = f'<w:styles {W}><w:style w:styleId="a1"><w:name w:val="heading 2"/></w:style><w:style w:styleId="n"><w:name w:val="Normal"/></w:style></w:styles>'
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}<w:sectPr/></w:body></w:document>", "word/styles.xml": styles})


def test_docx_headings_tables_and_merged_cells():
    cell = lambda t, marks="": f"<w:tc><w:tcPr>{marks}</w:tcPr>{word(t)}</w:tc>"
    table = (
        f"<w:tbl><w:tr>{cell('wide', '<w:gridSpan w:val=&quot;2&quot;/>'.replace('&quot;', chr(34)))}{cell('c')}</w:tr>"
        f"<w:tr>{cell('tall', '<w:vMerge w:val=&quot;restart&quot;/>'.replace('&quot;', chr(34)))}{cell('')}{cell('f')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('h')}{cell('i')}</w:tr></w:tbl>"
    )
    body = word("Before ", "all") + word() + word("Business Architecture", style="a1") + word("Application component shall expose API.", style="n") + table + word("No content", style="Heading1") + word("Last", style="Heading3")
    assert rows("docx", docx_file(body)) == [
        (None, None, "Before all", "docx:block:1-1"),
        ("Business Architecture", 2, "Application component shall expose API.\nTable 1\nwide | wide | c\ntall | f\ntall | h | i", "docx:block:3-5;heading:business-architecture"),
    ]
    link = f"<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>c</w:t></w:r></w:hyperlink></w:p>"
    assert rows("docx", docx_file(link)) == [(None, None, "a\tb\nc", "docx:block:1-1")]


def test_odt_blocks():
    names = 'xmlns:office="urn:o" xmlns:text="urn:t" xmlns:table="urn:b"'
    body = '<text:h text:outline-level="1">Technology  architecture</text:h><text:p>Backend <text:span>exposes</text:span>\n REST API.</text:p><text:p/><table:table><table:table-row><table:table-cell><text:p>x</text:p></table:table-cell></table:table-row></table:table>'
    data = zipped({"content.xml": f"<office:document-content {names}><office:automatic-styles/><office:body><office:text>{body}</office:text></office:body></office:document-content>"})
    assert rows("odt", data) == [
        ("Technology architecture", 1, "Technology architecture", "odt:block:1"), (None, None, "Backend exposes REST API.", "odt:block:2"), (None, None, "x", "odt:block:3"), (None, None, "x", "odt:block:4"),
    ]


def test_archimate_sections():
    data = b"""<model xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><elements><element identifier="app" xsi:type="ApplicationComponent"><name>Vacation Portal</name></element>
      <element id="x2" name="Named"/></elements><relationships><relationship identifier="rel" xsi:type="ServingRelationship" source="app" target="db" /></relationships><views><view identifier="v-1"><name>Application  view</name></view></views></model>"""
    assert rows("archimate", data) == [
        ("ArchiMate elements", 1, "Vacation Portal | ApplicationComponent | id=app\nNamed | id=x2", "archimate:elements"),
        ("ArchiMate relationships", 1, "rel | ServingRelationship | app -> db", "archimate:relationships"),
        ("ArchiMate views", 1, "Application view | id=v-1", "archimate:views"),
    ]
    assert rows("archimate", b"<model><x>some text</x></model>")[0][3] == "archimate:xml"


def book(sheets):
    shared, main, office = [], "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(ref, v):
        if isinstance(v, str):
            shared.append(v)
            return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>' if isinstance(v, bool) else f'<c r="{ref}"><v>{v}</v></c>'

    members = {}
    for n, (_, cells) in enumerate(sheets, 1):
        by_row = {}
        for (row, column), v in cells.items():
            by_row.setdefault(row, []).append(cell(f"{column}{row}", v))
        members[f"xl/worksheets/s{n}.xml"] = f'<worksheet xmlns="{main}"><cols><col/></cols><sheetData>{"".join(f"<row r={chr(34)}{r}{chr(34)}>{chr(32).join(c)}</row>" for r, c in by_row.items())}</sheetData></worksheet>'
    members["xl/sharedStrings.xml"] = f'<sst xmlns="{main}">{"".join(f"<si><r><t>{t[:2]}</t></r><r><t>{t[2:]}</t></r></si>" for t in shared)}</sst>'
    members["xl/workbook.xml"] = f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{"".join(f"<sheet name={chr(34)}{n}{chr(34)} r:id={chr(34)}r{k}{chr(34)}/>" for k, (n, _) in enumerate(sheets, 1))}</sheets></workbook>'
    members["xl/_rels/workbook.xml.rels"] = f'<Relationships>{"".join(f"<Relationship Id={chr(34)}r{k}{chr(34)} Target={chr(34)}worksheets/s{k}.xml{chr(34)}/>" for k in range(1, len(sheets) + 1))}</Relationships>'
    return zipped(members)


def test_xlsx_sheets_are_sections():
    data = book([("SID Entities", {(1, "A"): "Entity", (1, "B"): "De|sc", (2, "A"): "Customer", (2, "C"): 3, (4, "AA"): 2.50, (4, "B"): True}), ("Empty Sheet", {}), (" Notice ", {(1, "A"): "legal"})])
    assert rows("xlsx", data) == [("Sheet: SID Entities", 1, "Entity | De\\|sc\nCustomer |  | 3\n" + " | ".join(["", "True", *[""] * 24, "2.5"]), "xlsx:sheet:1;rows:1-4;sheet:sid-entities")]
    domains = [("All Domains", {(1, "A"): "again"})] + [(t, {(1, "A"): t}) for t in ("Product", "Service", "Resource")]
    assert [r[0] for r in rows("xlsx", book(domains))] == ["Sheet: Product", "Sheet: Service", "Sheet: Resource"]
    assert [r[0] for r in rows("xlsx", book(domains[:3]))] == ["Sheet: All Domains", "Sheet: Product", "Sheet: Service"]


def test_html_blocks():
    page = b"<html><head><title>t</title><script>var a = '<p>no</p>';</script></head><body><p>lead<br> in</p><h2>Apps &amp; co</h2><p>Main <b>flow</b>.</p><ul><li>one <p>two</p></li></ul><h3>None</h3></body></html>"
    assert rows("html", page) == [(None, None, "lead in", "html:block:1-1"), ("Apps & co", 2, "Main flow .\none two\ntwo", "html:block:2-5;heading:apps-co")]
    assert rows("htm", b"<div>only <i>text</i></div>") == [(None, None, "only\ntext", "html:block:1-1")]


def test_lines_json_and_fallbacks():
    assert rows("md", b"# General Information\n\nSystem overview.\n\n## Business Architecture\n\nActor.\n3.1 Roles\n") == [
        ("General Information", 1, "System overview.", "lines:1-4;heading:general-information"), ("Business Architecture", 2, "Actor.", "lines:5-7;heading:business-architecture"), ("3.1 Roles", 1, "3.1 Roles", "lines:8-8;heading:3-1-roles"),
    ]
    assert rows("json", '{"a": ["é"]}'.encode()) == [(None, None, json.dumps({"a": ["é"]}, indent=2, ensure_ascii=False), "lines:1-5")]
    assert list(s.parsed("c.csv", "csv", b"sku,name\n1,Router"))[0][1:] == ("fallback_text", "text-fallback", 1, None, None, "sku,name\n1,Router", "fallback:1", None)
    assert list(s.parsed("a.bin", "bin", b"PK\3\4\0\0\1\2"))[0][-1] == "binary content"
    assert list(s.parsed("a.docx", "docx", b"no zip"))[0][-1].startswith("BadZipFile") and list(s.parsed("a.txt", "txt", b" \n"))[0][-1] == "no text"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "in").mkdir()
    (root / "in" / "a.docx").write_bytes(docx_file(word("Head", style="a1") + word("text")))
    (root / "in" / "b.MD").write_text("# T\nbody")
    (root / "big.txt").write_text("x" * 5000)
    (root / "broken.xlsx").write_bytes(b"no")
    (root / "typed").write_bytes(b"<p>by media type</p>")
    return root


def test_both_ways_give_the_same_rows(spark, folder):
    s.register(spark)
    plain = lambda df: Counter((Path(r.path).name, *r[1:]) for r in df.collect())
    one = plain(spark.read.format("section_documents").option("maxBytes", 4000).option("partitionBytes", 10).load(str(folder)))
    assert one == plain(s.read_sections(spark, str(folder), 4000))
    assert {(r[0], r[-1]) for r in one if r[-1]} == {("big.txt", "larger than 4000 bytes"), ("broken.xlsx", "BadZipFile: File is not a zip file")}
    types = spark.createDataFrame([(f"file:{folder}/typed", "Text/HTML; charset=x")], "path string, media_type string")
    assert [r.content for r in s.read_sections(spark, str(folder), media_types=types).where("format = 'html'").collect()] == ["by media type"]


def test_length_reaches_the_source(spark, folder):
    plan = s.read_sections(spark, str(folder), 4000)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,4000)" in plan


def test_export_commits_appends_and_overwrites(spark, tmp_path):
    s.register(spark)
    to = str(tmp_path / "out")
    frame = lambda *names: spark.createDataFrame([(n, k, f"H {k}", k, f"line {n}\n& <more>") for n in names for k in (2, 1)], "path string, number int, heading string, level int, content string")
    read = lambda: Counter((Path(r.path).name, r.heading, r.level, r.content) for r in spark.read.format("section_documents").load(to).collect())
    want = lambda *names: Counter((f"{n}.docx", f"H {k}", k, f"line {n}\n& <more>") for n in names for k in (1, 2))
    export.export_documents(frame("a", "b"), to, "docx")
    assert read() == want("a", "b")
    export.export_documents(frame("c"), to, "docx", "append")
    # what a failed task left doesn't count
    Path(to, "part-lost").mkdir()
    Path(to, "part-lost", "z.docx").write_bytes(b"")
    assert read() == want("a", "b", "c")
    export.export_documents(frame("d"), to, "docx")
    assert read() == want("d")
    export.export_documents(frame("d").limit(0), to, "docx")
    assert not read()


@pytest.mark.parametrize("kind", ["odt", "html", "archimate"])
def test_other_writers(kind):
    if kind == "archimate":
        given = [{"heading": "ArchiMate elements", "level": 1, "content": "A & b | Node | id=n\nC | id=x2"}, {"heading": "ArchiMate relationships", "level": 1, "content": "r | Flow | n -> x2"}]
    else:
        given = [{"heading": "One", "level": 2, "content": "a\nb <c>"}]
    want = {"odt": [("One", 2, "One"), (None, None, "a"), (None, None, "b <c>")], "html": [("One", 2, "a\nb <c>")], "archimate": [(x["heading"], 1, x["content"]) for x in given]}
    assert [r[:3] for r in rows(kind, export.WRITERS[kind](given))] == want[kind]


def test_writer_refuses(spark, tmp_path):
    with pytest.raises(ValueError, match="documentFormat"):
        export.SectionWriter(f"file://{tmp_path}", "pdf", ["path"], False)
    with pytest.raises(ValueError, match="missing"):
        export.SectionWriter(f"file://{tmp_path}", "docx", ["path"], False)


def test_small_files_are_dealt_and_leave_in_large_batches(tmp_path):
    """Files of any size make tasks of bounded work, and their rows leave in few batches."""
    for n in range(1200):
        (tmp_path / f"{n}.txt").write_text(f"text number {n}")
    reader = s._Reader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) == 3 and sum(len(p.files) for p in parts) == 1200
    batches = [list(reader.read(p)) for p in parts]
    assert [len(b) for b in batches] == [1, 1, 1]
    assert {r["content"] for b in batches for r in b[0].to_pylist()} == {f"text number {n}" for n in range(1200)}

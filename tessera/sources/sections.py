"""Documents as sections: readers of nine formats that keep headings, levels and locations.

Two ways lead to the same rows ``(path, format, parser, number, heading, level, content,
location, error)``. :func:`read_sections` takes scanned files, from any store that Spark
reads. :class:`SectionSource` is a data source of its own,
``spark.read.format("section_documents").load(folder)``: the driver lists the files, puts
them into partitions of about ``partitionBytes``, and tasks read and parse them one at a
time. XML is parsed by events, a block at a time.

Defined results: a file larger than ``maxBytes`` is a row with an error whose bytes are
never read; a file that its parser can't read, and one without text, are rows with an
error too; other files of unknown format give their best decoding as one section, binary
ones a row with an error. Empty sections are left out. Cells of spreadsheets give their stored
values; dates are the numbers that are stored.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple
from xml.etree.ElementTree import Element, iterparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import MAX_BYTES, decoded, suffix

SCHEMA = "path string, format string, parser string, number int, heading string, level int, content string, location string, error string"
#: The two patterns of a heading line: fixed values.
HEADING_LINE = r"#{1,6}\s+.+|\d+(?:\.\d+)*\s+.+"
_HEADING = re.compile(f"(?:{HEADING_LINE})$")
#: Formats by media type, for files without a known suffix: fixed values.
MEDIA_TYPES = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.oasis.opendocument.text": "odt",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "text/html": "html",
    "text/markdown": "md",
    "text/plain": "txt",
    "application/json": "json",
    "text/json": "json",
}
#: Sheets that say nothing, and the one that repeats the others: fixed values.
LOW_VALUE_SHEETS = ("document title", "notice", "administrative appendix")
SUMMARY_SHEET = "all domains"


class Section(NamedTuple):
    heading: str | None
    level: int | None
    content: str
    location: str


def slug(heading: str | None) -> str:
    """A heading as a part of a location."""
    return re.sub(r"[^a-zA-Z0-9а-яА-ЯёЁ]+", "-", (heading or "").strip().lower()).strip("-")[:80] or "section"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(e: Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def _flat(e: Element) -> str:
    return " ".join("".join(e.itertext()).split())


def _blocks(stream, depth: int) -> Iterator[Element]:
    """The elements at this depth below the root, each dropped when the next one comes."""
    above: list[Element] = []
    for event, e in iterparse(stream, ("start", "end")):
        if event == "start":
            above.append(e)
        else:
            above.pop()
            if len(above) == depth:
                yield e
                above[-1].clear()


class Grouping:
    """Blocks gathered under the last heading; a heading without content gives no section."""

    def __init__(self, kind: str):
        self.kind, self.heading, self.level = kind, None, None
        self.lines: list[str] = []
        self.first, self.last = 1, 0

    def closed(self, at: int) -> Iterator[Section]:
        """The section so far, if it has content; the next begins behind block ``at``."""
        if self.lines:
            where = f"{self.kind}:block:{self.first}-{max(self.first, self.last)}"
            yield Section(self.heading, self.level, "\n".join(self.lines), f"{where};heading:{slug(self.heading)}" if self.heading else where)
            self.lines, self.first = [], at + 1

    def headed(self, at: int, heading: str, level: int | None) -> Iterator[Section]:
        yield from self.closed(at)
        self.heading, self.level, self.first, self.last = heading, level, at, at

    def add(self, at: int, text: str) -> None:
        self.lines.append(text)
        self.last = at


def _docx_text(p: Element) -> str:
    """A paragraph's runs, also those of links, with tabs and breaks."""
    signs = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
    out = []
    for child in p:
        for run in [child] if _local(child.tag) == "r" else list(child) if _local(child.tag) == "hyperlink" else []:
            out += [(x.text or "") if _local(x.tag) == "t" else signs.get(_local(x.tag), "") for x in run]
    return "".join(out).strip()


def _docx_rows(table: Element) -> Iterator[str]:
    """Rows of a table; a merged cell counts in each place that it covers."""
    above: list[str] = []
    for row in (r for r in table if _local(r.tag) == "tr"):
        cells: list[str] = []
        for cell in (c for c in row if _local(c.tag) == "tc"):
            marks = {_local(m.tag): m for p in cell if _local(p.tag) == "tcPr" for m in p}
            span = int(_attribute(marks["gridSpan"], "val") or 1) if "gridSpan" in marks else 1
            goes_on = "vMerge" in marks and (_attribute(marks["vMerge"], "val") or "continue") == "continue"
            text = "\n".join(_docx_text(p) for p in cell if _local(p.tag) == "p").strip()
            cells += [above[len(cells)] if goes_on and len(cells) < len(above) else text] * span
        above = cells
        if any(cells):
            yield " | ".join(filter(None, cells))


def docx(data: bytes) -> Iterator[Section]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        styles = {}
        if "word/styles.xml" in z.namelist():
            for style in (e for e in _blocks(z.open("word/styles.xml"), 1) if _local(e.tag) == "style"):
                styles[_attribute(style, "styleId")] = next((_attribute(n, "val") or "" for n in style if _local(n.tag) == "name"), "")
        group, tables = Grouping("docx"), 0
        at = 0
        for e in _blocks(z.open("word/document.xml"), 2):
            if _local(e.tag) == "p":
                at += 1
                text = _docx_text(e)
                style = next((_attribute(s, "val") or "" for m in e if _local(m.tag) == "pPr" for s in m if _local(s.tag) == "pStyle"), "")
                name = styles.get(style, style)
                if text and name.lower().startswith("heading"):
                    number = re.search(r"\d+$", name.strip())
                    yield from group.headed(at, text, int(number[0]) if number else 1)
                elif text:
                    group.add(at, text)
            elif _local(e.tag) == "tbl":
                at, tables = at + 1, tables + 1
                if rows := list(_docx_rows(e)):
                    group.add(at, "\n".join([f"Table {tables}", *rows]))
        yield from group.closed(at)


def odt(data: bytes) -> Iterator[Section]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        number = 0
        # the children of the body's text; a cell comes before the paragraphs in it
        for block in _blocks(z.open("content.xml"), 3):
            for e in (e for e in block.iter() if _local(e.tag) in ("h", "p", "table-cell")):
                if text := _flat(e):
                    number += 1
                    head = _local(e.tag) == "h"
                    level = _attribute(e, "outline-level") if head else None
                    yield Section(text if head else None, int(level) if level and level.isdigit() else None, text, f"odt:block:{number}")


def archimate(data: bytes) -> Iterator[Section]:
    lines: dict[str, list[tuple[int, str]]] = {"element": [], "relationship": [], "view": []}
    begun: list[int] = []
    number = 0
    for event, e in iterparse(io.BytesIO(data), ("start", "end")):
        kind = _local(e.tag)
        if kind not in lines:
            continue
        if event == "start":
            number += 1
            begun.append(number)
            continue
        name = _attribute(e, "name") or next((t for c in e if _local(c.tag) == "name" and (t := _flat(c))), None) or _attribute(e, "identifier")
        key = _attribute(e, "identifier") or _attribute(e, "id")
        ends = (_attribute(e, "source"), _attribute(e, "target"))
        last = (f"{ends[0]} -> {ends[1]}" if any(ends) else None) if kind == "relationship" else f"id={key}" if key else None
        lines[kind].append((begun.pop(), " | ".join(filter(None, (name, _attribute(e, "type") or _attribute(e, "archimateType"), last)))))
        e.clear()
    for kind, plural in (("element", "elements"), ("relationship", "relationships"), ("view", "views")):
        if lines[kind]:
            yield Section(f"ArchiMate {plural}", 1, "\n".join(t for _, t in sorted(lines[kind])), f"archimate:{plural}")
    if not any(lines.values()):
        yield Section("ArchiMate XML", 1, (decoded(data) or "").strip(), "archimate:xml")


def _column(reference: str) -> int:
    """The number of a cell's column, from 0."""
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(c: Element, shared: list[str]) -> str:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return " ".join("".join(t.text or "" for t in c.iter() if _local(t.tag) == "t").split())
    value = next((v.text or "" for v in c if _local(v.tag) == "v"), "")
    if kind == "s" and value:
        value = shared[int(value)]
    elif kind == "b":
        value = "True" if value == "1" else "False"
    elif kind == "n" and value and not re.fullmatch(r"-?\d+", value):
        value = str(float(value))
    return " ".join(value.split())


def xlsx(data: bytes) -> Iterator[Section]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in e.iter() if _local(t.tag) == "t") for e in _blocks(z.open("xl/sharedStrings.xml"), 1) if _local(e.tag) == "si"]
        targets = {e.get("Id"): e.get("Target", "") for e in _blocks(z.open("xl/_rels/workbook.xml.rels"), 1)}
        sheets = [(e.get("name", ""), targets.get(_attribute(e, "id"), "")) for e in _blocks(z.open("xl/workbook.xml"), 2) if _local(e.tag) == "sheet"]
        key = lambda name: " ".join(name.casefold().split())
        telling = sum(key(n) not in (*LOW_VALUE_SHEETS, SUMMARY_SHEET) for n, _ in sheets)
        for number, (name, target) in enumerate(sheets, 1):
            if key(name) in LOW_VALUE_SHEETS or key(name) == SUMMARY_SHEET and telling >= 3:
                continue
            rows, found = [], []
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for row in (r for r in _blocks(z.open(part), 2) if _local(r.tag) == "row"):
                cells: dict[int, str] = {}
                for c in (c for c in row if _local(c.tag) == "c"):
                    cells[_column(c.get("r", "")) if c.get("r") else len(cells)] = _cell(c, shared).replace("|", "\\|")
                at = int(row.get("r") or (rows[-1] if rows else 0) + 1)
                if last := max((k for k, v in cells.items() if v), default=-1) + 1:
                    rows.append(at)
                    found.append(" | ".join(cells.get(k, "") for k in range(last)))
            if found:
                yield Section(f"Sheet: {name}", 1, "\n".join(found), f"xlsx:sheet:{number};rows:{rows[0]}-{rows[-1]};sheet:{slug(name)}")


class _Page(HTMLParser):
    """The headings, paragraphs and list items of a page, in order of their beginning."""

    KINDS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li")
    SILENT = ("script", "style", "noscript")
    VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []
        self.found: list[tuple[str, list[str]]] = []
        self.silent = 0
        self.all: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        held = None
        if tag in self.KINDS and not self.silent:
            held = []
            self.found.append((tag, held))
        self.open.append((tag, held))
        self.silent += tag in self.SILENT

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while True:
                last, _ = self.open.pop()
                self.silent -= last in self.SILENT
                if last == tag:
                    return

    def handle_data(self, data):
        if (text := data.strip()) and not self.silent:
            self.all.append(text)
            for _, held in self.open:
                if held is not None:
                    held.append(text)


def html(data: bytes) -> Iterator[Section]:
    page = _Page()
    page.feed(data.decode("utf-8", "ignore"))
    page.close()
    group, at = Grouping("html"), 0
    some = False
    for tag, pieces in page.found:
        if not pieces:
            continue
        at += 1
        text = " ".join(pieces)
        if tag[0] == "h":
            made = list(group.headed(at, text, int(tag[1])))
            some |= bool(made)
            yield from made
        else:
            group.add(at, text)
    made = list(group.closed(at))
    yield from made
    if not made and not some and page.all:
        yield Section(None, None, "\n".join(page.all), "html:block:1-1")


def lines(text: str) -> Iterator[Section]:
    """Sections of marked or numbered heading lines; a heading without content is its own content."""
    heading, level, held, first, number = None, None, [], 1, 0

    def closed() -> Iterator[Section]:
        content = "\n".join(held).strip()
        if content or heading is not None:
            where = f"lines:{first}-{max(first, last)}"
            yield Section(heading, level, content or heading, f"{where};heading:{slug(heading)}" if heading else where)

    last = 0
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if _HEADING.match(line):
            yield from closed()
            bare = line.lstrip("#")
            heading, level, held, first, last = bare.strip(), max(1, len(line) - len(bare)), [], number, number
        else:
            held.append(raw.rstrip())
            last = number
    yield from closed()


def _text(data: bytes) -> Iterator[Section]:
    return lines(data.decode("utf-8", "ignore"))


def _json(data: bytes) -> Iterator[Section]:
    text = data.decode("utf-8", "ignore")
    try:
        text = json.dumps(json.loads(text), ensure_ascii=False, indent=2)
    except ValueError:
        pass
    return lines(text)


PARSERS = {
    "docx": ("docx-xml", docx), "odt": ("odt-xml", odt), "archimate": ("archimate-xml", archimate), "xlsx": ("xlsx-xml", xlsx), "html": ("html-events", html), "htm": ("html-events", html),
    "md": ("markdown-structured", _text), "markdown": ("markdown-structured", _text), "txt": ("plain-text", _text), "text": ("plain-text", _text), "json": ("json-normalized", _json),
}


def parsed(path: str, kind: str, data: bytes) -> Iterator[tuple]:
    """The rows of one file."""
    if kind in PARSERS:
        parser, parse = PARSERS[kind]
        number = 0
        try:
            for section in parse(data):
                if section.content.strip():
                    number += 1
                    yield (path, kind, parser, number, *section, None)
        except Exception as e:  # a document's failure is a row
            yield (path, kind, parser, 0, None, None, None, None, f"{type(e).__name__}: {e}"[:200])
            return
        if not number:
            yield (path, kind, parser, 0, None, None, None, None, "no text")
    elif (text := decoded(data)) and text.strip():
        yield (path, "fallback_text", "text-fallback", 1, None, None, text.replace("\0", "").strip(), "fallback:1", None)
    else:
        yield (path, "fallback_binary", "binary-fallback", 0, None, None, None, None, "binary content")


def _too_large(path: str, kind: str, most: int) -> tuple:
    return (path, kind, "none", 0, None, None, None, None, f"larger than {most} bytes")


def kind_of(path: Column, media_type: Column | None = None) -> Column:
    """The format of a file: its suffix where that is known, else its media type's."""
    own = suffix(path)
    if media_type is None:
        return own
    known = [F.when(F.trim(F.lower(F.substring_index(media_type, ";", 1))) == m, F.lit(k)) for m, k in MEDIA_TYPES.items()]
    return F.when(own.isin(*PARSERS, "pdf"), own).otherwise(F.coalesce(*known, own))


def _batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32()}
    fields = [tuple(f.split()) for f in SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of up to ``BATCH_ROWS`` and about ``BATCH_CHARACTERS``: most files have few rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[6] or "")
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARACTERS:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def read_sections(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, media_types: DataFrame | None = None) -> DataFrame:
    """The section rows of all files below ``root``, in any store that Spark reads.

    The bound on length reaches the file source, so the bytes of larger files aren't
    read. ``media_types`` may give ``(path, media_type)``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = files.where(F.col("length") <= max_bytes).select("path", "content")
    if media_types is not None:
        small = small.join(media_types.select("path", "media_type"), "path", "left").withColumn("kind", kind_of(F.col("path"), F.col("media_type")))
    else:
        small = small.withColumn("kind", kind_of(F.col("path")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = zip(batch.column("path").to_pylist(), batch.column("kind").to_pylist(), batch.column("content"), strict=True)
            yield from _batches(row for path, kind, data in files for row in parsed(path, kind, data.as_py()))

    read = small.select("path", "kind", "content").mapInArrow(run, SCHEMA)
    large = files.where(F.col("length") > max_bytes).select("path", kind_of(F.col("path")).alias("format"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("heading", "string"), ("level", "int"), ("content", "string"), ("location", "string"))]
    return read.unionByName(large.select("path", "format", F.lit("none").alias("parser"), F.lit(0).alias("number"), *none, F.lit(f"larger than {max_bytes} bytes").alias("error")))


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = _uri(options["path"])
        self.most = int(options.get("maxBytes", MAX_BYTES))
        self.share = int(options.get("partitionBytes", 8 << 20))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.root)
        found = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file]
        inside = lambda f: f.path[len(root.rstrip("/")) + 1 :]
        # what tasks left that were not committed isn't part of an exported folder
        if any(inside(f) == COMMITTED for f in found):
            with store.open_input_stream(f"{root.rstrip('/')}/{COMMITTED}") as s:
                parts = set(json.loads(s.read())["parts"])
            found = [f for f in found if inside(f).split("/")[0] in parts]
        found = [f for f in found if not f.base_name.startswith(("_", "."))]
        out, held, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            # a small file costs its opening and parsing, and packed text grows when it is read
            cost = min(f.size, self.most) + FILE_COST
            if held and size + cost > self.share:
                out.append(Files(held))
                held, size = [], 0
            held.append((f.path, f.size))
            size += cost
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.root)

        def rows() -> Iterator[tuple]:
            for path, size in partition.files:
                kind = (re.search(r"\.([A-Za-z0-9]+)$", path) or ["", ""])[1].lower()
                if size > self.most:
                    yield _too_large(path, kind, self.most)
                    continue
                with store.open_input_stream(path) as s:
                    data = s.read()
                yield from parsed(path, kind, data)

        yield from _batches(rows())


#: What a file adds to its length where files are dealt to tasks: about 500 small ones make a task.
FILE_COST = 1 << 14
#: Rows and characters of content that leave a task at once.
BATCH_ROWS, BATCH_CHARACTERS = 1024, 1 << 22
#: The file of an exported folder that names the parts that count.
COMMITTED = "_committed.json"


class SectionSource(DataSource):
    """``section_documents``: reads files to sections; writes sections to files (see ``export``).

    Options: ``path`` a folder (a local path or an absolute URI that pyarrow opens),
    ``maxBytes``, ``partitionBytes``; for writing ``documentFormat``.
    """

    @classmethod
    def name(cls) -> str:
        return "section_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool):
        from .export import SectionWriter

        return SectionWriter(_uri(self.options["path"]), self.options.get("documentFormat", "docx"), [f.name for f in schema], overwrite)


def _uri(path: str) -> str:
    return path if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path) else f"file://{path}"


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("section_documents")`` known to this session."""
    spark.dataSource.register(SectionSource)

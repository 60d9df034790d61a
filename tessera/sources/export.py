"""Sections written as document files: DOCX, ODT, ArchiMate models, HTML.

Each task writes its documents into a folder of its own. When all tasks are done the driver
writes one small file that names those folders; readers of the folder take these
only, so that a failed or repeated task leaves nothing that counts. Overwriting replaces the
list, then the old folders go; appending adds to it.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from .sections import COMMITTED, register

#: Characters that XML can't hold.
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_ODF = "urn:oasis:names:tc:opendocument:xmlns"
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'


def _xml(text: str) -> str:
    return escape(_FORBIDDEN.sub("", text))


def _zip(members: list[tuple[str, str]], stored: tuple[str, ...] = ()) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members:
            z.writestr(zipfile.ZipInfo(name), text.encode(), zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _paragraphs(sections: list[dict]) -> Iterator[tuple[int, str]]:
    """``(level, text)``: headings with their level, lines of content with 0."""
    for s in sections:
        if s["heading"]:
            yield max(1, min(6, s["level"] or 1)), s["heading"]
        if s["content"] and s["content"] != s["heading"]:
            for line in s["content"].split("\n"):
                yield 0, line


def docx(sections: list[dict]) -> bytes:
    def paragraph(level: int, text: str) -> str:
        style = f'<w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>' if level else ""
        return f'<w:p>{style}<w:r><w:t xml:space="preserve">{_xml(text)}</w:t></w:r></w:p>'

    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/></w:style>' for n in range(1, 7))
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    return _zip(
        [
            ("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
             f'<Override PartName="/word/document.xml" ContentType="{main}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{main}.styles+xml"/></Types>'),
            ("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>'),
            ("word/_rels/document.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>'),
            ("word/styles.xml", f'{_HEAD}<w:styles xmlns:w="{_W}">{styles}</w:styles>'),
            ("word/document.xml", f'{_HEAD}<w:document xmlns:w="{_W}"><w:body>{"".join(paragraph(*p) for p in _paragraphs(sections))}</w:body></w:document>'),
        ]
    )


def odt(sections: list[dict]) -> bytes:
    def block(level: int, text: str) -> str:
        return f'<text:h text:outline-level="{level}">{_xml(text)}</text:h>' if level else f"<text:p>{_xml(text)}</text:p>"

    kind = "application/vnd.oasis.opendocument.text"
    body = "".join(block(*p) for p in _paragraphs(sections))
    return _zip(
        [
            ("mimetype", kind),
            ("META-INF/manifest.xml", f'{_HEAD}<manifest:manifest xmlns:manifest="{_ODF}:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{kind}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'),
            ("content.xml", f'{_HEAD}<office:document-content xmlns:office="{_ODF}:office:1.0" xmlns:text="{_ODF}:text:1.0" office:version="1.3"><office:body><office:text>{body}</office:text></office:body></office:document-content>'),
        ],
        stored=("mimetype",),
    )


def html(sections: list[dict]) -> bytes:
    blocks = (f"<h{level}>{_xml(text)}</h{level}>" if level else f"<p>{_xml(text)}</p>" for level, text in _paragraphs(sections))
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"></head><body>{"".join(blocks)}</body></html>'.encode()


def archimate(sections: list[dict]) -> bytes:
    """A model of the lines ``name | type | id=...`` of the sections of elements and views, ``name | type | a -> b`` of relationships."""
    parts = {}
    for plural, kind in (("elements", "element"), ("relationships", "relationship"), ("views", "view")):
        items = []
        for line in (x for s in sections if s["heading"] == f"ArchiMate {plural}" for x in s["content"].split("\n")):
            fields = line.split(" | ")
            ends = re.match(r"(.*) -> (.*)$", fields[-1]) if kind == "relationship" else None
            key = fields[-1].removeprefix("id=") if fields[-1].startswith("id=") else None
            rest = fields[:-1] if ends or key else fields
            marks = {"xsi:type": rest[1] if len(rest) > 1 else None, "identifier": key, "source": ends and ends[1], "target": ends and ends[2]}
            text = " ".join(f'{k}="{_xml(v)}"' for k, v in marks.items() if v)
            items.append(f"<{kind} {text}>{f'<name>{_xml(rest[0])}</name>' if rest else ''}</{kind}>")
        parts[plural] = f"<{plural}>{''.join(items)}</{plural}>" if items else ""
    return f'{_HEAD}<model xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">{"".join(parts.values())}</model>'.encode()


WRITERS = {"docx": docx, "odt": odt, "html": html, "archimate": archimate}


@dataclass
class Part(WriterCommitMessage):
    folder: str
    files: int


class SectionWriter(DataSourceArrowWriter):
    """Rows ``(path, heading, level, content)``, those of a path together and in order; ``path`` is the file's name without suffix."""

    def __init__(self, folder: str, kind: str, columns: list[str], overwrite: bool):
        if kind not in WRITERS:
            raise ValueError(f"documentFormat is one of {', '.join(WRITERS)}")
        if missing := {"path", "heading", "level", "content"} - set(columns):
            raise ValueError(f"missing columns: {sorted(missing)}")
        self.folder, self.kind, self.overwrite = folder.rstrip("/"), kind, overwrite

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, root = self._store()
        part, count = f"part-{uuid.uuid4().hex}", 0
        store.create_dir(f"{root}/{part}", recursive=True)
        rows = (r for batch in iterator for r in batch.select(["path", "heading", "level", "content"]).to_pylist())
        for path, sections in groupby(rows, key=lambda r: r["path"]):
            with store.open_output_stream(f"{root}/{part}/{path}.{self.kind}") as out:
                out.write(WRITERS[self.kind](list(sections)))
            count += 1
        return Part(part, count)

    def _listed(self, store, root: str) -> list[str]:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{COMMITTED}").type == fs.FileType.NotFound:
            return []
        with store.open_input_stream(f"{root}/{COMMITTED}") as s:
            return json.loads(s.read())["parts"]

    def commit(self, messages: list[Part | None]) -> None:
        store, root = self._store()
        store.create_dir(root, recursive=True)
        old, new = self._listed(store, root), [m.folder for m in messages if m]
        with store.open_output_stream(f"{root}/{COMMITTED}.new") as s:
            s.write(json.dumps({"parts": new if self.overwrite else old + new}).encode())
        store.move(f"{root}/{COMMITTED}.new", f"{root}/{COMMITTED}")
        for folder in old if self.overwrite else []:
            store.delete_dir(f"{root}/{folder}")

    def abort(self, messages: list[Part | None]) -> None:
        store, root = self._store()
        for m in messages:
            if m:
                store.delete_dir(f"{root}/{m.folder}")


def export_documents(sections: DataFrame, folder: str, kind: str, mode: str = "overwrite") -> None:
    """Write one file for each ``path`` of ``(path, number, heading, level, content)``."""
    register(sections.sparkSession)
    rows = sections.select(F.col("path").cast("string").alias("path"), "number", "heading", F.col("level").cast("int").alias("level"), "content").repartition("path").sortWithinPartitions("path", "number")
    rows.write.format("section_documents").option("documentFormat", kind).mode(mode).save(folder)

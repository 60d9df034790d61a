"""Queries over readers and sinks of document files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators.shared import shared_path
from tessera.sources.export import export_documents
from tessera.sources.sections import lines, register

from .base import query, table

#: White space of any script, and characters that XML can't hold.
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NONE = r"[\x00-\x08\x0E-\x1B\x{FFFE}\x{FFFF}]"
_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"

_SLUG = "coalesce(nullif(substr(trim(regexp_replace(lower({0}), '[^a-zA-Z0-9а-яА-ЯёЁ]+', '-', 'g'), '-'), 1, 80), ''), 'section')"


@query(rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '{_NONE}', '', 'g'), '{_SPACE}+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents),
g AS (SELECT doc_id, j, ls[4 * j + 1] AS heading, 1 + j % 3 AS level, CASE WHEN ls[4 * j + 2:4 * j + 4] = [ls[4 * j + 1]] THEN [] ELSE ls[4 * j + 2:4 * j + 4] END AS body FROM (SELECT doc_id, ls, unnest(range((len(ls) + 3) // 4)) AS j FROM l)),
kinds AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'odt' ELSE 'html' END AS format FROM g)
SELECT doc_id, format, (j + 1)::INT AS number, heading, level::INT AS level, array_to_string(body, chr(10)) AS content, format || ':block:' || (4 * j + 1) || '-' || (4 * j + 1 + len(body)) || ';heading:' || {_SLUG.format("heading")} AS location FROM kinds WHERE format <> 'odt' AND len(body) > 0
UNION ALL SELECT doc_id, format, (4 * j + o)::INT, CASE WHEN o = 1 THEN heading END, CASE WHEN o = 1 THEN level::INT END, ([heading] || body)[o], 'odt:block:' || (4 * j + o) FROM (SELECT *, unnest(range(1, len(body) + 2)) AS o FROM kinds WHERE format = 'odt')
UNION ALL SELECT doc_id, format, 1, NULL, NULL, heading, 'html:block:1-1' FROM kinds WHERE format = 'html' AND j = 0 AND len(body) = 0""")
def read_back_sections(spark, sf):
    """Every document is written as a DOCX, ODT or HTML file and read again as sections.

    Of a document's lines each fourth is a heading over the next three.
    """
    ls = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, _NONE, ""), f"{_SPACE}+", " "))), lambda x: x != "")
    docs = table(spark, sf, "documents").select("doc_id", ls.alias("ls"))
    # the first number of each heading; none without lines: a filter on their number would make all lines twice
    firsts = F.when(F.size("ls") > 0, F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / 4).cast("int")))
    parts = docs.select("doc_id", "ls", F.explode(firsts).alias("number"))
    parts = parts.select(F.col("doc_id").alias("path"), "number", F.get("ls", 4 * F.col("number")).alias("heading"), (1 + F.col("number") % 3).alias("level"), F.array_join(F.slice("ls", 4 * F.col("number") + 2, 3), "\n").alias("content"))
    register(spark)
    folder, found = shared_path(spark), None
    for k, kind in enumerate(("docx", "odt", "html")):
        export_documents(parts.where(F.col("path") % 3 == k), f"{folder}/{kind}", kind)
        read = spark.read.format("section_documents").load(f"{folder}/{kind}")
        found = read if found is None else found.unionByName(read)
    doc_id = F.regexp_extract("path", r"([^/]+)\.\w+$", 1).cast("bigint")
    # a document of one line is a heading without content: a row with an error, in a page its whole text
    return found.where("error is null").select(doc_id.alias("doc_id"), "format", "number", "heading", "level", "content", "location")


@query(rf"""WITH s AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{_BREAK}') AS ls FROM documents),
l AS (SELECT doc_id, i, regexp_replace(ls[i], '^{_SPACE}+|{_SPACE}+$', '', 'g') AS line, regexp_replace(ls[i], '{_SPACE}+$', '') AS raw FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + CASE WHEN ls[len(ls)] = '' THEN 0 ELSE 1 END)) AS i FROM s)),
h AS (SELECT *, regexp_full_match(line, '#{{1,6}}{_SPACE}+.+|\p{{Nd}}+(?:\.\p{{Nd}}+)*{_SPACE}+.+') AS head FROM l),
g AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM h),
a AS (SELECT doc_id, part, min(i) AS lo, max(i) AS hi, max(line) FILTER (head) AS line, regexp_replace(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT head), ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS body FROM g GROUP BY doc_id, part),
b AS (SELECT *, regexp_replace(regexp_replace(line, '^#+', ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS heading FROM a WHERE body <> '' OR line IS NOT NULL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part)::INT AS number, heading, CASE WHEN line IS NOT NULL THEN greatest(1, length(line) - length(regexp_replace(line, '^#+', '')))::INT END AS level, CASE WHEN body = '' THEN heading ELSE body END AS content,
'lines:' || lo || '-' || hi || CASE WHEN heading IS NULL THEN '' ELSE ';heading:' || {_SLUG.format("heading")} END AS location FROM b""")
def line_sections(spark, sf):
    """Whole texts as sections by marked and numbered heading lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, *s) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for n, s in enumerate(lines(t or ""), 1)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "number", "heading", "level", "content", "location"])

    return table(spark, sf, "documents").select("doc_id", "text").mapInArrow(run, "doc_id bigint, number int, heading string, level int, content string, location string")

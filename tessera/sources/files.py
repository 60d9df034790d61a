"""File sources and sinks: directory scans, URL lists, readers by format, version tables.

Readers return one row per document; a file that can't be read is a row with an
error, never a failed job.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of supported documents: fixed values.
SUFFIXES = ("pdf", "docx", "odt", "xlsx", "archimate", "html", "htm", "md", "markdown", "txt", "json")
MAX_BYTES = 104_857_600
ENCODINGS = ("utf-8", "utf-16", "cp1251", "cp866", "koi8-r", "latin-1")
#: Ordered words of a file's name that tell its type: fixed values.
NAME_TYPES = (
    ("api", ("api", "swagger", "openapi")),
    ("architecture", ("archimate", "modelling", "modeling")),
    ("technology", ("операцион", "технолог", "радар")),
    ("normative", ("norm", "policy", "rule", "requirement", "standard", "стандарт", "togaf")),
    ("architecture", ("arch", "component", "integration", "solution")),
    ("technology", ("tech", "stack", "deploy", "platform")),
)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def type_of_name(name: Column) -> Column:
    low = F.lower(name)
    any_of = lambda words: low.rlike("|".join(words))
    return F.coalesce(*[F.when(any_of(words), F.lit(kind)) for kind, words in NAME_TYPES], F.lit("other"))


def scan(spark: SparkSession, root: str, depth: int = 2, limit: int | None = 500, suffixes=SUFFIXES) -> DataFrame:
    """Supported files up to ``depth`` folders down, in order: ``(path, name, suffix, size, modified, content)``.

    ``limit`` is the scan's own bound of documents; None lifts it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("/")[-1]
    below = F.regexp_extract("path", rf"/{re.escape(base)}/(.*)$", 1)
    found = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), suffix(F.col("path")).alias("suffix"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", below.alias("below"))
    found = found.where(F.col("suffix").isin(*suffixes) & (F.size(F.split("below", "/")) <= depth + 1)).drop("below").orderBy("path")
    return found if limit is None else found.limit(limit)


def supported(url: Column) -> Column:
    """Whether a url's path ends in the suffix of a supported document."""
    return F.coalesce(suffix(F.regexp_extract(url, r"^([^?#]*)", 1)).isin(*SUFFIXES), F.lit(False))


def url_list(lines: DataFrame, base: str, column: str = "value", only_supported: bool = False) -> DataFrame:
    """The urls that the lines of a list name: blank lines and ``#`` lines are skipped, references resolved against ``base``.

    Unsafe http urls are left out, other schemes too; ``only_supported`` keeps urls with the suffix of a document.
    """
    from tessera.operators.links import resolved

    line = F.trim(F.col(column))
    url = resolved(F.lit(base), line)
    kept = lines.where((line != "") & ~F.startswith(line, F.lit("#"))).select(url.alias("url")).where(safe_url(F.col("url")))
    return kept.where(supported(F.col("url"))) if only_supported else kept


#: Hosts and literal networks that no reader may open: fixed values.
FORBIDDEN_HOSTS = ("localhost", "metadata", "metadata.google.internal", "host.docker.internal")
PRIVATE = r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^(22[4-9]|2[3-5][0-9])\.|^\[?(::1?|fe[89ab][0-9a-f]:|f[cd][0-9a-f]{2}:|ff)"


def safe_url(url: Column) -> Column:
    """Whether a url is http(s) and its host is neither forbidden nor a literal private address."""
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    return F.coalesce((host != "") & ~host.isin(*FORBIDDEN_HOSTS) & ~host.rlike(PRIVATE), F.lit(False))


def decoded(data: bytes) -> str | None:
    """The decoding whose share of printable characters is best and 0.85 at least; None for binary data."""
    if data.count(b"\0") > 0.05 * max(1, len(data)) and not data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return None
    best, score = None, 0.0
    for encoding in ENCODINGS:
        try:
            text = data.decode(encoding)
        except (UnicodeDecodeError, UnicodeError):
            continue
        printable = sum(c.isprintable() or c in "\n\r\t" for c in text) / max(1, len(text))
        value = printable + min(0.4, sum(map(str.isalnum, text)) / max(1, len(text)))
        if printable >= 0.85 and value > score + 1e-12:
            best, score = text, value
    return best


def _xml_text(data: bytes, member: str, blocks: tuple[str, ...]) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read(member))
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    return "\n".join(t for e in root.iter() if local(e) in blocks and (t := " ".join("".join(e.itertext()).split())))


def _sheet_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in e.iter() if local(t) == "t") for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(e) == "si"]
        out = []
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for row in (e for e in ElementTree.fromstring(z.read(name)).iter() if local(e) == "row"):
                cells = []
                for c in (e for e in row if local(e) == "c"):
                    value = "".join(v.text or "" for v in c.iter() if local(v) in ("v", "t"))
                    cells.append((shared[int(value)] if c.get("t") == "s" and value else value).replace("|", "\\|"))
                while cells and not cells[-1]:
                    cells.pop()
                if cells:
                    out.append(" | ".join(cells))
    return "\n".join(out)


def _model_text(data: bytes) -> str:
    """Elements, relationships and views of a model file, a line each."""
    root = ElementTree.fromstring(data)
    kinds = ("element", "relationship", "view")
    lines = []
    for kind in kinds:
        for e in (e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == kind):
            attributes = {k.rsplit("}", 1)[-1]: v for k, v in e.attrib.items()}
            label = next((" ".join("".join(c.itertext()).split()) for c in e if c.tag.rsplit("}", 1)[-1] in ("name", "label")), attributes.get("name", ""))
            ends = f" {attributes['source']} -> {attributes['target']}" if "source" in attributes else ""
            lines.append(f"{kind} {attributes.get('type', '')} {label}{ends}".strip())
    return "\n".join(lines)


def _html_text(data: bytes) -> str:
    page = decoded(data) or ""
    page = re.sub(r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ", page)
    page = re.sub(r"(?i)</?(p|div|li|h[1-6]|tr|br|ul|ol|table|section|article)\b[^>]*>", "\n", page)
    from html import unescape

    lines = (" ".join(unescape(re.sub(r"<[^>]*>", "", line)).split()) for line in page.split("\n"))
    return "\n".join(filter(None, lines))


READERS = {
    "docx": lambda d: _xml_text(d, "word/document.xml", ("p",)),
    "odt": lambda d: _xml_text(d, "content.xml", ("h", "p")),
    "xlsx": _sheet_text,
    "archimate": _model_text,
    "html": _html_text,
    "htm": _html_text,
    "json": lambda d: json.dumps(json.loads(d.decode("utf-8")), indent=2, ensure_ascii=False),
}


def read_documents(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(path, parser, text, error)`` of scanned files, by suffix; plain text for the rest.

    Files that are too large, broken, binary or empty have an error and no text.
    """

    def one(kind: str, size: int, data: bytes) -> tuple[str, str | None, str | None]:
        if size > max_bytes:
            return "none", None, f"larger than {max_bytes} bytes"
        parser = kind if kind in READERS else "text"
        try:
            text = READERS[kind](data) if kind in READERS else decoded(data)
        except Exception as e:  # a document's failure is a row
            return parser, None, f"{type(e).__name__}: {e}"[:200]
        if text is None:
            return "fallback", None, "binary content"
        return (parser, text, None) if text.strip() else (parser, None, "no text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(k, n, d) for k, n, d in zip(*(batch.column(c).to_pylist() for c in ("suffix", "size", "content")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([f[k] for f in found], pa.string()) for k in range(3))], ["path", "parser", "text", "error"])

    return files.select("path", "suffix", "size", "content").mapInArrow(run, "path string, parser string, text string, error string")


def quarantine(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The strict gate: documents that were read, and those that weren't."""
    return read.where("error is null"), read.where("error is not null")


def reconcile(found: DataFrame, known: DataFrame, excluded: DataFrame, key: str = "uri") -> DataFrame:
    """``(uri, action)`` for each uri once: insert, refresh, archive, or exclude."""
    f = found.select(key, F.lit(True).alias("f")).distinct()
    k = known.select(key, F.lit(True).alias("k")).distinct()
    x = excluded.select(key, F.lit(True).alias("x")).distinct()
    action = F.when(F.col("x"), "archive").when(F.col("k").isNull(), "insert").when(F.col("f").isNull(), "archive").otherwise("refresh")
    return f.join(k, key, "full").join(x, key, "left").select(key, action.alias("action"))


def write_version(df: DataFrame, path: str, version: str) -> None:
    """Write a version's rows as a partition of its own; writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions; a filter on ``version`` reads its partition only."""
    return spark.read.option("basePath", path).parquet(path)


def publish(current: DataFrame, new: DataFrame, key: str = "artifact") -> DataFrame:
    """The table of published revisions with a new revision of each artifact of ``new`` appended.

    ``current`` holds the key, revision, state and body. Earlier published revisions of
    those artifacts are superseded; each row's hash is of its key, revision and body.
    """
    top = current.groupBy(key).agg(F.max("revision").alias("top"))
    added = new.join(top, key, "left").select(key, (F.coalesce("top", F.lit(0)) + 1).cast("bigint").alias("revision"), F.lit("published").alias("state"), "body")
    old = current.join(new.select(key, F.lit(True).alias("again")).distinct(), key, "left")
    state = F.when(F.col("again") & (F.col("state") == "published"), "superseded").otherwise(F.col("state"))
    rows = old.select(key, F.col("revision").cast("bigint").alias("revision"), state.alias("state"), "body").unionByName(added)
    return rows.withColumn("hash", F.sha2(F.concat_ws("||", key, "revision", "body"), 256))

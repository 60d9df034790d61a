"""Links of web pages, references resolved against them, and the bounded crawl.

Defined results: a null or empty reference is its page; a reference with a scheme of its own stays
as it is; dot segments that lead above the root are dropped; pages without a url or text
have no links; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.shared import written

#: Words of a link that looks like a document: fixed values.
DOCUMENT_WORDS = ("download", "export", "attachment", "file", "document", "pdf", "docx", "odt", "xlsx", "archimate", "json", "txt", "markdown", "raw")


def normalised_url(url: Column) -> Column:
    """Without its fragment, and with a path."""
    bare = F.regexp_replace(url, r"#.*$", "")
    return F.regexp_replace(bare, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+)(\?|$)", "$1/$2")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def within(seed: Column, url: Column) -> Column:
    """Whether a url is on the seed's host at or below the seed's path."""
    root = F.regexp_replace(path(seed), r"/+$", "")
    return (host(seed) == host(url)) & ((path(url) == root) | F.startswith(path(url), F.concat(root, F.lit("/"))) | (root == ""))


def looks_like_document(url: Column, title: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", F.regexp_replace(url, r"^[a-zA-Z]+://[^/]+", ""), title))
    return hay.rlike("|".join(DOCUMENT_WORDS))


_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"


def _without_dots(segments: Column) -> Column:
    """Path segments with ``.`` and ``..`` carried out; a path that ends in one ends in a slash."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        segments, none, lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s))
    )
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)


def resolved(base: Column, reference: Column) -> Column:
    """The url that a reference on the page ``base`` names, by the rules of relative references."""
    ref = F.trim(F.coalesce(reference, F.lit("")))
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    base_path, base_query = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    ref_path, ref_rest = F.regexp_extract(ref, r"^([^?#]*)", 1), F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    full = lambda xs: F.filter(xs, lambda x: x != "")
    own = F.split(ref_path, "/")
    # a path from the root keeps its empty segments, a joined one only its last
    rooted = F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0)))
    folder = F.split(F.regexp_replace(base_path, r"[^/]*$", ""), "/")
    joined = F.concat(full(folder), full(F.slice(own, F.lit(1), F.size(own) - 1)), F.slice(own, -1, 1))
    path_of = lambda segments: F.concat(F.lit("/"), F.array_join(_without_dots(segments), "/"))
    return (
        F.when(ref.rlike(_SCHEME), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(F.regexp_extract(base, _SCHEME, 0), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(origin, path_of(rooted), ref_rest))
        .when(ref == "", base)
        .when(F.startswith(ref, F.lit("#")), F.concat(origin, base_path, base_query, ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(origin, base_path, ref))
        .otherwise(F.concat(origin, path_of(joined), ref_rest))
    )


#: A tag's attributes: a name, and a value in double quotes, single quotes or none.
ATTRIBUTE = r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"""
ANCHOR = r"""(?is)(<a(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*)?>)(.*?)</a\s*>"""


def anchors(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``(page_id, page, position, href, url, title, download)`` of every anchor with a reference, in order.

    Scripts and comments are left out first. Attributes are read one by one, so that a reference
    may stand in any quotes and other attributes may hold anything.
    """
    clean = F.regexp_replace(F.regexp_replace(html_col, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->", " ")
    whole = F.arrays_zip(F.regexp_extract_all(clean, F.lit(ANCHOR), F.lit(1)).alias("tag"), F.regexp_extract_all(clean, F.lit(ANCHOR), F.lit(2)).alias("inside"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("page"), F.posexplode(whole).alias("position", "a")).select("page_id", "page", F.col("position").cast("bigint").alias("position"), "a.*")
    read = F.arrays_zip(F.regexp_extract_all("tag", F.lit(ATTRIBUTE), F.lit(1)).alias("name"), F.regexp_extract_all("tag", F.lit(ATTRIBUTE), F.lit(2)).alias("value"))
    given = F.get(F.filter(read, lambda x: F.lower(x["name"]) == "href"), F.lit(0))["value"]
    value = F.regexp_replace(given, "^[\"']|[\"']$", "")
    title = F.trim(F.regexp_replace(F.regexp_replace("inside", r"<[^>]*>", " "), r"\s+", " "))
    bare = F.regexp_replace("tag", "\"[^\"]*\"|'[^']*'", "")
    rows = rows.withColumn("href", F.replace(value, F.lit("&amp;"), F.lit("&"))).where("href is not null")
    return rows.select("page_id", "page", "position", "href", normalised_url(resolved(F.col("page"), F.col("href"))).alias("url"), title.alias("title"), bare.rlike(r"(?i)\sdownload\b").alias("download"))


def page_documents(links: DataFrame, supported: Column, safe: Column) -> DataFrame:
    """The links of pages that name documents: those of a supported format, and http ones that look like a document.

    ``supported`` and ``safe`` are conditions on ``url``; the title falls back on the file's name.
    """
    http = F.col("url").rlike(r"(?i)^https?://")
    named = F.regexp_extract(path(F.col("url")), r"([^/]*)$", 1)
    found = links.where((~http | safe) & (supported | http & (looks_like_document(F.col("url"), F.col("title")) | F.col("download"))))
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif(named, F.lit("")), F.col("url"))
    return found.select("page_id", F.col("page").alias("discovered_from"), "position", "url", title.alias("title"))


def _running(rows: DataFrame, order: str, *sums: str) -> DataFrame:
    """``rows`` with the sums of all earlier rows: ranges are summed apart, then their totals are added up."""
    parts = written(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    # one row for each range
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(totals, "_part").select(*rows.columns, *[(F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"before_{c}") for c in sums])


def budgeted_crawl(seeds: DataFrame, links: DataFrame, depth: int = 2, max_pages: int = 200, max_documents: int = 500) -> tuple[DataFrame, DataFrame]:
    """Pages ``(url, depth, visit)`` and documents ``(url, found_on, visit, position)`` of a crawl, as one queue visits them.

    ``seeds`` has ``(url, position)``, ``links`` ``(source, position, target, is_page, is_document)``;
    positions order a page's links, then the targets. Visiting stops when so many pages were read or so many
    documents found. A round takes a level of the queue: each url at its first place in it, the budgets
    by running sums over that order. There are ``depth`` + 1 rounds; three numbers of each reach the driver.
    """
    links = written(links.select("source", "position", "target", "is_page", "is_document"))
    counts = links.where("is_document").groupBy(F.col("source").alias("url")).agg(F.count(F.lit(1)).alias("documents"))
    queue = seeds.select("url", F.struct(F.lit(0).cast("bigint").alias("parent"), F.col("position").cast("bigint").alias("place"), "url").alias("at"))
    pages = documents = None
    read = found = visits = 0
    for d in range(depth + 1):
        first = queue.groupBy("url").agg(F.min("at").alias("at"))
        if pages is not None:
            first = first.join(pages.select("url"), "url", "left_anti")
        level = first.join(counts, "url", "left").select("url", "at", F.lit(1).cast("bigint").alias("pages"), F.coalesce("documents", F.lit(0)).alias("documents"))
        level = _running(level, "at", "pages", "documents").where((F.col("before_pages") + read < max_pages) & (F.col("before_documents") + found < max_documents))
        level = written(level.withColumn("visit", F.col("before_pages") + visits))
        sums = level.agg(F.sum("pages").alias("pages"), F.sum("documents").alias("documents")).first()
        nth = F.row_number().over(Window.partitionBy("source").orderBy("position", "target")) - 1
        own = links.where("is_document").withColumn("nth", nth).join(level.select(F.col("url").alias("source"), "visit", "before_documents"), "source")
        own = own.where(F.col("before_documents") + F.col("nth") + found < max_documents).select(F.col("target").alias("url"), F.col("source").alias("found_on"), "visit", "position")
        done = level.select("url", F.lit(d).alias("depth"), "visit")
        pages, documents = (done, own) if pages is None else (pages.unionByName(done), documents.unionByName(own))
        read, found, visits = read + (sums["pages"] or 0), found + (sums["documents"] or 0), visits + (sums["pages"] or 0)
        if read >= max_pages or found >= max_documents or not sums["pages"]:
            break
        queue = links.where("is_page").join(level.select(F.col("url").alias("source"), "visit"), "source").select(F.col("target").alias("url"), F.struct(F.col("visit").alias("parent"), F.col("position").alias("place"), F.col("target").alias("url")).alias("at"))
    return pages, documents


def crawl(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """``(url, depth)``: every url within ``depth`` links of a seed, at its smallest depth.

    A round is one join of the frontier with the edges and an anti join with what was
    seen, which are written; there are ``depth`` rounds.
    """
    seen = frontier = seeds.select("url", F.lit(0).alias("depth")).distinct()
    for d in range(1, depth + 1):
        found = frontier.join(edges.select("source", "target"), F.col("url") == F.col("source")).select(F.col("target").alias("url")).distinct()
        frontier = written(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen

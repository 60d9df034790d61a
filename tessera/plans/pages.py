"""Queries over web pages: links, scope, crawl, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import links as L
from tessera.sources import files as S

from .base import query, table

_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1))"
_PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1)"


@query(r"""WITH a AS (SELECT page_id, url AS page, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?is)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)', 1)) AS a FROM pages),
h AS (SELECT page_id, regexp_extract(page, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || regexp_extract(a, '(?is)href="([^"]*)"', 1) AS url, trim(regexp_replace(regexp_extract(a, '(?is)^<a\s[^>]*>(.*)</a>$', 1), '<[^>]*>', '', 'g')) AS title FROM a)
SELECT page_id, url, title FROM h""")
def html_links(spark, sf):
    """A3: anchors of pages with absolute targets."""
    return L.anchors(table(spark, sf, "pages")).select("page_id", "url", "title")


@query(rf"SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+)(\?|$)', '\1/\2') AS normal, {_HOST} AS host, {_HOST} = 'www.therti.example.org' AND starts_with({_PATH}, '/en/') AS in_scope FROM pages")
def url_scope(spark, sf):
    """Normal urls, and those within a seed's scope."""
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", L.normalised_url(u).alias("normal"), L.host(u).alias("host"), L.within(F.lit("http://www.therti.example.org/en"), u).alias("in_scope"))


@query(r"""SELECT page_id, regexp_matches(lower(regexp_replace(url, '^[a-zA-Z]+://[^/]+', '')), 'download|export|attachment|file|document|pdf|docx|odt|xlsx|archimate|json|txt|markdown|raw') AS document,
CASE WHEN regexp_matches(lower(url), 'api|swagger|openapi') THEN 'api' WHEN regexp_matches(lower(url), 'archimate|modelling|modeling') THEN 'architecture' WHEN regexp_matches(lower(url), 'операцион|технолог|радар') THEN 'technology'
WHEN regexp_matches(lower(url), 'norm|policy|rule|requirement|standard|стандарт|togaf') THEN 'normative' WHEN regexp_matches(lower(url), 'arch|component|integration|solution') THEN 'architecture'
WHEN regexp_matches(lower(url), 'tech|stack|deploy|platform') THEN 'technology' ELSE 'other' END AS kind FROM pages""")
def document_links(spark, sf):
    """Whether a url looks like a document, and of which type."""
    return table(spark, sf, "pages").select("page_id", L.looks_like_document(F.col("url"), F.lit("")).alias("document"), S.type_of_name(F.col("url")).alias("kind"))


@query("SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE true END AS BOOLEAN) AS safe FROM events")
def safe_urls(spark, sf):
    """Urls made from rows, on public, private, forbidden and other hosts."""
    n = F.col("event_id")
    url = F.when(n % 5 == 0, F.concat(F.lit("http://10.0.0."), n % 250)).when(n % 5 == 1, F.lit("http://localhost/x")).when(n % 5 == 2, F.concat(F.lit("https://example.org/"), n)).when(n % 5 == 3, F.lit("ftp://example.org/a")).otherwise(F.lit("http://8.8.8.8/q"))
    return table(spark, sf, "events").select("event_id", S.safe_url(url).alias("safe"))


_EDGES = "e AS (SELECT l_orderkey AS source, l_partkey AS target FROM lineitem)"


@query(f"""WITH {_EDGES}, d0 AS (SELECT DISTINCT source AS url, 0 AS depth FROM e WHERE source < 3), d1 AS (SELECT DISTINCT target AS url, 1 AS depth FROM e JOIN d0 ON source = url WHERE target NOT IN (SELECT url FROM d0)),
d2 AS (SELECT DISTINCT target AS url, 2 AS depth FROM e JOIN d1 ON source = url WHERE target NOT IN (SELECT url FROM d0 UNION SELECT url FROM d1)) SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2""")
def bounded_crawl(spark, sf):
    """A4: urls within two links of the seeds, over a link graph from the line items."""
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    return L.crawl(e.where("source < 3").select(F.col("source").alias("url")), e)


_REFERENCES = ("p.html", "../up.html", "../../../../top.html", "./here/", ".", "..", "?q=1", "#frag", "//other.example.org/a/../b", "/root/./a//b/../c?x=/../y", "mailto:x@example.org", "a//b/./c/..", "")
_QUOTE = "[chr(34), chr(39), ''][1 + page_id % 3]"


@query(rf"""WITH h AS (SELECT page_id, url AS page, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') || '<a class="x" title="href=no" HREF=' || {_QUOTE} || [{", ".join(f"'{r}'" for r in _REFERENCES)}][1 + page_id % 13] || {_QUOTE} || '>one <b>two</b></a>' AS html FROM pages),
t AS (SELECT page_id, page, unnest(range(len(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>')))) AS position, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>')) AS a FROM h),
r AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_extract(a, '(?is)^<a\s[^>]*>(.*)</a>$', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title, replace(trim(regexp_extract(a, '(?i)\shref\s*=\s*("[^"]*"|\x27[^\x27]*\x27|[^\s">]+)', 1), chr(34) || chr(39)), '&amp;', '&') AS href FROM t WHERE regexp_matches(a, '(?i)^<a[^>]*\shref\s*=\s*[^\s>]')),
c AS (SELECT *, regexp_extract(page, '^([a-zA-Z][a-zA-Z0-9+.-]*:)') AS scheme, regexp_extract(page, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)') AS origin, regexp_extract(page, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS folder, regexp_extract(href, '^[^?#]*') AS path, substr(href, length(regexp_extract(href, '^[^?#]*')) + 1) AS rest FROM r),
s AS (SELECT *, CASE WHEN starts_with(path, '/') THEN string_split(substr(path, 2), '/') ELSE list_filter(string_split(regexp_replace(folder, '[^/]*$', ''), '/'), lambda x: x <> '') || list_filter(string_split(path, '/')[:-2], lambda x: x <> '') || string_split(path, '/')[-1:] END AS segs FROM c),
f AS (SELECT *, coalesce(nullif(list_reduce([''] || segs, lambda acc, x: CASE x WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN '.' THEN acc ELSE acc || '/' || x END) || CASE WHEN segs[-1] IN ('.', '..') THEN '/' ELSE '' END, ''), '/') AS folded FROM s),
u AS (SELECT *, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN scheme || href WHEN path <> '' THEN origin || folded || rest WHEN href = '' THEN page WHEN starts_with(href, '?') THEN origin || folder || href ELSE regexp_replace(page, '#.*$', '') || href END AS full_ FROM f)
SELECT page_id, position, href, regexp_replace(regexp_replace(full_, '#.*$', ''), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+)(\?|$)', '\1/\2') AS url, title FROM u""")
def resolved_links(spark, sf):
    """A3: all anchors of pages, and one more of every form of reference and quotes, resolved against the page."""
    n = F.col("page_id")
    quote = F.element_at(F.array(F.lit('"'), F.lit("'"), F.lit("")), (1 + n % 3).cast("int"))
    ref = F.element_at(F.array(*map(F.lit, _REFERENCES)), (1 + n % len(_REFERENCES)).cast("int"))
    more = F.concat("html", F.lit('<a class="x" title="href=no" HREF='), quote, ref, quote, F.lit(">one <b>two</b></a>"))
    return L.anchors(table(spark, sf, "pages").withColumn("html", more)).select("page_id", "position", "href", "url", "title")


_LEVEL = """q{d} AS (SELECT t AS url, min((visit, pos, t)) AS o FROM v{b} JOIN e ON e.s = v{b}.url WHERE is_page AND t NOT IN (SELECT url FROM seen{b}) GROUP BY t),
r{d} AS (SELECT url, row_number() OVER (ORDER BY o) - 1 + (SELECT count(*) FROM seen{b}) AS visit, coalesce(docs, 0) AS docs, (SELECT coalesce(sum(docs), 0) FROM all{b}) + coalesce(sum(docs) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM q{d} LEFT JOIN c ON c.s = q{d}.url),
v{d} AS (SELECT * FROM r{d} WHERE visit < 200 AND before_ < 500), all{d} AS (SELECT url, {d} AS depth, visit, docs, before_ FROM v{d} UNION ALL SELECT * FROM all{b}), seen{d} AS (SELECT url FROM all{d})"""


@query(f"""WITH e AS (SELECT l_orderkey AS s, l_linenumber AS pos, l_partkey AS t, l_linenumber <> 2 AS is_page, l_linenumber % 3 = 0 AS is_doc FROM lineitem),
c AS (SELECT s, count(*) AS docs FROM e WHERE is_doc GROUP BY s),
r0 AS (SELECT url, row_number() OVER (ORDER BY url) - 1 AS visit, coalesce(docs, 0) AS docs, coalesce(sum(docs) OVER (ORDER BY url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM (SELECT DISTINCT s AS url FROM e WHERE s < 60) LEFT JOIN c ON c.s = url),
v0 AS (SELECT * FROM r0 WHERE visit < 200 AND before_ < 500), all0 AS (SELECT url, 0 AS depth, visit, docs, before_ FROM v0), seen0 AS (SELECT url FROM all0), {_LEVEL.format(d=1, b=0)}, {_LEVEL.format(d=2, b=1)},
d AS (SELECT visit, pos, t, before_ + row_number() OVER (PARTITION BY visit ORDER BY pos, t) - 1 AS nth FROM all2 JOIN e ON e.s = all2.url WHERE is_doc)
SELECT 'page' AS kind, url, depth::BIGINT AS depth, visit::BIGINT AS visit, NULL::BIGINT AS position FROM all2 UNION ALL SELECT 'document', t, NULL, visit, pos FROM d WHERE nth < 500""")
def budgeted_crawl(spark, sf):
    """A4: what a queue visits of the line items' graph with 200 pages and 500 documents."""
    link = F.col("l_linenumber")
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), link.cast("bigint").alias("position"), F.col("l_partkey").alias("target"), (link != 2).alias("is_page"), (link % 3 == 0).alias("is_document"))
    seeds = e.where("source < 60").select(F.col("source").alias("url")).distinct().withColumn("position", F.col("url"))
    pages, documents = L.budgeted_crawl(seeds, e)
    one = pages.select(F.lit("page").alias("kind"), "url", F.col("depth").cast("bigint").alias("depth"), "visit", F.lit(None).cast("bigint").alias("position"))
    return one.unionByName(documents.select(F.lit("document").alias("kind"), "url", F.lit(None).cast("bigint").alias("depth"), "visit", "position"))


@query(f"SELECT {_HOST} AS host, count(*) AS pages, count(DISTINCT {_PATH}) AS paths FROM pages GROUP BY ALL")
def host_counts(spark, sf):
    """Pages and paths of each host."""
    u = F.col("url")
    return table(spark, sf, "pages").groupBy(L.host(u).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.count_distinct(L.path(u)).alias("paths"))


@query("""WITH f AS (SELECT DISTINCT url AS uri FROM pages WHERE page_id % 3 <> 0), k AS (SELECT DISTINCT url AS uri FROM pages WHERE page_id % 4 <> 0), x AS (SELECT DISTINCT url AS uri FROM pages WHERE page_id % 11 = 0)
SELECT coalesce(f.uri, k.uri) AS uri, CASE WHEN x.uri IS NOT NULL THEN 'archive' WHEN k.uri IS NULL THEN 'insert' WHEN f.uri IS NULL THEN 'archive' ELSE 'refresh' END AS action FROM f FULL JOIN k ON f.uri = k.uri LEFT JOIN x ON x.uri = coalesce(f.uri, k.uri)""")
def reconcile_sources(spark, sf):
    """What was found against what is known."""
    uri = table(spark, sf, "pages").select("page_id", F.col("url").alias("uri"))
    return S.reconcile(uri.where("page_id % 3 <> 0"), uri.where("page_id % 4 <> 0"), uri.where("page_id % 11 = 0"))


@query("SELECT url AS uri, arg_min(page_id, (page_id % 2 = 0, page_id)) AS page_id FROM pages GROUP BY ALL")
def dedupe_uri(spark, sf):
    """One row a uri, those with an id (here: an odd one) first."""
    return table(spark, sf, "pages").groupBy(F.col("url").alias("uri")).agg(F.min(F.struct((F.col("page_id") % 2 == 0).alias("even"), "page_id")).getField("page_id").alias("page_id"))


@query(r"""WITH t AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(regexp_replace(html, '(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>', ' ', 'g'), '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda h: trim(regexp_replace(h, '<[^>]*>', '', 'g'))), lambda h: h <> '') AS headings FROM pages)
SELECT page_id, len(headings) AS n, headings[1] AS first FROM t""")
def html_sections(spark, sf):
    """The headings of pages without scripts and styles."""
    clean = F.regexp_replace("html", r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>", " ")
    heads = F.regexp_extract_all(clean, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    texts = F.filter(F.transform(heads, lambda h: F.trim(F.regexp_replace(h, r"<[^>]*>", ""))), lambda h: h != "")
    return table(spark, sf, "pages").select("page_id", texts.alias("t")).select("page_id", F.size("t").cast("bigint").alias("n"), F.get("t", F.lit(0)).alias("first"))

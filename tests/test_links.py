"""References against the standard library, anchors in every quoting, the crawl against a plain queue."""

from __future__ import annotations

import random
from collections import defaultdict, deque
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tessera.operators import links as L
from tessera.sources import files as S

BASES = ["http://h.org/a/b/x.html", "http://h.org/a/b/", "https://h.org", "http://h.org/x?q=1#f", "http://h.org/a//b/c?d=/e/f"]
REFERENCES = ["page.html", "../up.html", "../../../x", ".", "..", "./", "../", "?q=2", "#frag", "", "//o.org/p/../q", "/r/./s/../t", "/r//s/..", "mailto:x", "http://o.org/a/../b", "a//b/./c/..", "a/..", "x/y/../../z?u=../v#w", "ftp://o.org"]


def test_resolved_equals_the_library(spark):
    rows = [(b, r) for b in BASES for r in REFERENCES]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", L.resolved(F.col("b"), F.col("r")).alias("u")).collect()
    root = lambda u: u.replace("https://h.org", "https://h.org/", 1) if u.startswith("https://h.org") and u[13:14] not in ("/",) else u
    wrong = [(r.b, r.r, r.u, urljoin(r.b, r.r)) for r in got if root(r.u) != root(urljoin(r.b, r.r))]
    assert not wrong, wrong


def test_anchors(spark):
    html = """<script>var a = '<a href="no">no</a>';</script><!-- <a href="no">no</a> --><A HREF='q.html'>Single <b>q</b></A><a href=z.html>bare</a><a name="x">none</a>
    <a data-href="no" title='a > b "c" href=no' href = "../up.html#f" download>up &amp; on</a><a href="mailto:x">m</a><a href="?a=1&amp;b=2"></a><abbr href="no">no</abbr>"""
    pages = spark.createDataFrame([(1, "http://h.org/a/b/x.html", html, "t"), (2, None, None, "t"), (3, "http://h.org", "", "t")], "page_id int, url string, html string, title string")
    got = [(r.position, r.href, r.url, r.title, r.download) for r in L.anchors(pages).orderBy("position").collect()]
    assert got == [
        (0, "q.html", "http://h.org/a/b/q.html", "Single q", False), (1, "z.html", "http://h.org/a/b/z.html", "bare", False), (3, "../up.html#f", "http://h.org/a/up.html", "up &amp; on", True),
        (4, "mailto:x", "mailto:x", "m", False), (5, "?a=1&b=2", "http://h.org/a/b/x.html?a=1&b=2", "", False),
    ]
    found = L.page_documents(L.anchors(pages), S.supported(F.col("url")), S.safe_url(F.col("url"))).orderBy("position").collect()
    assert [(r.position, r.title) for r in found] == [(0, "Single q"), (1, "bare"), (3, "up &amp; on"), (5, "x.html")]
    assert L.anchors(pages.limit(0)).count() == 0


def test_url_list(spark):
    lines = spark.createDataFrame([(x,) for x in ("# no", " ", "a.pdf", "../b.docx", "/c.txt?x=1", "page", "http://localhost/x.pdf", "ftp://h.org/a.pdf")], "value string")
    every = sorted(r.url for r in S.url_list(lines, "https://h.org/docs/l/list.txt").collect())
    assert every == ["https://h.org/c.txt?x=1", "https://h.org/docs/b.docx", "https://h.org/docs/l/a.pdf", "https://h.org/docs/l/page"]
    assert len(S.url_list(lines, "https://h.org/docs/l/list.txt", only_supported=True).collect()) == 3


def queue(seeds, links, depth, max_pages, max_documents):
    waiting, seen, pages, documents = deque((s, 0) for s in seeds), set(), [], []
    while waiting and len(pages) < max_pages and len(documents) < max_documents:
        url, d = waiting.popleft()
        if url in seen:
            continue
        seen.add(url)
        pages.append((url, d, len(pages)))
        for position, target, _, is_document in links[url]:
            if is_document and len(documents) < max_documents:
                documents.append((target, url, len(pages) - 1, position))
        if d < depth and len(documents) < max_documents:
            waiting.extend((t, d + 1) for _, t, is_page, _ in links[url] if is_page)
    return sorted(pages), sorted(documents)


@pytest.mark.parametrize(("max_pages", "max_documents"), [(1, 1), (4, 500), (200, 3), (9, 12), (200, 500)])
def test_crawl_equals_a_queue(spark, max_pages, max_documents):
    r = random.Random(max_pages)
    rows = [(s, p, r.randrange(30), r.random() < 0.7, r.random() < 0.4) for s in range(25) for p in range(r.randint(0, 5))]
    links = defaultdict(list)
    for s, *rest in rows:
        links[s].append(tuple(rest))
    frame = spark.createDataFrame(rows, "source bigint, position bigint, target bigint, is_page boolean, is_document boolean")
    seeds = spark.createDataFrame([(3, 1), (1, 2), (28, 3)], "url bigint, position bigint")
    pages, documents = L.budgeted_crawl(seeds, frame, 2, max_pages, max_documents)
    assert (sorted(map(tuple, pages.collect())), sorted(map(tuple, documents.collect()))) == queue([3, 1, 28], links, 2, max_pages, max_documents)


def test_crawl_of_nothing(spark):
    none = spark.createDataFrame([], "source bigint, position bigint, target bigint, is_page boolean, is_document boolean")
    pages, documents = L.budgeted_crawl(spark.createDataFrame([], "url bigint, position bigint"), none)
    assert pages.count() == 0 == documents.count()

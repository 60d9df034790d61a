"""Quality, HTML, embeddings, toxicity and URLs."""

from __future__ import annotations

import random
import re
import time
import zlib

import numpy as np
import pytest

from tessera.llm import embeddings, html, quality, toxicity, urls


@pytest.fixture(scope="module")
def tables(spark, sf):
    return {t: spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels", "pages", "embeddings")}


def test_quality_on_held_out_labels(tables):
    labels = tables["labels"]
    found = quality.classify(tables["documents"], labels.where("doc_id % 4 <> 1"))
    rows = found.join(labels.where("doc_id % 4 = 1"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert len(bad) > 10 and sum(r.keep for r in good) >= 0.97 * len(good)
    assert sum(not r.keep for r in bad) >= 0.85 * len(bad)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_on_labels(tables):
    rows = quality.classify(tables["documents"], tables["labels"]).join(tables["labels"], "doc_id").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.keep for r in good) >= 0.99 * len(good) and sum(not r.keep for r in bad) >= 0.85 * len(bad)


def plain_quality(marked, known, smoothing=0.5):
    """Posterior, host share and path share of each row of features, by loops."""
    log, exp = np.log, np.exp
    prior = (sum(known.get(r.id, 0) for r in marked if r.id in known) + 1) / (sum(r.id in known for r in marked) + 2)
    logits = np.full(len(marked), log(prior / (1 - prior)))
    for f in quality.FEATURES:
        seen = [(getattr(r, f), known[r.id]) for r in marked if r.id in known and getattr(r, f) is not None and (f != "words" or r.second)]
        if not seen:
            continue
        lo, hi = quality.RANGES[f]
        total = {g: sum(y == g for _, y in seen) for g in (0, 1)}
        for k, r in enumerate(marked):
            v = getattr(r, f)
            if v is not None:
                reach = 0
                while reach < hi - lo and sum(abs(u - v) <= reach for u, _ in seen) < quality.ENOUGH:
                    reach += 1
                c = {g: sum(abs(u - v) <= reach and y == g for u, y in seen) for g in (0, 1)}
                logits[k] += log((c[1] + smoothing) / (total[1] + 2 * smoothing)) - log((c[0] + smoothing) / (total[0] + 2 * smoothing))
    own = 1 / (1 + exp(-np.clip(logits, -30, 30)))
    y = np.array([known.get(r.id, p) for r, p in zip(marked, own, strict=True)])
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))

    def strength(sites):
        n = np.array([len(v) for v, _ in sites], float)
        rate, mean = np.array([y[v].mean() for v, _ in sites]), np.array([m for _, m in sites])
        noise = (n * mean * (1 - mean)).sum() / n.sum()
        spread = ((n * (rate - mean) ** 2).sum() - len(n) * noise) / max(1e-9, n.sum() - (n * n).sum() / n.sum())
        return 10_000.0 if len(n) < 2 or spread <= 0 else min(10_000.0, max(2.0, noise / spread - 1))

    hosts, paths = {}, {}
    for k, r in enumerate(marked):
        hosts.setdefault(r.host, []).append(k)
        paths.setdefault((r.host, r.path), []).append(k)
    s = strength([(v, share) for v in hosts.values()])
    mean = {h: (s * share + y[v].sum()) / (s + len(v)) for h, v in hosts.items()}
    t = strength([(v, mean[h]) for (h, _), v in paths.items()])
    out = []
    for k, r in enumerate(marked):
        h, q = hosts[r.host], paths[r.host, r.path]
        host = (s * share + y[h].sum() - y[k]) / (s + len(h) - 1)
        path = (t * host + y[q].sum() - y[k]) / (t + len(q) - 1)
        site = float(np.clip(path, 1e-6, 1 - 1e-6))
        total = log(site / (1 - site)) - log(share / (1 - share)) + log(own[k] / (1 - own[k]))
        out.append((own[k], host, path, 1 / (1 + exp(-total))))
    return out


def test_quality_by_force(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["fine", "words", "of", "prose", "***", "##", "x1"][: 4 if r.random() < 0.6 else 7]) for _ in range(r.randint(0, 30))) + " w".join(map(str, range(r.choice([0, 30])))), r.choice(["a", "b", "c", None]), r.choice(["p", "q"])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int("*" not in t), 0) for i, t, _, _ in rows[:90]] + [(3, 0, 0), (None, 1, 0), (95, None, 0)], "doc_id bigint, quality int, id int")
    known = {i: int("*" not in t) for i, t, _, _ in rows[:90]}
    worth = quality.learn_words(docs, quality._known(labels), 20_000, "doc_id", "text")
    marked = quality._marked(docs, worth, "doc_id", "text", "source", "lang").withColumn("second", ~quality._first_half()).collect()
    want = {m.id: w for m, w in zip(marked, plain_quality(marked, known), strict=True)}
    got = {g.doc_id: (g.evidence, g.host_share, g.path_share, g.score) for g in quality.classify(docs, labels).collect()}
    assert all(np.allclose(got[i], want[i], atol=1e-9) for i in want) and len(got) == len(want)


def test_quality_shrinks_sparse_sites(spark):
    rows = [(i, "fine words of a text " * 5, "big", "p") for i in range(200)] + [(1000, "fine words of a text", "tiny", "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id bigint, quality int")
    by = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert abs(by[1000].path_share - by[1000].host_share) < 1e-6 and abs(by[1000].host_share - by[0].host_share) < 0.05


def test_quality_awkward(spark, make, awkward):
    labels = spark.createDataFrame([(13, 1), (14, 0), (None, 1), (15, None)], "doc_id bigint, quality int")
    assert quality.digests(make(awkward), labels).count() == len(awkward)
    assert quality.digests(make(awkward), labels.where("false")).count() == len(awkward)
    assert quality.digests(make([]), labels).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<!-- ad --><div class="ad">Buy now</div><div id="cookie-notice">We set cookies</div>{0}<aside>More</aside><section class="comments"><p>first!</p></section><form><p>Name</p></form><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>T</h1><p>One &amp; two\n three</p><div class='ad'>x</div><p><b>Four<br>five<p>six</article>", "T\nOne & two three\nFour five\nsix"),
        ("<main><p>a < b and <i>c</i>d</p></main>", "a < b and cd"),
        ("<div><p>Long enough paragraph of text, the first one here.</p><p>And a second one.</p></div>", "Long enough paragraph of text, the first one here.\nAnd a second one."),
        ("<article></article>", ""),
        ("<div class='page with-sidebar'><article><p class='share'>Tweet<p>Kept<ul><li class='ad'>x<li>item</ul><figure><figcaption>Caption</figcaption></figure></article><section id='comments'><article class='comment'><p>Me too, a very long reader comment that is longer than all.</p></article></section></div>", "Kept\nitem\nCaption"),
    ],
)
def test_html(body, text):
    assert html.main_text(PAGE.format(body)) == text


@pytest.mark.parametrize("page", [None, "", "<", "<nav>x", "<article><p>cut off", "<!-- open", "text only", "<script>never closed", "&bogus; &#x41;"])
def test_html_awkward(page):
    text = html.main_text(page)
    assert text == {"<article><p>cut off": "cut off", "text only": "text only", "&bogus; &#x41;": "&bogus; A", "<": "<"}.get(page, "")


TEXT = " ".join(["Word and word of a long paragraph here."] * 8)
ARTICLE = f"<h1>The title</h1><p>{TEXT} one</p><p>{TEXT} two</p><p>Short end.</p>"
LINES = f"The title\n{TEXT} one\n{TEXT} two\nShort end."


@pytest.mark.parametrize(
    "page",
    [
        *(f"<nav><a href=/>Home</a></nav><div class='{c}'>{ARTICLE}</div><footer>f</footer>" for c in ("layout has-sidebar", "post no-comments", "social-science-post", "main-side-by-side")),
        f"<div>We use cookies to improve your experience.</div>{ARTICLE}<p>Subscribe to our newsletter!</p>",
        f"<table><tr><td>Home<td>News<td>Contact</table>{ARTICLE}",
        f"<table><tr><td><a href=a>Home</a><td><a href=b>News</a></table>{ARTICLE}<ul><li><a href=a>Other</a></ul>",
        f"<div class=ad>Buy now{ARTICLE}",
        f"<form action=x>{ARTICLE}</form>",
        f'<div><a href="x>link</a></div>{ARTICLE}<p><a href="y">z</a></p>',
        f"<main><article>{ARTICLE}</article></main><div class='post-comments'><p>{TEXT} {TEXT} {TEXT} {TEXT}</div>",
    ],
)
def test_html_without_known_edges(page):
    assert html.main_text(f"<html><body>{page}</body></html>") == LINES


def test_html_keeps_linked_lines_of_the_article():
    assert html.main_text(f"<main><h1>Lead</h1><article>{ARTICLE}<p><a href=x>linked</a></p></article></main>") == f"Lead\n{LINES}\nlinked"
    links = "".join(f"<li><a href={k}>r{k}</a>" for k in range(5))
    assert html.main_text(f"<div>{ARTICLE}<ul>{links}</ul><p>{TEXT} last</p></div>") == f"{LINES}\n" + "\n".join(f"r{k}" for k in range(5)) + f"\n{TEXT} last"
    assert html.main_text("<ul><li><a href=a>Menu</a><li><a href=b>Two</a></ul>") == ""


@pytest.mark.parametrize("page", ["<div class='ad'>" * 20_000 + f"<article>{ARTICLE}</article>", "<article><div></main>" * 20_000 + ARTICLE, "<a href='x>" * 20_000 + ARTICLE])
def test_html_nested_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    assert html.main_text(page) == LINES
    assert time.perf_counter() - began < 5


def test_html_by_force(spark):
    """Random pages: the lines of the article and nothing of what is around it, in every row of a table."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    para = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    pages, want = [], []
    for k in range(200):
        lines = [para(r.randint(20, 60)) for _ in range(r.randint(2, 6))]
        title = para(4)
        junk = lambda: r.choice([f"<nav><a href=x>{para(3)}</a></nav>", f"<div class='{r.choice(['ad', 'sidebar', 'site-footer', 'cookie-notice', 'comments'])}'>{para(9)}</div>", f"<ul><li><a href=a>{word()}</a><li><a href=b>{word()}</a></ul>", f"<script>{para(5)}</script>", f"<aside><p>{para(30)}</aside>"])
        open_, close = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("<div>", "</div>")])
        body = f"<h1>{title}</h1>" + "".join(f"<p>{x}{r.choice(['</p>', ''])}" for x in lines)
        pages.append((k, "u", f"<html><head><title>t</title></head><body>{''.join(junk() for _ in range(3))}{open_}{body}{close}{''.join(junk() for _ in range(3))}</body></html>", "x"))
        want.append("\n".join([title, *lines]))
    df = spark.createDataFrame(pages + pages[:2], "page_id bigint, url string, html string, text string")
    got = [x.text for x in html.digests(df).orderBy("page_id").collect()]
    assert got[0] == got[1] == want[0] and got[4:] == want[2:]


def test_html_of_pages(spark, tables):
    rows = html.digests(tables["pages"]).collect()
    assert len(rows) == tables["pages"].count() and all(r.n_chars == len(r.text) > 0 for r in rows)
    empty = spark.createDataFrame([(None, None, None), (1, "u", "")], "page_id bigint, url string, html string")
    assert {r.text for r in html.digests(empty).collect()} == {""}
    assert html.digests(empty.where("false")).count() == 0


def links_by_force(rows, threshold=0.93):
    out = {}
    for i, v, l in rows:
        out[i] = 0
        for j, w, m in rows:
            if i != j and l is not None and l == m and v and w and len(v) == len(w) and all(x is not None and np.isfinite(x) for x in [*v, *w]):
                a, b = np.array(v, float), np.array(w, float)
                n = np.linalg.norm(a) * np.linalg.norm(b)
                out[i] += bool(n and a @ b / n >= threshold - 1e-12)
    return out


def test_embeddings(spark):
    g = np.random.default_rng(4)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(60):
            base = g.standard_normal(64)
            for _ in range(g.integers(1, 4)):
                k += 1
                rows.append((k, (base + g.uniform(0, 0.4) * g.standard_normal(64)).astype(np.float32).tolist(), label))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], None), (902, None, 0), (903, [], 0), (904, [0.0] * 64, 0), (905, [float("nan")] * 64, 0), (906, [None] * 64, 0), (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, label int, key int")
    want = links_by_force(rows)
    for options in ({}, {"cell": 20, "block": 8}):
        got = {r.vec_id: r for r in embeddings.near_duplicates(df, **options).collect()}
        assert set(got) == set(want)
        assert all(got[i].n_links <= want[i] for i in want)
        assert sum(r.n_links for r in got.values()) >= 0.9 * sum(want.values())
        assert got[900].component_id == got[1].component_id == 1 and not got[900].kept and got[901].kept and got[905].n_links == 0 and got[908].component_id == 907
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_least_count():
    p = embeddings.within(0.93, 0.25)
    k = embeddings.least_count(p, 32, 0.97)
    met = np.random.default_rng(0).binomial(32, p, 20_000)
    assert (met >= k).mean() >= 0.97 > (met >= k + 1).mean() - 0.01
    assert embeddings.cell_plan(100, 2048, 0.93, 0.97) == (0, 1) and embeddings.cell_plan(1 << 20, 2048, 0.93, 0.97)[1] > 1


def test_toxicity_held_out(spark, tables):
    found = toxicity.judge(tables["documents"], tables["labels"])
    rows = found.join(tables["labels"], "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    caught, wrong = sum(r.predicted for r in rows if r.toxic), sum(r.predicted for r in rows if not r.toxic)
    assert caught >= 0.7 * sum(r.toxic for r in rows) and wrong <= 0.03 * len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_lexicon(spark):
    r = random.Random(2)
    plain = ["".join(r.choice("aeiou") + r.choice("bcdfg") for _ in range(3)) for _ in range(200)]
    rows = []
    for i in range(600):
        words = [r.choice(plain) for _ in range(40)]
        if i % 5 == 0:
            words.insert(r.randrange(40), "zorgl" + r.choice(["a", "en", "ish"]))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    # one toxic text copied many times: its words are no insults
    copy = " ".join(["copied", "phrase"] + [r.choice(plain) for _ in range(20)] + ["zorgla"])
    rows += [(1000 + i, copy, 1) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id bigint, toxic int")
    grammar = toxicity.learn(docs, labels)
    assert set(grammar.stems) == {"zorgl"}
    kinds = grammar.cache()
    assert grammar.score(grammar.matched("you ZORGLiest thing", kinds)) > 0.5 > grammar.score(grammar.matched("nothing here", kinds))


def test_grammar_scores():
    g = toxicity.Grammar({"idiot": 2.0}, base=0.01)
    kinds = g.cache()
    codes = lambda t: [f for f, _ in g.matched(t, kinds)]
    score = lambda t: g.score(g.matched(t, kinds))
    assert codes("what an idiot") == [0] and codes("you idiot") == [4] and codes("idiot, you") == [4]
    assert codes("she is not an idiot") == [2] and codes("he said idiot") == [1] and codes("he said it. idiot") == [0]
    assert codes("i will kill you") == [12] and codes("kill the process") == []
    assert score("you idiot") > score("what an idiot") > score("he said idiot") > score("he said she is not an idiot") > score("nothing")
    assert score("what an idiot") > score("she is not an idiot") and score("i will kill you") > score("i will not kill you")
    # negations of every form, reported speech on both sides of the clause
    for said in ("you're no idiot", "isn't an idiot", "don't be an idiot", "he’s not really an idiot", "ce n'est pas un idiot", "nie ein idiot", "idiot, he said", "\"what an idiot!\" she wrote"):
        assert score(said) < score("what an idiot") and score(said) < score("you idiot"), said
    assert codes("what an idiot! she wrote") == [0] and codes("important idiot") == [0]
    # an unseen combination backs off to its factors, whatever training showed
    learned = toxicity.fitted(g, [(1, [(0, "idiot", 1)])] * 50 + [(1, [(2, "idiot", 2)])] * 50)
    assert learned.match(2, "idiot") < learned.match(0, "idiot") and learned.match(3, "idiot") < learned.match(2, "idiot")
    # a stem that clean texts use once by chance weighs less than one they never use
    two = toxicity.Grammar({"often": 2.0, "never": 2.0}, base=0.01)
    found = [(0, [(0, "often", 1)])] * 40 + [(1, [(0, "often", 6)])] * 40 + [(1, [(0, "never", 1)])] * 40
    learned = toxicity.fitted(two, found)
    assert learned.match(0, "often") < 0.4 < 0.8 < learned.match(0, "never") and learned.score([(0, "often")] * 6) > 0.5


def test_grammar_by_force(spark):
    """Factors by looking back and ahead from each match, in random texts."""
    r = random.Random(12)
    g = toxicity.Grammar({"idiot": 1.3, "zorg": -0.4}, 0.7, (0.4, -1.1, -0.6), 0.02)
    texts = [" ".join(r.choice(["idiot", "zorgs", "kill", "you", "not", "said", "a", "the", "tree", ". And", "b!", "du", "no;x"]) for _ in range(r.randint(0, 60))) for _ in range(150)] + [None, ""]
    want = []
    for text in texts:
        rest = 1 - g.base
        for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
            words = re.findall(r"[^\W\d_]+", clause)
            for k, w in enumerate(words):
                arc = 1.3 if w.startswith("idiot") else -0.4 if w.startswith("zorg") else 0.7 if w in toxicity.THREATS else None
                target = any(x in toxicity.TARGETS for x in words[max(0, k - 4) : k + 5])
                if arc is None or w in toxicity.THREATS and not target:
                    continue
                total = arc + 0.4 * target - 1.1 * any(x in toxicity.NEGATIONS for x in words[max(0, k - 4) : k]) - 0.6 * any(x in toxicity.REPORTS for x in words[max(0, k - 11) : k + 12])
                rest *= 1 - 1 / (1 + np.exp(-total))
        want.append(1 - rest)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [x.score for x in toxicity.score(df, g).orderBy("doc_id").collect()]
    assert np.allclose(got, want, atol=1e-12)


def test_toxicity_awkward(spark, make, awkward):
    labels = spark.createDataFrame([(13, 1), (14, 0), (None, 1), (15, None)], "doc_id bigint, toxic int")
    rows = toxicity.judge(make(awkward), labels).collect()
    assert len(rows) == len(awkward) and all(r.score is not None and r.held_out is not None for r in rows)
    assert toxicity.judge(make(awkward), labels.where("false")).count() == len(awkward)
    assert toxicity.judge(make([]), labels).count() == 0


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if c < "\x80" else c for c in host), rest[:end]


def plain_rule(host, path):
    fit = [(len(s + p), v, s + p) for v, s, p in urls.RULES if (host == s or host.endswith("." + s)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_urls(spark, tables):
    odd = [None, "", "no-scheme", "http://", "HTTP://A.Example.ORG/en/1x?q#f", "http://example.org/es/a", "http://notexample.org/es/a", "x://h.com/de/1", "x://com/fr/a/b", "x://É.Com/de/", "a://b://c/d", "u://org", "u://org/", "u://h\n.org/a\nb"]
    pages = spark.createDataFrame([(i, u, 1, "n") for i, u in enumerate(odd)], "page_id bigint, url string, id int, host string")
    got = {r.page_id: r for r in urls.digests(pages).collect()}
    for i, u in enumerate(odd):
        assert (got[i].host, got[i].path) == plain_split(u), u
        verdict, rule = plain_rule(*plain_split(u))
        assert got[i].rule == rule and got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)
    rows = urls.digests(tables["pages"]).join(tables["pages"].select("page_id", "url"), "page_id").collect()
    assert len(rows) == tables["pages"].count() and all((r.host, r.path) == plain_split(r.url) and r.rule == plain_rule(r.host, r.path)[1] for r in rows)
    assert urls.digests(pages.where("false")).count() == 0


def plain_purity(urls_and_labels, spread=3.0, z=2.0, strength=20.0):
    """(purity, support) of each (host, path) by loops over the tree."""
    lexical = lambda s: re.sub(urls._VARIABLE, r"*\1", s)
    leaves = {}
    for host, path, said in urls_and_labels:
        t = tuple(lexical(s) for s in path.split("/") if s)
        n = leaves.setdefault((host, t), [0, 0, 0])
        n[0] += 1
        n[1] += said is not None
        n[2] += said == "block"
    general = {k: k[1] for k in leaves}
    while True:
        values, sizes = {}, {}
        for (host, t), g in general.items():
            for k in range(len(g)):
                values.setdefault((host, g[:k]), set()).add(g[k])
                sizes[host, g[:k]] = sizes.get((host, g[:k]), 0) + leaves[host, t][0]
        wide = {p for p in values if len(values[p]) > spread * sizes[p] ** 0.5}
        if not wide:
            break
        general = {(h, t): tuple("*" if (h, g[:k]) in wide else s for k, s in enumerate(g)) for (h, t), g in general.items()}

    def walk(counts, start):
        """counts: g -> (labelled, blocked); start: g -> (purity, support)."""
        out = {}

        def down(members, purity, support, level):
            ended = [g for g in members if len(g) <= level]
            out.update({g: (purity[g], support[g]) for g in ended})
            kids = {}
            for g in members:
                if len(g) > level:
                    kids.setdefault(g[level], []).append(g)
            total = lambda gs, c: sum(counts[g][c] for g in gs)
            inner = [g for gs in kids.values() for g in gs]
            if not inner:
                return
            pl, pb = total(inner, 0), total(inner, 1)
            rate, sides = pb / max(pl, 1), {}
            for gs in kids.values():
                l, b = total(gs, 0), total(gs, 1)
                off = b / max(l, 1) - rate
                side = 0 if not l or abs(off) <= z * (rate * (1 - rate) / max(l, 1)) ** 0.5 + 1e-12 else 1 if off > 0 else -1
                sides.setdefault(side, []).extend(gs)
                for g in gs:
                    support[g] = max(support[g], l)
            for gs in sides.values():
                l, b = total(gs, 0), total(gs, 1)
                for g in gs:
                    purity[g] = (b + strength * purity[g]) / (l + strength)
                if l == 0 or len(gs) == 1:
                    out.update({g: (purity[g], support[g]) for g in gs})
                else:
                    down(gs, purity, support, level + 1)

        down(list(counts), {g: p for g, (p, _) in start.items()}, {g: s for g, (_, s) in start.items()}, 0)
        return out

    shared, own = {}, {}
    for (host, t), (_, l, b) in leaves.items():
        g = general[host, t]
        for table in (shared, own.setdefault(host, {})):
            table[g] = (table.get(g, (0, 0))[0] + l, table.get(g, (0, 0))[1] + b)
    prior = (sum(v[2] for v in leaves.values()) + 1) / (sum(v[1] for v in leaves.values()) + 2)
    known = walk(shared, dict.fromkeys(shared, (prior, 0)))
    out = {}
    for host, counts in own.items():
        l, b = (sum(c[k] for c in counts.values()) for k in (0, 1))
        found = walk(counts, {g: ((b + strength * known[g][0]) / (l + strength), max(known[g][1], l)) for g in counts})
        out.update({(host, t): (*found[general[h, t]], "/".join(general[h, t])) for h, t in leaves if h == host})
    return lambda host, path: out[host, tuple(lexical(s) for s in path.split("/") if s)]


def test_url_tree_by_force(spark):
    r = random.Random(6)
    rules = (("block", "a.net", "/ads/1"), ("allow", "a.net", "/docs"), ("block", "b.net", "/x/y/z/deep/er"), ("allow", "b.net", "/x/y/z/deep/el"), ("block", "net", "/spam"))
    parts = ["ads", "docs", "x", "y", "z", "deep", "er", "el", "spam", "17", "2020-01-02", "page7.html"]
    rows = [f"http://{r.choice('abc')}.net/" + "/".join(r.choice(parts) for _ in range(r.randint(0, 7))) for _ in range(300)]
    rows += [f"http://b.net/x/y/z/deep/{r.choice(['er', 'el', 'other'])}/{k}/q" for k in range(120)] + [f"http://a.net/ads/{k}" for k in range(150)]
    rows += [f"http://c.net/tag/{''.join(r.choice('abcdef') for _ in range(8))}/x{''.join(r.choice('ghijk') for _ in range(6))}" for _ in range(80)] + ["http://d.net/ads/7", "http://d.net/new", None, rows[0], "http://b.net/" + "s/" * 1500]
    rule = lambda u: max([(len(s + p), v) for v, s, p in rules if (plain_split(u)[0] == s or plain_split(u)[0].endswith("." + s)) and plain_split(u)[1].startswith(p)], default=(0, None))[1]
    purity = plain_purity([(*plain_split(u), rule(u)) for u in rows])
    got = urls.judge(spark.createDataFrame([(i, u, "x", 0.0) for i, u in enumerate(rows)], "page_id bigint, url string, template string, purity double"), rules=rules).collect()
    assert len(got) == len(rows)
    for g in got:
        u = rows[g.page_id]
        p, support, template = purity(*plain_split(u))
        assert abs(g.purity - p) < 1e-9 and g.support == support and g.template == template, u
        assert g.verdict == (rule(u) or ("block" if support and p >= 0.5 else "allow"))


def test_url_base_rate_blocks_no_unseen_host(spark):
    rules = (("block", "bad.net", "/"), ("allow", "good.net", "/"))
    rows = [f"http://bad.net/s/{k}" for k in range(60)] + [f"http://good.net/t/{k}" for k in range(20)] + [f"http://new{k % 3}.net/u/{k}" for k in range(20)]
    got = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string"), rules=rules).collect()
    assert {g.verdict for g in got if g.host.startswith("new")} == {"allow"}


def test_url_templates_reject_by_purity(spark):
    rules = (("block", "bad.net", "/ads/1"), ("allow", "bad.net", "/docs/1"))
    rows = [f"http://bad.net/ads/{n}" for n in range(1, 400)] + [f"http://bad.net/docs/{n}" for n in range(1, 400)] + ["http://new.net/a"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    got = {r.path: r for r in urls.judge(pages, rules=rules).collect()}
    assert got["/ads/299"].rule is None and got["/ads/299"].verdict == "block" and got["/ads/299"].template == "ads/*"
    assert got["/docs/299"].verdict == "allow"


SAID = "This paragraph is long enough to be the text of an article, and it says so in plain words."
OTHER = "Another paragraph of the same article goes on for a while about something else entirely."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # words of boilerplate in the text are text
        (f"<body><p>The newsletter of the club was first printed in 1950.</p><p>{SAID}</p><p>{OTHER}</p><p>The copyright dispute ended in 1999.</p></body>", f"The newsletter of the club was first printed in 1950.\n{SAID}\n{OTHER}\nThe copyright dispute ended in 1999."),
        # a part of a class settles nothing inside an article
        (f'<article><p>{SAID}</p><p class="legal-history">{OTHER}</p><p class="copyright-law">Short.</p><blockquote class="social-quote">Said.</blockquote><div class="search-engines">{SAID} {OTHER}</div><div class="social-share">Tell a friend</div></article>',
         f"{SAID}\n{OTHER}\nShort.\nSaid.\n{SAID} {OTHER}"),
        # but a hint that holds most of an article is void
        (f'<article><h1>T</h1><div class="alert-notice"><p>{SAID}</p><p>{OTHER}</p></div></article>', f"T\n{SAID}\n{OTHER}"),
        # linked titles and references belong to the text
        (f'<body><div><h1><a href="/x">A linked title</a></h1><p>{SAID}</p><p>{OTHER}</p><h2>References</h2><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div><div><ul><li><a href="/m">Menu</a></li></ul></div></body>',
         f"A linked title\n{SAID}\n{OTHER}\nReferences\nOne\nTwo"),
        # sections of an article with a list of short items between them
        (f"<body><div><section><p>{SAID}</p><p>{OTHER}</p></section><ul>{''.join(f'<li>x{k}</li>' for k in range(12))}</ul><section><p>{OTHER}</p><p>{SAID}</p></section></div></body>", "\n".join([SAID, OTHER, *(f"x{k}" for k in range(12)), OTHER, SAID])),
        # every article of a page
        (f"<body><article><p>{SAID}</p></article><p>Between.</p><article><p>{OTHER} {SAID}</p></article></body>", f"{SAID}\n{OTHER} {SAID}"),
        # a short article beside long comments
        (f'<body><article><h1>Title</h1><p>{SAID}</p></article><div class="reactions">{"".join(f"<p>{OTHER}</p>" for _ in range(9))}</div></body>', f"Title\n{SAID}"),
    ],
)
def test_html_loses_no_article_text(page, text):
    assert html.main_text(f"<html>{page}</html>") == text

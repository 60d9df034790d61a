"""Benchmark decontamination by a distributed positional inverted index.

The training texts are read once. Every place where a term of the test items stands is
stored as a posting ``(document, position, term)``. A term is ``gram`` neighbouring words
(a posting of two words is the intersection of the two words' lists at neighbouring
positions, made while the text is read); items of fewer words have shorter terms.

Each window of an item is searched from its rarest terms: their postings, moved back by
their offset in the item, give alignments of item and document. Alignments at which
enough of the rarest terms meet are intersected with the lists of all the item's terms.
Runs of terms that meet at one alignment and cover a whole window are exact phrases.
:func:`proximity_matches` finds the words of an item close together in any order.

All steps are DataFrame functions: no Python runs on the executors, nothing reaches the
driver but whether there are items of so few words. Joins leave it to Spark whether a
side is small enough to broadcast, and a common term's postings can be split.

Defined results: words are maximal runs of characters other than ASCII ones that are no
letters or digits, with A-Z in lower case; a null or empty text has none and is not
contaminated; an item of no words is not searched, one of fewer words than a window is one
window; items that share an id are searched each, and their id counts once; hits of an
item with a null id count as hit words but not as an item; rows with a null id and
repeated rows are each judged; an empty table gives an empty table, no items give no hits;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialized, only

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Upper-case letters that stay as they are.
OTHER_UPPER = r"[\p{Lu}\p{Lt}&&[^A-Z]]"


def words(text: Column) -> Column:
    """The words of a text as an array."""
    text = F.coalesce(text, F.lit(""))
    # translate looks every character up; where only A-Z can change, lower does the same faster
    low = F.when(text.rlike(OTHER_UPPER), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(low, BETWEEN), "")


def _items(benchmark: DataFrame, width: int, gram: int, item_col: str, text_col: str) -> DataFrame:
    """``(item, b, n, g, need)`` with the item's words: a row for each item text; need: terms that cover a window."""
    rows = only(benchmark, item=item_col, text=text_col).withColumn("b", F.xxhash64("item", "text"))
    rows = rows.select("item", "b", words(F.col("text")).alias("ws")).dropDuplicates(["b"]).withColumn("n", F.size("ws")).where("n > 0")
    rows = rows.withColumn("g", F.least("n", F.lit(gram)))
    return rows.withColumn("need", F.least("n", F.lit(width)) - F.col("g") + 1)


def _places(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(b, ipos, t, n, g, need)``: where each term stands in the items; ``(term, g, t)``: the terms with a number."""
    at = items.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("g"))).alias("ipos"))
    at = at.select("b", "n", "g", "need", "ipos", F.array_join(F.slice("ws", F.col("ipos") + 1, F.col("g")), " ").alias("term"))
    terms = materialized(at.select("term", "g").distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
    return materialized(at.join(terms, ["term", "g"]).drop("term"), "places"), terms


def index(docs: DataFrame, terms: DataFrame, gram: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, r1, r2, pos, t)``: the postings of ``terms``, and for each row one of term -1 behind its last word.

    ``r1`` and ``r2`` are a row's identity: a 128-bit hash of its id and text. Only
    text and id are read, once for each length of terms.
    """
    source = only(docs, id=id_col, text=text_col)
    source = source.select("id", F.xxhash64("id", "text").alias("r1"), F.xxhash64("text", "id").alias("r2"), words(F.col("text")).alias("ws"))
    end = terms.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).cast("bigint").alias("t"))
    at = source.withColumn("ws", F.concat("ws", F.array(F.lit("")))).select("*", F.posexplode("ws").alias("pos", "word"))
    found = None
    for g in range(gram, 0, -1):
        known = terms.where(F.col("g") == g).select("term", "t")
        if g == gram:
            known = known.union(end)
        elif known.isEmpty():
            continue
        term = F.concat_ws(" ", "word", *[F.get("ws", F.col("pos") + i) for i in range(1, g)])
        part = at.select("id", "r1", "r2", "pos", term.alias("term")).join(known, "term").drop("term")
        found = part if found is None else found.unionByName(part)
    return found


def _anchors(places: DataFrame, postings: DataFrame, rare: int) -> DataFrame:
    """``(b, ipos, t, least)``: the ``rare`` rarest terms of every window.

    Of equally rare terms all windows of an item prefer the same places.
    """
    counts = postings.where("t >= 0").groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    known = places.join(counts, "t", "left").fillna(0, ["f"])
    lo = F.greatest(F.lit(0), F.col("ipos") - F.col("need") + 1)
    hi = F.least(F.col("ipos"), F.col("n") - F.col("g") - F.col("need") + 1)
    windows = known.select("b", "need", F.struct("f", (F.col("ipos") % F.col("need")).alias("turn"), "ipos", "t").alias("x"), F.explode(F.sequence(lo, hi)).alias("s"))
    best = windows.groupBy("b", "s", "need").agg(F.slice(F.array_sort(F.collect_list("x")), 1, rare).alias("xs"))
    return best.select("b", F.least("need", F.lit(rare)).alias("least"), F.explode("xs").alias("x")).select("b", "x.ipos", "x.t", "least").distinct()


def _matches(docs: DataFrame, benchmark: DataFrame, width: int, gram: int, rare: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """The postings, and ``(item, b, r1, r2, delta, places)``: the item places covered by exact windows at each alignment."""
    items = _items(benchmark, width, gram, item_col, item_text_col)
    places, terms = _places(items)
    postings = materialized(index(docs, terms, gram, id_col, text_col), "postings")
    anchors = materialized(_anchors(places, postings, rare), "anchors")
    lists = postings.where("t >= 0").select("r1", "r2", "pos", "t")
    shifted = lists.join(anchors, "t").select("b", "r1", "r2", (F.col("pos") - F.col("ipos")).alias("delta"), "ipos", "least")
    meet = shifted.groupBy("b", "r1", "r2", "delta").agg(F.size(F.collect_set("ipos")).alias("have"), F.min("least").alias("least")).where("have >= least")
    # as a table of its own, so that the join of an item in very many documents can be split
    meet = materialized(meet.select("b", "r1", "r2", "delta"), "alignments")
    wanted = meet.join(places, "b").select("b", "r1", "r2", "delta", "ipos", "g", "need", "t", (F.col("delta") + F.col("ipos")).alias("pos"))
    met = lists.join(wanted, ["r1", "r2", "pos", "t"]).groupBy("b", "r1", "r2", "delta").agg(F.array_sort(F.collect_set("ipos")).alias("ps"), F.min("g").alias("g"), F.min("need").alias("need"))
    # the first of each window whose terms all meet: need places on, it is need places further
    met = met.where("size(ps) >= need").withColumn("starts", F.expr("filter(sequence(0, size(ps) - need), i -> get(ps, i + need - 1) - get(ps, i) = need - 1)")).where("size(starts) > 0")
    covered = F.expr("array_distinct(flatten(transform(starts, i -> sequence(get(ps, i), get(ps, i) + need + g - 2))))")
    met = met.select("b", "r1", "r2", "delta", covered.alias("places"))
    return postings, met.join(items.select("item", "b"), "b")


def phrase_matches(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, gram: int = 2, rare: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``(id, item, start, item_start, n_words)``: the maximal exact phrases of every distinct row, of at least a window's words."""
    postings, met = _matches(docs, benchmark, width, gram, rare, id_col, text_col, item_col, item_text_col)
    one = met.select("item", "r1", "r2", "delta", F.array_sort("places").alias("p"))
    run = one.select("item", "r1", "r2", "delta", "p", F.posexplode("p").alias("i", "at"))
    runs = run.groupBy("item", "r1", "r2", "delta", (F.col("at") - F.col("i")).alias("run")).agg(F.min("at").alias("item_start"), F.count(F.lit(1)).alias("n_words")).distinct()
    ids = postings.where("t < 0").select("id", "r1", "r2").distinct()
    return runs.join(ids, ["r1", "r2"]).select(F.col("id").alias(id_col), "item", (F.col("delta") + F.col("item_start")).alias("start"), "item_start", "n_words")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, gram: int = 2, rare: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items, contaminated)`` of every row; items: the matching items' ids, sorted as strings."""
    postings, met = _matches(docs, benchmark, width, gram, rare, id_col, text_col, item_col, item_text_col)
    met = materialized(met, "matches")
    hits = met.select("r1", "r2", F.explode("places").alias("p"), "delta").select("r1", "r2", (F.col("p") + F.col("delta")).alias("pos")).distinct()
    hits = hits.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n_hit"))
    # a document has no more different items than places where one begins
    names = met.where("item is not null").select("r1", "r2", F.col("item").cast("string").alias("item")).distinct().groupBy("r1", "r2").agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = postings.where("t < 0").select("id", "r1", "r2", F.col("pos").cast("bigint").alias("n_words"))
    out = rows.join(hits, ["r1", "r2"], "left").join(names, ["r1", "r2"], "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, span: int = 60, rare: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id, item, start)``: each first position of ``span`` neighbouring words (fewer at a text's end) that hold
    all different words of an item, in any order, and begin with one of them.

    The lists of an item's rarest words give the places where these lie close
    enough together; there the rest of the item's words are looked up in the text.
    """
    items = only(benchmark, item=item_col, text=item_text_col).withColumn("b", F.xxhash64("item", "text")).dropDuplicates(["b"])
    items = materialized(items.select("item", "b", F.array_distinct(words(F.col("text"))).alias("ws")).where("size(ws) > 0 and size(ws) <= " + str(span)), "items")
    places, terms = _places(items.withColumns({"n": F.size("ws"), "g": F.lit(1), "need": F.size("ws")}))
    postings = materialized(index(docs, terms, 1, id_col, text_col), "postings")
    anchors = materialized(_anchors(places, postings, rare), "anchors")
    lists = postings.where("t >= 0").select("r1", "r2", "pos", "t").distinct()
    # the rarest words of an item within a span of each other, by blocks of span positions that overlap by one block
    block = F.explode(F.array(F.floor(F.col("pos") / span), F.floor(F.col("pos") / span) - 1)).alias("block")
    near = lists.join(anchors, "t").select("b", "r1", "r2", block, "ipos", "least").groupBy("b", "r1", "r2", "block").agg(F.size(F.collect_set("ipos")).alias("have"), F.min("least").alias("least"))
    near = materialized(near.where("have >= least").select("b", "r1", "r2", F.explode(F.array("block", F.col("block") - 1)).alias("block")).distinct(), "blocks")
    source = only(docs, id=id_col, text=text_col).dropDuplicates(["id", "text"])
    texts = source.select("id", F.xxhash64("id", "text").alias("r1"), F.xxhash64("text", "id").alias("r2"), words(F.col("text")).alias("all"))
    tried = near.join(texts, ["r1", "r2"]).join(items, "b")
    starts = F.expr(f"sequence(greatest(0, block * {span}), least(size(all), (block + 1) * {span}) - 1)")
    tried = tried.where(f"greatest(0, block * {span}) < least(size(all), (block + 1) * {span})").select("id", "r1", "r2", "item", "all", "ws", F.explode(starts).alias("start"))
    held = F.expr(f"array_contains(ws, get(all, int(start))) and size(array_except(ws, slice(all, int(start) + 1, {span}))) = 0")
    return tried.where(held).select(F.col("id").alias(id_col), "item", F.col("start").cast("bigint").alias("start")).distinct()


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contaminated(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT item_id, least(len(ws), 10) AS n, array_to_string(ws[p:p + 9], ' ') AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS p FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM d),
lengths AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM dw),
cut AS (SELECT doc_id, p, n, array_to_string(ws[1:n], ' ') AS w FROM grams, lengths WHERE len(ws) >= n),
hit AS (SELECT DISTINCT cut.doc_id, cut.p, cut.n, win.item_id FROM cut JOIN win ON cut.w = win.w AND cut.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM hit, range(10) AS r(o) WHERE o < n GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

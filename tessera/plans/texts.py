"""Text queries: tokens, sentences, sections, signatures, rules, typed items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunks as C
from tessera.operators import relational as O

from .base import fragments, query, table


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words, greatest(1, len(regexp_extract_all(text, '\S+')) + length(text) // 8) AS budget, length(text) AS chars, len(string_split(text, chr(10))) AS lines FROM documents")
def budget_estimate(spark, sf):
    """H1, H3, H18."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.word_count(t).cast("bigint").alias("words"), X.budget_tokens(t).cast("bigint").alias("budget"), F.char_length(t).cast("bigint").alias("chars"), F.size(F.split(t, "\n")).cast("bigint").alias("lines"))


@query(r"""WITH s AS (SELECT doc_id, list_transform(list_filter(list_transform(flatten(list_transform(regexp_split_to_array(text, '[\r\n]+'), lambda b: string_split(regexp_replace(regexp_replace(trim(trim(regexp_replace(b, '\s+', ' ', 'g')), ' -•'), ' • ', chr(1), 'g'), '([.!?;]) ', '\1' || chr(1), 'g'), chr(1)))), lambda s: trim(s, ' -•')), lambda s: length(s) >= 20), lambda s: CASE WHEN length(s) <= 1400 THEN s ELSE rtrim(substr(s, 1, 1399)) || '…' END) AS s FROM documents)
SELECT doc_id, len(s) AS sentences, CASE WHEN len(s) > 0 THEN substr(array_to_string(s[1:2], ' '), 1, 800) END AS summary FROM s""")
def sentence_summary(spark, sf):
    """Sentences and the summary of the first two."""
    found = X.sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(found).cast("bigint").alias("sentences"), F.when(F.size(found) > 0, X.summary(F.col("text"))).alias("summary"))


@query(r"""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s, split_part(text, chr(10), 1) AS t FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 80 THEN s ELSE rtrim(substr(s, 1, 79)) || '…' END AS short, substr(regexp_replace(regexp_replace(lower(t), '[^a-z0-9а-яё]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM s""")
def truncate_slug(spark, sf):
    """H16, H17."""
    return table(spark, sf, "documents").select("doc_id", X.truncated(F.col("text"), 80).alias("short"), X.slug(F.element_at(F.split("text", "\n"), 1)).alias("slug"))


@query("""WITH l AS (SELECT doc_id, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS content FROM documents)
SELECT doc_id, line, length(content) AS chars, coalesce(CAST(sum(length(content) + 2) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM l""")
def section_offsets(spark, sf):
    """The offset of each section (here a line) with a separator of two characters."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content")).withColumn("line", (F.col("line") + 1).cast("bigint"))
    before = F.sum(F.char_length("content") + 2).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return lines.select("doc_id", "line", F.char_length("content").cast("bigint").alias("chars"), F.coalesce(before, F.lit(0)).cast("bigint").alias("start"))


_SIGNATURE = r"sha1(substr(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), '\b\d{1,4}\b', ' ', 'g'), '\s+', ' ', 'g')), 1, 4000))"


@query(f"SELECT doc_id, signature FROM (SELECT doc_id, {_SIGNATURE} AS signature, row_number() OVER (PARTITION BY {_SIGNATURE} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def page_signature_dedupe(spark, sf):
    """The first of pages with one signature."""
    return table(spark, sf, "documents").groupBy(X.page_signature(F.col("text")).alias("signature")).agg(F.min("doc_id").alias("doc_id"))


@query(r"""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS l FROM documents)
SELECT doc_id, len(l) AS lines, len(list_filter(l, lambda s: regexp_matches(s, '\.{3,}') OR regexp_matches(s, '(?i)\s([ivxlcdm]+|\d{1,4})$'))) AS toc_lines FROM x WHERE len(l) >= 6""")
def contents_lines(spark, sf):
    """Lines that look like a table of contents."""
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda s: s != "")
    toc = F.filter("l", lambda s: s.rlike(r"\.{3,}") | s.rlike(r"(?i)\s([ivxlcdm]+|\d{1,4})$"))
    return table(spark, sf, "documents").select("doc_id", lines.alias("l")).where(F.size("l") >= 6).select("doc_id", F.size("l").cast("bigint").alias("lines"), F.size(toc).cast("bigint").alias("toc_lines"))


@query("""SELECT doc_id, CASE WHEN (contains(lower(text), 'license') OR contains(lower(text), 'rights')) AND length(text) < 600 THEN 'disclaimer' WHEN trim(text) = '' THEN 'empty' ELSE 'kept' END AS page_class FROM documents""")
def legal_filter(spark, sf):
    """Pages with legal markers and little else."""
    marked = X.contains_any(F.lower("text"), ("license", "rights"))
    kind = F.when(marked & (F.char_length("text") < 600), "disclaimer").when(F.trim("text") == "", "empty").otherwise("kept")
    return table(spark, sf, "documents").select("doc_id", kind.alias("page_class"))


@query(r"""WITH c AS (SELECT doc_id, lower(text) AS low, len(regexp_extract_all(text, '\S+')) AS words, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN contains(low, 'license') THEN 'legal' WHEN contains(low, 'only') THEN 'limit' WHEN contains(low, 'entre') THEN 'between' ELSE 'other' END AS kind,
contains(low, 'only') OR contains(low, 'pas ') AS negated, round(least(0.99, 0.6 + CASE WHEN s <> '' THEN 0.1 ELSE 0 END + CASE WHEN contains(low, 'only') OR contains(low, 'pas ') THEN 0.05 ELSE 0 END + CASE WHEN words > 8 THEN 0.15 ELSE 0 END + CASE WHEN contains(low, 'license') OR contains(low, 'only') THEN 0.1 ELSE 0 END)::DOUBLE, 4) AS confidence FROM c""")
def rule_classify(spark, sf):
    """Ordered classes, negation and confidence, with words that occur."""
    t = F.col("text")
    kind = X.first_class(t, (("legal", ("license",)), ("limit", ("only",)), ("between", ("entre",))), "other")
    confidence = X.rule_confidence(t, ("license", "only"), ("only", "pas "))
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"), X.has_negation(t, ("only", "pas ")).alias("negated"), F.round(confidence, 4).alias("confidence"))


@query(r"""WITH i AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+)', 1)) AS item FROM documents),
d AS (SELECT DISTINCT doc_id, lower(item) AS item FROM i)
SELECT item, count(*) AS documents FROM d GROUP BY ALL""")
def typed_items(spark, sf):
    """Capitalised candidates, once a document, counted."""
    items = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), F.lit(1)), F.lower))).alias("item"))
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("documents"))


@query(r"""SELECT doc_id, list_sort(list_intersect(['only', 'license', 'entre', 'with', 'from', 'avec'], string_split(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g'), ' '))) AS markers FROM documents""")
def marker_match(spark, sf):
    """The markers of a catalogue that a text has among its words."""
    words = F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "), " ")
    catalogue = F.array(*map(F.lit, ("only", "license", "entre", "with", "from", "avec")))
    return table(spark, sf, "documents").select("doc_id", F.array_sort(F.array_intersect(catalogue, words)).alias("markers"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR length(trim(text)) < 120 THEN true ELSE length(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 8 END AS low_signal FROM documents".replace("\\\\", "\\"))
def low_signal(spark, sf):
    """Short texts, and those with few letters."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.when(t.isNull() | (F.char_length(F.trim(t)) < 120), True).otherwise(F.char_length(F.regexp_replace(t, r"[^\p{L}]", "")) < 8).alias("low_signal"))


@query("""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS before FROM conversations)
SELECT conv_id, turn, CASE WHEN before IS NULL THEN 'first' WHEN text = before THEN 'equal' WHEN contains(text, before) OR contains(before, text) THEN 'contained' ELSE 'different' END AS relation FROM t""")
def duplicate_bodies(spark, sf):
    """A body against the one before it: equal, contained or different."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    t = table(spark, sf, "conversations").select("conv_id", "turn", "text", before.alias("b"))
    relation = F.when(F.col("b").isNull(), "first").when(F.col("text") == F.col("b"), "equal").when(F.contains("text", "b") | F.contains("b", "text"), "contained").otherwise("different")
    return t.select("conv_id", "turn", relation.alias("relation"))


@query("""WITH l AS (SELECT p_partkey, ['1.' || p_size, p_size || '.2.' || p_partkey % 10] AS v FROM part)
SELECT p_partkey, list_transform((regexp_extract_all(v[2], '(\\d+)', 1) || ['0', '0', '0', '0'])[1:4], lambda x: CAST(x AS INTEGER)) AS key, p_size * 10000 + p_partkey % 10 >= 250005 AS newer FROM l JOIN part USING (p_partkey)""".replace("\\\\", "\\"))
def version_keys(spark, sf):
    """Versions as padded integers, which compare in order."""
    v = F.concat("p_size", F.lit(".2."), F.col("p_partkey") % 10)
    key = X.version_key(v)
    return table(spark, sf, "part").select("p_partkey", key.alias("key"), (key >= F.array(*map(F.lit, (25, 2, 5, 0)))).alias("newer"))


@query("""SELECT event_id, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS payload FROM events)""")
def json_recovery(spark, sf):
    """A JSON object out of a fence, a plain text or prose."""
    n = F.col("event_id") % 3
    said = F.when(n == 0, "none").when(n == 1, F.concat(F.lit("see ```json\n"), "props", F.lit("\n``` there"))).otherwise(F.concat(F.lit("so "), "props", F.lit(" it is")))
    return table(spark, sf, "events").select("event_id", F.try_variant_get(X.json_object(said), "$.k", "bigint").alias("k"))


@query("""SELECT doc_id, list_sort(list_filter(['goal', 'limit', 'terms'], lambda x: CASE x WHEN 'goal' THEN contains(lower(text), 'the') OR contains(lower(text), 'der') WHEN 'limit' THEN contains(lower(text), 'only') ELSE contains(lower(text), 'license') END)) AS ready,
CASE WHEN (CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'der') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'only') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END) / 3 >= 0.8 THEN 'ready'
WHEN (CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'der') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'only') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END) / 3 >= 0.45 THEN 'partial' ELSE 'missing' END AS state FROM documents""")
def section_readiness(spark, sf):
    """Groups of signals that a text has, as a share with two limits."""
    groups = (("goal", ("the", "der")), ("limit", ("only",)), ("terms", ("license",)))
    have = F.array_compact(F.array(*[F.when(X.contains_any(F.lower("text"), w), F.lit(g)) for g, w in groups]))
    share = F.size("ready") / 3
    return table(spark, sf, "documents").select("doc_id", F.array_sort(have).alias("ready")).select("doc_id", "ready", F.when(share >= 0.8, "ready").when(share >= 0.45, "partial").otherwise("missing").alias("state"))


@query()
def chunk_documents(spark, sf):
    """Chunks of every document by its type."""
    return C.chunks(fragments(spark, sf), text_col="content", kind_col="document_type")


@query()
def chunk_stats(spark, sf):
    """The distribution of chunks of each document."""
    return C.distribution(C.chunks(table(spark, sf, "documents")), "doc_id")


@query("""WITH s AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_quantity, l_extendedprice) AS sizes FROM lineitem GROUP BY ALL)
SELECT l_orderkey, sizes, list_transform(range(1, len(sizes) + 1), lambda i: list_contains(list_reduce([{'sum': 0::BIGINT, 'at': 0::BIGINT, 'took': []::BIGINT[]}] || list_transform(sizes, lambda x, k: {'sum': x, 'at': k, 'took': []::BIGINT[]}),
  lambda a, b: CASE WHEN a.sum + b.sum <= 60 THEN {'sum': a.sum + b.sum, 'at': b.at, 'took': list_append(a.took, b.at)} ELSE {'sum': a.sum, 'at': b.at, 'took': a.took} END).took, i)) AS taken FROM s""")
def budget_select(spark, sf):
    """F8: greedy choice in order within a budget: which items of each key are taken."""
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice"))), lambda x: x["l_quantity"].cast("bigint"))
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(sizes.alias("sizes"))
    taken = C.within_budget(F.col("sizes"), 60)
    return s.select("l_orderkey", "sizes", taken.alias("taken"))

"""Search: lexical and vector ranking, fusion, rerank, diversity, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.hashing import hash_embedding
from tessera.functions.text import search_tokens
from tessera.functions.vectors import normalised
from tessera.operators import embedding as E
from tessera.operators import retrieval as R
from tessera.operators.shared import shared_path

from .base import FRAGMENTS_SQL, SQL, benchmark_queries, fragments, query, table, tokens_sql

_BM25 = f"""WITH {FRAGMENTS_SQL},
tok AS (SELECT doc_id, {tokens_sql("title || ' ' || content")} AS t FROM frag),
size AS (SELECT count(*) AS n, greatest(avg(len(t)), 1) AS avgdl FROM tok),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({tokens_sql("text")}) AS term FROM benchmark) GROUP BY ALL),
qn AS (SELECT query_id, count(*) AS q FROM qt GROUP BY ALL),
post AS (SELECT doc_id, term, length, count(*) AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
met AS (
  SELECT query_id, doc_id, times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl)) AS w
  FROM post JOIN df USING (term) JOIN qt USING (term), size),
sc AS (SELECT query_id, doc_id, sum(w) AS b, count(*) AS shared FROM met GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(b, 8) AS bm25, shared / q AS overlap, round(b + 0.25 * (shared / q), 8) AS lexical FROM sc JOIN qn USING (query_id)),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) AS rank FROM bm),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS rank FROM bm)
"""


@query(_BM25 + "SELECT query_id, doc_id, rank, round(lexical, 6) AS score FROM lex WHERE rank <= 10")
def bm25_topk(spark, sf):
    """The ten best fragments of every benchmark text."""
    scores = R.bm25(fragments(spark, sf), benchmark_queries(spark, sf))
    return R.ranked(scores, "lexical", 10).select("query_id", "doc_id", "rank", F.round("lexical", 6).alias("score"))


@query(_BM25 + "SELECT query_id, doc_id, round(overlap, 6) AS overlap FROM bm WHERE overlap >= 0.5")
def keyword_overlap(spark, sf):
    """Fragments that have half or more of a query's terms."""
    return R.bm25(fragments(spark, sf), benchmark_queries(spark, sf)).where("overlap >= 0.5").select("query_id", "doc_id", F.round("overlap", 6).alias("overlap"))


#: The statistical embedding, independently: sparse slots (owner, slot, x) of unit vectors.
_SLOT = "list_reduce([0] || list_transform(range(1, length(p) + 1), lambda i: unicode(substr(p, i, 1))::BIGINT), lambda h, c: (h * 131 + c) % 64)"
_EVEN = "list_sum(list_transform(range(1, length(p) + 1), lambda i: unicode(substr(p, i, 1)))) % 2 = 0"
_WORDS_OF_AXES = "(VALUES (0, ['api', 'openapi', 'endpoint', 'rest', 'graphql']), (1, ['postgres', 'database', 'pgvector', 'sql', 'schema']), (2, ['service', 'component', 'module', 'backend', 'frontend']), (3, ['rule', 'must', 'shall', 'required', 'обязан', 'должен']), (4, ['integration', 'event', 'queue', 'message', 'broker']), (5, ['risk', 'constraint', 'assumption', 'nfr', 'latency'])) AS x(axis, words)"


def embedding_sql(name: str, source: str) -> str:
    """CTEs ending in ``name(owner, slot, x)`` of ``source(owner, body)``."""
    return rf"""{name}_n AS (SELECT owner, t, count(*) AS n FROM (SELECT owner, unnest(list_transform(regexp_extract_all(body, '[\p{{L}}\p{{N}}_\-/\.]+'), lambda t: lower(t))) AS t FROM {source}) GROUP BY ALL),
{name}_w AS (SELECT owner, t, 0.5::DOUBLE + 0.5 * n / max(n) OVER (PARTITION BY owner) AS w FROM {name}_n),
{name}_p AS (SELECT t, unnest(parts) AS p, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT t, [t] || list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)) || CASE WHEN length(t) >= 5 THEN [substr(t, 1, 5), substr(t, -5)] ELSE [] END AS parts FROM (SELECT DISTINCT t FROM {name}_w))),
{name}_s AS (SELECT t, {_SLOT} AS slot, CASE WHEN {_EVEN} THEN 1.0::DOUBLE ELSE -1.0 END / k AS share FROM {name}_p),
{name}_x AS (SELECT owner, slot, w * share AS x FROM {name}_w JOIN {name}_s USING (t) UNION ALL SELECT owner, axis, 0.75 FROM {name}_w JOIN {_WORDS_OF_AXES} ON list_contains(words, t)),
{name}_r AS (SELECT owner, slot, sum(x) AS x FROM {name}_x GROUP BY ALL),
{name} AS (SELECT owner, slot, x / sqrt(sum(x * x) OVER (PARTITION BY owner)) AS x FROM {name}_r)"""


_FUSED = (
    ", fv_in AS (SELECT doc_id AS owner, title || ' ' || content AS body FROM frag), qv_in AS (SELECT item_id AS owner, text AS body FROM benchmark), "
    + embedding_sql("fv", "fv_in")
    + ", "
    + embedding_sql("qv", "qv_in")
    + """, cosines AS (SELECT q.owner AS query_id, f.owner AS doc_id, sum(q.x * f.x) AS c FROM qv q JOIN fv f USING (slot) GROUP BY ALL),
vec AS (SELECT item_id AS query_id, frag.doc_id, round(greatest(0, coalesce(c, 0)), 8) AS vector FROM benchmark CROSS JOIN frag LEFT JOIN cosines ON query_id = item_id AND cosines.doc_id = frag.doc_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector DESC, doc_id) AS rank FROM vec),
lists AS (SELECT query_id, doc_id, rank FROM vr WHERE rank <= 36 UNION ALL SELECT query_id, doc_id, rank FROM lex WHERE rank <= 36 UNION ALL SELECT query_id, doc_id, rank FROM kw WHERE rank <= 36),
fu AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS fusion FROM lists GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, doc_id) AS rank FROM fu) WHERE rank <= 24)
"""
)


@query(
    "WITH tv_in AS (SELECT doc_id AS owner, text AS body FROM documents), "
    + embedding_sql("tv", "tv_in")
    + """, slots AS (SELECT doc_id, unnest(range(64)) AS slot FROM documents)
SELECT doc_id, list(round(coalesce(x, 0), 6) + 0.0 ORDER BY slots.slot) AS embedding FROM slots LEFT JOIN tv ON owner = doc_id AND tv.slot = slots.slot GROUP BY doc_id"""
)
def hash_embeddings(spark, sf):
    """Statistical embeddings of whole texts."""
    found = table(spark, sf, "documents").select("doc_id", hash_embedding(64)(F.col("text")).alias("e"))
    return found.select("doc_id", F.transform("e", lambda x: F.round(x, 6) + 0.0).alias("embedding"))


@query(SQL["hash_embeddings"])
def stored_embeddings(spark, sf):
    """The same from a store of vectors by key, in which equal texts and texts of earlier runs are not made again."""
    docs, profile = table(spark, sf, "documents").select("doc_id", "text"), E.Profile("statistical", 64, cut="whole")
    store = E.VectorStore(spark, shared_path(spark))
    store.add(table(spark, sf, "benchmark"), profile)
    store.add(docs.where("doc_id % 2 = 0"), profile)
    return store.embedded(docs, profile).select("doc_id", F.transform("embedding", lambda x: F.round(x, 6) + 0.0).alias("embedding"))


@query(_BM25 + _FUSED + "SELECT query_id, doc_id, rank, round(fusion, 8) AS fusion FROM top")
def rrf_fuse(spark, sf):
    """Fusion of the vector, the lexical and the keyword list."""
    found = R.fused(fragments(spark, sf), benchmark_queries(spark, sf))
    return found.select("query_id", "doc_id", "rank", F.round("fusion", 8).alias("fusion"))


_RERANK = f""", qtok AS (SELECT item_id AS query_id, list_distinct({tokens_sql("text")}) AS q FROM benchmark),
rows AS (SELECT top.query_id, top.doc_id, document, vector, coalesce(lexical, 0) AS lexical, coalesce(overlap, 0) AS overlap, fusion, q, list_distinct({tokens_sql("title")}) AS tt,
  coalesce(map {{'requirement': 1.15, 'component': 1.1, 'integration': 1.08, 'api': 1.04, 'rule': 0.95}}[fragment_type], 1.0)::DOUBLE
  * coalesce(map {{'architecture': 1.1, 'api': 1.05, 'normative': 0.98, 'technology': 1.0}}[document_type], 1.0)::DOUBLE * source_weight::DOUBLE
  * CASE WHEN document_type = 'api' OR fragment_type = 'api' THEN 1.02 ELSE 1.0 END::DOUBLE * CASE WHEN required_flag THEN 1.02 ELSE 1.0 END::DOUBLE AS meta
  FROM top JOIN vec USING (query_id, doc_id) LEFT JOIN bm USING (query_id, doc_id) JOIN frag USING (doc_id) JOIN qtok USING (query_id)),
sco AS (SELECT query_id, doc_id, document, round(vector * 0.34::DOUBLE + greatest(lexical, overlap) * 0.3::DOUBLE + meta * 0.16::DOUBLE + overlap * 0.2::DOUBLE
  + CASE WHEN len(tt) > 0 THEN len(list_intersect(q, tt)) / len(tt) ELSE 0 END * 0.15::DOUBLE + fusion * 0.12::DOUBLE, 8) AS score FROM rows),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM sco) WHERE r <= 12),
cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document ORDER BY score DESC, doc_id) AS d FROM kept) WHERE d <= 3),
res AS (SELECT query_id, doc_id, document, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, score FROM cap)
"""


@query(_BM25 + _FUSED + _RERANK + "SELECT query_id, doc_id, document, rank, round(score, 6) AS score FROM res")
def hybrid_search(spark, sf):
    """3.1, H66-H68, E7, F6: fused candidates reranked, at most three of a document."""
    found = R.hybrid(fragments(spark, sf), benchmark_queries(spark, sf))
    return found.select("query_id", "doc_id", "document", "rank", F.round("score", 6).alias("score"))


_TARGETS = """, tg AS (SELECT item_id AS query_id, doc_id, CAST(max(quality) AS DOUBLE) AS relevance FROM benchmark, labels WHERE quality = 1 AND doc_id % 40 = item_id % 40 GROUP BY ALL),
tc AS (SELECT query_id, count(*) AS targets FROM tg GROUP BY ALL),
hit AS (SELECT lex.query_id, rank, relevance, row_number() OVER (PARTITION BY lex.query_id ORDER BY relevance DESC, rank) AS best FROM lex JOIN tg USING (query_id, doc_id) WHERE rank <= 10),
agg AS (SELECT query_id, count(*) FILTER (rank <= 5) AS at5, count(*) AS at10, min(rank) AS first_rank,
  sum((2.0::DOUBLE ** relevance - 1) / log2(rank + 1)) AS dcg, sum((2.0::DOUBLE ** relevance - 1) / log2(best + 1)) AS ideal FROM hit GROUP BY ALL),
cs AS (SELECT query_id, round(coalesce(at5 / targets, 0), 6) AS recall_5, round(coalesce(at10 / targets, 0), 6) AS recall_10, round(coalesce(1.0::DOUBLE / first_rank, 0), 6) AS mrr_10,
  round(coalesce(dcg / ideal, 0), 6) AS ndcg_10, CASE WHEN first_rank IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS hit_10, CASE WHEN first_rank <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_after_rerank, first_rank FROM tc LEFT JOIN agg USING (query_id))
"""


def _cases(spark, sf):
    scores = R.ranked(R.bm25(fragments(spark, sf), benchmark_queries(spark, sf)), "lexical", 10)
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id", (F.col("doc_id") % 40).alias("m"), F.lit(1.0).alias("relevance"))
    targets = benchmark_queries(spark, sf).select("query_id", (F.col("query_id") % 40).alias("m")).join(good, "m").select("query_id", "doc_id", "relevance")
    return R.evaluate(scores, targets)


@query(_BM25 + _TARGETS + "SELECT * FROM cs")
def eval_cases(spark, sf):
    """Metrics of every query."""
    return _cases(spark, sf)


@query(_BM25 + _TARGETS + "SELECT count(*) AS cases, round(coalesce(avg(recall_5), 0), 6) AS recall_5, round(coalesce(avg(recall_10), 0), 6) AS recall_10, round(coalesce(avg(mrr_10), 0), 6) AS mrr_10, round(coalesce(avg(ndcg_10), 0), 6) AS ndcg_10, round(coalesce(avg(hit_10), 0), 6) AS hit_10, round(coalesce(avg(hit_after_rerank), 0), 6) AS hit_after_rerank FROM cs")
def eval_metrics(spark, sf):
    """Macro averages."""
    return R.macro_average(_cases(spark, sf))


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 8) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""")
def cosine_topk(spark, sf):
    """The twenty nearest of all vectors to every vector whose id is divisible by 20, by exact cosine."""
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.nearest(vectors, asked, 20).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) + 0.0) AS unit FROM embeddings")
def l2_normalise(spark, sf):
    """Unit vectors."""
    return table(spark, sf, "embeddings").select("vec_id", F.transform(normalised(F.col("embedding"), 64), lambda x: F.round(x, 5) + 0.0).alias("unit"))


@query(_BM25 + "SELECT doc_id, arg_max(query_id, (lexical, -query_id)) AS query_id, round(max(lexical), 6) AS score FROM bm GROUP BY doc_id")
def best_per_key(spark, sf):
    """The query with a fragment's best score."""
    scores = R.bm25(fragments(spark, sf), benchmark_queries(spark, sf))
    best = scores.groupBy("doc_id").agg(F.max(F.struct("lexical", (-F.col("query_id")).alias("q"))).alias("m"))
    return best.select("doc_id", (-F.col("m.q")).alias("query_id"), F.round("m.lexical", 6).alias("score"))


@query(f"""WITH {FRAGMENTS_SQL}, tok AS (SELECT document_type, {tokens_sql("title || ' ' || content")} AS t FROM frag)
SELECT document_type, count(*) AS documents, round(avg(len(t)), 2) AS avg_length, CAST(sum(len(t)) AS BIGINT) AS tokens FROM tok GROUP BY ALL""")
def corpus_stats(spark, sf):
    """Number and lengths of fragments."""
    tok = fragments(spark, sf).select("document_type", F.size(search_tokens(F.concat_ws(" ", "title", "content"))).alias("n"))
    return tok.groupBy("document_type").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("n"), 2).alias("avg_length"), F.sum("n").cast("bigint").alias("tokens"))


@query(_BM25 + "SELECT query_id, doc_id, round(CASE WHEN doc_id % 3 = 0 THEN lexical ELSE 0.45::DOUBLE * lexical + 0.55::DOUBLE * overlap END, 6) AS score FROM lex WHERE rank <= 12")
def rerank_blend(spark, sf):
    """A model's scores (here the overlap, missing for every third fragment) blended into the ranking."""
    best = R.ranked(R.bm25(fragments(spark, sf), benchmark_queries(spark, sf)), "lexical", 12)
    model = F.when(F.col("doc_id") % 3 != 0, F.col("overlap"))
    return best.select("query_id", "doc_id", F.round(R.blended(F.col("lexical"), model), 6).alias("score"))

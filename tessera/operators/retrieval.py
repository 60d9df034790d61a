"""Ranking of fragments for many queries at once.

Queries are rows, so one plan ranks for all of them; nothing loops over queries. A
query meets only the fragments with which it shares a term (equi-join on terms).
Ties are broken by id.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_embedding
from tessera.functions.text import search_tokens
from tessera.functions.vectors import cosine

from .shared import written


#: Rows of postings and queries that a task of BM25 sums: about 2 million.
MET = 1 << 21
#: Characters of the texts whose postings a task counts: about 8 million, a million tokens.
CHARS = 1 << 23
#: Scores that a task looks at together when it keeps the best.
SCORES = 1 << 16


@dataclass(frozen=True)
class Policy:
    """Weights and limits of a ranking; the values are fixed."""

    name: str
    vector: float
    lexical: float
    metadata: float
    keyword: float
    vector_candidates: int
    keyword_candidates: int
    fused_candidates: int
    kept: int = 12
    per_document: int = 3
    rrf_k: int = 60
    title: float = 0.15
    fusion: float = 0.12
    normative: float = 1.0
    api: float = 1.0
    fragment_weights: Mapping[str, float] = field(default_factory=dict)
    type_weights: Mapping[str, float] = field(default_factory=dict)


GENERATION = Policy(
    "generation", 0.34, 0.3, 0.16, 0.2, 36, 36, 24, per_document=3, api=1.02,
    fragment_weights={"requirement": 1.15, "component": 1.1, "integration": 1.08, "api": 1.04, "rule": 0.95},
    type_weights={"architecture": 1.1, "api": 1.05, "normative": 0.98, "technology": 1.0},
)
VERIFICATION = Policy(
    "verification", 0.26, 0.28, 0.2, 0.26, 40, 40, 28, per_document=4, title=0.1, normative=1.04,
    fragment_weights={"rule": 1.2, "requirement": 1.12, "api": 1.08, "integration": 1.05, "component": 1.0},
    type_weights={"normative": 1.18, "api": 1.1, "architecture": 1.02, "technology": 1.0},
)
POLICIES = {p.name: p for p in (GENERATION, VERIFICATION)}


def policy(name: str | None) -> Policy:
    """The policy of a name; generation for any other."""
    return POLICIES.get(name or "", GENERATION)


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query_text") -> DataFrame:
    """``(query_id, term, times)``: how often each query repeats a term."""
    terms = queries.select(F.col(id_col).alias("query_id"), F.explode(search_tokens(F.col(text_col))).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def postings(fragments: DataFrame, terms: DataFrame, ends: bool = False, tasks: int | None = None) -> DataFrame:
    """``(doc_id, term, tf, length)`` of the terms that a query has; fragments hold doc_id, title, content.

    ``ends`` adds a row of the empty term for every fragment, so that one pass over the
    texts gives their number and lengths as well. ``tasks`` is in how many they are counted,
    by default as Spark deals them.
    """
    tokens = fragments.select("doc_id", search_tokens(F.concat_ws(" ", "title", "content")).alias("t"))
    asked = terms.select("term").distinct()
    said = F.col("t")
    if ends:
        said, asked = F.concat("t", F.array(F.lit(""))), asked.union(terms.sparkSession.range(1).select(F.lit("").alias("term")))
    long = tokens.select("doc_id", F.size("t").alias("length"), F.explode(said).alias("term"))
    # dealt before they are counted: a file's part may hold any number of texts, and counting there holds all its terms
    said = long.join(asked, "term", "left_semi")
    dealt = said.repartition(tasks, "doc_id") if tasks else said.repartition("doc_id")
    return dealt.groupBy("doc_id", "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def weights(fragments: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, DataFrame, int]:
    """``(doc_id, term, w)``, what a term adds to BM25; the queries' terms; and how many rows both have joined."""
    terms = written(query_terms(queries))
    # a row of the shuffle takes few bytes, so tasks are cut by characters: dealt by bytes, one would count millions of rows
    chars = fragments.agg(F.coalesce(F.sum(F.length(F.concat_ws(" ", "title", "content"))), F.lit(0)).alias("n")).first()["n"]
    every = written(postings(fragments, terms, ends=True, tasks=max(1, -(-chars // CHARS))))
    posted, texts = every.where("term <> ''"), every.where("term = ''")
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("length"), F.lit(1.0)).alias("avgdl"))
    both = size.select(F.struct("n", "avgdl")).scalar()
    n, avgdl = both["n"], both["avgdl"]
    df = written(posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / avgdl))
    asked = terms.groupBy("term").agg(F.count(F.lit(1)).alias("queries"))
    rows = df.join(asked, "term").agg(F.coalesce(F.sum(F.col("df") * F.col("queries")), F.lit(0)).alias("n")).first()["n"]
    return posted.join(df, "term").select("doc_id", "term", weight.alias("w")), terms, rows


def summed(met: DataFrame, terms: DataFrame) -> DataFrame:
    """``(query_id, doc_id, bm25, overlap, lexical)`` of ``(query_id, doc_id, w, times)``."""
    distinct = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("q"))
    scored = met.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("times")).alias("bm25"), F.count(F.lit(1)).alias("shared"))
    overlap = F.col("shared") / F.col("q")
    return scored.join(distinct, "query_id").select(
        "query_id", "doc_id", F.round("bm25", 8).alias("bm25"), overlap.alias("overlap"), F.round(F.col("bm25") + 0.25 * overlap, 8).alias("lexical")
    )


def scores_of(weighed: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """``summed`` of all that the queries meet."""
    # dealt by fragment, in tasks of about ``MET`` rows: what queries meet grows with queries times fragments
    return summed(weighed.repartition(max(1, -(-rows // MET)), "doc_id").join(terms, "term"), terms)


def bm25(fragments: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(query_id, doc_id, bm25, overlap, lexical)`` of the fragments that share a term with a query.

    ``overlap`` is the share of the query's distinct terms, ``lexical`` is BM25 and a
    quarter of it.
    """
    return scores_of(*weights(fragments, queries, k1, b))


def leading(scores: DataFrame, limits: Mapping[str, int], id_col: str = "doc_id") -> DataFrame:
    """Each task's rows that are in their query among the best of it by one of the columns: all that ``ranked`` can keep.

    A task holds ``SCORES`` rows and its best so far, and neither sorts nor hands on all it has.
    """

    def lead(rows: pa.Table) -> pa.Table:
        query, good = rows["query_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(), np.zeros(len(rows), bool)
        rows_by = rows.append_column("__query", pa.array(query))
        for column, limit in limits.items():
            order = pc.sort_indices(rows_by, sort_keys=[("__query", "ascending"), (column, "descending"), (id_col, "ascending")], null_placement="at_start").to_numpy()
            nth = np.arange(len(order)) - np.searchsorted(query[order], query[order])
            good[order[nth < limit]] = True
        return rows.filter(pa.array(good))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kept = [], 0, 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= max(SCORES, kept):
                best = lead(pa.Table.from_batches(held))
                held, n, kept = best.to_batches(), 0, len(best)
        if held:
            yield from lead(pa.Table.from_batches(held)).to_batches()

    return scores.mapInArrow(run, scores.schema)


def ranked(scores: DataFrame, score: str, limit: int, by: Sequence[str] = ("query_id",), id_col: str = "doc_id") -> DataFrame:
    """The ``limit`` best of each query with their ``rank``; Spark prunes per partition before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(id_col))
    best = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return best.withColumn("rank", F.col("rank").cast("bigint"))


def fuse(rankings: Sequence[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ``(query_id, doc_id, rank)`` lists: ``(query_id, doc_id, fusion)``."""
    lists = [r.select("query_id", "doc_id", (1.0 / (k + F.col("rank"))).alias("part")) for r in rankings]
    both = lists[0]
    for more in lists[1:]:
        both = both.unionByName(more)
    return both.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 10).alias("fusion"))


def _lookup(values: Mapping[str, float], key: Column) -> Column:
    if not values:
        return F.lit(1.0)
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in values.items()))
    return F.coalesce(F.try_element_at(table, key), F.lit(1.0))


def metadata_score(p: Policy, fragment_type: Column, document_type: Column, source_weight: Column, normative: Column, api: Column, required: Column) -> Column:
    flags = F.when(normative, p.normative).otherwise(1.0) * F.when(api, p.api).otherwise(1.0) * F.when(required, 1.02).otherwise(1.0)
    return _lookup(p.fragment_weights, F.coalesce(fragment_type, F.lit(""))) * _lookup(p.type_weights, F.coalesce(document_type, F.lit(""))) * F.coalesce(source_weight, F.lit(1.0)) * flags


def title_bonus(query: Column, title: Column) -> Column:
    """The share of a title's distinct tokens that the query has."""
    q, t = F.array_distinct(query), F.array_distinct(title)
    return F.when(F.size(t) > 0, F.size(F.array_intersect(q, t)) / F.size(t)).otherwise(0.0)


def rerank_score(p: Policy, vector: Column, lexical: Column, keyword: Column, overlap: Column, metadata: Column, title: Column, fusion: Column) -> Column:
    total = (
        F.greatest(vector, F.lit(0.0)) * p.vector
        + F.greatest(lexical, overlap) * p.lexical
        + metadata * p.metadata
        + F.greatest(keyword, overlap) * p.keyword
        + title * p.title
        + F.greatest(fusion, F.lit(0.0)) * p.fusion
    )
    return F.round(total, 8)


def blended(heuristic: Column, model: Column) -> Column:
    """A model's score at 0.55 with the heuristic one; without a model's score the heuristic one."""
    return F.coalesce(0.45 * heuristic + 0.55 * model, heuristic)


def diverse(scored: DataFrame, per_document: int, limit: int, score: str = "score", document: str = "document", id_col: str = "doc_id") -> DataFrame:
    """In rank order at most ``per_document`` of each document, then the first ``limit`` of each query."""
    w = Window.partitionBy("query_id", document).orderBy(F.desc(score), F.asc(id_col))
    capped = scored.withColumn("in_document", F.row_number().over(w)).where(F.col("in_document") <= per_document)
    return ranked(capped, score, limit, id_col=id_col)


def nearest(vectors: DataFrame, queries: DataFrame, limit: int, id_col: str = "vec_id", query_block: int = 2048, vector_block: int = 16_384, tile: int = 1 << 20) -> DataFrame:
    """Exact vector search for many queries: ``(query_id, id, rank, score)`` of the ``limit`` best of each.

    ``vectors`` hold ``id_col`` and ``embedding``, ``queries`` hold query_id and embedding.
    The score is max(0, cosine) at 8 places, ties go by id; null and zero vectors, and those of
    another length than the query, have score 0. Both sides are dealt in blocks; a task holds one block of each,
    scores ``tile`` pairs at once and keeps the best of its block per query, so what is shuffled last is in proportion to
    queries and vector blocks, not to pairs.
    """
    as_double = F.col("embedding").cast("array<double>")
    q, v = queries.select("query_id", as_double.alias("embedding")), vectors.select(F.col(id_col).alias("id"), as_double.alias("embedding"))
    number = lambda df, block: max(1, -(-df.count() // block))
    nq, nv = number(q, query_block), number(v, vector_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("a"), every(nv).alias("b"))
    v = v.select("id", "embedding", every(nq).alias("a"), F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int").alias("b"))

    def units(column: pd.Series, length: int) -> np.ndarray:
        out = np.zeros((len(column), length))
        for k, x in enumerate(column):
            if x is not None and len(x) == length:
                out[k] = np.nan_to_num(np.asarray(x, np.float64))
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)

    def top(asked: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``asked``, rows of ``known`` and scores of the best, ties by the row of ``known``."""
        row, col, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(asked), -1.0)  # what a later vector must exceed
        step = max(limit, tile // max(1, len(asked)))
        for start in range(0, len(known), step):
            scores = np.round(np.maximum(0.0, asked @ known[start : start + step].T), 8)
            good = scores > least[:, None]
            if scores.shape[1] > limit:
                good &= scores >= np.partition(scores, -limit, axis=1)[:, -limit, None]
            r, c = np.nonzero(good)
            row, col, score = np.concatenate([row, r]), np.concatenate([col, c + start]), np.concatenate([score, scores[r, c]])
            order = np.lexsort((col, -score, row))
            row, col, score = row[order], col[order], score[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, score, nth = (x[nth < limit] for x in (row, col, score, nth))
            least[row[nth == limit - 1]] = score[nth == limit - 1]
        return row, col, score

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left.query_id[:0], "id": right.id[:0], "score": np.zeros(0)})
        right = right.sort_values("id", ignore_index=True)
        length = max((len(x) for x in left.embedding if x is not None), default=0)
        known, parts = units(right.embedding, length), []
        for start in range(0, len(left), 256):
            row, col, score = top(units(left.embedding[start : start + 256], length), known)
            parts.append(pd.DataFrame({"query_id": left.query_id.to_numpy()[start + row], "id": right.id.to_numpy()[col], "score": score}))
        return pd.concat(parts)

    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {v.schema['id'].dataType.simpleString()}, score double"
    found = q.groupBy("a", "b").cogroup(v.groupBy("a", "b")).applyInPandas(best, kinds)
    return ranked(found, "score", limit, id_col="id").select("query_id", F.col("id").alias(id_col), "rank", "score")


def hybrid(fragments: DataFrame, queries: DataFrame, p: Policy = GENERATION, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """The whole search: vector, BM25 and keyword lists, fusion, rerank, diversity.

    Fragments hold doc_id, document, title, content, fragment_type, document_type,
    source_weight and required_flag; queries query_id and query_text. ``vectors``
    (doc_id, embedding) and ``query_vectors`` (query_id, embedding) are by default the
    statistical embeddings of title with content and of the query.
    """
    rows = written(fused(fragments, queries, p, vectors, query_vectors))
    tokens = queries.select("query_id", search_tokens(F.col("query_text")).alias("q"))
    rows = rows.join(fragments.drop("content"), "doc_id").join(tokens, "query_id")
    kind = F.col("fragment_type")
    meta = metadata_score(
        p, kind, F.col("document_type"), F.col("source_weight"), (F.col("document_type") == "normative") | (kind == "rule"), (F.col("document_type") == "api") | (kind == "api"), F.col("required_flag")
    )
    total = rerank_score(p, F.col("vector"), F.col("lexical"), F.col("overlap"), F.col("overlap"), meta, title_bonus(F.col("q"), search_tokens(F.col("title"))), F.col("fusion"))
    best = ranked(rows.withColumn("score", total), "score", p.kept).drop("rank")
    return diverse(best, p.per_document, p.kept).select("query_id", "doc_id", "document", "rank", "score")


def fused(fragments: DataFrame, queries: DataFrame, p: Policy = GENERATION, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id, rank, fusion, vector, lexical, overlap)``: the candidates of the three lists."""
    embed = hash_embedding(64)
    vectors = written(fragments.select("doc_id", embed(F.concat_ws(" ", "title", "content")).alias("embedding")) if vectors is None else vectors)
    query_vectors = written(queries.select("query_id", embed(F.col("query_text")).alias("embedding")) if query_vectors is None else query_vectors)
    weighed, terms, met = weights(fragments, queries)
    scores = written(leading(scores_of(weighed, terms, met), {"lexical": p.keyword_candidates, "overlap": p.keyword_candidates}))
    near = nearest(vectors, query_vectors, p.vector_candidates, "doc_id")
    lists = [near, ranked(scores, "lexical", p.keyword_candidates), ranked(scores, "overlap", p.keyword_candidates)]
    best = written(ranked(fuse(lists, p.rrf_k), "fusion", p.fused_candidates))
    # the few that are left are scored again: those of the vector list have scores that lead nowhere
    own = summed(weighed.join(best.select("query_id", "doc_id"), "doc_id").join(terms, ["query_id", "term"]), terms)
    rows = best.join(vectors, "doc_id").join(query_vectors.withColumnRenamed("embedding", "asked"), "query_id").join(own, ["query_id", "doc_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    vector = F.round(F.greatest(F.lit(0.0), cosine(F.col("embedding"), F.col("asked"))), 8)
    return rows.select("query_id", "doc_id", "rank", "fusion", vector.alias("vector"), zero("lexical"), zero("overlap"))


def evaluate(predicted: DataFrame, targets: DataFrame, top_k: int = 10) -> DataFrame:
    """Metrics of each query: Recall@5/10, MRR@10, nDCG@10, HitRate@10, HitAfterRerank at 6 places.

    ``top_k`` is how many of the reranked list are looked at; at most ten count.

    ``predicted`` holds query_id, doc_id, rank; ``targets`` query_id, doc_id, relevance
    over 0. The ideal order is that of the observed ten. Queries without a prediction
    have zeros.
    """
    wanted = targets.where("relevance > 0").groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))
    count = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("targets"))
    hits = predicted.where(F.col("rank") <= min(10, top_k)).join(wanted, ["query_id", "doc_id"])
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.asc("rank")))
    hits = hits.withColumn("best", best).groupBy("query_id").agg(
        F.count_if(F.col("rank") <= 5).alias("at5"),
        F.count(F.lit(1)).alias("at10"),
        F.min("rank").alias("first_rank"),
        F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(gain / F.log2(F.col("best") + 1)).alias("ideal"),
    )
    rows = count.join(hits, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.select(
        "query_id",
        zero(F.col("at5") / F.col("targets")).alias("recall_5"),
        zero(F.col("at10") / F.col("targets")).alias("recall_10"),
        zero(1.0 / F.col("first_rank")).alias("mrr_10"),
        zero(F.col("dcg") / F.col("ideal")).alias("ndcg_10"),
        *[F.when(F.col("first_rank").isNotNull(), 1.0).otherwise(0.0).alias(n) for n in ("hit_10", "hit_after_rerank")],
        "first_rank",
    )


def macro_average(cases: DataFrame) -> DataFrame:
    """One row of the cases' means; zeros for no case."""
    names = ("recall_5", "recall_10", "mrr_10", "ndcg_10", "hit_10", "hit_after_rerank")
    return cases.agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6).alias(n) for n in names])

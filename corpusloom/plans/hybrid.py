"""Hybrid search as one plan: vector leg, text leg, fusion, rerank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import fulltext, fusion, rerank, vector
from corpusloom.operators.postings import Index
from corpusloom.session import written

CHUNKS, DOCUMENTS = 100, 30


def vector_leg(chunks: DataFrame, queries: DataFrame, chunk: str = "chunk_id", doc: str = "doc_id", level: str | None = None, threshold: bool = True) -> DataFrame:
    """query_id, doc_id, score, rank: top 100 chunks, best chunk of each document, threshold, top 30 documents."""
    pool = fusion.level_filter(chunks, "court_level", level) if level else chunks
    top = vector.top_k_batch(pool, queries, CHUNKS, chunk).join(pool.select(chunk, doc), chunk)
    best = vector.best_of_document(top, doc, chunk)
    best = vector.adaptive_threshold(best) if threshold else best
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), doc)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DOCUMENTS).select("query_id", doc, "score", "rank")


def text_leg(docs: DataFrame | Index, queries: DataFrame, scorer: str = "tf") -> DataFrame:
    """query_id, doc_id, score, rank: phrase and OR matches merged, top 100, from documents with terms or from stored postings. scorer: tf or bm25."""
    if isinstance(docs, Index):
        return fulltext.phrase_or_merge(docs.top_phrases(queries), docs.top(queries, scorer=scorer))
    either = fulltext.tf_rank(docs, queries) if scorer == "tf" else fulltext.bm25_rank(docs, queries)
    return fulltext.phrase_or_merge(fulltext.phrase_rank(docs, queries), either)


def hybrid_search(queries: DataFrame, documents: DataFrame, chunks: DataFrame, scorer: str = "tf", level: str | None = None, strict_filters: bool = False, documents_level: str = "court_level", index: Index | None = None) -> DataFrame:
    """Fused results of each query (query_id, text, query_vector), 30 at most, with score_kind.

    A level filters the vector leg alone, unless strict_filters asks for both legs. The text leg
    reads stored postings, if an index is given and no filter applies to that leg.
    """
    pool = fusion.level_filter(documents, documents_level, level) if strict_filters and level else documents
    v = written(vector_leg(chunks, queries, level=level), "vector-leg")
    if index is not None and pool is documents:
        t = written(text_leg(index, queries, scorer), "text-leg")
        return fusion.with_bypass(fusion.rrf(v, t), v, t)
    terms = pool.select("doc_id", "terms") if "terms" in pool.columns else written(fulltext.documents_with_terms(pool), "terms")
    t = written(text_leg(terms, queries, scorer), "text-leg")  # 30 and 100 rows a query
    return fusion.with_bypass(fusion.rrf(v, t), v, t)


def answer(queries: DataFrame, documents: DataFrame, found: DataFrame, backend: str | None = None) -> DataFrame:
    """Reranks what was found by the offline scorer; the full text joins only for rows that a search found."""
    found = written(found, "found")
    texts = found.select("query_id", "doc_id").join(documents.select("doc_id", X.rerank_preview(F.col("text")).alias("preview")), "doc_id")
    scored = texts.join(queries.select("query_id", "text"), "query_id").select("query_id", "doc_id", rerank.scaled(rerank.token_overlap(F.col("text"), F.col("preview"))).alias("score"))
    return rerank.rerank(found, written(scored, "scores"), backend=backend)

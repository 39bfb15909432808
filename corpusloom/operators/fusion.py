"""Fusion of retrieval legs and of several searches of one session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(vector: DataFrame, text: DataFrame, k: int = 30, query_key: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of two legs (query, document, rank): query, document, vec_rank, bm25_rank, score, rank.

    A missing leg adds nothing; ties stand in vector order, then text order, then by document.
    """
    v = vector.select(query_key, doc, F.col("rank").alias("vec_rank"))
    t = text.select(query_key, doc, F.col("rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (RRF_K + F.col(c)), F.lit(0.0))
    both = v.join(t, [query_key, doc], "full_outer").withColumn("score", part("vec_rank") + part("bm25_rank"))
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("bm25_rank"), doc)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def overlap(fused: DataFrame, query_key: str = "query_id") -> DataFrame:
    """How many documents both legs, the vector leg alone and the text leg alone found."""
    v, t = F.col("vec_rank").isNotNull(), F.col("bm25_rank").isNotNull()
    return fused.groupBy(query_key).agg(F.count_if(v & t).alias("both"), F.count_if(v & ~t).alias("vector_only"), F.count_if(~v & t).alias("text_only"))


def with_bypass(fused: DataFrame, vector: DataFrame, text: DataFrame, query_key: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Fused results, or the vector leg with its own scores for questions whose text leg is empty; score_kind tells which."""
    asked = text.select(query_key).distinct()
    alone = vector.join(asked, query_key, "left_anti").select(query_key, doc, F.col("rank").alias("vec_rank"), F.lit(None).cast("int").alias("bm25_rank"), "score", "rank", F.lit("cosine").alias("score_kind"))
    kept = fused.join(asked, query_key, "left_semi").withColumn("score_kind", F.lit("rrf"))
    return kept.unionByName(alone)


def first_seen(found: DataFrame, session: str, step: str, position: str, doc: str) -> DataFrame:
    """Each document of a session as the first search that found it has it; rows without a document go."""
    order = Window.partitionBy(session, doc).orderBy(step, position)
    return found.where(F.col(doc).isNotNull() & (F.col(doc).cast("string") != "")).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def year_between(df: DataFrame, year: str, low: int | None = None, high: int | None = None, keep_unparsable: bool = False) -> DataFrame:
    """Year range on numbers or text; 0 or None is no bound. Years that are no numbers stay only if asked for (else they count as 0)."""
    value = F.col(year).cast("string").try_cast("int")
    known = value if keep_unparsable else F.coalesce(value, F.lit(0))
    rule = F.lit(True)
    if low:
        rule = rule & (known >= low)
    if high:
        rule = rule & (known <= high)
    return df.where(value.isNull() | rule if keep_unparsable else rule)


def level_filter(df: DataFrame, level: str, value: str | None) -> DataFrame:
    """Applies a level only if it's one that filters; else nothing is filtered."""
    from corpusloom.functions.dimensions import FILTER_LEVELS

    return df.where(F.col(level) == value) if value in FILTER_LEVELS else df


def legacy_filter(df: DataFrame, court: str | None = None, year_from: str | None = None, year_to: str | None = None) -> DataFrame:
    """The older store's filter: court and years compared as text."""
    rules = [F.col("court") == court] * bool(court) + [F.col("year") >= year_from] * bool(year_from) + [F.col("year") <= year_to] * bool(year_to)
    for r in rules:
        df = df.where(r)
    return df

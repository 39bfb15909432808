"""The second scoring of found documents: scorers, merge, keep rules, boost, cutoff, fallback, and what is made of summaries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import dimensions as D

MIN_SCORE = {"generative": 4.0, "cross": 0.1, "cross+generative": 0.1}
FORCE_KEEP_RANK, BOOST, RESCUE_BELOW = 50, 2.0, 1.0
KEEP_LEAST, KEEP_MOST, EXTEND_FROM, MOST_IN, BYPASS, FALLBACK = 30, 75, 2.0, 180, 3, 5


def scaled(score: Column) -> Column:
    """A score of 0 to 1 on the scale of 0 to 10 with one decimal, halves up."""
    return F.floor(score * 100 + 0.5) / 10


def merged(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The larger of two scorers' scores; missing ones count as 0."""
    both = first.select(*keys, F.col("score").alias("_a")).join(second.select(*keys, F.col("score").alias("_b")), keys, "left")
    return both.select(*keys, F.greatest(F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))).alias("score"))


def boost(rank: Column) -> Column:
    return F.when(rank <= FORCE_KEEP_RANK, BOOST * (1 - rank / FORCE_KEEP_RANK)).otherwise(F.lit(0.0))


def keep_flags(docs: DataFrame, backend: str = "cross") -> DataFrame:
    """Adds eligible: the rerank score reaches the backend's minimum, or the keyword rank is strong."""
    strong = F.coalesce(F.col("bm25_rank") <= FORCE_KEEP_RANK, F.lit(False))
    return docs.withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0))).withColumn("eligible", (F.col("rerank_score") >= MIN_SCORE[backend]) | strong)


def cutoff(docs: DataFrame, query_key: str, doc: str) -> DataFrame:
    """Adds effective, place and kept to eligible rows: at least 30 of a query are kept, and up to 75 while the effective score is 2 or more."""
    docs = docs.withColumn("effective", F.col("rerank_score") + boost(F.col("bm25_rank")))
    order = Window.partitionBy(query_key).orderBy(F.desc("effective"), F.desc_nulls_last("score"), doc)
    strong = F.count_if(F.col("effective") >= EXTEND_FROM).over(Window.partitionBy(query_key))
    return docs.withColumn("place", F.row_number().over(order)).withColumn("kept", F.col("place") <= F.least(F.lit(KEEP_MOST), F.greatest(F.lit(KEEP_LEAST), strong)))


def rerank(found: DataFrame, scores: DataFrame, rescue: DataFrame | None = None, query_key: str = "query_id", doc: str = "doc_id", backend: str | None = None) -> DataFrame:
    """Kept documents of each query, from found (query, doc, score, bm25_rank) and scores by (query, doc).

    The best 180 by search score are scored; low ones take a rescue scorer's higher score; if no
    row would be kept, the first five are; three documents or fewer pass as they are. Scores
    are joined by document, never by position, and the minimum follows the scorer that ran.
    """
    keys = [query_key, doc]
    by_score = Window.partitionBy(query_key).orderBy(F.desc_nulls_last("score"), doc)
    rows = found.withColumn("_in", F.row_number().over(by_score)).where(F.col("_in") <= MOST_IN)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(query_key)))
    if rescue is not None:
        low = scores.where(F.col("score") < RESCUE_BELOW).select(*keys)
        scores = merged(scores, rescue.join(low, keys, "left_semi"), keys)
    backend = backend or ("cross" if rescue is None else "cross+generative")
    rows = keep_flags(rows.join(scores.select(*keys, F.col("score").alias("rerank_score")), keys, "left"), backend)
    judged = cutoff(rows.where("eligible or _n <= 3"), query_key, doc)
    kept = judged.where(F.col("kept") | (F.col("_n") <= BYPASS)).withColumn("fallback", F.lit(False))
    none = rows.join(kept.select(query_key).distinct(), query_key, "left_anti").where(F.col("_in") <= FALLBACK)
    none = none.withColumn("effective", F.lit(None).cast("double")).withColumn("place", F.col("_in")).withColumn("kept", F.lit(True)).withColumn("fallback", F.lit(True))
    return kept.unionByName(none).drop("_in", "_n", "eligible", "kept")


def scorer(score: Callable[[str, str], float]):
    """A scorer (query, preview) -> score as a column function over Arrow batches."""

    @F.pandas_udf("double")
    def run(query: pd.Series, preview: pd.Series) -> pd.Series:
        return pd.Series([score(q or "", p or "") for q, p in zip(query, preview, strict=True)], dtype="float64")

    return run


def token_overlap(query: Column, preview: Column) -> Column:
    """The offline scorer: the share of a question's terms that the preview holds, 0 to 1."""
    from corpusloom.operators.fulltext import analyze, query_terms

    asked = query_terms(query)
    return F.coalesce(F.size(F.array_intersect(asked, analyze(preview))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def ordered_rank(order: dict[str, int], value: Column, otherwise: int) -> Column:
    return D.lookup(order, value, F.lit(otherwise))


def relevance_rule(engagement: Column, rating: Column) -> Column:
    """A rating can't be higher than the engagement allows."""
    return F.when((engagement == "NOT_ADDRESSED") & rating.isin("HIGH", "MEDIUM"), F.lit("LOW")).when((engagement == "MENTIONED") & (rating == "HIGH"), F.lit("MEDIUM")).otherwise(rating)


SUMMARY_SCHEMA = (
    "caseHeader struct<parties:string,court:string,date:string,caseNumber:string>, status string, facts string, coreIssue string, "
    "findings struct<engagement:string,analysis:string,quote:string>, outcome string, relevance struct<rating:string,reasoning:string>"
)


def parsed_summary(text: Column) -> Column:
    """A summary's JSON as a struct with the relevance rule applied; what isn't a valid summary becomes the default one."""
    got = F.from_json(text, SUMMARY_SCHEMA)
    valid = got["relevance"]["rating"].isin(*D.RELEVANCE_ORDER) & got["findings"]["engagement"].isin(*D.ENGAGEMENTS)
    ruled = got.withField("relevance.rating", relevance_rule(got["findings"]["engagement"], got["relevance"]["rating"]))
    blank = '{"caseHeader":{"parties":"","court":"","date":"","caseNumber":""},"status":"","facts":"","coreIssue":"","findings":{"engagement":"NOT_ADDRESSED","analysis":"","quote":""},"outcome":"","relevance":{"rating":"NONE","reasoning":""}}'
    return F.when(F.coalesce(valid, F.lit(False)), ruled).otherwise(F.from_json(F.lit(blank), SUMMARY_SCHEMA))


def display(sources: DataFrame, summaries: DataFrame, expected: int | None = None, query_key: str = "query_id", doc: str = "doc_id", gate: bool = True) -> DataFrame:
    """Sources rated HIGH or MEDIUM, by rating, then newest first; with the gate, only once all expected summaries are there."""
    rows = sources.join(summaries.select(query_key, doc, "rating"), [query_key, doc], "left")
    of_query = Window.partitionBy(query_key)
    wanted = F.lit(expected) if expected is not None else F.count(F.lit(1)).over(of_query)
    rows = rows.withColumn("_done", F.count("rating").over(of_query)).withColumn("_want", wanted)
    if gate:
        rows = rows.where((F.col("_want") > 0) & (F.col("_done") >= F.col("_want")))
    rows = rows.where(F.col("rating").isin("HIGH", "MEDIUM")).drop("_done", "_want")
    year = F.coalesce(F.col("year").cast("string").try_cast("int"), F.lit(0))
    order = of_query.orderBy(ordered_rank(D.RELEVANCE_ORDER, F.col("rating"), 4), F.desc(year), doc)
    return rows.withColumn("place", F.row_number().over(order))


def progress(sources: DataFrame, summaries: DataFrame, query_key: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Summaries there, expected, percent and whether all are done."""
    rows = sources.join(summaries.select(query_key, doc, F.lit(1).alias("_s")), [query_key, doc], "left")
    got = rows.groupBy(query_key).agg(F.count("_s").alias("summarized"), F.count(F.lit(1)).alias("expected"))
    return got.withColumn("percent", F.round(F.col("summarized") * 100 / F.col("expected"))).withColumn("all_done", F.col("summarized") >= F.col("expected"))


def summary_order(query_key: str, doc: str = "doc_id") -> Window:
    """By court level, relevance, newest first."""
    return Window.partitionBy(query_key).orderBy(ordered_rank(D.LEVEL_ORDER, F.col("court_level"), 4), ordered_rank(D.RELEVANCE_ORDER, F.col("relevance"), 3), F.desc("year"), doc)


def brief_line(relevance: Column, court: Column, year: Column, doc: Column, issue: Column) -> Column:
    return F.concat(F.lit("- ["), relevance, F.lit("] "), D.lookup(D.COURT_LIST_NAME, court, court), F.lit(", "), year.cast("string"), F.lit(" — Document ID: "), doc.cast("string"), F.lit(" — "), F.left(issue, F.lit(120)))


def result_text(rank: Column, title: Column, court: Column, year: Column, score: Column, text: Column) -> Column:
    """One search result as context for a language model."""
    return F.concat(F.lit("[Result "), rank.cast("string"), F.lit("] "), title, F.lit("\nCourt: "), court, F.lit(" | Year: "), year.cast("string"), F.lit(" | Relevance: "), score.cast("string"), F.lit("%\n"), text)


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return tokens_in / 1_000_000 * price_in + tokens_out / 1_000_000 * price_out

"""Full-text search: analyzer, postings, two scorers, phrases, and the merge of phrase and OR results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import dimensions as D
from corpusloom.operators import scoring
from corpusloom.session import small, written

K1, B = 1.2, 0.75


def analyze(text: Column, stop_words: list[str] | None = None, dictionary: list[str] | None = None) -> Column:
    """Lower-cased runs of letters and digits without stop words, in order; no stemming. ASCII terms of the dictionary stay even as stop words. Null gives an empty list."""
    known = {w.lower() for w in (D.DICTIONARY if dictionary is None else dictionary) if w.isascii()}
    stop = F.array(*[F.lit(w) for w in (D.STOP_WORDS if stop_words is None else stop_words) if w not in known]).cast("array<string>")
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (w != "") & ~F.array_contains(stop, w))


def query_tokens(query: Column) -> Column:
    """Words of two characters or more, then only letters, digits and ./() of them; what becomes empty goes."""
    words = F.filter(F.split(query, r"(?U)\s+"), lambda w: F.char_length(w) >= 2)
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}./()]", "")), lambda w: w != "")


def query_terms(query: Column) -> Column:
    """Distinct index terms of a question's tokens; characters that query languages reserve are plain separators."""
    return F.array_distinct(analyze(F.array_join(query_tokens(query), " ")))


def phrase_gate(query: Column) -> Column:
    """Whether a question may hold an exact reference: a digit, one of .()/, or six words at most."""
    return query.rlike("[0-9]") | query.rlike("[.()/]") | (F.size(F.split(query, r"(?U)\s+")) <= 6)


def documents_with_terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), analyze(F.col(text)).alias("terms"))


def postings(docs: DataFrame) -> DataFrame:
    """term, doc_id, tf, doc_len of documents with terms; counted within map tasks first."""
    rows = docs.select("doc_id", F.size("terms").alias("doc_len"), F.explode("terms").alias("term"))
    return rows.groupBy("term", "doc_id", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def positions(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode("terms").alias("pos", "term"))


def term_frequency(docs: DataFrame) -> DataFrame:
    """term, df, cf; one shuffle, as each document's sorted terms tell which are its first ones."""
    ordered = docs.select(F.array_sort("terms").alias("_t"))
    marked = F.transform("_t", lambda t, k: F.struct(t.alias("term"), ((k == 0) | (F.get(F.col("_t"), k - 1) != t)).cast("long").alias("first")))
    rows = ordered.select(F.inline(marked))
    return rows.groupBy("term").agg(F.sum("first").alias("df"), F.count(F.lit(1)).alias("cf"))


def matches(docs: DataFrame, queries: DataFrame, query: str = "text", query_key: str = "query_id") -> DataFrame:
    """query_id, term, doc_id, tf, doc_len: documents that hold any of a question's terms.

    Only terms that are asked for are counted, so text that no question touches is dropped before the shuffle.
    """
    asked = queries.select(query_key, F.explode(query_terms(F.col(query))).alias("term"))
    terms = small(asked.select("term").distinct())
    rows = docs.select("doc_id", F.size("terms").alias("doc_len"), F.explode("terms").alias("term")).join(terms, "term", "left_semi")
    counted = rows.groupBy("term", "doc_id", "doc_len").agg(F.count(F.lit(1)).alias("tf"))
    return counted.join(small(asked), "term").select(query_key, "term", "doc_id", "tf", "doc_len")


def _ranked(scored: DataFrame, k: int, query_key: str) -> DataFrame:
    """Scores are rounded, so that sums in another order rank alike."""
    scored = scored.withColumn("score", F.round("score", 9))
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tf_rank(docs: DataFrame, queries: DataFrame, k: int = 100, query: str = "text", query_key: str = "query_id") -> DataFrame:
    """Top k by the sum of 1 + ln(tf) over matched terms, over 1 + ln(document length)."""
    asked = _asked(queries, query, query_key)
    once, others = _by_id(docs)
    found = scoring.best(once, asked.withColumn("weight", F.lit(1.0)), k, scoring.of_documents(lambda tf, _: 1 + np.log(tf), lambda n: 1 + np.log(n)))
    if others is not None:
        found = found.unionByName(tf_scores(others, queries, query, query_key).withColumnRenamed(query_key, "query_id"))
    return _ranked(found.withColumnRenamed("query_id", query_key), k, query_key)


def _asked(queries: DataFrame, query: str, query_key: str) -> DataFrame:
    return written(queries.select(F.col(query_key).alias("query_id"), F.explode(query_terms(F.col(query))).alias("term")).distinct(), "asked")


def _by_id(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id no other has, which are scored alone, and the others, if any."""
    twice = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "repeated-ids")
    if twice.isEmpty():
        return docs.select("doc_id", "terms"), None
    ids = small(twice)
    others = docs.join(ids, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    return docs.where("doc_id IS NOT NULL").join(ids, "doc_id", "left_anti").select("doc_id", "terms"), others


def bm25_rank(docs: DataFrame, queries: DataFrame, k: int = 100, query: str = "text", query_key: str = "query_id") -> DataFrame:
    """Top k by Okapi BM25 (k1 1.2, b 0.75)."""
    asked = _asked(queries, query, query_key)
    once, others = _by_id(docs)
    n, average = docs.agg(F.count(F.lit(1)), F.avg(F.size("terms"))).first()
    average = float(average or 1.0)
    terms = small(asked.select("term").distinct())
    held = once.select(F.explode(F.array_distinct("terms")).alias("term")).join(terms, "term", "left_semi")
    if others is not None:
        held = held.unionByName(others.select("doc_id", F.explode("terms").alias("term")).where("doc_id IS NOT NULL").join(terms, "term", "left_semi").distinct().select("term"))
        held = held.unionByName(others.where("doc_id IS NULL").select(F.explode("terms").alias("term")).join(terms, "term", "left_semi").distinct())
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = written(asked.join(small(df), "term").select("query_id", "term", idf.alias("weight")), "weighted")
    share = lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
    found = scoring.best(once, asked, k, scoring.of_documents(share, np.ones_like))
    if others is not None:
        rows = matches(others, queries, query, query_key).withColumnRenamed(query_key, "query_id").join(small(asked), ["query_id", "term"])
        found = found.unionByName(rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * share(F.col("tf"), F.col("doc_len"))).alias("score")))
    return _ranked(found.withColumnRenamed("query_id", query_key), k, query_key)


def phrase_match(docs: DataFrame, phrases: DataFrame, query: str = "text", query_key: str = "query_id") -> DataFrame:
    """query_id, doc_id, occurrences: documents that hold all terms of a phrase one after the other.

    Only the places of each phrase's rarest term in the corpus are looked at; the terms around
    them are compared in place. Phrases of which the corpus lacks a term drop out before.
    """
    asked = phrases.select(query_key, analyze(F.col(query)).alias("_phrase")).where(F.size("_phrase") > 0)
    words = written(asked.select(query_key, "_phrase", F.posexplode("_phrase").alias("off", "term")), "phrase-terms")
    terms = small(words.select("term").distinct())
    held = docs.select(F.explode("terms").alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("_n"))
    rarest = words.join(held, "term", "left").groupBy(query_key, "_phrase").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "term", "off")).alias("_a"))
    anchors = written(rarest.where("_a.n > 0").select(query_key, "_phrase", F.col("_a.term").alias("term"), F.col("_a.off").alias("off")), "anchors")
    starts = positions(docs).join(small(anchors.select(query_key, "term", "off")), "term").select(query_key, "doc_id", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    starts = written(starts, "phrase-starts")
    there = docs.join(small(starts.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "terms")
    found = starts.join(there, "doc_id").join(small(anchors.select(query_key, "_phrase")), query_key)
    found = found.where(F.slice("terms", F.col("start") + 1, F.size("_phrase")) == F.col("_phrase"))
    return found.groupBy(query_key, "doc_id").agg(F.count(F.lit(1)).alias("occurrences"))


def phrase_rank(docs: DataFrame, phrases: DataFrame, k: int = 20, query: str = "text", query_key: str = "query_id") -> DataFrame:
    """Top k phrase matches of questions that pass the gate, scored like tf_rank; only documents with a match are scored."""
    gated = phrases.where(phrase_gate(F.col(query)))
    found = written(phrase_match(docs, gated, query, query_key).select(query_key, "doc_id"), "phrases")
    some = docs.join(small(found.select("doc_id").distinct()), "doc_id", "left_semi")
    # Counts meet the questions that match their document, not all that ask for the term.
    asked = gated.select(query_key, F.explode(query_terms(F.col(query))).alias("term")).distinct()
    counted = postings(some).join(small(asked.select("term").distinct()), "term", "left_semi")
    rows = counted.join(small(found.distinct()), "doc_id").join(small(asked), [query_key, "term"], "left_semi")
    return _ranked(_tf_summed(rows, query_key), k, query_key)


def tf_scores(docs: DataFrame, queries: DataFrame, query: str = "text", query_key: str = "query_id") -> DataFrame:
    return _tf_summed(matches(docs, queries, query, query_key), query_key)


def _tf_summed(rows: DataFrame, query_key: str) -> DataFrame:
    return rows.groupBy(query_key, "doc_id").agg((F.sum(1 + F.log("tf")) / (1 + F.log(F.max("doc_len")))).alias("score"))


def phrase_or_merge(phrase: DataFrame, either: DataFrame, k: int = 100, query_key: str = "query_id") -> DataFrame:
    """Phrase and OR results, a phrase row before an OR row of the same document; the order of all is by score."""
    rows = phrase.select(query_key, "doc_id", "score", F.lit(0).alias("leg")).unionByName(either.select(query_key, "doc_id", "score", F.lit(1).alias("leg")))
    first = Window.partitionBy(query_key, "doc_id").orderBy("leg")
    return _ranked(rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r"), k, query_key)

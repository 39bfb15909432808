"""Corpus statistics, evaluation and usage measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.sources.sinks import numbered


def extraction_stats(parsed: DataFrame, court: str = "court", fmt: str = "fmt") -> DataFrame:
    """Documents, words, characters, references and average words per court, per format and overall, in one pass of grouping sets."""
    sets = [[F.col(court)], [F.col(fmt)], []]
    got = parsed.groupingSets(sets, court, fmt).agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"), F.sum("chars").alias("chars"), F.sum("refs").alias("refs"))
    return got.withColumn("avg_words", F.expr("words div documents"))


def index_stats(entries: DataFrame, court: str = "court", year: str = "year") -> DataFrame:
    """Entries and first and last year per court, with a row of totals (court null)."""
    return entries.rollup(court).agg(F.count(F.lit(1)).alias("entries"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def distribution(df: DataFrame, column: str | Column, top: int | None = None) -> DataFrame:
    """Values by falling count."""
    got = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(column) if isinstance(column, str) else column)
    return got.limit(top) if top else got


def distinct_documents(chunks: DataFrame, doc: str) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct(doc).alias("documents"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def hit_rate(rated: DataFrame, rating: str = "rating", query_key: str | None = None) -> DataFrame:
    """Counts by rating and the share rated HIGH or MEDIUM."""
    r = F.col(rating)
    good = F.count_if(r.isin("HIGH", "MEDIUM"))
    counts = [F.count_if(r == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW", "NONE")]
    return rated.groupBy(*[query_key] * bool(query_key)).agg(*counts, F.round(good / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("hit_rate"))


def ground_truth_tracking(truth: DataFrame, sources: DataFrame, reranked: DataFrame, summaries: DataFrame, doc: str = "doc_id") -> DataFrame:
    """For each expected document whether each stage had it, and its rating."""
    rows = truth.join(sources.select(doc, F.col("rank").alias("source_rank")), doc, "left")
    rows = rows.join(reranked.select(doc, F.col("place").alias("rerank_place")), doc, "left")
    return rows.join(summaries.select(doc, "rating"), doc, "left")


def category_recall(tracked: DataFrame, category: str = "category", found: str = "rerank_place") -> DataFrame:
    return tracked.groupBy(category).agg(F.count_if(F.col(found).isNotNull()).alias("kept"), F.count(F.lit(1)).alias("expected"))


def token_usage(log: DataFrame, pricing: DataFrame, model: str = "model") -> DataFrame:
    """Tokens and cost by model."""
    sums = log.groupBy(model).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    cost = F.col("tokens_in") / 1_000_000 * F.col("price_in") + F.col("tokens_out") / 1_000_000 * F.col("price_out")
    return sums.join(F.broadcast(pricing), sums[model] == pricing["model"]).select(sums[model], "tokens_in", "tokens_out", F.round(cost, 6).alias("cost"))


def last_user_message(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    rows = turns.where(F.col(role) == "user")
    return rows.groupBy(conversation).agg(F.max_by(text, turn).alias(text))


def source_line(found: DataFrame, group: str, title: str, court: str, year: str, order: str, most: int = 5) -> DataFrame:
    """The first titles of a group as `title (court, year)` joined by semicolons, with dots if there are more."""
    label = F.format_string("%s (%s, %s)", F.col(title), F.col(court), F.col(year).cast("string"))
    got = found.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), label.alias("label")))).alias("_x"))
    text = F.array_join(F.transform(F.slice("_x", 1, most), lambda s: s["label"]), "; ")
    return got.select(group, F.concat(text, F.when(F.size("_x") > most, F.lit("...")).otherwise(F.lit(""))).alias("sources"))


def context_line(found: DataFrame, group: str, text: str, order: str) -> DataFrame:
    """Contexts of a session joined by `; ` in order; one equal to all said before it adds nothing."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    add = lambda acc, x: F.when((x["t"].isNull()) | (x["t"] == "") | (x["t"] == acc), acc).when(acc == "", x["t"]).otherwise(F.concat(acc, F.lit("; "), x["t"]))
    return found.groupBy(group).agg(F.aggregate(rows, F.lit(""), add).alias("legal_context"))


def citation_edges(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """src, dst, dst_known: citations of documents, targets written as document ids are."""
    edges = docs.select(F.col(key).alias("src"), F.explode(X.cross_refs(F.col(text))).alias("_to"))
    edges = edges.select("src", F.regexp_replace(X.normal_path(F.col("_to")), "^/", "").alias("dst")).distinct()
    known = docs.select(F.col(key).alias("dst"), F.lit(True).alias("_k")).distinct()
    return edges.join(known, "dst", "left").select("src", "dst", F.coalesce("_k", F.lit(False)).alias("dst_known"))


def cited_most(edges: DataFrame, top: int = 100) -> DataFrame:
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("citations")).orderBy(F.desc("citations"), "dst").limit(top)


def sampled(df: DataFrame, order: str | list[str], size: int) -> DataFrame:
    """About `size` rows spread over the whole order (a sampling operator): every n-th one from the first on, n being the rows over `size`, 1 at least."""
    step = max(1, df.count() // max(1, size))
    return numbered(df, [order] if isinstance(order, str) else order, "_i").where(F.col("_i") % step == 0).drop("_i")


def expected_found(expected: DataFrame, found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Expected documents that were found, each once."""
    return expected.select(doc).distinct().join(found.select(doc), doc, "left_semi")


def summary_counters(log: DataFrame, query_key: str = "query_id") -> DataFrame:
    """Summaries, tokens in and out by query."""
    return log.groupBy(query_key).agg(F.count(F.lit(1)).alias("summaries"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))

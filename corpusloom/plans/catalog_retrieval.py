"""Registered retrieval queries over the whole tables: (query, SQL or None) by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import dimensions as D
from corpusloom.operators import fulltext, fusion, postings, rerank, vector, vector_index
from corpusloom.plans import agent, chat, hybrid
from corpusloom.session import table, work_path, written

# ---- shared inputs: vectors whose id is divisible by 50 ask; the benchmark item of a fiftieth of that id is their text


def chunks(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 2).alias("doc_id"), "label", "embedding", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.col("label") % 4 + 1).cast("int")).alias("court_level"))


def asked(spark, d):
    e = table(spark, d, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.floor(F.col("vec_id") / 50).alias("query_id"), F.col("embedding").alias("query_vector"))
    return e.join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "query_id")


def vectors_asked(spark, d):
    return table(spark, d, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def docs(spark, d):
    """Documents with their terms stored, as the document table has them."""
    return written(fulltext.documents_with_terms(table(spark, d, "documents")), "terms")


LEVELS = ["supreme", "appeal", "foreign", "other"]
i = lambda c: F.col(c).cast("int").alias(c)
n = lambda c: F.col(c).cast("long").alias(c)

COSINE = "round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))), 9)"
TOP = f"""top AS (SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id, c.label, {COSINE.format(a="c.embedding", b="q.embedding")} AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE.format(a="c.embedding", b="q.embedding")} DESC, c.vec_id) AS rank
  FROM embeddings c, embeddings q WHERE q.vec_id % 50 = 0))"""
STOP = "[" + ", ".join(f"'{w}'" for w in D.STOP_WORDS) + "]"
TERMS_OF = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND NOT list_contains(" + STOP + ", w))"
TOKENS = "list_filter(list_transform(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: length(w) >= 2), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}./()]', '', 'g')), lambda w: w <> '')"
DOCS = f"docs AS (SELECT doc_id, {TERMS_OF.format('text')} AS terms FROM documents)"
ITEM_TERMS = f"q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS_OF.format('array_to_string(' + TOKENS.format('text') + ', chr(32))')}) AS term FROM benchmark)"
POST = "post AS (SELECT term, doc_id, doc_len, count(*) AS tf FROM (SELECT doc_id, len(terms) AS doc_len, unnest(terms) AS term FROM docs) GROUP BY ALL)"
TF = "tf AS (SELECT query_id, doc_id, round(sum(1 + ln(tf)) / (1 + ln(max(doc_len))), 9) AS score FROM post JOIN q USING (term) GROUP BY ALL)"
RANKED = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {0}"
PHRASE = f"""ph AS (SELECT item_id AS query_id, doc_id FROM benchmark b, docs WHERE len({TERMS_OF.format('b.text')}) > 0
  AND contains(' ' || array_to_string(terms, ' ') || ' ', ' ' || array_to_string({TERMS_OF.format('b.text')}, ' ') || ' '))"""
GATE = "(regexp_matches({0}, '[0-9]') OR regexp_matches({0}, '[.()/]') OR len(regexp_split_to_array({0}, '\\s+')) <= 6)"
MERGED = f"""phr AS (SELECT query_id, doc_id, score FROM ({RANKED.format("(SELECT tf.* FROM tf JOIN ph USING (query_id, doc_id) JOIN benchmark b ON b.item_id = tf.query_id WHERE " + GATE.format("b.text") + ")")}) WHERE rank <= 20),
orr AS (SELECT query_id, doc_id, score FROM ({RANKED.format("tf")}) WHERE rank <= 100),
mer AS (SELECT query_id, doc_id, score FROM phr UNION ALL SELECT query_id, doc_id, score FROM orr ANTI JOIN phr USING (query_id, doc_id)),
txt AS (SELECT * FROM ({RANKED.format("mer")}) WHERE rank <= 100)"""
VEC = f"""vall AS (SELECT c.vec_id, c.label, q.vec_id // 50 AS query_id, {COSINE.format(a="c.embedding", b="q.embedding")} AS score FROM embeddings c, embeddings q JOIN benchmark b ON b.item_id = q.vec_id // 50
  WHERE q.vec_id % 50 = 0 AND {{level}}),
v100 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM vall) WHERE r <= 100),
vdoc AS (SELECT query_id, vec_id // 2 AS doc_id, max(score) AS score FROM v100 GROUP BY ALL),
vkeep AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM vdoc) WHERE score >= greatest(0.42, best * 0.75)),
vec AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vkeep) WHERE rank <= 30)"""
FUSED = """fus AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.doc_id, t.doc_id) AS doc_id, v.rank AS vec_rank, t.rank AS bm25_rank,
  coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0) AS score FROM vec v FULL JOIN txt2 t ON v.query_id = t.query_id AND v.doc_id = t.doc_id)"""
ASKED_TXT = "txt2 AS (SELECT t.* FROM txt t WHERE t.query_id IN (SELECT vec_id // 50 FROM embeddings WHERE vec_id % 50 = 0))"
LEG = ", ".join([DOCS, ITEM_TERMS, POST, TF, PHRASE, MERGED, ASKED_TXT])
RRF_SQL = f"""WITH {LEG}, {VEC}, {FUSED},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST, doc_id) AS rank FROM fus)
SELECT query_id::BIGINT AS query_id, doc_id::BIGINT AS doc_id, vec_rank::INT AS vec_rank, bm25_rank::INT AS bm25_rank, round(score, 9) AS score, rank::INT AS rank FROM r WHERE rank <= 30"""


def vec_topk(s, d):
    e = table(s, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).first()
    return vector.top_k(e, q["embedding"], 100, "vec_id").select("vec_id", "score")


def vec_multi_query_topk(s, d):
    return vector.top_k_batch(table(s, d, "embeddings"), vectors_asked(s, d), 10, "vec_id").select("query_id", "vec_id", "score", i("rank"))


def _grouped(s, d):
    e = table(s, d, "embeddings")
    top = vector.top_k_batch(e, vectors_asked(s, d), 100, "vec_id").join(e.select("vec_id", "label"), "vec_id")
    return vector.best_of_document(top, "label", "vec_id")


def vec_best_per_group(s, d):
    return _grouped(s, d).select("query_id", i("label"), "vec_id", "score", n("chunk_count"))


def vec_adaptive_threshold(s, d):
    return vector.adaptive_threshold(_grouped(s, d)).select("query_id", i("label"), "score")


def vec_score_pct(s, d):
    top = vector.top_k_batch(table(s, d, "embeddings"), vectors_asked(s, d), 10, "vec_id")
    return top.select("query_id", "vec_id", vector.percent(1 - F.col("score")).alias("score_pct"))


def vec_truncate_dims(s, d):
    cut = table(s, d, "embeddings").select("vec_id", vector.truncated(F.col("embedding"), 16).alias("v"))
    return cut.select("vec_id", F.size("v").cast("int").alias("dims"), F.round(vector.norm(F.col("v")), 9).alias("norm"))


def vec_ivf_topk(s, d):
    """A stored index of all vectors, a tenth of them appended."""
    path, rows = work_path(s, "cells"), table(s, d, "embeddings")
    vector_index.build(rows.where("vec_id % 10 <> 3"), path, "vec_id", 16)
    vector_index.append(rows.where("vec_id % 10 = 3"), path, "vec_id")
    return vector_index.search(s, path, vectors_asked(s, d), 10, 4, exact=True).select("query_id", "vec_id", "score", i("rank"))


def vec_members(s, d):
    e = table(s, d, "embeddings")
    found = vector.top_k_batch(e, vectors_asked(s, d), 100, "vec_id").join(e.select("vec_id", "label"), "vec_id")
    got = vector.members_of_document(found, "label", "vec_id", most=5)
    return got.select("query_id", i("label"), "score", n("chunk_count"), F.array_join(F.transform("members", lambda m: m["vec_id"].cast("string")), ",").alias("members"), "members_cut")


def terms_df(s, d):
    return fulltext.term_frequency(docs(s, d)).select("term", n("df"), n("cf"))


def or_match_rank(s, d):
    return fulltext.tf_rank(docs(s, d), items(s, d)).select("query_id", "doc_id", "score", i("rank"))


def bm25_rank(s, d):
    got = fulltext.bm25_rank(docs(s, d), items(s, d))
    return got.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def phrase_match(s, d):
    return fulltext.phrase_match(docs(s, d), items(s, d)).select("query_id", "doc_id")


def stored(s, d):
    """An index of stored postings: nine tenths of the documents, and the others appended."""
    path, rows = work_path(s, "index"), docs(s, d)
    postings.build(rows.where("doc_id % 10 <> 3"), path, buckets=8, spread=2)
    postings.append(rows.where("doc_id % 10 = 3"), path, spread=2)
    return postings.Index(s, path)


def stored_or_rank(s, d):
    return stored(s, d).top(items(s, d)).select("query_id", "doc_id", "score", i("rank"))


def stored_bm25_rank(s, d):
    return stored(s, d).top(items(s, d), scorer="bm25").select("query_id", "doc_id", F.round("score", 6).alias("score"))


def stored_phrase_match(s, d):
    return stored(s, d).phrases(items(s, d)).select("query_id", "doc_id")


def stored_text_leg(s, d):
    return hybrid.text_leg(stored(s, d), items(s, d)).select("query_id", "doc_id", "score", i("rank"))


def phrase_gate(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", fulltext.phrase_gate(F.col("text")).alias("gate"))


def query_tokens(s, d):
    return table(s, d, "benchmark").select("item_id", F.array_join(fulltext.query_tokens(F.col("text")), "|").alias("tokens"))


def phrase_or_merge(s, d):
    return hybrid.text_leg(docs(s, d), items(s, d)).select("query_id", "doc_id", "score", i("rank"))


def _legs(s, d, level=None):
    q = asked(s, d)
    return hybrid.vector_leg(chunks(s, d), q, level=level), hybrid.text_leg(docs(s, d), q)


def rrf_fusion(s, d):
    return fusion.rrf(*_legs(s, d)).select("query_id", "doc_id", i("vec_rank"), i("bm25_rank"), F.round("score", 9).alias("score"), i("rank"))


def rrf_overlap_counts(s, d):
    return fusion.overlap(fusion.rrf(*_legs(s, d), k=1000)).select("query_id", n("both"), n("vector_only"), n("text_only"))


def level_filter_one_leg(s, d):
    return fusion.overlap(fusion.rrf(*_legs(s, d, "supreme"), k=1000)).select("query_id", n("both"), n("vector_only"), n("text_only"))


def hybrid_answer(s, d):
    """Search, bypass and rerank of all questions."""
    q, documents = asked(s, d), table(s, d, "documents")
    found = hybrid.hybrid_search(q, documents.withColumn("court_level", F.lit("other")), chunks(s, d))
    return hybrid.answer(q, documents, found)


def _conversed(s, d):
    documents = table(s, d, "documents").select("doc_id", F.left("text", F.lit(80)).alias("title"), F.col("source").alias("court"), F.lit(None).cast("int").alias("year"), "text")
    return documents, chat.hybrid_searches(documents, stored(s, d))


def chat_sources(s, d):
    """All items as questions: themselves, then what the offline model calls for; each document once a question."""
    documents, search = _conversed(s, d)
    _, sources = chat.converse(items(s, d), documents, search, agent.keyword_model)
    return sources.select("query_id", "doc_id", i("step"), i("rank"), F.round("score", 9).alias("score"))


def chat_events(s, d):
    """The whole run for all items, as the number of events of each kind."""
    documents, search = _conversed(s, d)
    told = chat.answer(items(s, d), documents, search, agent.keyword_model)["events"]
    return told.groupBy("query_id", "event").agg(F.count(F.lit(1)).alias("n"))


def cross_query_dedup(s, d):
    """Five items in a row are one session's searches."""
    found = fulltext.tf_rank(docs(s, d), items(s, d), 20).withColumn("session", F.floor(F.col("query_id") / 5)).withColumn("step", F.col("query_id") % 5)
    return fusion.first_seen(found, "session", "step", "rank", "doc_id").select("session", "step", "doc_id", "score", i("rank"))


def year_filter_kept_unparsable(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.year("o_orderdate").cast("string")).alias("year"))
    return fusion.year_between(o, "year", 1994, 1996, keep_unparsable=True)


# ---- rerank queries: documents with labels; quality is the query, scores and ranks follow from ids and lengths


def judged(s, d):
    x = table(s, d, "labels").select("doc_id", F.col("quality").alias("query_id")).join(table(s, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return x.select(
        "query_id", "doc_id", "n_chars", "lang", ((F.col("n_chars") % 97) / 10.0).alias("rerank_score"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 120 + 1).cast("int").alias("bm25_rank"),
        ((F.col("doc_id") % 1000) / 1000.0).alias("score"), (F.col("n_chars") % 30 + 1990).cast("int").alias("year"),
        F.element_at(F.array(*[F.lit(e) for e in D.ENGAGEMENTS]), (F.col("doc_id") % 4 + 1).cast("int")).alias("engagement"), F.element_at(F.array(*[F.lit(e) for e in D.RELEVANCE_ORDER]), (F.col("n_chars") % 4 + 1).cast("int")).alias("rating"),
    )


JUDGED = """jud AS (SELECT l.quality AS query_id, doc_id, n_chars, lang, (n_chars % 97) / 10.0::DOUBLE AS rerank_score, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 120 + 1 END AS bm25_rank,
  (doc_id % 1000) / 1000.0::DOUBLE AS score, n_chars % 30 + 1990 AS year, ['RULED', 'DISCUSSED', 'MENTIONED', 'NOT_ADDRESSED'][doc_id % 4 + 1] AS engagement, ['HIGH', 'MEDIUM', 'LOW', 'NONE'][n_chars % 4 + 1] AS rating
  FROM labels l JOIN documents USING (doc_id)),
elig AS (SELECT *, rerank_score >= 0.1 OR coalesce(bm25_rank <= 50, false) AS eligible, rerank_score + CASE WHEN bm25_rank <= 50 THEN 2.0::DOUBLE * (1 - bm25_rank / 50.0::DOUBLE) ELSE 0 END AS effective FROM jud),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY effective DESC, score DESC, doc_id) AS place, count(*) FILTER (effective >= 2) OVER (PARTITION BY query_id) AS strong FROM elig WHERE eligible)"""


def _cut(s, d):
    return rerank.cutoff(rerank.keep_flags(judged(s, d)).where("eligible"), "query_id", "doc_id")


def keyword_boost_sort(s, d):
    return _cut(s, d).select(i("query_id"), "doc_id", F.round("effective", 9).alias("effective"), i("place"))


def smart_cutoff(s, d):
    return _cut(s, d).where("kept").select(i("query_id"), "doc_id", i("place"))


def rerank_keep_flags(s, d):
    return rerank.keep_flags(judged(s, d)).select(i("query_id"), "doc_id", "eligible")


def rescue_merge_max(s, d):
    j = judged(s, d)
    first = j.select("query_id", "doc_id", F.col("rerank_score").alias("score"))
    second = j.where(F.col("rerank_score") < rerank.RESCUE_BELOW).select("query_id", "doc_id", ((F.col("doc_id") % 50) / 10.0).alias("score"))
    return rerank.merged(first, second, ["query_id", "doc_id"]).select(i("query_id"), "doc_id", "score")


def relevance_rules(s, d):
    j = judged(s, d).withColumn("ruled", rerank.relevance_rule(F.col("engagement"), F.col("rating")))
    return j.groupBy("engagement", "rating", "ruled").agg(F.count(F.lit(1)).alias("n"))


def display_sort(s, d):
    j = judged(s, d)
    got = rerank.display(j.select("query_id", "doc_id", "year"), j.select("query_id", "doc_id", "rating"))
    return got.select(i("query_id"), "doc_id", "rating", i("year"), i("place"))


def level_relevance_format(s, d):
    """The first ten of a query in full, the others as one line."""
    level = F.create_map(*[F.lit(x) for x in ("en", "supreme", "de", "appeal", "fr", "foreign", "es", "other")])[F.col("lang")]
    j = judged(s, d).select("query_id", "doc_id", "year", F.col("rating").alias("relevance"), level.alias("court_level"), "lang", "engagement")
    j = j.withColumn("place", F.row_number().over(rerank.summary_order("query_id")))
    line = rerank.brief_line(F.col("relevance"), F.col("lang"), F.col("year"), F.col("doc_id"), F.col("engagement"))
    return j.select(i("query_id"), "doc_id", i("place"), F.when(F.col("place") > 10, line).alias("brief"))


CATALOG = {
    "vec_topk": (vec_topk, f"WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, {COSINE.format(a='embedding', b='e')} AS score FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 100"),
    "vec_multi_query_topk": (vec_multi_query_topk, f"WITH {TOP} SELECT query_id, vec_id, score, rank::INT AS rank FROM top WHERE rank <= 10"),
    "vec_best_per_group": (vec_best_per_group, f"WITH {TOP} SELECT query_id, label::INT AS label, arg_min(vec_id, rank) AS vec_id, max(score) AS score, count(*) AS chunk_count FROM top WHERE rank <= 100 GROUP BY query_id, label"),
    "vec_adaptive_threshold": (vec_adaptive_threshold, f"WITH {TOP}, g AS (SELECT query_id, label::INT AS label, max(score) AS score FROM top WHERE rank <= 100 GROUP BY ALL) SELECT query_id, label, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM g) WHERE score >= greatest(0.42, best * 0.75)"),
    "vec_score_pct": (vec_score_pct, f"WITH {TOP} SELECT query_id, vec_id, round(greatest(0, (1 - (1 - score)) * 100), 1) AS score_pct FROM top WHERE rank <= 10"),
    "vec_truncate_dims": (vec_truncate_dims, "SELECT vec_id, 16::INT AS dims, round(sqrt(list_dot_product(embedding[1:16]::DOUBLE[], embedding[1:16]::DOUBLE[])), 9) AS norm FROM embeddings"),
    "vec_ivf_topk": (vec_ivf_topk, f"WITH {TOP} SELECT query_id, vec_id, score, rank::INT AS rank FROM top WHERE rank <= 10"),
    "vec_members": (vec_members, f"WITH {TOP} SELECT query_id, label::INT AS label, max(score) AS score, count(*) AS chunk_count, array_to_string(list(vec_id ORDER BY rank)[1:5], ',') AS members, count(*) > 5 AS members_cut FROM top WHERE rank <= 100 GROUP BY query_id, label"),
    "terms_df": (terms_df, f"WITH {DOCS}, {POST} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term"),
    "or_match_rank": (or_match_rank, f"WITH {DOCS}, {ITEM_TERMS}, {POST}, {TF} SELECT query_id, doc_id, score, rank::INT AS rank FROM ({RANKED.format('tf')}) WHERE rank <= 100"),
    "bm25_rank": (
        bm25_rank,
        f"""WITH {DOCS}, {ITEM_TERMS}, {POST}, st AS (SELECT count(*)::DOUBLE AS n, avg(len(terms))::DOUBLE AS av FROM docs), m AS (SELECT * FROM post JOIN q USING (term)),
        df AS (SELECT term, count(DISTINCT doc_id)::DOUBLE AS df FROM m GROUP BY term),
        sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / av))), 9) AS score FROM m JOIN df USING (term), st GROUP BY ALL)
        SELECT query_id, doc_id, round(score, 6) AS score FROM ({RANKED.format('sc')}) WHERE rank <= 100""",
    ),
    "phrase_match": (phrase_match, f"WITH {DOCS}, {PHRASE} SELECT query_id, doc_id FROM ph"),
    **{name: (query, None) for name, query in (("stored_or_rank", stored_or_rank), ("stored_bm25_rank", stored_bm25_rank), ("stored_phrase_match", stored_phrase_match), ("stored_text_leg", stored_text_leg))},
    "phrase_gate": (phrase_gate, f"SELECT conv_id, turn, {GATE.format('text')} AS gate FROM conversations"),
    "query_tokens": (query_tokens, f"SELECT item_id, array_to_string({TOKENS.format('text')}, '|') AS tokens FROM benchmark"),
    "phrase_or_merge": (phrase_or_merge, f"WITH {LEG} SELECT query_id, doc_id, score, rank::INT AS rank FROM txt"),
    "rrf_fusion": (rrf_fusion, RRF_SQL.replace("{level}", "true")),
    "rrf_overlap_counts": (rrf_overlap_counts, f"WITH {LEG}, {VEC.replace('{level}', 'true')}, {FUSED} SELECT query_id::BIGINT AS query_id, count(*) FILTER (vec_rank IS NOT NULL AND bm25_rank IS NOT NULL) AS both, count(*) FILTER (bm25_rank IS NULL) AS vector_only, count(*) FILTER (vec_rank IS NULL) AS text_only FROM fus GROUP BY query_id"),
    "level_filter_one_leg": (level_filter_one_leg, f"WITH {LEG}, {VEC.replace('{level}', 'c.label % 4 = 0')}, {FUSED} SELECT query_id::BIGINT AS query_id, count(*) FILTER (vec_rank IS NOT NULL AND bm25_rank IS NOT NULL) AS both, count(*) FILTER (bm25_rank IS NULL) AS vector_only, count(*) FILTER (vec_rank IS NULL) AS text_only FROM fus GROUP BY query_id"),
    "hybrid_answer": (hybrid_answer, None),
    "cross_query_dedup": (cross_query_dedup, f"WITH {DOCS}, {ITEM_TERMS}, {POST}, {TF}, f AS (SELECT * FROM ({RANKED.format('tf')}) WHERE rank <= 20) SELECT session, step, doc_id, score, rank::INT AS rank FROM (SELECT query_id // 5 AS session, query_id % 5 AS step, doc_id, score, rank, row_number() OVER (PARTITION BY query_id // 5, doc_id ORDER BY query_id % 5, rank) AS r FROM f) WHERE r = 1"),
    "year_filter_kept_unparsable": (year_filter_kept_unparsable, "SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE year(o_orderdate)::VARCHAR END AS year FROM orders) WHERE try_cast(year AS INT) IS NULL OR try_cast(year AS INT) BETWEEN 1994 AND 1996"),
    "keyword_boost_sort": (keyword_boost_sort, f"WITH {JUDGED} SELECT query_id::INT AS query_id, doc_id, round(effective, 9) AS effective, place::INT AS place FROM cut"),
    "smart_cutoff": (smart_cutoff, f"WITH {JUDGED} SELECT query_id::INT AS query_id, doc_id, place::INT AS place FROM cut WHERE place <= least(75, greatest(30, strong))"),
    "rerank_keep_flags": (rerank_keep_flags, f"WITH {JUDGED} SELECT query_id::INT AS query_id, doc_id, eligible FROM elig"),
    "rescue_merge_max": (rescue_merge_max, f"WITH {JUDGED} SELECT query_id::INT AS query_id, doc_id, greatest(rerank_score, CASE WHEN rerank_score < 1 THEN (doc_id % 50) / 10.0::DOUBLE ELSE 0 END) AS score FROM jud"),
    "relevance_rules": (relevance_rules, f"WITH {JUDGED} SELECT engagement, rating, CASE WHEN engagement = 'NOT_ADDRESSED' AND rating IN ('HIGH', 'MEDIUM') THEN 'LOW' WHEN engagement = 'MENTIONED' AND rating = 'HIGH' THEN 'MEDIUM' ELSE rating END AS ruled, count(*) AS n FROM jud GROUP BY ALL"),
    "display_sort": (display_sort, f"WITH {JUDGED} SELECT query_id::INT AS query_id, doc_id, rating, year::INT AS year, row_number() OVER (PARTITION BY query_id ORDER BY CASE rating WHEN 'HIGH' THEN 0 ELSE 1 END, year DESC, doc_id)::INT AS place FROM jud WHERE rating IN ('HIGH', 'MEDIUM')"),
    "level_relevance_format": (
        level_relevance_format,
        f"""WITH {JUDGED}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 5 ELSE 4 END, CASE rating WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END, year DESC, doc_id) AS place FROM jud)
        SELECT query_id::INT AS query_id, doc_id, place::INT AS place, CASE WHEN place > 10 THEN '- [' || rating || '] ' || lang || ', ' || year || ' — Document ID: ' || doc_id || ' — ' || engagement END AS brief FROM p""",
    ),
}
#: Stored postings give the rows that a scan of all documents gives.
SAME = {"stored_or_rank": "or_match_rank", "stored_bm25_rank": "bm25_rank", "stored_phrase_match": "phrase_match", "stored_text_leg": "phrase_or_merge"}
CATALOG |= {name: (CATALOG[name][0], CATALOG[other][1]) for name, other in SAME.items()}
#: Questions as the offline model asks them: the item, and its four longest words.
ASKS = """words AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w) AS r FROM (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(trim(text)), '\\s+')) AS w FROM benchmark) WHERE w <> ''),
asks AS (SELECT item_id * 2 AS item_id, text FROM benchmark WHERE length(trim(text)) > 2 UNION ALL SELECT item_id * 2 + 1, string_agg(w, ' ' ORDER BY r) FROM words WHERE r <= 4 GROUP BY item_id)"""
CHAT = f"""WITH {ASKS}, {", ".join([DOCS, ITEM_TERMS, POST, TF, PHRASE, MERGED]).replace("benchmark", "asks")},
top AS (SELECT query_id // 2 AS query_id, query_id % 2 AS step, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS rank, rank AS text_rank FROM txt),
best AS (SELECT * FROM top WHERE rank <= 30)
SELECT query_id::BIGINT AS query_id, doc_id, step::INT AS step, rank::INT AS rank, round(1.0::DOUBLE / (60 + text_rank), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY step, rank) AS r FROM best) WHERE r = 1"""
CATALOG |= {"chat_sources": (chat_sources, CHAT), "chat_events": (chat_events, None)}

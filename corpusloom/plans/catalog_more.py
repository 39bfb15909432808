"""Registered queries of path, link, log and job rules over the whole tables: (query, SQL) by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import dimensions as D
from corpusloom.functions import text as X
from corpusloom.operators import fusion, stats, vector
from corpusloom.plans import api, embedding_jobs
from corpusloom.plans.catalog_retrieval import TOP, vectors_asked
from corpusloom.plans.catalog_text import DECISIONS, PATH, decisions, path_of
from corpusloom.session import table, work_path
from corpusloom.sources import files, markdown_tree, sinks

n = lambda c: F.col(c).cast("long").alias(c)


def cases(k, *values):
    """The value at k modulo their number."""
    return F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def texts(name, at):
    """A text column as its own string: what a rule makes of values derived from ids."""
    return F.concat(F.lit(name), at.cast("string"))


# ---- filters and paths


def legacy_filter(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("court"), F.year("o_orderdate").cast("string").alias("year"))
    return fusion.legacy_filter(o, "F", "1996", "1997").select("o_orderkey", "year")


def court_variants(s, d):
    p = path_of()
    return table(s, d, "documents").select("doc_id", X.court_extractor(p).alias("extractor"), X.court_crawler(F.concat(F.lit("/"), p)).alias("crawler"), X.court_summary(F.concat(cases(F.col("doc_id"), "apofaseis/", ""), p)).alias("summary"), X.year_crawler(p).alias("year"))


def chain(rules, test, otherwise):
    return "CASE " + " ".join(f"WHEN {test.format(p=PATH, k=k)} THEN '{v}'" for k, v in rules) + f" ELSE {otherwise} END"


FIRST = f"coalesce(list_filter(string_split({PATH}, '/'), lambda p: p <> '')[1], 'unknown')"
VARIANTS = f"""SELECT doc_id, {chain(D.EXTRACTOR_COURT, "contains({p}, '{k}')", FIRST)} AS extractor, {chain(D.PATH_PREFIX_COURT, "starts_with('/' || {p}, '{k}')", "'unknown'")} AS crawler,
  split_part({PATH}, '/', 1) AS summary, regexp_extract({PATH}, '/(\\d{{4}})/', 1) AS year FROM documents"""


def path_rules(s, d):
    k = F.col("doc_id")
    p = F.concat(cases(k, "/aad/", "/x/../", "y/", "/cgi-bin/open.pl?file=/z/"), k.cast("string"), cases(k, ".md", "", ".html"))
    rows = table(s, d, "documents").select("doc_id", p.alias("p"))
    c = F.col("p")
    return rows.select("doc_id", X.normal_path(c).alias("normal"), X.safe_path(c).alias("safe"), X.with_md(c).alias("md"), X.href_to_md(c).alias("target"), X.is_case_link(c).alias("case_link"))


PATH_RULES = """SELECT doc_id, CASE WHEN starts_with(p, '/aad/') THEN '/apofaseis' || p ELSE p END AS normal, NOT contains(p, '..') AND NOT starts_with(p, '/') AS safe, CASE WHEN ends_with(p, '.md') THEN p ELSE p || '.md' END AS md,
  CASE WHEN contains(p, 'file=') THEN CASE WHEN ends_with(p, '.md') OR ends_with(p, '.html') THEN regexp_replace(split_part(p, 'file=', 2), '\\.(md|html)$', '') ELSE split_part(p, 'file=', 2) END || '.md' END AS target, contains(p, 'open.pl') AS case_link
FROM (SELECT doc_id, ['/aad/', '/x/../', 'y/', '/cgi-bin/open.pl?file=/z/'][doc_id % 4 + 1] || doc_id || ['.md', '', '.html'][doc_id % 3 + 1] AS p FROM documents)"""


def link_rules(s, d):
    k = F.col("page_id")
    href = F.concat(cases(k, "/doc?doc_id=a%2F", "/b/", "c/", "http://d/", "/e/index_", "/2001/index.html?"), k.cast("string"), cases(k, ".md", ".md", ".html", ".md", ".html"))
    rows = table(s, d, "pages").select("page_id", href.alias("h"))
    return rows.select("page_id", X.link_target(F.col("h")).alias("target"), X.is_year_index(F.col("h")).alias("year_index"))


LINK_RULES = """SELECT page_id, CASE WHEN starts_with(h, '/doc?doc_id=') THEN replace(substr(h, 13), '%2F', '/') WHEN ends_with(h, '.md') AND starts_with(h, '/') THEN substr(h, 2) WHEN ends_with(h, '.md') AND NOT starts_with(h, 'http') THEN h END AS target,
  regexp_matches(h, 'index_\\w*\\d+\\.html') OR regexp_matches(h, '/\\d{4}/index\\.html') AS year_index
FROM (SELECT page_id, ['/doc?doc_id=a%2F', '/b/', 'c/', 'http://d/', '/e/index_', '/2001/index.html?'][page_id % 6 + 1] || page_id || ['.md', '.md', '.html', '.md', '.html'][page_id % 5 + 1] AS h FROM pages)"""


# ---- texts


def decision_lines(s, d):
    t = F.col("text")
    return decisions(s, d).select("doc_id", X.subject(t).alias("subject"), X.title_viewer(t).alias("viewer"), X.is_greek(t).alias("greek"))


SPACE = "' ' || chr(9) || chr(10) || chr(13)"
LINES = f"""SELECT doc_id, trim(regexp_extract(text, 'Subject:\\s*([^\\n]+?)(?:\\n|$)', 1), {SPACE})[1:200] AS subject, trim(regexp_replace(split_part(text, chr(10), 1), '^#+\\s*', ''), {SPACE})[1:200] AS viewer,
  regexp_matches(text, '[\\x{{370}}-\\x{{3ff}}]') AS greek FROM {DECISIONS}"""


def ratings_of_text(s, d):
    k = F.col("doc_id")
    said = F.concat(cases(k, "The court RULED on it. ", "It was NOT ADDRESSED. ", "Only MENTIONED, not DISCUSSED. ", ""), cases(k, "Relevance rating: HIGH", "RELEVANCE RATING is LOW, not HIGHER", "relevance rating NONE", "HIGH", "RELEVANCE RATING\nMEDIUM or LOW"))
    return table(s, d, "documents").select("doc_id", X.relevance_of_text(said).alias("rating"), X.engagement_of_text(said).alias("engagement"))


def id_prefixes(s, d):
    whole = F.concat(cases(F.col("doc_id"), "a", "a::b", "x"), F.when(F.col("doc_id") % 3 < 2, F.concat(F.lit("::"), F.col("doc_id").cast("string"))).otherwise(F.lit("")))
    return table(s, d, "documents").select("doc_id", X.vector_id_prefix(whole).alias("prefix"))


def reset_times(s, d):
    k = F.col("event_id")
    said = F.concat(F.when(k % 3 != 0, F.concat((k % 7).cast("string"), F.lit("m"))).otherwise(F.lit("")), F.when(k % 5 != 0, F.concat((k % 60).cast("string"), F.lit(".5s"))).otherwise(F.lit("")))
    return table(s, d, "events").select("event_id", X.reset_seconds(said).alias("seconds"))


def error_messages(s, d):
    said = cases(F.col("event_id"), "maximum context length is", "status 429", "ETIMEDOUT", "401 bad", "other")
    return table(s, d, "events").groupBy(X.api_error(said).alias("told")).agg(F.count(F.lit(1)).alias("n"))


# ---- vectors, statistics, logs


def unit_vectors(s, d):
    v = vector.normalized(F.transform("embedding", lambda x: x * 3))
    return table(s, d, "embeddings").select("vec_id", F.round(F.element_at(v, 1), 6).alias("first"), F.round(vector.norm(v), 9).alias("norm"))


def best_of_prefix(s, d):
    e = table(s, d, "embeddings")
    found = vector.top_k_batch(e, vectors_asked(s, d), 100, "vec_id").join(e.select("vec_id", F.concat(F.lit("c"), "label", F.lit("::"), "vec_id").alias("id")), "vec_id")
    return vector.best_of_prefix(found, "id", top=5).select("query_id", "prefix", "id", "score", F.col("place").cast("int").alias("place"))


def sampled_rows(s, d):
    return stats.sampled(table(s, d, "documents").select("doc_id"), "doc_id", 37)


def expected_found(s, d):
    return stats.expected_found(table(s, d, "benchmark").select(F.col("item_id").alias("doc_id")), table(s, d, "labels").where("quality = 1"))


def summary_counters(s, d):
    log = table(s, d, "conversations").select(F.col("conv_id").alias("query_id"), F.char_length("text").alias("tokens_in"), F.col("turn").alias("tokens_out"))
    return stats.summary_counters(log).select("query_id", n("summaries"), n("tokens_in"), n("tokens_out"))


def context_lines(s, d):
    return stats.context_line(table(s, d, "conversations"), "conv_id", "role", "turn")


def download_stats(s, d):
    got = table(s, d, "pages").select(cases(F.col("page_id"), "ok", "fail", "cached").alias("status"), F.octet_length("html").alias("bytes"))
    return sinks.download_stats(got).select("status", n("n"), n("bytes"))


def checked_turns(s, d):
    known = next(iter(D.PRICING))
    turns = table(s, d, "conversations").withColumn("model", F.when(F.col("conv_id") % 5 == 0, F.lit("none such")).otherwise(F.lit(known))).withColumn("role", F.when(F.col("turn") % 7 == 6, F.lit("critic")).otherwise(F.col("role")))
    checked = api.validated(turns.withColumn("text", F.when(F.col("conv_id") % 3 == 0, F.lit(" ")).otherwise(F.col("text"))))
    return checked.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


CHECKED = f"""SELECT error, count(*) AS n FROM (SELECT CASE WHEN conv_id % 5 = 0 THEN 'unknown model: none such; known: {", ".join(D.PRICING)}' WHEN turn % 7 = 6 THEN 'unknown role: critic' WHEN role NOT IN ('system', 'user', 'assistant', 'tool') THEN 'unknown role: ' || role
  WHEN conv_id % 3 = 0 OR trim(text) = '' THEN 'empty message' END AS error FROM conversations) GROUP BY error"""


def batch_steps(s, d):
    """Orders as batch jobs: what step each is due for."""
    k = F.col("o_orderkey")
    status = cases(k, F.lit(None).cast("string"), "submitted", "completed", "failed", "expired", "completed", "in_progress")
    jobs = table(s, d, "orders").select(k.alias("batch"), F.when(k % 7 != 0, texts("j", k)).alias("job"), status.alias("status"), F.when(k % 7 == 5, texts("f", k)).when((k % 7 == 2) & (k % 2 == 0), texts("f", k)).alias("output_file_id"), (k % 3 == 0).alias("collected"))
    steps = {"submit": embedding_jobs.to_submit, "wait": embedding_jobs.running, "broken": embedding_jobs.broken, "collect": embedding_jobs.to_collect}
    out = None
    for name, rule in steps.items():
        rows = rule(jobs).agg(F.count(F.lit(1)).alias("n"), F.sum("batch").alias("total")).select(F.lit(name).alias("step"), "n", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


BATCHES = """WITH j AS (SELECT o_orderkey AS batch, [NULL, 'submitted', 'completed', 'failed', 'expired', 'completed', 'in_progress'][o_orderkey % 7 + 1] AS status, o_orderkey % 7 = 5 OR (o_orderkey % 7 = 2 AND o_orderkey % 2 = 0) AS output, o_orderkey % 3 = 0 AS collected FROM orders)
SELECT 'submit' AS step, count(*) AS n, sum(batch)::BIGINT AS total FROM j WHERE status IS NULL OR status IN ('failed', 'expired') UNION ALL SELECT 'wait', count(*), sum(batch)::BIGINT FROM j WHERE status IN ('submitted', 'in_progress')
UNION ALL SELECT 'broken', count(*), sum(batch)::BIGINT FROM j WHERE status IN ('failed', 'expired') UNION ALL SELECT 'collect', count(*), sum(batch)::BIGINT FROM j WHERE status = 'completed' AND output AND NOT collected"""


# ---- files that mirror paths, done sets, excerpts


def markdown_tree_files(s, d):
    """Every text as a file at its document's path, read back from the files."""
    root = work_path(s, "markdown-files")
    docs = table(s, d, "documents").select(F.coalesce(path_of(), F.concat(F.lit("unknown/"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("doc_id"), "text")
    told = markdown_tree.write(docs, root)
    read = files.markdown_corpus(s, root).select(F.col("doc_id").alias("file"), F.md5("text").alias("md5"))
    return told.join(read, "file", "left").select("file", "status", "n_chars", "n_words", "n_refs", "md5")


STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
WORDS = r"len(list_filter(regexp_split_to_array(regexp_replace(text, '[#*_\[\]()|>-]', ' ', 'g'), '\s+'), lambda w: w <> ''))"
TREE = rf"""SELECT file, CASE WHEN short THEN 'fail' ELSE 'written' END AS status, n_chars, n_words, n_refs, CASE WHEN NOT short THEN md5(text) END AS md5
FROM (SELECT coalesce({PATH}, 'unknown/' || doc_id || '.md') AS file, text, text IS NULL OR length({STRIPPED}) < 10 AS short, length(text)::BIGINT AS n_chars, {WORDS} AS n_words, len(regexp_extract_all(text, '\]\([^)]*\.md\)'))::BIGINT AS n_refs FROM documents)"""


def done_union(s, d):
    """Customers that neither urgent orders, nor finished ones, nor a negative balance have as done."""
    orders, customers = table(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(s, d, "customer")
    done = sinks.done_set(orders.where("o_orderpriority = '1-URGENT'"), orders.where("o_orderstatus = 'F'"), customers.where("c_acctbal < 0"), keys=["c_custkey"])
    return sinks.resume(customers.select("c_custkey"), done, ["c_custkey"])


def excerpts(s, d):
    t = F.col("text")
    preview = X.findings_preview(cases(F.col("doc_id"), "RULED", "NOT_ADDRESSED", "DISCUSSED"), t)
    return table(s, d, "documents").select("doc_id", X.excerpt(t, 400).alias("source"), F.md5(X.excerpt(t, 4000)).alias("stored"), X.excerpt(t, 120).alias("core"), preview.alias("findings"))


EXCERPTS = """SELECT doc_id, left(text, 400) AS source, md5(left(text, 4000)) AS stored, left(text, 120) AS core,
  CASE WHEN doc_id % 3 = 1 OR text IS NULL THEN '' WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS findings FROM documents"""


CATALOG = {
    "markdown_tree": (markdown_tree_files, TREE),
    "done_union": (
        done_union,
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    ),
    "excerpts": (excerpts, EXCERPTS),
    "legacy_filter": (legacy_filter, "SELECT o_orderkey, year(o_orderdate)::VARCHAR AS year FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) BETWEEN 1996 AND 1997"),
    "court_variants": (court_variants, VARIANTS),
    "path_rules": (path_rules, PATH_RULES),
    "link_rules": (link_rules, LINK_RULES),
    "decision_lines": (decision_lines, LINES),
    "ratings_of_text": (
        ratings_of_text,
        "SELECT doc_id, ['HIGH', 'LOW', 'NONE', 'UNKNOWN', 'MEDIUM'][doc_id % 5 + 1] AS rating, ['RULED', 'NOT_ADDRESSED', 'DISCUSSED', 'UNKNOWN'][doc_id % 4 + 1] AS engagement FROM documents",
    ),
    "id_prefixes": (id_prefixes, "SELECT doc_id, ['a', 'a::b', 'x'][doc_id % 3 + 1] AS prefix FROM documents"),
    "reset_times": (reset_times, "SELECT event_id, (CASE WHEN event_id % 3 <> 0 THEN event_id % 7 * 60 ELSE 0 END + CASE WHEN event_id % 5 <> 0 THEN event_id % 60 + 0.5 ELSE 0 END)::DOUBLE AS seconds FROM events"),
    "error_messages": (
        error_messages,
        """SELECT ['The search returned too many documents. Try a more specific query.', 'The AI service is temporarily overloaded. Please wait and try again.', 'The request timed out. Please try again.', 'API authentication error.',
        'An error occurred while processing your request. Please try again.'][event_id % 5 + 1] AS told, count(*) AS n FROM events GROUP BY ALL""",
    ),
    "unit_vectors": (unit_vectors, "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, 1.0::DOUBLE AS norm FROM embeddings"),
    "best_of_prefix": (
        best_of_prefix,
        f"""WITH {TOP}, b AS (SELECT query_id, 'c' || label AS prefix, max(score) AS score, arg_min('c' || label || '::' || vec_id, struct_pack(a := -score, b := 'c' || label || '::' || vec_id)) AS id FROM top WHERE rank <= 100 GROUP BY query_id, label)
        SELECT * FROM (SELECT query_id, prefix, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prefix)::INT AS place FROM b) WHERE place <= 5""",
    ),
    "sampled_rows": (sampled_rows, "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) WHERE i % greatest(1, n // 37) = 0"),
    "expected_found": (expected_found, "SELECT DISTINCT item_id AS doc_id FROM benchmark WHERE item_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "summary_counters": (summary_counters, "SELECT conv_id AS query_id, count(*) AS summaries, sum(length(text))::BIGINT AS tokens_in, sum(turn)::BIGINT AS tokens_out FROM conversations GROUP BY conv_id"),
    "context_lines": (context_lines, "SELECT conv_id, list_reduce(list(role ORDER BY turn), lambda a, x: CASE WHEN x = a THEN a ELSE a || '; ' || x END) AS legal_context FROM conversations GROUP BY conv_id"),
    "download_stats": (download_stats, "SELECT ['ok', 'fail', 'cached'][page_id % 3 + 1] AS status, count(*) AS n, sum(octet_length(encode(html)))::BIGINT AS bytes FROM pages GROUP BY ALL"),
    "checked_turns": (checked_turns, CHECKED),
    "batch_steps": (batch_steps, BATCHES),
}

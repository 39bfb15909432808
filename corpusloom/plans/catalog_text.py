"""Registered text and HTML queries over the whole tables: (query, SQL or None) by name. Long texts are returned as MD5 and length."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import dimensions as D
from corpusloom.functions import text as X
from corpusloom.operators import chunker, html_markdown
from corpusloom.session import table



def digest(c):
    return [F.md5(c).alias("md5"), F.char_length(c).cast("long").alias("n")]


def path_of(lang="lang", source="source"):
    """A document's place in a court tree, made of its columns."""
    court = F.create_map(*[F.lit(x) for x in ("en", "supreme", "de", "apofaseised/oik", "fr", "courtOfAppeal", "es", "jsc")])[F.col(lang)]
    return F.concat(court, F.lit("/"), (F.col("n_chars") % 60 + 1960).cast("string"), F.lit("/"), F.col(source), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


PATH = "CASE lang WHEN 'en' THEN 'supreme' WHEN 'de' THEN 'apofaseised/oik' WHEN 'fr' THEN 'courtOfAppeal' WHEN 'es' THEN 'jsc' END || '/' || (n_chars % 60 + 1960) || '/' || source || '/' || doc_id || '.md'"


def decisions(s, d):
    """Documents whose texts have, by their ids, what decisions have: a subject, a heading, links within links, a marker."""
    k, say = F.col("doc_id"), lambda test, *parts: F.when(test, F.concat(*parts)).otherwise(F.lit(""))
    number = lambda m: (k % m).cast("string")
    links = F.concat(F.lit("[see [*earlier* case](/apofaseis/"), number(97), F.lit(".md)](x/"), number(7), F.lit(".md) [again](x/"), number(7), F.lit(".md)\n"))
    marker = F.when(k % 4 == 1, F.lit(D.LEGAL_ANALYSIS + ":  ")).when(k % 4 == 2, F.lit(D.DECISION + ": ")).otherwise(F.lit(""))
    head = F.concat(say(k % 2 == 0, F.lit("Subject: matter of "), "source", F.lit("\n")), say(k % 3 == 0, F.lit("# **Case** "), k.cast("string"), F.lit("\n")), say(k % 5 != 0, links))
    return table(s, d, "documents").withColumn("text", F.concat(head, marker, "text"))


DECISIONS = f"""(SELECT * REPLACE (CASE WHEN doc_id % 2 = 0 THEN 'Subject: matter of ' || source || chr(10) ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '# **Case** ' || doc_id || chr(10) ELSE '' END
  || CASE WHEN doc_id % 5 <> 0 THEN '[see [*earlier* case](/apofaseis/' || (doc_id % 97) || '.md)](x/' || (doc_id % 7) || '.md) [again](x/' || (doc_id % 7) || '.md)' || chr(10) ELSE '' END
  || CASE doc_id % 4 WHEN 1 THEN '{D.LEGAL_ANALYSIS}:  ' WHEN 2 THEN '{D.DECISION}: ' ELSE '' END || text AS text) FROM documents)"""


def doc_min_length(s, d):
    return table(s, d, "documents").where(X.long_enough(F.col("text"))).select("doc_id")


def clean_chunk_text(s, d):
    return decisions(s, d).select("doc_id", *digest(X.clean_noise(F.col("text"))))


UNLINKED = "translate(text, '*#', '')"
for _ in range(4):
    UNLINKED = rf"regexp_replace({UNLINKED}, '\[([^\]]*)\]\([^)]*\)', '\1', 'g')"
CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(" + UNLINKED + r", '[\x{80}-\x{9f}]', '', 'g'), chr(160) || chr(8209) || chr(173) || chr(856), ' -'), '(?m)^[-_]{3,}$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def title_extract(s, d):
    return decisions(s, d).select("doc_id", X.title(F.col("text")).alias("title"))


LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '' AND NOT starts_with(x, '---'))"
HEADS = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: starts_with(x, '# ') AND trim(x[3:]) <> '')"
TITLE = f"trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(translate(coalesce(trim(({HEADS})[1][3:]), ({LINES})[1][1:200], ''), '*#', ''), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[\\x{{80}}-\\x{{9f}}]', '-', 'g'), chr(8209), '-'), '-{{2,}}', '-', 'g'), '\\s+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")


def cross_refs(s, d):
    return decisions(s, d).select("doc_id", F.array_join(X.cross_refs(F.col("text")), " ").alias("refs"), X.count_refs(F.col("text")).cast("long").alias("n"))


def word_counts(s, d):
    return table(s, d, "documents").select("doc_id", X.word_count(F.col("text")).cast("long").alias("words"))


def rerank_preview(s, d):
    return decisions(s, d).select("doc_id", *digest(X.rerank_preview(F.col("text"))))


def after(marker, otherwise, take):
    at = f"instr(text, '{marker}')"
    return f"CASE WHEN {at} > 0 THEN {take.format(f'substr(text, {at} + {len(marker)})')} ELSE {otherwise} END"


FIRST = "regexp_replace({0}, '^[:\\s*]+', '')[1:2000]"
SUBJECT = "regexp_extract(text, 'Subject:\\s*([^\\n\\r]+)', 1)"
PREVIEW = (
    f"text[1:500] || CASE WHEN {SUBJECT} <> '' THEN '[SUBJECT: ' || trim({SUBJECT}) || ']' ELSE '' END || chr(10) || '[...]' || chr(10) || " + after(D.LEGAL_ANALYSIS, after(D.DECISION, "text[1:2000]", FIRST), FIRST)
    + " || CASE WHEN greatest(0, length(text) - 1700) > 500 THEN chr(10) || '[...middle omitted...]' || chr(10) || substr(text, length(text) - 1699, 1500) ELSE '' END"
)


def decision_extract(s, d):
    return decisions(s, d).select("doc_id", *digest(X.decision_text(F.col("text"), 1000)))


STRIPPED = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
DECIDED = "CASE WHEN instr(text, chr(10)) > 1 THEN trim(split_part(text, chr(10), 1)) || chr(10) || chr(10) ELSE '' END || " + after(D.LEGAL_ANALYSIS, after(D.DECISION + ":", "text", STRIPPED), STRIPPED)


def vector_ids(s, d):
    return table(s, d, "documents").select("doc_id", X.vector_id(F.concat(path_of(), F.left(F.col("text"), F.lit(24))), F.col("doc_id") % 7).alias("vector_id"))


def chunk_header(s, d):
    p = path_of()
    rows = decisions(s, d).select("doc_id", X.chunk_header(X.court(p), X.jurisdiction(F.lit(""), p), X.year_text(p), X.title(F.col("text"))).alias("header"))
    return rows


def court_metadata(s, d):
    p = path_of()
    rows = table(s, d, "documents").select("doc_id", X.court(p).alias("court"), X.year_int(X.year_text(p)).alias("year"), p.alias("_p"))
    return rows.select("doc_id", "court", "year", X.court_level(F.col("court")).alias("court_level"), X.subcourt(F.col("_p"), F.col("court")).alias("subcourt"))


def chunk_documents(s, d):
    return chunker.chunk_documents(table(s, d, "documents").select(path_of().alias("doc_id"), "text"))


def document_records(s, d):
    return chunker.document_records(table(s, d, "documents").select(path_of().alias("doc_id"), "text")).select("doc_id", *digest(F.col("content")))


def year_part():
    """Ends of addresses with a year as a folder, before a number, a volume's number, or none."""
    k = F.col("page_id")
    year = (k % 60 + 1960).cast("string")
    return F.when(k % 4 == 0, F.concat(F.lit("/"), year, F.lit("/"))).when(k % 4 == 1, F.concat(F.lit("/"), year, F.lit("_2.html"))).when(k % 4 == 2, F.concat(F.lit("/index_"), (k % 9).cast("string"), F.lit(".html"))).otherwise(F.lit(""))


def year_from_path(s, d):
    rows = table(s, d, "pages").withColumn("url", F.concat("url", year_part()))
    return rows.select("page_id", X.year_text(F.col("url")).alias("year"), X.year_of_url(F.col("url")).alias("url_year"))


def html_to_markdown(s, d):
    return html_markdown.to_markdown(table(s, d, "pages")).select("page_id", "parsed.status", "parsed.words", "parsed.chars", "parsed.refs", "parsed.markdown")


def page_links(s, d):
    found = html_markdown.links(table(s, d, "pages"), "page_id")
    return html_markdown.distinct_links(found, "page_id").select("page_id", "href")


def page_title(s, d):
    return table(s, d, "pages").select("page_id", html_markdown.page_title(F.col("html")).alias("title"))


SECTIONS = "<!--sections_start--><p>menu</p><!---sections_end---><!--sino date 1 May--><!--noteup_start-->"


def strip_sections(s, d):
    artifact = F.when(F.col("page_id") % 3 == 0, F.lit("Content-type: text/html\n\n")).otherwise(F.lit(""))
    return table(s, d, "pages").withColumn("html", F.concat(artifact, F.lit(SECTIONS), "html")).select("page_id", *digest(X.strip_metadata_sections(X.strip_server_artifact(F.col("html")))))


def normalize_markdown(s, d):
    return table(s, d, "documents").select("doc_id", *digest(X.normalize_markdown(F.col("text"))))


def copy_lines(s, d):
    return table(s, d, "documents").select("doc_id", *digest(X.copy_line(F.col("text"))))


UNESCAPED = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
MD5 = "SELECT {k}, md5(x) AS md5, length(x) AS n FROM (SELECT {k}, {x} AS x FROM {t})"

CATALOG = {
    "doc_min_length": (doc_min_length, r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 50"),
    "clean_chunk_text": (clean_chunk_text, MD5.format(k="doc_id", x=CLEAN, t=DECISIONS)),
    "title_extract": (title_extract, f"SELECT doc_id, {TITLE} AS title FROM {DECISIONS}"),
    "cross_refs": (cross_refs, "SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS refs, len(l) AS n FROM (SELECT doc_id, regexp_extract_all(text, '\\]\\(([^)]*\\.md)\\)', 1) AS l FROM " + DECISIONS + ")"),
    "word_counts": (word_counts, r"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '[#*_\[\]()|>-]', ' ', 'g'), '\s+'), lambda w: w <> '')) AS words FROM documents"),
    "rerank_preview": (rerank_preview, MD5.format(k="doc_id", x=PREVIEW, t=DECISIONS)),
    "decision_extract": (decision_extract, "SELECT doc_id, md5(y) AS md5, length(y) AS n FROM (SELECT doc_id, CASE WHEN length(x) <= 1000 THEN x ELSE x[1:350] || chr(10) || chr(10) || '[... middle section omitted — see full document for complete text ...]' || chr(10) || chr(10) || right(x, 450) END AS y FROM (SELECT doc_id, " + DECIDED + " AS x FROM " + DECISIONS + "))"),
    "vector_ids": (vector_ids, f"SELECT doc_id, CASE WHEN strlen(p || '::' || doc_id % 7) <= 64 THEN p || '::' || doc_id % 7 ELSE md5(p)[1:16] || '::' || doc_id % 7 END AS vector_id FROM (SELECT doc_id, {PATH} || text[1:24] AS p FROM documents)"),
    "chunk_header": (
        chunk_header,
        f"SELECT doc_id, 'Δικαστήριο: ' || CASE lang WHEN 'en' THEN 'supreme' WHEN 'de' THEN 'apofaseised' WHEN 'fr' THEN 'courtOfAppeal' ELSE 'jsc' END || CASE WHEN lang = 'de' THEN ' | ΟΙΚΟΓΕΝΕΙΑΚΗ ΔΙΚΑΙΟΔΟΣΙΑ' ELSE '' END || ' | Έτος: ' || (n_chars % 60 + 1960) || CASE WHEN t <> '' THEN ' | ' || t[1:120] ELSE '' END AS header FROM (SELECT *, {TITLE} AS t FROM {DECISIONS})",
    ),
    "court_metadata": (
        court_metadata,
        "SELECT doc_id, CASE lang WHEN 'en' THEN 'supreme' WHEN 'de' THEN 'apofaseised' WHEN 'fr' THEN 'courtOfAppeal' ELSE 'jsc' END AS court, (n_chars % 60 + 1960)::INT AS year, CASE lang WHEN 'de' THEN 'first_instance' WHEN 'fr' THEN 'appeal' ELSE 'supreme' END AS court_level, CASE WHEN lang = 'de' THEN 'oik' ELSE '' END AS subcourt FROM documents",
    ),
    "chunk_documents": (chunk_documents, None),
    "document_records": (document_records, None),
    "year_from_path": (year_from_path, r"SELECT page_id, coalesce(nullif(regexp_extract(url, '/(\d{4})/', 1), ''), regexp_extract(url, '/(\d{4})_', 1)) AS year, coalesce(nullif(regexp_extract(url, '(\d{4})', 1), ''), 'vol_' || nullif(regexp_extract(url, 'index_(\d+)\.html', 1), ''), 'unknown') AS url_year FROM (SELECT * REPLACE (url || CASE page_id % 4 WHEN 0 THEN '/' || (page_id % 60 + 1960) || '/' WHEN 1 THEN '/' || (page_id % 60 + 1960) || '_2.html' WHEN 2 THEN '/index_' || (page_id % 9) || '.html' ELSE '' END AS url) FROM pages)"),
    "html_to_markdown": (html_to_markdown, None),
    "page_links": (page_links, f"SELECT DISTINCT page_id, {UNESCAPED.format('h')} AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*\"([^\"]*)\"[^>]*>.*?</a>', 1)) AS h FROM pages)"),
    "page_title": (page_title, f"SELECT page_id, {UNESCAPED.format('trim(regexp_extract(html, chr(40) || $$?is)<title[^>]*>(.*?)</title>$$, 1), chr(32) || chr(9) || chr(10) || chr(13))')} AS title FROM pages"),
    "strip_sections": (strip_sections, MD5.format(k="page_id", x=r"regexp_replace(regexp_replace(regexp_replace(CASE WHEN starts_with(html, 'Content-type:') THEN regexp_replace(html, '^[^\n]*\n[^\n]*\n', '') ELSE html END, '(?s)<!---?sections_start-?--?>.*?<!---?sections_end-?--?>', '', 'g'), '<!--sino\s+[^>]+-->', '', 'g'), '<!--noteup_(start|end)-->|<!---noteup_(start|end)--->', '', 'g')", t=f"(SELECT * REPLACE (CASE WHEN page_id % 3 = 0 THEN 'Content-type: text/html' || chr(10) || chr(10) ELSE '' END || '{SECTIONS}' || html AS html) FROM pages)")),
    "normalize_markdown": (normalize_markdown, MD5.format(k="doc_id", x=r"regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda l: regexp_replace(l, '\s+$', '')), chr(10)), '^\s+|\s+$', '', 'g') || chr(10)", t="documents")),
    "copy_lines": (copy_lines, MD5.format(k="doc_id", x=r"replace(translate(text, chr(9) || chr(13), ' '), chr(10), '\n')", t="documents")),
}

"""Text rules as column expressions. Python's white space and line rules are kept: (?U) for \\s, (?d) where lines end at \\n alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import dimensions as D

LINK = r"\[([^\]]*)\]\([^)]*\)"
C1 = r"[\x{80}-\x{9f}]"
#: Characters and what they become; those beyond the end go.
PLAIN = " ‑­͘", " -"


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def py_rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def py_lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def long_enough(text: Column, least: int = 50) -> Column:
    """At least so many code points once stripped; null is too short."""
    return F.coalesce(F.char_length(py_strip(text)) >= least, F.lit(False))


def court(path: Column) -> Column:
    """First known substring, otherwise the first path part, otherwise 'unknown'."""
    first = F.coalesce(empty_to_null(F.get(F.filter(F.split(path, "/"), lambda p: p != ""), 0)), F.lit("unknown"))
    return _first(path, D.PATH_SUBSTRING_COURT, F.contains, first)


def court_extractor(path: Column) -> Column:
    first = F.coalesce(F.get(F.filter(F.split(path, "/"), lambda p: p != ""), 0), F.lit("unknown"))
    return _first(path, D.EXTRACTOR_COURT, F.contains, first)


def court_crawler(path: Column) -> Column:
    return _first(path, D.PATH_PREFIX_COURT, F.startswith, F.lit("unknown"))


def court_summary(doc_id: Column) -> Column:
    """Path part 0, or part 1 below apofaseis."""
    parts = F.split(doc_id, "/")
    return F.when(parts[0] == "apofaseis", F.coalesce(F.get(parts, 1), F.lit("unknown"))).otherwise(parts[0])


def _first(path: Column, rules: list[tuple[str, str]], test, otherwise: Column) -> Column:
    chain = F
    for key, value in rules:
        chain = chain.when(test(path, F.lit(key)), F.lit(value))
    return chain.otherwise(otherwise)


def court_level(court_id: Column) -> Column:
    return D.lookup(D.COURT_LEVEL, court_id, F.lit("other"))


def subcourt(doc_id: Column, court_id: Column) -> Column:
    part = F.get(F.split(doc_id, "/"), 1)
    return F.when((court_id == "apofaseised") & part.isin(D.SUBCOURTS), part).otherwise(F.lit(""))


def year_text(path: Column) -> Column:
    """/YYYY/, else /YYYY_, else empty."""
    return F.coalesce(empty_to_null(F.regexp_extract(path, r"/(\d{4})/", 1)), F.regexp_extract(path, r"/(\d{4})_", 1))


def year_crawler(path: Column) -> Column:
    return F.regexp_extract(path, r"/(\d{4})/", 1)


def year_int(text: Column) -> Column:
    """The year as a number, 0 where it's none."""
    return F.coalesce(text.try_cast("int"), F.lit(0))


def year_of_url(url: Column) -> Column:
    """First four digits, else vol_N of a volume index, else 'unknown'."""
    volume = empty_to_null(F.regexp_extract(url, r"index_(\d+)\.html", 1))
    return F.coalesce(empty_to_null(F.regexp_extract(url, r"(\d{4})", 1)), F.concat(F.lit("vol_"), volume), F.lit("unknown"))


def clean_markdown(line: Column) -> Column:
    """Markup, links (one pass), C1 characters and runs of dashes and spaces out of a line."""
    c = F.translate(line, "*#", "")
    c = F.regexp_replace(c, LINK, "$1")
    c = F.regexp_replace(c, C1, "-")
    c = F.replace(c, F.lit("‑"), F.lit("-"))
    c = F.regexp_replace(c, "-{2,}", "-")
    return py_strip(F.regexp_replace(c, r"(?U)\s+", " "))


def title(text: Column) -> Column:
    """The first '# ' heading, else the first line that isn't empty or a rule (200 characters), cleaned."""
    lines = F.transform(F.split(text, "\n"), py_strip)
    heading = empty_to_null(py_strip(F.substr(F.get(F.filter(lines, lambda x: x.startswith("# ")), 0), F.lit(3))))
    plain = F.left(F.get(F.filter(lines, lambda x: (x != "") & ~x.startswith("---")), 0), F.lit(200))
    return F.regexp_replace(clean_markdown(F.coalesce(heading, plain, F.lit(""))), C1, "")


def title_viewer(text: Column) -> Column:
    """The first line without heading marks, 200 characters."""
    return F.left(py_strip(F.regexp_replace(F.substring_index(text, "\n", 1), r"^#+\s*", "")), F.lit(200))


def jurisdiction(text: Column, doc_id: Column) -> Column:
    """The first of 30 lines after the decision marker with the jurisdiction word, else by path segment, else empty."""
    parts = F.split(text, r"\*{0,4}" + D.DECISION + r"\*{0,4}", 2)
    lines = F.filter(F.transform(F.slice(F.split(F.get(parts, 1), "\n"), 1, 30), clean_markdown), lambda x: F.contains(x, F.lit(D.JURISDICTION)))
    by_path = _first(doc_id, [(f"/{k}/", v) for k, v in D.SEGMENT_JURISDICTION], F.contains, F.lit(""))
    return F.coalesce(F.get(lines, 0), by_path)


def strip_references(text: Column, compat: bool = True) -> Column:
    """Cuts from the references marker to the decision marker. compat: references without a later decision marker cut the rest; otherwise such text stays."""
    refs = F.regexp_instr(text, F.lit(r"\*{0,4}" + D.REFERENCES + r"\*{0,4}"))
    mark = r"\*{0,4}" + D.DECISION + r"\*{0,4}:?"
    body = F.regexp_instr(text, F.lit(mark))
    length = F.char_length(F.regexp_substr(text, F.lit(mark)))
    before, after = F.substr(text, F.lit(1), body - 1), F.substr(text, body + length)
    head, tail = py_rstrip(F.substr(text, F.lit(1), refs - 1)), py_lstrip(after)
    joined = F.when(head != "", F.concat(head, F.lit("\n\n"), tail)).otherwise(tail)
    return F.when((refs == 0) & (body > 0), F.concat(before, after)).when(refs == 0, text).when(body > refs, joined).otherwise(head if compat else text)


def cross_refs(text: Column) -> Column:
    """Distinct targets of links to .md files, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\]\(([^)]*\.md)\)"), F.lit(1)))


def count_refs(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\]\([^)]*\.md\)"))


def clean_noise(text: Column, passes: int = 4) -> Column:
    """Formatting noise out of a document's text, in fixed order; `passes` bounds how deep links may nest (chunking resolves any depth)."""
    c = F.translate(text, "*#", "")
    for _ in range(passes):
        c = F.regexp_replace(c, LINK, "$1")
    return after_links(c)


def after_links(c: Column) -> Column:
    c = F.regexp_replace(c, C1, "")
    c = F.translate(c, *PLAIN)
    c = F.regexp_replace(c, r"(?dm)^[-_]{3,}$", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, " {2,}", " ")
    return py_strip(c)


def chunk_header(court_name: Column, jurisdiction_: Column, year: Column, title_: Column) -> Column:
    year_part = F.when(year != "", F.concat(F.lit("Έτος: "), year))
    return F.concat_ws(" | ", F.concat(F.lit("Δικαστήριο: "), court_name), empty_to_null(jurisdiction_), year_part, empty_to_null(F.left(title_, F.lit(120))))


def subject(text: Column) -> Column:
    return F.left(py_strip(F.regexp_extract(text, r"Subject:\s*([^\n]+?)(?:\n|$)", 1)), F.lit(200))


def after_marker(text: Column, marker: str) -> Column:
    """What follows the first marker, or null."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substr(text, at + len(marker)))


def body_for_embedding(text: Column) -> Column:
    return body_of_clean(clean_noise(strip_references(text)))


def body_of_clean(clean: Column) -> Column:
    skip = lambda c: F.regexp_replace(c, r"(?U)^[:*\s]+", "")
    return F.coalesce(skip(after_marker(clean, D.LEGAL_ANALYSIS)), skip(after_marker(clean, D.DECISION + ":")), clean)


def document_content(text: Column, most: int = 3500) -> Column:
    """Title, subject and body joined by blank lines; longer ones end in a notice."""
    return content_of(title(text), subject(text), body_for_embedding(text), most)


def content_of(title_: Column, line: Column, body: Column, most: int = 3500) -> Column:
    whole = F.concat_ws("\n\n", empty_to_null(title_), F.when(line != "", F.concat(F.lit("[Subject: "), line, F.lit("]"))), body)
    return F.when(F.char_length(whole) > most, F.concat(F.left(whole, F.lit(most - 100)), F.lit("\n[...truncated]"))).otherwise(whole)


def decision_text(text: Column, most: int) -> Column:
    """First line and the part after the legal-analysis or decision marker; too long ones keep 35 % head and a tail."""
    at = F.instr(text, "\n")
    head_line = F.when(at > 1, F.concat(py_strip(F.substr(text, F.lit(1), at - 1)), F.lit("\n\n"))).otherwise(F.lit(""))
    body = F.coalesce(py_strip(after_marker(text, D.LEGAL_ANALYSIS)), py_strip(after_marker(text, D.DECISION + ":")), text)
    whole = F.concat(head_line, body)
    head = most * 35 // 100
    cut = F.concat(F.left(whole, F.lit(head)), F.lit("\n\n[... middle section omitted — see full document for complete text ...]\n\n"), F.right(whole, F.lit(most - head - 200)))
    return F.when(F.char_length(whole) <= most, whole).otherwise(cut)


def rerank_preview(text: Column, head: int = 500, middle: int = 2000, tail: int = 1500, skip: int = 200) -> Column:
    """Head, subject, the start of the decisive part, and a tail that ends before the last `skip` characters."""
    line = F.regexp_extract(text, r"Subject:\s*([^\n\r  ]+)", 1)
    first = lambda marker: F.left(F.regexp_replace(after_marker(text, marker), r"(?U)^[:\s*]+", ""), F.lit(middle))
    part = F.coalesce(first(D.LEGAL_ANALYSIS), first(D.DECISION), F.left(text, F.lit(middle)))
    end = F.greatest(F.lit(0), F.char_length(text) - skip)
    start = F.greatest(F.lit(0), end - tail)
    last = F.when(start > head, F.concat(F.lit("\n[...middle omitted...]\n"), F.substr(text, start + 1, end - start))).otherwise(F.lit(""))
    named = F.when(line != "", F.concat(F.lit("[SUBJECT: "), py_strip(line), F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.left(text, F.lit(head)), named, F.lit("\n[...]\n"), part, last)


def vector_id(doc_id: Column, index: Column, most: int = 64) -> Column:
    """doc::i if it fits in so many bytes, else a hash prefix."""
    plain = F.concat_ws("::", doc_id, index.cast("string"))
    return F.when(F.octet_length(plain) <= most, plain).otherwise(F.concat_ws("::", F.left(F.md5(doc_id), F.lit(16)), index.cast("string")))


def vector_id_prefix(vector_id_: Column) -> Column:
    got = F.regexp_extract(vector_id_, r"(?s)^(.*)::", 1)
    return F.when(F.contains(vector_id_, F.lit("::")), got).otherwise(vector_id_)


def href_file(href: Column) -> Column:
    return F.regexp_extract(href, r"file=([^&\"'\s]+)", 1)


def href_to_md(href: Column) -> Column:
    """The .md path that a gateway link leads to, or null."""
    path = F.regexp_replace(empty_to_null(href_file(href)), r"(?i)\.(html?|pdf)$", ".md")
    return F.when(path.endswith(".md"), path).otherwise(F.concat(path, F.lit(".md")))


def absolute_url(href: Column, base_url: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base_url), href))


def normal_path(path: Column) -> Column:
    """Old /aad/ paths under their new root."""
    return F.when(path.startswith("/aad/"), F.concat(F.lit("/apofaseis"), path)).otherwise(path)


def gateway_url(path: Column, base_url: str) -> Column:
    return F.concat(F.lit(base_url + "/cgi-bin/open.pl?file="), path)


def word_count(text: Column) -> Column:
    words = F.split(F.regexp_replace(text, r"[#*_\[\]()|>-]", " "), r"(?U)\s+")
    return F.size(F.filter(words, lambda w: w != ""))


def normalize_markdown(md: Column) -> Column:
    """At most one blank line in a row, no trailing white space, one final line end."""
    lines = F.transform(F.split(F.regexp_replace(md, r"\n{3,}", "\n\n"), "\n"), py_rstrip)
    return F.concat(py_strip(F.array_join(lines, "\n")), F.lit("\n"))


def strip_metadata_sections(html: Column) -> Column:
    c = F.regexp_replace(html, r"(?s)<!---?sections_start-?--?>.*?<!---?sections_end-?--?>", "")
    c = F.regexp_replace(c, r"<!--sino\s+[^>]+-->", "")
    return F.regexp_replace(c, r"<!--noteup_(start|end)-->|<!---noteup_(start|end)--->", "")


def strip_server_artifact(html: Column) -> Column:
    """A page that starts with a header line loses its first two lines."""
    return F.when(html.startswith("Content-type:"), F.element_at(F.split(html, "\n", 3), -1)).otherwise(html)


def reset_seconds(value: Column) -> Column:
    """1m30s -> 90.0"""
    part = lambda unit: F.coalesce(F.regexp_extract(value, rf"([\d.]+){unit}", 1).try_cast("double"), F.lit(0.0))
    return part("m") * 60 + part("s")


def format_cost(cost: Column) -> Column:
    """Dollars with five, four or three decimals by size."""
    digits = lambda n: F.format_string(f"$%.{n}f", cost)
    return F.when(cost < 0.001, digits(5)).when(cost < 0.01, digits(4)).otherwise(digits(3))


def api_error(message: Column) -> Column:
    """What a user is told about an error."""
    has = lambda *words: reduce(Column.__or__, [F.contains(message, F.lit(w)) for w in words])
    return (
        F.when(has("maximum context length"), F.lit("The search returned too many documents. Try a more specific query."))
        .when(has("rate_limit", "429"), F.lit("The AI service is temporarily overloaded. Please wait and try again."))
        .when(has("timeout", "ETIMEDOUT"), F.lit("The request timed out. Please try again."))
        .when(has("401", "auth"), F.lit("API authentication error."))
        .otherwise(F.lit("An error occurred while processing your request. Please try again."))
    )


def link_target(href: Column) -> Column:
    """The document that a link in an answer opens, or null."""
    param = F.url_decode(F.regexp_extract(href, r"[?&]doc_id=([^&#]*)", 1))
    return (
        F.when(href.startswith("/doc?doc_id="), empty_to_null(param))
        .when(href.endswith(".md") & href.startswith("/"), F.substr(href, F.lit(2)))
        .when(href.endswith(".md") & ~href.startswith("http"), href)
    )


def relevance_of_text(summary: Column) -> Column:
    """The first of the ordered ratings that stands, as a word, after the rating heading."""
    section = F.coalesce(F.get(F.split(summary, "(?i)RELEVANCE RATING"), 1), F.lit(""))
    chain = F
    for level in D.RELEVANCE_ORDER:
        chain = chain.when(section.rlike(rf"\b{level}\b"), F.lit(level))
    return chain.otherwise(F.lit("UNKNOWN"))


def engagement_of_text(summary: Column) -> Column:
    text = F.coalesce(summary, F.lit(""))
    chain = F
    for level in D.ENGAGEMENTS:
        chain = chain.when(text.rlike(rf"\b{level.replace('_', ' ')}\b"), F.lit(level))
    return chain.otherwise(F.lit("UNKNOWN"))


def is_greek(text: Column) -> Column:
    return text.rlike("[Ͱ-Ͽ]")


def is_footer(text: Column, markers: list[str] | None = None) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in (D.FOOTER_MARKERS if markers is None else markers)])


def safe_path(doc_id: Column) -> Column:
    """No way out of the root: neither .. nor a leading slash."""
    return ~F.contains(doc_id, F.lit("..")) & ~doc_id.startswith("/")


def with_md(doc_id: Column) -> Column:
    return F.when(doc_id.endswith(".md"), doc_id).otherwise(F.concat(doc_id, F.lit(".md")))


def is_year_index(href: Column) -> Column:
    return href.rlike(r"index_\w*\d+\.html") | href.rlike(r"/\d{4}/index\.html")


def is_case_link(href: Column) -> Column:
    return F.contains(href, F.lit("open.pl"))


def copy_line(text: Column) -> Column:
    """As a bulk loader writes a field: tabs to spaces, no carriage returns, line ends escaped."""
    return F.replace(F.translate(text, "\t\r", " "), F.lit("\n"), F.lit("\\n"))


def excerpt(text: Column, n: int, more: str = "") -> Column:
    """The first n characters, and a mark behind them where there are more."""
    return F.concat(F.left(text, F.lit(n)), F.when(F.char_length(text) > n, F.lit(more)).otherwise(F.lit("")))


def findings_preview(engagement: Column, analysis: Column) -> Column:
    """300 characters of a finding; empty where the matter wasn't addressed or nothing is said."""
    return F.when(engagement == "NOT_ADDRESSED", F.lit("")).otherwise(F.coalesce(excerpt(analysis, 300, "..."), F.lit("")))


def spoken_focus(query: Column) -> Column:
    """The question without times, courts, instructions and quantities; the question itself if fewer than 15 characters are left.

    Each pattern names, in Greek, one kind of wording; they apply in order.
    """
    c = py_strip(query)
    for pattern, put in FOCUS_RULES:
        c = F.regexp_replace(c, "(?iu)" + pattern, put)
    c = py_strip(F.regexp_replace(c, r"(?U)\s+", " "))
    c = py_strip(F.regexp_replace(c, r"(?U)^[,;:\s]+|[,;:\s]+$", ""))
    return F.when(F.char_length(c) < 15, py_strip(query)).otherwise(c)


# Wording that a summary's focus leaves out, in order: times, courts, instructions, quantities.
FOCUS_RULES = [
    (r"κατά τη[νη]?\s+τελευταί[αη]\s+(?:πενταετία|δεκαετία|τριετία|διετία)", " "),
    (r"τ(?:α|ης|ων)\s+τελευταί(?:α|ες|ων|ων)\s+\d+\s+(?:χρόνι[αω]|ετ[ηών]|μήν(?:ες|ών))", " "),
    (r"(?:μετά|από|πριν)\s+(?:το|τ[ηο]ν?)\s+(?:έτος\s+)?\d{4}", " "),
    (r"(?:μεταξύ|από)\s+\d{4}\s+(?:και|έως|μέχρι|ως)\s+\d{4}", " "),
    (r"πρόσφατ(?:ες|α|ων|η)\s*", " "),
    (r"τ(?:ης|ων)\s+τελευταί(?:ας|ων)\s+(?:πενταετίας|δεκαετίας|τριετίας|διετίας|περιόδου)", " "),
    (r"(?:στ[οα]|του|τ(?:ης|ων)|ενώπιον(?:\s+του)?|από\s+τ[οα])\s+(?:Ανώτατ[οα]|Ανωτάτου)\s+(?:Συνταγματικ[οό](?:ύ)?\s+)?Δικαστήρι[οα](?:ύ)?", " "),
    (r"(?:στ[οα]|του|τ(?:ης|ων)|ενώπιον(?:\s+του)?|από\s+τ[οα])\s+Εφετεί[οα](?:ύ)?", " "),
    (r"(?:σε|στ[αο]|τ(?:ων|α))\s+(?:πρωτ[οό]δικ[αο]|Επαρχιακ[αάό])\s+[Δδ]ικαστήρι[αο](?:ύ)?", " "),
    (r"(?:στ[οα]|του|τ(?:ης|ων))\s+[Δδ]ιοικητικ[οό](?:ύ)?\s+[Δδ]ικαστήρι[οα](?:ύ)?", " "),
    (r"(?:στ[οα]|του|τ(?:ης|ων))\s+Οικογενειακ[οό](?:ύ)?\s+[Δδ]ικαστήρι[οα](?:ύ)?", " "),
    (r"^(?:Βρες|Αναζήτησε|Ψάξε|Δείξε|Εντόπισε)(?:\s+μου)?\s+(?:αποφάσεις|υποθέσεις|δικαστικές\s+αποφάσεις)?\s*(?:σχετικ[άέ]\s+(?:με|με\s+τ[οηα]ν?))?\s*", ""),
    (r"^(?:Θέλω|Χρειάζομαι)\s+(?:να\s+(?:βρω|δω|αναζητήσω))?\s*(?:αποφάσεις|υποθέσεις)?\s*(?:σχετικ[άέ]\s+(?:με|με\s+τ[οηα]ν?))?\s*", ""),
    (r"^(?:Ποιες|Ποια)\s+(?:αποφάσεις|υποθέσεις)\s+(?:αφορούν|σχετίζονται\s+με)\s*", ""),
    (r"τ(?:ις|α|ους?)\s+\d+\s+(?:πιο|πλέον)\s+(?:σημαντικ[έά]ς?|σχετικ[έά]ς?)\s*", " "),
    (r"τ(?:α|ις)\s+(?:πρώτ[αες]|κύρι[αες])\s+\d+\s*", " "),
]

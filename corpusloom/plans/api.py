"""Entry functions of the search and document endpoints, as DataFrames: the contracts of requests and responses without a web server."""

from __future__ import annotations

import html as escapes
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import dimensions as D
from corpusloom.functions import text as X
from corpusloom.operators import fusion, vector
from corpusloom.session import code_path
from corpusloom.sources import files

ROLES = ("system", "user", "assistant", "tool")


class BadRequest(ValueError):
    """What an endpoint answers with status 400."""


class NotFound(LookupError):
    """What an endpoint answers with status 404."""


def health(documents: DataFrame) -> dict:
    return {"status": "ok", "documents": not documents.isEmpty()}


def search(chunks: DataFrame, query_vector: list[float], court: str | None = None, year_from: int | None = None, year_to: int | None = None, n_results: int = 20, max_documents: int = 30, chunk: str = "chunk_id") -> DataFrame:
    """doc_id, title, court, year, score, chunk_count: the best documents among the best n_results chunks; years that aren't numbers pass the year filter."""
    pool = chunks.where(F.col("court") == court) if court else chunks
    if year_from or year_to:
        pool = fusion.year_between(pool, "year", year_from, year_to, keep_unparsable=True)
    top = vector.top_k(pool, query_vector, n_results, chunk).select("doc_id", "title", "court", "year", "score", chunk)
    first = F.struct(-F.col("score"), F.col(chunk))
    one = lambda c: F.min_by(c, first).alias(c)
    docs = top.groupBy("doc_id").agg(one("title"), one("court"), one("year"), F.max("score").alias("score"), F.count(F.lit(1)).alias("chunk_count"))
    return docs.orderBy(F.desc("score"), "doc_id").limit(max_documents)


def document(documents: DataFrame, doc_id: str | None) -> dict:
    """doc_id, text and text_length of one document; an unsafe or unknown id is not found."""
    if not doc_id:
        raise BadRequest("doc_id is required")
    rows = files.find_document(documents, doc_id).select("doc_id", "text").limit(1).collect()
    if not rows:
        raise NotFound(f"Document not found: {doc_id}")
    return {"doc_id": rows[0]["doc_id"], "text": rows[0]["text"], "text_length": len(rows[0]["text"] or "")}


def viewed(documents: DataFrame) -> DataFrame:
    """doc_id, html, title as the document viewer shows them."""
    code_path(documents.sparkSession)
    return documents.select("doc_id", rendered(F.col("text")).alias("html"), X.title_viewer(F.col("text")).alias("title"))


def validated(turns: DataFrame, model: str = "model", role: str = "role", text: str = "text") -> DataFrame:
    """All columns and `error`: unknown models and roles and empty messages say what is wrong, valid rows null."""
    known = ", ".join(D.PRICING)
    wrong = (
        F.when(~F.coalesce(F.col(model).isin(*D.PRICING), F.lit(False)), F.concat(F.lit("unknown model: "), F.coalesce(F.col(model), F.lit("none")), F.lit(f"; known: {known}")))
        .when(~F.coalesce(F.col(role).isin(*ROLES), F.lit(False)), F.concat(F.lit("unknown role: "), F.coalesce(F.col(role), F.lit("none"))))
        .when(F.coalesce(X.py_strip(F.col(text)), F.lit("")) == "", F.lit("empty message"))
    )
    return turns.withColumn("error", wrong)


def checked_request(messages: list[dict], model: str) -> str:
    """The last user message of a request; an unknown model, no messages or an unknown role is a bad request."""
    if model not in D.PRICING:
        raise BadRequest(f"unknown model: {model}")
    if not messages:
        raise BadRequest("messages are required")
    for m in messages:
        if m.get("role") not in ROLES:
            raise BadRequest(f"unknown role: {m.get('role')}")
    asked = [m.get("content") or "" for m in messages if m["role"] == "user"]
    if not asked or not asked[-1].strip():
        raise BadRequest("a user message is required")
    return asked[-1]


# ---- Markdown to HTML: the dialect that the converter writes


def inline(text: str) -> str:
    """Code, links, strong and emphasised text of one block; everything else is escaped."""
    kept: list[str] = []

    def hold(made: str) -> str:
        kept.append(made)
        return f"\x00{len(kept) - 1}\x00"

    text = re.sub(r"`([^`]+)`", lambda m: hold(f"<code>{escapes.escape(m[1], False)}</code>"), text.replace("\x00", ""))
    text = escapes.escape(text, False)
    safe = lambda target: target if re.match(r"(?i)(?:https?:|mailto:|/|#|[^:]*$)", target) else "#"
    text = re.sub(r"\[([^\]]*)\]\(([^)\s]*)\)", lambda m: hold(f'<a href="{escapes.escape(safe(escapes.unescape(m[2])))}">') + m[1] + "</a>", text)
    text = re.sub(r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"<strong>\1</strong>", text, flags=re.S)
    text = re.sub(r"\*(?=\S)(.+?)(?<=\S)\*", r"<em>\1</em>", text, flags=re.S)
    text = re.sub(r" {2,}\n", "<br>\n", text)
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], text)


def cells_of(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def markdown_html(text: str | None) -> str:
    """Headings, rules, lists, quotes, tables and paragraphs, block by block."""
    out: list[str] = []
    for block in re.split(r"\n[ \t]*\n+", (text or "").strip("\n")):
        lines = block.strip("\n").split("\n")
        head = re.match(r"(#{1,6})\s+(.*)", lines[0])
        if not block.strip():
            continue
        if head:
            out.append(f"<h{len(head[1])}>{inline(head[2].strip())}</h{len(head[1])}>")
            rest = "\n".join(lines[1:])
            out.append(markdown_html(rest) if rest.strip() else "")
        elif re.fullmatch(r"\s*(?:-{3,}|_{3,}|\*{3,})\s*", block):
            out.append("<hr>")
        elif all(re.match(r"\s*[-*+] ", x) for x in lines):
            out.append("<ul>" + "".join(f"<li>{inline(re.sub(r'^\s*[-*+] ', '', x))}</li>" for x in lines) + "</ul>")
        elif all(re.match(r"\s*\d+\. ", x) for x in lines):
            out.append("<ol>" + "".join(f"<li>{inline(re.sub(r'^\s*\d+\. ', '', x))}</li>" for x in lines) + "</ol>")
        elif all(x.startswith(">") for x in lines):
            out.append(f"<blockquote>{markdown_html(chr(10).join(re.sub(r'^> ?', '', x) for x in lines))}</blockquote>")
        elif len(lines) > 1 and lines[0].startswith("|") and re.fullmatch(r"\|(?:\s*:?-{3,}:?\s*\|)+", lines[1].strip()):
            row = lambda tag, x: "<tr>" + "".join(f"<{tag}>{inline(c)}</{tag}>" for c in cells_of(x)) + "</tr>"
            out.append("<table>" + row("th", lines[0]) + "".join(row("td", x) for x in lines[2:]) + "</table>")
        else:
            out.append(f"<p>{inline(block.strip())}</p>")
    return "\n".join(filter(None, out))


@F.pandas_udf(T.StringType())
def rendered(text: pd.Series) -> pd.Series:
    return text.map(markdown_html)

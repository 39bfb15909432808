"""Chunks of documents: metadata by column rules, splitting in an Arrow function."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import dimensions as D
from corpusloom.functions import text as X
from corpusloom.session import code_path

SIZE, OVERLAP, TAIL = 2000, 400, 500
#: Characters of chunks that a task passes on at once.
CHUNK_CHARS = 1 << 20
SEPARATORS = ("\n\n", "\n", ". ", " ")
_LINK = re.compile(X.LINK)


def pieces(text: str, separators: tuple[str, ...]) -> tuple[list[str], tuple[str, ...]]:
    """The text cut before each occurrence of the first separator in it, and the separators left for pieces still too long."""
    for i, sep in enumerate(separators):
        if sep in text:
            first, *rest = text.split(sep)
            return [p for p in (first, *(sep + r for r in rest)) if p], separators[i + 1 :]
    return [text], ()


def split(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Recursive splitting into stripped chunks of at most `size` characters, a piece without separator aside; neighbours share up to `overlap`."""
    out: list[str] = []
    held: list[str] = []
    length = 0

    def emit() -> None:
        chunk = "".join(held).strip()
        if chunk:
            out.append(chunk)

    parts, rest = pieces(text, separators)
    for p in parts:
        if len(p) > size:
            if held:
                emit()
                held, length = [], 0
            out += split(p, size, overlap, rest) if rest else [p.strip()] * bool(p.strip())
            continue
        if length + len(p) > size and held:
            emit()
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    if held:
        emit()
    return out


def merge_tail(chunks: list[str], least: int = TAIL) -> list[str]:
    """A last chunk below `least` characters joins the one before it."""
    chunks = list(chunks)
    while len(chunks) > 1 and len(chunks[-1]) < least:
        last = chunks.pop()
        chunks[-1] = f"{chunks[-1]}\n\n{last}"
    return chunks


def without_links(text: str) -> str:
    """Links to their text until none is left, however deep they nest."""
    while _LINK.search(text):
        text = _LINK.sub(r"\1", text)
    return text


_PLAIN = {ord(c): X.PLAIN[1][i : i + 1] for i, c in enumerate(X.PLAIN[0])}
_RULE, _SPACE = re.compile(r"^[-_]{3,}$", re.M), "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def after_links(text: str) -> str:
    """What text.after_links says, on a string."""
    text = re.sub("[\x80-\x9f]", "", text).translate(_PLAIN)
    text = re.sub(r"\n{3,}", "\n\n", _RULE.sub("", text))
    return re.sub(" {2,}", " ", text).strip(_SPACE)


def chunked(rows: DataFrame, text: str) -> DataFrame:
    """A row for each chunk of a text, with chunk_index and _chunk in its place; one Python function takes a text at a time and passes on few chunks at once."""
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, texts = batch.select(kept), batch.column(text)
            at, index, chunks, size = [], [], [], 0

            def some() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*own.take(pa.array(at, pa.int32())).columns, pa.array(index, pa.int32()), pa.array(chunks, pa.string())], [*kept, "chunk_index", "_chunk"])  # noqa: B023

            for i in range(batch.num_rows):
                t = texts[i].as_py()
                for k, chunk in enumerate(merge_tail(split(after_links(without_links(t)))) if t else ()):
                    at.append(i)
                    index.append(k)
                    chunks.append(chunk)
                    size += len(chunk)
                    if size > CHUNK_CHARS:
                        yield some()
                        at, index, chunks, size = [], [], [], 0
            if at:
                yield some()

    schema = T.StructType([*rows.select(kept).schema, T.StructField("chunk_index", T.IntegerType()), T.StructField("_chunk", T.StringType())])
    return rows.mapInArrow(run, schema)


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", compat: bool = True) -> DataFrame:
    """text, doc_id, title, court, year, chunk_index, court_level, subcourt, jurisdiction, cross_refs of each chunk.

    Texts below 50 characters give none. compat keeps that a references section without a later
    decision marker takes the rest of the document with it.
    """
    code_path(docs.sparkSession)
    t, path = F.col("_text"), F.col("doc_id")
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("_text")).where(X.long_enough(t))
    rows = rows.select(
        "doc_id", X.title(t).alias("title"), X.court(path).alias("court"), X.year_text(path).alias("year"), X.jurisdiction(t, path).alias("jurisdiction"), X.cross_refs(t).alias("cross_refs"),
        F.translate(X.strip_references(t, compat), "*#", "").alias("_clean"),
    )
    rows = rows.withColumn("court_level", X.court_level(F.col("court"))).withColumn("subcourt", X.subcourt(path, F.col("court")))
    name = D.lookup(D.COURT_HEADER_NAME, F.col("court"), F.col("court"))
    header = X.chunk_header(name, F.col("jurisdiction"), F.col("year"), F.col("title"))
    rows = chunked(rows.withColumn("_header", header), "_clean")
    whole = F.concat("_header", F.lit("\n\n"), "_chunk").alias("text")
    return rows.select(whole, "doc_id", "title", "court", "year", "chunk_index", "court_level", "subcourt", "jurisdiction", "cross_refs")


def document_records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, content, title, court, year, court_level, subcourt, jurisdiction: one record a document for whole-document embedding."""
    t, path = F.col(text), F.col(key).cast("string")
    # What several columns and the filter use is made once a row: no filter moves below explode, nor is its column written out anew.
    once = lambda **made: F.explode(F.array(F.struct(*[c.alias(k) for k, c in made.items()])))
    rows = docs.where(X.long_enough(t)).select(path.alias("doc_id"), once(title=X.title(t), line=X.subject(t), clean=X.clean_noise(X.strip_references(t)), jurisdiction=X.jurisdiction(t, path)).alias("_m"))
    rows = rows.select("doc_id", "_m", once(body=X.body_of_clean(F.col("_m.clean"))).alias("_b")).where(X.py_strip(F.col("_b.body")) != "")
    path = F.col("doc_id")
    rows = rows.select("doc_id", X.content_of(F.col("_m.title"), F.col("_m.line"), F.col("_b.body")).alias("content"), F.left("_m.title", F.lit(200)).alias("title"), X.court(path).alias("court"), X.year_text(path).alias("year"), "_m.jurisdiction")
    return rows.withColumn("court_level", X.court_level(F.col("court"))).withColumn("subcourt", X.subcourt(F.col("doc_id"), F.col("court")))

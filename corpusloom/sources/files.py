"""File sources with explicit schemas: corpora, raw pages, indexes, logs and responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X
from corpusloom.session import code_path
from corpusloom.sources import tree

HTML_ENCODINGS = ("utf-8", "iso-8859-7", "windows-1253", "latin-1")
CSV_ENCODINGS = ("iso-8859-7", "windows-1253", "latin-1", "utf-8")
ENTRY = "url string, file_path string, title string, court string, year string, date string"
INDEX_SCHEMA = f"court string, source string, scraped_at string, total bigint, by_year map<string,array<struct<{ENTRY.replace(' string', ':string')}>>>"
META_SCHEMA = "idx bigint, doc_id string, court string, year string, title string, chunk_index int, court_level string, subcourt string, jurisdiction string, text string"
RESPONSE_SCHEMA = "custom_id string, response struct<status_code:int,body:struct<data:array<struct<index:int,embedding:array<double>>>>>"


def relative_path(path: Column, root: str) -> Column:
    """A file's path below root, whatever scheme both are written with."""
    bare = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    top = root.split("://")[-1].rstrip("/") + "/"
    at = F.instr(bare, top)
    return F.when(at > 0, F.substr(bare, at + len(top))).otherwise(bare)


def markdown_corpus(spark: SparkSession, root: str, court: str | None = None, limit: int | None = None) -> DataFrame:
    """doc_id (path below root), text of all .md files, found and read by tasks; a limit takes the first ones by id."""
    rows = tree.texts(tree.listed(spark, root).where(F.col("file").endswith(".md")), root).withColumnRenamed("file", "doc_id")
    rows = rows.where(F.contains("doc_id", F.lit(court))) if court else rows
    return rows.orderBy("doc_id").limit(limit) if limit else rows


def decoder(encodings: tuple[str, ...]):
    """Bytes to text by the first encoding that fits."""

    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        def one(raw):
            for e in encodings:
                try:
                    return bytes(raw).decode(e)
                except UnicodeDecodeError:
                    continue
            return bytes(raw).decode("latin-1")

        return content.map(lambda raw: None if raw is None else one(raw))

    return decode


def raw_files(spark: SparkSession, root: str, court: str | None = None, least: int = 100) -> DataFrame:
    """path (below root), fmt, content of HTML and PDF files, and of files without suffix, that have `least` bytes or more."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = rows.select(relative_path(F.col("path"), root).alias("path"), "length", "content")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise(F.lit(""))
    rows = rows.withColumn("_s", suffix).where((F.col("length") >= least) & F.col("_s").isin("htm", "html", "pdf", "") & (name != ".DS_Store"))
    rows = rows.where(F.contains("path", F.lit(court))) if court else rows
    return rows.select("path", F.when(F.col("_s") == "pdf", "pdf").otherwise("html").alias("fmt"), "content")


def decoded_html(files: DataFrame) -> DataFrame:
    """path, html of raw HTML files."""
    code_path(files.sparkSession)
    return files.where("fmt = 'html'").select("path", decoder(HTML_ENCODINGS)(F.col("content")).alias("html"))


def pdf_text(files: DataFrame) -> DataFrame:
    """path, title, text of raw PDF files, pages parted by rules; needs pypdf on the executors, else each row fails with that error."""
    code_path(files.sparkSession)

    @F.pandas_udf("struct<text:string,error:string>")
    def read(content: pd.Series) -> pd.DataFrame:
        try:
            import io

            import pypdf
        except ImportError:
            return pd.DataFrame({"text": [None] * len(content), "error": ["pypdf is not installed"] * len(content)})
        rows = []
        for raw in content:
            try:
                rows.append(("\n\n---\n\n".join((p.extract_text() or "").strip() for p in pypdf.PdfReader(io.BytesIO(bytes(raw))).pages), None))
            except Exception as e:  # a broken file fails alone
                rows.append((None, str(e)[:200]))
        return pd.DataFrame(rows, columns=["text", "error"])

    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.where("fmt = 'pdf'").select("path", F.translate(stem, "_", " ").alias("title"), read("content").alias("_r")).select("path", "title", "_r.text", "_r.error")


def cached_pages(spark: SparkSession, cache: str, urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with the html that the page cache has (file md5(url).html), null where it has none; undecodable bytes become U+FFFD."""
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(cache)
    name = F.regexp_extract("path", r"([0-9a-f]{32})\.html$", 1)
    held = held.select(name.alias("_key"), decoder_replace(F.col("content")).alias("html"))
    code_path(spark)
    return urls.join(held, F.md5(url) == F.col("_key"), "left").drop("_key")


@F.pandas_udf(T.StringType())
def decoder_replace(content: pd.Series) -> pd.Series:
    return content.map(lambda raw: None if raw is None else bytes(raw).decode("utf-8", "replace"))


def paths_log(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lines that aren't blank."""
    return spark.read.text(path).select(X.py_strip(F.col("value")).alias("path")).where("path <> ''").distinct()


def pipe_index(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """Entries of a pipe-delimited index in legacy encodings: # lines and blank lines are skipped, so are lines without two fields; the first of equal paths stays."""
    code_path(spark)
    raw = spark.read.format("binaryFile").load(path).select("path", decoder(CSV_ENCODINGS)(F.col("content")).alias("_t"))
    lines = raw.select("path", F.posexplode(F.split("_t", r"\r\n|\r|\n")).alias("pos", "line")).where(~F.col("line").startswith("#"))
    parts = F.split(X.py_strip(F.col("line")), r"\|")
    part = lambda k: F.coalesce(X.py_strip(F.get(parts, k)), F.lit(""))
    rows = lines.where((F.size(parts) >= 2) & (part(0) != "")).select("path", "pos", part(0).alias("_p"), part(1).alias("title"), part(3).alias("date"))
    rows = rows.withColumn("file_path", X.normal_path(F.col("_p")))
    first = Window.partitionBy("file_path").orderBy("path", "pos")
    rows = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return rows.select(X.gateway_url(F.col("file_path"), base_url).alias("url"), "file_path", "title", F.lit("aad").alias("court"), X.year_crawler(F.col("_p")).alias("year"), "date")


def pipe_skipped(spark: SparkSession, path: str) -> DataFrame:
    """path, skipped: lines of pipe-delimited indexes with text but without two fields or a first one; comments and blank lines don't count."""
    code_path(spark)
    raw = spark.read.format("binaryFile").load(path).select("path", decoder(CSV_ENCODINGS)(F.col("content")).alias("_t"))
    line = X.py_strip(F.col("line"))
    parts = F.split(line, r"\|")
    lines = raw.select("path", F.explode(F.split("_t", r"\r\n|\r|\n")).alias("line"))
    bad = ~F.col("line").startswith("#") & (line != "") & ((F.size(parts) < 2) | (X.py_strip(F.get(parts, 0)) == ""))
    return lines.groupBy("path").agg(F.count_if(bad).alias("skipped"))


def paged_export(spark: SparkSession, fetch: Callable[[int, int], list[dict]], total: int, schema: str, page: int = 1000, limit: int | None = None) -> DataFrame:
    """A vector store's records, read by offset and limit: pages are dealt over tasks, each of which asks for its own. `total` is the store's count."""
    code_path(spark)
    total = min(total, limit) if limit is not None else total
    starts = spark.range(0, total, page, max(1, min(200, -(-total // page))))
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in frame["id"].tolist():
                rows = fetch(int(start), int(min(page, total - start)))
                yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)

    return starts.mapInPandas(run, schema)


def index_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of nested JSON index files, with the file and the year they are filed under."""
    rows = spark.read.schema(INDEX_SCHEMA).option("multiLine", True).json(path)
    rows = rows.select(F.col("_metadata.file_name").alias("file"), F.explode("by_year").alias("filed_under", "_e"))
    return rows.select("file", "filed_under", F.posexplode("_e").alias("pos", "e")).select("file", "filed_under", "pos", "e.*")


def distinct_paths(entries: DataFrame) -> DataFrame:
    """One entry a path: the first by file, year and place."""
    first = Window.partitionBy("file_path").orderBy("file", "filed_under", "pos")
    return entries.where("file_path <> ''").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def chunk_log(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The chunk metadata log, or its rows start <= idx < end by the stored idx; `line_index.records` reads a range by the lines' places alone."""
    rows = spark.read.schema(META_SCHEMA).json(path)
    rows = rows.where(F.col("idx") >= start) if start is not None else rows
    return rows.where(F.col("idx") < end) if end is not None else rows


def embedding_results(spark: SparkSession, path: str, chunks: int | None = None) -> DataFrame:
    """idx, embedding of successful responses; malformed lines and failures are dropped, and positions beyond the known chunks."""
    rows = spark.read.schema(RESPONSE_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("response.status_code = 200")
    start = F.regexp_extract("custom_id", r"-s(\d+)$", 1).try_cast("bigint")
    rows = rows.select(start.alias("_s"), F.explode("response.body.data").alias("d")).where("_s is not null")
    rows = rows.select((F.col("_s") + F.col("d.index")).alias("idx"), "d.embedding")
    return rows.where(F.col("idx") < chunks) if chunks is not None else rows


def with_embeddings(chunks: DataFrame, results: DataFrame, dims: int = 2000) -> DataFrame:
    """Chunks joined with their vectors by position, cut to the stored dimensions."""
    return chunks.join(results, "idx").withColumn("embedding", F.slice("embedding", 1, dims))


def event_lines(lines: DataFrame, order: str = "pos", value: str = "value", session: str = "session") -> DataFrame:
    """session, seq, event, data of a server-sent event log: a data line takes the event named before it since the last data line."""
    rows = lines.withColumn("_e", F.when(F.col(value).startswith("event:"), X.py_strip(F.substr(F.col(value), F.lit(7))))).withColumn("_d", F.col(value).startswith("data:"))
    w = Window.partitionBy(session).orderBy(order)
    block = F.coalesce(F.sum(F.col("_d").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_b", block)
    named = F.last("_e", ignorenulls=True).over(Window.partitionBy(session, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("event", named).where(F.col("_d") & F.col("event").isNotNull())
    data = F.replace(X.py_strip(F.substr(F.col(value), F.lit(6))), F.lit("\\n"), F.lit("\n"))
    return rows.select(session, F.row_number().over(w).alias("seq"), "event", data.alias("data"))


def find_document(docs: DataFrame, doc_id: str) -> DataFrame:
    """A document by id, with or without .md; an id that leaves the root finds none."""
    return docs.where(X.safe_path(F.lit(doc_id)) & (F.col("doc_id") == X.with_md(F.lit(doc_id))))


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()

"""Corpus builds as layers of tables: raw pages, Markdown, documents, chunks, postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import dimensions as D
from corpusloom.functions import text as X
from corpusloom.operators import chunker, html_markdown, postings
from corpusloom.session import written
from corpusloom.sources import fetch, files, sinks, versions


def crawl(spark: SparkSession, court_id: str, base_url: str, **options) -> DataFrame:
    """Case entries of a court: its main page, the year pages that links there name (all years of its range if none does), their case links. A page that fails is left out."""
    court = D.get_court(spark, court_id, base_url)
    main = fetch.fetch_pages(court.select(F.col("main_index_url").alias("url")), **options).where("status = 'ok'")
    folder, href = F.regexp_replace("url", "[^/]*$", ""), F.col("href")
    target = F.when(href.startswith("http"), href).when(href.startswith("/"), F.concat(F.lit(base_url), href)).otherwise(F.concat(folder, href))
    named = [(r["url"], r["year"]) for r in html_markdown.year_index_links(main, "url").select(target.alias("url"), "year").collect()]  # the links of one page
    if not named:
        named = [(r["url"], str(r["year"])) for r in D.year_index_urls(spark, base_url).where(F.col("court_id") == court_id).collect()]
    years = spark.createDataFrame(named, "page string, year string").dropDuplicates(["page"])
    pages = fetch.fetch_pages(years.select(F.col("page").alias("url")), **options).where("status = 'ok'").select(F.col("url").alias("page"), "html")
    found = html_markdown.case_entries(pages, "page", base_url, F.lit(court_id))
    return found.drop("year").join(years, "page").select("url", "file_path", "title", "court", "year", "date").dropDuplicates(["file_path"])


def parse(spark: SparkSession, raw: str, out: str, markers: list[str] | None = None) -> DataFrame:
    """Raw files not parsed before to Markdown, appended below `out` by court; returns the status of each file tried."""
    pages = files.decoded_html(files.raw_files(spark, raw)).withColumn("doc_id", F.concat(F.regexp_replace("path", r"(?i)\.(html?|pdf)$", ""), F.lit(".md")))
    rows = html_markdown.to_markdown(sinks.absent(pages, out, ["doc_id"]), markers=markers)
    rows = rows.select("doc_id", X.court_extractor(F.col("doc_id")).alias("court"), "parsed.*")
    sinks.append_new(rows.where("status = 'ok'").select("doc_id", F.col("markdown").alias("text"), "court"), out, ["doc_id"], ["court"])
    return rows.drop("markdown")


def build(spark: SparkSession, corpus: DataFrame, out: str, buckets: int = postings.BUCKETS) -> dict[str, str]:
    """Documents, chunks and stored postings of a corpus (doc_id, text), each replaced as a whole once the new one stands; returns where they are."""
    paths = {
        "documents": sinks.replaced(sinks.documents_table(corpus), f"{out}/documents", ["court_level"], ["year", "doc_id"]),
        "chunks": sinks.replaced(chunker.chunk_documents(corpus), f"{out}/chunks", ["court_level"], ["year", "doc_id"]),
        "postings": f"{out}/postings",
    }
    postings.build(spark.read.parquet(paths["documents"]).select("doc_id", "terms"), paths["postings"], buckets)
    return paths


def extend(spark: SparkSession, corpus: DataFrame, out: str) -> int:
    """Adds documents that the tables don't have, their chunks and postings; returns how many."""
    documents = sinks.absent(sinks.documents_table(corpus), versions.path_of(spark, f"{out}/documents"), ["doc_id"])
    documents = written(documents, "new-documents")
    n = documents.count()
    if n:
        texts = documents.select("doc_id", F.col("content").alias("text"))
        for name, rows in (("documents", documents), ("chunks", chunker.chunk_documents(texts))):
            rows.sortWithinPartitions("year", "doc_id").write.mode("append").partitionBy("court_level").parquet(versions.path_of(spark, f"{out}/{name}"))
        postings.append(documents.select("doc_id", "terms"), f"{out}/postings")
    return n

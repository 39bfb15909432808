"""Command line: parse raw pages, build tables, search them, show statistics."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import models, stats
from corpusloom.operators.postings import Index
from corpusloom.plans import agent, chat, hybrid, ingest
from corpusloom.session import written
from corpusloom.sources import files, markdown_tree, sinks, versions


def main(args: list[str] | None = None, **fetching) -> None:
    """`fetching` goes to the crawler's fetches."""
    parser = argparse.ArgumentParser(prog="corpusloom")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("parse", help="raw HTML files to Markdown")
    one.add_argument("raw")
    one.add_argument("out")
    two = commands.add_parser("build", help="documents, chunks and postings of a Markdown folder")
    two.add_argument("corpus")
    two.add_argument("out")
    two.add_argument("--court")
    two.add_argument("--limit", type=int)
    three = commands.add_parser("search", help="hybrid search over built tables, with the offline embedding")
    three.add_argument("tables")
    three.add_argument("query", nargs="+")
    three.add_argument("--scorer", choices=("tf", "bm25"), default="tf")
    three.add_argument("--level")
    three.add_argument("--rounds", type=int, help="ask as whole questions: this many rounds of searches by the offline model, rerank and summaries")
    more = commands.add_parser("extend", help="add documents of a Markdown folder that the tables don't have")
    more.add_argument("corpus")
    more.add_argument("tables")
    tree = commands.add_parser("tree", help="parsed Markdown as files at the paths of its documents; files that stand are passed over")
    tree.add_argument("parsed")
    tree.add_argument("out")
    tree.add_argument("--court")
    tree.add_argument("--overwrite", action="store_true")
    crawl = commands.add_parser("crawl", help="index a court from its pages, as JSON")
    crawl.add_argument("court")
    crawl.add_argument("base_url")
    crawl.add_argument("out")
    four = commands.add_parser("stats", help="documents by court level")
    four.add_argument("tables")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    if a.command == "parse":
        ingest.parse(spark, a.raw, a.out).groupBy("status").count().show()
    elif a.command == "build":
        for name, path in ingest.build(spark, files.markdown_corpus(spark, a.corpus, a.court, a.limit), a.out).items():
            print(name, path, spark.read.parquet(path).count())
    elif a.command == "search":
        queries = spark.createDataFrame(list(enumerate(a.query)), "query_id int, text string")
        queries = models.embedded(queries, models.hashed_provider, out="query_vector")
        chunks = models.embedded(versions.read(spark, f"{a.tables}/chunks").withColumn("chunk_id", F.concat_ws("::", "doc_id", "chunk_index")), models.hashed_provider)
        documents, index = versions.read(spark, f"{a.tables}/documents").withColumnRenamed("content", "text"), Index(spark, f"{a.tables}/postings")
        if a.rounds:
            search = chat.hybrid_searches(documents, index, chunks, models.hashed_provider, a.scorer)
            told = chat.answer(queries.select("query_id", "text"), documents, search, agent.keyword_model, rounds=a.rounds)
            told["events"].orderBy("query_id", "seq").show(1000, False)
        else:
            hybrid.hybrid_search(queries, documents, chunks, a.scorer, a.level, index=index).orderBy("query_id", "rank").show(100, False)
    elif a.command == "tree":
        parsed = spark.read.parquet(a.parsed)
        parsed = parsed.where(F.contains("doc_id", F.lit(a.court))) if a.court else parsed
        markdown_tree.write(parsed, a.out, overwrite=a.overwrite).groupBy("status", "error").count().show(100, False)
    elif a.command == "crawl":
        entries = written(ingest.crawl(spark, a.court, a.base_url, **fetching), "crawled")
        sinks.write_index(entries, a.out, datetime.now(UTC).isoformat(timespec="seconds"))
        print(a.court, entries.count())
    elif a.command == "extend":
        print(ingest.extend(spark, files.markdown_corpus(spark, a.corpus), a.tables))
    else:
        stats.distribution(versions.read(spark, f"{a.tables}/documents"), "court_level").show()


if __name__ == "__main__":
    main()

"""Nested JSON indexes, a file a court, written as sorted streams: no court's entries stand in one row or one task's memory.

Entries are dealt by range over (court, falling year, entry) and sorted within tasks. Each task
turns its stretch into pieces of text, in which what opens and closes a year or a court is
known from the first and last entry of each, found by an aggregation before. The pieces of a
court, one behind the other, are its file; a last job copies them together, piece by piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import code_path, small, work_path
from corpusloom.sources.line_index import files, opened

FIELDS = ["file_path", "url", "title", "court", "year", "date"]
COPIED = 8 << 20


def pieces(entries: DataFrame, scraped_at: str, key: str = "court") -> DataFrame:
    """_court and text, in order of partitions and of rows within them: the lines of the courts' JSON files.

    A blank year counts as unknown, a null court too; years fall, entries of a year rise by their fields; equal entries all stay.
    """
    spark = entries.sparkSession
    code_path(spark)
    blank = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    rows = entries.select(blank(key).alias("_court"), blank("year").alias("_year"), F.struct(*FIELDS).alias("_e"))
    years = rows.groupBy("_court", "_year").agg(F.min("_e").alias("_low"), F.max("_e").alias("_high"), F.count(F.lit(1)).alias("_n"))
    courts = years.groupBy("_court").agg(F.sum("_n").alias("_total"), F.max("_year").alias("_top"), F.min("_year").alias("_bottom"))
    ends = small(years.join(courts, "_court").drop("_n"))
    marked = rows.join(ends, ["_court", "_year"]).select(
        "_court", "_year", "_e", (F.col("_e") == F.col("_low")).alias("_first"), (F.col("_e") == F.col("_high")).alias("_last"), (F.col("_year") == F.col("_top")).alias("_opens"), (F.col("_year") == F.col("_bottom")).alias("_closes"), "_total"
    )
    order = [F.col("_court"), F.col("_year").desc(), F.col("_e")]
    dealt = marked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    dealt = dealt.select("_court", "_year", F.to_json("_e", {"ignoreNullFields": "false"}).alias("_j"), "_first", "_last", "_opens", "_closes", "_total")

    def opening(court: str, year: str, opens: bool, total: int) -> str:
        head = f'{{"court": {json.dumps(court)}, "scraped_at": {json.dumps(scraped_at)}, "total": {total}, "by_year": {{' if opens else ", "
        return f"{head}{json.dumps(year)}: ["

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A line ends with what follows its entry, so each waits for the next one.
        waiting, seq = None, 0
        for batch in batches:
            names, texts = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                court, year, entry, first, _, opens, _, total = row
                same = waiting is not None and waiting[:2] == (court, year)
                if waiting:
                    names.append(waiting[0])
                    texts.append(waiting[2] + ("," if same else "]}}" if waiting[4] else "]"))
                # Equal entries lie in one partition, so a task's first row begins its year if it equals the year's first entry.
                starts = not same if waiting else first
                waiting = (court, year, (opening(court, year, opens, total) if starts else "") + entry, row[4], row[6])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(range(seq, seq + len(names)), pa.int64()), pa.array(texts, pa.string())], ["_court", "_seq", "text"])
            seq += len(names)
        if waiting:
            end = ("]}}" if waiting[4] else "]") if waiting[3] else ","
            yield pa.RecordBatch.from_arrays([pa.array([waiting[0]]), pa.array([seq], pa.int64()), pa.array([waiting[2] + end])], ["_court", "_seq", "text"])

    return dealt.mapInArrow(run, "_court string, _seq long, text string")


def write(entries: DataFrame, path: str, scraped_at: str, key: str = "court") -> None:
    """Writes <court>.json for each court into a folder; a file is replaced once its new text is whole, other courts' files stay."""
    spark = entries.sparkSession
    parts = work_path(spark, "index-parts")
    rows = pieces(entries, scraped_at, key).sortWithinPartitions("_court", "_seq")
    rows.select(F.col("_court").alias("court"), "text").write.partitionBy("court").text(parts)
    name = F.regexp_extract("path", r"/court=([^/]+)/[^/]+$", 1)
    # A court has one part for each task that held some of it.
    held = files(spark, parts).groupBy(name.alias("court")).agg(F.sort_array(F.collect_list("path")).alias("parts"))
    held = held.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "court")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for court, sources in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, folder = opened(path)
                system.create_dir(folder, recursive=True)
                target = f"{folder.rstrip('/')}/{court}.json"
                with system.open_output_stream(f"{target}.part") as out:
                    for source in sources:
                        come, place = opened(source)
                        with come.open_input_stream(place) as f:
                            while piece := f.read(COPIED):
                                out.write(piece)
                system.move(f"{target}.part", target)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["court"])

    held.mapInArrow(run, "court string").write.format("noop").mode("overwrite").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of files that `write` made, line by line, so that files are split over tasks: file and the entry's fields."""
    line = F.col("value")
    entry = F.regexp_replace(F.substr(line, F.locate('{"file_path":', line)), r"(,|\]|\]\}\})$", "")
    rows = spark.read.text(path, pathGlobFilter="*.json").where(line.contains('{"file_path":'))
    return rows.select(F.col("_metadata.file_name").alias("file"), F.from_json(entry, ", ".join(f"{c} string" for c in FIELDS)).alias("_e")).select("file", "_e.*")

"""Markdown files that mirror the paths of documents, written by tasks.

What already stands is told from one listing before anything is written, and each file comes
into being by a move. A task that runs again after a lost executor thus writes the same files
and reports the same status.

Works on the file systems that pyarrow opens (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.session import code_path, written
from corpusloom.sources import line_index, tree

LEAST_CHARS = 10


def put(system: pafs.FileSystem, path: str, data: bytes) -> None:
    folder, _, leaf = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    held = f"{folder}/.{leaf}.{uuid.uuid4().hex}"  # hidden from readers
    with system.open_output_stream(held) as f:
        f.write(data)
    system.move(held, path)


def standing(spark: SparkSession, root: str) -> DataFrame:
    """file: what isn't empty below the root."""
    try:
        held = tree.listed(spark, root)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "file string")
    return held.where("length > 0").select("file")


def write(docs: DataFrame, root: str, key: str = "doc_id", text: str = "text", overwrite: bool = False) -> DataFrame:
    """doc_id, file, status (written, skip, fail), error, n_chars, n_words, n_refs of each id; its text goes to <root>/<file>.

    Files that aren't empty stay as they are unless `overwrite`. Ids without text or with under 10 characters of it, null
    ids and paths that lead out of the root fail. Of rows that give the same file the least text counts, under the least id.
    """
    spark = docs.sparkSession
    code_path(spark)
    named = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))
    named = named.select(F.struct("doc_id", "text").alias("row"), X.with_md(F.col("doc_id")).alias("file"))
    rows = named.groupBy("file").agg(F.min("row.doc_id").alias("doc_id"), F.min("row.text").alias("text"))
    if not overwrite:
        rows = rows.join(standing(spark, root).distinct().withColumn("held", F.lit(True)), "file", "left")
    else:
        rows = rows.withColumn("held", F.lit(None).cast("boolean"))
    fault = F.when(F.col("file").isNull(), F.lit("no id")).when(~X.safe_path(F.col("file")), F.lit("path leads out of the root"))
    short = F.col("text").isNull() | (F.char_length(X.py_strip(F.col("text"))) < LEAST_CHARS)
    fault = F.when(fault.isNotNull(), fault).when(F.col("held").isNull() & short, F.lit("empty or too short"))
    rows = rows.withColumn("error", fault).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("n_words", X.word_count(F.col("text")).cast("long")).withColumn("n_refs", X.count_refs(F.col("text")).cast("long"))
    rows = rows.withColumn("go", F.col("error").isNull() & F.col("held").isNull())
    columns = ["doc_id", "file", "go", "error", "n_chars", "n_words", "n_refs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = line_index.opened(root)
        for batch in batches:
            errors = []
            for file, go, error, content in zip(*(batch.column(c) for c in ("file", "go", "error", "text")), strict=True):
                said = error.as_py()
                if go.as_py():
                    try:
                        put(system, f"{base.rstrip('/')}/{file.as_py()}", content.as_py().encode())
                    except OSError as e:  # one file that can't be written fails alone
                        said = str(e)[:200]
                errors.append(said)
            given = {**{c: batch.column(c) for c in columns}, "error": pa.array(errors, pa.string())}
            yield pa.RecordBatch.from_arrays(list(given.values()), list(given))

    done = rows.select(*columns, "text").mapInArrow(run, rows.select(*columns).schema)
    status = F.when(F.col("error").isNotNull(), F.lit("fail")).when(F.col("go"), F.lit("written")).otherwise(F.lit("skip"))
    return written(done.select("doc_id", "file", status.alias("status"), "error", "n_chars", "n_words", "n_refs"), "markdown-tree")

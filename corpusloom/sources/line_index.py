"""A positional index of line-based logs: where the n-th line is, so that a range of lines is read without the lines before it.

Files are taken in order of their paths and cut into blocks of bytes. A line belongs to the
block that its first byte lies in; tasks count the lines of each block, and sums over blocks
give the number of each block's first line. A read opens only the blocks that a range of
numbers touches, from the block's first byte on. Lines end at a line feed; a carriage return before it
goes. Files must not be compressed. Tasks open them by pyarrow's file systems (local, HDFS,
S3, GCS), so the paths must be ones that these know.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import code_path

BLOCK = 64 << 20
#: Bytes that counting holds at a time; lines and bytes in a batch of a read.
PIECE, ROWS, BYTES = 4 << 20, 10_000, 16 << 20


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI as Spark gives it."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of files, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def begun(f: pa.NativeFile, begin: int, end: int) -> int:
    """Lines whose first byte lies in [begin, end) of a file, which is that long at least: one at 0, and one behind each line feed."""
    n = int(begin == 0 < end)
    at = max(begin - 1, 0)
    f.seek(at)
    while at < end - 1:
        piece = f.read(min(PIECE, end - 1 - at))
        if not piece:
            break
        n += piece.count(b"\n")
        at += len(piece)
    return n


def build(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """path, begin, end, n, first: the blocks of the files, the lines begun in each, and the number of the first of these. To be stored by the caller."""
    code_path(spark)
    spans = files(spark, path).where("length > 0").withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long"))))
    spans = spans.select("path", "begin", F.least(F.col("begin") + block, F.col("length")).alias("end"))
    spans = spans.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for uri, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = opened(uri)
                with system.open_input_file(name) as f:
                    counts.append(begun(f, begin, end))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], ["path", "begin", "end", "n"])

    counted = spans.mapInArrow(run, "path string, begin long, end long, n long")
    before = lambda *keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = counted.groupBy("path").agg(F.sum("n").alias("_n"))
    shift = total.select("path", F.coalesce(F.sum("_n").over(before(order="path")), F.lit(0)).alias("_s"))  # one row a file
    rows = counted.withColumn("_b", F.coalesce(F.sum("n").over(before("path", order="begin")), F.lit(0))).join(shift, "path")
    return rows.select("path", "begin", "end", "n", (F.col("_s") + F.col("_b")).alias("first"))


def touched(index: DataFrame, start: int | Column, end: int | Column) -> DataFrame:
    """Blocks in which a line of start <= number < end begins."""
    return index.where((F.col("n") > 0) & (F.col("first") < end) & (F.col("first") + F.col("n") > start))


def begun_lines(f: pa.NativeFile, begin: int, skip: int, n: int) -> Iterator[bytes]:
    """n lines of those begun at `begin` or behind it, after `skip` others."""
    f.seek(max(begin - 1, 0))
    text = io.BufferedReader(f, 1 << 20)
    if begin:
        text.readline()  # the end of a line that began before
    for _ in range(skip):
        text.readline()
    for _ in range(n):
        yield text.readline().removesuffix(b"\n").removesuffix(b"\r")


def lines(index: DataFrame, start: int, end: int) -> DataFrame:
    """idx, value of the lines start <= idx < end; undecodable bytes become U+FFFD. An empty or inverted range has none."""
    spark = index.sparkSession
    code_path(spark)
    spans = touched(index, start, end).select("path", "begin", "n", "first").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, begin, n, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = max(start, first), min(end, first + n)
                system, name = opened(uri)
                with system.open_input_file(name) as f:
                    held, size, at = [], 0, low
                    for raw in begun_lines(f, begin, low - first, high - low):
                        held.append(raw.decode("utf-8", "replace"))
                        size += len(raw)
                        if len(held) == ROWS or size > BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(held)), pa.int64()), pa.array(held, pa.string())], ["idx", "value"])
                            at += len(held)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(held)), pa.int64()), pa.array(held, pa.string())], ["idx", "value"])

    return spans.mapInArrow(run, "idx long, value string")


def records(index: DataFrame, start: int, end: int, schema: str) -> DataFrame:
    """The JSON records at these lines, with the line's number as idx; a line that isn't JSON has nulls."""
    fields = F.from_json("value", schema)
    return lines(index, start, end).select("idx", fields.alias("_r")).select("idx", "_r.*")


def total(index: DataFrame) -> int:
    return index.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that a block of texts handed to numpy holds at most; a single longer text is a block of its own.
BLOCK_CHARS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, local runs take a temporary one and clusters raise."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (got or local_dir()).rstrip("/")


#: Intermediate tables written and not yet deleted, in order.
WRITTEN: list[str] = []


def materialize(df: DataFrame, tag: str, top: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{top or shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, pattern: str) -> None:
    """Deletes what a path or pattern names, by Hadoop's file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(path) or ():
        files.delete(found.getPath(), True)


def clear(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the intermediate tables written since a length of WRITTEN, but those whose paths contain a name in `keep`. Results that read them must have been consumed."""
    for path in WRITTEN[since:]:
        if not any(k in path for k in keep):
            delete(spark, path)
            WRITTEN.remove(path)


@atexit.register
def clear_at_end() -> None:
    spark = SparkSession.getActiveSession()
    if WRITTEN and spark and spark.sparkContext._jsc:
        with contextlib.suppress(Exception):  # the JVM may have ended first
            clear(spark)


class Scratch:
    """Intermediate tables of one operator, deleted once its result is written; `release` lets Spark drop shuffle files that no plan needs any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        return materialize(df, tag, self.path)

    def release(self) -> None:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def __enter__(self) -> Scratch:
        return self

    def discard(self, tag: str = "") -> None:
        """Deletes the tables written under a tag, or all."""
        start = f"{self.path}/{tag}-" if tag else self.path
        delete(self.spark, f"{start}*" if tag else start)
        WRITTEN[:] = [p for p in WRITTEN if not p.startswith(start)]

    def __exit__(self, *_) -> None:
        self.discard()
        self.release()


#: Python workers live as long as their executor, so memory that a batch needed goes back to the system: few arenas, Arrow
#: memory from malloc, large blocks mapped on their own.
WORKER_ENV = {"MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "16777216", "MALLOC_MMAP_THRESHOLD_": "8388608", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows and bytes in an Arrow batch at most; whole texts make Spark's default of 10,000 rows large.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def code_path(spark: SparkSession) -> None:
    """Prepares Python workers: lets them import this package from where the driver has it (on a cluster without that path, submit it with --py-files) and bounds their memory."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    for k, v in WORKER_ENV.items():
        env.setdefault(k, v)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"\d+", spark.conf.get(size))[0]) > BATCH_BYTES and spark.conf.get(size)[-1] in "0123456789b":
        spark.conf.set(size, str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over each batch alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    code_path(df.sparkSession)
    return df.mapInArrow(run, schema)


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts with at most `limit` characters together, one text at least."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and held + n > limit:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(texts):
        yield a, len(texts)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (the public splitmix64 step)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gapless(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int, salt: Column) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, without gathering a group in one task.

    Rows of a group are spread over `buckets` salts; each salt's rows are numbered on their own,
    shifted by the counts of the salts before it. `order` must make rows within a salt distinct
    or interchangeable.
    """
    df = df.withColumn("_salt", F.pmod(salt, F.lit(buckets)).cast("int"))
    counts = df.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*group, "_salt").orderBy(*order)
    numbered = df.withColumn("_row", F.row_number().over(inner) - 1)
    keys = [*group, "_salt"]
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_start")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = numbered.join(starts, on)
    return joined.select(*[c for c in df.columns if c != "_salt"], (F.col("_start") + F.col("_row")).cast("long").alias(out))


#: Rows of a one-column table of ids that is broadcast at most (16 bytes each in a join's table); more are shuffled.
SENT_IDS = 2_000_000


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join with a written table of ids, broadcast behind a check of its size."""
    return df.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, key, how)


#: Partition totals that one window of `starts` adds up.
FAN = 1024


def starts(totals: DataFrame, part: str, n: str, out: str) -> DataFrame:
    """part and the sum of n over all partitions before it: sums within groups of FAN partitions, then over the groups' sums."""
    rows = totals.select(F.col(part), F.col(n).alias("_n"), F.floor(F.col(part) / FAN).alias("_g"))
    groups = rows.groupBy("_g").agg(F.sum("_n").alias("_s"))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_g", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_g").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    return rows.join(groups, "_g").select(part, (F.col("_base") + F.col("_in")).cast("long").alias(out))


def with_starts(rows: DataFrame, start: DataFrame, part: str) -> DataFrame:
    """Joins the written starts of partitions, one row each: broadcast behind a check of their count."""
    return rows.join(F.broadcast(start) if start.count() <= SENT_IDS else start, part)

"""What operators need of a session."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a small side is broadcast; beyond that Spark joins by shuffle.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, which a limited count checks first."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows and bytes in an Arrow batch at most; whole texts make Spark's default of 10,000 rows large.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def code_path(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and bounds the batches that they hold."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get(size)[-1] in "0123456789b" and int(re.match(r"-?\d+", spark.conf.get(size))[0]) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir. Where that is unset, local runs take a temporary one and clusters raise."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(top or local_dir()).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@cache
def local_dir() -> str:
    top = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, top, ignore_errors=True)
    return f"file://{top}"


#: Intermediate tables written and not yet deleted.
WRITTEN: list[str] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder, for results that a plan uses several times; deleted when the driver ends, or by `clear`."""
    path = work_path(df.sparkSession, tag)
    WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Deletes the intermediate tables written since a length of WRITTEN; results that read them must have been consumed."""
    for path in WRITTEN[since:]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        WRITTEN.remove(path)


@atexit.register
def clear_at_end() -> None:
    spark = SparkSession.getActiveSession()
    if WRITTEN and spark and spark.sparkContext._jsc:
        with contextlib.suppress(Exception):  # the JVM may have ended first
            clear(spark)

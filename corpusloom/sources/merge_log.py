"""A keyed table as a log of merges: each batch of updates is a run of its own, and runs are merged by levels.

What runs are live stands in numbered records. A record is put in place only if its number is
free, so a writer and a merge that meet don't lose each other's work: the later one reads
the new record and tries again. A level of FANOUT runs becomes one run of the next level,
so each row is written again once a level, and a read meets FANOUT runs a level at most.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import versions

FANOUT, KEEP_RECORDS = 4, 10
#: The batch that a row came with decides between equal versions.
EPOCH = "_epoch"


def record(spark: SparkSession, base: str) -> tuple[int, dict]:
    """The number and content of the last record."""
    numbers = [int(n.removesuffix(".json")) for n in versions.children(spark, f"{base}/records") if n.endswith(".json") and not n.startswith("_")]
    if not numbers:
        return 0, {"runs": [], "epoch": -1, "gone": []}
    return max(numbers), json.loads(versions.text(spark, f"{base}/records/{max(numbers):012d}.json"))


def commit(spark: SparkSession, base: str, change: Callable[[dict], dict | None]) -> bool:
    """Applies a change to the last record, anew if another writer came first; a change of None gives up."""
    while True:
        number, held = record(spark, base)
        new = change(held)
        if new is None:
            return False
        if versions.create(spark, f"{base}/records/{number + 1:012d}.json", json.dumps(new)):
            for n in range(max(1, number + 1 - 2 * KEEP_RECORDS), number + 2 - KEEP_RECORDS):
                versions.delete(spark, f"{base}/records/{n:012d}.json")
            return True


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of each key the row of the highest version, of the latest batch among equal ones; combined within map tasks first."""
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    best = F.max_by(rest, F.struct(F.col(version), F.col(EPOCH))).alias("_r")
    return rows.groupBy(*keys).agg(best).select(*keys, "_r.*").select(*rows.columns)


def apply(batch: DataFrame, base: str, keys: list[str], version: str, epoch: int) -> bool:
    """Adds a batch of updates as a run; a batch that was applied before changes nothing. Rows of the same key and version within a batch: any one of them."""
    spark = batch.sparkSession
    if record(spark, base)[1]["epoch"] >= epoch:
        return False
    name = uuid.uuid4().hex
    newest(batch.withColumn(EPOCH, F.lit(epoch).cast("long")), keys, version).write.parquet(f"{base}/runs/{name}")

    def add(held: dict) -> dict | None:
        return None if held["epoch"] >= epoch else held | {"runs": [*held["runs"], {"name": name, "level": 0}], "epoch": epoch}

    if not commit(spark, base, add):
        versions.delete(spark, f"{base}/runs/{name}")
        return False
    return True


def compact(spark: SparkSession, base: str, keys: list[str], version: str) -> int:
    """Merges full levels, the lowest first; returns how many merges took place. Runs that are no longer live stay until the next call, for readers that began before."""
    gone, merges = record(spark, base)[1]["gone"], 0
    while True:
        held = record(spark, base)[1]["runs"]
        levels = sorted({r["level"] for r in held})
        full = next((level for level in levels if sum(r["level"] == level for r in held) >= FANOUT), None)
        if full is None:
            break
        old = [r["name"] for r in held if r["level"] == full]
        name = uuid.uuid4().hex
        newest(spark.read.parquet(*[f"{base}/runs/{n}" for n in old]), keys, version).write.parquet(f"{base}/runs/{name}")

        def swap(now: dict, old: list[str] = old, name: str = name, level: int = full) -> dict | None:
            if not set(old) <= {r["name"] for r in now["runs"]}:
                return None  # another merge took them
            left = [r for r in now["runs"] if r["name"] not in old]
            return now | {"runs": [{"name": name, "level": level + 1}, *left], "gone": [*now["gone"], *old]}

        if not commit(spark, base, swap):
            versions.delete(spark, f"{base}/runs/{name}")
            break
        merges += 1
    if gone:
        commit(spark, base, lambda now: now | {"gone": [n for n in now["gone"] if n not in gone]})
        for n in gone:
            versions.delete(spark, f"{base}/runs/{n}")
    return merges


def read(spark: SparkSession, base: str, keys: list[str], version: str) -> DataFrame | None:
    """The table as of the last record; None before the first batch."""
    runs = record(spark, base)[1]["runs"]
    return newest(spark.read.parquet(*[f"{base}/runs/{r['name']}" for r in runs]), keys, version).drop(EPOCH) if runs else None


def upsert_stream(stream: DataFrame, base: str, keys: list[str], version: str, checkpoint: str):
    """Each micro-batch updates the table, and merges levels that are full."""

    def write(batch: DataFrame, epoch: int) -> None:
        apply(batch, base, keys, version, epoch)
        compact(batch.sparkSession, base, keys, version)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

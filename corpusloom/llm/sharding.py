"""Sharding: minimax contiguous partition of ordered atomic groups.

Equal texts form one atomic group. Groups above a small share of a shard, of which there are
few whatever the input, are units of their own; the others are joined by hash into small
units, so the driver sees a bounded number of unit sizes. Small units stand in the order of
their hashes; large ones are spread among them, so that none is likely to lie where a cut has to be.
The smallest feasible capacity over this order is found by binary search, each candidate
checked greedily; then the cuts are made there, each shard's capacity being the smallest with which the rest still fits.

Defined results: a null text counts as empty, but its group isn't that of the empty text;
an empty table gives no rows; repeated rows are rows of one group; a group larger than an
even share has its shard for itself, and the others share the rest evenly.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common as C

#: Groups above 1 / LARGE of an even share are units of their own (LARGE x shards at most); the others are joined by hash to UNITS x shards units.
LARGE, UNITS = 200, 1000


def ordered(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The order of units. Small ones stay as they are given. Large ones go where an even share would begin, the largest first to where the fewest bytes stand."""
    share = sizes.sum() / shards
    large, small = np.flatnonzero(sizes * LARGE > share), np.flatnonzero(sizes * LARGE <= share)
    filled, begins = [(0, k) for k in range(shards)], np.zeros(len(large), np.int64)
    falling = np.argsort(-sizes[large], kind="stable")
    for i in falling.tolist():
        held, k = heapq.heappop(filled)
        begins[i] = k
        heapq.heappush(filled, (held + int(sizes[large[i]]), k))
    free = np.zeros(shards)
    for held, k in filled:
        free[k] = max(0.0, share - held)
    # A small unit stands in the stretch where its middle comes to lie when the stretches' free bytes are filled in order.
    middle = np.cumsum(sizes[small]) - sizes[small] / 2
    stretch = np.minimum(np.searchsorted(np.cumsum(free), middle, "right"), shards - 1)
    both = np.concatenate([large[falling], small])
    return both[np.argsort(np.concatenate([begins[falling], stretch]), kind="stable")]


def cuts_within(ends: np.ndarray, start: int, capacity: int, shards: int) -> list[int] | None:
    """Where greedy filling from unit `start` cuts (the unit after each shard's last), or None if `shards` don't hold all; ends: sums up to each unit."""
    out, at = [], start
    for _ in range(shards):
        at = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + capacity, "right"))
        out.append(at)
        if at >= len(ends):
            return out
    return None


def partition(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each of these ordered units: contiguous, with the smallest largest sum, and likewise for what each shard leaves to the ones behind it."""
    out, ends, start = np.zeros(len(sizes), np.int64), np.cumsum(sizes), 0
    for k in range(shards):
        if start >= len(sizes):
            break
        left, total, largest = shards - k, int(ends[-1] - (ends[start - 1] if start else 0)), int(sizes[start:].max())
        low = max(largest, -(-total // left))
        high = low + largest
        while low < high:
            middle = (low + high) // 2
            if cuts_within(ends, start, middle, left) is None:
                low = middle + 1
            else:
                high = middle
        end = cuts_within(ends, start, low, left)[0]
        out[start:end] = k
        start = end
    return out


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit. Units larger than an even share of what is left have a shard each; the rest is ordered and cut."""
    out, falling, alone, total = np.zeros(len(sizes), np.int64), np.argsort(-sizes, kind="stable"), 0, int(sizes.sum())
    while alone < min(shards - 1, len(sizes)) and int(sizes[falling[alone]]) * (shards - alone) > total:
        out[falling[alone]] = alone
        total -= int(sizes[falling[alone]])
        alone += 1
    rest = falling[alone:]
    if len(rest):
        rest = np.sort(rest)
        order = rest[ordered(sizes[rest], shards - alone)]
        out[order] = alone + partition(sizes[order], shards - alone)
    return out


def assign(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """key, size, text_crc32, shard and slot (gapless from 0 in its shard) of each row; sizes are UTF-8 bytes plus `overhead`."""
    spark = df.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(content) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.unhex(F.coalesce(F.sha2(F.col(text), 256), F.lit("00"))).alias("content"),
    )
    rows = C.materialize(rows, "shard-rows")
    groups = C.materialize(rows.groupBy("content").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") > total // (LARGE * shards)
    # Large groups go by their content, the others by a hash of it.
    unit = F.when(large, F.col("content")).otherwise(F.pmod(F.xxhash64("content"), F.lit(UNITS * shards)).cast("string").cast("binary"))
    groups = groups.select("content", "bytes", unit.alias("unit"))
    units = sorted((bytes(r["unit"]), r["bytes"]) for r in groups.groupBy("unit").agg(F.sum("bytes").alias("bytes")).collect())
    shard = place(np.array([n for _, n in units], np.int64), shards)
    told = spark.createDataFrame([(bytearray(u), int(k)) for (u, _), k in zip(units, shard, strict=True)], "unit binary, shard int")
    placed = groups.join(F.broadcast(told), "unit").select("content", "shard")  # at most (LARGE + UNITS) x shards rows
    rows = rows.join(placed, "content")
    rows = C.materialize(rows.select("doc_id", "size", "text_crc32", "shard"), "shard-placed")
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return C.gapless(rows, ["shard"], ["doc_id", "text_crc32"], "slot", buckets, F.xxhash64("doc_id", "text_crc32"))

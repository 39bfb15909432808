"""Target-distribution importance resampling over hashed n-grams.

A document's features are its runs of 1 to `n` consecutive words, joined by one space; a
feature's bucket is its CRC-32 modulo `buckets`. Each word's CRC is computed once. The
CRC of a longer run follows from those of its parts: a CRC is linear over GF(2), and
appending k bytes multiplies it by a 32 x 32 bit matrix, the k-th power of the matrix of
one byte. So the strings of n-grams never exist.

Bucket counts of both tables are summed over all rows; a bucket's gain is the logarithm
of the ratio of its shares in target and pool, and a document's weight the mean of its
features' gains. Gumbel noise from a hash of the id turns the highest scores into a
draw without replacement. Ranks come from counts: a histogram of scores (whole numbers
of a bounded range) gives the least score that is drawn, and only rows from there on
are sorted, in ranges whose counts are added up (`common.starts`).

Defined results: null and empty texts have no features and weight 0; an empty table gives
no rows; an empty target gives every bucket the same smoothed share; repeated rows are
scored and drawn one by one; a null id takes its noise from an empty one and comes last
among ties; of very long texts all features count, worked through in slices; of the
input only the named columns are read, whatever else it has.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common as C

#: ASCII letters and digits stay, lower-cased, as do all bytes of other characters; the rest separates words.
WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Bytes of a text whose words are hashed at once.
SLICE_BYTES = 1 << 20
#: Words whose CRC a task remembers at most; it then forgets all and goes on.
KNOWN_WORDS = 1 << 18
#: A document of fewer words isn't drawn.
LEAST_WORDS = 20
SPACE = zlib.crc32(b" ")


@cache
def powers() -> np.ndarray:
    """powers()[k, j, b]: what byte j of a CRC with value b becomes when 2^k zero bytes are appended; of all such matrices' columns, 32 are computed and the others are sums of them."""
    columns = np.array([_append_zero(1 << i) for i in range(32)], np.uint32)
    out = []
    for _ in range(32):
        tables = np.zeros((4, 256), np.uint32)
        for j in range(4):
            for b in range(8):
                tables[j, 1 << b : 2 << b] = tables[j, : 1 << b] ^ columns[8 * j + b]
        out.append(tables)
        columns = _times(tables, columns)  # the square
    return np.array(out)


def _append_zero(crc: int) -> int:
    """A CRC register (without inversion) after one zero byte; the polynomial is CRC-32's."""
    for _ in range(8):
        crc = crc >> 1 ^ (0xEDB88320 if crc & 1 else 0)
    return crc


def _times(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs multiplied by the matrix of n appended bytes each, one bit of n after the other."""
    crc, left, k = crc.copy(), n.copy(), 0
    while left.any():
        own = np.flatnonzero(left & 1)
        if len(own):
            crc[own] = _times(powers()[k], crc[own])
        left, k = left >> 1, k + 1
    return crc


def combined(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 of strings put together, from the CRCs of both and the second one's bytes."""
    return shifted(first, n) ^ second


class Hasher:
    """CRCs of texts' features; remembers words' lengths and CRCs within a task."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def word(self, word: bytes) -> int:
        """A word's length and CRC in one number."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            got = self.known[word] = len(word) << 32 | zlib.crc32(word)
        return got

    def features(self, text: bytes | None) -> Iterator[tuple[np.ndarray, int]]:
        """Slices of a text's features, as CRCs, with the number of words that begin there."""
        data = (text or b"").translate(WORDS)
        held: list[bytes] = []
        at = 0
        while at < len(data):
            end = data.find(b" ", at + SLICE_BYTES)
            end = len(data) if end < 0 else end
            held += data[at:end].split()
            at = end
            begin = len(held) if at == len(data) else max(0, len(held) - self.n + 1)
            if begin:
                yield self.runs(held, begin), begin
                held = held[begin:]

    def runs(self, words: list[bytes], begin: int) -> np.ndarray:
        """Runs of 1 to n words that begin at one of the first `begin` words."""
        both = np.fromiter(map(self.word, words), np.int64, len(words))
        crc, size = (both & 0xFFFFFFFF).astype(np.uint32), both >> 32
        out, run = [crc[:begin]], crc
        spaced = combined(np.full(len(crc), SPACE, np.uint32), crc, size) if self.n > 1 else crc
        for k in range(1, min(self.n, len(words))):
            run = combined(run[: len(words) - k], spaced[k:], size[k:] + 1)
            out.append(run[:begin])
        return np.concatenate(out)


def bucket_counts(df: DataFrame, text: str = "text", n: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n of all features of all rows; each task adds up its rows first."""
    C.code_path(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = Hasher(n), np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0):
                for crc, _ in hasher.features(t.as_py()):
                    counts += np.bincount(crc % buckets, minlength=buckets)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(counts[own])], ["bucket", "n"])

    rows = df.select(F.col(text).cast("binary")).mapInArrow(run, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(pool: DataFrame, target: DataFrame, text: str = "text", n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Each bucket's gain in thousandths; `buckets` numbers are all that reaches the driver."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, df in ((s, pool), (t, target)):
        for r in bucket_counts(df, text, n, buckets).collect():
            counts[r["bucket"]] = r["n"]
    of_pool, of_target = float(s.sum()), float(t.sum())
    ratio = lambda a, b: ((b + 1.0) * (of_pool + buckets)) / ((a + 1.0) * (of_target + buckets))
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def noise(doc_id: str, seed: str) -> int:
    """Gumbel noise in thousandths from the first 32 bits of sha256(`seed:doc_id`)."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(df: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", n: int = 1, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, n_words, weight, score, part, row; part and row number the rows. Write it before use."""
    spark = df.sparkSession
    C.code_path(spark)
    inner = df.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("_text"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_name"))
    sent = spark.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, hasher, part, row = sent.value, Hasher(n), TaskContext.get().partitionId(), 0
        for batch in batches:
            out = np.zeros((4, batch.num_rows), np.int64)
            for i, (t, name) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                total = features = words = 0
                for crc, w in hasher.features(t.as_py()):
                    total, features, words = total + int(gain[crc % len(gain)].sum()), features + len(crc), words + w
                weight = total // features if features else 0
                out[:, i] = features, words, weight, weight + noise(name, seed)
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out), pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(rows)], ["doc_id", "n_features", "n_words", "weight", "score", "part", "row"])

    return inner.mapInArrow(run, f"doc_id {inner.schema['doc_id'].dataType.simpleString()}, n_features long, n_words long, weight long, score long, part long, row long")


def ranked(rows: DataFrame, wanted: int, eligible: Column) -> DataFrame:
    """Written rows of `scored` with their rank (from 1) among the `wanted` best eligible ones, else null.

    Scores lie within some 100,000 whole numbers (logarithms of counts and of 32-bit noise), so their histogram is small.
    """
    histogram = rows.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()
    least, held = None, 0
    for r in sorted(histogram, key=lambda r: -r["score"]):
        if held >= wanted:
            break
        least, held = r["score"], held + r["n"]
    names = ["doc_id", "n_features", "n_words", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if least is None:
        return rows.select(*names, unranked)
    high = eligible & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("part"), F.col("row")]
    best = rows.where(high).repartitionByRange(*order).sortWithinPartitions(*order).select(*names, F.monotonically_increasing_id().alias("_id"))
    best = C.materialize(best.select(*names, F.shiftright("_id", 33).alias("range"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("place")), "ranges")
    start = C.materialize(C.starts(best.groupBy("range").agg(F.count(F.lit(1)).alias("n")), "range", "n", "start"), "range-starts")
    rank = F.col("start") + F.col("place") + 1
    best = C.with_starts(best, start, "range").select(*names, F.when(rank <= wanted, rank).alias("rank"))
    return rows.where(~high).select(*names, unranked).unionByName(best)


def resample(df: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), key: str = "doc_id", text: str = "text", n: int = 1, buckets: int = 10_000, seed: str = "2024", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank of every row; of those with enough words, the share with the highest scores has ranks."""
    gain = gains(df, target, text, n, buckets)
    rows = C.materialize(scored(df, gain, key, text, n, seed), "scored")
    eligible = F.col("n_words") >= least_words
    return ranked(rows, rows.where(eligible).count() * share[0] // share[1], eligible)

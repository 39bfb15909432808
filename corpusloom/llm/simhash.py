"""SimHash document fingerprints, with DataFrame functions only.

Terms are five-word shingles of the lower-cased text (a shorter text is one term), weighted
by how often they occur; the two 64-bit hashes of each term vote on 128 signed bits. Four
16-bit vote counters share one long, so that votes are 32 plain sums in generated code.
`near` finds all fingerprints within a Hamming radius by permuted block tables.

Defined results: null is the empty text; a text without words has the fingerprint 0; an
even vote gives 0; equal texts have equal fingerprints; two equal fingerprints have
likeness 1. In the order that `edit_next` uses, null ids stand before all others and rows
with equal ids are ordered by text.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import common as C

SHINGLE = 5
BITS = 128
#: Terms that one row of packed counters takes; below 2^15, so that no counter overflows.
TERMS_A_ROW = 30_000
LANES = 0x0001000100010001


def terms(df: DataFrame, text: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """Adds the array of term hashes of a text."""
    words = df.withColumn("_words", F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    w = F.col("_words")
    long = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)]))
    short = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(w)))
    return words.withColumn(out, F.when(F.size(w) < shingle, short).otherwise(long)).drop("_words")


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys (which must tell rows apart), hi and lo: the halves of each text's fingerprint.

    If df is already dealt by some of the keys, nothing is dealt anew.
    """
    exploded = terms(df, text, "_terms").select(*keys, F.posexplode_outer("_terms").alias("_at", "_a"))
    exploded = exploded.select(*keys, F.floor(F.col("_at") / TERMS_A_ROW).alias("_part"), "_a", F.when(F.col("_a").isNotNull(), F.xxhash64("_a", F.lit(1))).alias("_b"))
    packed = exploded.groupBy(*keys, "_part").agg(
        F.count("_a").alias("_n"),
        *[F.sum(F.shiftright(h, j).bitwiseAND(F.lit(LANES))).alias(f"{h}{j}") for h in ("_a", "_b") for j in range(16)],
    )
    lane = lambda h, j, k: F.shiftright(f"{h}{j}", 16 * k).bitwiseAND(F.lit(0xFFFF))
    votes = packed.groupBy(*keys).agg(F.sum("_n").alias("_n"), *[F.sum(lane(h, j, k)).alias(f"{h}_{16 * k + j}") for h in ("_a", "_b") for j in range(16) for k in range(4)])
    half = lambda h: reduce(
        Column.bitwiseOR, [F.when(F.coalesce(F.col(f"{h}_{b}"), F.lit(0)) * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)]
    )
    return votes.select(*keys, half("_a").alias("hi"), half("_b").alias("lo"))


def hexadecimal(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(hi: Column, lo: Column, other_hi: Column, other_lo: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(other_hi)) + F.bit_count(lo.bitwiseXOR(other_lo))


def likeness(hi: Column, lo: Column, other_hi: Column, other_lo: Column) -> Column:
    """Share of equal bits."""
    return 1 - distance(hi, lo, other_hi, other_lo) / F.lit(float(BITS))


def told(spark: SparkSession, values: list, kind: str) -> Column:
    """A constant array or struct out of plain values, of a DDL type."""
    return F.from_json(F.lit(json.dumps(values, default=str)), kind)


def ordered_buckets(df: DataFrame, key: str, rows_a_bucket: int = 64, most: int = 16_384, sample_rows: int = 131_072) -> DataFrame:
    """Adds `bucket`, rising with the key, so that no order over all rows in one task is needed.

    Buckets end at quantiles of a sample of at most about `sample_rows` keys of any type, which decides how rows are
    dealt and nothing else. Null keys are in the first bucket.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    total = df.count()
    place = F.pmod(F.xxhash64(key, F.lit("bucket sample")), F.lit(1 << 30))
    sample = df.where(place < int((1 << 30) * min(1.0, sample_rows / max(1, total)))).where(F.col(key).isNotNull()).select(key)
    keys = [r[0] for r in sample.orderBy(key).collect()]
    buckets = min(most, total // rows_a_bucket, len(keys) // 4) + 1
    ends = list(dict.fromkeys(keys[len(keys) * b // buckets] for b in range(1, buckets)))
    # Two steps, each over about the root of the number of ends.
    width = max(1, math.isqrt(len(ends)))
    runs = [ends[a : a + width] for a in range(0, len(ends), width)]
    tops, inside = told(spark, [r[0] for r in runs], f"array<{kind}>"), told(spark, [r[1:] for r in runs], f"array<array<{kind}>>")
    upto = lambda ends: F.size(F.filter(ends, lambda e: e <= F.col(key)))
    run = F.col("_run")
    found = df.withColumn("_run", F.coalesce(upto(tops), F.lit(0)))
    bucket = F.when(run > 0, (run - 1) * width + 1 + upto(F.get(inside, run - 1))).otherwise(0)
    return found.withColumn("bucket", bucket.cast("int")).drop("_run")


def edit_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """bucket, rn (together unique), extra, doc_id, text, next_text: each row beside the next one by falling key (after the last: the first).

    A bucket also gets, marked `extra`, the row next to its lowest one, from the bucket below or, in the lowest, from the highest.
    """
    docs = ordered_buckets(df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "doc_id")
    tops = sorted((r["bucket"], r["top"]) for r in docs.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    extra = None
    if tops:
        above = {b: tops[(i + 1) % len(tops)][0] for i, (b, _) in enumerate(tops)}
        rows = told(df.sparkSession, [{"b": b, "top": top, "above": above[b]} for b, top in tops], f"array<struct<b:int,top:{df.schema[key].dataType.simpleString()},above:int>>")
        edge = df.sparkSession.range(1).select(F.inline(rows))  # one row a bucket
        last = docs.join(F.broadcast(edge), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("top")))
        last = last.groupBy("b", "top", "above").agg(F.max("text").alias("text"))
        extra = last.select(F.col("top").alias("doc_id"), "text", F.col("above").alias("bucket"), F.lit(True).alias("extra"))
    both = docs.select("doc_id", "text", "bucket", F.lit(False).alias("extra"))
    both = both.unionByName(extra) if extra is not None else both
    order = Window.partitionBy("bucket").orderBy(F.desc("extra"), F.asc_nulls_first("doc_id"), "text")
    return both.select("*", F.row_number().over(order).alias("rn"), F.lag("text").over(order).alias("next_text"))


def near(queries: DataFrame, index: DataFrame, radius: int) -> DataFrame:
    """Pairs hi, lo (of queries), other_hi, other_lo (of index), distance: all within the radius, by permuted block tables.

    The bits are cut into radius + 1 blocks, so a pair within the radius agrees on one block
    at least; each table is keyed by another block. Both sides hold distinct fingerprints.
    """
    blocks = radius + 1
    width = -(-BITS // blocks)
    bits = lambda df: F.concat(F.lpad(F.conv(F.hex("hi"), 16, 2), 64, "0"), F.lpad(F.conv(F.hex("lo"), 16, 2), 64, "0"))
    tables = lambda df: df.withColumn("_bits", bits(df)).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_key", F.concat_ws(":", F.col("_t"), F.expr(f"substring(_bits, _t * {width} + 1, {width})"))).drop("_bits", "_t")
    q = tables(queries.select("hi", "lo").distinct())
    x = tables(index.select("hi", "lo").distinct()).select(F.col("hi").alias("other_hi"), F.col("lo").alias("other_lo"), "_key")
    apart = distance(F.col("hi"), F.col("lo"), F.col("other_hi"), F.col("other_lo"))
    found = q.join(x, (q["_key"] == x["_key"]) & (apart <= radius))
    return found.select("hi", "lo", "other_hi", "other_lo", apart.alias("distance")).distinct()


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256 and, as hi/lo halves, the fingerprints of each text, of its edit and of the next text.

    An edit replaces the last floor(n_chars / 3) code points by as many first ones of the next text.
    """
    rows = edit_next(df, key, text)
    n = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.expr("substring(coalesce(next_text, ''), 1, cast(floor(char_length(text) / 3) as int))"))
    rows = rows.select("bucket", "rn", "extra", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"))))
    keys = ["bucket", "rn", "extra", "doc_id", "n_chars", "edited_sha256", "kind"]
    rows = rows.select("bucket", "rn", "extra", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), kinds.alias("_x"))
    rows = rows.select(*keys[:-1], "_x.kind", "_x.t").where("not (extra and kind = 1)")
    prints = fingerprints(rows, keys, "t")
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = prints.groupBy(*keys[:-1]).agg(pick(0, "hi").alias("hi"), pick(0, "lo").alias("lo"), pick(1, "hi").alias("edited_hi"), pick(1, "lo").alias("edited_lo"))
    order = Window.partitionBy("bucket").orderBy("rn")
    wide = wide.select("*", F.lag("hi").over(order).alias("next_hi"), F.lag("lo").over(order).alias("next_lo"))
    return wide.where(~F.col("extra")).drop("bucket", "rn", "extra")

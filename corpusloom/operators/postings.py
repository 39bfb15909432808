"""Stored postings that searches read: lists by term in blocks with maxima, so that blocks that can't reach the top k are passed over.

A table of blocks lies in folders by a hash of the term. A block holds the documents of one
range that have a term: ids, counts, lengths and places, and the most that any of them can
add to a score. Ranges are the same for all terms and hold about RANGE documents of like
length, so a block's maximum is near what its documents score, and the maxima of a
question's terms in a range add up to a bound for its documents.

A search reads the bounds first (small columns of the folders of its terms), scores the k
most promising ranges of each question, whose k-th score is a threshold, and then reads on only
in ranges whose bound reaches it. Results equal those of a scan: a range that is passed over holds
no document among the first k.

Appending writes another epoch of blocks; the record of live epochs is replaced in one step.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import fulltext as T
from corpusloom.operators import scoring
from corpusloom.session import code_path, small, written
from corpusloom.sources import versions

#: Documents of a range, about.
RANGE = 128
#: Folders by hash of the term, and parts that a term's blocks are dealt in when they are written.
BUCKETS, SPREAD = 64, 4
#: Scores are rounded to 9 digits, bounds allow for it.
SLACK = 1e-6
#: Terms of a task that writes blocks, and of the ranges of which it makes blocks at once, about.
PART_TERMS, LOT_TERMS = 1 << 22, 1 << 20


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(docs: DataFrame, base: str, buckets: int = BUCKETS, spread: int = SPREAD) -> None:
    """Writes the postings of documents (doc_id, terms) and makes them the index at `base`; what was there before goes. Documents without terms count, but have no postings."""
    spark = docs.sparkSession
    old = versions.current(spark, base)
    epoch = _write(docs, base, buckets, spread)
    versions.publish(spark, base, {"buckets": buckets, "epochs": [epoch]})
    for e in old["epochs"] if old else ():
        versions.delete(spark, f"{base}/epoch={e['name']}")


def append(docs: DataFrame, base: str, spread: int = SPREAD) -> None:
    """Adds documents whose ids the index doesn't have."""
    spark = docs.sparkSession
    record = versions.current(spark, base)
    epoch = _write(docs, base, record["buckets"], spread)
    versions.publish(spark, base, record | {"epochs": [*record["epochs"], epoch]})


def _write(docs: DataFrame, base: str, buckets: int, spread: int) -> dict:
    sized = docs.select("doc_id", "terms", F.size("terms").alias("len"))
    kind = F.floor(F.log2("len")).cast("int")  # documents whose lengths lie within a factor of two
    counted = sized.groupBy(F.when(F.col("len") > 0, kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("length")).collect()  # 32 rows at most
    total, length = sum(r["n"] for r in counted), sum(r["length"] or 0 for r in counted)
    # Long documents make smaller ranges, which tasks hold whole.
    ranges = {r["kind"]: -(-r["n"] // max(1, min(RANGE, LOT_TERMS >> r["kind"]))) for r in counted if r["kind"] is not None}
    average = length / total if total and length else 1.0
    epoch = {"name": uuid.uuid4().hex, "docs": total, "length": length, "average": average}
    of_kind = F.element_at(F.array(*[F.lit(ranges.get(k, 1)) for k in range(32)]), F.col("kind") + 1)
    rows = sized.where("len > 0").withColumn("kind", kind).withColumn("range", F.shiftleft(F.col("kind").cast("long"), 40) + F.pmod(F.xxhash64("doc_id"), of_kind))
    # One shuffle, of documents: a range's postings are made in one task, from whole rows.
    parts = max(spread, -(-length // PART_TERMS))
    dealt = rows.select("doc_id", "len", "range", "terms").repartition(parts, "range").sortWithinPartitions("range", "doc_id", "len")
    code_path(docs.sparkSession)
    kind_of = docs.schema["doc_id"].dataType.simpleString()
    columns = f"term string, range long, n int, peak_tf double, peak_bm25 double, doc_id array<{kind_of}>, tf array<int>, len array<int>, places array<array<int>>"
    blocks = dealt.mapInArrow(lambda batches: (_blocks(t, average) for t in scoring.groups(batches, "range", LOT_TERMS)), columns)
    names = [c.split()[0] for c in columns.split(", ")]
    blocks = blocks.select(_bucket(F.col("term"), buckets).alias("bucket"), *names)
    blocks.sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{base}/epoch={epoch['name']}")
    return epoch


def _blocks(rows: pa.Table, average: float) -> pa.RecordBatch:
    """The blocks of documents (doc_id, len, range, terms) in the order of ranges and ids. Rows equal in id and length are one document."""
    ids, lists = rows["doc_id"].combine_chunks(), rows["terms"].combine_chunks()
    length, ranges = (rows[c].to_numpy() for c in ("len", "range"))
    code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    new = np.concatenate([[True], (code[1:] != code[:-1]) | (length[1:] != length[:-1]) | (ranges[1:] != ranges[:-1])])
    doc, first_row = np.cumsum(new) - 1, np.flatnonzero(new)
    coded = lists.flatten().dictionary_encode()
    term = coded.indices.to_numpy().astype(np.int64)
    place = (np.arange(len(term)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
    key = term * len(first_row) + np.repeat(doc, length)
    order = np.argsort(key, kind="stable") if new.all() else np.lexsort((place, key))
    key, place = key[order], place[order]
    at = _starts(key)
    tf = np.diff(np.append(at, len(key))).astype(np.int32)
    word, which = np.divmod(key[at], len(first_row))
    row = first_row[which]
    n, span = length[row], ranges[row]
    block = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (span[1:] != span[:-1])]))
    ends = pa.array(np.append(block, len(at)).astype(np.int32))
    of_block = lambda values: pa.ListArray.from_arrays(ends, values)
    peaks = [np.maximum.reduceat(x, block) for x in ((1 + np.log(tf)) / (1 + np.log(n)), tf * (T.K1 + 1) / (tf + T.K1 * (1 - T.B + T.B * n / average)))]
    places = pa.ListArray.from_arrays(pa.array(np.append(at, len(key)).astype(np.int32)), pa.array(place))
    names = ["term", "range", "n", "peak_tf", "peak_bm25", "doc_id", "tf", "len", "places"]
    columns = [coded.dictionary.take(pa.array(word[block])), pa.array(span[block]), pa.array(np.diff(np.append(block, len(at))).astype(np.int32)), *map(pa.array, peaks)]
    columns += [of_block(x) for x in (ids.take(pa.array(row)), pa.array(tf), pa.array(n.astype(np.int32)), places)]
    return pa.RecordBatch.from_arrays(columns, names)


def _starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


class Index:
    """The index at a path as it was when opened."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.record = spark, versions.current(spark, base)
        if self.record is None:
            raise FileNotFoundError(f"no index in {base}")
        self.total, self.length = (sum(e[k] for e in self.record["epochs"]) for k in ("docs", "length"))
        self.average = self.length / self.total if self.total and self.length else 1.0
        # An epoch without postings has no folder to read a schema from.
        paths = [f"{base}/epoch={e['name']}" for e in self.record["epochs"] if e["length"]]
        self.blocks = spark.read.option("basePath", base).parquet(*paths) if paths else None

    def lists(self, asked: DataFrame) -> DataFrame:
        """Blocks of the terms asked for (in column term); only their folders are listed and read."""
        found = [r[0] for r in asked.select(_bucket(F.col("term"), self.record["buckets"]).alias("b")).distinct().collect()]  # as many as there are folders at most
        return self.blocks.where(F.col("bucket").isin(found)).join(small(asked.select("term").distinct()), "term", "left_semi")

    def bounds(self, asked: DataFrame, scorer: str) -> tuple[DataFrame, DataFrame]:
        """asked with each term's weight, and by question and range the most that a document there can score."""
        lists = self.lists(asked).select("term", "epoch", "range", "n", "peak_tf", "peak_bm25")
        held = written(lists, "block-bounds")
        if scorer == "tf":
            asked, peak = written(asked.withColumn("weight", F.lit(1.0)), "asked"), F.col("peak_tf")
        else:
            df = held.groupBy("term").agg(F.sum("n").alias("df"))
            idf = F.log(1 + (F.lit(float(self.total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
            asked = written(asked.join(small(df), "term").withColumn("weight", idf).drop("df"), "asked")
            # A longer average makes a document's share larger, at most in proportion.
            grown = F.create_map(*[F.lit(x) for e in self.record["epochs"] for x in (e["name"], max(1.0, self.average / e["average"]))])
            peak = F.col("peak_bm25") * grown[F.col("epoch")]
        bound = held.join(small(asked), "term").groupBy("query_id", "epoch", "range").agg(F.sum(F.col("weight") * peak).alias("bound"))
        return asked, written(bound, "bounds")

    def scores(self, asked: DataFrame, ranges: DataFrame, scorer: str, k: int) -> DataFrame:
        """query_id, doc_id, score of all questions in the ranges (epoch, range, written); tasks keep k documents of each question."""
        lists = self.lists(asked).join(small(ranges), ["epoch", "range"], "left_semi")
        lists = lists.select(F.xxhash64("epoch", "range").alias("range_id"), "term", F.col("doc_id").alias("docs"), "tf", "len")
        lists = lists.repartition("range_id").sortWithinPartitions("range_id")
        if scorer == "tf":
            share, scale = (lambda tf, _: 1 + np.log(tf)), (lambda n: 1 + np.log(n))
        else:
            average = self.average
            share, scale = (lambda tf, n: tf * (T.K1 + 1) / (tf + T.K1 * (1 - T.B + T.B * n / average))), np.ones_like
        kind = self.blocks.schema["doc_id"].dataType.elementType.simpleString()
        return scoring.best(lists, asked, k, scoring.of_blocks(share, scale), kind)

    def top(self, queries: DataFrame, k: int = 100, scorer: str = "tf", query: str = "text", query_key: str = "query_id") -> DataFrame:
        """query_id, doc_id, score, rank of the k best documents of each question; scorer: tf or bm25."""
        if self.blocks is None:
            return self.none(queries, query_key, "score double, rank int")
        asked = written(queries.select(F.col(query_key).alias("query_id"), F.explode(T.query_terms(F.col(query))).alias("term")), "asked")
        asked, bound = self.bounds(asked, scorer)
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "epoch", "range")
        first = bound.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
        first = written(first.select("epoch", "range").distinct(), "first-ranges")  # there, all questions are scored
        seen = written(T._ranked(self.scores(asked, first, scorer, k), k, "query_id"), "first-scores")
        least = seen.where(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))
        rest = bound.join(small(first), ["epoch", "range"], "left_anti").join(small(least), "query_id", "left")
        self.passed = rest  # what the threshold decides on, for measurements
        rest = rest.where(F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - SLACK))
        rest = written(rest.select("epoch", "range").distinct(), "other-ranges")
        both = seen.drop("rank").unionByName(self.scores(asked, rest, scorer, k))
        return T._ranked(both, k, "query_id").withColumnRenamed("query_id", query_key)

    def phrases(self, phrases: DataFrame, query: str = "text", query_key: str = "query_id") -> DataFrame:
        """query_id, doc_id, occurrences of phrases: only ranges in which a phrase's every term occurs are read, and there places are shifted and intersected."""
        if self.blocks is None:
            return self.none(phrases, query_key, "occurrences long")
        words = phrases.select(F.col(query_key).alias("query_id"), T.analyze(F.col(query)).alias("_t")).where(F.size("_t") > 0)
        words = written(words.select("query_id", F.size("_t").alias("size"), F.size(F.array_distinct("_t")).alias("kinds"), F.posexplode("_t").alias("off", "term")), "phrase-terms")
        lists = self.lists(words)
        where = lists.select("term", "epoch", "range").join(small(words.select("query_id", "term", "kinds").distinct()), "term")
        where = where.groupBy("query_id", "epoch", "range").agg(F.count(F.lit(1)).alias("_n"), F.max("kinds").alias("_k")).where("_n = _k")
        rows = written(where.select("query_id", "epoch", "range"), "phrase-ranges").join(small(words), "query_id")
        rows = rows.join(lists.select("term", "epoch", "range", F.arrays_zip("doc_id", "places").alias("d")), ["term", "epoch", "range"]).select("query_id", "size", "off", F.inline("d"))
        starts = F.transform("places", lambda p: p - F.col("off"))
        held = rows.withColumn("starts", starts).groupBy("query_id", "doc_id").agg(F.max("size").alias("size"), F.collect_list("starts").alias("s")).where(F.size("s") == F.col("size"))
        common = F.aggregate(F.slice("s", 2, F.size("s")), F.element_at("s", 1), lambda a, b: F.array_intersect(a, b))
        found = held.select("query_id", "doc_id", F.size(common).cast("long").alias("occurrences")).where("occurrences > 0")
        return found.withColumnRenamed("query_id", query_key)

    def top_phrases(self, queries: DataFrame, k: int = 20, query: str = "text", query_key: str = "query_id") -> DataFrame:
        """The k best phrase matches, by the tf score, of questions that pass the gate."""
        gated = queries.where(T.phrase_gate(F.col(query)))
        if self.blocks is None:
            return self.none(queries, query_key, "score double, rank int")
        found = written(self.phrases(gated, query, query_key).select(F.col(query_key).alias("query_id"), "doc_id"), "phrases")
        asked = written(gated.select(F.col(query_key).alias("query_id"), F.explode(T.query_terms(F.col(query))).alias("term"), F.lit(1.0).alias("weight")), "asked")
        lists = self.lists(asked.join(small(found.select("query_id").distinct()), "query_id", "left_semi"))
        # The documents found are few; each is asked for in the blocks of its question's terms.
        rows = lists.select("term", F.inline(F.arrays_zip("doc_id", "tf", "len"))).join(small(found.join(asked, "query_id")), ["term", "doc_id"])
        scored = rows.groupBy("query_id", "doc_id").agg((F.sum(1 + F.log("tf")) / (1 + F.log(F.max("len")))).alias("score"))
        return T._ranked(scored, k, "query_id").withColumnRenamed("query_id", query_key)

    def none(self, queries: DataFrame, query_key: str, rest: str) -> DataFrame:
        return self.spark.createDataFrame([], f"{query_key} {queries.schema[query_key].dataType.simpleString()}, doc_id string, {rest}")

"""The training-data pipeline: language ID, near-duplicate removal, substring dedup, decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next stage's docs. All but the
last return the columns of documents. Rows that share a doc_id stay or go together in
the second stage; rows without doc_id pass it; columns besides those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common as C
from corpusloom.llm import decontamination, language_id, ngram_join, packing, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document's best language must be at least this likely.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the model recognises; lang becomes the prediction where it was null."""
    model = language_id.fit(docs)
    told = language_id.predict(docs.select(*COLUMNS), model)
    kept = told.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of similar documents the one with the smallest doc_id; five words a shingle, Jaccard 0.8."""
    docs = docs.select(*COLUMNS)
    found = ngram_join.similar(docs, k=5, share=(80, 100))
    others = C.materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "duplicates")
    return C.by_ids(docs, others, "doc_id", "left_anti").select(*COLUMNS)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document has, and documents of which nothing is left."""
    cut = substring_dedup.dedup(docs.select(*COLUMNS))
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return left.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long")).alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark passages contaminate, which their text alone decides."""
    docs = docs.select(*COLUMNS).withColumn("_digest", F.md5("text"))
    found = decontamination.match(docs.select("_digest", "text"), C.table(spark, sf_dir, "benchmark"), keep=["_digest"])
    others = C.materialize(found.where(decontamination.contaminated()).select("_digest").distinct(), "contaminated")
    return C.by_ids(docs, others, "_digest", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    parts = C.materialize(packing.pieces(docs.select("doc_id", "text")), "pieces")
    return packing.pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", remove_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Naive Bayes, gear hashing and byte-level BPE can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = len(C.WRITTEN)
        docs = C.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        C.clear(spark, before, keep=("/pipeline-",))  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)

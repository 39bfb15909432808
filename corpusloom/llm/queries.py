"""One query for each operator over its whole table, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common as C
from corpusloom.llm import concatenation, decontamination, html_extract, language_id, maxent_lm, ngram_join, oracles, packing, quality, resampling, sharding, simhash, spelling, substring_dedup

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(C.fold(F.col("doc_id"), 4) != 2))
    out = language_id.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (C.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(C.table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs).select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), "n_removed", "spans", "owners")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(C.table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.match(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontamination.items_digest().alias("items_sha256"), decontamination.contaminated().alias("contaminated"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = C.materialize(packing.pieces(C.table(spark, sf_dir, "documents")), "pieces")
    return packing.pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_within: other rows within Hamming radius 3, for ids divisible by 50, else null."""
    rows = C.materialize(simhash.fingerprint_edits(C.table(spark, sf_dir, "documents")), "simhash")
    asked = rows.where(F.col("doc_id") % 50 == 0)
    counted = rows.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"))
    pairs = simhash.near(asked, rows, 3)
    reached = pairs.join(counted.select(F.col("hi").alias("other_hi"), F.col("lo").alias("other_lo"), "n"), ["other_hi", "other_lo"]).groupBy("hi", "lo").agg((F.sum("n") - 1).alias("n_within"))
    out = rows.join(reached, ["hi", "lo"], "left")
    like = lambda k: simhash.likeness(F.col("hi"), F.col("lo"), F.col(f"{k}_hi"), F.col(f"{k}_lo"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", simhash.hexadecimal(F.col("hi"), F.col("lo")).alias("fingerprint"), simhash.hexadecimal(F.col("edited_hi"), F.col("edited_lo")).alias("edited_fingerprint"),
        like("edited").alias("near_edited"), like("next").alias("near_next"), F.when(F.col("doc_id") % 50 == 0, F.col("n_within")).alias("n_within"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    model = quality.fit(docs.where(C.fold(F.col("doc_id"), 3) != 1), labels.where(C.fold(F.col("doc_id"), 3) != 1))
    out = quality.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (C.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(C.table(spark, sf_dir, "pages"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = C.fold(F.col("doc_id"), 5) == 1
    out = maxent_lm.score(docs.withColumn("held_out", held_out), *maxent_lm.fit(docs.where(~held_out)), keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(C.table(spark, sf_dir, "documents"), drop_one_in=199)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = C.materialize(concatenation.tokenized(C.table(spark, sf_dir, "documents")), "tokens")
    return concatenation.pieces(stored, 1024).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": op1_language_id,
        "op2_ngram_join": op2_ngram_join,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_sharding": op4_sharding,
        "op5_decontamination": op5_decontamination,
        "op6_packing": op6_packing,
        "op7_simhash": op7_simhash,
        "op8_language_model": op8_language_model,
        "op9_quality": op9_quality,
        "op10_html_extraction": op10_html_extraction,
        "op11_spelling": op11_spelling,
        "op12_packing": op12_packing,
        "op13_resampling": op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)

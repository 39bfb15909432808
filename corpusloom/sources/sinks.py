"""Sinks and jobs: full refresh, insert if absent, upsert, resume, request packing, indexes, events and state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.fulltext import analyze, documents_with_terms, positions
from corpusloom.sources import index_writer, versions

INPUTS_A_REQUEST, INPUTS_A_BATCH = 100, 50_000
PHASES = ["init", "prepared", "submitted", "collecting", "done"]


# ---- tables


def documents_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, court, court_level, year (0 unknown), title, content, terms of documents long enough; one row an id."""
    path, t = F.col(key).cast("string"), F.col(text)
    rows = docs.where(X.long_enough(t)).select(path.alias("doc_id"), X.court(path).alias("court"), X.year_int(X.year_text(path)).alias("year"), F.left(X.title(t), F.lit(200)).alias("title"), F.translate(t, "\t\r", " ").alias("content"))
    rows = rows.withColumn("court_level", X.court_level(F.col("court"))).withColumn("terms", analyze(F.col("content")))
    return rows.dropDuplicates(["doc_id"])


def refresh(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> None:
    """Replaces a Parquet table; sorting within files keeps their column ranges narrow, which is what prunes later scans."""
    df = df.sortWithinPartitions(*sort_by) if sort_by else df
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def replaced(df: DataFrame, base: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> str:
    """Like refresh, but beside the live version, which goes on until the new one is whole (`versions.read` reads it). Returns where the new one is."""
    return versions.refresh(df.sparkSession, base, lambda path: refresh(df, path, partition_by, sort_by))


def load_chunks(chunks: DataFrame, base: str, dims: int = 2000, digits: int = 8) -> str:
    """Full refresh of the table of chunks: vectors cut to `dims` and rounded as bulk loaders write them, one row an id; chunks without a vector go. A load that fails leaves the old table."""
    cut = F.transform(F.slice("embedding", 1, dims), lambda x: F.round(x.cast("double"), digits).cast("float"))
    rows = chunks.where(F.size("embedding") > 0).withColumn("embedding", cut).withColumn("id", X.vector_id(F.col("doc_id"), F.col("chunk_index")))
    return replaced(rows.dropDuplicates(["id"]), base, ["court_level"], ["year", "doc_id"])


def postings_table(docs: DataFrame, name: str, buckets: int = 64) -> None:
    """Saves positions bucketed by term, so that joins on terms read them without a shuffle."""
    positions(documents_with_terms(docs)).write.mode("overwrite").bucketBy(buckets, "term").sortBy("term", "doc_id").saveAsTable(name)


def analyze_table(spark: SparkSession, name: str, columns: list[str] | None = None) -> None:
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(columns)}" if columns else ""))


def missing(required: DataFrame, existing: DataFrame) -> DataFrame:
    """Required rows that don't exist, each once."""
    return required.subtract(existing)


def missing_indexes(spark: SparkSession, required: list[str], existing: list[str]) -> DataFrame:
    """Required ones that don't exist."""
    names = lambda x: spark.createDataFrame([(v,) for v in x], "name string")
    return missing(names(required), names(existing))


# ---- keyed writes


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of new whose key isn't there yet, one a key."""
    first = Window.partitionBy(*keys).orderBy(*(order or [F.lit(1)]))
    once = new.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r") if order else new.dropDuplicates(keys)
    return once.join(existing.select(*keys), keys, "left_anti")


def absent(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows whose key the table at `path` doesn't hold; all of them while there is none."""
    held = existing(df.sparkSession, path)
    return df if held is None else resume(df, held, keys)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def append_new(df: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> None:
    """Appends rows whose key isn't there yet, one a key."""
    absent(df.dropDuplicates(keys), path, keys).write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def insert_counts(new: DataFrame, inserted: DataFrame) -> DataFrame:
    """inserted, skipped"""
    both = new.agg(F.count(F.lit(1)).alias("n")).crossJoin(inserted.agg(F.count(F.lit(1)).alias("inserted")))  # one row each
    return both.select("inserted", (F.col("n") - F.col("inserted")).alias("skipped"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last writer wins: of each key the row of the highest version; on equal versions the new one."""
    rows = existing.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.desc("_n"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_n")


def done_set(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that any of the parts (stored tables, reports of batches) has done, each once."""
    if not parts:
        raise ValueError("no parts")
    return reduce(DataFrame.union, [p.select(*keys) for p in parts]).distinct()


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't done yet."""
    return todo.join(done.select(*keys), keys, "left_anti")


# ---- vectors


def vector_records(chunks: DataFrame) -> DataFrame:
    """id, values, metadata of chunks with embeddings."""
    meta = F.struct("doc_id", "court", "year", F.left("title", F.lit(500)).alias("title"), "chunk_index", "court_level", "subcourt", "jurisdiction")
    return chunks.select(X.vector_id(F.col("doc_id"), F.col("chunk_index")).alias("id"), F.col("embedding").alias("values"), meta.alias("metadata"))


def vector_literal(v: Column, digits: int = 8) -> Column:
    """A vector as bulk loaders write it."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), ","), F.lit("]"))


def request_packing(chunks: DataFrame, model: str, dims: int, idx: str = "idx", text: str = "text", per_request: int = INPUTS_A_REQUEST, per_batch: int = INPUTS_A_BATCH) -> DataFrame:
    """batch, custom_id, request (JSON) of chunks numbered from 0: so many inputs a request and a batch."""
    at = F.col(idx)
    rows = chunks.select(F.floor(at / per_batch).alias("batch"), F.floor((at % per_batch) / per_request).alias("_q"), at.alias("idx"), F.col(text).alias("text"))
    packed = rows.groupBy("batch", "_q").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("input"))
    start = F.col("_q") * per_request
    name = F.concat(F.lit("b"), F.col("batch").cast("string"), F.lit("-r"), start.cast("string"), F.lit("-s"), (F.col("batch") * per_batch + start).cast("string"))
    body = F.struct(F.lit(model).alias("model"), F.col("input"), F.lit(dims).alias("dimensions"))
    packed = packed.withColumn("custom_id", name)
    request = F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit("/v1/embeddings").alias("url"), body.alias("body")))
    return packed.select("batch", "custom_id", F.size("input").alias("inputs"), request.alias("request"))


def numbered(df: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """Numbers rows from 0 in a fixed order without one task for all: range partitions are sorted, counted and shifted."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    from corpusloom.session import work_path

    path = work_path(spark, "numbered")  # written once, so that partitions stay what they were when counted
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    shift = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))  # one row a partition
    row = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return rows.withColumn("_r", row).join(F.broadcast(shift), "_p").withColumn(out, F.col("_s") + F.col("_r") - 1).drop("_p", "_r", "_s")


# ---- indexes and events as JSON


def by_year(entries: DataFrame, key: str = "court") -> DataFrame:
    """A court's index: total and, by falling year, its entries; a blank year counts as unknown."""
    year = F.coalesce(F.nullif(F.col("year"), F.lit("")), F.lit("unknown"))
    rows = entries.withColumn("_y", year).groupBy(key, "_y").agg(F.sort_array(F.collect_list(F.struct("file_path", "url", "title", "court", "year", "date"))).alias("_e"), F.count(F.lit(1)).alias("_n"))
    grouped = rows.groupBy(key).agg(F.sum("_n").alias("total"), F.sort_array(F.collect_list(F.struct("_y", "_e")), asc=False).alias("_x"))
    return grouped.select(key, "total", F.map_from_entries("_x").alias("by_year"))


def write_index(entries: DataFrame, path: str, scraped_at: str, key: str = "court") -> None:
    """Indexes as nested JSON, <court>.json for each court, written as sorted streams."""
    index_writer.write(entries, path, scraped_at, key)


def event_text(event: Column, data: Column) -> Column:
    """A server-sent event; line ends in its data are escaped."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.replace(data, F.lit("\n"), F.lit("\\n")), F.lit("\n\n"))


def log_line(event: str, **fields: Column) -> Column:
    """A structured log record."""
    return F.to_json(F.struct(F.lit(event).alias("event"), *[c.alias(k) for k, c in fields.items()]))


def error_log(results: DataFrame, path: str) -> None:
    """Failed rows (path, error) as tab-separated text."""
    results.where("status = 'fail'").select("path", "error").write.mode("overwrite").option("sep", "\t").csv(path)


def download_stats(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


# ---- job state: a small JSON record with guarded phases


def load_state(spark: SparkSession, path: str, required: bool = False) -> dict:
    """The last state written, or a fresh one; with `required` a missing state is an error, as a lost one must not pass for a run that has nothing to do."""
    state = versions.current(spark, path)
    if state is None and required:
        raise FileNotFoundError(f"no state in {path}: prepare the run, or restore what was lost")
    return state or {"phase": "init", "batches": []}


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    """Replaces the state in one step; a phase may stay, move one step on, or start over."""
    old, new = load_state(spark, path)["phase"], state["phase"]
    if new not in PHASES or PHASES.index(new) not in (0, PHASES.index(old), PHASES.index(old) + 1):
        raise ValueError(f"phase can't go from {old} to {new}")
    versions.publish(spark, path, state)


def uncollected(batches: DataFrame) -> DataFrame:
    """Finished batch jobs whose output is still to be fetched."""
    return batches.where("status = 'completed' and not coalesce(collected, false) and output_file_id is not null")

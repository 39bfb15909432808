"""The event log of query sessions, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with zone; sessions run in UTC."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def read_stream(spark: SparkSession, path: str, files: str = "*.parquet", schema: str = EVENTS, files_a_trigger: int = 100) -> DataFrame:
    """Events as files arrive in a folder; `files` picks them by name."""
    return timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).option("pathGlobFilter", files).parquet(path))


def gaps(events: DataFrame, session: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Seconds since the session's event before."""
    w = Window.partitionBy(session).orderBy(ts, tie)
    return events.withColumn("gap_s", F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w)))


def longest_gap(events: DataFrame, session: str = "user_id") -> DataFrame:
    return gaps(events, session).groupBy(session).agg(F.max("gap_s").alias("max_gap_s"), F.count(F.lit(1)).alias("events"))


def numbered(events: DataFrame, session: str = "user_id") -> DataFrame:
    """Step numbers from 1."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(session).orderBy("ts", "event_id")))


def running_totals(events: DataFrame, session: str = "user_id", value: str = "value") -> DataFrame:
    w = Window.partitionBy(session).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("running_n", F.count(F.lit(1)).over(w)).withColumn("running_value", F.sum(value).over(w))


def sessions(events: DataFrame, gap: str = "30 minutes", session: str = "user_id") -> DataFrame:
    """Runs of a user's events with pauses below the gap; works on batches and streams."""
    got = events.groupBy(session, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return got.select(session, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")


def windows(events: DataFrame, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling or sliding window and type, with late events up to the watermark."""
    got = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "value")


def first_seen(stream: DataFrame, session: str, doc: str, late: str = "1 hour") -> DataFrame:
    """Each document of a session once, remembered as long as the watermark says."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([session, doc])


def totals(stream: DataFrame, session: str = "user_id") -> DataFrame:
    """Running totals of a stream, for update or complete mode."""
    return stream.groupBy(session).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns the result table; for tests and small backfills (the result is in the driver's memory)."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def keep_alive(events: DataFrame, every: int = 5, session: str = "user_id") -> DataFrame:
    """A progress event for each full batch of `every` events of a session: session, batch, done, ts of the batch's last event."""
    order = Window.partitionBy(session).orderBy("ts", "event_id")
    rows = events.withColumn("done", F.row_number().over(order)).where(F.col("done") % every == 0)
    return rows.select(session, (F.col("done") / every).cast("long").alias("batch"), F.col("done").cast("long").alias("done"), "ts")


def answered(asked: DataFrame, answers: DataFrame, within: str = "30 minutes", late: str = "10 minutes", session: str = "user_id") -> DataFrame:
    """Pairs of a session's events and their answers within a time: a join of two streams (or tables) whose state the watermarks bound."""
    a = asked.withWatermark("ts", late).select(F.col(session), F.col("event_id").alias("asked_id"), F.col("ts").alias("asked_ts"))
    b = answers.withWatermark("ts", late).select(F.col(session).alias("_s"), F.col("event_id").alias("answer_id"), F.col("ts").alias("answer_ts"))
    on = (F.col(session) == F.col("_s")) & (F.col("answer_ts") >= F.col("asked_ts")) & (F.col("answer_ts") <= F.col("asked_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on).select(session, "asked_id", "answer_id", (F.unix_timestamp("answer_ts") - F.unix_timestamp("asked_ts")).alias("after_s"))

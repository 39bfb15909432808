"""Streams over small fixtures: order, repeats, late events, restarts."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.plans import catalog_jobs
from corpusloom.session import work_path
from corpusloom.streaming import event_sink, gate
from corpusloom.streaming import events as E

HOUR = timedelta(hours=1)
START = datetime(2024, 1, 1)
SCHEMA = "user_id long, event_id long, ts timestamp, kind string, n long, doc_id string"


def gated(spark, folder, name, *files, late="10 minutes"):
    """Each of `files` is one micro-batch of (user, minute, kind, n, doc)."""
    k = 0
    for j, rows in enumerate(files):
        data = []
        for user, minute, kind, n, doc in rows:
            data.append((user, k, START + timedelta(minutes=minute), kind, n, doc))
            k += 1
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{folder}/{j:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    got = E.run_once(gate.all_arrived(stream, late=late), name, "append", work_path(spark, name))
    return sorted((r.user_id, (r.at.replace(tzinfo=None) - START) // timedelta(minutes=1), r.expected, r.summarized, r.complete) for r in got.collect())


def test_gate(spark, tmp_path):
    """Announcement before, between and after summaries; repeats; a session told once; one that never completes."""
    first = [(1, 0, "expected", 2, None), (1, 1, "summary", None, "a"), (2, 0, "summary", None, "a"), (2, 1, "summary", None, "a"), (3, 0, "summary", None, "x"), (4, 0, "expected", 3, None), (5, 0, "summary", None, "q")]
    second = [(1, 2, "summary", None, "a"), (1, 3, "summary", None, "b"), (2, 2, "expected", 1, None), (3, 5, "expected", 0, None), (4, 9, "summary", None, "z"), (4, 10, "expected", None, None), (4, 11, "summary", None, None)]
    third = [(1, 4, "summary", None, "c"), (9, 500, "summary", None, "z")]
    got = gated(spark, tmp_path, "gate_orders", first, second, third)
    assert got == [(1, 3, 2, 2, True), (2, 2, 1, 1, True), (4, 11, 3, 1, False)]


def test_gate_session_comes_again(spark, tmp_path):
    """After a pause, in the same micro-batch or a later one, everything counts anew."""
    rows = [(1, 0, "expected", 1, None), (1, 1, "summary", None, "a"), (1, 100, "expected", 1, None), (1, 101, "summary", None, "a"), (2, 0, "expected", 2, None), (2, 1, "summary", None, "a"), (2, 90, "summary", None, "b")]
    got = gated(spark, tmp_path, "gate_again", rows, [(8, 300, "summary", None, "z")], [(1, 320, "expected", 1, None), (1, 321, "summary", None, "a")])
    assert got == [(1, 1, 1, 1, True), (1, 101, 1, 1, True), (1, 321, 1, 1, True), (2, 1, 2, 1, False)]


def test_gate_late_events(spark, tmp_path):
    """Behind the watermark of the batch before an event is dropped; ahead of it, it counts."""
    got = gated(spark, tmp_path, "gate_late", [(1, 60, "expected", 2, None), (2, 60, "expected", 1, None)], [(1, 55, "summary", None, "a")], [(2, 20, "summary", None, "a"), (1, 61, "summary", None, "b")], [(9, 400, "summary", None, "z")])
    assert got == [(1, 61, 2, 2, True), (2, 60, 1, 0, False)]


@pytest.mark.parametrize("parts", [1, 4])
def test_gate_is_the_window_query(spark, sf, tmp_path, parts):
    """Micro-batches in order of time give what SQL gives for the whole log."""
    log = E.timed(spark.read.parquet(f"{sf}/events.parquet"))
    bounds = [r[0] for r in log.select(F.percentile_approx("event_id", [k / parts for k in range(1, parts)], 100_000).alias("b") if parts > 1 else F.array().alias("b")).collect()][0]
    for k, (low, high) in enumerate(zip([-1, *bounds], [*bounds, 1 << 60], strict=True)):
        log.where((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(1).write.parquet(str(tmp_path / f"{k:03d}"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    got = E.run_once(gate.all_arrived(catalog_jobs.announced(stream), idle=6 * HOUR), f"gate_sql_{parts}", "append", work_path(spark, "gate"))
    rows = {(r.user_id, r.b, r.a, r.expected, r.summarized, r.complete) for r in got.select("*", F.unix_micros("began").alias("b"), F.unix_micros("at").alias("a")).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = set(con.sql(catalog_jobs.GATE).fetchall())
    assert rows == want and any(r[5] for r in want) and not all(r[5] for r in want)


def test_gate_of_nothing(spark, tmp_path):
    assert gated(spark, tmp_path, "gate_none", []) == []


# ---- the durable sink

TOLD = "user_id long, event_id long, ts timestamp, event string"


def told(spark, folder, *files):
    for j, rows in enumerate(files, len(list(folder.glob("*")))):
        data = [(u, k, START + timedelta(minutes=m), e) for u, k, m, e in rows]
        spark.createDataFrame(data, TOLD).repartition(2).write.parquet(f"{folder}/{j:03d}")
    return spark.readStream.schema(TOLD).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(str(folder))


def heard(spark, path, since=-1):
    rows = event_sink.in_order(event_sink.read_events(spark, path, "user_id long, event_id long, event string", since)).collect()
    return sorted((r.user_id, r.seq, r.event_id) for r in rows)


def test_sink_keeps_order_and_tells_nothing_twice(spark, tmp_path):
    """After a restart between the sink's commit and the stream's, the batch runs again and changes nothing; then more comes."""
    source, path, state = tmp_path / "in", f"file://{tmp_path}/log", tmp_path / "state"
    source.mkdir()
    first = [(u, k, (k * 7) % 10, "token") for k in range(10) for u in (1, 2)]
    event_sink.write_events(told(spark, source, first), path, str(state)).awaitTermination()
    want = [(u, n + 1, k) for u in (1, 2) for n, k in enumerate(sorted(range(10), key=lambda k: ((k * 7) % 10, k)))]
    assert heard(spark, path) == want
    last = max(int(p.name) for p in (state / "commits").iterdir() if p.name.isdigit())
    for p in (state / "commits").iterdir():
        if p.name.strip(".").startswith(str(last)):
            p.unlink()
    stray = tmp_path / "log" / "data" / "stray.jsonl"  # of a task that was lost
    stray.write_text('{"place": 0, "user_id": 1, "event_id": 99, "event": "token"}\n')
    files = len(list((tmp_path / "log" / "data").iterdir()))
    event_sink.write_events(told(spark, source), path, str(state)).awaitTermination()
    assert heard(spark, path) == want and len(list((tmp_path / "log" / "data").iterdir())) == files
    event_sink.write_events(told(spark, source, [(1, 50, 3, "done")]), path, str(state)).awaitTermination()
    assert heard(spark, path) == sorted([*want, (1, 11, 50)])
    assert heard(spark, path, since=last) == [(1, 1, 50)]


def test_sink_of_nothing(spark, tmp_path):
    assert heard(spark, f"file://{tmp_path}/none") == []

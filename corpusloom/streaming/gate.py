"""A gate for the event stream: a session's results show once all summaries that were announced have arrived.

State lives in a keyed store, in event time: the announced number, the documents summarised
so far (a list, so that one more document writes one more entry), and the session's last
event. A micro-batch reads a session's state once and writes what is left of it once; calls to
the store don't grow with the events of sessions that end within it. An event-time timer ends a
session after a pause; with no events left, nothing runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from corpusloom.session import code_path

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_store(spark: SparkSession) -> None:
    """Chooses the state store that several states and timers a key need; for streams started afterwards."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Gate(StatefulProcessor):
    """Handles a session's events in the order of their time and, at the same time, of their ids."""

    def __init__(self, session: str, idle_ms: int):
        self.session, self.idle_ms = session, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "began long, last long, expected long, summarized long, told boolean")
        self.docs = handle.getListState("docs", "doc_id string")

    def frame(self, key: tuple, told: list[tuple]) -> pd.DataFrame:
        """Rows of (began, at, expected, summarized, complete), times in microseconds."""
        began, at, expected, summarized, complete = zip(*told, strict=True)
        time = lambda us: pd.DatetimeIndex(np.array(us, "datetime64[us]")).tz_localize("UTC")
        return pd.DataFrame({self.session: [key[0]] * len(told), "began": time(began), "at": time(at), "expected": expected, "summarized": summarized, "complete": complete})

    def unmet(self, about: tuple) -> list[tuple]:
        """A session that announced summaries and never got them all is told as incomplete."""
        return [(*about[:4], False)] if about[2] > 0 and not about[4] else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events: list[tuple] = []
        for part in rows:
            at = part["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
            events += zip(at, *(part[c].tolist() for c in ("event_id", "kind", "n", "doc_id")), strict=True)
        events.sort(key=lambda e: e[:2])
        stored = self.about.get()
        about, kept = stored, stored is not None
        known = {d for (d,) in self.docs.get()} if kept else set()
        new: dict[str, None] = {}
        out: list[tuple] = []
        for at, _, kind, n, doc in events:
            if about and at > about[1] + self.idle_ms * 1000:
                out += self.unmet(about)
                about, kept, known, new = None, False, set(), {}
            began, last, expected, summarized, told = about or (at, at, -1, 0, False)
            if kind == "expected" and not pd.isna(n):
                expected = int(n)
            elif kind == "summary" and not pd.isna(doc) and doc not in new and doc not in known:
                new[doc] = None
                summarized += 1
            about = (min(began, at), max(last, at), expected, summarized, told)
            if not told and 0 < expected <= summarized:
                out.append((about[0], at, *about[2:4], True))
                about = (*about[:4], True)
        if stored and not kept:
            self.docs.clear()
        if new:
            self.docs.appendList([(doc,) for doc in new])
        self.about.update(about)
        if stored:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
        self.handle.registerTimer(about[1] // 1000 + self.idle_ms)
        if out:
            yield self.frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        about = self.about.get()
        out = self.unmet(about) if about else []
        self.docs.clear()
        self.about.clear()
        if out:
            yield self.frame(key, out)

    def close(self) -> None:
        pass


def all_arrived(stream: DataFrame, session: str = "user_id", idle: timedelta = timedelta(hours=1), late: str = "10 minutes") -> DataFrame:
    """session, began, at, expected, summarized, complete: one row a session, of events (session, event_id, ts, kind: expected or summary, n, doc_id).

    A session is complete with the event at which as many different documents have summaries as
    the last announcement says; later events of it change nothing. A pause of more than
    `idle` ends a session; one with an announcement that wasn't met gives a row that says so, once
    the watermark has passed its last event by `idle`. Events later than the watermark are
    dropped. A summary that repeats counts once; null documents and announcements don't count.
    Events of a session within a micro-batch are taken in order of time, so how files
    are dealt to batches matters only for events out of order between batches.
    """
    keyed_store(stream.sparkSession)
    code_path(stream.sparkSession)
    kind = stream.schema[session].dataType.simpleString()
    schema = StructType.fromDDL(f"{session} {kind}, began timestamp, at timestamp, expected long, summarized long, complete boolean")
    rows = stream.withWatermark("ts", late).select(session, "event_id", "ts", "kind", F.col("n").cast("long").alias("n"), F.col("doc_id").cast("string").alias("doc_id"))
    return rows.groupBy(session).transformWithStateInPandas(Gate(session, int(idle.total_seconds() * 1000)), schema, "Append", "EventTime")

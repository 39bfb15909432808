"""What must not grow with the input in the driver or in a task."""

import json
import weakref
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import chunker
from corpusloom.sources import files, markdown_tree
from corpusloom.streaming import event_sink, gate


class Row:
    """A row that can be watched; tuples can't."""

    def __init__(self, **values):
        self.values = values

    def asDict(self, recursive):  # noqa: N802
        return self.values


class Store:
    """A session's state and timers in memory; calls are counted."""

    def __init__(self):
        self.value, self.held, self.timers, self.calls = None, set(), [], 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def appendList(self, rows):  # noqa: N802
        self.calls += 1
        self.held |= set(rows)

    def clear(self):
        self.calls += 1
        self.value, self.held = None, set()

    def listTimers(self):  # noqa: N802
        self.calls += 1
        return list(self.timers)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)


def test_gate_calls_do_not_grow_with_events():
    """Sessions that end within a micro-batch cost no call to the store, and only the last one's documents stay."""
    got = gate.Gate("user_id", int(timedelta(hours=1).total_seconds() * 1000))
    got.handle = got.about = got.docs = None
    stores = got.handle, got.about, got.docs = Store(), Store(), Store()
    day = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=600, freq="10min").repeat(2), "event_id": range(1200)})
    day["ts"] += pd.to_timedelta(day.index // 12 * 2, unit="h")
    told = day.assign(kind=["expected", "summary"] * 600, n=2, doc_id=[None, "a", None, "b"] * 300)
    rows = pd.concat(got.handleInputRows((1,), iter([told[700:], told[:700]]), None))
    assert len(rows) == 100 and rows["complete"].all()
    assert sum(s.calls for s in stores) < 10 and got.docs.held == {("a",), ("b",)} and len(got.handle.timers) == 1


def test_tree_reads_are_not_listed_by_the_driver(spark, tmp_path):
    """Names of files reach no file index of the driver; hidden files and other suffixes aren't read."""
    root = tmp_path / "md"
    docs = spark.createDataFrame([(f"{i % 3}/{i % 7}/ü {i}%.md", f"text of document {i}\r\n") for i in range(60)], "doc_id string, text string")
    assert markdown_tree.write(docs, str(root)).where("status = 'written'").count() == 60
    (root / "0" / "_hidden.md").write_text("no")
    (root / "0" / "other.txt").write_text("no")
    for place in (str(root), f"file://{root}"):
        got = files.markdown_corpus(spark, place)
        assert {(r.doc_id, r.text) for r in got.collect()} == {(r.doc_id, r.text) for r in docs.collect()}
        assert not [f for f in got.inputFiles() if f.endswith(".md")]
    assert [r.doc_id for r in files.markdown_corpus(spark, str(root), court="1/", limit=2).collect()] == sorted(r.doc_id for r in docs.where(F.contains("doc_id", F.lit("1/"))).collect())[:2]
    with pytest.raises(FileNotFoundError):
        files.markdown_corpus(spark, str(tmp_path / "none"))


def test_sink_holds_one_row_at_a_time(tmp_path):
    """A task's rows go to its file as they come."""
    seen, most = [], [0]

    def rows():
        for k in range(5000):
            row = Row(user_id=1, event_id=k)
            seen.append(weakref.ref(row, lambda r: seen.remove(r)))
            most[0] = max(most[0], len(seen))
            yield row
            del row

    told = event_sink.Writer(f"file://{tmp_path}", 0).write(rows())
    lines = (tmp_path / "data" / told.file).read_text().splitlines()
    assert told.rows == 5000 and json.loads(lines[-1]) == {"place": 4999, "user_id": 1, "event_id": 4999}
    assert most[0] <= 3


def test_records_clean_a_text_once(spark):
    """The filter and the columns share one cleaned text: a pass for links stands in the plan as often as there are passes."""
    docs = spark.createDataFrame([("a/1.md", "# T\nSubject: s\n" + "words " * 20), ("a/2.md", "*" * 60)], "doc_id string, text string")
    got = chunker.document_records(docs)
    assert [r.doc_id for r in got.collect()] == ["a/1.md"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("-_]{3,}$") == 1


def test_chunks_take_one_python_step(spark):
    """Links, what follows them and the splitting are one function, which says what the column rules say."""
    odd = ["a\x85b\x1c \x9f", " x\xa0y‑z­͘　", "---\n-_-\r\n___\n\n\n\nq  r\n---", "[a [b](c)](d) --- \x1c", "᠎﻿ \v\f ", "", "\n---"]
    docs = spark.createDataFrame(list(enumerate(odd)), "i int, t string")
    for r in docs.select("t", X.after_links(F.col("t")).alias("want")).collect():
        assert chunker.after_links(r.t) == r.want
    got = chunker.chunk_documents(spark.createDataFrame([("a/1.md", "# T\n" + "words [x [y](z)](w) " * 400)], "doc_id string, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert [r.chunk_index for r in got.collect()] == list(range(got.count())) and "[" not in got.first().text

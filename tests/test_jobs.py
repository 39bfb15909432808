"""Jobs that end midway: embedding batches, states and loads."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import embedding_jobs as J
from corpusloom.sources import sinks, versions


class Service:
    """A batch service in memory. `ends` raises after the n-th submission has arrived, as a driver that dies would."""

    def __init__(self, spark, fails=(), ends=None):
        self.spark, self.jobs, self.fails, self.ends = spark, [], set(fails), ends

    def submit(self, requests):
        self.jobs.append(requests)
        if self.ends == len(self.jobs):
            self.ends = None
            raise KeyboardInterrupt
        return f"job{len(self.jobs) - 1}"

    def find(self, requests):
        return next((f"job{k}" for k, r in enumerate(self.jobs) if r == requests), None)

    def status(self, job):
        return ("failed", None) if job in self.fails else ("completed", f"out-{job}")

    def fetch(self, output, folder):
        requests = self.jobs[int(output.removeprefix("out-job"))]
        for_each = "transform(from_json(get_json_object(value, '$.body.input'), 'array<string>'), (t, i) -> named_struct('index', i, 'embedding', array(cast(length(t) as double), 1.0D)))"
        body = f"to_json(named_struct('custom_id', get_json_object(value, '$.custom_id'), 'response', named_struct('status_code', 200, 'body', named_struct('data', {for_each})))) AS value"
        self.spark.read.text(requests).selectExpr(body).write.mode("overwrite").text(folder)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/jobs"


@pytest.fixture
def chunks(spark, monkeypatch):
    monkeypatch.setattr(sinks, "INPUTS_A_BATCH", 100)
    return spark.range(250).select(F.col("id").alias("idx"), F.concat(F.lit("text "), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int"))).alias("text"), F.concat(F.lit("d"), "id").alias("doc_id"))


def test_run_to_its_end(spark, folder, chunks):
    state = J.prepare(chunks, folder, "m", 2)
    assert state["phase"] == "prepared" and state["batches"]
    service = Service(spark, fails={"job0"})
    done = J.run(spark, folder, service, pause=0)
    assert done["phase"] == "done" and all(b["collected"] for b in done["batches"]) and len(service.jobs) == len(state["batches"]) + 1
    assert J.status(done) == {"collected": len(state["batches"])}
    got = J.embedded_chunks(spark, folder, 1)
    assert got.count() == 250 and got.where(F.element_at("embedding", 1) != F.length("text")).count() == 0


def test_a_driver_that_ends_submits_nothing_twice(spark, folder, chunks):
    J.prepare(chunks, folder, "m", 2)
    service = Service(spark, ends=1)
    with pytest.raises(KeyboardInterrupt):
        J.run(spark, folder, service, pause=0)
    with pytest.raises(RuntimeError, match="still run"):
        J.prepare(chunks, folder, "m", 2)
    done = J.run(spark, folder, service, pause=0)
    assert done["phase"] == "done" and len(service.jobs) == len(set(service.jobs)) == len(done["batches"])


def test_a_lost_state_is_no_finished_run(spark, folder):
    with pytest.raises(FileNotFoundError):
        J.run(spark, folder, Service(spark), pause=0)


def test_a_run_that_goes_on_says_so(spark, folder, chunks):
    J.prepare(chunks, folder, "m", 2)
    service = Service(spark)
    service.status = lambda job: ("in_progress", None)
    with pytest.raises(TimeoutError, match="in_progress"):
        J.run(spark, folder, service, pause=0, polls=2)


def test_state_that_fails_midway_stays(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/state"
    sinks.save_state(spark, path, {"phase": "prepared", "batches": [1]})

    def torn(*_):
        raise OSError("disk full")

    monkeypatch.setattr(versions.json, "dumps", torn)
    with pytest.raises(OSError, match="disk full"):
        sinks.save_state(spark, path, {"phase": "submitted", "batches": [1]})
    monkeypatch.undo()
    assert sinks.load_state(spark, path) == {"phase": "prepared", "batches": [1]}


def test_load_of_chunks(spark, tmp_path):
    base = f"file://{tmp_path}/chunks"
    rows = [("supreme/2010/a.md", 0, "supreme", 2010, [0.123456789012, 1.0, 2.0]), ("supreme/2010/a.md", 0, "supreme", 2010, [0.123456789012, 1.0, 2.0]), ("b.md", 1, "other", 0, [1.0, 2.0, 3.0]), ("c.md", 0, "other", 0, None)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_index int, court_level string, year int, embedding array<double>")
    sinks.load_chunks(chunks, base, dims=2)
    got = {r.doc_id: r.embedding for r in versions.read(spark, base).collect()}
    assert got == {"supreme/2010/a.md": [pytest.approx(0.12345679, abs=1e-8), 1.0], "b.md": [1.0, 2.0]}
    bad = chunks.withColumn("year", F.col("doc_id").cast("int"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sinks.load_chunks(bad, base)
    assert versions.read(spark, base).count() == 2
    assert json.dumps(versions.current(spark, base))

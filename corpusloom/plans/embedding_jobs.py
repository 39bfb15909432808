"""The life of asynchronous embedding batches over tables: prepare, submit, poll, collect, resume. The remote service is a client that the caller gives."""

from __future__ import annotations

import time
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import files, sinks

FAILED = ("failed", "expired", "cancelled")
#: A batch that is being handed over.
SUBMITTING = "submitting"
STATES = "batch long, job string, status string, output_file_id string, collected boolean"


class Client(Protocol):
    """A batch service. `requests` is a folder of JSON lines; `find` tells the job that a folder was submitted as, None if it wasn't; `fetch` writes a finished job's JSON lines below a folder."""

    def submit(self, requests: str) -> str: ...

    def find(self, requests: str) -> str | None: ...

    def status(self, job: str) -> tuple[str, str | None]: ...

    def fetch(self, output: str, folder: str) -> None: ...


# ---- predicates over the table of batches


def to_submit(batches: DataFrame) -> DataFrame:
    """Batches without a job, or whose job failed, expired or was cancelled."""
    return batches.where(F.col("job").isNull() | F.col("status").isin(*FAILED))


def running(batches: DataFrame) -> DataFrame:
    """Submitted batches that are neither finished nor failed."""
    return batches.where(F.col("job").isNotNull() & ~F.coalesce(F.col("status"), F.lit("")).isin("completed", *FAILED))


def broken(batches: DataFrame) -> DataFrame:
    return batches.where(F.col("status").isin(*FAILED))


to_collect = sinks.uncollected


def finished(batches: DataFrame) -> bool:
    """Whether every batch's output has been fetched."""
    return batches.where("not coalesce(collected, false)").isEmpty()


# ---- steps; the state (a small record for each batch of 50,000 inputs) is written after every change


def prepare(chunks: DataFrame, folder: str, model: str, dims: int, anew: bool = False) -> dict:
    """Writes the metadata log (meta) and the requests by batch (requests) and starts a fresh state. A folder whose jobs still run is left alone, unless `anew` gives them up."""
    spark = chunks.sparkSession
    held = sinks.load_state(spark, state_path(folder))["batches"]
    if any(b["status"] and b["status"] not in ("completed", *FAILED) for b in held) and not anew:
        raise RuntimeError(f"jobs of {folder} still run")
    chunks.write.mode("overwrite").json(f"{folder}/meta")
    packed = sinks.request_packing(chunks, model, dims)
    packed.select("batch", "request").withColumnRenamed("request", "value").repartition("batch").write.mode("overwrite").partitionBy("batch").text(f"{folder}/requests")
    numbers = sorted(r[0] for r in spark.read.text(f"{folder}/requests").select("batch").distinct().collect())
    state = {"phase": "prepared", "batches": [{"batch": int(b), "job": None, "status": None, "output_file_id": None, "collected": False} for b in numbers]}
    reset(spark, folder)
    sinks.save_state(spark, state_path(folder), state)
    return state


def state_path(folder: str) -> str:
    return f"{folder}/state"


def reset(spark: SparkSession, folder: str) -> None:
    sinks.save_state(spark, state_path(folder), {"phase": "init", "batches": []})


def table(spark: SparkSession, state: dict) -> DataFrame:
    return spark.createDataFrame([tuple(b[k.split()[0]] for k in STATES.split(", ")) for b in state["batches"]], STATES)


def submit(spark: SparkSession, folder: str, client: Client) -> dict:
    """Submits what has no running or finished job. That a batch is about to be submitted is saved first, and its job after; a run that ended in between asks the service whether it got the batch, so nothing is submitted twice."""
    state = sinks.load_state(spark, state_path(folder), required=True)
    todo = {r["batch"] for r in to_submit(table(spark, state)).collect()}
    for b in state["batches"]:
        if b["batch"] in todo:
            requests = f"{folder}/requests/batch={b['batch']}"
            job = client.find(requests) if b["status"] == SUBMITTING else None
            if job is None:
                b |= {"job": None, "status": SUBMITTING, "output_file_id": None, "collected": False}
                sinks.save_state(spark, state_path(folder), state)
                job = client.submit(requests)
            b |= {"job": job, "status": "submitted"}
            sinks.save_state(spark, state_path(folder), state)
    return advance(spark, folder, state, "submitted")


def advance(spark: SparkSession, folder: str, state: dict, phase: str) -> dict:
    """Moves on to a phase, step by step; earlier ones stay behind."""
    order = sinks.PHASES
    while order.index(state["phase"]) < order.index(phase):
        state = state | {"phase": order[order.index(state["phase"]) + 1]}
        sinks.save_state(spark, state_path(folder), state)
    return state


def poll(spark: SparkSession, folder: str, client: Client) -> dict:
    """Asks for the status of jobs that run."""
    state = sinks.load_state(spark, state_path(folder), required=True)
    jobs = {r["batch"] for r in running(table(spark, state)).collect()}
    for b in state["batches"]:
        if b["batch"] in jobs:
            b["status"], b["output_file_id"] = client.status(b["job"])
    sinks.save_state(spark, state_path(folder), state)
    return state


def collect(spark: SparkSession, folder: str, client: Client) -> dict:
    """Fetches finished outputs that aren't there yet; the state is saved after each."""
    state = advance(spark, folder, sinks.load_state(spark, state_path(folder), required=True), "collecting")
    ready = {r["batch"] for r in to_collect(table(spark, state)).collect()}
    for b in state["batches"]:
        if b["batch"] in ready:
            client.fetch(b["output_file_id"], f"{folder}/results/batch={b['batch']}")
            b["collected"] = True
            sinks.save_state(spark, state_path(folder), state)
    return advance(spark, folder, state, "done") if finished(table(spark, state)) else state


def run(spark: SparkSession, folder: str, client: Client, pause: float = 60.0, polls: int = 2000) -> dict:
    """Submits, waits and collects until all batches are done; failed jobs are submitted anew. A run that was stopped goes on where it was; one that isn't done after so many polls raises."""
    state = sinks.load_state(spark, state_path(folder), required=True)
    for _ in range(polls):
        submit(spark, folder, client)
        poll(spark, folder, client)
        state = collect(spark, folder, client)
        if state["phase"] == "done":
            return state
        time.sleep(pause)
    raise TimeoutError(f"{status(state)} after {polls} polls")


def embedded_chunks(spark: SparkSession, folder: str, dims: int = 2000) -> DataFrame:
    """The prepared chunks with the vectors fetched so far."""
    return files.with_embeddings(files.chunk_log(spark, f"{folder}/meta"), files.embedding_results(spark, f"{folder}/results"), dims)


def status(state: dict) -> dict[str, int]:
    """Number of batches by status."""
    counts: dict[str, int] = {}
    for b in state["batches"]:
        name = "collected" if b["collected"] else b["status"] or "prepared"
        counts[name] = counts.get(name, 0) + 1
    return counts

"""A durable sink for event streams: every event once, each session's in order.

Spark sorts a micro-batch's partitions, and tasks write them row by row to files of JSON lines, which
nobody reads yet; when a micro-batch ends, one manifest for it is put into place in one step and names its files. A batch that is run again after a
restart finds its manifest and changes nothing; files of attempts that failed are in no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from corpusloom.session import code_path

NAME = "session_events"


@dataclass
class Staged(WriterCommitMessage):
    file: str | None
    rows: int


def _folder(path: str):
    """The file system of a shared folder and the path in it, in the driver's and in tasks' Python."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class EventSink(DataSource):
    """Options: path (a URI that all machines reach), epoch (the micro-batch's number). Rows come in order."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"].rstrip("/"), int(self.options["epoch"]))


class Writer(DataSourceWriter):
    def __init__(self, path: str, epoch: int):
        self.path, self.epoch = path, epoch

    def write(self, iterator: Iterator[Row]) -> Staged:
        """One file for a task's rows of a micro-batch, of which it holds one at a time."""
        first = next(iterator, None)
        if first is None:
            return Staged(None, 0)
        files, base = _folder(self.path)
        files.create_dir(f"{base}/data", recursive=True)
        name = f"{uuid.uuid4().hex}.jsonl"
        with files.open_output_stream(f"{base}/data/{name}") as out:
            for n, row in enumerate(chain([first], iterator), 1):
                out.write((json.dumps({"place": n - 1, **row.asDict(recursive=True)}, default=str, ensure_ascii=False) + "\n").encode())
        return Staged(name, n)

    def commit(self, messages: list[Staged | None]) -> None:
        files, base = _folder(self.path)
        final = f"{base}/epochs/{self.epoch:012d}.json"
        if files.get_file_info(final).is_file:
            return self.abort(messages)  # the batch was published before the restart
        files.create_dir(f"{base}/epochs", recursive=True)
        draft = f"{base}/epochs/_{uuid.uuid4().hex}"
        told = [{"file": m.file, "rows": m.rows} for m in messages if m and m.file]
        with files.open_output_stream(draft) as out:
            out.write(json.dumps({"epoch": self.epoch, "files": told}).encode())
        files.move(draft, final)

    def abort(self, messages: list[Staged | None]) -> None:
        files, base = _folder(self.path)
        for m in messages:
            if m and m.file:
                files.delete_file(f"{base}/data/{m.file}")


def write_events(stream: DataFrame, path: str, checkpoint: str, session: str = "user_id", order: str = "ts,event_id"):
    """Starts a stream that appends its events to the log at `path`; a session's events of a micro-batch go to one file."""
    spark = stream.sparkSession
    code_path(spark)
    spark.dataSource.register(EventSink)
    keys = [F.asc_nulls_last(c) for c in (session, *order.split(","))]

    def publish(batch: DataFrame, epoch: int) -> None:
        batch.repartition(session).sortWithinPartitions(*keys).write.format(NAME).option("path", path).option("epoch", epoch).mode("append").save()

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def read_events(spark: SparkSession, path: str, schema: str, since: int = -1) -> DataFrame:
    """Published events after an epoch, with epoch and place; by these a session's events stand in order. `since` lets a client go on where it was."""
    files, base = _folder(path.rstrip("/"))
    from pyarrow import fs

    found = files.get_file_info(fs.FileSelector(f"{base}/epochs", allow_not_found=True))
    epochs = sorted(int(x.base_name.removesuffix(".json")) for x in found if not x.base_name.startswith("_"))
    told = []
    for epoch in epochs:
        if epoch > since:
            with files.open_input_stream(f"{base}/epochs/{epoch:012d}.json") as f:
                told += [(x["file"], epoch) for x in json.loads(f.read())["files"]]
    full = f"place long, {schema}"
    if not told:
        return spark.createDataFrame([], f"{full}, epoch long")
    rows = spark.read.schema(full).json([f"{path.rstrip('/')}/data/{name}" for name, _ in told]).withColumn("_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return rows.join(F.broadcast(spark.createDataFrame(told, "_file string, epoch long")), "_file").drop("_file")  # a row a file, whose names are on the driver as it is


def in_order(events: DataFrame, session: str = "user_id") -> DataFrame:
    """Adds seq, from 1, to a session's published events."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(session).orderBy("epoch", "place")))

"""Folders that change as a whole: data is written beside what is live, and a small record, renamed into place, says what is."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

RECORD = "_current.json"


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, base: str) -> dict | None:
    """The record of a folder, None if nothing was published there."""
    if not _files(spark, base).exists(_path(spark, f"{base}/{RECORD}")):
        return None
    return json.loads(text(spark, f"{base}/{RECORD}"))


def text(spark: SparkSession, path: str) -> str:
    stream = _files(spark, path).open(_path(spark, path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, base: str, record: dict) -> None:
    """Makes a record the folder's one, by a rename that replaces the old one in one step (as HDFS and local file systems do it). Readers see the old or the new one."""
    _put(spark, f"{base}/{RECORD}", json.dumps(record), ["OVERWRITE"])


def create(spark: SparkSession, path: str, content: str) -> bool:
    """Makes a file that isn't there yet; False if it is, also where another writer comes first."""
    try:
        _put(spark, path, content, [])
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def _put(spark: SparkSession, target: str, content: str, options: list[str]) -> None:
    """Writes a draft beside the target and renames it there in one step."""
    jvm, files = spark.sparkContext._jvm, _files(spark, target)
    draft = _path(spark, f"{target.rpartition('/')[0]}/_draft-{uuid.uuid4().hex}")
    stream = files.create(draft, True)
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()
    given = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, len(options))
    for k, name in enumerate(options):
        given[k] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, name)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(_path(spark, target)), given)
    finally:
        files.delete(draft, False)


def delete(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)


def children(spark: SparkSession, base: str) -> list[str]:
    """Names in a folder, [] if it isn't there."""
    files, path = _files(spark, base), _path(spark, base)
    return sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []


def refresh(spark: SparkSession, base: str, write: Callable[[str], None], keep: int = 1) -> str:
    """Replaces a table: `write` gets a new folder; when it is done that becomes the live one, and all but the last `keep` before it go.

    If `write` fails or the driver ends midway, the table stays what it was; the half-written folder goes with the next refresh.
    """
    old = current(spark, base) or {"version": None, "before": []}
    name = f"v-{uuid.uuid4().hex}"
    write(f"{base}/{name}")
    before = ([old["version"]] if old["version"] else []) + old["before"]
    publish(spark, base, {"version": name, "before": before[:keep]})
    for other in children(spark, base):
        if other.startswith(("v-", "_draft-")) and other not in (name, *before[:keep]):
            delete(spark, f"{base}/{other}")
    return f"{base}/{name}"


def path_of(spark: SparkSession, base: str) -> str:
    """Where the live version of a table is."""
    record = current(spark, base)
    if record is None:
        raise FileNotFoundError(f"nothing was published in {base}")
    return f"{base}/{record['version']}"


def read(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(path_of(spark, base))

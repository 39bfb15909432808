"""Files below a folder, listed and read by tasks, so that the driver holds neither names nor sizes.

Folders are listed level by level: tasks list those of one level and store what they find, and
the folders among it are the next level. Names that start with _ or . are hidden, as they are to
Spark's readers. Works on the file systems that pyarrow opens (local, HDFS, S3, GCS).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import code_path, written
from corpusloom.sources.line_index import opened

#: Entries and bytes of text in a batch that a task passes on.
ROWS, BYTES = 2000, 4 << 20


def listed(spark: SparkSession, root: str) -> DataFrame:
    """file (path below root), length of all files that aren't hidden; a root that isn't there is PATH_NOT_FOUND."""
    code_path(spark)
    system, base = opened(located(root))
    top = system.get_file_info(base)
    if top.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"PATH_NOT_FOUND: {root}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = opened(located(root))
        at = at.rstrip("/")
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = own.get_file_info(pafs.FileSelector(f"{at}/{folder}".rstrip("/")))
                found = [x for x in found if not x.base_name.startswith(("_", "."))]
                for i in range(0, len(found), ROWS):
                    some = found[i : i + ROWS]
                    names = [f"{folder}/{x.base_name}".lstrip("/") for x in some]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x.size for x in some], pa.int64()), pa.array([x.type == pafs.FileType.Directory for x in some], pa.bool_())], ["file", "length", "folder"])

    level, levels = spark.createDataFrame([("",)], "file string"), []
    while True:
        found = written(level.mapInArrow(run, "file string, length long, folder boolean"), "tree-level")
        levels.append(found.where(~F.col("folder")).select("file", "length"))
        level = found.where("folder").select("file")
        if level.isEmpty():
            return reduce(DataFrame.union, levels)
        level = level.repartition(parts, "file")


def texts(rows: DataFrame, root: str) -> DataFrame:
    """file, text of the files named in column file; undecodable bytes become U+FFFD."""
    spark = rows.sparkSession
    code_path(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(located(root))
        base = base.rstrip("/")
        names: list[str] = []
        held: list[str] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.string())], ["file", "text"])

        for batch in batches:
            for file in batch.column(0).to_pylist():
                with system.open_input_file(f"{base}/{file}") as f:
                    raw = f.read()
                names.append(file)
                held.append(raw.decode("utf-8", "replace"))
                size += len(raw)
                if len(names) == ROWS or size > BYTES:
                    yield batch_of()
                    names, held, size = [], [], 0
        if names:
            yield batch_of()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("file").repartition(parts, "file").mapInArrow(run, "file string, text string")


def located(root: str) -> str:
    """The root as a URI or an absolute path, which pyarrow asks for."""
    from pathlib import Path

    return root if ":" in root.split("/")[0] else str(Path(root).resolve())

"""A stored inverted-file index of vectors: cells around learned centres, appended to by epochs, rebuilt when cells drift.

Centres are a matrix that goes to tasks as a broadcast (lists x dimensions floats); vectors
are assigned to their nearest one in Arrow batches and written into a folder a cell. A
search multiplies each batch of a cell's vectors with the questions that probe that cell. With
`exact`, it then probes every cell that can hold a better vector than a question's k-th: no vector
of a cell is nearer than the angle to the cell's centre less the cell's widest angle.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import vector as V
from corpusloom.session import code_path
from corpusloom.sources import versions

#: Rows that centres are learned on, about.
SAMPLE_ROWS = 100_000
#: An index is rebuilt if the mean cosine of vectors with their centres is below this share of what it was, or a cell holds this many times its share.
LEAST_FIT, MOST_ROWS = 0.9, 20.0


def learned(chunks: DataFrame, lists: int, vector: str, key: str, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> np.ndarray:
    """Centres of unit length by k-means on a sample by hash of the key, of about `sample_rows` rows; vectors of the most usual length count."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sizes = chunks.where(F.size(vector) > 0).groupBy(F.size(vector).alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not usual:
        raise ValueError("no vectors to learn cells from")
    fit = chunks.where((F.size(vector) == usual[0]["dims"]) & F.exists(F.col(vector), lambda x: x != 0))  # zero vectors have no direction
    points = fit.select(key, array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))).alias("features"))
    n = points.count()
    if not n:
        raise ValueError("no vectors to learn cells from")
    sample = points if n <= sample_rows else points.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int((1 << 20) * sample_rows / n))
    model = KMeans(k=min(lists, max(2, n)), distanceMeasure="cosine", seed=seed, maxIter=10).fit(sample)
    centres = np.array(model.clusterCenters())
    return (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def assigned(chunks: DataFrame, centres: np.ndarray, key: str, vector: str) -> DataFrame:
    """key, embedding, cell, cosine with its centre; vectors that are null or of another length have no cell and go."""
    spark = chunks.sparkSession
    code_path(spark)
    sent = spark.sparkContext.broadcast(centres)

    def run(batches):
        centres = sent.value.astype(np.float64)
        for batch in batches:
            part, x = V.matrix(batch, 1, centres.shape[1])
            if part is None:
                continue
            cosine = (x @ centres.T) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            cell = cosine.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(cosine[np.arange(len(cell)), cell])], ["key", "embedding", "cell", "cosine"])

    kinds = [chunks.schema[c].dataType for c in (key, vector)]
    schema = T.StructType([T.StructField("key", kinds[0]), T.StructField("embedding", kinds[1]), T.StructField("cell", T.IntegerType()), T.StructField("cosine", T.DoubleType())])
    return chunks.select(key, vector).mapInArrow(run, schema)


def build(chunks: DataFrame, base: str, key: str, lists: int, vector: str = "embedding", sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> None:
    """Learns centres, assigns all vectors and makes them the index at `base`; what was there before goes."""
    spark = chunks.sparkSession
    old = versions.current(spark, base)
    centres = learned(chunks, lists, vector, key, sample_rows, seed)
    cells = f"cells-{uuid.uuid4().hex}"
    epoch = _write(chunks, centres, f"{base}/{cells}", key, vector)
    stats = _stats(spark, f"{base}/{cells}", [epoch])
    spark.createDataFrame([*enumerate(centres.tolist())], "cell int, centre array<float>").write.parquet(f"{base}/{cells}/centres")
    record = {"cells": cells, "epochs": [epoch], "dims": centres.shape[1], "lists": len(centres), "stats": stats}
    record["fit"] = _fit(record)
    _publish(spark, base, record, old)


def append(chunks: DataFrame, base: str, key: str, vector: str = "embedding") -> None:
    """Assigns vectors whose keys the index doesn't have to the cells there are."""
    spark = chunks.sparkSession
    record = versions.current(spark, base)
    folder = f"{base}/{record['cells']}"
    epoch = _write(chunks, _centres(spark, base, record), folder, key, vector)
    new = {s["cell"]: s for s in _stats(spark, folder, [epoch])}
    stats = [_merged(s, new.pop(s["cell"], None)) for s in record["stats"]] + list(new.values())
    _publish(spark, base, record | {"epochs": [*record["epochs"], epoch], "stats": stats}, record)


def _centres(spark: SparkSession, base: str, record: dict) -> np.ndarray:
    rows = spark.read.parquet(f"{base}/{record['cells']}/centres").orderBy("cell").collect()
    return np.array([r["centre"] for r in rows], np.float32)


def _write(chunks: DataFrame, centres: np.ndarray, folder: str, key: str, vector: str) -> str:
    epoch = uuid.uuid4().hex
    # A large cell is dealt to several tasks: batches stay where they are, only sorted by cell for the writer.
    assigned(chunks, centres, key, vector).write.partitionBy("cell").parquet(f"{folder}/epoch={epoch}")
    return epoch


def _cells(spark: SparkSession, folder: str, epochs: list[str]) -> DataFrame | None:
    """Stored vectors of epochs; one that got no vectors has no schema."""
    paths = [f"{folder}/epoch={e}" for e in epochs if any(x.startswith("cell=") for x in versions.children(spark, f"{folder}/epoch={e}"))]
    return spark.read.option("basePath", folder).parquet(*paths) if paths else None


def _stats(spark: SparkSession, folder: str, epochs: list[str]) -> list[dict]:
    """Of each cell: its rows, the sum of cosines with the centre, and the least one. As many rows as cells."""
    cells = _cells(spark, folder, epochs)
    rows = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("cosine").alias("sum"), F.min("cosine").alias("least")).collect() if cells is not None else []
    return [r.asDict() for r in rows]


def _merged(a: dict, b: dict | None) -> dict:
    return a if b is None else {"cell": a["cell"], "n": a["n"] + b["n"], "sum": a["sum"] + b["sum"], "least": min(a["least"], b["least"])}


def _fit(record: dict) -> float:
    """The mean cosine of vectors with their centres."""
    return sum(s["sum"] for s in record["stats"]) / max(1, sum(s["n"] for s in record["stats"]))


def _publish(spark: SparkSession, base: str, record: dict, old: dict | None) -> None:
    versions.publish(spark, base, record)
    if old and old["cells"] != record["cells"]:
        versions.delete(spark, f"{base}/{old['cells']}")


def drifted(record: dict, least_fit: float = LEAST_FIT, most_rows: float = MOST_ROWS) -> bool:
    """Whether what was appended no longer lies around the centres, or has swollen a cell."""
    total = sum(s["n"] for s in record["stats"])
    swollen = max((s["n"] for s in record["stats"]), default=0) > most_rows * max(1.0, total / record["lists"])
    return _fit(record) < least_fit * record["fit"] or swollen


def rebuild(spark: SparkSession, base: str, lists: int, force: bool = False) -> bool:
    """Learns new centres from all stored vectors if cells have drifted; readers go on with the old cells until the new ones stand."""
    record = versions.current(spark, base)
    cells = _cells(spark, f"{base}/{record['cells']}", record["epochs"])
    if cells is None or not (force or drifted(record)):
        return False
    build(cells.select("key", "embedding"), base, "key", lists)
    return True


def search(spark: SparkSession, base: str, queries: DataFrame, k: int, probes: int = 30, exact: bool = False, key: str = "vec_id", query_key: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """query_key, key, score, rank of the k best stored vectors among those of each question's nearest cells, or, with `exact`, of all."""
    record = versions.current(spark, base)
    cells = _cells(spark, f"{base}/{record['cells']}", record["epochs"])
    centres = _centres(spark, base, record).astype(np.float64)
    of_cell = {s["cell"]: s for s in record["stats"]}
    held = np.array([c in of_cell for c in range(len(centres))])
    widest = np.arccos(np.clip([of_cell[c]["least"] if c in of_cell else 1.0 for c in range(len(centres))], -1, 1))
    found = None
    for ids, q in V.query_blocks(queries, query_key, query_vector, record["dims"]):
        cosine = np.where(held, q @ centres.T, -np.inf)
        near = np.argsort(-cosine, axis=1, kind="stable")[:, :probes]
        probed = np.zeros(cosine.shape, bool)
        np.put_along_axis(probed, near, True, axis=1)
        probed &= held
        part = _probe(cells, ids, q, k, probed, key, query_key, queries)
        if exact and part is not None:
            first = V.written_top(part, k, key, query_key)
            place = {x: j for j, x in enumerate(ids)}
            least = np.full(len(ids), -np.inf)
            for r in first.where(F.col("rank") == k).select(query_key, "score").collect():  # one number a question of the block
                least[place[r[0]]] = r[1]
            nearest = np.cos(np.maximum(0.0, np.arccos(np.clip(cosine, -1, 1)) - widest))
            more = _probe(cells, ids, q, k, held & ~probed & (nearest >= least[:, None] - 1e-6), key, query_key, queries)
            part = first.drop("rank") if more is None else first.drop("rank").unionByName(more)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        kinds = [queries.schema[query_key].dataType.simpleString(), cells.schema["key"].dataType.simpleString() if cells is not None else "long"]
        found = spark.createDataFrame([], f"{query_key} {kinds[0]}, {key} {kinds[1]}, score double")
    return V.top(found, k, key, query_key)


def _probe(cells: DataFrame | None, ids: list, q: np.ndarray, k: int, probed: np.ndarray, key: str, query_key: str, queries: DataFrame) -> DataFrame | None:
    """Scores of the cells that any question probes; other cells' folders aren't read."""
    wanted = np.flatnonzero(probed.any(axis=0)).tolist()
    if cells is None or not wanted:
        return None
    rows = cells.where(F.col("cell").isin(wanted)).select(F.col("key").alias(key), "embedding", "cell")
    return V.scored(rows, ids, q, k, key, query_key, queries.schema[query_key].dataType, {c: np.flatnonzero(probed[:, c]) for c in wanted})

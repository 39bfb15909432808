"""Vector search: exact top-k for one or many queries, grouping by document, thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions import text as X
from corpusloom.session import code_path, written

#: Query vectors that are scored against a batch of rows at once.
QUERY_BLOCK = 256
#: Bytes of query vectors that one scan answers.
BLOCK_BYTES = 64 << 20
#: Parts that a question's finds are ranked in before they are ranked together.
MERGE_PARTS = 64
#: Scores are rounded to so many digits, so that sums in another order rank alike.
DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    """In doubles, whatever the vectors hold."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def truncated(a: Column, dims: int = 2000) -> Column:
    """The first dimensions, not normalised anew."""
    return F.slice(a, 1, dims)


def percent(distance: Column) -> Column:
    """Distance as a score of 0 to 100 with one decimal."""
    return F.round(F.greatest(F.lit(0.0), (1 - distance) * 100), 1)


def top_k(chunks: DataFrame, query: list[float], k: int, key: str, vector: str = "embedding") -> DataFrame:
    """The k chunks most like one query vector, with their score."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return chunks.withColumn("score", F.round(cosine(F.col(vector), q), DIGITS)).orderBy(F.desc("score"), key).limit(k)


def matrix(batch: pa.RecordBatch, column: int, dims: int) -> tuple[pa.RecordBatch | None, np.ndarray | None]:
    """The rows of a batch whose vectors have so many dimensions, and these as doubles."""
    lengths = batch.column(column).value_lengths().fill_null(0).to_numpy()
    fit = np.flatnonzero(lengths == dims)
    if not len(fit):
        return None, None
    part = batch if len(fit) == batch.num_rows else batch.take(pa.array(fit))
    return part, part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), -1)


def query_blocks(queries: DataFrame, query_key: str, query_vector: str, dims: int | None = None) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and unit vectors of questions, in blocks of BLOCK_BYTES at most; vectors that are null, or not of `dims`, are left out."""
    asked = queries.select(query_key, query_vector).where(F.col(query_vector).isNotNull() & (F.lit(True) if dims is None else F.size(query_vector) == dims))
    n, size = asked.agg(F.count(F.lit(1)), F.max(F.size(query_vector))).first()
    blocks = max(1, -(-n * 8 * (size or 1) // BLOCK_BYTES))
    for b in range(blocks):
        rows = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b)).collect()
        if rows:
            q = np.array([r[1] for r in rows], np.float64)
            yield [r[0] for r in rows], q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)


def scored(chunks: DataFrame, ids: list, q: np.ndarray, k: int, key: str, query_key: str, id_type, probed: dict[int, np.ndarray] | None = None) -> DataFrame:
    """query_key, key, score of what may be among the k best of each question, from chunks (key, vector, and with `probed`, which says what questions probe a cell, cell).

    One scan for a whole block of questions: each batch of chunks is multiplied with QUERY_BLOCK
    of them at a time, and only what reaches the k-th best that the task has seen leaves it.
    """
    spark = chunks.sparkSession
    code_path(spark)
    sent = spark.sparkContext.broadcast((ids, q, probed))
    arrow_type = to_arrow_type(id_type)

    def run(batches):
        ids, q, probed = sent.value
        least = np.full(len(ids), -np.inf)
        everyone = np.arange(len(ids))
        for batch in batches:
            part, x = matrix(batch, 1, q.shape[1])
            if part is None:
                continue
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            groups = [(np.arange(len(x)), everyone)]
            if probed is not None:
                cell = part.column(2).to_numpy()
                groups = [(np.flatnonzero(cell == c), probed[c]) for c in np.unique(cell).tolist()]
            for own, asked in groups:
                for a in range(0, len(asked), QUERY_BLOCK):
                    some = asked[a : a + QUERY_BLOCK]
                    scores = x[own] @ q[some].T
                    if len(own) >= k:
                        # Everything that ties with the k-th stays, so that ties are cut by key later.
                        least[some] = np.maximum(least[some], np.partition(scores, len(own) - k, axis=0)[len(own) - k])
                    r, c = np.nonzero(scores >= least[some] - 10**-DIGITS)
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some[c]], arrow_type), part.column(0).take(pa.array(own[r])), pa.array(scores[r, c])], [query_key, key, "score"])

    schema = T.StructType([T.StructField(query_key, id_type), T.StructField(key, chunks.schema[key].dataType), T.StructField("score", T.DoubleType())])
    return chunks.mapInArrow(run, schema)


def top(found: DataFrame, k: int, key: str, query_key: str = "query_id") -> DataFrame:
    """The k best of each question with their rank, merged in two steps, so that no task gets all that a question found in many tasks."""
    found = found.withColumn("score", F.round("score", DIGITS))
    order = [F.desc("score"), F.col(key)]
    some = Window.partitionBy(query_key, F.pmod(F.xxhash64(key), F.lit(MERGE_PARTS))).orderBy(*order)
    found = found.withColumn("_r", F.row_number().over(some)).where(F.col("_r") <= k).drop("_r")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(*order))).where(F.col("rank") <= k)


def written_top(found: DataFrame, k: int, key: str, query_key: str = "query_id") -> DataFrame:
    return written(top(found, k, key, query_key), "vector-top")


def top_k_batch(chunks: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """query_id, key, score, rank of the k best chunks for each query.

    One scan of the chunks for each BLOCK_BYTES of query vectors; neither a pair table nor all
    scores exist. Rows whose vector is null or of another length than the queries' score nothing.
    """
    id_type, found = queries.schema[query_key].dataType, None
    for ids, q in query_blocks(queries, query_key, query_vector):
        part = scored(chunks.select(key, vector), ids, q, k, key, query_key, id_type)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = chunks.sparkSession.createDataFrame([], T.StructType([T.StructField(query_key, id_type), T.StructField(key, chunks.schema[key].dataType), T.StructField("score", T.DoubleType())]))
    return top(found, k, key, query_key)


def best_of_document(scored: DataFrame, doc: str, chunk: str, query_key: str = "query_id") -> DataFrame:
    """Each document's best chunk for each query (the first one on ties), with the number of its chunks found."""
    keys = [query_key, doc] if query_key in scored.columns else [doc]
    best = F.struct(F.col("score"), -F.col(chunk)) if dict(scored.dtypes)[chunk] in ("int", "bigint", "smallint") else F.struct(F.col("score"))
    return scored.groupBy(*keys).agg(F.max("score").alias("score"), F.max_by(chunk, best).alias(chunk), F.count(F.lit(1)).alias("chunk_count"))


def best_of_prefix(scored: DataFrame, vector_id: str, top: int | None = None, query_key: str = "query_id") -> DataFrame:
    """Each id prefix's best vector (its representative) for each query, best first; `top` keeps so many a query (5 and 30 in the older interfaces)."""
    keys = [query_key] if query_key in scored.columns else []
    rows = scored.withColumn("prefix", X.vector_id_prefix(F.col(vector_id)))
    best = rows.groupBy(*keys, "prefix").agg(F.max("score").alias("score"), F.min_by(vector_id, F.struct(-F.col("score"), F.col(vector_id))).alias(vector_id))
    if top is None:
        return best
    if not keys:
        return best.orderBy(F.desc("score"), "prefix").limit(top)
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), "prefix")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def members_of_document(scored: DataFrame, doc: str, chunk: str, query_key: str = "query_id", most: int = 1000) -> DataFrame:
    """Documents with their best chunks found, best first (ties by chunk), and the number of all: score, chunk_count, members.

    `most` members at most are kept, ranked in two steps by a salt, so that a document with any number of hits takes
    bounded memory; members_cut tells where there were more.
    """
    keys = [query_key, doc] if query_key in scored.columns else [doc]
    order = [F.desc("score"), F.col(chunk)]
    salt = F.pmod(F.xxhash64(chunk), F.lit(MERGE_PARTS))
    some = Window.partitionBy(*keys, salt).orderBy(*order)
    best = scored.withColumn("_r", F.row_number().over(some)).where(F.col("_r") <= most)
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most)
    listed = best.groupBy(*keys).agg(F.max("score").alias("score"), F.sort_array(F.collect_list(F.struct("_r", "score", chunk))).alias("_m"))
    counts = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunk_count"))
    members = F.transform("_m", lambda m: F.struct(m["score"].alias("score"), m[chunk].alias(chunk)))
    return listed.join(counts, keys).select(*keys, "score", "chunk_count", members.alias("members"), (F.col("chunk_count") > most).alias("members_cut"))


def adaptive_threshold(scored: DataFrame, least: float = 0.42, share: float = 0.75, query_key: str = "query_id") -> DataFrame:
    """Rows that reach both a fixed score and a share of their query's best one."""
    of_query = Window.partitionBy(query_key)
    return scored.withColumn("best", F.max("score").over(of_query)).where(F.col("score") >= F.greatest(F.lit(least), F.col("best") * share)).drop("best")

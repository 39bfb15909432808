"""Scores of documents for many questions within tasks: only each task's k best of every question leave it.

All terms of a document lie in one row (or one range of stored postings), so its scores need no shuffle. Tasks hold
the asked terms, a bounded number of scores, and k documents a question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import code_path

#: Asked terms (question, term) of one pass over the documents; more take several passes.
ASKED_ROWS = 1_000_000
#: Scores, and products that they are sums of, that a task computes at once.
HELD_SCORES, HELD_PRODUCTS = 1 << 20, 1 << 20


class Best:
    """The k best documents of each question among those added; ties by document. asked: query_id, term, weight."""

    def __init__(self, asked: pa.Table, k: int):
        self.k, self.terms, self.queries = k, pc.unique(asked["term"].combine_chunks()), pc.unique(asked["query_id"].combine_chunks())
        term, query = (pc.index_in(asked[c].combine_chunks(), value_set=v).to_numpy(zero_copy_only=False) for c, v in (("term", self.terms), ("query_id", self.queries)))
        order = np.argsort(term, kind="stable")
        self.query, self.weight = query[order], asked["weight"].to_numpy()[order]
        self.n = np.bincount(term, minlength=len(self.terms))
        self.start = np.cumsum(self.n) - self.n
        self.least, self.held, self.size = np.zeros(len(self.queries)), [], 0

    def number(self, terms: pa.Array) -> np.ndarray:
        """Numbers of asked terms, -1 for others."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, docs: pa.Array, doc: np.ndarray, term: np.ndarray, value: np.ndarray, scale: np.ndarray) -> None:
        """Postings, in the order of places in docs; scale: what each document's sum is divided by."""
        times = self.n[term]
        products = np.cumsum(np.bincount(doc, times, len(docs)))
        most, a = max(1, HELD_SCORES // max(1, len(self.queries))), 0
        while a < len(docs):
            b = int(np.searchsorted(products, (products[a - 1] if a else 0) + HELD_PRODUCTS, "right"))
            b = min(max(b, a + 1), a + most, len(docs))
            part = slice(*np.searchsorted(doc, [a, b]))
            self._score(docs, a, b, doc[part], term[part], value[part], times[part], scale)
            a = b

    def _score(self, docs, a, b, doc, term, value, times, scale) -> None:
        at = np.repeat(self.start[term] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        cells = np.repeat((doc - a) * len(self.queries), times) + self.query[at]
        sums = np.bincount(cells, np.repeat(value, times) * self.weight[at], (b - a) * len(self.queries)).reshape(b - a, -1)
        scores = np.round(sums / scale[a:b, None], 9)
        d, q = np.nonzero((sums > 0) & (scores >= self.least))
        self.held.append(pa.table({"q": q.astype(np.int32), "doc_id": docs.take(pa.array(d + a)), "score": scores[d, q]}))
        self.size += len(d)
        if self.size > max(HELD_SCORES, 2 * self.k * len(self.queries)):
            self._cut()

    def _cut(self) -> None:
        rows = pa.concat_tables(self.held)
        rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_start")).combine_chunks()
        q = rows["q"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        ends = rank == self.k - 1
        self.least[q[ends]] = rows["score"].to_numpy()[ends]
        rows = rows.filter(pa.array(rank < self.k))
        self.held, self.size = [rows], len(rows)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._cut()
            rows = self.held[0]
            yield from pa.table({"query_id": self.queries.take(rows["q"].combine_chunks()), "doc_id": rows["doc_id"], "score": rows["score"]}).to_batches()


def best(rows: DataFrame, asked: DataFrame, k: int, add: Callable[[Best, Iterable[pa.RecordBatch]], None], kind: str | None = None) -> DataFrame:
    """query_id, doc_id, score: each task's k best of every question. asked (written): query_id, term, weight; add gives a task's postings to a Best; kind: the type of doc_id, if rows have no such column."""
    spark = rows.sparkSession
    code_path(spark)
    kinds = [f"query_id {asked.schema['query_id'].dataType.simpleString()}", f"doc_id {kind or rows.schema['doc_id'].dataType.simpleString()}"]

    def pass_over(part: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast(part.select("query_id", "term", F.col("weight").cast("double").alias("weight")).toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Best(sent.value, k)
            if len(held.terms):
                add(held, batches)
            yield from held.rows()

        return rows.mapInArrow(run, f"{kinds[0]}, {kinds[1]}, score double")

    passes = max(1, -(-asked.count() // ASKED_ROWS))
    out = None
    for p in range(passes):
        got = pass_over(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p) if passes > 1 else asked)
        out = got if out is None else out.unionByName(got)
    return out


def of_documents(score: Callable[[np.ndarray, np.ndarray], np.ndarray], scale: Callable[[np.ndarray], np.ndarray]) -> Callable[[Best, Iterable[pa.RecordBatch]], None]:
    """Postings of rows (doc_id, terms); score: of counts and lengths."""

    def add(held: Best, batches: Iterable[pa.RecordBatch]) -> None:
        for batch in batches:
            lists = batch.column("terms")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            term = held.number(lists.flatten())
            row = np.repeat(np.arange(len(lengths)), lengths)
            key, tf = np.unique(row[term >= 0] * len(held.terms) + term[term >= 0], return_counts=True)
            doc, term = np.divmod(key, len(held.terms))
            held.add(batch.column("doc_id"), doc, term, score(tf, lengths[doc]), scale(np.maximum(lengths, 1)))

    return add


def of_blocks(score: Callable[[np.ndarray, np.ndarray], np.ndarray], scale: Callable[[np.ndarray], np.ndarray]) -> Callable[[Best, Iterable[pa.RecordBatch]], None]:
    """Postings of blocks (range_id, term, doc_id, tf, len, the latter three as lists), those of a range one after the other."""

    def add(held: Best, batches: Iterable[pa.RecordBatch]) -> None:
        for blocks in groups(batches, "range_id", HELD_SCORES):
            lists = blocks["docs"].combine_chunks()
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            term = np.repeat(held.number(blocks["term"].combine_chunks()), n)
            tf, length = (blocks[c].combine_chunks().flatten().to_numpy() for c in ("tf", "len"))
            coded = lists.flatten().dictionary_encode(null_encoding="encode")
            doc = coded.indices.to_numpy().astype(np.int64)
            longest = np.ones(len(coded.dictionary), np.int64)
            np.maximum.at(longest, doc, length)
            order = np.argsort(doc, kind="stable")
            held.add(coded.dictionary, doc[order], term[order], score(tf, length)[order], scale(longest))

    return add


def groups(batches: Iterable[pa.RecordBatch], key: str, values: int) -> Iterator[pa.Table]:
    """Whole groups of rows that follow each other with one key, several together until they hold some number of list values."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        of = batch.column(key).to_numpy(zero_copy_only=False)
        sizes = sum(len(c.flatten()) for c in batch.columns if pa.types.is_list(c.type))
        if n >= values:
            start = int(np.argmax(of != held[-1].column(key)[-1].as_py())) if (of != held[-1].column(key)[-1].as_py()).any() else len(of)
            if start < len(of):
                yield pa.Table.from_batches([*held, batch.slice(0, start)])
                held, n, batch = [], 0, batch.slice(start)
        held.append(batch)
        n += sizes
    if held:
        yield pa.Table.from_batches(held)

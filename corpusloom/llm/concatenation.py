"""Packing by concatenating and cutting.

All documents' ids, each followed by an end id, make one row of tokens that is cut into
windows of `capacity`. The first pass tokenises whole texts on the executors and writes
the ids with the number of the partition and the tokens of that partition before them.
The totals of the partitions are added up (`common.starts`), which gives every document
its global offset; the second pass cuts at the windows' ends. No row is shuffled and
nothing but one row a partition is added up.

A window that would have to be padded is the last one alone. As windows of a power of
two need no padding, what is left there is cut into powers of two, the largest first.

Rows are written before they are numbered, so a lost executor changes no offset.

Defined results: a null text is an empty one, whose only id is the end id; an empty table
gives no rows; repeated rows and ids are packed one by one, ties in the order of the
input; of the input only the named columns are read, whatever else it has. A very long
text is tokenised as a whole, since a byte-level BPE gives other ids to its parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common as C
from corpusloom.llm.packing import default_tokenizer, encoder


def tokenized(df: DataFrame, key: str = "doc_id", text: str = "text", end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n, part, at: n tokens, of which `at` lie before the document in its partition. Write it before use."""
    path = tokenizer or default_tokenizer()
    inner = df.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    C.code_path(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in C.blocks(texts):
                held = [np.array([*encode(t or ""), end_id], "<u4") for t in texts[a:b]]
                n = np.array([len(x) for x in held], np.int64)
                before = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in held], pa.binary()), pa.array(n), pa.array(np.full(b - a, part, np.int64)), pa.array(before)],
                    ["doc_id", "ids", "n", "part", "at"],
                )

    return inner.mapInArrow(run, f"doc_id {inner.schema['doc_id'].dataType.simpleString()}, ids binary, n long, part long, at long")


def offsets(stored: DataFrame, capacity: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """Written rows of `tokenized` with their global offset, and the windows' ends after the last full one."""
    totals = stored.groupBy("part").agg(F.sum("n").alias("total"))
    start = C.materialize(C.starts(totals, "part", "total", "start"), "starts")
    total = stored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = C.with_starts(stored, start, "part").select("doc_id", "ids", "n", (F.col("start") + F.col("at")).alias("global"))
    return placed, tail_ends(total, capacity)


def tail_ends(total: int, capacity: int) -> np.ndarray:
    """The end of the last full window, then those of the powers of two that the rest is cut into."""
    rest = total % capacity
    sizes = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    return total - rest + np.cumsum([0, *sizes], dtype=np.int64)


def cut(start: int, n: int, capacity: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First tokens, windows and offsets there of the pieces of n tokens from a global offset on."""
    full, stop = int(ends[0]), start + n
    whole = np.arange(start // capacity + 1, min(stop, full + 1) // capacity + 1, dtype=np.int64) * capacity
    inner = np.unique(np.concatenate([whole, ends]))
    at = np.concatenate([[start], inner[(inner > start) & (inner < stop)]])
    later = np.searchsorted(ends, at, "right") - 1
    window = np.where(at < full, at // capacity, full // capacity + later)
    first = np.where(at < full, at // capacity * capacity, ends[np.maximum(later, 0)])
    return at, window, at - first


def pieces(stored: DataFrame, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of written rows of `tokenized`."""
    placed, ends = offsets(stored, capacity)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, n, begin = batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        own, columns = [], [[] for _ in range(6)]
        for i in range(len(n)):
            at, window, offset = cut(int(begin[i]), int(n[i]), capacity, ends)
            data, start = memoryview(ids[i].as_buffer()), at - begin[i]
            length = np.diff(np.append(start, n[i]))
            crc = np.array([zlib.crc32(data[4 * s : 4 * (s + m)]) for s, m in zip(start.tolist(), length.tolist(), strict=True)], np.int64)
            own.append(np.full(len(at), i))
            for c, x in zip(columns, (np.arange(len(at)), start, length, crc, window, offset), strict=True):
                c.append(x)
        if own:
            own = np.concatenate(own)
            piece, *rest = [np.concatenate(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own)), pa.array(piece.astype(np.int32)), *map(pa.array, rest[:3]), pa.array(n[own]), *map(pa.array, rest[3:])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = stored.schema["doc_id"].dataType.simpleString()
    return C.map_arrow(placed, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def sequences(stored: DataFrame, capacity: int = 1024) -> DataFrame:
    """sequence_id, ids array<int>, doc_ids, lengths (of each document's piece, in order): the windows themselves.

    Windows that lie within a batch are whole there; only the boundary records, the parts of
    windows that go over a batch's end, are shuffled and joined by their offsets.
    """
    placed, ends = offsets(stored, capacity)
    full = int(ends[0]) // capacity

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, n, begin = batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        parts: list[list] = []
        for i in np.argsort(begin, kind="stable").tolist():
            at, window, offset = cut(int(begin[i]), int(n[i]), capacity, ends)
            data = np.frombuffer(ids[i].as_buffer(), "<u4").astype(np.int32)
            bounds = np.append(at - begin[i], n[i]).tolist()
            for k, (w, o) in enumerate(zip(window.tolist(), offset.tolist(), strict=True)):
                own = data[bounds[k] : bounds[k + 1]]
                if not (parts and parts[-1][0] == w and parts[-1][1] + parts[-1][5] == o):
                    parts.append([w, o, [], [], [], 0])
                last = parts[-1]
                last[2].append(own)
                last[3].append(i)
                last[4].append(len(own))
                last[5] += len(own)
        if not parts:
            return
        size = [capacity if p[0] < full else int(ends[p[0] - full + 1] - ends[p[0] - full]) for p in parts]
        ends_of = lambda k: pa.array(np.cumsum([0, *(len(p[k]) for p in parts)]).astype(np.int32))
        tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(p[5] for p in parts)]).astype(np.int32)), pa.array(np.concatenate([x for p in parts for x in p[2]])))
        docs = batch.column(0).take(pa.array([i for p in parts for i in p[3]], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.int64()), tokens, pa.ListArray.from_arrays(ends_of(3), docs),
             pa.ListArray.from_arrays(ends_of(4), pa.array([x for p in parts for x in p[4]], pa.int32())), pa.array([p[5] == s for p, s in zip(parts, size, strict=True)])],
            ["sequence_id", "offset", "ids", "doc_ids", "lengths", "whole"],
        )

    kind = stored.schema["doc_id"].dataType.simpleString()
    got = C.materialize(C.map_arrow(placed, run, f"sequence_id long, offset long, ids array<int>, doc_ids array<{kind}>, lengths array<int>, whole boolean"), "windows")
    names = ["sequence_id", "ids", "doc_ids", "lengths"]
    boundary = got.where("not whole").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_ids", "lengths"))).alias("_p"))
    joined = boundary.select("sequence_id", *[F.flatten(F.col(f"_p.{c}")).alias(c) for c in names[1:]])
    return got.where("whole").select(*names).unionByName(joined)

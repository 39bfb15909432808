"""Best-two-fit packing of token pieces into sequences.

Whole texts are tokenised on the executors, followed by an end id; only longer ones are
cut, the first piece holding what is over. How pieces share sequences depends on their
lengths alone, so the driver packs the length histogram (at most `capacity` numbers,
whatever the input): it fills a sequence greedily with the longest piece that fits, then
replaces its smallest piece by two unpacked ones that fit the expanded gap more tightly,
and repeats that pattern as often as the supply lasts. Pieces get their places by their
rank within their length, numbered without gathering a length in one task.

Defined results: a null text is an empty one, whose only id is the end id; an empty table
gives no rows; repeated rows are packed one by one.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common as C

_LOADED: dict[str, Callable[[str], list[int]]] = {}
#: From this many white-space characters in a row on, the quicker library's backtracking may overflow its stack.
LONG_SPACE = 1000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by the byte-level BPE of a tokenizers JSON file.

    A quicker library that gives the same ids runs it, but for texts that hold an added token or very long white space.
    """
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"] for x in model.get("added_tokens", ())}
        # Byte-level vocabularies write a byte as a character: printable ones as themselves, the others from U+0100 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        back = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(back[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
        quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        exact = Tokenizer.from_file(path)
        rare = re.compile("|".join([*map(re.escape, sorted(special)), rf"\s{{{LONG_SPACE}}}"]))

        def encode(text: str) -> list[int]:
            return exact.encode(text, add_special_tokens=False).ids if rare.search(text) else quick.encode_ordinary(text)

        _LOADED[path] = encode
    return _LOADED[path]


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece."""
    path = tokenizer or default_tokenizer()
    inner = df.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    kind = inner.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batch):
        encode, texts = encoder(path), batch.column(1).to_pylist()
        for a, b in C.blocks(texts):
            rows, cols, ids_out = [], [[], [], [], []], []
            for i in range(a, b):
                ids = np.array([*encode(texts[i] or ""), end_id], "<u4")
                at, k = 0, 0
                while at < len(ids):
                    n = (len(ids) - at) % capacity or capacity if k == 0 else capacity
                    own = ids[at : at + n]
                    rows.append(i)
                    for c, x in zip(cols, (k, at, n, zlib.crc32(own.tobytes())), strict=True):
                        c.append(x)
                    if with_ids:
                        ids_out.append(own.astype(np.int32))
                    at, k = at + n, k + 1
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids_out, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return C.map_arrow(inner, run, schema)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths that share a sequence, how many such sequences); counts[n]: pieces of length n."""
    left = counts.astype(np.int64).copy()
    lengths = np.arange(len(left))
    out = []
    while left.any():
        free, pattern, gap = left.copy(), [], capacity
        while True:
            fit = np.flatnonzero(free[: gap + 1])
            if not len(fit):
                break
            n = int(fit[-1])
            k = min(int(free[n]), gap // n)
            pattern += [n] * k
            free[n] -= k
            gap -= n * k
        if gap:
            small = pattern[-1]
            room = gap + small
            # For each first length the longest second one that fits beside it.
            largest = np.maximum.accumulate(np.where(free > 0, lengths, 0))
            first = np.flatnonzero(free[: room // 2 + 1])
            second = largest[room - first]
            alone = (second == first) & (free[first] < 2)
            second = np.where(alone, largest[np.maximum(np.minimum(room - first, first - 1), 0)], second)
            total = np.where(second > 0, first + second, 0)
            if len(total) and int(total.max()) > small:
                k = int(total.argmax())
                pattern = [*pattern[:-1], int(second[k]), int(first[k])]
        used = np.bincount(pattern, minlength=len(left))
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        out.append((pattern, times))
    return out


def layout(patterns: list[tuple[list[int], int]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: pieces of a length, by rank, take consecutive sequences from there."""
    taken = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            rows.append((n, int(taken[n]), sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces that have doc_id, piece and length."""
    spark = parts.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["length"]] = r["n"]
    rows = layout(best_two_fit(counts, capacity), capacity)
    sent = spark.sparkContext.broadcast(rows)
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = C.gapless(parts, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank", buckets, F.xxhash64("doc_id", "piece"))
    names = parts.columns

    def run(batch):
        rows, columns = sent.value, dict(zip(batch.schema.names, batch.columns, strict=True))
        length, rank = columns["length"].to_numpy(), columns["_rank"].to_numpy()
        at = np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            own, (a, b) = length == n, np.searchsorted(rows[:, 0], [n, n + 1])
            at[own] = a + np.searchsorted(rows[a:b, 1], rank[own], "right") - 1
        extra = [pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])]
        yield pa.RecordBatch.from_arrays([*(columns[c] for c in names), *extra], [*names, "sequence_id", "offset"])

    return C.map_arrow(ranked, run, T.StructType([*parts.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))

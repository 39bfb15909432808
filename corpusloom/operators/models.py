"""External models as column functions: embeddings and generative scores with pluggable providers, retries and pacing."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import code_path

Embed = Callable[[list[str]], list[list[float]]]


class RateLimited(Exception):
    """A provider's answer that its budget of tokens is used up until `reset` (say, 1m30s or 250ms) has passed."""

    def __init__(self, reset: str = "1s"):
        super().__init__(f"rate limited for {reset}")
        self.reset = reset


def reset_after(reset: str) -> float:
    """Seconds of a reset header."""
    units = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}
    return sum(float(n) * units[u] for n, u in re.findall(r"([\d.]+)(ms|s|m|h)", reset))


def embedded(df: DataFrame, make: Callable[[], Embed], text: str = "text", out: str = "embedding", batch: int = 100, tries: int = 5, pause: float = 0.0) -> DataFrame:
    """Adds a vector to each row. A task makes its provider once and asks for `batch` texts at a time; failures of the network or the service are tried again after 1, 2, 4 ... seconds, used up budgets once they are reset. Null texts get null."""
    code_path(df.sparkSession)
    at = df.columns.index(text)
    schema = T.StructType([*[f for f in df.schema if f.name != out], T.StructField(out, T.ArrayType(T.FloatType()))])

    def ask(embed: Embed, texts: list[str]) -> list[list[float]]:
        for k in range(tries):
            try:
                return embed(texts)
            except (OSError, RuntimeError, TimeoutError, RateLimited) as e:
                if k == tries - 1:
                    raise
                time.sleep(reset_after(e.reset) if isinstance(e, RateLimited) else 2.0**k)
        return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for frame in frames:
            texts = frame.iloc[:, at]
            known = [i for i, t in enumerate(texts) if t is not None]
            vectors: list = [None] * len(frame)
            for k in range(0, len(known), batch):
                part = known[k : k + batch]
                for i, v in zip(part, ask(embed, [texts.iloc[i] for i in part]), strict=True):
                    vectors[i] = v
                if pause:
                    time.sleep(pause)
            yield frame.drop(columns=[out], errors="ignore").assign(**{out: vectors})

    return df.mapInPandas(run, schema)


def hashed_provider(dims: int = 64) -> Embed:
    """An offline provider: signed hashes of words, unit length. The same text gives the same vector anywhere."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dims] += 1.0 if h >> 31 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def listed_scores(answer: Column, size: Column) -> Column:
    """Scores of a generative scorer's answer: the outermost JSON array of {idx, score} in it; places outside the batch are dropped. No array gives an empty list."""
    found = F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), "array<struct<idx:int,score:double>>")
    return F.filter(F.coalesce(found, F.array().cast("array<struct<idx:int,score:double>>")), lambda x: (x["idx"] >= 0) & (x["idx"] < size) & x["score"].isNotNull())


def scored_batches(docs: DataFrame, answers: DataFrame, batch: str, place: str, doc: str) -> DataFrame:
    """doc, score of documents numbered within batches, from the batches' answers; joined by batch and place, then carried by document."""
    sizes = docs.groupBy(batch).agg((F.max(place) + 1).alias("_n"))
    scores = answers.join(sizes, batch).select(batch, F.explode(listed_scores(F.col("answer"), F.col("_n"))).alias("s"))
    scores = scores.select(batch, F.col("s.idx").alias(place), F.col("s.score").alias("score")).groupBy(batch, place).agg(F.max("score").alias("score"))
    return docs.join(scores, [batch, place], "left").select(doc, F.coalesce("score", F.lit(0.0)).alias("score"))

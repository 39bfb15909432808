"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams are summed per language on the executors; the driver turns
them into one log-probability matrix, which is broadcast (languages x buckets floats, a
fixed size), and batches of texts are scored as sparse rows times that matrix in numpy.

Defined results: a null text, or one without a letter, gets `und` and score 0. With no
usable training row every text gets `und`. Ties go to the language first in order. Rows
with equal ids are scored one by one; columns besides the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common as C

UNDETERMINED = "und"
#: Buckets times languages of a model at most (32 MB as floats), and places times languages that scoring holds.
CELLS, DENSE = 1 << 23, 1 << 24


@dataclass
class LanguageModel:
    langs: list[str]
    #: buckets x languages, natural logarithms; a last row of zeros for places that count nothing
    log_prob: np.ndarray
    log_prior: np.ndarray


def pieces(text: str | None, limit: int) -> list[str]:
    """The lower-cased text and two spaces, in pieces of at most `limit` places; the last two characters of a piece are only read on into."""
    whole = f"{(text or '').lower()}  "
    return [whole[a : a + limit + 2] for a in range(0, max(1, len(whole) - 2), limit)]


def ngrams(parts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to 3-grams of pieces, three for each place, and each piece's first place.

    The last two places of a piece hold the bucket 1 << bits, which counts nothing.
    """
    raw = "".join(parts).encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(raw, np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
    c1, c2 = np.concatenate([c[1:], c[:1]]), np.concatenate([c[2:], c[:2]])
    shift = np.uint64(64 - bits)
    h = c * np.uint64(0x9E3779B97F4A7C15)
    two = h + (c1 + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two + (c2 + np.uint64(1)) * np.uint64(0x165667B19E3779F9)
    out = np.empty((len(c), 3), np.int32)
    for k, x in enumerate((h, two, three)):
        out[:, k] = ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift
    out[starts[1:] - 1] = out[starts[1:] - 2] = 1 << bits
    return out, starts


def in_blocks(texts: list[str | None], bits: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets, starts of pieces and the text of each piece, for blocks of pieces with at most `limit` places together; a longer text comes in several."""
    for a, b in C.blocks(texts, limit):
        if b - a > 1 or len(texts[a] or "") <= limit:
            parts = [f"{(t or '').lower()}  " for t in texts[a:b]]
            yield *ngrams(parts, bits), np.arange(a, b)
        else:
            for part in pieces(texts[a], limit):
                yield *ngrams([part], bits), np.array([a])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", bits: int = 15, rows_per_lang: int = 4000, alpha: float = 0.1) -> LanguageModel:
    """Learns from a hash sample of about `rows_per_lang` labelled rows of each language (the documented bound of this fit). No language is left out: with more than CELLS >> bits of them, n-grams share fewer buckets."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros(((1 << bits) + 1, 0), np.float32), np.zeros(0))
    bits = max(1, min(bits, (CELLS // len(sizes)).bit_length() - 1))
    share = F.broadcast(spark.createDataFrame([(k, min(1.0, rows_per_lang / n)) for k, n in sizes.items()], "_l string, _share double"))  # a row a language
    place = F.pmod(F.xxhash64("k", F.lit("language sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.join(share, F.col("l") == F.col("_l")).where(place < F.col("_share")).select("t", "l")
    buckets = 1 << bits

    def counts(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for grams, starts, of in in_blocks(texts, bits, C.BLOCK_CHARS):
                for i, at in enumerate(of.tolist()):
                    own = np.bincount(grams[starts[i] : starts[i + 1]].ravel(), minlength=buckets + 1)[:buckets]
                    held[langs[at]] = held[langs[at]] + own if langs[at] in held else own
        for name, n in held.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["l", "b", "n"])

    C.code_path(spark)
    got = sample.mapInArrow(counts, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    n = np.zeros((buckets, len(langs)))
    index = {k: i for i, k in enumerate(langs)}
    cols = [index[x] for x in got.column("l").to_pylist()]
    n[got.column("b").to_numpy(), cols] = got.column("n").to_numpy()
    log_prob = np.log(n + alpha) - np.log(n.sum(0) + alpha * buckets)
    total = sum(sizes.values())
    return LanguageModel(langs, np.vstack([log_prob, np.zeros(len(langs))]).astype(np.float32), np.log([sizes[k] / total for k in langs]))


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language and its posterior probability for each text."""
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return names, scores
    bits = model.log_prob.shape[0].bit_length() - 1
    total = np.zeros((len(texts), len(model.langs)))
    # Places times languages are dense for a moment.
    for grams, starts, of in in_blocks(texts, bits, max(1, min(C.BLOCK_CHARS, DENSE // len(model.langs)))):
        at = np.zeros((len(grams), len(model.langs)), np.float32)
        for k in range(3):
            at += model.log_prob[grams[:, k]]
        total[of] += np.add.reduceat(at, starts[:-1], axis=0, dtype=np.float64)
    total += model.log_prior
    best = total.argmax(1)
    total -= total.max(1, keepdims=True)
    post = 1 / np.exp(total).sum(1)
    for i, text in enumerate(texts):
        if has_letter(text):
            names[i], scores[i] = model.langs[best[i]], post[i]
    return names, scores


def predict(df: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` (all of df's by default), then lang_pred and score."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    sent = df.sparkSession.sparkContext.broadcast(model)
    inner = df.select(*keep, F.col(text).alias("_text"))
    schema = inner.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batch):
        names, scores = score_texts(sent.value, batch.column(len(keep)).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return C.map_arrow(inner, run, schema)

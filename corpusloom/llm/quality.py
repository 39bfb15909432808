"""Quality classifier: supervised subword embeddings.

Hashed words, word shapes and character n-grams have learned vectors; a text is their average, and a
softmax layer on it gives the label's probability, all trained by numpy stochastic gradient
descent on a bounded hash sample of labelled rows. At scoring time the output layer is
folded into the vectors (it is linear in them), so each feature adds two numbers.

Defined results: texts without features (null, empty, one white space) get the label's
share; without labelled rows every score is 0.5. A score of 0.5 or more predicts 1.
Labels repeated for an id are averaged and rounded half up; rows equal in id and text are
one row to learn from. Texts are read in pieces of half a million characters, whose
features are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common as C

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: 0 lower case, 1 upper case, 2 digit, 3 other ASCII, 4 beyond ASCII
CLASSES = np.array([4 if b > 127 else 0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 for b in range(256)], np.uint8)

#: Orders of the character n-grams; the last one of a text ends in a space.
ORDERS = (3, 4)
MOST_ORDER = max(ORDERS)
#: A longer run without white space is cut into words of so many characters.
WORD_CHARS = 1024
POWERS = np.cumprod(np.concatenate([[1], np.full(WORD_CHARS - 1, 0x5851F42D4C957F2D)]).astype(np.uint64))


@dataclass
class QualityModel:
    #: logit that each feature bucket adds before averaging
    weight: np.ndarray
    bias: float
    #: logit of a text without features
    empty: float


def pieces(text: str, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `size` characters that cut no word: they end at white space, or where a longer run is cut into words anyhow."""
    size, a = max(1, size // WORD_CHARS) * WORD_CHARS, 0
    while len(text) - a > size:
        b = 1 + max(text.rfind(c, a, a + size) for c in "\t\n\x0b\x0c\r ")
        b = b if b > a else a + size
        yield a, b
        a = b
    if text:
        yield a, len(text)


def parts(texts: Iterable) -> Iterator[list[tuple[int, str, str]]]:
    """Blocks of (place of the text, piece, what follows it), so that a long text needs no more memory than others."""
    held, n = [], 0
    for i, t in enumerate(texts):
        t = (t.as_py() if isinstance(t, pa.Scalar) else t) or ""
        for a, b in pieces(t, C.BLOCK_CHARS):
            held.append((i, t[a:b], (t[b : b + MOST_ORDER - 1] + " ")[: MOST_ORDER - 1]))
            n += b - a
            if n >= C.BLOCK_CHARS:
                yield held
                held, n = [], 0
    if held:
        yield held


def features(block: list[tuple[int, str, str]], bits: int, before: tuple[int, int] = (-1, 0)) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[int, int]]:
    """For character n-grams, words and their shapes: buckets, and the text that each belongs to. Then the last word, as (text, hash), which the next block takes as `before`."""
    chars = np.frombuffer("".join(x for _, piece, tail in block for x in (piece, tail)).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(block)), [len(piece) + len(tail) for _, piece, tail in block])
    inside = np.repeat(np.tile([True, False], len(block)), [len(x) for _, piece, tail in block for x in (piece, tail)])
    owner = np.array([i for i, _, _ in block])[of]
    x, low = chars.astype(np.uint64), np.minimum(chars, 255)
    shift = np.uint64(64 - bits)
    found = []
    put = lambda values, owners: found.append(((C.mix64(values) >> shift).astype(np.int32), owners))
    h = np.zeros(len(x), np.uint64)
    for n in range(1, min(MOST_ORDER, len(x)) + 1):
        m = len(x) - n + 1
        h = h[:m] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            same = inside[:m] & (of[:m] == of[n - 1 :])
            put(h[same] + np.uint64(n << 40), owner[:m][same])
    # Words: a polynomial over each stretch between spaces, from prefix sums.
    space = SPACES[low] | ~inside
    begins = ~space & np.concatenate([[True], space[:-1]])
    at = np.arange(len(x))
    place = (at - np.maximum.accumulate(np.where(begins, at, 0))) % WORD_CHARS
    first = np.flatnonzero(~space & (place == 0))
    last = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | (place == WORD_CHARS - 1)))
    if len(first):
        total = np.concatenate([[np.uint64(0)], np.cumsum(np.where(space, np.uint64(0), (x + np.uint64(7)) * POWERS[place]))])
        word, whose = total[last + 1] - total[first], owner[first]
        put(word, whose)
        # A word's shape: whether it repeats the word before it, its length, its first and last character's class.
        again = np.concatenate([[before == (int(whose[0]), int(word[0]))], (word[1:] == word[:-1]) & (whose[1:] == whose[:-1])]).astype(np.uint64)
        kind = CLASSES[low[first]].astype(np.uint64) * np.uint64(8) + CLASSES[low[last]]
        put(again + np.uint64(1 << 50), whose)
        put(again * np.uint64(1 << 12) + np.minimum(last - first, 31).astype(np.uint64) * np.uint64(64) + kind + np.uint64(2 << 50), whose)
        before = int(whose[-1]), int(word[-1])
    return found, before


def sparse(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    counts, before = np.zeros(1 << bits, np.int64), (-1, 0)
    for block in parts([text]):
        found, before = features(block, bits, before)
        for at, _ in found:
            counts += np.bincount(at, minlength=1 << bits)
    got = np.flatnonzero(counts)
    return got.astype(np.int32), (counts[got] / max(1, counts.sum())).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, width: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 1) -> QualityModel:
    """Plain SGD, one text a step; the learning rate falls linearly; classes weigh the same in the gradient."""
    if not len(labels):
        return QualityModel(np.zeros(1 << bits, np.float32), 0.0, 0.0)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (1 << bits, width)).astype(np.float32)
    out = np.zeros((width, 2), np.float32)
    bias = np.array([np.log(1 - share), np.log(share)], np.float32)
    steps, step = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            at, w = rows[i]
            own = rate * (1 - step / steps)
            step += 1
            if not len(at):
                continue
            hidden = w @ vectors[at]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = out @ p
            out -= own * np.outer(hidden, p)
            bias -= 0.1 * own * p
            # Shares are small, so the step along them is scaled up by the number of features.
            vectors[at] -= (own * min(len(at), 2000) ** 0.5 * w)[:, None] * back
    fold = out[:, 1] - out[:, 0]
    return QualityModel(vectors @ fold, float(bias[1] - bias[0]), float(np.log(share / (1 - share))))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bits: int = 16, max_rows: int = 4000, max_chars: int = 40_000_000) -> QualityModel:
    """Learns from a hash sample of about `max_rows` labelled rows and `max_chars` characters (the documented bounds of this fit)."""
    known = labels.select(F.col(key).alias("_k"), F.col(label).alias("_l")).where("_k is not null and _l is not null").groupBy("_k").agg(F.floor(F.avg("_l") + 0.5).cast("int").alias("_l"))
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    place = F.pmod(F.xxhash64("_k", F.lit("quality sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    n = known.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()
    # Half of the bound for each label, so that a rare one isn't lost.
    share = {r["_l"]: min(1.0, max_rows / max(1, len(n)) / r["n"]) for r in n}
    if not share:
        return train([], np.zeros(0), bits)
    picked = known.where(place < F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])[F.col("_l")])
    sample = rows.join(F.broadcast(picked), "_k").dropDuplicates(["_k", "_t"])  # at most about max_rows ids and labels
    size = sample.agg(F.sum(F.char_length("_t"))).first()[0] or 0
    if size > max_chars:
        sample = sample.where(F.pmod(F.xxhash64("_k", "_t", F.lit("quality chars")), F.lit(1 << 20)) < int((1 << 20) * max_chars / size))

    def run(batch):
        got = [sparse(t.as_py(), bits) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))], ["k", "l", "at", "w"])

    kind = sample.schema["_k"].dataType.simpleString()
    got = C.map_arrow(sample.select("_k", "_t", "_l"), run, f"k {kind}, l int, at array<int>, w array<float>").toArrow().sort_by("k")
    rows_ = [(at.values.to_numpy(), w.values.to_numpy()) for at, w in zip(got.column("at"), got.column("w"), strict=True)]
    model = train(rows_, np.array(got.column("l").to_pylist()), bits)
    # Labels are sampled at their own rates; the log odds of the rates give back the shares that the labels have.
    odds = float(np.log(share.get(0, 1.0) / share.get(1, 1.0))) if len(share) == 2 else 0.0
    return QualityModel(model.weight, model.bias + odds, model.empty + odds)


def score_texts(model: QualityModel, texts: Sequence) -> np.ndarray:
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    bits, before = len(model.weight).bit_length() - 1, (-1, 0)
    for block in parts(texts):
        found, before = features(block, bits, before)
        base, upto = block[0][0], block[-1][0] + 1
        for at, owner in found:
            total[base:upto] += np.bincount(owner - base, model.weight[at], upto - base)
            n[base:upto] += np.bincount(owner - base, minlength=upto - base)
    z = np.where(n > 0, total / np.maximum(n, 1) + model.bias, model.empty)
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def predict(df: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` (all by default), then score and predicted."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("score", "predicted")]
    sent = df.sparkSession.sparkContext.broadcast(model)
    inner = df.select(*keep, F.col(text).alias("_text"))
    schema = inner.drop("_text").schema.add("score", "double").add("predicted", "integer")

    def run(batch):
        scores = score_texts(sent.value, batch.column(len(keep)))
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return C.map_arrow(inner, run, schema)

"""Hashed maximum-entropy language model with a class-factored softmax.

P(token) = P(class | context) * P(slot | class, context) * P(token | slot). The most frequent
tokens have a slot of their own in the head classes; all others, known or not, are dealt by
hash to the slots of the tail classes, where a token has its add-half share of the slot, so
the model is a proper distribution over an open vocabulary. Contexts give hashed features:
the word before, the one before that (skip) and both together.

Training takes steps along the gradient, observed less expected counts of each feature and
outcome, summed over all tasks, so the model doesn't depend on how rows are dealt. Each
coordinate's step is scaled by the curvature: the gradient over the logarithmic mean of both
sums is the logarithm of their ratio. Observed and expected counts are those of all training
documents; the expected ones of the first step follow from the observed ones. What a model expects
depends on a token's context alone, so equal contexts of all documents are counted once, as a table
of distinct ones, over which each later step goes.
Scoring is sparse lookups and sums over numpy batches.

Frequencies, classes and biases come from the counts of all training documents, without a
vocabulary on the driver, which takes the frequent tokens and the sums of slots. The counts of
all other tokens are a table that scoring joins by the token's 64-bit hash.

Defined results: a null text is the empty one, whose only token is the end; without
training documents every count is 0. Rows with equal ids are scored one by one; tables other
than the training one score by the training counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common as C

END = b""
SLOTS = 32
#: Head and tail classes at most; a small vocabulary has fewer.
HEAD, TAIL = 64, 64
#: Distinct tokens for each tail class until there are TAIL of them.
CLASS_TYPES = 1024
#: Context ids (head tokens have their own, others share what is left) and rows for pairs of them.
CONTEXTS, PAIRS = 4096, 8192
#: From each of these numbers of training tokens on, there are twice as many rows for pairs.
SCALE_TOKENS = (1 << 21, 1 << 26)
#: Tokens that workers look up in a dictionary, which affects speed alone.
FREQUENT = 1 << 16
#: Outcomes' values in a batch of numpy's, so that it stays in a core's cache, and in one whose rows are added to tables, which go by runs of equal rows.
BATCH_CELLS, ADDED_CELLS = 1 << 16, 1 << 18
#: Equal rows from which on they are added up at once.
LONG_RUN = 24
#: Pseudo-counts of a feature's row, dealt by the unigram shares of classes, and of each of a row's slots.
CLASS_PRIOR, SLOT_PRIOR = 5.0, 5.0
#: Rates of the first step and of the later ones.
FIRST, RATE, ROUNDS = 0.5, 0.3, 2
#: parameter rows in a block of the gradient exchange
BLOCK_ROWS = 1024
#: training tokens of a gradient task at least, beyond one task a core, of which there are at most two a core
TASK_TOKENS = 1 << 21
#: distinct tokens that a task counts before it passes them on
HELD_TOKENS = 1 << 18
#: tokens whose contexts a task counts at once, and distinct contexts that it holds
COUNTED_CONTEXTS, HELD_CONTEXTS = 1 << 20, 1 << 21
#: parts that contexts are dealt in by the row of their pair: at least, and at most, where a part can have about 2^20 contexts
CONTEXT_PARTS, MOST_PARTS = 64, 2048
#: training tokens for each part between these, and contexts in a row of their table
PART_TOKENS, ROW_CONTEXTS = 1 << 20, 1 << 17
OUT_OF_USE = np.float32(-1e4)


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def token_hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def classes_for(types: int) -> tuple[int, int]:
    """Head and tail classes for so many distinct tokens."""
    return min(HEAD, 1 + types // SLOTS), min(TAIL, 1 + types // CLASS_TYPES)


@dataclass
class Model:
    #: frequent tokens; the first head * SLOTS have slots of their own, 0 is the end
    index: dict[bytes, int]
    head: int
    tail: int
    pairs: int
    class_bias: np.ndarray
    slot_bias: np.ndarray
    #: log10 of each tail slot's add-half total
    slot_total: np.ndarray
    #: of frequent tokens, in the order of index
    counts: np.ndarray
    hashes: np.ndarray
    #: tokens and distinct tokens of the training documents
    n_tokens: int = 0
    types: int = 0
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        if not self.weights:
            self.weights = [np.zeros((self.rows, n), np.float32) for n in (self.head + self.tail, SLOTS)]

    @property
    def own(self) -> int:
        """Tokens with a slot of their own."""
        return self.head * SLOTS

    @property
    def rows(self) -> int:
        return 2 * CONTEXTS + self.pairs

    def tail_slot(self, hashes: np.ndarray) -> np.ndarray:
        return self.own + ((hashes >> np.uint64(20)) % np.uint64(self.tail * SLOTS)).astype(np.int64)

    def feature_rows(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Parameter rows of the word before, the one before that, and both."""
        pair = C.mix64(one.astype(np.uint64) * np.uint64(CONTEXTS) + two.astype(np.uint64)) % np.uint64(self.pairs)
        return np.stack([one, CONTEXTS + two, 2 * CONTEXTS + pair.astype(np.int64)])

    def with_class(self, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Parameter rows of features together with a class."""
        return (C.mix64(rows.astype(np.uint64) * np.uint64(1 << 20) + which.astype(np.uint64)) % np.uint64(self.rows)).astype(np.int64)


def fresh(counts: list[tuple[bytes, int]], n_tokens: int, types: int, slots: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """A model whose biases give unigram shares; counts: of frequent tokens. slots: by tail slot, the sum and number of all tokens, those of the head too."""
    ranked = sorted(((w, n) for w, n in counts if w != END), key=lambda x: (-x[1], x[0]))[: FREQUENT - 1]
    ranked = [(END, dict(counts).get(END, 0)), *ranked]
    head, tail = classes_for(types)
    own, hashes = head * SLOTS, token_hash([w for w, _ in ranked])
    n = np.array([k for _, k in ranked], np.int64)
    pairs = PAIRS << sum(n_tokens >= n for n in SCALE_TOKENS)
    model = Model({w: i for i, (w, _) in enumerate(ranked)}, head, tail, pairs, np.zeros(0), np.zeros(0), np.zeros(0), n, hashes, n_tokens, types)
    at = model.tail_slot(hashes) - own
    if slots is None:
        sums, kinds = np.bincount(at, n, tail * SLOTS), np.bincount(at, minlength=tail * SLOTS).astype(np.float64)
    else:
        sums, kinds = (x.astype(np.float64) for x in slots)
    np.subtract.at(sums, at[:own], n[:own])
    np.subtract.at(kinds, at[:own], n[:own] > 0)
    sums, kinds = np.maximum(sums, 0), np.maximum(kinds, 0)
    each = np.concatenate([n[:own], np.zeros(own - len(n[:own])), sums + 0.5]).reshape(-1, SLOTS)
    with np.errstate(divide="ignore"):
        model.slot_bias = np.where(each > 0, np.log(each), OUT_OF_USE).astype(np.float32)
        total = each.sum(1)
        model.class_bias = np.where(total > 0, np.log(total), OUT_OF_USE).astype(np.float32)
    model.slot_total = np.log10(sums + 0.5 * (kinds + 1))
    return model


@dataclass
class Encoded:
    """Tokens of a block of texts. ids: index of frequent tokens, else -1; hashes: of those others, in order; starts: of each text."""

    ids: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray

    def slots(self, model: Model) -> np.ndarray:
        """Each token's slot, counted over all classes."""
        out = self.ids.copy()
        far = self.ids >= model.own
        out[far] = model.tail_slot(model.hashes[self.ids[far]])
        out[self.ids < 0] = model.tail_slot(self.hashes)
        return out

    def features(self, model: Model) -> np.ndarray:
        """Three parameter rows for each token."""
        start, others = CONTEXTS - 1, np.uint64(CONTEXTS - 1 - model.own)
        context = self.ids.copy()
        far = self.ids >= model.own
        context[far] = model.own + (model.hashes[self.ids[far]] % others).astype(np.int64)
        context[self.ids < 0] = model.own + (self.hashes % others).astype(np.int64)
        one = np.concatenate([[start], context[:-1]])
        one[self.starts[:-1]] = start
        two = np.concatenate([[start], one[:-1]])
        two[self.starts[:-1]] = start
        return model.feature_rows(one, two)


def encode(texts: list[str | None], index: dict[bytes, int]) -> Encoded:
    split = [tokens(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in split])])
    flat = [w for s in split for w in s]
    ids = np.fromiter(map(index.get, flat, repeat(-1)), np.int64, len(flat))
    hashes = token_hash([flat[i] for i in np.flatnonzero(ids < 0).tolist()])
    return Encoded(ids, hashes, starts.astype(np.int64))


def decisions(model: Model, data: Encoded):
    """In batches of tokens, both choices: (0 or 1, tokens' places, parameter rows, unnormalised log probabilities, choice taken)."""
    rows = data.features(model)
    which, slot = np.divmod(data.slots(model), SLOTS)
    for m, taken in enumerate((which, slot)):
        for part in batches_of(len(which), model.weights[m]):
            at, bias = rows[:, part], model.class_bias
            if m:
                at, bias = model.with_class(at, which[part]), model.slot_bias.take(which[part], 0)
            yield m, part, at, scored(model.weights[m], at, bias), taken[part]


def batches_of(n: int, w: np.ndarray, cells: int = BATCH_CELLS) -> Iterator[slice]:
    size = max(cells // w.shape[1], 1)
    return (slice(a, a + size) for a in range(0, n, size))


def scored(w: np.ndarray, at: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Unnormalised log probabilities of the outcomes, given the parameter rows of three features."""
    z = w.take(at[0], 0)
    z += w.take(at[1], 0)
    z += w.take(at[2], 0)
    z += bias
    return z


def exponentials(z: np.ndarray) -> np.ndarray:
    """Turns z into exponentials relative to each row's greatest, in place, and returns their sums."""
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def add_rows(table: np.ndarray, at: np.ndarray, z: np.ndarray) -> None:
    """Adds rows of z to rows of a table, which may repeat: long runs of equal rows are summed, of others the first ones of all runs are added, then the second ones, and so on."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # by radix; rows are below 2^16
    ordered = at[order]
    first = starts_of(ordered)
    times = np.diff(first, append=len(at))
    far = times > LONG_RUN
    for a, n in zip(first[far].tolist(), times[far].tolist(), strict=True):
        table[ordered[a]] += np.ones(n, z.dtype) @ z.take(order[a : a + n], 0)
    first, times = first[~far], times[~far]
    for k in range(times.max(initial=0)):
        some = first[times > k] + k
        rows = ordered[some]
        table[rows] = table.take(rows, 0) + z.take(order[some], 0)


def log_prob(model: Model, data: Encoded) -> np.ndarray:
    """Natural log of P(slot) of each token."""
    out = np.zeros(len(data.ids))
    for _, part, _, z, taken in decisions(model, data):
        z -= z.max(1, keepdims=True)
        chosen = z[np.arange(len(z)), taken].astype(np.float64)
        np.exp(z, out=z)
        out[part] += np.maximum(chosen - np.log(z @ np.ones(z.shape[1], z.dtype)), np.log(1e-30))
    return out


def observe(model: Model, texts: list[str | None], sums: list[np.ndarray]) -> None:
    """Adds these texts' observed counts of features and outcomes."""
    data = encode(texts, model.index)
    rows, (which, slot) = data.features(model), np.divmod(data.slots(model), SLOTS)
    for r in rows:
        np.add.at(sums[0].reshape(-1), r * sums[0].shape[1] + which, np.float32(1))
        np.add.at(sums[1].reshape(-1), model.with_class(r, which) * SLOTS + slot, np.float32(1))


def text_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[str | None]]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in C.blocks(texts):
            yield texts[a:b]


def observe_all(model: Model, batches: Iterable[pa.RecordBatch], sums: list[np.ndarray]) -> None:
    """Observed counts of batches of texts."""
    for texts in text_blocks(batches):
        observe(model, texts, sums)


def contexts(model: Model, texts: list[str | None]) -> np.ndarray:
    """The word before, the one before that and the class of each token, as one number below 2^31."""
    data = encode(texts, model.index)
    one, two, _ = data.features(model)
    return ((one * CONTEXTS + two - CONTEXTS) * (HEAD + TAIL) + data.slots(model) // SLOTS).astype(np.uint32)


def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = starts_of(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def starts_of(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def expect(model: Model, texts: list[str | None], sums: list[np.ndarray]) -> None:
    """Adds the counts that the model expects given these texts' contexts."""
    for keys, counts in distinct_contexts(model, [texts]):
        expect_at(model, keys, counts, sums)


def expect_all(model: Model, batches: Iterable[pa.RecordBatch], sums: list[np.ndarray]) -> None:
    """Expected counts at batches of distinct contexts."""
    for batch in batches:
        for _, keys, counts in context_rows(batch):
            expect_at(model, keys, counts, sums)


def context_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """part, keys and counts of each row, which aren't copied."""
    for part, keys, counts in zip(*batch.columns, strict=True):
        yield part.as_py(), np.frombuffer(keys.as_buffer(), np.uint32), np.frombuffer(counts.as_buffer(), np.int64)


def distinct_contexts(model: Model, blocks: Iterable[list[str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts of all tokens in blocks of texts in order, and how often they occur; contexts beyond HELD_CONTEXTS come in several lots."""
    held, counts, new, n = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0
    for texts in blocks:
        new.append(contexts(model, texts))
        n += len(new[-1])
        if n >= COUNTED_CONTEXTS:
            held, counts = merged(held, counts, new)
            new, n = [], 0
            if len(held) >= HELD_CONTEXTS:
                yield held, counts
                held, counts = held[:0], counts[:0]
    yield merged(held, counts, new)


def merged(held: np.ndarray, counts: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, times = np.unique(np.concatenate([held[:0], *keys]), return_counts=True)
    return added_up(np.concatenate([held, own]), np.concatenate([counts, times]))


def expect_at(model: Model, keys: np.ndarray, counts: np.ndarray, sums: list[np.ndarray]) -> None:
    """Adds what the model expects at distinct contexts that occur so many times."""
    before, which = np.divmod(keys.astype(np.int64), HEAD + TAIL)
    rows = model.feature_rows(*np.divmod(before, CONTEXTS))
    order = np.lexsort((before, rows[2]))  # equal rows of pairs stand together
    before, which, rows, counts = before[order], which[order], rows[:, order], counts[order]
    own = starts_of(before)
    add_expected(model, 0, rows[:, own], None, np.add.reduceat(counts, own) if len(own) else counts, sums[0])
    order = np.argsort(which.astype(np.uint8), kind="stable")
    which = which[order]
    add_expected(model, 1, model.with_class(rows[:, order], which), which, counts[order], sums[1])


def add_expected(model: Model, m: int, rows: np.ndarray, classes: np.ndarray | None, times: np.ndarray, table: np.ndarray) -> None:
    """Adds what a choice of the model expects at parameter rows that occur so many times together."""
    w = model.weights[m]
    for part in batches_of(len(times), w, ADDED_CELLS):
        at = rows[:, part]
        z = scored(w, at, model.slot_bias.take(classes[part], 0) if m else model.class_bias)
        total = exponentials(z)
        z *= (times[part] / total).astype(np.float32)[:, None]
        for r in at:
            add_rows(table, r, z)


def step(model: Model, observed: list[np.ndarray], expected: list[np.ndarray], rate: float) -> None:
    """A scaled gradient step of the model; the rows of `expected` are scaled to the observed ones, and rows without any stay."""
    share = np.exp(model.class_bias - model.class_bias.max())
    priors = (CLASS_PRIOR * (share / share.sum()).astype(np.float32) * len(share) + np.float32(1e-6), np.float32(SLOT_PRIOR))
    for w, seen, thought, prior in zip(model.weights, observed, expected, priors, strict=True):
        for a in range(0, len(w), BLOCK_ROWS):
            part = slice(a, a + BLOCK_ROWS)
            total = thought[part].sum(1, keepdims=True)
            scale = seen[part].sum(1, keepdims=True) / np.maximum(total, np.float32(1e-9))
            move = np.log((seen[part] + prior) / (thought[part] * scale + prior))
            w[part] += np.where(total > 0, np.float32(rate) * move, 0)


def at_start(model: Model, observed: list[np.ndarray]) -> list[np.ndarray]:
    """The counts that a model without weights expects: what it says of classes and slots, times how often a row was seen with each class."""
    share = np.exp(model.class_bias - model.class_bias.max())
    slots = np.exp(model.slot_bias - model.slot_bias.max(1, keepdims=True))
    slots /= slots.sum(1, keepdims=True)
    with_class = np.zeros_like(observed[0])
    every = np.arange(model.rows)
    for k in range(with_class.shape[1]):
        np.add.at(with_class[:, k], model.with_class(every, np.full(model.rows, k)), observed[0][:, k])
    return [observed[0].sum(1, keepdims=True) * (share / share.sum()), with_class @ slots]


def summed(df: DataFrame) -> DataFrame:
    """Sums float32 vectors by block, streaming; a block has a row from each task before."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data, np.float32)
                held[b] = held[b] + x if b in held else x.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "data"])

    return df.repartition("block").mapInArrow(run, "block int, data binary")


def gathered(rows: DataFrame, model: Model, add, n_tokens: int = 0) -> list[np.ndarray]:
    """Sums, over all rows (texts or contexts), of what `add` (observe_all or expect_all) adds to tables shaped like the weights. Without n_tokens, one task a core."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(model)
    height = model.rows

    def run(batches):
        own: Model = sent.value
        sums = [np.zeros(w.shape, np.float32) for w in own.weights]
        full = (batch for batch in batches if batch.num_rows)
        some = next(full, None)
        if some is None:
            return
        add(own, chain([some], full), sums)
        for m, table in enumerate(sums):
            for i in range(0, height, BLOCK_ROWS):
                block = pa.array([(m * height + i) // BLOCK_ROWS], pa.int32())
                yield pa.RecordBatch.from_arrays([block, pa.array([table[i : i + BLOCK_ROWS].tobytes()], pa.binary())], ["block", "data"])

    # Each task sends whole tables, so small partitions are joined.
    cores = spark.sparkContext.defaultParallelism
    parts = rows.coalesce(max(cores, min(2 * cores, n_tokens // TASK_TOKENS)))
    out = [np.zeros(w.shape, np.float32) for w in model.weights]
    for r in summed(parts.mapInArrow(run, "block int, data binary")).toLocalIterator():
        m, i = divmod(r["block"] * BLOCK_ROWS, height)
        out[m][i : i + BLOCK_ROWS] = np.frombuffer(r["data"], np.float32).reshape(BLOCK_ROWS, -1)
    sent.unpersist()
    return out


def pair_rows(model: Model, keys: np.ndarray) -> np.ndarray:
    """The rows of contexts' pairs, from 0."""
    return model.feature_rows(*np.divmod(keys.astype(np.int64) // (HEAD + TAIL), CONTEXTS))[2] - 2 * CONTEXTS


def counted_contexts(rows: DataFrame, model: Model) -> DataFrame:
    """part, keys, counts: the distinct contexts of all texts and how often each occurs, in rows of at most ROW_CONTEXTS of a part, written."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    parts = min(max(CONTEXT_PARTS, model.n_tokens // PART_TOKENS), MOST_PARTS)

    def row_of(part: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["part", "keys", "counts"])

    def run(batches):
        for keys, counts in distinct_contexts(sent.value, text_blocks(batches)):
            part = (pair_rows(sent.value, keys) * parts // sent.value.pairs).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            keys, counts, ends = keys[order], counts[order], np.cumsum(np.bincount(part, minlength=parts))
            for p, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if b > a:
                    yield row_of(p, keys[a:b], counts[a:b])

    def merge(batches):
        for part, found in groupby(chain.from_iterable(map(context_rows, batches)), itemgetter(0)):
            keys, counts, new, n = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0
            for _, *lot in found:
                new.append(lot)
                n += len(lot[0])
                if n >= COUNTED_CONTEXTS:
                    keys, counts = added_up(*map(np.concatenate, zip((keys, counts), *new, strict=True)))
                    new, n = [], 0
            keys, counts = added_up(*map(np.concatenate, zip((keys, counts), *new, strict=True)))
            order = np.argsort(pair_rows(sent.value, keys).astype(np.uint16), kind="stable")
            for a in range(0, len(keys), ROW_CONTEXTS):
                some = order[a : a + ROW_CONTEXTS]
                yield row_of(part, keys[some], counts[some])

    schema = "part int, keys binary, counts binary"
    lots = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)
    out = C.materialize(lots.repartition("part").sortWithinPartitions("part").mapInArrow(merge, schema), "lm-contexts")
    sent.unpersist()
    return out


def count_tokens(rows: DataFrame, text: str) -> DataFrame:
    """w, n: every distinct token of all rows with its count, written."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(tokens(t))
                if len(held) > HELD_TOKENS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["w", "n"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["w", "n"])

    return C.materialize(rows.select(text).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")), "lm-counts")


def slot_sums(counted: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of counts, and number of distinct tokens, by slot of the tail."""

    def run(batches):
        held = np.zeros((2, slots), np.int64)
        for batch in batches:
            at = ((token_hash(batch.column(0).to_pylist()) >> np.uint64(20)) % np.uint64(slots)).astype(np.int64)
            np.add.at(held[0], at, batch.column(1).to_numpy())
            np.add.at(held[1], at, 1)
        some = np.flatnonzero(held[1])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[0, some]), pa.array(held[1, some])], ["slot", "n", "types"])

    out = np.zeros((2, slots), np.int64)
    got = counted.mapInArrow(run, "slot int, n long, types long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).toArrow()
    out[:, got["slot"].to_numpy()] = got["n"].to_numpy(), got["types"].to_numpy()
    return out[0], out[1]


def by_hash(counted: DataFrame) -> DataFrame:
    """token (the 64-bit hash), n."""

    def run(batch):
        yield pa.RecordBatch.from_arrays([pa.array(token_hash(batch.column(0).to_pylist()).view(np.int64)), batch.column(1)], ["token", "n"])

    return C.map_arrow(counted, run, "token long, n long")


def fit(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the exact counts (token, n) of all tokens that aren't in its index, from all rows of df."""
    spark = df.sparkSession
    C.code_path(spark)
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    counted = count_tokens(rows, "_t")
    # How many tokens occur how often tells the count from which FREQUENT of them are left, ties at the end being left out.
    often = sorted(((r["n"], r["types"]) for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("types")).collect()), reverse=True)
    least = next((n + 1 for (n, _), above in zip(often, np.cumsum([t for _, t in often]), strict=True) if above >= FREQUENT), 1)
    frequent = (F.col("n") >= least) | (F.col("w") == F.lit(END))
    top = [(bytes(r["w"]), r["n"]) for r in counted.where(frequent).collect()]
    n_tokens, types = sum(n * t for n, t in often), sum(t for _, t in often)
    model = fresh(top, n_tokens, types, slot_sums(counted, classes_for(types)[1] * SLOTS))
    rare = C.materialize(by_hash(counted.where(~frequent)), "lm-rare")
    observed = gathered(rows.select("_t"), model, observe_all, n_tokens)
    step(model, observed, at_start(model, observed), FIRST)
    held = counted_contexts(rows.select("_t"), model)
    for _ in range(ROUNDS):
        step(model, observed, gathered(held, model, expect_all), RATE)
    return model, rare


def score(df: DataFrame, model: Model, rare: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` (the key by default), n_tokens, n_known, train_tokens, base_score and score of each row.

    One pass gives a row for each document and one for each of its distinct tokens that isn't
    among the frequent ones; the latter find their counts by hash.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)
    keep = [key] if keep is None else keep
    inner = df.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col(text).alias("_t"))
    sums = ["n_tokens", "n_known", "base", "rest", "model"]
    names = ["_row", *keep, "token", "times", *sums]

    def run(batch):
        own, texts = sent.value, batch.column(len(keep) + 1).to_pylist()
        log_count = np.log10(own.counts + 0.5)
        for a, b in C.blocks(texts):
            data = encode(texts[a:b], own.index)
            first, frequent, at = data.starts[:-1], data.ids >= 0, np.maximum(data.ids, 0)
            slot = data.slots(own) - own.own
            base = np.where(frequent, log_count[at], 0.0)
            added = [np.add.reduceat(x, first) for x in (np.ones(len(at), np.int64), (frequent & (own.counts[at] > 0)).astype(np.int64), base, np.where(slot >= 0, base - own.slot_total[np.maximum(slot, 0)], 0.0), log_prob(own, data) / np.log(10))]
            doc = np.repeat(np.arange(b - a), np.diff(data.starts))[~frequent]
            order = np.lexsort((data.hashes, doc))
            d, h = doc[order], data.hashes[order]
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])) if len(d) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(d)))
            take = pa.array(np.concatenate([np.arange(b - a), d[new]]) + a)
            n, m = b - a, len(new)
            # Rows of documents have a token of their own, so that they are dealt evenly.
            token = np.concatenate([C.mix64(batch.column(0).to_numpy()[a:b].astype(np.uint64)), h[new]]).view(np.int64)
            tail = [pa.array(np.concatenate([s, np.zeros(m, s.dtype)])) for s in added]
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[: len(keep) + 1]), pa.array(token), pa.array(np.concatenate([np.zeros(n), times]).astype(np.int32)), *tail], names)

    added = T.StructType.fromDDL("token long, times int, n_tokens long, n_known long, base double, rest double, model double")
    rows = C.map_arrow(inner, run, T.StructType([*inner.drop("_t").schema, *added]))
    rows = rows.join(rare, "token", "left").withColumn("_c", F.coalesce("n", F.lit(0).cast("long")))
    seen, add = F.col("times") > 0, F.col("times") * F.log10(F.col("_c") + 0.5)
    docs = rows.groupBy("_row", *keep).agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(seen & (F.col("_c") > 0), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(seen, add).otherwise(0.0)).alias("base"),
        F.sum(F.col("rest") + F.when(seen, add).otherwise(0.0)).alias("rest"),
        F.sum("model").alias("model"),
    )
    whole = float(np.log10(model.n_tokens + 0.5 * (model.types + 1)))
    return docs.select(*keep, "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("model") + F.col("rest")).alias("score"))

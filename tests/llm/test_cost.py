"""Steps whose cost decides whether a query keeps to its limits."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import maxent_lm


@pytest.mark.parametrize("kinds", [3, 5000])
def test_lm_rows_are_added(kinds):
    """Rows that repeat often and rows that hardly do give the sums of one addition after the other."""
    rng = np.random.default_rng(kinds)
    at, z = rng.integers(0, kinds, 2000), rng.random((2000, 32), np.float32)
    got, want = np.ones((5000, 32), np.float32), np.ones((5000, 32))
    maxent_lm.add_rows(got, at, z)
    np.add.at(want, at, z)
    assert np.allclose(got, want, rtol=1e-4)


def test_lm_batches_fit_a_cache():
    """Both choices go in batches of at most 256 KB, whatever their number of outcomes."""
    for width in (1, 32, 128):
        parts = list(maxent_lm.batches_of(10_001, np.zeros((1, width), np.float32)))
        assert [i for p in parts for i in range(10_001)[p]] == list(range(10_001)) and all((p.stop - p.start) * width <= 1 << 16 for p in parts)


def test_lm_contexts_held_are_bounded(monkeypatch):
    """A task that counts millions of contexts, all of them distinct, holds less than 160 MB."""
    rng = np.random.default_rng(1)
    monkeypatch.setattr(maxent_lm, "contexts", lambda model, texts: rng.integers(0, 1 << 31, 100_000).astype(np.uint32))
    tracemalloc.start()
    n = sum(int(counts.sum()) for _, counts in maxent_lm.distinct_contexts(None, ([] for _ in range(80))))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 8_000_000 and most < 160e6


def test_lm_context_rows_are_bounded(spark, monkeypatch):
    """The table of distinct contexts has more parts for more tokens, short rows, and every context once."""
    monkeypatch.setattr(maxent_lm, "ROW_CONTEXTS", 16, raising=False)
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(3000)], [1 / (i + 5) for i in range(3000)], k=500)) for _ in range(100)]
    counts = Counter(w for t in texts for w in maxent_lm.tokens(t))
    model = maxent_lm.fresh(list(counts.items()), 1 << 31, len(counts))
    maxent_lm.C.code_path(spark)
    rows = maxent_lm.counted_contexts(spark.createDataFrame([(t,) for t in texts], "_t string").repartition(5), model).collect()
    keys, counts = np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in rows]), np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows])
    want = maxent_lm.merged(keys[:0], counts[:0], [maxent_lm.contexts(model, texts)])
    assert all(np.array_equal(a, b) for a, b in zip(maxent_lm.added_up(keys, counts), want, strict=True)) and len(keys) == len(want[0])
    assert max(len(r["keys"]) for r in rows) <= 64 and len({r["part"] for r in rows}) > 1000


def test_lm_rows_of_long_and_short_runs_are_added():
    rng = np.random.default_rng(7)
    at, z = (rng.zipf(1.3, 5000) % 4000).astype(np.int64), rng.random((5000, 32), np.float32)
    got, want = np.ones((4000, 32), np.float32), np.ones((4000, 32))
    maxent_lm.add_rows(got, at, z)
    np.add.at(want, at, z)
    times = np.bincount(at)
    assert times.max() > maxent_lm.LONG_RUN and (times == 1).any() and np.allclose(got, want, rtol=1e-4)

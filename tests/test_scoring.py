"""Scores within tasks against plain loops."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import fulltext, scoring


def expected(rows, questions, k, bm25=False):
    terms = lambda t: [w for w in (t or "").split() if w]
    average = sum(len(terms(t)) for _, t in rows) / len(rows)
    out = {}
    for q, text in questions:
        by_id = {}
        for i, t in rows:
            by_id.setdefault((i, len(terms(t))), Counter()).update(terms(t))
        sums, longest = {}, {}
        for (i, n), tf in by_id.items():
            for w in set(text.split()) & set(tf):
                df = len({i for i, t in rows if w in terms(t)})
                idf = math.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
                sums[i] = sums.get(i, 0) + (idf * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * n / average)) if bm25 else 1 + math.log(tf[w]))
                longest[i] = max(longest.get(i, 0), n)
        scores = {i: round(s if bm25 else s / (1 + math.log(longest[i])), 9) for i, s in sums.items()}
        for rank, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:k], 1):
            out[q, i, rank] = scores[i]
    return out


@pytest.mark.parametrize("bm25", [False, True])
def test_tasks_keep_the_best_of_each_question(spark, monkeypatch, bm25):
    """Few scores at once, many ties, ids on several rows: ranks are those of a plain loop, and no task passes on more than k a question."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices([f"t{j}" for j in range(12)], k=rng.randint(1, 9)))) for i in range(150)]
    rows += [(i + 200, "t1 t2 t3") for i in range(60)] + [(3, "t1 t1"), (3, "t1 t5"), (4, ""), (5, None)]
    questions = [(q, " ".join(sorted({f"t{rng.randrange(14)}" for _ in range(4)}))) for q in range(7)]
    docs = fulltext.documents_with_terms(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    asked = spark.createDataFrame(questions, "query_id long, text string")
    sizes, plain = [], scoring.best
    monkeypatch.setattr(scoring, "ASKED_ROWS", 9)  # several passes

    def noted(rows, asked, k, add):
        out = plain(rows, asked, k, add)
        sizes.append((out.groupBy("query_id", F.spark_partition_id()).count().agg(F.max("count")).first()[0], k))
        return out

    monkeypatch.setattr(scoring, "best", noted)
    got = (fulltext.bm25_rank if bm25 else fulltext.tf_rank)(docs, asked, 5)
    want = expected(rows, questions, 5, bm25)
    assert {(r.query_id, r.doc_id, r["rank"]): r.score for r in got.collect()} == pytest.approx(want, abs=2e-9)
    assert sizes and all(n <= k for n, k in sizes)


def test_cuts_keep_ties_by_document(monkeypatch):
    monkeypatch.setattr(scoring, "HELD_SCORES", 8)
    monkeypatch.setattr(scoring, "HELD_PRODUCTS", 4)
    asked = pa.table({"query_id": ["a", "b", "a"], "term": ["x", "x", "y"], "weight": [1.0, 2.0, 1.0]})
    held = scoring.Best(asked, 3)
    import numpy as np

    ids = [f"d{i:03}" for i in random.Random(1).sample(range(100), 100)]
    held.add(pa.array(ids), np.arange(100), np.zeros(100, np.int64), np.ones(100), np.ones(100))
    got = [tuple(r.values()) for b in held.rows() for r in b.to_pylist()]
    assert sorted(got) == [(q, f"d{i:03}", s) for q, s in (("a", 1.0), ("b", 2.0)) for i in range(3)]

"""The pipeline's stages against brute force on the smallest tables."""

import random
from collections import defaultdict

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontamination

from .test_llm import EDGES, SCHEMA, brute_components, brute_hits, check_packing


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_language_stage(spark, sf, docs):
    out = P.identify_language(spark, docs, sf)
    assert out.columns == docs.columns
    kept = set(ids(out))
    assert all((r.doc_id in kept) == any(c.isalpha() for c in r.text) for r in docs.collect())


def test_near_duplicates_stage(spark, sf, docs):
    want, _ = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, (80, 100))
    out = P.remove_near_duplicates(spark, docs, sf)
    assert out.columns == docs.columns and ids(out) == sorted(i for i, c in want.items() if i == c)


def test_passages_stage(spark, sf):
    rng = random.Random(3)
    many = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(n))
    passage = many(70)
    rows = [(1, f"{many(30)} {passage}", "en", "a", 0), (2, f"{passage} {many(30)}", "en", "a", 0), (3, passage, "en", "a", 0), (4, many(40), "en", "a", 7), (5, "", "en", "a", 0)]
    out = {r.doc_id: r for r in P.remove_repeated_passages(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()}
    assert set(out) == {1, 2, 4, 5} and passage not in out[2].text
    assert out[2].n_chars == len(out[2].text) and out[4].n_chars == 7


def test_decontamination_stage(spark, sf, docs):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = set()
    for r in docs.collect():
        n, hit, _ = brute_hits(r.text, items)
        if hit and 20 * hit >= n:
            bad.add(r.doc_id)
    assert ids(P.decontaminate(spark, docs, sf)) == sorted(set(ids(docs)) - bad)


def test_run(spark, sf, docs):
    rows = P.run(spark, sf).collect()
    check_packing(rows, 2048)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    assert set(pieces) <= set(ids(docs)) and len(pieces) > 0.7 * docs.count()
    for v in pieces.values():
        v.sort()
        assert [p for p, _, _ in v] == list(range(len(v))) and all(v[i][1] + v[i][2] == v[i + 1][1] for i in range(len(v) - 1))


def test_edges(spark, sf):
    frame = spark.createDataFrame(EDGES, SCHEMA).withColumn("score", F.lit("clash"))
    empty = frame.limit(0)
    for name, stage in P.STAGES:
        out = stage(spark, frame, sf)
        assert out.count() >= 0
        if name != "packing":
            assert out.columns == P.COLUMNS
        assert stage(spark, empty, sf).count() == 0
    assert decontamination.words(None) == []

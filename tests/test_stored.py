"""Stored tables: postings with block maxima, cells of vectors, versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import fulltext, postings, vector, vector_index
from corpusloom.sources import file_index, merge_log, versions

KIND = "doc_id long, text string"


@pytest.fixture(scope="module")
def words():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    return lambda n: " ".join(rng.choices(vocabulary, weights, k=n))


@pytest.fixture(scope="module")
def texts(words):
    rng = random.Random(5)
    rows = [(k, words(rng.choice([1, 3, 10, 200]))) for k in range(600)]
    return [*rows, (900, None), (901, ""), (902, "..."), *[(1000 + k, "w1 w2 tie") for k in range(20)], (2000, "w0 " * 3000), (2001, "alpha beta alpha beta alpha")]


ASKED = [(1, "w1 w2"), (2, "tie"), (3, "nothing such"), (4, None), (5, "w0"), (6, "w40 w50 w3 w59"), (7, ""), (8, "alpha beta"), (9, "beta alpha beta")]


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(ASKED, "query_id long, text string")


@pytest.fixture(scope="module")
def analyzed(spark, texts):
    return fulltext.documents_with_terms(spark.createDataFrame(texts, KIND)).persist()


@pytest.fixture(scope="module")
def index(spark, analyzed, tmp_path_factory):
    """Three epochs of small ranges."""
    base, held = f"file://{tmp_path_factory.mktemp('index')}/at", postings.RANGE
    postings.RANGE = 4
    try:
        postings.build(analyzed.where("doc_id < 300"), base, buckets=8, spread=3)
        postings.append(analyzed.where("doc_id between 300 and 899"), base)
        postings.append(analyzed.where("doc_id in (900, 901, 902)"), base)
        postings.append(analyzed.where("doc_id > 902"), base)
    finally:
        postings.RANGE = held
    return postings.Index(spark, base)


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 1000])
@pytest.mark.parametrize("scorer", ["tf", "bm25"])
def test_stored_postings_rank_as_a_scan(index, analyzed, questions, k, scorer):
    scan = (fulltext.tf_rank if scorer == "tf" else fulltext.bm25_rank)(analyzed, questions, k)
    assert rows(index.top(questions, k, scorer)) == rows(scan)


def test_ranges_are_passed_over(index, questions):
    """The threshold spares most of what has been left after the first ranges."""
    index.top(questions, 5)
    left = index.passed.agg(F.count(F.lit(1)), F.count_if(F.col("bound") < F.col("_least") - postings.SLACK)).first()
    assert left[1] > 0.5 * left[0] > 20


def test_only_folders_of_the_terms_are_read(spark, index):
    asked = spark.createDataFrame([(1, "w40")], "query_id long, term string")
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(index.lists(asked)) < 0.3 * files(index.blocks)


def test_stored_phrases(index, analyzed, questions):
    key = lambda df: sorted((r.query_id, r.doc_id, r.occurrences) for r in df.collect())
    got = key(index.phrases(questions))
    assert got == key(fulltext.phrase_match(analyzed, questions)) and (8, 2001, 2) in got and (9, 2001, 1) in got
    assert rows(index.top_phrases(questions, 5)) == rows(fulltext.phrase_rank(analyzed, questions, 5))


def test_index_of_nothing(spark, analyzed, questions, tmp_path):
    base = f"file://{tmp_path}/none"
    with pytest.raises(FileNotFoundError):
        postings.Index(spark, base)
    postings.build(analyzed.where("doc_id in (900, 901)"), base, 4, 2)
    none = postings.Index(spark, base)
    assert none.total == 2 and none.top(questions).count() == none.phrases(questions).count() == none.top_phrases(questions).count() == 0
    postings.append(analyzed.where("doc_id = 2001"), base)
    assert [r.doc_id for r in postings.Index(spark, base).top(questions.where("query_id = 8"), scorer="bm25").collect()] == [2001]
    postings.build(analyzed.where("doc_id = 5"), base)
    assert len(versions.children(spark, base)) == 2 and postings.Index(spark, base).total == 1


def test_refresh_survives_a_failure(spark, tmp_path):
    base = f"file://{tmp_path}/table"
    assert versions.current(spark, base) is None
    versions.refresh(spark, base, lambda path: spark.range(3).write.parquet(path))

    def fails(path):
        spark.range(9).write.parquet(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        versions.refresh(spark, base, fails)
    assert versions.read(spark, base).count() == 3 and len(versions.children(spark, base)) == 3
    held = versions.read(spark, base)
    versions.refresh(spark, base, lambda path: spark.range(5).write.parquet(path))
    assert versions.read(spark, base).count() == 5 and held.count() == 3  # a reader of the version before may end
    versions.refresh(spark, base, lambda path: spark.range(6).write.parquet(path))
    assert len([x for x in versions.children(spark, base) if x.startswith("v-")]) == 2


# ---- cells

VECTORS = "vec_id long, embedding array<float>"


def around(rng, centre, n, spread=0.3):
    return [(np.array(centre) + rng.normal(0, spread, len(centre))).astype(float).tolist() for _ in range(n)]


@pytest.fixture(scope="module")
def clouds(spark):
    """Eight clouds, one of which holds a third of all vectors; vectors that are null, zero or of another length; copies."""
    rng = np.random.default_rng(7)
    points = [p for c in range(8) for p in around(rng, np.eye(8)[c] * 3, 400 if c == 2 else 100)]
    rows = [*enumerate(points), (5000, None), (5001, []), (5002, [1.0]), (5003, [0.0] * 8), *[(6000 + k, points[0]) for k in range(30)]]
    return spark.createDataFrame(rows, VECTORS).repartition(5).persist()


def tops(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def asking(clouds):
    return clouds.where("vec_id % 40 = 0 or vec_id in (5000, 5002)").selectExpr("vec_id as query_id", "embedding as query_vector")


def test_stored_cells(spark, clouds, asking, tmp_path):
    base = f"file://{tmp_path}/cells"
    vector_index.build(clouds.where("vec_id % 3 > 0"), base, "vec_id", 8)
    vector_index.append(clouds.where("vec_id % 3 = 0"), base, "vec_id")
    vector_index.append(clouds.where("vec_id = 5000"), base, "vec_id")
    want = tops(vector.top_k_batch(clouds.where("size(embedding) = 8"), asking.where("size(query_vector) = 8"), 7, "vec_id"))
    assert tops(vector_index.search(spark, base, asking, 7, 1, exact=True)) == want
    near = {r[::2] for r in tops(vector_index.search(spark, base, asking, 7, 2))}
    assert len(near & {r[::2] for r in want}) >= 0.9 * len(want)
    assert tops(vector_index.search(spark, base, asking, 5000, 1, exact=True)) == tops(vector.top_k_batch(clouds.where("size(embedding) = 8"), asking.where("size(query_vector) = 8"), 5000, "vec_id"))
    assert vector_index.search(spark, base, asking.limit(0), 7).count() == 0


def test_cells_that_drift_are_learned_anew(spark, clouds, asking, tmp_path):
    base = f"file://{tmp_path}/cells"
    vector_index.build(clouds.where("vec_id < 800"), base, "vec_id", 6)
    assert not vector_index.rebuild(spark, base, 6)
    rng = np.random.default_rng(8)
    away = spark.createDataFrame([(9000 + k, p) for k, p in enumerate(around(rng, [-3.0] * 8, 3000, 0.2))], VECTORS)
    vector_index.append(away, base, "vec_id")
    before = versions.current(spark, base)
    assert vector_index.drifted(before) and vector_index.rebuild(spark, base, 8)
    after = versions.current(spark, base)
    assert after["cells"] != before["cells"] and after["fit"] > vector_index._fit(before) and before["cells"] not in versions.children(spark, base)
    both = clouds.where("vec_id < 800").unionByName(away)
    some = asking.where("size(query_vector) = 8")
    assert tops(vector_index.search(spark, base, some, 5, 1, exact=True)) == tops(vector.top_k_batch(both, some, 5, "vec_id"))


def test_cells_of_nothing(spark, clouds, asking, tmp_path):
    with pytest.raises(ValueError, match="no vectors"):
        vector_index.build(clouds.where("vec_id in (5000, 5001)"), f"file://{tmp_path}/none", "vec_id", 4)


def test_one_scan_answers_thousands_of_questions(spark, clouds):
    rng = np.random.default_rng(9)
    many = spark.createDataFrame([(k, p) for k, p in enumerate(around(rng, [0.0] * 8, 5000, 1.0))], "query_id long, query_vector array<float>")
    found = vector.top_k_batch(clouds, many, 3, "vec_id")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {(r.query_id, r["rank"]): r.score for r in found.collect()}
    x = np.array([r.embedding for r in clouds.where("size(embedding) = 8").collect()], np.float64)
    q = np.array([r.query_vector for r in many.orderBy("query_id").collect()], np.float64)
    best = np.sort((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T, axis=1)[:, ::-1]
    assert len(got) == 15_000 and all(abs(got[i, r + 1] - best[i, r]) < 1e-8 for i in range(5000) for r in range(3))


# ---- merges and file indexes


def updates(spark, epoch, rows):
    return spark.createDataFrame([(k, v, t) for k, v, t in rows], "k long, v string, t long").withColumn("extra", F.lit(epoch))


def state_of(spark, base):
    return {r.k: (r.v, r.t) for r in merge_log.read(spark, base, ["k"], "t").collect()}


def test_log_of_merges(spark, tmp_path):
    """Many batches of the same keys: the last version wins, reads meet few runs, batches applied again change nothing."""
    base, rng, want = f"file://{tmp_path}/log", random.Random(3), {}
    assert merge_log.read(spark, base, ["k"], "t") is None
    for epoch in range(18):
        rows = [(k, f"e{epoch}", rng.randrange(6)) for k in {rng.randrange(12) for _ in range(6)}]
        assert merge_log.apply(updates(spark, epoch, rows), base, ["k"], "t", epoch)
        for k, v, t in rows:
            if k not in want or t >= want[k][1]:
                want[k] = (v, t)
        merge_log.compact(spark, base, ["k"], "t")
    assert state_of(spark, base) == want
    runs = merge_log.record(spark, base)[1]["runs"]
    assert sorted(r["level"] for r in runs) == [0, 0, 2]
    assert not merge_log.apply(updates(spark, 17, [(1, "again", 99)]), base, ["k"], "t", 17) and state_of(spark, base) == want
    merge_log.compact(spark, base, ["k"], "t")
    assert len(versions.children(spark, f"{base}/runs")) == 3 and len(versions.children(spark, f"{base}/records")) <= 2 * merge_log.KEEP_RECORDS + 2


def test_merge_beside_a_writer(spark, tmp_path, monkeypatch):
    """A batch that comes in while runs are merged is kept, and so are readers' files."""
    base = f"file://{tmp_path}/log"
    for epoch in range(4):
        merge_log.apply(updates(spark, epoch, [(1, f"e{epoch}", epoch), (10 + epoch, "x", 0)]), base, ["k"], "t", epoch)
    reader = merge_log.read(spark, base, ["k"], "t")
    held, merged = merge_log.commit, []

    def late(spark, base, change):
        if not merged:
            merged.append(1)
            merge_log.apply(updates(spark, 4, [(1, "late", 9)]), base, ["k"], "t", 4)
        return held(spark, base, change)

    monkeypatch.setattr(merge_log, "commit", late)
    assert merge_log.compact(spark, base, ["k"], "t") == 1
    assert state_of(spark, base) == {1: ("late", 9), **{10 + e: ("x", 0) for e in range(4)}}
    assert {r.k: r.v for r in reader.collect()}[1] == "e3"
    assert sorted(r["level"] for r in merge_log.record(spark, base)[1]["runs"]) == [0, 1]


def test_upsert_stream(spark, tmp_path):
    source, base = tmp_path / "in", f"file://{tmp_path}/log"
    for epoch in range(5):
        updates(spark, epoch, [(epoch % 2, f"e{epoch}", epoch), (7, f"e{epoch}", 1)]).coalesce(1).write.parquet(f"{source}/{epoch}")
    stream = spark.readStream.schema("k long, v string, t long, extra int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    merge_log.upsert_stream(stream, base, ["k"], "t", str(tmp_path / "state")).awaitTermination()
    assert state_of(spark, base) == {0: ("e4", 4), 1: ("e3", 3), 7: ("e4", 1)}
    assert len(merge_log.record(spark, base)[1]["runs"]) == 2


def test_lookup_reads_the_files_that_hold_a_value(spark, tmp_path):
    table, base = f"file://{tmp_path}/table", f"file://{tmp_path}/index"
    ids = [*[f"doc/{k:05d}" for k in range(4000)], None]
    rows = spark.createDataFrame([(x, k, k % 3) for k, x in enumerate(ids)], "doc_id string, n long, level int")
    rows.repartition(24, F.xxhash64("doc_id")).write.partitionBy("level").parquet(table)
    file_index.build(spark, table, base, ["doc_id", "n"])
    every = len(spark.read.parquet(table).inputFiles())
    found = file_index.lookup(spark, table, base, "doc_id", ["doc/00777"])
    assert [(r.n, r.level) for r in found.collect()] == [(777, 0)] and len(found.inputFiles()) <= 4 < every
    assert {r.doc_id for r in file_index.lookup(spark, table, base, "n", [5, 3999, 123456]).collect()} == {"doc/00005", "doc/03999"}
    assert file_index.lookup(spark, table, base, "doc_id", ["doc/x", "zzz"]).count() == 0
    hits = [len(file_index.files_with(spark, base, "doc_id", [f"doc/{k:05d}"])) for k in range(0, 4000, 400)]
    assert sum(hits) <= 4 * len(hits) and min(hits) >= 1


def test_write_tasks_grow_with_the_terms(spark, tmp_path, monkeypatch):
    """Blocks are written by as many tasks as the terms ask for, whatever the spread, and hold the rows of a scan."""
    monkeypatch.setattr(postings, "PART_TERMS", 200)
    monkeypatch.setattr(postings, "RANGE", 8)
    texts = [(i, " ".join(f"t{i * j % 17}" for j in range(1, 3 + i % 9))) for i in range(300)]
    docs = fulltext.documents_with_terms(spark.createDataFrame(texts, "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "t1 t5"), (2, "t3 t16 t0")], "query_id long, text string")
    base = f"file://{tmp_path}/many"
    postings.build(docs, base, buckets=1, spread=1)
    assert len(list(tmp_path.glob("many/epoch=*/bucket=0/*.parquet"))) >= 3
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())
    assert key(postings.Index(spark, base).top(asked, 20)) == key(fulltext.tf_rank(docs, asked, 20))

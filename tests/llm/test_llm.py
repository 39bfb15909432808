"""The training-data operators: edge cases, brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common as C
from corpusloom.llm import decontamination, html_extract, language_id, maxent_lm, ngram_join, packing, quality, queries, sharding, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} filler" for i in range(30_000))
EDGES = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "the cat sat on the mat", "en", "a", 22), (3, "the cat sat on the mat", "en", "a", 22), (4, LONG, "en", None, len(LONG)),
    (5, "der hund und die katze", "de", "b", 22), (6, "  \n\t ", None, "b", 5), (7, "12345 !!! ...", None, None, 13), (8, "ñandú Ünïcödé 𝔘𝔫𝔦 日本語", None, "c", 20), (9, "the cat sat on the mat", None, "d", 22), (None, "no id here", None, None, 10),
]
#: names that operators give their own columns
CLASH = ["score", "lang_pred", "n_words", "n_hit", "items", "spans", "owners", "n_removed", "shard", "slot", "rank", "bucket", "token", "component"]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# ---- 1


def test_language_edges(spark, edges, empty):
    said = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog sat on that mat with this hat", "en"), ("der hund und die katze sind auf dem tisch nicht hier", "de")] * 3)]
    model = language_id.fit(spark.createDataFrame([*said, (9, None, "en"), (10, "x", None)], "doc_id long, text string, lang string"))
    rows = language_id.predict(edges, model).collect()
    assert len(rows) == len(EDGES) and set(rows[0].asDict()) == {*edges.columns}
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in rows}
    assert all(got[k] == ("und", 0.0) for k in ((1, None), (2, ""), (6, "  \n\t "), (7, "12345 !!! ...")))
    assert got[3, "the cat sat on the mat"][0] == "en" and got[5, "der hund und die katze"][0] == "de"
    assert language_id.predict(empty, model).count() == 0
    blank = language_id.predict(edges, language_id.fit(empty), keep=["doc_id"])
    assert {r.lang_pred for r in blank.collect()} == {"und"}


def test_language_is_a_function_of_the_text(spark, docs):
    """Neighbours in a batch and the number of partitions change nothing."""
    model = language_id.fit(docs)
    texts = ["ok go", "zug", "que", "la", "the", "", None, "a", *[r.text for r in docs.select("text").limit(60).collect()]]
    names, scores = language_id.score_texts(model, texts)
    alone = [language_id.score_texts(model, [t]) for t in texts]
    assert names == [n for (n,), _ in alone] and scores.tolist() == [s[0] for _, s in alone]
    rows = [{(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(docs.repartition(n), language_id.fit(docs.repartition(n)), keep=["doc_id"]).collect()} for n in (1, 64)]
    assert rows[0] == rows[1]


def test_language_of_long_texts_and_of_many_languages(spark, docs, monkeypatch):
    """A text in pieces has the n-grams of the whole; no language is left out however many there are."""
    model = language_id.fit(docs)
    long = " ".join(r.text for r in docs.where("text is not null").select("text").limit(40).collect()) + " ΟΔΟΣ"
    whole, _ = language_id.ngrams([f"{long.lower()}  "], 15)
    parts = np.concatenate([language_id.ngrams([p], 15)[0][:-2] for p in language_id.pieces(long, 101)])
    assert (parts == whole[:-2]).all()
    names, scores = language_id.score_texts(model, ["the", long, None])
    monkeypatch.setattr(C, "BLOCK_CHARS", 97)
    again, near = language_id.score_texts(model, ["the", long, None])
    assert again == names and np.allclose(scores, near, atol=1e-6)
    assert (language_id.fit(docs).log_prob == model.log_prob).all()
    said = spark.range(600).selectExpr("id AS doc_id", "concat('l', id) AS lang")
    said = said.withColumn("text", F.translate(F.concat_ws(" ", *(F.md5(F.concat(F.lit(k), F.col("doc_id").cast("string"))) for k in "abcd")), "0123456789", "ghijklmnop"))
    many = language_id.fit(said)
    assert len(many.langs) == 600 and many.log_prob.size <= language_id.CELLS + 600
    got = language_id.predict(said, many).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 590


def test_language_held_out(spark, sf, docs):
    got = queries.op1_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


# ---- 2


def brute_components(rows, k, share):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if y < x and any(a and b and share[1] * len(a & b) >= share[0] * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}, {i: [len(s) for s in v] for i, v in sets.items()}


@pytest.mark.parametrize(("k", "share"), [(4, (85, 100)), (5, (80, 100)), (1, (70, 100))])
def test_join_groups(spark, k, share):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for g in range(14):
        base = rng.choices(words, k=rng.choice([3, 8, 20, 60, 200]))
        for c in range(rng.choice([3, 10, 40])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 30)) if c % 3 else 0):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((i, " ".join(own)))
            i += 1
    rng.shuffle(rows)
    want, sizes = brute_components(rows, k, share)
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), k=k, share=share).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles in sizes[r.doc_id] for r in got)


def test_join_blocks(spark, monkeypatch):
    """A large group of near copies that mostly don't link, cut into many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 2000)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    want, _ = brute_components(rows, 4, (85, 100))
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_join_text_ids(spark):
    rng = random.Random(17)
    words = [f"w{i}" for i in range(500)]
    bases = [rng.choices(words, k=60) for _ in range(4)]
    rows = [(f"id{i:03d}", " ".join(w if rng.random() > 0.01 else rng.choice(words) for w in bases[i % 4])) for i in range(80)]
    want, _ = brute_components(rows, 4, (85, 100))
    assert {r.doc_id: r.component_id for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id string, text string")).collect()} == want


def test_join_edges(edges, empty):
    rows = ngram_join.similar(edges).collect()
    assert len(rows) == len(EDGES)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[6] == (0, 6)
    assert got[3] == (3, 3) and got[9] == (3, 3) and got[None] == (1, None)
    assert ngram_join.similar(empty).count() == 0


def test_divide_skip_exact():
    rng = random.Random(1)
    for _ in range(200):
        own = np.array(sorted(rng.sample(range(60), rng.randint(1, 40))), np.uint64)
        others = [np.array(sorted(rng.sample(range(60), rng.randint(1, 40))), np.uint64) for _ in range(rng.randint(1, 30))]
        want = [i for i, o in enumerate(others) if 100 * len(np.intersect1d(own, o)) >= 60 * len(np.union1d(own, o))]
        assert sorted(ngram_join.divide_skip(own, others, (60, 100))) == want


def test_join_query(spark, sf, docs):
    want, _ = brute_components(list(texts_of(docs).items()), 4, (85, 100))
    assert {r.doc_id: r.component_id for r in queries.op2_ngram_join(spark, sf).collect()} == want


# ---- 3


def test_chunks_are_the_text_and_resist_shifts():
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 122, 20_000, dtype=np.uint8))
    cut = substring_dedup.chunks(text)
    assert b"".join(text[a:b] for a, b in cut) == text
    own, moved = ({t[a:b] for a, b in substring_dedup.chunks(t)} for t in (text, b"inserted" + text))
    assert len(own & moved) >= 0.98 * len(own)
    assert substring_dedup.chunks(b"") == [] and max(b - a for a, b in substring_dedup.chunks(b"a" * 1000)) <= substring_dedup.LONGEST


def test_dedup_passages(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnopé", k=rng.randint(2, 9)))
    many = lambda n: " ".join(word() for _ in range(n))
    passages = [many(60) for _ in range(20)]
    short = many(20)
    rows = [(i, f"{many(80)} {passages[i % 20]} {many(50)} {short if i % 3 else many(20)}") for i in range(60)]
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = 0
    for i, text in rows:
        if i < 20:
            assert got[i].text == text and got[i].n_removed == 0
        elif passages[i % 20] in got[i].text:
            missed += 1
        else:
            assert set(got[i].owners) <= {i % 20, i - 20} and got[i].owners
            before = [text[: s.start] for s in got[i].spans]
            assert got[i].text.startswith(before[0]) and short in got[i].text or i % 3 == 0
    assert missed <= 1


def test_least_around_against_brute_force():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 5, 19, 20, 21, 22, 64, 300):
        for radius in (3, 8, 20):
            h = rng.integers(0, 12, n).astype(np.uint16)
            before, behind = substring_dedup.least_around(h, radius)
            top = np.iinfo(np.uint16).max
            assert before.tolist() == [min(h[max(0, i - radius) : i].tolist(), default=top) for i in range(n)]
            assert behind.tolist() == [min(h[i + 1 : i + 1 + radius].tolist(), default=top) for i in range(n)]


def brute_dedup(rows, min_words):
    """Code points of each document that stand in a stretch of whole words, min_words or more, which an earlier document has."""
    marks = {}
    texts = dict(rows)
    ids = sorted(texts)
    for x in ids:
        own = texts[x].split(" ")
        at = np.cumsum([0] + [len(w) + 1 for w in own])
        hit = np.zeros(len(own), bool)
        for y in ids:
            if y >= x:
                break
            other = texts[y].split(" ")
            run = np.zeros(len(other) + 1, np.int64)
            for i, w in enumerate(own):
                new = np.zeros(len(other) + 1, np.int64)
                same = np.flatnonzero([w == v for v in other])
                new[same + 1] = run[same] + 1
                run = new
                if run.max() >= min_words:
                    hit[i + 1 - int(run.max()) : i + 1] = True
        marks[x] = {c for i in np.flatnonzero(hit) for c in range(at[i], at[i] + len(own[i]))}
    return marks


def test_dedup_against_brute_force(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    many = lambda n: rng.choices(words, k=n)
    pool = [many(rng.randint(30, 90)) for _ in range(25)]
    rows = []
    for i in range(80):
        parts = many(rng.randint(10, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(pool)
            a = rng.randint(0, 10)
            parts += p[a : a + rng.randint(20, 90)] + many(rng.randint(3, 30))
        rows.append((i, " ".join(parts)))
    got = {r.doc_id: {c for s in r.spans for c in range(s.start, s.end)} for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts, want = dict(rows), brute_dedup(rows, 40)
    assert sum(len(v) for v in want.values()) > 5000
    for i, own in want.items():
        assert {c for c in got[i] if texts[i][c] != " "} - own == set()  # nothing else goes
    missed = sum(len({c for c in own if texts[i][c] != " "} - got[i]) for i, own in want.items())
    assert missed <= 0.01 * sum(len(v) for v in want.values())


def test_dedup_of_halves_with_two_owners(spark):
    """A passage of 70 words in documents 2 and 3, whose halves stand in 0 and 1, goes from 3."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    many = lambda n: " ".join(word() for _ in range(n))
    rows, asked = [], []
    for k in range(200):
        a, b = many(35), many(35)
        own = [f"{many(20)} {a} {many(20)}", f"{many(20)} {b} {many(20)}", f"{many(20)} {a} {b} {many(20)}", f"{many(20)} {a} {b} {many(20)}"]
        rows += [(4 * k + i, t) for i, t in enumerate(own)]
        asked.append((4 * k + 3, f"{a} {b}"))
    got = {r.doc_id: r.text for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(p not in got[i] for i, p in asked) >= 198
    assert all(got[4 * k + i] == dict(rows)[4 * k + i] for k in range(200) for i in range(3))


def test_dedup_with_partial_holders_between(spark):
    """54 words stand whole in documents 2 and 5; words 1 to 39 and 16 to 54 stand in 0 and 1, and again in 3 and 4, so every chunk's first and last holder has a part only."""
    rng = random.Random(15)
    many = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n)]
    around = lambda part: " ".join(many(20) + part + many(20))
    rows, asked = [], []
    for k in range(200):
        p = many(54)
        for i, part in enumerate((p[:39], p[15:], p, p[:39], p[15:], p)):
            rows.append((6 * k + i, around(part)))
        asked.append((6 * k + 5, " ".join(p)))
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(p not in got[i].text for i, p in asked) >= 196
    assert all(got[6 * k + i].n_removed == 0 for k in range(200) for i in range(3))


def test_dedup_of_many_and_long_repeats(spark, monkeypatch):
    """A passage that many documents hold, one repeated many times in a document, long passages found by slices of their own, and text of one word."""
    monkeypatch.setattr(substring_dedup, "REACH", 32)
    monkeypatch.setattr(substring_dedup, "HOLDERS", 8)
    rng = random.Random(14)
    many = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))
    passage, long = many(60), many(3000)
    rows = [(i, f"{many(20)} {passage} {many(20)}") for i in range(100)]
    rows += [(200, " ".join(f"{passage} {many(3)}" for _ in range(50))), (300, f"{many(9)} {long}"), (301, f"{long} {many(30)}"), (400, "word " * 5000), (401, "word " * 4000)]
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and all(passage not in got[i].text for i in range(1, 100))
    assert len(got[200].spans) == 50 and got[300].n_removed == 0 and got[301].n_removed >= len(long)
    assert got[400].n_removed == 0


def test_dedup_edges(edges, empty):
    rows = substring_dedup.dedup(edges).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in rows) == sorted((str(r[0]), r[1] or "") for r in EDGES)
    assert substring_dedup.dedup(empty).count() == 0


def test_dedup_copies(spark):
    text = " ".join(f"w{i * 7919 % 1009}" for i in range(200))
    rows = [(1, text), (1, text), (2, text), (3, text + " tail"), (None, text)]
    got = Counter((r.doc_id, r.text) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, text): 2, (2, ""): 1, (3, " tail"): 1, (None, text): 1})


# ---- 4


def test_cuts_against_brute_force():
    def least(sizes, shards):
        def fits(cap):
            n, held = 1, 0
            for s in sizes:
                if s > cap:
                    return False
                n, held = (n + 1, s) if held + s > cap else (n, held + s)
            return n <= shards

        return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))

    rng = random.Random(4)
    for _ in range(100):
        sizes = np.array([rng.choice([1, 2, 3, 5, 8, 40]) for _ in range(rng.randint(1, 30))])
        shards = rng.randint(1, 8)
        shard = sharding.partition(sizes, shards).tolist()
        sums = np.bincount(shard, sizes)
        assert shard == sorted(shard) and max(shard) < shards and max(sums) == least(sizes.tolist(), shards)
        order = sharding.ordered(sizes, shards)
        assert sorted(order.tolist()) == list(range(len(sizes)))
        placed = np.bincount(sharding.place(sizes, shards), sizes, shards)
        assert placed.sum() == sizes.sum() and max(placed) <= sizes.sum() / shards + max(sizes)


@pytest.mark.parametrize("kind", ["lognormal", "uniform", "pareto"])
def test_cuts_decide_over_many_units(kind):
    """Units in the order of their hashes: the largest sum is the smallest that this order allows, below that of filling each shard to its even share, and shards are even."""
    rng, shards = np.random.default_rng(11), 40
    sizes = {"lognormal": rng.lognormal(7, 1, 40_000), "uniform": rng.uniform(1, 5000, 40_000), "pareto": (rng.pareto(2.5, 40_000) + 1) * 500}[kind].astype(np.int64)
    order = sharding.ordered(sizes, shards)
    own = sizes[order]
    cut = sharding.partition(own, shards)
    sums = np.bincount(cut, own, shards)
    ends = np.cumsum(own)
    assert sharding.cuts_within(ends, 0, int(sums.max()), shards) and sharding.cuts_within(ends, 0, int(sums.max()) - 1, shards) is None
    filled = np.minimum((ends - own) // -(-own.sum() // shards), shards - 1)  # a new shard where an even share is full
    assert (filled != cut).any() and sums.max() < np.bincount(filled, own, shards).max() and sums.max() - sums.min() <= 0.02 * own.sum() / shards
    small = sizes[order] * sharding.LARGE <= sizes.sum() / shards
    assert small.mean() > 0.8 and (np.diff(order[small]) > 0).mean() > 0.99  # nearly all stand as given


def test_one_hot_group_has_a_shard():
    sizes = np.array([5000, *[7] * 2000, *range(1, 60)])
    sums = np.bincount(sharding.place(sizes, 10), sizes, 10)
    assert max(sums) == 5000 and max(np.delete(sums, sums.argmax())) - min(sums) <= 60


def test_sharding_edges(edges, empty):
    rows = sharding.assign(edges, 4).collect()
    assert len(rows) == len(EDGES)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in rows if r.size == 38 and r.text_crc32 == zlib.crc32(b"the cat sat on the mat")}) == 1
    assert sharding.assign(empty, 4).count() == 0


def test_sharding_query(spark, sf, docs):
    rows = queries.op4_sharding(spark, sf).collect()
    text, shards = texts_of(docs), defaultdict(set)
    sums = Counter()
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        shards[raw].add(r.shard)
        sums[r.shard] += r.size
    assert all(len(s) == 1 for s in shards.values()) and len(rows) == len(text)


def test_shards_are_even(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    sums = [r["n"] for r in sharding.assign(docs, 40).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sums) == 40 and max(sums) - min(sums) <= 0.02 * sum(sums) / 40


# ---- 5


def brute_hits(text, items, window=13):
    w = decontamination.words(text)
    hit, found = set(), set()
    for name, t in items:
        x = decontamination.words(t)
        for k in range(max(1, len(x) - window + 1) if x else 0):
            own = x[k : k + window]
            for a in range(len(w) - len(own) + 1):
                if w[a : a + len(own)] == own:
                    hit.update(range(a, a + len(own)))
                    found.add(name)
    return len(w), len(hit), found


def test_decontamination(spark, edges, empty):
    rng = random.Random(6)
    words = [f"t{i}" for i in range(40)] + ["ÉTÉ", "été", "naïve"]
    items = [(str(i), " ".join(rng.choices(words, k=rng.choice([1, 5, 13, 20, 30])))) for i in range(25)] + [("7", "t1, t2-t3!"), ("x", None), ("y", "...")]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choices(words, k=30))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), (rng.choice(items)[1] or "").upper() if i % 2 else rng.choice(items)[1] or "")
        rows.append((i, " ".join(parts)))
    bench = spark.createDataFrame(items, "item_id string, text string")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    index = decontamination.build_index(frame, "text", ["doc_id"])
    assert sum(len(r.docs) for r in index.collect()) == 60  # a stored index serves several searches
    for block_words in (1_000_000, 20):  # in one block and in many
        for r in decontamination.search(index, bench, block_words=block_words).collect():
            n, hit, found = brute_hits(rows[r.doc_id][1], items)
            assert (r.n_words, r.n_hit, set(r.items)) == (n, hit, found)
            assert sum(s.end - s.start for s in r.spans) == hit
    assert decontamination.match(edges, bench).count() == len(EDGES)
    assert decontamination.match(empty, bench).count() == 0
    none = decontamination.match(edges, bench.limit(0)).select("n_hit", decontamination.items_digest().alias("d")).distinct().collect()
    assert [(r.n_hit, r.d) for r in none] == [(0, hashlib.sha256(b"").hexdigest())]


def test_proximity(spark):
    bench = spark.createDataFrame([("a", "red green blue"), ("b", "x y")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "blue one green two red"), (2, "blue 1 2 3 4 5 6 green red"), (3, "y x"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.items, [(s.start, s.end) for s in r.spans]) for r in decontamination.match(docs, bench, proximity=5).collect()}
    assert got == {1: (["a"], [(0, 5)]), 2: ([], []), 3: (["b"], [(0, 2)]), 4: ([], [])}


def test_near_against_brute_force():
    rng = random.Random(15)
    for _ in range(40):
        texts = [" ".join(rng.choices("abcdefg", [1, 2, 3, 4, 9, 9, 9], k=rng.randint(0, 60))) for _ in range(4)]
        segment, asked, span = decontamination.Segment.of_texts(texts), rng.sample("abcd", rng.randint(1, 3)), rng.randint(2, 9)
        items = decontamination.build_items([("x", " ".join(asked))], 13)
        got = segment.hits(items, span)
        for d, t in enumerate(texts):
            w = t.split()
            want = {k for a in range(len(w)) for b in range(a + 1, min(len(w), a + span) + 1) if set(asked) <= set(w[a:b]) and not set(asked) <= set(w[a + 1 : b]) and not set(asked) <= set(w[a : b - 1]) for k in range(a, b)}
            spans = got.get(d, (set(), []))[1]
            assert {k for a, b in spans for k in range(a, b)} == want


# ---- 6


def test_tokenizer_parity(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = [*texts_of(docs).values(), "", " ", "a  b\n\n\tc", "<|endoftext|>", "x <|endoftext|>\n<|endoftext|", "日本語 𝔘 ñ\x00\x7f", "it's we'll I'D", "é" * 50, "\r\n  x"]
    texts += [" " * 1_000_000, "w" * 1_000_000, "a" + "\n \u00a0\t" * 100_000 + "b", " " * (packing.LONG_SPACE - 1) + "x"]
    encode = packing.encoder(packing.default_tokenizer())
    assert all(encode(x) == e.ids for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True))


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_edges(edges, empty):
    parts = C.materialize(packing.pieces(edges, with_ids=True), "pieces")
    rows = packing.pack(parts).collect()
    check_packing(rows, 2048)
    enc = packing.encoder(packing.default_tokenizer())
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.piece)):
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 2048
        whole[r.doc_id].append(r)
    for i, t, *_ in EDGES:
        if i != 3:
            got = [x for r in whole[i] for x in r.ids]
            assert got == [*enc(t or ""), 0] and all(r.length == 2048 for r in whole[i][1:])
            assert [r.start for r in whole[i]] == list(np.cumsum([0, *(r.length for r in whole[i])])[:-1])
    assert len(whole[3]) == 2
    assert packing.pack(C.materialize(packing.pieces(empty), "pieces")).count() == 0


def test_best_two_fit():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 400))
        counts = np.bincount(lengths, minlength=101)
        patterns = packing.best_two_fit(counts, 100)
        used = np.zeros(101, np.int64)
        for pattern, times in patterns:
            assert sum(pattern) <= 100
            for n in pattern:
                used[n] += times
        assert (used == counts).all()
        bins = sum(t for _, t in patterns)
        assert bins <= 1.1 * -(-int(lengths.sum()) // 100) + 2 or bins <= (lengths > 50).sum() + 2
    # 60 alone with 35 leaves 5; two pieces of 20 fit the gap of 40 whole.
    assert packing.best_two_fit(np.bincount([60, 35, 20, 20], minlength=101), 100)[0] == ([60, 20, 20], 1)


def test_packing_query(spark, sf):
    rows = queries.op6_packing(spark, sf).collect()
    total = sum(r.length for r in rows)
    assert check_packing(rows, 2048) <= 1.02 * -(-total // 2048) + 1


# ---- 7


def test_simhash_edges(edges, empty, spark):
    rows = simhash.fingerprint_edits(edges.select("doc_id", "text")).collect()
    assert len(rows) == len(EDGES)
    prints = defaultdict(set)
    order = sorted(((-1 if r[0] is None else r[0], r[1] or "") for r in EDGES), reverse=True)
    want = Counter()
    for k, (i, t) in enumerate(order):
        n, nxt = len(t) // 3, order[(k + 1) % len(order)][1]
        want[i, hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()] += 1
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.edited_sha256) for r in rows) == want
    for r in rows:
        prints[{str(x[0]): x[1] for x in EDGES}[str(r.doc_id)] or ""].add((r.hi, r.lo))
    assert all(len(v) == 1 for v in prints.values()) and prints[""] == {(0, 0)}
    assert simhash.fingerprint_edits(empty).count() == 0
    one = simhash.fingerprint_edits(spark.createDataFrame([(5, "abc def")], "doc_id long, text string")).first()
    assert (one.next_hi, one.next_lo) == (one.hi, one.lo)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_buckets_of_any_keys(spark, kind):
    """One far key, text keys with quotes, ties and nulls: buckets stay even and in order, and edits take the next text."""
    rng = random.Random(3)
    keys = [*range(3000), 1 << 60, 5, 5] if kind == "long" else [f"id'{i}\\\"" for i in range(3000)] + ["zz", "zz"]
    rows = [(k, f"text {rng.random()} of some words {i}") for i, k in enumerate(keys)] + [(None, "none")]
    frame = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    got = simhash.ordered_buckets(frame, "doc_id").groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("bucket").collect()
    assert len(got) > 20 and max(r.n for r in got) < 300 and all(x.b < y.a for x, y in zip(got, got[1:], strict=False))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]), reverse=True)
    want = Counter()
    for k, (i, t) in enumerate(order):
        n, nxt = len(t) // 3, order[(k + 1) % len(order)][1]
        want[i, hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in simhash.fingerprint_edits(frame).select("doc_id", "edited_sha256").collect()) == want

def test_simhash_votes(spark):
    text = " ".join(f"w{i % 50}" for i in range(70))
    frame = spark.createDataFrame([(1, text)], "k int, t string")
    hashes = [r.h for r in simhash.terms(frame, "t", "x").select(F.explode("x").alias("h")).collect()]
    second = [r.h for r in spark.createDataFrame([(h,) for h in hashes], "a long").select(F.xxhash64("a", F.lit(1)).alias("h")).collect()]
    got = simhash.fingerprints(frame, ["k"], "t").first()
    for value, own in ((got.hi, hashes), (got.lo, second)):
        bits = [2 * sum((h >> b) & 1 for h in own) > len(own) for b in range(64)]
        assert value & (1 << 64) - 1 == sum(1 << b for b, v in enumerate(bits) if v)


def test_simhash_many_terms(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(500))
    frame = spark.createDataFrame([(1, text)], "k int, t string")
    whole = simhash.fingerprints(frame, ["k"], "t").first()
    monkeypatch.setattr(simhash, "TERMS_A_ROW", 100)
    assert simhash.fingerprints(frame, ["k"], "t").first() == whole


def test_near_is_exact(spark):
    rng = random.Random(7)
    base = [(rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63)) for _ in range(30)]
    points = set(base)
    for hi, lo in base:
        for _ in range(4):
            a, b = hi, lo
            for bit in rng.sample(range(127), rng.randint(1, 6)):
                a, b = (a ^ (1 << bit), b) if bit < 63 else (a, b ^ (1 << (bit - 63) % 63))
            points.add((a, b))
    mask = (1 << 64) - 1
    apart = lambda p, q: bin((p[0] ^ q[0]) & mask).count("1") + bin((p[1] ^ q[1]) & mask).count("1")
    want = {(p, q) for p in base for q in points if apart(p, q) <= 3}
    got = simhash.near(spark.createDataFrame(base, "hi long, lo long"), spark.createDataFrame(list(points), "hi long, lo long"), 3).collect()
    assert {((r.hi, r.lo), (r.other_hi, r.other_lo)) for r in got} == want


def test_simhash_query(spark, sf, docs):
    rows = queries.op7_simhash(spark, sf).collect()
    text = texts_of(docs)
    assert len(rows) == len(text) and all(r.n_chars == len(text[r.doc_id]) for r in rows)
    long = [r for r in rows if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.98 * len(long)


# ---- 8


def brute_base(rows):
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(maxent_lm.tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, {i: (len(maxent_lm.tokens(t)), sum(counts[w] > 0 for w in maxent_lm.tokens(t)), sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in maxent_lm.tokens(t))) for i, t in rows}


def test_lm_query(spark, sf, docs):
    n, want = brute_base(list(texts_of(docs).items()))
    rows = queries.op8_language_model(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[r.doc_id][:2], n)
        assert r.base_score == pytest.approx(want[r.doc_id][2])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_is_a_distribution():
    """Slots add up to 1, and so do the tokens of a tail slot with the half count that it leaves to unknown ones."""
    counts = [(f"w{i}".encode(), 9000 - i) for i in range(8000)] + [(maxent_lm.END, 50)]
    model = maxent_lm.fresh(counts, sum(n for _, n in counts), len(counts))
    sums = [[np.zeros(w.shape, np.float32) for w in model.weights] for _ in range(2)]
    texts = [" ".join(f"w{i * 7 % 8000}" for i in range(k, k + 500)) for k in range(20)]
    maxent_lm.observe(model, texts, sums[0])
    maxent_lm.step(model, sums[0], maxent_lm.at_start(model, sums[0]), 0.5)
    maxent_lm.expect(model, texts, sums[1])
    maxent_lm.step(model, *sums, 0.3)
    assert all(np.abs(w).max() > 0.1 for w in model.weights) and model.own < 8000
    total, slots = 0.0, set()
    for w, k in counts:
        data = maxent_lm.encode([f"w3 {w.decode()}" if w else "w3"], model.index)
        p, at = np.exp(maxent_lm.log_prob(model, data)[1]), data.slots(model)[1] - model.own
        total += p if at < 0 else p * (k + 0.5) / 10 ** model.slot_total[at]
        if at >= 0 and at not in slots:
            slots.add(at)
            total += p * 0.5 / 10 ** model.slot_total[at]
    assert len(slots) == model.tail * maxent_lm.SLOTS and total == pytest.approx(1, abs=1e-3)


def test_lm_gradient_is_the_derivative():
    """Observed less expected counts are the derivative of the log likelihood by each weight."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(150)], range(1, 151), k=300)) for _ in range(10)]
    counts = Counter(w for t in texts for w in maxent_lm.tokens(t))
    model = maxent_lm.fresh(list(counts.items()), sum(counts.values()), len(counts))
    observed, expected = ([np.zeros(w.shape, np.float32) for w in model.weights] for _ in range(2))
    maxent_lm.observe(model, texts, observed)
    maxent_lm.step(model, observed, maxent_lm.at_start(model, observed), 0.5)
    maxent_lm.expect(model, texts, expected)
    data = maxent_lm.encode(texts, model.index)
    for m, (row, choice) in ((m, at) for m in (0, 1) for at in rng.sample(np.argwhere(observed[m] > 1).tolist(), 5)):
        held, ends = model.weights[m][row, choice], []
        for d in (-0.05, 0.05):
            model.weights[m][row, choice] = held + d
            ends.append(maxent_lm.log_prob(model, data).sum())
        model.weights[m][row, choice] = held
        assert (ends[1] - ends[0]) / 0.1 == pytest.approx(observed[m][row, choice] - expected[m][row, choice], abs=0.05)


def test_lm_expects_over_every_training_document(spark, monkeypatch):
    """Expected counts of each step are those of all training documents, token by token, however many contexts a task holds."""
    rng, seen = random.Random(5), []
    texts = [" ".join(rng.choices([f"w{i}" for i in range(60)], range(1, 61), k=40)) for _ in range(50)]
    plain = maxent_lm.gathered

    def noted(rows, model, add, *rest):
        weights = [w.copy() for w in model.weights]
        out = plain(rows, model, add, *rest)
        if add is maxent_lm.expect_all:
            seen.append((replace(model, weights=weights), out))
        return out

    monkeypatch.setattr(maxent_lm, "gathered", noted)
    maxent_lm.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert len(seen) == maxent_lm.ROUNDS
    for model, got in seen:
        want = [np.zeros(w.shape, np.float64) for w in model.weights]
        for m, _, at, z, _ in maxent_lm.decisions(model, maxent_lm.encode(texts, model.index)):
            p = np.exp(z - z.max(1, keepdims=True))
            for r in at:
                np.add.at(want[m], r, p / p.sum(1, keepdims=True))
        assert all(np.allclose(g, w, rtol=1e-3, atol=1e-3) for g, w in zip(got, want, strict=True))
    monkeypatch.setattr(maxent_lm, "COUNTED_CONTEXTS", 100)
    monkeypatch.setattr(maxent_lm, "HELD_CONTEXTS", 50)
    few = [np.zeros(w.shape, np.float32) for w in model.weights]
    lots = list(maxent_lm.distinct_contexts(model, (texts[i : i + 3] for i in range(0, 50, 3))))
    for keys, counts in lots:
        maxent_lm.expect_at(model, keys, counts, few)
    assert len(lots) > 2 and sum(c.sum() for _, c in lots) == 50 * 41
    assert all(np.allclose(g, w, rtol=1e-3, atol=1e-3) for g, w in zip(few, want, strict=True))


def test_lm_edges(edges, empty):
    fitted = maxent_lm.fit(edges.select("doc_id", "text"))
    rows = maxent_lm.score(edges.select("doc_id", "text"), *fitted).collect()
    assert len(rows) == len(EDGES) and all(np.isfinite(r.score) and r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 6)} == {1}
    none = maxent_lm.score(edges.select("doc_id", "text"), *maxent_lm.fit(empty.select("doc_id", "text"))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) and abs(r.base_score) < 1e-6 for r in none)
    assert maxent_lm.score(empty.select("doc_id", "text"), *fitted).count() == 0


def test_lm_scores_other_tables(spark, sf, docs):
    """A table without the training rows scores by their counts."""
    train = docs.where("doc_id % 2 = 0").select("doc_id", "text")
    counts = Counter(w for t in texts_of(train).values() for w in maxent_lm.tokens(t))
    n, v = sum(counts.values()), len(counts)
    other = docs.where("doc_id % 2 = 1").select("doc_id", "text")
    text = texts_of(other)
    for r in maxent_lm.score(other, *maxent_lm.fit(train)).collect():
        own = maxent_lm.tokens(text[r.doc_id])
        assert (r.n_known, r.train_tokens) == (sum(counts[w] > 0 for w in own), n) and np.isfinite(r.score)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))


def test_lm_gains_alike_however_rows_are_dealt(spark, docs):
    train, held = (docs.where(F.pmod("doc_id", F.lit(5)) == 1 if h else F.pmod("doc_id", F.lit(5)) != 1).select("doc_id", "text") for h in (False, True))
    gains = []
    for n in (1, 8, 64):
        fitted = maxent_lm.fit(train.repartition(n))
        r = maxent_lm.score(held, *fitted).agg(F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).first()
        gains.append(r[0])
    assert min(gains) > 0.02 and max(gains) - min(gains) < 0.001


def test_lm_learns_tokens_outside_the_head(spark):
    """Pairs of words, all of them rarer than the tokens that fill the head, are predicted from their context."""
    rng = random.Random(9)
    common = [f"f{i}" for i in range(maxent_lm.HEAD * maxent_lm.SLOTS + 100)]
    pairs = [(f"a{i}", f"b{i}") for i in range(300)]
    texts = [" ".join(w for _ in range(20) for w in (*rng.choice(pairs), *rng.sample(common, 25))) for _ in range(1500)]
    model, rare = maxent_lm.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    exact = Counter(w for t in texts for w in maxent_lm.tokens(t))
    assert all(model.counts[i] == exact[w] for w, i in model.index.items()) and set(model.index) == set(exact) and rare.count() == 0
    assert sum(model.index[w.encode()] >= model.own for p in pairs for w in p) > 500
    asked = [(i, f"{pairs[i][0]} {pairs[i][1]}") for i in range(300)] + [(300 + i, f"{pairs[i][0]} {pairs[(i + 1) % 300][1]}") for i in range(300)]
    rows = maxent_lm.score(spark.createDataFrame([(i, t) for i, t in asked], "doc_id long, text string"), model, rare).collect()
    score = {r.doc_id: r.score for r in rows}
    assert np.mean([score[i] - score[300 + i] for i in range(300)]) > 0.2


# ---- 9


def test_quality(spark, edges, empty):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(40)) if i % 4 else " ".join([word()] * 20 + [word().upper() + "!!"] * 20)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(None, 1), (5, None), (999, 1)], "doc_id long, quality int")
    model = quality.fit(frame, labels, max_rows=200)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.predict(frame, model).collect()}
    assert sum(got[i][1] == int(i % 4 != 0) for i in range(300, 400)) >= 97
    assert all((s >= 0.5) == bool(p) and 0 <= s <= 1 for s, p in got.values())
    mixed = quality.predict(edges, model).collect()
    assert len(mixed) == len(EDGES) and len({r.score for r in mixed if r.doc_id in (1, 2)}) == 1
    assert {r.score for r in quality.predict(edges, quality.fit(empty, labels), keep=["doc_id"]).collect()} == {0.5}
    assert quality.predict(empty, model).count() == 0
    # Batches score a text as it scores alone.
    texts = [t for _, t in rows[:20]] + [None, "", LONG]
    assert quality.score_texts(model, texts) == pytest.approx([quality.score_texts(model, [t])[0] for t in texts], abs=1e-6)


def brute_quality_features(text: str, bits: int) -> Counter:
    """Buckets of a text, one character and one word after the other."""
    wrap, found = (1 << 64) - 1, Counter()
    bucket = lambda v: int(C.mix64(np.array([v & wrap], np.uint64))[0]) >> (64 - bits)
    whole = text + " "
    for n in quality.ORDERS:
        for i in range(len(whole) - n + 1):
            h = 0
            for c in whole[i : i + n]:
                h = h * 0x100000001B3 + ord(c) + 1
            found[bucket(h + (n << 40))] += 1
    before, kind = None, lambda c: 4 if ord(c) > 127 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    for run in re.findall(r"[^\t-\r ]+", text):
        for word in (run[a : a + quality.WORD_CHARS] for a in range(0, len(run), quality.WORD_CHARS)):
            again, before = int(word == before), word
            found[bucket(sum((ord(c) + 7) * pow(0x5851F42D4C957F2D, k, 1 << 64) for k, c in enumerate(word)))] += 1
            found[bucket(again + (1 << 50))] += 1
            found[bucket((again << 12) + min(len(word) - 1, 31) * 64 + kind(word[0]) * 8 + kind(word[-1]) + (2 << 50))] += 1
    return found


@pytest.mark.parametrize("size", [1, 3000, 500_000])
def test_quality_features_in_pieces(monkeypatch, size):
    """Whatever the pieces, the features are those of the whole text, in characters."""
    monkeypatch.setattr(C, "BLOCK_CHARS", size)
    texts = ["a", "ab", " ", "one one  two", "Ωδή \U0001f600 naïve NAÏVE 42!", "x" * 5000 + " yy yy\n" + "z" * 1024 + " end", "\t\t" + "same " * 900, "é" * 2047 + " " + "é" * 2049]
    for text in texts:
        at, share = quality.sparse(text, 14)
        want = brute_quality_features(text, 14)
        assert dict(zip(at.tolist(), share.tolist(), strict=True)) == pytest.approx({k: v / want.total() for k, v in want.items()}, rel=1e-5)
    model = quality.QualityModel(np.random.default_rng(3).normal(size=1 << 14).astype(np.float32), 0.1, 0.0)
    for got, text in zip(quality.score_texts(model, [*texts, None, ""]), texts, strict=False):
        want = brute_quality_features(text, 14)
        z = sum(n * float(model.weight[b]) for b, n in want.items()) / want.total() + 0.1 if want else 0.0
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_quality_of_one_hot_id(spark):
    """A labelled id on many rows is sampled by its texts, and its equal rows count once."""
    frame = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "if(id % 6 = 0, 'same text', repeat(concat('w', id, ' '), 20)) AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "int(id % 2) AS quality")
    model = quality.fit(frame, labels, max_chars=20_000)
    assert np.isfinite(model.weight).all() and len({r.score for r in quality.predict(frame.where("text = 'same text'"), model).collect()}) == 1


def test_quality_query(spark, sf, docs):
    """Scores are those of the fitted model by the plain definition of its features; held-out labels are told apart."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs.where(C.fold(F.col("doc_id"), 3) != 1), labels.where(C.fold(F.col("doc_id"), 3) != 1))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op9_quality(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == int(got[i].score >= 0.5)
        if len(text or "") < 400:
            want = brute_quality_features(text or "", 16)
            z = sum(n * float(model.weight[b]) for b, n in want.items()) / want.total() + model.bias if want else model.empty
            assert got[i].score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)
    told = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out and r.quality is not None]
    good, bad = [s for s, q in told if q], [s for s, q in told if not q]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.8


def test_quality_keeps_the_shares_of_labels(spark):
    """A balanced sample of unbalanced labels scores empty texts by the true share."""
    frame = spark.createDataFrame([(i, f"text {i % 7} of {i % 11}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(2000)], "doc_id long, quality int")
    for most in (4000, 200):
        model = quality.fit(frame, labels, max_rows=most)
        assert quality.score_texts(model, [None])[0] == pytest.approx(0.9, abs=0.03)


# ---- 10

BODY = "<article><h1>Title &amp; more</h1><p>First <b>bold</b>\n  text.<br>Second&nbsp;line.</p><p>Third <a href=x>link</a>.</p><ul><li>one<li>two</ul>"
NOISE = "<nav><ul><li><a href=/>Menu</a></li></ul></nav><div class='ad banner'>Buy</div><header>Site</header><aside>Side</aside><script>var t='</p>';</script><style>p{}</style><form>Name<input></form>"


def test_extraction(spark):
    pages = [
        (1, "http://h.org/1", f"<html><head><title>T</title></head><body>{NOISE}{BODY}<div id=comments><p>Reply</p></div></article><footer>&copy; h</footer></body></html>"),
        (2, "http://h.org/2", None), (3, None, ""), (4, "::bad[", "plain text"), (5, "http://h.org/5", f"<body>{NOISE}<article><p>Cut off te<foo"), (5, "http://h.org/5", f"<body>{NOISE}<article><p>Cut off te<foo"),
        (6, "http://x.org", "<p>" + LONG),
    ]
    frame = spark.createDataFrame(pages, "page_id int, url string, html string").withColumn("text", F.lit("clash"))
    for most in (200_000, 0):  # places sent to executors, and joined
        html_extract.SENT_PLACES, held = most, html_extract.SENT_PLACES
        rows = html_extract.extract(frame).collect()
        html_extract.SENT_PLACES = held
        got = {r.page_id: r.text for r in rows}
        assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
        assert got == {1: "Title & more First bold text. Second line. Third link. one two", 2: "", 3: "", 4: "plain text", 5: "Cut off te", 6: LONG}
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_style_tree_drops_templates(spark):
    """Without any self-description, what recurs on a host goes and what varies stays."""
    page = lambda i: f"<body><div class=top><p>Welcome to our site, the home of news</p></div><div class=story><p>Story {i} tells of thing {i * 7} alone</p></div></body>"
    rows = [(i, "http://h.org", page(i)) for i in range(40)] + [(99, "http://other.org", page(99))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} tells of thing {i * 7} alone" for i in range(40))
    assert got[99].startswith("Welcome") and "Story 99" in got[99]  # one page tells nothing about its site


def test_copies_of_a_page_are_no_template(spark):
    copies = [(i, "http://c.org", "<body><p>The same text on every copy</p></body>") for i in range(3)] + [(i, None, "<p>No address</p>") for i in (10, 11)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(copies, "page_id int, url string, html string")).collect()}
    assert got == {0: "The same text on every copy", 1: "The same text on every copy", 2: "The same text on every copy", 10: "No address", 11: "No address"}


def test_article_stays_and_marked_blocks_go(spark):
    """Whatever their length and however much they vary or recur: headings of all articles stay; comments, sidebars, adverts and what stands beside an article go."""
    own = lambda i, n=50: " ".join(f"word{i * 50 + j}" for j in range(n))
    body = lambda i: f"<article class=has-sidebar><header class=article-header><h1>Title {i}</h1></header><h2>Introduction</h2><p>{own(i)}</p><h2>Summary</h2><p>{own(i + 50, 45)}</p><p>Read our terms</p><div class='ad box'>{own(i + 70)}</div></article>"
    beside = lambda i: f"<div class=comments><p>{own(i + 100)}</p></div><div class=sidebar><p>{own(i + 200)}</p></div><div class=ad>{own(i + 300, 45)}</div><div id=x><p>{own(i + 400)}</p></div>"
    rows = [(i, "http://a.org", f"<body><nav><a href=/{i}>Link {i}</a></nav>{body(i)}{beside(i)}</body>") for i in range(8)]
    rows += [(100 + i, "http://b.org", f"<body><div class='content no-sidebar'><article><h1 class=page-header>T{i}</h1><p>Short {i}</p></article></div><footer>Foot {i}</footer></body>") for i in range(20)]
    rows += [(200 + i, "http://c.org", f"<body><div class='content no-sidebar'><p>{own(i)}</p></div><div class=sidebar>{own(i + 100)}</div></body>") for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert all(got[i] == f"Title {i} Introduction {own(i)} Summary {own(i + 50, 45)} Read our terms" for i in range(8))
    assert all(got[100 + i] == f"T{i} Short {i}" for i in range(20))
    assert all(got[200 + i] == own(i) for i in range(8))


def test_recurring_text_goes_from_places_of_its_own_kind(spark):
    """Without marks, a text that recurs goes from among paragraphs that vary, sent and joined alike."""
    page = lambda i: f"<body><div><p>Please accept our terms of use</p><p>Story {i} tells of {i * 7}</p><p>More of story {i}</p><p>All rights are reserved</p></div></body>"
    frame = spark.createDataFrame([(i, "http://h.org", page(i)) for i in range(30)], "page_id int, url string, html string")
    for most in (200_000, 0):
        html_extract.SENT_PLACES, held = most, html_extract.SENT_PLACES
        got = {r.page_id: r.text for r in html_extract.extract(frame).collect()}
        html_extract.SENT_PLACES = held
        assert got == {i: f"Story {i} tells of {i * 7} More of story {i}" for i in range(30)}


def test_tree_alone_on_pages_without_marks(spark, sf):
    """With names of elements and classes taken away, the tree finds the article by what recurs: words against those of the marked pages."""
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    site = [r for r in rows if r.html]
    names = r"(</?)(?:article|nav|footer|header|aside|main|form|section)\b"
    bare = [(r.page_id, f"http://h{k % 5}.org", re.sub(names, r"\1div", re.sub(r' (?:class|id|role)="[^"]*"', "", r.html))) for k, r in enumerate(site)]
    marked = [(r.page_id, f"http://h{k % 5}.org", r.html) for k, r in enumerate(site)]
    texts = [{r.page_id: Counter(r.text.split()) for r in html_extract.extract(spark.createDataFrame(x, "page_id long, url string, html string")).collect()} for x in (bare, marked)]
    both = sum((texts[0][k] & texts[1][k]).total() for k in texts[1])
    precision, recall = both / sum(c.total() for c in texts[0].values()), both / sum(c.total() for c in texts[1].values())
    print(f"precision {precision:.4f} recall {recall:.4f}")
    assert precision >= 0.94 and recall >= 0.97


def brute_importance(pages):
    """content and presentation of each node of one site, by counting over distinct pages."""
    seen = {}
    for h in pages:
        blocks, looks = html_extract.parse(h)
        seen.setdefault(tuple(blocks), (blocks, looks))
    texts, forms = defaultdict(set), defaultdict(list)
    for k, (blocks, looks) in enumerate(seen.values()):
        for leaf, branch, _, text, _ in blocks:
            texts[leaf].add((k, text))
            texts[branch].add((k, text))
        for node, look in looks:
            forms[node].append(look)
    out = {}
    for node, own in texts.items():
        m = len({k for k, _ in own})
        shares = [sum(1 for _, t in own if t == x) for x in {t for _, t in own}]
        content = 1.0 if m <= 1 else 1 - min(1.0, np.mean(np.log(shares)) / np.log(m))
        n = len(forms[node])
        counts = np.array(list(Counter(forms[node]).values()) or [1])
        entropy = float(-(counts / counts.sum() * np.log(counts / counts.sum())).sum())
        out[node] = (m, content, 0.0 if not n else 1.0 if n == 1 else min(1.0, entropy / np.log(n)))
    return out


def test_style_tree_against_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    sites = defaultdict(list)
    for r in pages:
        sites[html_extract.host(r.url)].append(r.html)
    sites["own.org"] = [f"<body><div class=a><p>Same</p></div><div class={'b' if i % 2 else 'a'}><p>Text {i % 3}</p><ul><li>x</li></ul></div></body>" for i in range(12)]
    rows = [(i, f"http://{h}/", t) for h, own in sites.items() for i, t in enumerate(own)]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string")
    tree = html_extract.style_tree(html_extract.parsed(frame, "page_id", "url", "html")).collect()
    want = {(h, node): x for h, own in sites.items() for node, x in brute_importance(own).items()}
    assert {(r.host, r.node) for r in tree} == set(want)
    for r in tree:
        m, content, presentation = want[r.host, r.node]
        assert r.pages == m and r.content == pytest.approx(content) and r.presentation == pytest.approx(presentation, abs=1e-9)


def test_deep_nesting_takes_linear_time(spark):
    import time

    n = 100_000
    pages = ["<body>" + "<span>x " * n, "<body>" + "<div>" * n + "deep" + "</div>" * n, "<b>" * n + "text" + "</i>" * n, "<ul>" + "<li>item " * n, "<p>" + "<em><p>" * n]
    for h in pages:
        began = time.time()
        html_extract.parse(h)
        assert time.time() - began < 10
    assert [b[3] for b in html_extract.parse(pages[1])[0]] == ["deep"]


def test_extraction_query(spark, sf):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op10_html_extraction(spark, sf).collect():
        body = re.search(r"(?s)<article>(.*?)(</article>|<footer>|$)", pages[r.page_id])[1]
        body = re.sub(r"<[^>]*$", "", body)
        assert r.text == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]+>", " ", body))).split())


# ---- all queries


def test_spread_of_numbers(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), "id")
    got = C.gapless(rows, ["g"], ["id"], "n", 16, F.xxhash64("id"))
    assert got.groupBy("g").agg(F.count_distinct("n").alias("c"), F.min("n").alias("a"), F.max("n").alias("b"), F.count(F.lit(1)).alias("k")).where("c <> k or a <> 0 or b <> k - 1").count() == 0

"""Spelling variants, packing by cutting and importance resampling: edge cases and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import common as C
from corpusloom.llm import concatenation, packing, queries, resampling, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} filler" for i in range(30_000))
EDGES = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "the cat sat on the mat", "en", "a", 22), (3, "the cat sat on the mat", "en", "a", 22), (4, LONG, "en", None, len(LONG)),
    (5, "der hund und die katze", "de", "b", 22), (6, "  \n\t ", None, "b", 5), (7, "12345 !!! ...", None, None, 13), (8, "ñandú Ünïcödé 𝔘𝔫𝔦 日本語", None, "c", 20), (None, "no id here", None, None, 10), (None, "no id here", None, None, 10),
]
#: names that operators give their own columns
CLASH = ["word", "n", "form", "near", "route", "part", "at", "row", "ids", "global", "start", "score", "weight", "rank", "bucket", "range", "place"]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# ---- 11


def brute_words(rows, drop=None, length=6, least=5):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop and h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= length and n >= least}


def brute_variants(words, ratio=5):
    """Every string one edit away, looked up."""
    letters = {c for w in words for c in w}
    out = {}
    for w, n in words.items():
        near = {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for c in (*letters, "") if i + k <= len(w)} & words.keys() - {w}
        form = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = [form if form and words[form] >= ratio * n else None, n, len(near)]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.append(root)
    return {w: (form, root, n, near, words.get(form)) for w, (form, n, near, root) in out.items()}


def as_dict(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_spelling_query(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_variants(brute_words(rows, 199))
    assert as_dict(queries.op11_spelling(spark, sf)) == want and any(v[0] for v in want.values())


@pytest.mark.parametrize("block", [20_000, 7])
def test_spelling_of_dense_words(spark, block):
    """Few letters and repeated ones give many near words, runs and hot halves; small blocks meet in pairs."""
    rng = random.Random(5)
    some = {"".join(rng.choices("aabà", k=rng.randint(6, 9))) for _ in range(1500)} | {"a" * n for n in range(6, 14)} | {"ab" * n for n in range(3, 7)} | {"aaa" * 400 + c for c in ("", "b", "ba")}
    words = {w: int(5 * 1.9 ** rng.randint(0, 40)) for w in some}
    frame = spark.createDataFrame([*words.items()], "word string, n long")
    pairs = spelling.near_pairs(frame, block).collect()
    seen = Counter((p.word, p.near) for p in pairs)
    assert max(seen.values()) == 1 and all(p.n == words[p.word] and p.near_n == words[p.near] for p in pairs)
    found = spelling.with_roots(spelling.forms(frame, spelling.near_pairs(frame, block)))
    want = brute_variants(words)
    assert as_dict(found) == want
    assert sum(v[3] for v in want.values()) > 1000 and any(v[1] != v[0] for v in want.values() if v[0])


def test_spelling_ties_and_chains(spark):
    words = {"spelling": 1000, "speling": 100, "spelin": 10, "abcdefg": 50, "abcdefh": 50, "abcdefi": 10, "lonely": 7}
    frame = spark.createDataFrame([*words.items()], "word string, n long")
    got = as_dict(spelling.with_roots(spelling.forms(frame, spelling.near_pairs(frame))))
    assert got["spelin"][:2] == ("speling", "spelling") and got["abcdefi"][0] == "abcdefg" and got["abcdefg"][0] is None and got["lonely"] == (None, "lonely", 7, 0, None)


def test_spelling_edges(edges, empty):
    assert spelling.variants(empty).count() == 0
    got = as_dict(spelling.variants(edges, least_count=1, drop_one_in=3))
    assert got == brute_variants(brute_words([r[:2] for r in EDGES], 3, least=1))
    with pytest.raises(ValueError):
        spelling.variants(edges, least_length=5)


def test_spelling_counts_however_rows_are_dealt(docs, monkeypatch):
    want = {(r.word, r.n) for r in spelling.word_counts(docs).collect()}
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    assert {(r.word, r.n) for r in spelling.word_counts(docs.repartition(7)).collect()} == want


# ---- 12


def check_pieces(got, rows, capacity):
    """Round trip: pieces put together are the documents' ids; windows are gapless, full, or a power of two."""
    exact = Tokenizer.from_file(packing.default_tokenizer())
    wanted = Counter()
    for key, text in rows:
        wanted[key, np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()] += 1
    windows = defaultdict(list)
    for r in got:
        assert 0 < r.length <= capacity
        windows[r.sequence_id].append((r.offset, r.length))
    filled = []
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        filled.append(at)
    assert sum(filled) == sum(len(x) // 4 * n for (_, x), n in wanted.items())
    assert all(n == capacity or n & (n - 1) == 0 for n in filled) and max(Counter(n for n in filled if n < capacity).values(), default=1) == 1
    left = defaultdict(Counter)
    for r in got:
        left[r.doc_id][r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    by_key = defaultdict(list)
    for (key, ids), n in wanted.items():
        by_key[key].append((ids, n))
    for key, texts in by_key.items():
        if len(texts) == 1 and texts[0][1] == 1:
            ids, at = texts[0][0], 0
            for start, length, crc, tokens in sorted(left[key]):
                assert (start, tokens, crc) == (at, len(ids) // 4, zlib.crc32(ids[4 * at : 4 * (at + length)]))
                at += length
            assert at == len(ids) // 4


@pytest.mark.parametrize("capacity", [1024, 64, 1])
def test_cut_edges(edges, empty, capacity):
    rows = C.materialize(concatenation.tokenized(edges.repartition(3)), "t")
    check_pieces(concatenation.pieces(rows, capacity).collect(), [r[:2] for r in EDGES], capacity)
    none = C.materialize(concatenation.tokenized(empty), "t")
    assert concatenation.pieces(none, capacity).count() == concatenation.sequences(none, capacity).count() == 0


def test_cut_query(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check_pieces(queries.op12_packing(spark, sf).collect(), rows, 1024)


def test_windows_hold_what_pieces_say(spark, docs):
    """Boundary records of many small partitions and batches come together in order."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = C.materialize(concatenation.tokenized(docs.repartition(9)), "t")
        pieces = defaultdict(list)
        for r in concatenation.pieces(rows, 100).collect():
            pieces[r.sequence_id].append(r)
        got = concatenation.sequences(rows, 100).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(pieces)
    for w in got:
        own, at = sorted(pieces[w.sequence_id], key=lambda r: r.offset), 0
        assert [(r.doc_id, r.length) for r in own] == [*zip(w.doc_ids, w.lengths, strict=True)]
        for r in own:
            assert zlib.crc32(np.array(w.ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(w.ids)


def test_cut_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([1, 2, 8, 100])
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 12))]
        total = sum(sizes)
        ends, at = concatenation.tail_ends(total, capacity), 0
        window = []
        for k in range(total // capacity):
            window += [(k, o) for o in range(capacity)]
        for bit in reversed(range(20)):
            if total % capacity >> bit & 1:
                k = window[-1][0] + 1 if window else 0
                window += [(k, o) for o in range(1 << bit)]
        for n in sizes:
            first, own, offset = concatenation.cut(at, n, capacity, ends)
            bounds = [*first.tolist(), at + n]
            assert [(w, o + i) for w, o, a, b in zip(own.tolist(), offset.tolist(), bounds, bounds[1:], strict=False) for i in range(b - a)] == window[at : at + n]
            at += n


def test_starts(spark, monkeypatch):
    monkeypatch.setattr(C, "FAN", 3)
    totals = {k: (k * 7919) % 11 for k in range(0, 40, 2)}
    got = {r.part: r.start for r in C.starts(spark.createDataFrame([*totals.items()], "part long, n long"), "part", "n", "start").collect()}
    assert got == {k: sum(n for j, n in totals.items() if j < k) for k in totals}


# ---- 13

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text, n):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute_draw(rows, items, n=1, buckets=10_000, share=(10, 100), least=20):
    s, t = Counter(), Counter()
    of = lambda text: [zlib.crc32(f.encode()) % buckets for f in brute_features(text, n)[1]]
    for _, text in rows:
        s.update(of(text))
    for text in items:
        t.update(of(text))
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for key, text in rows:
        own = of(text)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), brute_features(text, n)[0] >= least])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = Counter((*r[:4], k + 1) for k, r in enumerate(drawn[: len(drawn) * share[0] // share[1]]))
    chosen = Counter(k[:4] for k in ranks.elements())
    return ranks + Counter((*k, None) for k in (Counter(tuple(r[:4]) for r in out) - chosen).elements())


def as_counts(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect())


@pytest.mark.parametrize(("n", "least", "share"), [(1, 20, (10, 100)), (1, 1, (50, 100)), (3, 2, (100, 100))])
def test_resampling_edges(spark, edges, empty, n, least, share):
    items = ["the cat and the mat", None, "", "ñandú 日本語"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = as_counts(resampling.resample(edges, target, share, n=n, buckets=997, least_words=least))
    assert got == brute_draw([r[:2] for r in EDGES], items, n, 997, share, least)
    assert resampling.resample(empty, target).count() == 0
    assert as_counts(resampling.resample(edges, target.limit(0), share, n=n, least_words=least)) == brute_draw([r[:2] for r in EDGES], [], n, 10_000, share, least)


def test_resampling_query(spark, sf, docs):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert as_counts(queries.op13_resampling(spark, sf)) == brute_draw([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], items)


def test_crc_algebra():
    rng = random.Random(7)
    strings = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 5, 33, 1000]))) for _ in range(200)]
    first, second = np.array([zlib.crc32(x) for x in strings], np.uint32), np.array([zlib.crc32(x) for x in strings[::-1]], np.uint32)
    got = resampling.combined(first, second, np.array([len(x) for x in strings[::-1]], np.int64))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(strings, strings[::-1], strict=True)]


@pytest.mark.parametrize("n", [1, 2, 4])
def test_features_of_slices(n, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 10)
    monkeypatch.setattr(resampling, "KNOWN_WORDS", 5)
    hasher = resampling.Hasher(n)
    for text in ("", "one", "a b c", "Ünïcödé and ASCII-words; 12 of them, or more than that " * 5, "x" * 50 + " y " * 9, "  ..  "):
        slices = [*hasher.features(text.encode())]
        words, wanted = brute_features(text, n)
        assert sum(w for _, w in slices) == words and Counter(c for f, _ in slices for c in f.tolist()) == Counter(zlib.crc32(f.encode()) for f in wanted)


def test_ranks_of_ties(spark, monkeypatch):
    """One score and one id hold most rows; ranks are gapless all the same and smaller ids come first."""
    rows = [(7, 30, 30, 5, 5, k % 4, k // 4) for k in range(200)] + [(k, 30, 30, 5, 5, 9, k) for k in range(100)] + [(900 + k, 30, 3, 5, 99, 8, k) for k in range(5)]
    frame = C.materialize(spark.createDataFrame(rows, "doc_id long, n_features long, n_words long, weight long, score long, part long, row long").repartition(6), "r")
    got = resampling.ranked(frame, 150, F.col("n_words") >= 20).collect()
    drawn = sorted((r.rank, r.doc_id) for r in got if r["rank"])
    assert len(got) == len(rows) and drawn == [*zip(range(1, 151), [*range(7), *[7] * 143], strict=True)]

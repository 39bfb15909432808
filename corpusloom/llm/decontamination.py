"""Benchmark decontamination by a distributed positional inverted index.

`build_index` stores the index once as a table: a row is a segment of whole documents with the
sorted 64-bit hashes of their distinct words and each word's places. `search` looks up the
windows of benchmark items in it: offset-adjusted lists are intersected from a window's rarest
word in the segment on, so every exact phrase occurrence is found; with `proximity` it finds the
places where all words of an item stand close together, again from the rarest one on.
Benchmark items go out in blocks of at most about `block_words` words, one block after the other,
each in a pass over the stored index that ends before the next one is sent.

Defined results: null and wordless texts have no words and are never contaminated; an item
of fewer words than the window is one window; items without words or without id are left
out; items that share an id count once; an empty benchmark hits nothing. Rows with equal
doc_ids are judged one by one.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common as C

#: A-Z to lower case, other ASCII that is no digit or letter to a space; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Characters of a segment's documents at most; a longer document is a segment of its own.
SEGMENT_CHARS = 1 << 20
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


@dataclass
class Items:
    """A block of benchmark items: each row of `terms` is a distinct window (padded by -1), `owners` has the items that hold it."""

    ids: list[str]
    #: of each term
    hashes: np.ndarray
    terms: np.ndarray
    lengths: np.ndarray
    owners: list[list[int]]
    #: distinct terms of each item
    sets: list[np.ndarray]


def build_items(rows: list[tuple[str, str]], window: int) -> Items:
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    owners: dict[tuple[int, ...], set[int]] = {}
    sets: dict[int, set[int]] = {}
    for name, text in rows:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
        if not ids:
            continue
        item = names.setdefault(name, len(names))
        sets.setdefault(item, set()).update(ids)
        for k in range(max(1, len(ids) - window + 1)):
            owners.setdefault(tuple(ids[k : k + window]), set()).add(item)
    terms = np.full((len(owners), window), -1, np.int64)
    for row, w in zip(terms, owners, strict=True):
        row[: len(w)] = w
    return Items(list(names), word_hashes(list(vocabulary)), terms, np.array([len(w) for w in owners], np.int64), [sorted(x) for x in owners.values()], [np.array(sorted(sets[i])) for i in range(len(names))])


@dataclass
class Segment:
    """The positional inverted index of some documents. Places count words over all of them, with one place between documents."""

    n_words: np.ndarray
    #: hashes of distinct words, sorted; the places of the k-th are places[starts[k] : starts[k + 1]], rising
    terms: np.ndarray
    starts: np.ndarray
    places: np.ndarray

    @classmethod
    def of_texts(cls, texts: list[str | None]) -> Segment:
        split = [words(t) for t in texts]
        n_words = np.array([len(t) for t in split], np.int64)
        local: dict[bytes, int] = {}
        ids = np.fromiter((local.setdefault(w, len(local)) for t in split for w in t), np.int64, int(n_words.sum()))
        hashes = word_hashes(list(local))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = rank[ids]
        at = np.arange(len(ids)) + np.repeat(np.arange(len(split)), n_words)
        counts = np.bincount(key, minlength=len(order))
        return cls(n_words, hashes[order], np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), at[np.argsort(key, kind="stable")].astype(np.int32))

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each of these words here (-1: none), and how often it stands."""
        if not len(self.terms):
            return np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = self.terms[at] == hashes
        return np.where(known, at, -1), np.where(known, np.diff(self.starts)[at], 0)

    def of(self, term: int) -> np.ndarray:
        return self.places[self.starts[term] : self.starts[term + 1]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Places at which these words (numbers in this segment) stand one after the other."""
        order = np.argsort(self.starts[terms + 1] - self.starts[terms], kind="stable")
        at = self.of(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(at):
                break
            own = self.of(terms[k])
            found = np.minimum(np.searchsorted(own, at + k), len(own) - 1)
            at = at[own[found] == at + k]
        return at

    def near(self, terms: np.ndarray, span: int) -> list[tuple[int, int]]:
        """Smallest stretches [a, b) of at most `span` places in one document that hold all these words."""
        lists = sorted((self.of(t) for t in terms), key=len)
        rare = lists[0]
        for own in lists[1:]:  # those places of the rarest word that have each other word about
            found = np.searchsorted(own, rare - span)
            rare = rare[(found < len(own)) & (own[np.minimum(found, len(own) - 1)] < rare + span)]
        if not len(rare):
            return []
        close = []
        for own in lists:
            found = np.searchsorted(rare, own - span, "right")
            close.append(own[(found < len(rare)) & (rare[np.minimum(found, len(rare) - 1)] < own + span)])
        places = np.concatenate(close)
        which = np.repeat(np.arange(len(close)), [len(x) for x in close])
        order = np.argsort(places, kind="stable")
        first, last, out = self.first(), np.full(len(close), -1, np.int64), []
        for p, t in zip(places[order].tolist(), which[order].tolist(), strict=True):
            last[t] = p
            a = int(last.min())
            if a >= 0 and p - a < span and np.searchsorted(first, a, "right") == np.searchsorted(first, p, "right") and (not out or out[-1][0] != a):
                out.append((a, p + 1))
        return out

    def first(self) -> np.ndarray:
        """The first place of each document, and the one behind the last."""
        return np.concatenate([[0], np.cumsum(self.n_words + 1)])

    def hits(self, items: Items, proximity: int | None) -> dict[int, tuple[set[str], list[tuple[int, int]]]]:
        """By document: ids of items that occur, and the stretches [start, end) of its words in which they do."""
        terms, counts = self.lookup(items.hashes)
        found: list[tuple[int, int, list[int]]] = []
        if proximity is None:
            least = np.append(counts, np.iinfo(np.int64).max)[items.terms]
            for w in np.flatnonzero(least.min(1) > 0) if len(least) else ():
                n = int(items.lengths[w])
                found += [(a, a + n, items.owners[w]) for a in self.phrase(terms[items.terms[w, :n]]).tolist()]
        else:
            for i, own in enumerate(items.sets):
                if counts[own].all():
                    found += [(a, b, [i]) for a, b in self.near(terms[own], proximity)]
        first, out = self.first(), {}
        for (a, b, owners), d in zip(found, (np.searchsorted(first, [f[0] for f in found], "right") - 1).tolist() if found else (), strict=True):
            names, spans = out.setdefault(d, (set(), []))
            names.update(items.ids[i] for i in owners)
            spans.append((a - int(first[d]), b - int(first[d])))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def one_row(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def build_index(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The stored index: segment, docs (structs of the columns of `keep`, in order), n_words, terms, starts, places."""
    inner = df.select(*keep, F.col(text).alias("_text"))
    doc = inner.drop("_text").schema
    schema = T.StructType([T.StructField("segment", T.StringType()), T.StructField("docs", T.ArrayType(doc)), *T.StructType.fromDDL("n_words array<long>, terms array<long>, starts array<int>, places array<int>")])

    def run(batch):
        texts = batch.column(len(keep)).to_pylist()
        for a, b in C.blocks(texts, SEGMENT_CHARS):
            s = Segment.of_texts(texts[a:b])
            docs = pa.StructArray.from_arrays([c.slice(a, b - a) for c in batch.columns[: len(keep)]], keep) if keep else pa.array([{}] * (b - a), pa.struct([]))
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), one_row(docs), one_row(pa.array(s.n_words)), one_row(pa.array(s.terms.view(np.int64))), one_row(pa.array(s.starts)), one_row(pa.array(s.places))], schema.names)

    return C.materialize(C.map_arrow(inner, run, schema), "postings")


def hits_of(index: DataFrame, items: Items, proximity: int | None) -> DataFrame:
    """segment, at (the document's number in it), items, spans of documents in which items of this block occur."""
    sent = index.sparkSession.sparkContext.broadcast(items)

    def run(batch):
        names, columns = batch.column(0), [batch.column(i) for i in range(1, 5)]
        rows, at, ids, spans = [], [], [], []
        for r in range(len(names)):
            n_words, terms, starts, places = (c[r].values.to_numpy() for c in columns)
            for d, (found, where) in sorted(Segment(n_words, terms.view(np.uint64), starts, places).hits(sent.value, proximity).items()):
                rows.append(r)
                at.append(d)
                ids.append(sorted(found))
                spans.append([{"start": a, "end": b} for a, b in merged(where)])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, SPANS)], ["segment", "at", "items", "spans"])

    segments = index.select("segment", "n_words", "terms", "starts", "places")
    out = C.materialize(C.map_arrow(segments, run, "segment string, at int, items array<string>, spans array<struct<start:long,end:long>>"), "hits")
    sent.destroy()
    return out


def item_blocks(benchmark: DataFrame, window: int, key: str, text: str, block_words: int):
    """Blocks of items, dealt by a hash of the id so that a block has about `block_words` words, one at a time."""
    rows = benchmark.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    chars = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-chars // (block_words * 2)))
    for p in range(parts):
        got = rows.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == p).collect()
        items = build_items(sorted((r["k"], r["t"]) for r in got), window)
        if items.ids:
            yield items


def search(index: DataFrame, benchmark: DataFrame, window: int = 13, proximity: int | None = None, item_key: str = "item_id", item_text: str = "text", block_words: int = 1_000_000) -> DataFrame:
    """The kept columns of each indexed document, then n_words, n_hit, items and spans (word places [start, end)).

    Exact phrases of `window` words, or with `proximity` all words of an item within so many places.
    """
    found = [hits_of(index, items, proximity) for items in item_blocks(benchmark, window, item_key, item_text, block_words)]
    places = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("docs") - 1).alias("at"), F.col("docs"), F.col("n_words")))
    docs = index.where(F.size("docs") > 0).select("segment", places.alias("_d")).select("segment", F.col("_d.at").alias("_at"), F.col("_d.docs").alias("_doc"), F.col("_d.n_words").alias("n_words"))
    keep = index.schema["docs"].dataType.elementType.names
    kept = [F.col("_doc")[c].alias(c) for c in keep]
    if not found:
        return docs.select(*kept, "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    # A document's hits of several blocks.
    grouped = every.groupBy("segment", "at").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def run(batch):
        spans = [merged([(s["start"], s["end"]) for s in row]) for row in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array([sorted(set(x)) for x in batch.column(2).to_pylist()], pa.list_(pa.string())), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], SPANS)], ["_segment", "_at2", "n_hit", "items", "spans"])

    told = C.map_arrow(grouped, run, "_segment string, _at2 int, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")
    out = docs.join(told, (F.col("segment") == F.col("_segment")) & (F.col("_at") == F.col("_at2")), "left")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select(*kept, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", empty).alias("spans"))


def match(df: DataFrame, benchmark: DataFrame, window: int = 13, proximity: int | None = None, text: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """Builds the index of df, with the columns of `keep` (all by default), and searches it."""
    new = ["n_words", "n_hit", "items", "spans"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    return search(build_index(df, text, keep), benchmark, window, proximity, **options)


def contaminated(share: int = 20):
    """A document counts as contaminated if a word is hit and at least one in `share` of its words is."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def items_digest():
    return F.sha2(F.array_join(F.array_sort("items"), ","), 256)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

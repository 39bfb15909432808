"""Substring deduplication by content-defined chunking.

A gear rolling hash over the bytes cuts texts where it is smaller than all its neighbours
within RADIUS places, so a cut depends on some 60 bytes around it, text inserted before a
passage doesn't shift the chunks in it, and chunks are longer than RADIUS bytes. Chunks are
grouped by digest; a chunk that an earlier document (by id) has points to the first document
with it, to the one just before in a bounded run of its holders, and to the first ones that have
it with the next one to five chunks. A passage's inner
chunks are all such chunks, one beside the other; runs of them that are too short, with what
stands around them, are no passages. The chunks of a run that point to one document at the same
distance form a candidate, which is compared byte by byte with that document's text, extended
on both sides, trimmed to whole words and removed if it has `min_words` words or more. The
earlier document's text is its text before any removal, so every passage stays once.

Defined results: null texts stay null; passages that repeat only within a document (or
among rows that share an id) stay; rows without id stay as they are and are no earlier documents;
whole copies of an earlier document end up empty. Among documents with a passage in common
the smallest id keeps it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common as C

#: A cut is where the hash is smallest within so many places: chunks of twice as many bytes and one on average.
RADIUS = 20
LONGEST = 256
#: Chunks beside a run that a passage may reach into: cuts near its ends depend on the text around it.
BESIDE = 3
#: Bytes by which a candidate is extended at first, and by how much more each time what it reaches isn't known to repeat.
REACH, MORE = 512, 16
#: Holders of a digest that are in one run, each pointing to the one before.
HOLDERS = 4096
#: Chunks in a row that point to the first document with all of them, so that a passage whose parts stand in other documents finds one with the whole.
WINDOW = 6
#: Rows (a key, an owner and a place) of such documents that are broadcast at most; more are shuffled.
SENT_WINDOWS = 500_000
GEAR = C.mix64(np.arange(1, 257, dtype=np.uint64)).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + GEAR[byte] over 16 bits, for all places at once."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h


def least_around(h: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest value among the `radius` places before each one, and among those behind it."""
    n, width = len(h), 1
    low = np.concatenate([h, np.full(radius, np.iinfo(h.dtype).max, h.dtype)])  # low[i]: the least of [i, i + width)
    while 2 * width <= radius:
        low[:-width] = np.minimum(low[:-width], low[width:])
        width *= 2
    low[: n + radius - (radius - width)] = np.minimum(low[: n + radius - (radius - width)], low[radius - width :]) if radius > width else low[: n + radius]
    behind = low[1 : n + 1]
    before = np.full(n, np.iinfo(h.dtype).max, h.dtype)
    before[radius:] = low[: max(0, n - radius)]
    if n:
        before[1:radius] = np.minimum.accumulate(h)[: max(0, min(n, radius) - 1)]
    return before, behind


def cuts(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk ends."""
    h = gear(data)
    before, behind = least_around(h, RADIUS)
    return np.flatnonzero((h < before) & (h <= behind)) + 1


def edges_of(data: np.ndarray) -> np.ndarray:
    """Where chunks begin and the last one ends."""
    edges = np.unique(np.concatenate([[0], cuts(data), [len(data)]]))
    wide = np.flatnonzero(np.diff(edges) > LONGEST)
    if len(wide):
        more = [np.arange(edges[i] + LONGEST, edges[i + 1], LONGEST) for i in wide]
        edges = np.unique(np.concatenate([edges, *more]))
    return edges


def chunks(text: bytes) -> list[tuple[int, int]]:
    """[start, end) of the chunks, which together are the text."""
    edges = edges_of(np.frombuffer(text, np.uint8)).tolist() if text else []
    return list(zip(edges[:-1], edges[1:], strict=True)) if edges else []


def word_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are white space, and how many words begin before each place."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = ~space
    starts[1:] &= space[:-1]
    return space, np.concatenate([[0], np.cumsum(starts)])


def occurrences(docs: DataFrame) -> DataFrame:
    """digest, doc_id, start, length, words and beside (words that begin in the BESIDE chunks on the left and on the right) of each chunk."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        texts = batch.column(1).to_pylist()
        for a, b in C.blocks(texts):
            digests, rows, cols = [], [], [[], [], [], [], []]
            for i in range(a, b):
                if not texts[i]:
                    continue
                raw = texts[i].encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, np.uint8)
                edges = edges_of(data)
                _, words = word_starts(data)
                at, n = words[edges], len(edges) - 1
                places = edges.tolist()
                digests.extend(xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(places[:-1], places[1:], strict=True))
                every = np.arange(n)
                left = at[:-1] - at[np.maximum(every - BESIDE, 0)]
                right = at[np.minimum(every + 1 + BESIDE, n)] - at[1:]
                rows.append(np.full(n, i))
                for c, x in zip(cols, (edges[:-1], np.diff(edges), np.diff(at), left, right), strict=True):
                    c.append(x)
            if rows:
                ids = batch.column(0).take(pa.array(np.concatenate(rows)))
                start, *small = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(digests, np.uint64).view(np.int64)), ids, pa.array(start.astype(np.int64)), *(pa.array(x.astype(np.int16)) for x in small)], names)

    names = ["digest", "doc_id", "start", "length", "words", "left", "right"]
    return C.map_arrow(docs.where("doc_id is not null"), run, f"digest long, doc_id {kind}, start long, length short, words short, left short, right short")


def shared_runs(found: DataFrame, min_words: int) -> DataFrame:
    """Chunks that another document has too, in runs of neighbours long enough for a passage.

    Adds run, its low and high end (beyond which nothing repeats), the first holder of the digest, the number
    of holders, and `keys`: digests of the 2 to WINDOW chunks that begin here.
    """
    holders = found.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("_first"), F.max("doc_id").alias("_top"), F.count(F.lit(1)).alias("n")).where("_first.doc_id <> _top")
    rows = found.join(holders.select(F.col("digest").alias("_digest"), "_first", "n"), F.col("digest") == F.col("_digest"))
    rows = rows.select(*found.columns, F.col("_first.doc_id").alias("owner"), F.col("_first.start").alias("there"), "n")
    ordered = Window.partitionBy("doc_id").orderBy("start")
    # Rows that share an id may have chunks at the same place.
    last = F.max(F.col("start") + F.col("length")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_gap", (last.isNull() | (F.col("start") > last)).cast("int"))
    rows = rows.withColumn("run", F.sum("_gap").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("doc_id", "run")
    words = F.sum("words").over(whole) + F.max("left").over(whole) + F.max("right").over(whole) + 1
    rows = rows.withColumn("_words", words).where(F.col("_words") >= min_words)
    reach = BESIDE * LONGEST
    rows = rows.withColumn("low", F.min("start").over(whole) - reach).withColumn("high", F.max(F.col("start") + F.col("length")).over(whole) + reach)
    inside = whole.orderBy("start")
    ahead = [F.col("digest"), *(F.lead("digest", k).over(inside) for k in range(1, WINDOW))]
    # Words of the k chunks from here; where those are a passage already, longer windows tell nothing more.
    held = [F.sum("words").over(inside.rowsBetween(0, k - 1)) for k in range(1, WINDOW)]
    keys = F.array_compact(F.array(*(F.when(ahead[k].isNotNull() & (held[k - 1] < min_words), F.xxhash64(*ahead[: k + 1])) for k in range(1, WINDOW))))
    return rows.select("digest", "doc_id", "start", "length", "run", "low", "high", "owner", "there", "n", keys.alias("keys"))


def pointed(shared: DataFrame) -> DataFrame:
    """Occurrences with `to`: the first document with the digest and the one just before in a run of holders, and the places there."""
    # A digest with many holders has several runs of them, so that none is one task's.
    shared = shared.drop("keys").withColumn("_run", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / HOLDERS)))
    order = Window.partitionBy("digest", "_run").orderBy("doc_id", "start")
    before = F.struct(F.lag("doc_id").over(order).alias("owner"), F.lag("start").over(order).alias("there"))
    shared = shared.withColumn("_before", before).withColumn("_new", F.col("_before.owner").isNull() | (F.col("_before.owner") != F.col("doc_id")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # All of a document's chunks with one digest point where its first one does.
    to = F.last(F.when(F.col("_new"), F.col("_before")), ignorenulls=True).over(upto)
    shared = shared.withColumn("_to", to)
    both = F.array_distinct(F.filter(F.array(F.struct("owner", "there"), F.col("_to")), lambda x: x["owner"] != F.col("doc_id")))
    return shared.select("doc_id", "run", "low", "high", "start", "length", F.explode(both).alias("to")).select("doc_id", "run", "low", "high", "start", "length", "to.owner", "to.there")


def pointed_windows(shared: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Occurrences and the first document with the same 2 to WINDOW chunks in a row, where that isn't the first one with the chunk itself."""
    is_first = (F.col("doc_id") == F.col("owner")) & (F.col("start") == F.col("there"))
    each = shared.select(F.explode("keys").alias("key"), "doc_id", "start", is_first.alias("_is_first"))
    firsts = each.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("_first"), F.max("doc_id").alias("_top"), F.bool_or("_is_first").alias("_known"))
    firsts = firsts.where("not _known and _first.doc_id <> _top").select(F.col("key").alias("_key"), F.col("_first.doc_id").alias("owner"), F.col("_first.start").alias("there"))
    firsts = scratch.write(firsts, "windows")
    if firsts.count() <= SENT_WINDOWS:
        firsts = F.broadcast(firsts)
    rows = shared.select(F.explode("keys").alias("key"), "doc_id", "run", "low", "high", "start", "length").join(firsts, F.col("key") == F.col("_key"))
    return rows.where("owner <> doc_id").select("doc_id", "run", "low", "high", "start", "length", "owner", "there")


def candidates(found: DataFrame, min_words: int, scratch: C.Scratch) -> DataFrame:
    """doc_id, owner, delta, start, end: stretches from the first to the last chunk of a run that point to one document whose text stands `delta` bytes before, and the run's low and high end, beyond which nothing repeats."""
    shared = scratch.write(shared_runs(found, min_words), "shared")
    scratch.discard("chunks")
    scratch.release()  # of the chunks' shuffle files
    rows = pointed(shared).union(pointed_windows(shared, scratch))
    lines = rows.groupBy("doc_id", "run", "low", "high", "owner", (F.col("start") - F.col("there")).alias("delta"))
    lines = lines.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end")).drop("run")
    return lines.select("doc_id", "low", "high", "owner", "delta", "start", "end")


def stretches(raw: bytes, theirs: bytes, begin: int, min_words: int, words: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """[s, e) of raw, whole words, `min_words` or more, equal to `theirs`, which stands at `begin` in raw's places."""
    data, other = np.frombuffer(raw, np.uint8), np.frombuffer(theirs, np.uint8)
    a, b = max(0, begin), min(len(raw), begin + len(other))
    if a >= b:
        return []
    space, before = words
    same = data[a:b] == other[a - begin : b - begin]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]]))) + a
    out = []
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if before[e] - before[s] + 1 < min_words:
            continue
        while s < e and s > 0 and not space[s - 1] and not space[s]:
            s += 1  # a word that began before isn't whole
        while e > s and e < len(raw) and not space[e - 1] and not space[e]:
            e -= 1
        if before[e] - before[s] >= min_words:
            out.append((s, e))
    return out


def compared(docs: DataFrame, lines: DataFrame, reach: int, min_words: int, scratch: C.Scratch) -> DataFrame:
    """doc_id, row, owner, s, e of passages; and, with s null, the lines whose equal stretch goes on beyond `reach` (as delta, start, end, low, high)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = lambda c, side: F.greatest(F.lit(0).cast("long"), (F.greatest if side < 0 else F.least)(F.col(c) + side * reach, F.col("low" if side < 0 else "high")) - F.col("delta"))
    lines = lines.withColumn("a", span("start", -1)).withColumn("b", span("end", 1))
    wanted = scratch.write(lines.select(F.col("owner").alias("_owner"), F.col("a").alias("_a"), F.col("b").alias("_b")).distinct(), "stretches")
    ids = scratch.write(wanted.select(F.col("_owner").alias("doc_id")).distinct(), "owners")
    held = C.by_ids(docs, ids, "doc_id", "left_semi").select(F.col("doc_id").alias("_id"), F.encode("text", "UTF-8").alias("_bytes"))
    # Rows that share an id: any of their texts.
    slices = wanted.join(held, F.col("_owner") == F.col("_id")).select("_owner", "_a", "_b", F.substring("_bytes", (F.col("_a") + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int")).alias("slice"))
    full = lines.join(slices, (F.col("owner") == F.col("_owner")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select("doc_id", "owner", "delta", "start", "end", "low", "high", "a", "slice")
    mine = scratch.write(lines.select("doc_id").distinct(), "touched")
    own = C.by_ids(docs, mine, "doc_id", "left_semi").select("doc_id", F.encode("text", "UTF-8").alias("slice"))
    empty = [F.lit(None).cast(full.schema[c].dataType).alias(c) for c in ("owner", "delta", "start", "end", "low", "high", "a")]
    both = own.select("doc_id", *empty, "slice").union(full).repartition("doc_id").sortWithinPartitions("doc_id", F.asc_nulls_first("a"), "delta", "owner")
    names = ["doc_id", "owner", "delta", "start", "end", "low", "high", "s", "e"]

    def run(batches):
        at, texts = None, []
        for batch in batches:
            ids, theirs = batch.column(0).to_pylist(), batch.column(8)
            values = list(zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True))
            rows, marks = [], []
            for r, (i, value) in enumerate(zip(ids, values, strict=True)):
                if i != at:
                    at, texts = i, []
                if value[-1] is None:
                    raw = theirs[r].as_py() or b""
                    texts.append((raw, word_starts(np.frombuffer(raw, np.uint8))))
                    continue
                delta, start, end, low, high, a = value
                piece = theirs[r].as_py()
                begin = a + delta
                more = False
                for raw, words in texts:
                    for s, e in stretches(raw, piece, begin, min_words, words):
                        rows.append(r)
                        marks.append((s, e))
                    stop = begin + len(piece)
                    first, last = max(begin, 0), min(stop, len(raw))
                    more |= low < first - 1 and first < len(raw) and piece[first - begin : first - begin + reach // 2] == raw[first : first + reach // 2]
                    more |= high > last and last < len(raw) and last > first and piece[max(0, last - begin - reach // 2) : last - begin] == raw[max(last - reach // 2, first) : last]
                if more:
                    rows.append(r)
                    marks.append((None, None))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(7)), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64())], names)

    C.code_path(docs.sparkSession)
    return scratch.write(both.mapInArrow(run, f"doc_id {kind}, owner {kind}, delta long, start long, end long, low long, high long, s long, e long"), "passages")


def passages(docs: DataFrame, min_words: int, scratch: C.Scratch) -> DataFrame:
    """doc_id, owner, s, e (bytes) of stretches that an earlier document has."""
    lines = scratch.write(candidates(scratch.write(occurrences(docs), "chunks"), min_words, scratch), "candidates")
    scratch.discard("shared")
    scratch.release()
    docs, reach, out = docs.where("doc_id is not null"), REACH, None
    while True:
        rows = compared(docs, lines, reach, min_words, scratch)
        marks = rows.where("s is not null").select("doc_id", "owner", "s", "e")
        out = marks if out is None else out.union(marks)
        # What goes on beyond a slice is looked at again, unless a passage known by now covers it on both ends.
        spans = out.groupBy("doc_id").agg(F.collect_set(F.struct("s", "e")).alias("_spans")).withColumnRenamed("doc_id", "_id")
        open_ = rows.where("s is null").select("doc_id", "owner", "delta", "start", "end", "low", "high")
        left, right = F.col("start") - reach, F.col("end") + reach
        covered = lambda place: F.exists("_spans", lambda x: (x["s"] < place) & (x["e"] > place))
        again = open_.join(spans, open_["doc_id"] == spans["_id"], "left")
        known = lambda place, inside: ~inside | F.coalesce(covered(place), F.lit(False))
        again = again.where(~(known(left, left > F.col("low")) & known(right, right < F.col("high")))).select(*open_.columns)
        lines = scratch.write(again, "candidates")
        if lines.isEmpty():
            return out
        reach *= MORE


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 40) -> DataFrame:
    """All columns of df, the text without passages that an earlier document has, then n_removed (code points), spans ([start, end) code points of the text before) and owners."""
    new = ["n_removed", "spans", "owners"]
    keep = [c for c in df.columns if c not in new]
    df = df.select(*keep)
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    with C.Scratch(df.sparkSession, "substring-dedup") as scratch:
        marks = passages(docs, min_words, scratch).groupBy("doc_id", "s", "e").agg(F.min("owner").alias("owner"))
        grouped = C.materialize(marks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("s", "e", "owner"))).alias("_marks")).withColumnRenamed("doc_id", "_id"), "marks")
    added = T.StructType.fromDDL(f"n_removed long, spans array<struct<start:long,end:long>>, owners array<{kind}>")
    schema = T.StructType([*df.schema, *added])
    ids = grouped.select(F.col("_id").alias(key))
    inside = C.by_ids(df, ids, key, "left_semi")
    inside = inside.join(grouped, inside[key] == grouped["_id"]).select(*keep, "_marks")
    at = keep.index(text)

    def run(batch):
        texts, spans_of, owners_of, removed = [], [], [], []
        for t, marks in zip(batch.column(at).to_pylist(), batch.column(len(keep)).to_pylist(), strict=True):
            raw = (t or "").encode("utf-8", "surrogatepass")
            spans, owners = [], set()
            for m in marks:
                if m["e"] > len(raw):  # of another row that shares the id
                    continue
                owners.add(m["owner"])
                if spans and m["s"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], m["e"])
                else:
                    spans.append([m["s"], m["e"]])
            lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            left, last = [], 0
            for s, e in spans:
                left.append(raw[last:s])
                last = e
            texts.append(b"".join([*left, raw[last:]]).decode("utf-8", "surrogatepass") if spans else t)
            spans_of.append([{"start": int(lead[s]), "end": int(lead[e])} for s, e in spans])
            owners_of.append(sorted(owners))
            removed.append(sum(x["end"] - x["start"] for x in spans_of[-1]))
        columns = list(batch.columns[: len(keep)])
        columns[at] = pa.array(texts, columns[at].type)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        id_type = batch.column(len(keep)).type.value_type.field("owner").type
        yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64()), pa.array(spans_of, span), pa.array(owners_of, pa.list_(id_type))], [*keep, *new])

    changed = C.map_arrow(inside, run, schema)
    empty: list[Column] = [F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.array().cast(f"array<{kind}>").alias("owners")]
    same = C.by_ids(df, ids, key, "left_anti").select(*keep, *empty)
    return same.unionByName(changed)

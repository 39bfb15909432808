"""N-gram Jaccard self-join by T-occurrence search.

A document's set holds hashes of its distinct k-word shingles; documents with the same set
form a class, and only class representatives are compared. Two sets that are similar enough
share at least T tokens among the first ones of any fixed order of all tokens (rare ones
first here), so representatives that meet on fewer tokens of these inverted lists are no
candidates. Candidates are decided exactly: inverted lists are built over them, and of the lists
of a document's tokens the short ones are merged by a heap and the long ones probed by binary
search for what is left (DivideSkip); what reaches the overlap that the threshold demands is kept.

Groups of near copies may be large, and pairs of them needn't be similar enough, so they are
never listed as pairs. Each representative joins the group of one hub (of its lists, the
document there that shares most of its own tokens). The hub is searched against its group;
what links with it is connected, and what doesn't is searched against all others, in blocks of
bounded size, from which only links that join components leave. Pairs across groups, which
are few, are found on the inverted lists. Documents stop being compared only once they are
known to be connected, so no link that joins two components is lost.

Defined results: a text with fewer words than k is one shingle; null texts and those
without words have an empty set and link with nothing; rows that share an id are one node;
rows without id have no component unless their set has a row with one.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import common as C
from corpusloom.llm.components import components, joined

#: Ids that a filter sent to all executors holds at most (8 bytes each); more are joined.
SENT_IDS = 2_000_000
#: Rows of a few ids and numbers that are broadcast at most (about 100 bytes each).
SENT_ROWS = 500_000
#: Tokens in a block: of a document's candidates that are searched together, or of a group, of which a task holds two blocks.
BLOCK_TOKENS = 200_000
#: Parts, by token, in which postings are looked through.
SLICES = 4
SKIP = 0.0085
#: An overlap that no set reaches.
NEVER = 1 << 40
#: One row in so many gives the order of tokens, but at least `sample_rows` of them.
SAMPLED = 100


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the ASCII-lower-cased text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = C.mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def at_least(share: tuple[int, int], x: int) -> int:
    """ceil(share * x)"""
    return -(-share[0] * x // share[1])


def needed(share: tuple[int, int], a: int, b: int) -> int:
    """The overlap at which sets of sizes a and b reach the Jaccard share."""
    return -(-share[0] * (a + b) // (share[0] + share[1]))


def prefix_extra(n: int) -> int:
    """Tokens that similar sets must share within their prefixes: one, and one more for each 50 tokens."""
    return 1 + n // 50


class InvertedLists:
    """For each token, which of some sets hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")  # within a token the sets stay in order
        flat = flat[order]
        self.sets = np.repeat(np.arange(len(sets)), self.sizes)[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        self.tokens, self.start = flat[first], np.append(first, len(flat))

    def search(self, own: np.ndarray, share: tuple[int, int], alive: np.ndarray | None = None) -> list[int]:
        """Which sets (of those alive) reach the share with `own`: short lists are merged by a heap, long ones probed for what is left (DivideSkip)."""
        if not len(own) or not len(self.tokens):
            return []
        want = -(-share[0] * (len(own) + self.sizes) // (share[0] + share[1]))
        able = want <= np.minimum(len(own), self.sizes)
        able &= alive if alive is not None else True
        if not able.any():
            return []
        want = np.where(able, want, NEVER)
        at = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
        at = at[self.tokens[at] == own]
        least = max(1, int(want.min()))
        if len(at) < least:
            return []
        length = self.start[at + 1] - self.start[at]
        at = at[np.argsort(length, kind="stable")]
        longest = int(length.max())
        n_long = min(least - 1, len(at), int(least / (SKIP * np.log2(max(2, longest)) + 1)))
        lists = [self.sets[a:b] for a, b in zip(self.start[at].tolist(), self.start[at + 1].tolist(), strict=True)]
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        docs, counts = [], []
        enough = (want - n_long).tolist()
        for doc, run in groupby(heapq.merge(*(x.tolist() for x in short))):
            n = sum(1 for _ in run)
            if n >= enough[doc]:
                docs.append(doc)
                counts.append(n)
        docs, counts = np.array(docs, np.int64), np.array(counts, np.int64)
        for k, x in enumerate(reversed(long)):
            left = counts + n_long - k >= want[docs]
            docs, counts = docs[left], counts[left]
            if not len(docs):
                break
            found = np.minimum(np.searchsorted(x, docs), len(x) - 1)
            counts = counts + (x[found] == docs)
        return docs[counts >= want[docs]].tolist()


def divide_skip(own: np.ndarray, others: list[np.ndarray], share: tuple[int, int]) -> list[int]:
    """Which of the other sets reach the share with `own`."""
    return InvertedLists(others).search(own, share)


def rare_first(df: DataFrame, k: int, sample_rows: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that a sample finds frequent, sorted, and their counts, the `most` frequent ones. The order of tokens affects speed alone."""
    rows = df.count()
    sample_rows = max(sample_rows, rows // SAMPLED)
    place = F.pmod(F.xxhash64("doc_id", F.lit("shingle sample")), F.lit(1 << 30))
    sample = df.where(place < int((1 << 30) * min(1.0, sample_rows / max(1, rows))))

    def run(batch):
        sets = [shingles(t, k) for t in batch.column(1).to_pylist()]
        got, n = np.unique(np.concatenate(sets), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(n)], ["token", "n"])

    top = C.map_arrow(sample, run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 4").orderBy(F.desc("n"), "token").limit(most).toArrow()
    tokens, n = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def sets_with_prefix(df: DataFrame, k: int, share: tuple[int, int], sample_rows: int, most: int) -> DataFrame:
    """doc_id, n, digest, prefix of each row (digest and prefix null for an empty set; no prefix where only equal sets can be similar)."""
    sent = df.sparkSession.sparkContext.broadcast(rare_first(df, k, sample_rows, most))

    def run(batch):
        texts = batch.column(1).to_pylist()
        for a, b in C.blocks(texts):
            yield of_block(batch.column(0).slice(a, b - a), texts[a:b])

    def of_block(ids, texts):
        frequent, counts = sent.value
        n, digests, prefixes = [], [], []
        for t in texts:
            own = shingles(t, k)
            n.append(len(own))
            digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            if not len(own):
                prefixes.append(None)
                continue
            length = len(own) - at_least(share, len(own)) + prefix_extra(len(own))
            if at_least(share, len(own) + 1) > len(own):  # not even one token more would do
                prefixes.append(np.zeros(0, np.int64))
                continue
            often = np.zeros(len(own), np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                often = np.where(frequent[at] == own, counts[at], 0)
            prefixes.append(own[np.lexsort((own, often))][:length].view(np.int64))
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "prefix"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return C.map_arrow(df, run, f"doc_id {kind}, n long, digest binary, prefix array<long>")


def sets_of(df: DataFrame, ids: DataFrame, k: int, scratch: C.Scratch) -> DataFrame:
    """id, tokens of the rows named in ids (one column, id)."""
    ids = scratch.write(ids.distinct(), "wanted")
    kind = df.schema["doc_id"].dataType.simpleString()
    if ids.count() <= SENT_IDS:
        wanted = np.sort(ids.toArrow().column(0).to_numpy())
        sent = df.sparkSession.sparkContext.broadcast(wanted)

        def pick(batch):
            wanted, own = sent.value, batch.column(0).to_numpy(zero_copy_only=False)
            if len(wanted):
                at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                yield from build(batch.filter(pa.array(wanted[at] == own)))

    else:
        df = df.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select("doc_id", "text")

        def pick(batch):
            yield from build(batch)

    def build(batch):
        texts = batch.column(1).to_pylist()
        for a, b in C.blocks(texts):
            tokens = [shingles(t, k).view(np.int64) for t in texts[a:b]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(tokens, pa.list_(pa.int64()))], ["id", "tokens"])

    return scratch.write(C.map_arrow(df.where("doc_id is not null"), pick, f"id {kind}, tokens array<long>"), "sets")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("id")).union(pairs.select("y"))


def sent(rows: DataFrame) -> DataFrame:
    """Written rows of ids and numbers, broadcast behind a check of their count. Beyond it they are joined by a shuffle of what was written, which adaptive execution splits at hot keys."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def with_sets(rows: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """Written rows of ids and numbers joined with their sets."""
    return sent(rows).join(sets, key)


def linked(sets: DataFrame, pairs: DataFrame, share: tuple[int, int], scratch: C.Scratch) -> DataFrame:
    """Those pairs x, y (n: tokens of y) whose sets (id, tokens) reach the share, decided by one DivideSkip search for each x and a block of its candidates."""
    salts = scratch.write(pairs.groupBy("x").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("_s")), "salts")
    dealt = scratch.write(pairs.join(sent(salts), "x").select("x", "y", F.pmod(F.xxhash64("y"), F.col("_s")).alias("salt")), "dealt")
    theirs = with_sets(dealt, sets.withColumnRenamed("id", "y"), "y").select("x", "salt", "y", "tokens")
    own = dealt.select("x", "salt").distinct().join(sets.withColumnRenamed("id", "x"), "x").select("x", "salt", F.lit(None).cast(sets.schema["id"].dataType).alias("y"), "tokens")
    together = theirs.union(own).repartition("x", "salt").sortWithinPartitions("x", "salt", F.asc_nulls_first("y"))
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches):
        at, mine = None, []
        for batch in batches:
            xs, salts, ys = (batch.column(i).to_pylist() for i in range(3))
            values, offsets = batch.column(3).values.to_numpy().view(np.uint64), batch.column(3).offsets.to_numpy()
            sets = [values[offsets[i] : offsets[i + 1]] for i in range(len(xs))]
            out: list[tuple] = []
            for key, run_ in groupby(range(len(xs)), lambda i: (xs[i], salts[i])):
                rows = list(run_)
                if key != at:
                    at, mine = key, []
                mine += [sets[i].copy() for i in rows if ys[i] is None]
                others = [i for i in rows if ys[i] is not None]
                for own in mine:
                    out += [(key[0], ys[others[d]]) for d in divide_skip(own, [sets[i] for i in others], share)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.schema.field("x").type), pa.array([o[1] for o in out], batch.schema.field("x").type)], ["x", "y"])

    C.code_path(sets.sparkSession)
    return scratch.write(together.mapInArrow(run, f"x {kind}, y {kind}"), "links")


def similar(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, share: tuple[int, int] = (85, 100), sample_rows: int = 4000, most_frequent: int = 65_536) -> DataFrame:
    """doc_id, n_shingles, component_id of each row. The sample only chooses an order of tokens; every row is joined whole."""
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    with C.Scratch(df.sparkSession, "ngram-join") as scratch:
        rows = scratch.write(sets_with_prefix(docs, k, share, sample_rows, most_frequent), "shingle-sets")
        classes = scratch.write(rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
        known = search(docs, rows, classes, k, share, scratch)
        out = rows.select("doc_id", "n", "digest").join(classes, "digest", "left").join(known.withColumnRenamed("node", "rep"), "rep", "left")
        return C.materialize(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")), "similar")


def search(docs: DataFrame, rows: DataFrame, classes: DataFrame, k: int, share: tuple[int, int], scratch: C.Scratch) -> DataFrame:
    """node, component of the class representatives that link with another one."""
    reps = rows.where("doc_id is not null and size(prefix) > 0").join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"])
    reps = scratch.write(reps.select(F.col("doc_id").alias("rep"), F.col("n").cast("int").alias("n"), "prefix"), "representatives")
    lists = None
    for at in range(SLICES):  # one after the other, so that only a part of the postings is in shuffle files at a time
        postings = reps.select("rep", "n", F.explode("prefix").alias("token")).where(F.pmod("token", F.lit(SLICES)) == at)
        shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("token")
        part = scratch.write(postings.join(shared, "token"), "slice")
        scratch.release()
        lists = part if lists is None else lists.union(part)
    scratch.discard("representatives")
    # Whoever is on fewer lists than a similar pair must share has no partner.
    own = F.count(F.lit(1)).over(Window.partitionBy("rep"))
    lists = scratch.write(lists.withColumn("m", own).where(F.col("m") >= 1 + F.floor(F.col("n") / 50)), "lists")
    groups = scratch.write(hub_groups(lists, share, scratch), "groups")
    scratch.release()  # of the lists' shuffle files, the largest ones; Spark holds on to those of its last query
    sets = sets_of(docs, groups.select(F.col("rep").alias("id")), k, scratch)
    known = components(blocked(groups, sets, share, scratch), "x", "y", scratch)
    scratch.release()
    met = scratch.write(candidates(lists, groups, known, share), "candidates")
    across = linked(sets_of(docs, ends(met), k, scratch), met, share, scratch)
    return joined(known, across, "x", "y", scratch)


def hub_groups(lists: DataFrame, share: tuple[int, int], scratch: C.Scratch) -> DataFrame:
    """rep, n, hub, members, tokens: representatives in groups of those that share prefix tokens with one hub.

    A list's hub is its member that shares most of its own prefix (an original among edited
    copies); each member joins the hub of most of its lists, if these are as many as a similar
    pair must share; others are in no group.
    """
    common = lists.groupBy("rep", "n").agg(F.count(F.lit(1)).alias("_c")).select("rep", (F.col("_c") / prefix_size(F.col("n"), share)).alias("_share"))
    hubs = lists.select("token", "rep").join(common, "rep").groupBy("token").agg(F.min_by("rep", F.struct(-F.col("_share"), "rep")).alias("hub"))
    votes = lists.select("token", "rep", "n", "m").join(hubs, "token").groupBy("rep", "n", "m", "hub").agg(F.count(F.lit(1)).alias("_v"))
    first = votes.groupBy("rep", "n", "m").agg(F.min_by("hub", F.struct(-F.col("_v"), "hub")).alias("hub"), F.max("_v").alias("_v")).where(F.col("_v") >= 1 + F.floor(F.col("n") / 50))
    first = scratch.write(first, "first")
    hubs = first.select(F.col("hub").alias("rep")).distinct()
    leader = lists.join(hubs, "rep", "left_semi").select(F.col("rep").alias("hub"), F.col("n").alias("_n"), F.col("m").alias("_m")).distinct()
    first = first.join(sent(scratch.write(leader, "leaders")), "hub").where(F.least("m", "_m") >= enough(F.col("n"), F.col("_n"), share))
    first = scratch.write(first, "near")
    # A hub stands in its own group, wherever its own lists would put it.
    leaders = first.select(F.col("hub").alias("rep"), F.lit(True).alias("_leads")).distinct()
    sizes = lists.select("rep", "n").distinct()
    placed = first.join(leaders, "rep", "left_anti").select("rep", "n", "hub").union(leaders.join(sizes, "rep").select("rep", "n", F.col("rep").alias("hub")))
    placed = scratch.write(placed, "placed")  # so that sizes are added up in map tasks first
    totals = placed.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens")).where("members > 1")
    return placed.join(sent(scratch.write(totals, "totals")), "hub")


def blocked(groups: DataFrame, sets: DataFrame, share: tuple[int, int], scratch: C.Scratch) -> DataFrame:
    """x, y: links within groups, as far as they join components.

    Members are searched for by their hub first. Only strays, which don't link with it, are searched
    for among all: strays and the others are cut into blocks of about BLOCK_TOKENS tokens, and a
    task holds one block of strays and one other.
    """
    direct = linked(sets, groups.where("rep <> hub").select(F.col("hub").alias("x"), F.col("rep").alias("y"), "n"), share, scratch)
    members = groups.where("rep <> hub").join(direct.select(F.col("y").alias("rep"), F.lit(False).alias("_s")), "rep", "left")
    members = scratch.write(members.select("rep", "n", "hub", F.coalesce("_s", F.lit(True)).alias("stray")), "members")
    blocks = lambda stray: F.ceil(F.sum(F.when(F.col("stray") == stray, F.col("n")).otherwise(0)) / BLOCK_TOKENS).cast("int")
    totals = scratch.write(members.groupBy("hub").agg(blocks(True).alias("_sb"), blocks(False).alias("_lb")).where("_sb > 0"), "strays")
    h, sb, lb = F.xxhash64("rep"), F.col("_sb"), F.col("_lb")
    own = F.when(F.col("stray"), F.pmod(h, F.greatest(sb, F.lit(1)))).otherwise(sb + F.pmod(h, F.greatest(lb, F.lit(1)))).cast("int")
    to = F.when(F.col("stray"), F.sequence(F.lit(0), sb + lb - 1)).otherwise(F.sequence(F.lit(0), sb - 1))
    state = members.join(sent(totals), "hub").withColumn("own", own).withColumn("_o", F.explode(to))
    dealt = state.select("hub", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"), "own", "stray", F.col("rep").alias("id"))
    rows = with_sets(scratch.write(dealt, "dealt"), sets, "id").select("hub", "i", "j", "own", "stray", "id", "tokens").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "own", "id")
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches):
        at, held = None, []
        for batch in batches:
            hubs, a, b, own, stray, ids = (batch.column(c).to_pylist() for c in range(6))
            values, offsets = batch.column(6).values.to_numpy().view(np.uint64), batch.column(6).offsets.to_numpy()
            out = []
            for r, key in enumerate(zip(hubs, a, b, strict=True)):
                if key != at:
                    out += block_links(at, held, share)
                    at, held = key, []
                held.append((ids[r], own[r], stray[r], values[offsets[r] : offsets[r + 1]].copy()))
            yield pairs_batch(out, batch.schema.field("id").type)
            kept = batch.schema.field("id").type
        if held:
            yield pairs_batch(block_links(at, held, share), kept)

    C.code_path(sets.sparkSession)
    return direct.union(scratch.write(rows.mapInArrow(run, f"x {kind}, y {kind}"), "links-within"))


def pairs_batch(pairs: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind)], ["x", "y"])


def block_links(key: tuple | None, rows: list[tuple], share: tuple[int, int]) -> list[tuple]:
    """Links of the strays of block i with what is in block j, as far as they join what isn't joined here yet. Rows: id, block, whether a stray, tokens."""
    if key is None:
        return []
    _, i, j = key
    # What links with the hub is one component.
    parent = [r if row[2] else -1 for r, row in enumerate(rows)] + [len(rows)]
    parent = [len(rows) if p < 0 else p for p in parent]

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index, out = InvertedLists([r[3] for r in rows]), []
    block = np.array([r[1] for r in rows])
    for x, row in enumerate(rows):
        if row[1] != i or not row[2]:
            continue
        alive = (block == j) & (np.arange(len(rows)) > x if i == j else True)
        mine = root(x)
        alive &= np.array([root(y) != mine for y in range(len(rows))])
        for y in index.search(row[3], share, alive):
            if root(x) != root(y):
                parent[root(x)] = root(y)
                out.append((row[0], rows[y][0]))
    return out


def candidates(lists: DataFrame, groups: DataFrame, known: DataFrame, share: tuple[int, int]) -> DataFrame:
    """x, y, n (tokens of y): pairs in different groups and components that meet on so many lists that they may reach the share."""
    rows = lists.join(groups.select("rep", "hub"), "rep", "left").join(known.withColumnRenamed("node", "rep"), "rep", "left")
    rows = rows.select("rep", "n", "m", "token", F.coalesce("hub", "rep").alias("hub"), F.coalesce("component", "rep").alias("c"))
    # Tokens that stand in one group or one component alone can't join two of them.
    mixed = rows.groupBy("token").agg(F.min("hub").alias("_a"), F.max("hub").alias("_b"), F.min("c").alias("_c"), F.max("c").alias("_d")).where("_a <> _b and _c <> _d").select("token")
    rows = rows.join(mixed, "token")
    a = rows.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("m").alias("mx"), F.col("hub").alias("gx"), F.col("c").alias("cx"), "token")
    b = rows.select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("m").alias("my"), F.col("hub").alias("gy"), F.col("c").alias("cy"), F.col("token").alias("_token"))
    part, whole = share
    nx, ny = F.col("nx"), F.col("ny")
    least = enough(nx, ny, share)
    sized = (nx * whole >= ny * part) & (ny * whole >= nx * part) & (F.least("mx", "my") >= least)
    met = a.join(b, (F.col("token") == F.col("_token")) & (F.col("x") < F.col("y")) & (F.col("gx") != F.col("gy")) & (F.col("cx") != F.col("cy")) & sized)
    met = met.groupBy("x", "y", "nx", "ny").agg(F.count(F.lit(1)).alias("_n"))
    return met.where(F.col("_n") >= least).select("x", "y", F.col("ny").alias("n"))


def prefix_size(n: Column, share: tuple[int, int]) -> Column:
    """Tokens in the prefix of a set of n, as sets_with_prefix cuts it."""
    return n - F.ceil(n * share[0] / share[1]) + 1 + F.floor(n / 50)


def enough(nx: Column, ny: Column, share: tuple[int, int]) -> Column:
    """Prefix tokens that sets of nx and ny must share to be similar.

    Of each token that two prefixes don't share, one set hasn't the token; what follows the prefixes may be shared whole.
    """
    part, whole = share
    overlap = F.ceil(F.lit(part) * (nx + ny) / (part + whole))
    return F.greatest(1 + F.floor(F.least(nx, ny) / 50), overlap - F.greatest(nx - prefix_size(nx, share), ny - prefix_size(ny, share)))

"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

Words are counted over whole texts (each task adds up its rows first). Two words one edit
apart share their first half or their last half, so the index is dealt by these halves:
a word goes to the few groups named by its halves, turned round for last halves, and
a pair meets in one of them. Within a group each word's q-grams behind the shared half have
posting lists by gram, place and length. A word merges, by a heap, the lists of its grams
at the places that one edit allows (the same place, and for a word longer by one also the
next) and keeps words on at least as many lists as one edit leaves in common; these are
then compared. Groups of more than `block` words are dealt in blocks by a hash, of which every two meet.

A word's form is its near word of largest count, if that is `ratio` times its own; roots
follow forms to the end by doubling steps, which stop as counts grow by that ratio each time.

Defined results: null and empty texts have no words; an empty table gives no rows; rows
that repeat count each time, and a null id counts as an empty one where ids matter; among
near words of the same count the smallest in code-point order is the form; words of any
length are indexed whole; of the input only the named columns are read, whatever else it has.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common as C

#: Maximal runs of these characters are words.
LETTERS = "A-Za-zÀ-ÿ"
CAPITALS = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Characters of a q-gram. One edit leaves max(lengths) + 1 - 2 * Q of them, of which words of LEAST_LENGTH have one at least behind a shared half.
Q = 2
#: Different words that a task counts before it hands them on.
HELD_WORDS = 1 << 17
#: Words of a group that are indexed at once.
BLOCK = 20_000
#: Pairs in an Arrow batch.
OUT_ROWS = 10_000


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", drop_one_in: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of words of at least so many code points and occurrences; only A-Z are lower-cased.

    With `drop_one_in`, a word whose crc32(`id:word`) that number divides loses the code point
    at the crc modulo its length, which makes misspellings of a known rate.
    """
    pattern = re.compile(f"[{LETTERS}]+")
    C.code_path(df.sparkSession)

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Counter(m[0] for m in pattern.finditer(t.as_py() or ""))
                lower: Counter[str] = Counter()
                for w, k in own.items():
                    lower[w.lower() if w.isascii() else w.translate(CAPITALS)] += k
                before = zlib.crc32(f"{name}:".encode())
                for w, k in lower.items():
                    if drop_one_in and (h := zlib.crc32(w.encode(), before)) % drop_one_in == 0:
                        w = w[: h % len(w)] + w[h % len(w) + 1 :]
                    if len(w) >= least_length:
                        counts[w] += k
                if len(counts) >= HELD_WORDS:
                    yield batch_of(counts)
                    counts.clear()
        if counts:
            yield batch_of(counts)

    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text)).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def routed(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """route, i, j, mine, k, turned, word, n: each word in each group of its halves, and there in each pair of blocks that its own block belongs to.

    A pair whose shorter word has L characters meets in the group of its first k = L div 2, or turned round of its last L - L div 2.
    """
    length = F.char_length("word")

    def half(least: Column, turned: bool) -> Column:
        k = F.floor((least + int(turned)) / 2).cast("int")
        word = F.reverse("word") if turned else F.col("word")
        return F.struct(F.xxhash64(F.lit(turned), F.substring(word, 1, k)).alias("route"), k.alias("k"), F.lit(turned).alias("turned"), word.alias("word"))

    # As the shorter or an equal word, and as the longer one of a pair; both may name the same group.
    halves = F.array_distinct(F.array(*[half(least, turned) for turned in (False, True) for least in (length, length - 1)]))
    rows = words.select("n", F.inline(halves))
    sizes = rows.groupBy("route").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    large = F.ceil(F.col("size") / block).cast("int")
    rows = rows.join(sizes, "route").withColumn("_blocks", large).withColumn("mine", F.pmod(F.xxhash64("word"), F.col("_blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    return rows.select("route", "mine", "k", "turned", "word", "n", F.inline(others))


def one_edit(a: str, b: str) -> bool:
    """Whether a and b, of which b may be longer by one, differ by exactly one edit."""
    if len(a) == len(b):
        at = next((i for i in range(len(a)) if a[i] != b[i]), None)
        return at is not None and a[at + 1 :] == b[at + 1 :]
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at:] == b[at + 1 :]


def merged(lists: list[list[int]], least: int) -> Iterator[int]:
    """Entries that sorted lists hold at least `least` times, by a heap."""
    last, seen = -1, 0
    for entry in heapq.merge(*lists):
        seen = seen + 1 if entry == last else 1
        last = entry
        if seen == least:
            yield entry


def near_in_group(words: list[str], shared: list[int], sides: list[tuple[bool, bool]], turned: bool) -> Iterator[tuple[int, int]]:
    """Pairs (a, b) of places in `words`, b as long as a or longer by one, that are one edit apart behind a shared start.

    shared: the characters that a word shares with its group; sides: whether a word belongs to
    the first and to the second of the blocks that meet, of which a pair needs one each.
    """
    lists: dict[tuple[bool, str, int, int], list[int]] = defaultdict(list)
    for b, w in enumerate(words):
        for p in range(max(0, shared[b] - Q + 1), len(w) - Q + 1):
            lists[sides[b][1], w[p : p + Q], p, len(w)].append(b)
    for a, w in enumerate(words):
        if (len(w) + turned) // 2 != shared[a]:
            continue  # here only as the longer word of a pair
        begin = max(0, shared[a] - Q + 1)
        other = sides[a][0]  # words of the first block meet those of the second one, and the other way round
        for longer in (0, 1):
            size = len(w) + longer
            # grams that one edit leaves in common, less those that lie within the shared start
            least = size + 1 - 2 * Q - begin
            found = [x for p in range(begin, len(w) - Q + 1) for q in range(p, p + longer + 1) if (x := lists.get((other, w[p : p + Q], q, size)))]
            if len(found) >= least:
                yield from ((a, b) for b in merged(found, least) if (longer or a < b) and one_edit(w, words[b]))


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, near, near_n: all pairs of different words one edit apart, both ways round, each once. `words` has word and n, no word twice and none shorter than LEAST_LENGTH."""
    group = ["route", "i", "j", "k", "turned"]
    # A fixed number of partitions: rows are few bytes but much work, so adaptive execution shall not put them together.
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = routed(words, block).repartition(parts, "route", "i", "j").sortWithinPartitions("route", "i", "j", "word")
    C.code_path(words.sparkSession)

    def pairs(held: list[tuple]) -> Iterator[tuple[str, int, str, int]]:
        """held: (k, turned, word, n, in the first block, in the second one) of one group's pair of blocks."""
        for turned in (False, True):
            own = [h for h in held if h[1] == turned]
            found = near_in_group([h[2] for h in own], [h[0] for h in own], [h[4:] for h in own], turned)
            for a, b in found:
                (ka, _, x, nx, *_), (_, _, y, ny, *_) = own[a], own[b]
                if turned:
                    x, y = x[::-1], y[::-1]
                    first = min(len(x), len(y)) // 2
                    if x[:first] == y[:first]:
                        continue  # their first halves bring them together
                yield x, nx, y, ny
                yield y, ny, x, nx

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held, key = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("route", "i", "j", "k", "turned", "word", "n", "mine")]
            for route, i, j, *row, mine in zip(*columns, strict=True):
                if (route, i, j) != key:
                    yield held
                    held, key = [], (route, i, j)
                held.append((*row, mine == i, mine == j))
        yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (p for held in groups(batches) if len(held) > 1 for p in pairs(held))
        while out := list(islice(found, OUT_ROWS)):
            columns = zip(zip(*out, strict=True), (pa.string(), pa.int64()) * 2, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["word", "n", "near", "near_n"])

    return rows.select(*group, "word", "n", "mine").mapInArrow(run, "word string, n long, near string, near_n long")


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n of each word."""
    best = F.struct(-F.col("near_n"), F.col("near"))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(best).alias("_best"))
    rows = words.join(near, "word", "left").withColumn("_n", -F.col("_best.col1"))
    usual = F.col("_n") >= ratio * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("_best.near")).alias("form"), F.when(usual, F.col("_n")).alias("form_n"))


def with_roots(rows: DataFrame) -> DataFrame:
    """Adds root, the last word that forms lead to: words with a form only are joined among themselves, twice as far each time."""
    leads = C.materialize(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = leads.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        step = C.materialize(leads.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")), "roots")
        leads = step.drop("_moved")
        if step.where("_moved").isEmpty():
            break
    return rows.join(leads, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", drop_one_in: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of a corpus."""
    if least_length < LEAST_LENGTH:
        raise ValueError(f"words of less than {LEAST_LENGTH} characters may have no gram in common behind a shared half")
    words = C.materialize(word_counts(df, key, text, drop_one_in, least_length, least_count), "words")
    found = C.materialize(forms(words, near_pairs(words, block), ratio), "forms")
    return with_roots(found).select("word", "form", "root", "n", "n_near", "form_n")

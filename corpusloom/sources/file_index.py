"""A secondary index by file: minima, maxima and Bloom filters of columns, used to pick the files that a lookup reads.

Column statistics inside Parquet tell ranges only; ids that are dealt by hash lie in every
range. A Bloom filter a file says which files can hold a value, before any of them is opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import versions

#: Bits of a file's filter for each row (rounded up to a power of two), and places a value sets there: some 2 % of other values pass.
BITS_A_ROW, PLACES = 8, 4


def _places(value: Column, bits: Column) -> Column:
    """The places of a value in a filter of so many bits (a power of two)."""
    return F.array(*[F.xxhash64(value.cast("string"), F.lit(k)).bitwiseAND(bits - 1) for k in range(PLACES)])


def build(spark: SparkSession, table: str, base: str, columns: list[str]) -> str:
    """Writes the index of a Parquet table at `base`, replacing the one before: file, rows, and by column low, high (as text in order of its kind) and filter words."""
    rows = spark.read.parquet(table).select(F.col("_metadata.file_path").alias("file"), *columns)
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    bits = F.pow(F.lit(2.0), F.greatest(F.lit(10), F.ceil(F.log2(F.col("rows") * BITS_A_ROW)))).cast("long")
    sizes = sizes.withColumn("bits", bits)
    index = sizes
    for c in columns:
        placed = rows.where(F.col(c).isNotNull()).join(sizes.select("file", "bits"), "file").select("file", F.explode(_places(F.col(c), F.col("bits"))).alias("p"))
        words = placed.groupBy("file", F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("b"))
        filters = words.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("word", "b"))).alias(f"filter_{c}"))
        index = index.join(filters, "file", "left")
    return versions.refresh(spark, base, lambda path: index.write.parquet(path))


def files_with(spark: SparkSession, base: str, column: str, values: list) -> list[str]:
    """Files that may hold any of a few values; the index has a row a file, and only names leave it."""
    index = versions.read(spark, base)
    hit = F.lit(False)
    for v in values:
        value = F.lit(v)
        within = (value >= F.col(f"low_{column}")) & (value <= F.col(f"high_{column}"))
        kind = dict(index.dtypes)[f"low_{column}"]
        word = lambda p: F.coalesce(F.col(f"filter_{column}")[F.shiftright(p, 6)], F.lit(0).cast("long"))
        set_there = F.forall(_places(value.cast(kind), F.col("bits")), lambda p: F.call_function("getbit", word(p), p.bitwiseAND(63).cast("int")) == 1)  # noqa: B023
        hit = hit | (within & F.coalesce(set_there, F.lit(False)))
    return [r["file"] for r in index.where(hit).select("file").collect()]


def lookup(spark: SparkSession, table: str, base: str, column: str, values: list) -> DataFrame:
    """Rows of the table with any of the values, from the files that may hold them. The index must be as new as the table."""
    found = files_with(spark, base, column, values)
    whole = spark.read.parquet(table)
    rows = spark.read.schema(whole.schema).option("basePath", table).parquet(*found) if found else whole.where("false")
    return rows.where(F.col(column).isin(values))

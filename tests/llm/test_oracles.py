"""Queries with SQL give DuckDB's rows, on the given tables and on awkward ones."""

import duckdb
import pytest

from corpusloom.llm import oracles, queries

TEXTS = [None, "", "  ", "one", "One", "a b c", "A b C", "x " * 3000, "x " * 2999, "d\u00e9j\u00e0 vu d\u00c9j\u00e0 vu", "42 + 1 = 43", "p q r s t u v w x y z a b c d e f", "p q r s t u v w x y z a b", "tail q r s t u v w x y z a b c end"]
ITEMS = [(1, "p q r s t u v w x y z a b"), (2, "Q R S T u v w x y z a b c d"), (10, "one"), (11, ""), (12, None), (13, "d\u00e9j\u00e0 vu"), (14, "x x x"), (15, "x x x")]


def awkward(spark, folder):
    rows = [(i, t, None, "s", len(t or "")) for i, t in enumerate(TEXTS + TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(oracles.SQL))
@pytest.mark.parametrize("kind", ["given", "awkward"])
def test_rows(spark, sf, tmp_path, name, kind):
    folder = sf if kind == "given" else awkward(spark, tmp_path)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if kind == 'given' else '/*.parquet'}')")
    want = con.sql(oracles.SQL[name])
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())

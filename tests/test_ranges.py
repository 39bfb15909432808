"""Line ranges of logs, and indexes written as streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import index_writer, line_index, sinks


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    """Three files: lines of all lengths, blank ones, one longer than several blocks, none at all, and a last line without an end."""
    rng = random.Random(3)
    top = tmp_path_factory.mktemp("log")
    own = [["", "a", "x" * 5000, *("é" * rng.randint(0, 90) for _ in range(400)), ""], [f"line {k}\r" for k in range(300)], ["last"]]
    for name, part in zip(("a", "b", "d"), own, strict=True):
        (top / f"{name}.log").write_bytes("".join(f"{t}\n" for t in part).encode())
    (top / "c.log").write_bytes(b"")
    (top / "e.log").write_bytes("one\ntwo\n\nthree".encode())
    return top, [t.removesuffix("\r") for part in own for t in part] + ["one", "two", "", "three"]


@pytest.mark.parametrize("block", [1, 64, 1000, 1 << 20])
def test_lines_by_number(spark, log, block):
    top, want = log
    # With blocks of one byte most hold no line's first byte.
    index = line_index.build(spark, str(top), block).persist()
    assert line_index.total(index) == len(want)
    for start, end in ((0, len(want)), (0, 1), (2, 3), (3, 4), (399, 410), (700, 10_000), (5, 5), (9, 2), (len(want), len(want) + 9)):
        got = {r.idx: r.value for r in line_index.lines(index, start, end).collect()}
        assert got == {k: want[k] for k in range(start, min(end, len(want)))}
    index.unpersist()


def test_only_touched_blocks_are_read(spark, tmp_path):
    """Bytes outside the range's blocks are overwritten after the index was built: the range doesn't notice."""
    whole = "".join(f'{{"doc": "d{k:04}"}}\n' for k in range(1000)).encode()
    file = tmp_path / "log.jsonl"
    file.write_bytes(whole)
    index = line_index.build(spark, str(file), 1000).persist()
    low, high = (line_index.touched(index, 500, 510).agg(F.min("begin"), F.max("end"))).first()
    assert high - low <= 2000 and line_index.touched(index, 500, 510).count() <= 2
    file.write_bytes(b"#" * (low - 1) + whole[low - 1 : high + 100] + b"#" * (len(whole) - high - 100))
    got = line_index.records(index, 500, 510, "doc string").collect()
    assert sorted((r.idx, r.doc) for r in got) == [(k, f"d{k:04}") for k in range(500, 510)]


def test_no_lines(spark, tmp_path):
    (tmp_path / "empty.log").write_bytes(b"")
    index = line_index.build(spark, str(tmp_path))
    assert line_index.total(index) == 0 and line_index.lines(index, 0, 5).count() == 0


ENTRY = "file_path string, url string, title string, court string, year string, date string"


def entry(k, court, year):
    return (f"/{court}/{k:05}.html", f"u{k}", f'a "quoted" {{"file_path": ]}} title, {k}\n', court, year, None)


def test_index_files(spark, tmp_path):
    """Most entries stand in one court and one year, which many tasks write; ties, blank years, null fields and a court of one entry."""
    rows = [entry(k, "high", "2020") for k in range(3000)] + [entry(7, "high", "2020")] * 5
    rows += [entry(k, "high", str(1990 + k % 30)) for k in range(300)] + [entry(1, "low", ""), entry(2, "low", None), entry(3, "low", "2001"), entry(9, "one", "1999"), entry(4, None, "2002")]
    entries = spark.createDataFrame(rows, ENTRY)
    assert index_writer.pieces(entries, "now").select(F.spark_partition_id()).distinct().count() > 1
    for again in range(2):  # the second replaces the first
        index_writer.write(entries, str(tmp_path / "out"), f"at {again}")
    got = {p.stem: json.loads(p.read_text()) for p in (tmp_path / "out").glob("*.json")}
    assert sorted(got) == ["high", "low", "one", "unknown"] and not list((tmp_path / "out").glob("*.part"))
    want = {r.court or "unknown": r for r in sinks.by_year(entries).collect()}
    for court, index in got.items():
        assert (index["court"], index["scraped_at"], index["total"]) == (court, "at 1", want[court].total)
        assert list(index["by_year"]) == sorted(index["by_year"], reverse=True)
        assert index["by_year"] == {y: [e.asDict() for e in es] for y, es in want[court].by_year.items()}
    back = index_writer.read(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.drop("file").collect())) == sorted(map(str, entries.collect()))


def test_no_entries(spark, tmp_path):
    index_writer.write(spark.createDataFrame([], ENTRY), str(tmp_path / "out"), "now")
    assert not list(tmp_path.glob("out/*"))

"""Files that mirror document paths, done sets of several sources, and excerpts."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.sources import files, markdown_tree, sinks

LONG = "Κείμενο *απόφασης* [x](/a/b.md) με λέξεις"
ROWS = [("a/2020/1.md", LONG), ("a/2020/2", "second text here"), ("b/3.md", "short"), ("b/4.md", None), ("../out.md", LONG), ("/abs.md", LONG), (None, LONG), ("c/5.md", "same text, b"), ("c/5", "same text, a"), ("d/ö x.md", "with a space in its name")]


def test_tree(spark, tmp_path):
    root = str(tmp_path / "md")
    docs = spark.createDataFrame(ROWS, "doc_id string, text string").withColumn("file", F.lit("clash"))
    got = {r.file: r for r in markdown_tree.write(docs, root).collect()}
    status = {k: (r.status, r.error) for k, r in got.items()}
    assert status == {
        "a/2020/1.md": ("written", None), "a/2020/2.md": ("written", None), "b/3.md": ("fail", "empty or too short"), "b/4.md": ("fail", "empty or too short"), "../out.md": ("fail", "path leads out of the root"),
        "/abs.md": ("fail", "path leads out of the root"), None: ("fail", "no id"), "c/5.md": ("written", None), "d/ö x.md": ("written", None),
    }
    assert (got["a/2020/1.md"].n_chars, got["a/2020/1.md"].n_refs) == (len(LONG), 1)
    read = {r.doc_id: r.text for r in files.markdown_corpus(spark, root).collect()}
    assert read == {"a/2020/1.md": LONG, "a/2020/2.md": "second text here", "c/5.md": "same text, a", "d/ö x.md": "with a space in its name"}
    assert not (tmp_path / "out.md").exists() and not [f for _, _, names in os.walk(root) for f in names if not f.endswith((".md", ".crc"))]


def test_tree_goes_on(spark, tmp_path):
    """Files with text stay, empty ones are written again, and a second run writes nothing."""
    root = tmp_path / "md"
    (root / "a").mkdir(parents=True)
    (root / "a" / "1.md").write_text("older text")
    (root / "a" / "2.md").write_text("")
    docs = spark.createDataFrame([(f"a/{i}.md", f"text of document {i}") for i in range(1, 5)], "doc_id string, text string")
    run = lambda **o: {r.doc_id: r.status for r in markdown_tree.write(docs, str(root), **o).collect()}
    assert run() == {"a/1.md": "skip", "a/2.md": "written", "a/3.md": "written", "a/4.md": "written"}
    assert (root / "a" / "1.md").read_text() == "older text" and (root / "a" / "2.md").read_text() == "text of document 2"
    assert set(run().values()) == {"skip"}
    assert set(run(overwrite=True).values()) == {"written"} and (root / "a" / "1.md").read_text() == "text of document 1"
    assert markdown_tree.write(docs.limit(0), str(tmp_path / "none")).count() == 0


def test_tree_file_in_the_way(spark, tmp_path):
    """A file where a folder must stand fails its documents and no others."""
    root = tmp_path / "md"
    root.mkdir()
    (root / "a").write_text("in the way")
    docs = spark.createDataFrame([("a/1.md", "text of document 1"), ("b/2.md", "text of document 2")], "doc_id string, text string")
    assert {r.doc_id: r.status for r in markdown_tree.write(docs, str(root)).collect()} == {"a/1.md": "fail", "b/2.md": "written"}


def test_done_set(spark):
    frame = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "doc_id string, more string")
    assert sorted(r.doc_id for r in sinks.done_set(frame("a", "b", "a"), frame("b", "c"), frame(), keys=["doc_id"]).collect()) == ["a", "b", "c"]
    assert [r.doc_id for r in sinks.resume(frame("a", "d"), sinks.done_set(frame("a"), keys=["doc_id"]), ["doc_id"]).collect()] == ["d"]
    with pytest.raises(ValueError):
        sinks.done_set(keys=["doc_id"])


def test_excerpts(spark):
    rows = spark.createDataFrame([("RULED", "ω" * 301), ("DISCUSSED", "ω" * 300), ("NOT_ADDRESSED", "ω"), ("RULED", ""), ("RULED", None), (None, "ω")], "engagement string, analysis string")
    got = [r[0] for r in rows.select(X.findings_preview(F.col("engagement"), F.col("analysis"))).collect()]
    assert got == ["ω" * 300 + "...", "ω" * 300, "", "", "", "ω"]
    assert rows.select(X.excerpt(F.col("analysis"), 5, "…")).first()[0] == "ω" * 5 + "…"

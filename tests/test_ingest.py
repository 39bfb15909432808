"""Builds end to end on small trees, and model functions."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.__main__ import main
from corpusloom.operators import models
from corpusloom.plans import ingest
from corpusloom.sources import fetch

BASE = "https://e.org"
SITE = {
    "/supreme/": "<a href='index_2023.html'>2023</a><a href='/supreme/index_2024.html'>2024</a>",
    "/supreme/index_2023.html": "<a href='/cgi-bin/open.pl?file=/supreme/2023/1.html'>Α</a>",
    "/supreme/index_2024.html": "<a href='/cgi-bin/open.pl?file=/supreme/2024/2.html'>Β</a><a href='/cgi-bin/open.pl?file=/supreme/2023/1.html'>Α</a>",
    "/rscc/index_1.html": "<a href='/cgi-bin/open.pl?file=/rscc/files/1961_1.html'>Γ</a>",
}


def fetcher():
    site = dict(SITE)

    def get(url):
        page = site.get(url.removeprefix(BASE))
        return (200, page.encode(), "utf-8") if page is not None else (404, b"", None)

    return fetch.Fetcher(get, pause=0)


def test_crawl(spark):
    got = {(r.file_path, r.court) for r in ingest.crawl(spark, "supreme", BASE, make=fetcher, partitions=2).collect()}
    assert got == {("/supreme/2023/1.html", "supreme"), ("/supreme/2024/2.html", "supreme")}
    volumes = ingest.crawl(spark, "rscc", BASE, make=fetcher, partitions=2).collect()  # no main page: all volumes are tried
    assert [(r.file_path, r.year) for r in volumes] == [("/rscc/files/1961_1.html", "1")]
    with pytest.raises(ValueError):
        ingest.crawl(spark, "x", BASE)


def test_crawl_command(spark, tmp_path, capsys):
    main(["crawl", "supreme", BASE, str(tmp_path / "index")], make=fetcher, partitions=2)
    assert "supreme 2" in capsys.readouterr().out
    (found,) = (json.loads(p.read_text()) for p in (tmp_path / "index").rglob("supreme.json"))
    assert found["total_cases" if "total_cases" in found else "total"] == 2


def test_parse_build_search(spark, tmp_path, capsys):
    raw = tmp_path / "raw" / "supreme" / "2023"
    raw.mkdir(parents=True)
    for i in range(3):
        (raw / f"{i}.html").write_text(f"<title>Υπόθεση {i}</title><p>{'αμέλεια ' * 30} θέμα{i}</p><a href='/cgi-bin/open.pl?file=/supreme/2023/0.html'>Α</a>", encoding="utf-8")
    status = ingest.parse(spark, str(tmp_path / "raw"), str(tmp_path / "md"))
    assert status.count() in (0, 3)
    parsed = spark.read.parquet(str(tmp_path / "md"))
    assert {r.doc_id for r in parsed.collect()} == {f"supreme/2023/{i}.md" for i in range(3)}
    (raw / "3.html").write_text("<p>" + "νέο κείμενο " * 20, encoding="utf-8")
    ingest.parse(spark, str(tmp_path / "raw"), str(tmp_path / "md"))
    parsed = spark.read.parquet(str(tmp_path / "md"))
    assert parsed.count() == 4
    paths = ingest.build(spark, parsed.select("doc_id", "text"), str(tmp_path / "t"))
    assert spark.read.parquet(paths["documents"]).count() == 4
    assert spark.read.parquet(paths["postings"]).where("term = 'αμέλεια'").select(F.sum(F.aggregate("tf", F.lit(0), lambda s, x: s + x))).first()[0] == 90
    main(["search", str(tmp_path / "t"), "αμέλεια θέμα2"])
    assert "supreme/2023/2.md" in capsys.readouterr().out
    main(["search", str(tmp_path / "t"), "--rounds", "2", "αμέλεια θέμα2"])
    assert "summaries" in capsys.readouterr().out
    main(["tree", str(tmp_path / "md"), str(tmp_path / "files")])
    assert (tmp_path / "files" / "supreme" / "2023" / "3.md").read_text().startswith("νέο κείμενο")
    main(["tree", str(tmp_path / "md"), str(tmp_path / "files"), "--court", "supreme"])
    assert "skip" in capsys.readouterr().out
    main(["stats", str(tmp_path / "t")])
    assert "supreme" in capsys.readouterr().out
    more = parsed.select("doc_id", "text").unionByName(spark.createDataFrame([("supreme/2024/9.md", "# Νέα\n" + "μοναδικό κείμενο " * 20)], "doc_id string, text string"))
    assert ingest.extend(spark, more, str(tmp_path / "t")) == 1 and ingest.extend(spark, more, str(tmp_path / "t")) == 0
    main(["search", str(tmp_path / "t"), "μοναδικό"])
    assert "supreme/2024/9.md" in capsys.readouterr().out


def test_models(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "k int, text string")
    got = {r.k: r.embedding for r in models.embedded(rows, models.hashed_provider, batch=1).collect()}
    assert got[1] == got[3] and got[2] is None and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5)
    docs = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "batch int, place int, doc_id string")
    answers = spark.createDataFrame([(1, 'Here: [{"idx": 0, "score": 7}, {"idx": 9, "score": 1}, {"idx": 2}] done')], "batch int, answer string")
    assert {r.doc_id: r.score for r in models.scored_batches(docs, answers, "batch", "place", "doc_id").collect()} == {"a": 7.0, "b": 0.0, "c": 0.0}
    none = spark.createDataFrame([("no list",), (None,)], "v string").select(F.size(models.listed_scores(F.col("v"), F.lit(5))).alias("n")).collect()
    assert [r.n for r in none] == [0, 0]

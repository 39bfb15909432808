"""Operators on small fixtures: edge cases that the driver's tables don't hold."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunker, fulltext, fusion, html_markdown, rerank, stats, vector
from corpusloom.plans import hybrid
from corpusloom.session import work_path
from corpusloom.sources import fetch, files, sinks
from corpusloom.streaming import events as E


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


# ---- chunker


def test_split_bounds_and_cover():
    words = [f"λέξη{i}." for i in range(3000)]
    text = "".join(w + ("\n\n" if i % 97 == 0 else "\n" if i % 31 == 0 else " ") for i, w in enumerate(words))
    chunks = chunker.split(text)
    assert all(0 < len(c) <= chunker.SIZE for c in chunks)
    seen, at = set(), -1
    for c in chunks:
        got = [int(w.strip("λέξη.")) for w in c.split()]
        assert got == list(range(got[0], got[-1] + 1)) and got[0] <= at + 1
        at = got[-1]
        seen.update(got)
    assert len(seen) == len(words)
    assert chunker.split("x" * 5000) == ["x" * 5000]
    assert chunker.split("  ") == []


def test_tail_merge():
    assert chunker.merge_tail(["a" * 600, "b" * 10]) == ["a" * 600 + "\n\n" + "b" * 10]
    assert chunker.merge_tail(["b"]) == ["b"]


def test_chunk_documents(spark):
    body = "# Τίτλος\nΚΕΙΜΕΝΟ ΑΠΟΦΑΣΗΣ:\nΠΟΛΙΤΙΚΗ ΔΙΚΑΙΟΔΟΣΙΑ\n" + "[[α](x)](y) " + "λόγος " * 900
    docs = frame(spark, "doc_id string, text string", ("supreme/2020/a.md", body), ("b.md", "short"), ("c.md", None), ("d.md", "x" * 50))
    got = chunker.chunk_documents(docs).orderBy("doc_id", "chunk_index").collect()
    own = [r for r in got if r.doc_id.startswith("supreme")]
    assert {r.doc_id for r in got} == {"supreme/2020/a.md", "d.md"}
    assert [r.chunk_index for r in own] == list(range(len(own))) and len(own) >= 2
    head = "Δικαστήριο: Ανώτατο Δικαστήριο (νέο) | ΠΟΛΙΤΙΚΗ ΔΙΚΑΙΟΔΟΣΙΑ | Έτος: 2020 | Τίτλος\n\n"
    assert all(r.text.startswith(head) and "[" not in r.text for r in own)
    assert len(own[-1].text) - len(head) >= chunker.TAIL
    assert chunker.document_records(docs).count() == 2


# ---- HTML

PAGE = """Content-type: text/html

<html><head><title>Τ &amp; Υ</title><style>x{}</style></head><body>
<!--sections_start-->meta<!--sections_end--><h2>Κεφάλαιο</h2><p>Α <b>β</b> <i>γ</i><br>δ</p>
<ul><li>ένα<li>δύο</ul><ol><li>α</li><li></li><li>β</li></ol>
<table><tr><th>x|y</th><td> z </td></tr><tr><td>1</td></tr></table><blockquote>p
q</blockquote><p><a href="#x">κ</a> <a href="/cgi-bin/open.pl?file=/aad/1.htm">λ</a> <a href="http://e.org">μ</a> <a href="rel">ν</a></p>
<div>κείμενο<br>ΥΠΟΣΕΛΙΔΟ</div></body></html>"""


def test_html_to_markdown(spark):
    pages = frame(spark, "page_id int, html string", (1, PAGE), (2, None), (3, ""), (4, "<p>ελάχιστο κείμενο</p>"))
    rows = {r.page_id: r.parsed for r in html_markdown.to_markdown(pages, markers=["ΥΠΟΣΕΛΙΔΟ"]).collect()}
    md = rows[1].markdown
    assert md.startswith("# Τ & Υ\n\n## Κεφάλαιο\n\nΑ **β** *γ*  \nδ".replace("  \n", "\n"))
    for part in ("1. α\n3. β", "| x\\|y | z |\n| --- | --- |\n| 1 |  |", "> p\n> q", "κ [λ](/aad/1.md) [μ](http://e.org) ν", "κείμενο"):
        assert part in md
    assert "meta" not in md and "ΥΠΟΣΕΛΙΔΟ" not in md and rows[1].refs == 1
    assert rows[2].status == rows[3].status == "skip" and rows[4].status == "ok"
    old = html_markdown.to_markdown(pages, markers=["ΥΠΟΣΕΛΙΔΟ"], compat=True).where("page_id = 1").first().parsed.markdown
    assert "κείμενο" not in old and "γ*δ" in old


def test_links(spark):
    html = "<a href='index_2020.html'>x</a><a href=\"index_2020.html\">y</a><a href='/cgi-bin/open.pl?file=/supreme/2020/1.html&amp;a=1'> <b>Τ</b> </a><a href='open.pl?x'>z</a>"
    pages = frame(spark, "page_id int, html string", (1, html), (2, ""), (3, None))
    years = html_markdown.year_index_links(pages, "page_id").collect()
    assert [(r.href, r.year) for r in years] == [("index_2020.html", "2020")]
    entries = html_markdown.case_entries(pages, "page_id", "https://e.org").collect()
    assert [(r.file_path, r.title, r.court, r.year) for r in entries] == [("/supreme/2020/1.html", "Τ", "supreme", "2020")]
    assert entries[0].url == "https://e.org/cgi-bin/open.pl?file=/supreme/2020/1.html&a=1"


# ---- search


def test_vectors(spark):
    chunks = frame(spark, "chunk_id int, doc_id int, embedding array<float>", (1, 1, [1.0, 0.0]), (2, 1, [0.0, 2.0]), (3, 2, [1.0, 0.0]), (4, 3, None), (5, 3, [1.0]))
    queries = frame(spark, "query_id int, query_vector array<float>", (1, [3.0, 0.0]), (2, None))
    got = vector.top_k_batch(chunks, queries, 2, "chunk_id").orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in got] == [(1, 1, 1.0), (1, 3, 1.0)]
    assert vector.top_k_batch(chunks, queries.where("query_id = 2"), 2, "chunk_id").count() == 0
    scored = frame(spark, "query_id int, doc_id int, chunk_id int, score double", (1, 1, 1, 0.9), (1, 1, 2, 0.9), (1, 2, 3, 0.5))
    best = vector.best_of_document(scored, "doc_id", "chunk_id").orderBy("doc_id").collect()
    assert [(r.chunk_id, r.chunk_count) for r in best] == [(1, 2), (3, 1)]
    assert [len(r.members) for r in vector.members_of_document(scored, "doc_id", "chunk_id").orderBy("doc_id").collect()] == [2, 1]
    cut = vector.members_of_document(scored, "doc_id", "chunk_id", most=1).orderBy("doc_id").collect()
    assert [([m.chunk_id for m in r.members], r.chunk_count, r.members_cut) for r in cut] == [([1], 2, True), ([3], 1, False)]
    assert [r.doc_id for r in vector.adaptive_threshold(scored).select("doc_id").distinct().collect()] == [1]


def test_cells_query_finds_all(spark, sf):
    """The registered index query against exact search, over the whole table."""
    from corpusloom.plans import catalog_retrieval as R

    near = {(r.query_id, r.vec_id): r.score for r in R.vec_ivf_topk(spark, sf).collect()}
    exact = {(r.query_id, r.vec_id): r.score for r in vector.top_k_batch(R.table(spark, sf, "embeddings"), R.vectors_asked(spark, sf), 10, "vec_id").collect()}
    assert len(near) == len(exact) and len(near.keys() & exact.keys()) >= 0.99 * len(exact)


def test_fulltext(spark):
    docs = fulltext.documents_with_terms(frame(spark, "doc_id int, text string", (1, "Νόμος 216(Ι)/2012 και άρθρο"), (2, "άρθρο νόμος"), (3, None), (4, "")))
    queries = frame(spark, "query_id int, text string", (1, "νόμος 216(Ι)/2012"), (2, "και το"), (3, ")( x"), (4, ""))
    assert [r.terms for r in docs.orderBy("doc_id").collect()][0] == ["νόμος", "216", "ι", "2012", "άρθρο"]
    found = {(r.query_id, r.doc_id) for r in fulltext.tf_rank(docs, queries).collect()}
    assert found == {(1, 1), (1, 2)}
    assert {(r.query_id, r.doc_id) for r in fulltext.phrase_match(docs, queries).collect()} == {(1, 1)}
    assert fulltext.bm25_rank(docs, queries).where("rank = 1").first().doc_id == 1
    gates = queries.select(fulltext.phrase_gate(F.col("text")).alias("g")).collect()
    assert all(r.g for r in gates)


def test_phrase_wins_but_order_is_by_score(spark):
    phrase = frame(spark, "query_id int, doc_id int, score double", (1, 1, 0.5))
    either = frame(spark, "query_id int, doc_id int, score double", (1, 1, 0.7), (1, 2, 0.6))
    got = fulltext.phrase_or_merge(phrase, either).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(2, 0.6), (1, 0.5)]


def test_fusion(spark):
    v = frame(spark, "query_id int, doc_id int, score double, rank int", (1, 1, 0.9, 1), (1, 2, 0.8, 2), (2, 7, 0.9, 1))
    t = frame(spark, "query_id int, doc_id int, score double, rank int", (1, 2, 5.0, 1), (1, 3, 4.0, 2))
    fused = fusion.rrf(v, t)
    got = fused.where("query_id = 1").orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 1, 3]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61) and got[1].bm25_rank is None
    kinds = {r.query_id: r.score_kind for r in fusion.with_bypass(fused, v, t).collect()}
    assert kinds == {1: "rrf", 2: "cosine"}
    row = fusion.overlap(fused).where("query_id = 1").first()
    assert (row.both, row.vector_only, row.text_only) == (1, 1, 1)
    years = frame(spark, "d int, year string", (1, "2010"), (2, ""), (3, "2021"), (4, None))
    assert [r.d for r in fusion.year_between(years, "year", 2015, 0).collect()] == [3]
    assert [r.d for r in fusion.year_between(years, "year", 2015, None, keep_unparsable=True).orderBy("d").collect()] == [2, 3, 4]
    assert fusion.level_filter(years.withColumn("level", F.lit("other")), "level", "nonsense").count() == 4
    seen = frame(spark, "s int, step int, pos int, doc_id string", (1, 1, 1, "a"), (1, 2, 1, "a"), (1, 2, 2, ""), (2, 1, 1, "a"))
    assert fusion.first_seen(seen, "s", "step", "pos", "doc_id").count() == 2


@pytest.mark.parametrize(("n", "strong", "kept"), [(3, 0, 3), (4, 0, 4), (29, 29, 29), (31, 0, 30), (31, 31, 31), (76, 76, 75), (181, 40, 40)])
def test_cutoff(spark, n, strong, kept):
    found = spark.range(n).selectExpr("1 as query_id", "id as doc_id", "1.0 - id / 1000 as score", "cast(null as int) as bm25_rank")
    scores = spark.range(n).selectExpr("1 as query_id", "id as doc_id", f"if(id < {strong}, 5.0D, 1.5D) as score")
    assert rerank.rerank(found, scores).count() == kept


def test_rerank_rules(spark):
    found = frame(spark, "query_id int, doc_id int, score double, bm25_rank int", *[(1, i, 1.0 - i / 10, r) for i, r in enumerate([None, 50, 51, 1, None, None])])
    scores = frame(spark, "query_id int, doc_id int, score double", (1, 0, 0.1), (1, 1, 0.0), (1, 2, 0.0), (1, 3, 0.0), (1, 4, 0.05))
    got = {r.doc_id: r.effective for r in rerank.rerank(found, scores).collect()}
    assert got == {0: pytest.approx(0.1), 1: 0.0, 3: pytest.approx(1.96)}
    rescue = frame(spark, "query_id int, doc_id int, score double", (1, 4, 6.0), (1, 0, 0.0))
    assert rerank.rerank(found, scores, rescue).orderBy("place").first().doc_id == 4
    nothing = rerank.rerank(found.withColumn("bm25_rank", F.lit(None).cast("int")), scores.limit(0))
    assert sorted(r.doc_id for r in nothing.collect()) == [0, 1, 2, 3, 4] and nothing.first().fallback
    assert rerank.rerank(found.limit(3), scores.limit(0)).count() == 3
    assert [r.x for r in frame(spark, "v double", (0.345,), (0.3449,)).select(rerank.scaled(F.col("v")).alias("x")).collect()] == [3.5, 3.4]


def test_summaries(spark):
    good = {"caseHeader": {"parties": "p", "court": "c", "date": "d", "caseNumber": "n"}, "status": "s", "facts": "f", "coreIssue": "i", "findings": {"engagement": "MENTIONED", "analysis": "a", "quote": ""}, "outcome": "o", "relevance": {"rating": "HIGH", "reasoning": "r"}}
    rows = frame(spark, "v string", (json.dumps(good),), ("not json",), (None,)).select(rerank.parsed_summary(F.col("v")).alias("s")).collect()
    assert [r.s.relevance.rating for r in rows] == ["MEDIUM", "NONE", "NONE"]
    sources = frame(spark, "query_id int, doc_id int, year string", (1, 1, "2010"), (1, 2, "x"), (1, 3, "2020"))
    some = frame(spark, "query_id int, doc_id int, rating string", (1, 1, "HIGH"), (1, 2, "HIGH"))
    assert rerank.display(sources, some).count() == 0
    assert [r.doc_id for r in rerank.display(sources, some, gate=False).orderBy("place").collect()] == [1, 2]
    done = some.union(frame(spark, "query_id int, doc_id int, rating string", (1, 3, "MEDIUM")))
    assert [r.doc_id for r in rerank.display(sources, done).orderBy("place").collect()] == [1, 2, 3]


def test_hybrid(spark, sf):
    from corpusloom.plans import catalog_retrieval as R
    from corpusloom.session import table

    docs = table(spark, sf, "documents").withColumn("court_level", F.lit("other"))
    q, c = R.asked(spark, sf), R.chunks(spark, sf)
    free, strict = hybrid.hybrid_search(q, docs, c, level="supreme"), hybrid.hybrid_search(q, docs, c, level="supreme", strict_filters=True)
    assert free.where("score_kind = 'rrf'").count() > 0
    assert strict.where("score_kind = 'cosine'").count() == strict.count()


# ---- statistics


def test_stats(spark):
    found = frame(spark, "g int, o int, title string, court string, year int, ctx string", *[(1, i, f"t{i}", "c", 2000, "x" if i < 2 else f"y{i}") for i in range(7)])
    assert stats.source_line(found, "g", "title", "court", "year", "o").first().sources == "; ".join(f"t{i} (c, 2000)" for i in range(5)) + "..."
    assert stats.context_line(found, "g", "ctx", "o").first().legal_context == "x; y2; y3; y4; y5; y6"
    docs = frame(spark, "doc_id string, text string", ("apofaseis/aad/1.md", "[a](/aad/2.md) [b](/aad/2.md)"), ("apofaseis/aad/2.md", "[z](/zzz.md)"))
    edges = {(r.src, r.dst, r.dst_known) for r in stats.citation_edges(docs).collect()}
    assert edges == {("apofaseis/aad/1.md", "apofaseis/aad/2.md", True), ("apofaseis/aad/2.md", "zzz.md", False)}


# ---- sources and sinks


def test_corpus(spark, tmp_path):
    (tmp_path / "aad" / "2010").mkdir(parents=True)
    (tmp_path / "aad" / "2010" / "a b.md").write_text("# Τ\nκείμενο", encoding="utf-8")
    (tmp_path / "b.md").write_text("x")
    got = files.markdown_corpus(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == ["aad/2010/a b.md", "b.md"] and got[0].text == "# Τ\nκείμενο"
    assert files.markdown_corpus(spark, str(tmp_path), limit=1).count() == 1
    assert files.find_document(files.markdown_corpus(spark, str(tmp_path)), "b").count() == 1
    assert files.find_document(files.markdown_corpus(spark, str(tmp_path)), "../b").count() == 0


def test_encodings(spark, tmp_path):
    text = "<p>" + "Άρθρο νόμου " * 20 + "</p>"
    for name, enc in (("a.htm", "utf-8"), ("b", "iso-8859-7"), ("c.HTML", "windows-1253"), ("d.txt", "utf-8")):
        (tmp_path / name).write_bytes(text.encode(enc))
    (tmp_path / "small.html").write_bytes(b"x")
    raw = files.raw_files(spark, str(tmp_path))
    rows = {r.path: r.html for r in files.decoded_html(raw).collect()}
    assert set(rows) == {"a.htm", "b", "c.HTML"} and all("ρθρο νόμου" in t for t in rows.values())
    (tmp_path / "x_y.pdf").write_bytes(b"%PDF" + b" " * 200)
    pdf = files.pdf_text(files.raw_files(spark, str(tmp_path))).first()
    assert pdf.title == "x y" and pdf.text is None and pdf.error


def test_pipe_index(spark, tmp_path):
    lines = ["# header", "", "/aad/meros_1/2010/a.htm|Τίτλος|x|1/2/2010", "/apofaseis/aad/meros_1/2010/a.htm|again", "single", "|no path", "/aad/b.htm|Β"]
    (tmp_path / "i.csv").write_bytes("\r\n".join(lines).encode("iso-8859-7"))
    got = files.pipe_index(spark, str(tmp_path / "i.csv"), "https://e.org").orderBy("file_path").collect()
    assert [(r.file_path, r.title, r.year, r.date) for r in got] == [("/apofaseis/aad/b.htm", "Β", "", ""), ("/apofaseis/aad/meros_1/2010/a.htm", "Τίτλος", "2010", "1/2/2010")]


def test_index_round_trip(spark, tmp_path):
    entries = frame(spark, "url string, file_path string, title string, court string, year string, date string", ("u", "/a", "A", "aad", "2010", ""), ("u", "/b", "B", "aad", "", ""), ("u", "/c", "C", "aad", "2020", ""))
    row = sinks.by_year(entries).select("total", F.map_keys("by_year").alias("years")).first()
    assert row.years == ["unknown", "2020", "2010"] and row.total == 3
    sinks.write_index(entries, str(tmp_path / "o"), "2026-01-01")
    back = files.index_entries(spark, str(tmp_path / "o"))
    assert back.count() == 3 and files.distinct_paths(back.union(back)).count() == 3


def test_logs_and_results(spark, tmp_path):
    (tmp_path / "log").write_text(" a \n\nb\na\n")
    assert files.paths_log(spark, str(tmp_path / "log")).count() == 2
    ok = {"custom_id": "b0-r0-s200", "response": {"status_code": 200, "body": {"data": [{"index": 0, "embedding": [1.0, 2.0, 3.0]}, {"index": 1, "embedding": [0.0, 0.0, 0.0]}]}}}
    bad = {"custom_id": "b0-r1-s300", "response": {"status_code": 500}}
    (tmp_path / "r.jsonl").write_text("\n".join([json.dumps(ok), "", "{broken", json.dumps(bad)]))
    got = files.embedding_results(spark, str(tmp_path / "r.jsonl"), 201)
    assert [r.idx for r in got.collect()] == [200]
    meta = frame(spark, files.META_SCHEMA, (200, "d", "c", "2010", "t", 0, "other", "", "", "x"))
    assert files.with_embeddings(meta, got, 2).first().embedding == [1.0, 2.0]
    record = sinks.vector_records(files.with_embeddings(meta, got, 2)).first()
    assert record.id == "d::0" and record.metadata.court == "c"


def test_event_lines(spark):
    log = [": comment", "event: a", 'data: {"x":1}', "", "data: lost", "event: b", "data: p\\nq"]
    lines = frame(spark, "session int, pos int, value string", *[(1, i, v) for i, v in enumerate(log)])
    assert [(r.seq, r.event, r.data) for r in files.event_lines(lines).orderBy("seq").collect()] == [(1, "a", '{"x":1}'), (2, "b", "p\nq")]


def test_keyed_writes(spark):
    old = frame(spark, "k int, v int, t int", (1, 1, 1), (2, 2, 5))
    new = frame(spark, "k int, v int, t int", (2, 9, 5), (3, 3, 1), (3, 4, 1))
    inserted = sinks.insert_if_absent(old, new, ["k"])
    assert [r.k for r in inserted.collect()] == [3]
    assert tuple(sinks.insert_counts(new, inserted).first()) == (1, 2)
    assert {(r.k, r.v) for r in sinks.upsert(old, new.where("v <> 4"), ["k"], "t").collect()} == {(1, 1), (2, 9), (3, 3)}
    assert [r.k for r in sinks.resume(old, new, ["k"]).collect()] == [1]


def test_packing_and_tables(spark, tmp_path):
    chunks = spark.range(250).selectExpr("id as idx", "concat('t', id) as text")
    got = sinks.request_packing(chunks, "m", 8, per_batch=200).orderBy("batch", "custom_id").collect()
    assert [(r.custom_id, r.inputs) for r in got] == [("b0-r0-s0", 100), ("b0-r100-s100", 100), ("b1-r0-s200", 50)]
    assert json.loads(got[2].request)["body"]["input"][0] == "t200"
    numbered = sinks.numbered(spark.range(1000).selectExpr("999 - id as k"), ["k"])
    assert numbered.where("k <> idx").count() == 0
    docs = frame(spark, "doc_id string, text string", ("supreme/2010/a.md", "# Τ\n" + "λόγος\t " * 20), ("b.md", "short"))
    table = sinks.documents_table(docs)
    sinks.refresh(table, str(tmp_path / "t"), ["court_level"], ["year"])
    row = spark.read.parquet(str(tmp_path / "t")).first()
    assert (row.court_level, row.year, row.title) == ("supreme", 2010, "Τ") and "\t" not in row.content
    sinks.postings_table(docs.select("doc_id", "text"), "postings_test", 4)
    sinks.analyze_table(spark, "postings_test")
    assert spark.table("postings_test").count() > 0
    assert [r.name for r in sinks.missing_indexes(spark, ["a", "b"], ["b"]).collect()] == ["a"]
    assert frame(spark, "v array<float>", ([1.0, 0.5],)).select(sinks.vector_literal(F.col("v")).alias("x")).first().x == "[1.00000000,0.50000000]"


def test_state(spark, tmp_path):
    path = str(tmp_path / "state")
    assert sinks.load_state(spark, path)["phase"] == "init"
    sinks.save_state(spark, path, {"phase": "prepared"})
    assert sinks.load_state(spark, path)["phase"] == "prepared"
    with pytest.raises(ValueError, match="can't go"):
        sinks.save_state(spark, path, {"phase": "done"})


def test_fetcher(spark, tmp_path):
    calls, pauses = [], []
    answers = [(500, b"", None), (200, "Άρθρο".encode("iso-8859-7"), "ISO-8859-1")]
    f = fetch.Fetcher(lambda u: (calls.append(u), answers[len(calls) - 1])[1], sleep=pauses.append, clock=lambda: 0.0)
    assert f.fetch("u") == "Άρθρο" and len(calls) == 2 and pauses == [1.0, 0.75]
    with pytest.raises(OSError, match="status 503"):
        fetch.Fetcher(lambda u: (503, b"", None), sleep=lambda s: None, pause=0).fetch("u")
    with pytest.raises(OSError, match="status 404"):
        fetch.Fetcher(lambda u: (404, b"", None), sleep=lambda s: None, pause=0).fetch("u")

    def make():
        return fetch.Fetcher(lambda u: (200, u.encode(), "utf-8") if "good" in u else (404, b"", None), pause=0)

    urls = frame(spark, "url string", ("good",), ("bad",), ("held",))
    cached = frame(spark, "url string, html string", ("held", "<p>"))
    got = {r.url: (r.status, r.html) for r in fetch.with_cache(urls, cached, make=make, partitions=2).collect()}
    assert got == {"good": ("ok", "good"), "bad": ("fail", None), "held": ("ok", "<p>")}
    import hashlib

    (tmp_path / (hashlib.md5(b"u").hexdigest() + ".html")).write_bytes(b"ok \xff")
    assert files.cached_pages(spark, str(tmp_path), frame(spark, "url string", ("u",), ("v",))).orderBy("url").first().html == "ok �"


# ---- streams


def stream_of(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_stream_windows(spark, sf):
    got = E.run_once(E.windows(E.read_stream(spark, sf, "events.parquet"), "1 hour", "30 minutes"), "slide_test", "complete", work_path(spark, "slide"))
    assert got.agg(F.sum("n")).first()[0] == 2 * spark.read.parquet(f"{sf}/events.parquet").count()

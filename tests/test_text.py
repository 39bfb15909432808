"""Text rules on inline fixtures (Greek markers, broken variants, noise)."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import dimensions as D
from corpusloom.functions import text as X

DECISION = "# ΥΠΟΘΕΣΗ *ΑΛΦΑ*\n**ΑΝΑΦΟΡΕΣ:**\n[α](/apofaseis/aad/1.md) [β](/x.md) [α](/apofaseis/aad/1.md)\n**ΚΕΙΜΕΝΟ ΑΠΟΦΑΣΗΣ:**\n\nΠΟΙΝΙΚΗ **ΔΙΚΑΙΟΔΟΣΙΑ**\nSubject: Contract law\nΝΟΜΙΚΗ ΠΤΥΧΗ: το σκεπτικό"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def on(spark, f, value):
    return one(spark, f(F.col("v")), v=value)


@pytest.mark.parametrize(
    ("path", "court", "level", "sub", "year"),
    [
        ("apofaseis/aad/meros_1/2010/a.md", "aad", "supreme", "", "2010"),
        ("apofaseised/oik/2024/a.md", "apofaseised", "first_instance", "oik", "2024"),
        ("supremeAdministrative/2023/a.md", "supremeAdministrative", "supreme", "", "2023"),
        ("administrativeIP/2020/a.md", "administrativeIP", "administrative", "", "2020"),
        ("administrativeCourtOfAppeal/2025/a.md", "administrativeCourtOfAppeal", "appeal", "", "2025"),
        ("rscc/files/1961_1_0001.md", "rscc", "supreme", "", "1961"),
        ("areiospagos/1999/a.md", "areiospagos", "foreign", "", "1999"),
        ("other/a.md", "other", "other", "", ""),
        ("", "unknown", "other", "", ""),
    ],
)
def test_path_metadata(spark, path, court, level, sub, year):
    v = F.col("v")
    row = spark.createDataFrame([(path,)], "v string").select(X.court(v).alias("c"), X.court_level(X.court(v)).alias("l"), X.subcourt(v, X.court(v)).alias("s"), X.year_text(v).alias("y")).first()
    assert tuple(row) == (court, level, sub, year)


def test_court_variants(spark):
    assert on(spark, X.court_crawler, "/apofaseis/epa/2004/x.html") == "epa"
    assert on(spark, X.court_crawler, "/zzz/") == "unknown"
    assert on(spark, X.court_extractor, "x/clr/1.html") == "clr"
    assert on(spark, X.court_summary, "apofaseis/aad/2010/x.md") == "aad"
    assert on(spark, X.court_summary, "supreme/2010/x.md") == "supreme"


def test_years(spark):
    assert on(spark, X.year_of_url, "index_pol_2005.html") == "2005"
    assert on(spark, X.year_of_url, "index_1.html") == "vol_1"
    assert on(spark, X.year_of_url, "x.html") == "unknown"
    assert on(spark, lambda c: X.year_int(c), "") == 0


def test_title(spark):
    assert on(spark, X.title, DECISION) == "ΥΠΟΘΕΣΗ ΑΛΦΑ"
    assert on(spark, X.title, "\n---\n  Α[β](γ)  δ‑ε -- ζ\n") == "Αβ δ-ε - ζ"
    assert on(spark, X.title, "") == ""
    assert on(spark, X.title_viewer, "## Τίτλος\nx") == "Τίτλος"


def test_jurisdiction(spark):
    both = X.jurisdiction(F.col("t"), F.col("p"))
    assert one(spark, both, t=DECISION, p="x") == "ΠΟΙΝΙΚΗ ΔΙΚΑΙΟΔΟΣΙΑ"
    far = "ΚΕΙΜΕΝΟ ΑΠΟΦΑΣΗΣ" + "\n" * 31 + "ΔΙΚΑΙΟΔΟΣΙΑ"
    assert one(spark, both, t=far, p="apofaseised/pol/1.md") == "ΠΟΛΙΤΙΚΗ ΔΙΚΑΙΟΔΟΣΙΑ"
    assert one(spark, both, t="x", p="x") == ""


def test_references(spark):
    cut = on(spark, X.strip_references, DECISION)
    assert cut.startswith("# ΥΠΟΘΕΣΗ *ΑΛΦΑ*\n\n") and "[α]" not in cut and "το σκεπτικό" in cut
    assert on(spark, X.strip_references, "α\nΑΝΑΦΟΡΕΣ\nβ") == "α"
    assert on(spark, lambda c: X.strip_references(c, compat=False), "α\nΑΝΑΦΟΡΕΣ\nβ") == "α\nΑΝΑΦΟΡΕΣ\nβ"
    assert on(spark, X.strip_references, "α ΚΕΙΜΕΝΟ ΑΠΟΦΑΣΗΣ: β") == "α  β"
    assert on(spark, X.strip_references, "α") == "α"
    assert on(spark, X.cross_refs, DECISION) == ["/apofaseis/aad/1.md", "/x.md"]
    assert on(spark, X.count_refs, DECISION) == 3


def test_noise(spark):
    text = "***[***[τ](u)***](v)***\x85 α\xa0β‑γ\xadδ\n---\n\n\n\nε  ζ "
    assert on(spark, X.clean_noise, text) == "τ α β-γδ\n\nε ζ"


def test_header(spark):
    got = one(spark, X.chunk_header(F.col("c"), F.col("j"), F.col("y"), F.col("t")), c="Εφετείο", j="", y="2010", t="Τ" * 130)
    assert got == "Δικαστήριο: Εφετείο | Έτος: 2010 | " + "Τ" * 120


def test_documents(spark):
    assert on(spark, X.subject, DECISION) == "Contract law"
    assert on(spark, X.body_for_embedding, DECISION) == "το σκεπτικό"
    assert on(spark, X.document_content, DECISION) == "ΥΠΟΘΕΣΗ ΑΛΦΑ\n\n[Subject: Contract law]\n\nτο σκεπτικό"
    long = on(spark, X.document_content, "# τ\n" + "λ" * 4000)
    assert len(long) == 3400 + len("\n[...truncated]") and long.endswith("\n[...truncated]")


def test_decision_and_preview(spark):
    assert on(spark, lambda c: X.decision_text(c, 1000), "Τ\nΚΕΙΜΕΝΟ ΑΠΟΦΑΣΗΣ: σώμα") == "Τ\n\nσώμα"
    cut = on(spark, lambda c: X.decision_text(c, 1000), "λ" * 1200)
    assert cut.startswith("λ" * 350 + "\n\n[... middle") and cut.endswith("λ" * 450)
    text = "α" * 600 + "ΝΟΜΙΚΗ ΠΤΥΧΗ: *" + "β" * 3000 + "γ" * 200
    got = on(spark, X.rerank_preview, text)
    assert got == "α" * 500 + "\n[...]\n" + "β" * 2000 + "\n[...middle omitted...]\n" + "β" * 1500


def test_ids(spark):
    short, long = one(spark, X.vector_id(F.col("d"), F.lit(3)), d="a/b.md"), one(spark, X.vector_id(F.col("d"), F.lit(3)), d="α" * 40)
    assert short == "a/b.md::3" and len(long) == 16 + 3
    assert on(spark, X.vector_id_prefix, "a::b::3") == "a::b"


def test_links(spark):
    assert on(spark, X.href_to_md, "/cgi-bin/open.pl?file=/a/b.HTM&x=1") == "/a/b.md"
    assert on(spark, X.href_to_md, "open.pl?file=/a/b") == "/a/b.md"
    assert on(spark, X.href_to_md, "x") is None
    assert on(spark, X.normal_path, "/aad/1") == "/apofaseis/aad/1"
    assert on(spark, X.link_target, "/doc?doc_id=a%2Fb.md") == "a/b.md"
    assert on(spark, X.link_target, "/a/b.md") == "a/b.md"
    assert on(spark, X.link_target, "http://x/a.md") is None


def test_small_rules(spark):
    assert on(spark, X.word_count, "a **b** [c](d.md) -") == 4
    assert on(spark, X.normalize_markdown, "\na  \n\n\n\nb\n") == "a\n\nb\n"
    assert on(spark, X.strip_server_artifact, "Content-type: x\n\nbody\nmore") == "body\nmore"
    assert on(spark, X.strip_metadata_sections, "a<!--sections_start-->x\ny<!--sections_end-->b<!--sino z--><!--noteup_start-->c") == "abc"
    assert on(spark, X.reset_seconds, "1m30s") == 90.0
    assert on(spark, lambda c: X.format_cost(c.cast("double")), "0.0123") == "$0.012"
    assert on(spark, lambda c: X.format_cost(c.cast("double")), "0.0005") == "$0.00050"
    assert on(spark, X.api_error, "HTTP 429").startswith("The AI service")
    assert on(spark, X.relevance_of_text, "x\nRelevance Rating: MEDIUM") == "MEDIUM"
    assert on(spark, X.engagement_of_text, "NOT ADDRESSED") == "NOT_ADDRESSED"
    assert on(spark, X.is_greek, "αβγ") and not on(spark, X.is_greek, "abc")
    assert on(spark, X.is_footer, "x Παγκύπριο Δικηγορικό Σύλλογο")
    assert not on(spark, X.safe_path, "../x") and not on(spark, X.safe_path, "/x") and on(spark, X.safe_path, "a/b.md")
    assert on(spark, X.copy_line, "a\tb\r\nc") == "a b\\nc"
    assert not on(spark, X.long_enough, " " * 60) and on(spark, X.long_enough, "x" * 50) and not on(spark, X.long_enough, None)


def test_focus(spark):
    asked = "Βρες μου αποφάσεις σχετικά με αμέλεια γιατρών μετά το 2015 στο Ανώτατο Δικαστήριο"
    assert on(spark, X.spoken_focus, asked) == "αμέλεια γιατρών"
    assert on(spark, X.spoken_focus, "μετά το 2015") == "μετά το 2015"


def test_registry(spark):
    assert D.court_registry(spark, "https://e.org").count() == 15
    urls = {r.year: r.url for r in D.year_index_urls(spark, "https://e.org").where("court_id = 'rscc'").collect()}
    assert urls[1] == "https://e.org/rscc/index_1.html" and len(urls) == 5
    with pytest.raises(ValueError, match="unknown court"):
        D.get_court(spark, "nope", "https://e.org")
    with pytest.raises(Exception, match="unknown year pattern"):
        spark.range(1).select(D.year_index_url("b", F.lit("/x/"), F.lit("?"), F.lit(1))).collect()

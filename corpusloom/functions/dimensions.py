"""Static dimensions as data, with column expressions and small tables over them.

All literals below are fixed values of the data model; their order matters where a comment says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Substring of a path -> court; the first one in this order decides.
PATH_SUBSTRING_COURT = [
    ("apofaseis/aad", "aad"), ("apofaseis/epa", "epa"), ("apofaseis/aap", "aap"), ("apofaseis/dioikitiko", "dioikitiko"), ("courtOfAppeal", "courtOfAppeal"),
    ("administrativeCourtOfAppeal", "administrativeCourtOfAppeal"), ("supremeAdministrative", "supremeAdministrative"), ("supreme", "supreme"), ("administrativeIP", "administrativeIP"),
    ("administrative", "administrative"), ("juvenileCourt", "juvenileCourt"), ("areiospagos", "areiospagos"), ("clr", "clr"), ("jsc", "jsc"), ("rscc", "rscc"),
]
# Start of a path -> court, for the crawler's update pages.
PATH_PREFIX_COURT = [
    ("/courtOfAppeal/", "courtOfAppeal"), ("/supreme/", "supreme"), ("/supremeAdministrative/", "supremeAdministrative"), ("/administrative/", "administrative"), ("/administrativeIP/", "administrativeIP"),
    ("/apofaseis/aad/", "aad"), ("/apofaseis/epa/", "epa"), ("/apofaseis/aap/", "aap"), ("/apofaseis/dioikitiko/", "dioikitiko"), ("/areiospagos/", "areiospagos"), ("/apofaseised/", "apofaseised"),
    ("/jsc/", "jsc"), ("/rscc/", "rscc"), ("/administrativeCourtOfAppeal/", "administrativeCourtOfAppeal"), ("/juvenileCourt/", "juvenileCourt"),
]
# The five substrings that the extractor looks for, in this order.
EXTRACTOR_COURT = [("apofaseis/aad", "aad"), ("apofaseis/epa", "epa"), ("apofaseis/aap", "aap"), ("apofaseis/dioikitiko", "dioikitiko"), ("clr", "clr")]
# Court -> level.
COURT_LEVEL = {
    "aad": "supreme", "supreme": "supreme", "supremeAdministrative": "supreme", "areiospagos": "foreign", "courtOfAppeal": "appeal", "administrativeCourtOfAppeal": "appeal",
    "apofaseised": "first_instance", "administrative": "administrative", "administrativeIP": "administrative", "juvenileCourt": "first_instance", "epa": "other", "aap": "other",
    "jsc": "supreme", "rscc": "supreme", "clr": "supreme", "dioikitiko": "administrative",
}
# Court -> name in the header of a chunk.
COURT_HEADER_NAME = {
    "aad": "Ανώτατο Δικαστήριο", "supreme": "Ανώτατο Δικαστήριο (νέο)", "supremeAdministrative": "Ανώτατο Συνταγματικό Δικαστήριο", "areiospagos": "Άρειος Πάγος (Ελλάδα)", "courtOfAppeal": "Εφετείο",
    "administrativeCourtOfAppeal": "Διοικητικό Εφετείο", "apofaseised": "Επαρχιακό Δικαστήριο", "administrative": "Διοικητικό Δικαστήριο", "administrativeIP": "Διοικητικό Δικαστήριο Διεθνούς Προστασίας",
    "juvenileCourt": "Δικαστήριο Παίδων", "epa": "Επιτροπή Προστασίας Ανταγωνισμού", "aap": "Αναθεωρητική Αρχή Προσφορών", "jsc": "Supreme Court of Cyprus", "rscc": "Supreme Constitutional Court",
    "clr": "Cyprus Law Reports", "dioikitiko": "Διοικητικό Δικαστήριο",
}
# Court -> name in lists of results.
COURT_LIST_NAME = {
    "aad": "Ανώτατο Δικαστήριο", "supreme": "Νέο Ανώτατο Δικαστήριο", "courtOfAppeal": "Εφετείο", "supremeAdministrative": "Ανώτατο Συνταγματικό Δικαστήριο", "administrative": "Διοικητικό Δικαστήριο",
    "administrativeIP": "Διοικ. Δικαστήριο Διεθν. Προστασίας", "epa": "Επιτροπή Προστασίας Ανταγωνισμού", "aap": "Αναθεωρητική Αρχή Προσφορών", "dioikitiko": "Διοικητικό Δικαστήριο", "clr": "Ανώτατο Δικαστήριο",
    "areiospagos": "Άρειος Πάγος", "apofaseised": "Πρωτόδικα Δικαστήρια", "jsc": "Ανώτατο Δικαστήριο", "rscc": "Ανώτατο Συνταγματικό Δικαστήριο", "administrativeCourtOfAppeal": "Διοικητικό Εφετείο",
    "juvenileCourt": "Δικαστήριο Παίδων",
}
# Codes of subcourts.
SUBCOURTS = ["pol", "poin", "oik", "enoik", "erg"]
# Path segment -> jurisdiction, in this order.
SEGMENT_JURISDICTION = [
    ("pol", "ΠΟΛΙΤΙΚΗ ΔΙΚΑΙΟΔΟΣΙΑ"), ("poin", "ΠΟΙΝΙΚΗ ΔΙΚΑΙΟΔΟΣΙΑ"), ("oik", "ΟΙΚΟΓΕΝΕΙΑΚΗ ΔΙΚΑΙΟΔΟΣΙΑ"), ("enoik", "ΔΙΚΑΙΟΔΟΣΙΑ ΕΝΟΙΚΙΟΣΤΑΣΙΟΥ"), ("erg", "ΕΡΓΑΤΙΚΗ ΔΙΚΑΙΟΔΟΣΙΑ"),
    ("meros_1", "ΠΟΙΝΙΚΗ ΔΙΚΑΙΟΔΟΣΙΑ"), ("meros_2", "ΠΟΛΙΤΙΚΗ ΔΙΚΑΙΟΔΟΣΙΑ"), ("meros_3", "ΕΡΓΑΤΙΚΗ ΔΙΚΑΙΟΔΟΣΙΑ"), ("meros_4", "ΔΙΟΙΚΗΤΙΚΗ ΔΙΚΑΙΟΔΟΣΙΑ"),
]
# Markers in documents.
REFERENCES, DECISION, JURISDICTION, LEGAL_ANALYSIS = "ΑΝΑΦΟΡΕΣ", "ΚΕΙΜΕΝΟ ΑΠΟΦΑΣΗΣ", "ΔΙΚΑΙΟΔΟΣΙΑ", "ΝΟΜΙΚΗ ΠΤΥΧΗ"
# Footer markers that name no site; callers add those of their source.
FOOTER_MARKERS = ["Παγκύπριο Δικηγορικό Σύλλογο", "Παγκύπριου Δικηγορικού Συλλόγου"]
# Sort orders of levels, relevance and engagement.
LEVEL_ORDER = {"supreme": 0, "appeal": 1, "first_instance": 2, "administrative": 3, "other": 4, "foreign": 5}
RELEVANCE_ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2, "NONE": 3}
ENGAGEMENTS = ["RULED", "DISCUSSED", "MENTIONED", "NOT_ADDRESSED"]
#: Levels that may filter the vector leg.
FILTER_LEVELS = ["supreme", "appeal", "foreign"]
# Stop words of the analyzer.
STOP_WORDS = "ο η το τα τον την του της τους τις των στο στη στον στην στα στους στις στων και ή αλλά με σε για από ως ότι αν δεν μη να θα ένα μια ένας είναι ήταν".split()
# Terms of the custom dictionary.
DICTIONARY = (
    "ΑΑΔ ΕΔ ΕΔΑΠ ΑΔ ΕΕΔ ΟΑΔ ΕΠΔ ΔΕΚ ΔΕΕ ΔΕΑ ΕΔΔΑ Mareva injunction estoppel judicata forum lex causae locus standi certiorari mandamus habeas corpus "
    "Cap Κανονισμός Κανονισμοί Κανονισμών Οδηγία Οδηγίες Κεφ acquis vires Famagusta"
).split()
# Model key -> dollars for a million input and output tokens.
PRICING = {"gpt-4o": (2.5, 10.0), "o3-mini": (1.1, 4.4), "claude": (3.0, 15.0)}
# Court, index path, year pattern, first and last year (or volume).
COURTS = [
    ("aad", "/apofaseis/aad/", "index_{year}", 1961, 2024), ("supreme", "/supreme/", "index_{year}", 2023, 2026), ("courtOfAppeal", "/courtOfAppeal/", "index_{year}", 2004, 2026),
    ("supremeAdministrative", "/supremeAdministrative/", "index_{year}", 2023, 2026), ("administrative", "/administrative/", "index_{year}", 2016, 2026), ("administrativeIP", "/administrativeIP/", "index_{year}", 2018, 2026),
    ("epa", "/apofaseis/epa/", "{year}/index", 2002, 2026), ("aap", "/apofaseis/aap/", "{year}/index", 2004, 2026), ("dioikitiko", "/apofaseis/dioikitiko/", "index_{year}", 2023, 2023),
    ("areiospagos", "/areiospagos/", "index_{year}", 1968, 2026), ("apofaseised", "/apofaseised/", "index_{year}", 2005, 2026), ("jsc", "/jsc/", "index_{year}", 1964, 1988), ("rscc", "/rscc/", "index_{year}", 1, 5),
    ("administrativeCourtOfAppeal", "/administrativeCourtOfAppeal/", "index_{year}", 2025, 2026), ("juvenileCourt", "/juvenileCourt/", "index_{year}", 2023, 2025),
]


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """A map literal's value, or the default."""
    got = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[key]
    return got if default is None else F.coalesce(got, default)


def court_registry(spark: SparkSession, base_url: str) -> DataFrame:
    """court_id, base_index_url, year_index_pattern, year_start, year_end, main_index_url."""
    df = spark.createDataFrame(COURTS, "court_id string, base_index_url string, year_index_pattern string, year_start int, year_end int")
    return df.withColumn("main_index_url", F.concat(F.lit(base_url), "base_index_url"))


def year_index_url(base_url: str, index: Column, pattern: Column, year: Column) -> Column:
    """A year's index page; an unknown pattern raises."""
    start = F.concat(F.lit(base_url), index)
    return (
        F.when(pattern == "index_{year}", F.concat(start, F.lit("index_"), year.cast("string"), F.lit(".html")))
        .when(pattern == "{year}/index", F.concat(start, year.cast("string"), F.lit("/index.html")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown year pattern: "), pattern)))
    )


def year_index_urls(spark: SparkSession, base_url: str) -> DataFrame:
    """One row for each court and year of its range: court_id, year, url."""
    rows = court_registry(spark, base_url).withColumn("year", F.explode(F.sequence("year_start", "year_end")))
    return rows.select("court_id", "year", year_index_url(base_url, F.col("base_index_url"), F.col("year_index_pattern"), F.col("year")).alias("url"))


def get_court(spark: SparkSession, court_id: str, base_url: str) -> DataFrame:
    """The registry row of a court; an unknown id raises ValueError."""
    if court_id not in {c[0] for c in COURTS}:
        raise ValueError(f"unknown court {court_id!r}; known: {[c[0] for c in COURTS]}")
    return court_registry(spark, base_url).where(F.col("court_id") == court_id)


def pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PRICING.items()], "model string, price_in double, price_out double")

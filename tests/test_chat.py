"""Questions as whole runs, with models whose calls are scripted."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import fulltext, models, postings
from corpusloom.plans import agent, chat

DOCS = "doc_id string, title string, court string, year int, text string"
ROWS = [
    ("a", "A", "x", 2001, "negligence of the driver on a wet road"), ("b", "B", "x", 2010, "driver of a lorry, damages for negligence"), ("c", "C", "y", 2015, "contract of sale, damages"),
    ("d", "D", "y", None, "damages for breach of contract"), ("e", "E", "y", 2020, "appeal on costs"), ("f", "F", "y", 2021, ""),
]


def call(name, **arguments):
    return {"id": name, "name": "search_cases", "arguments": json.dumps(arguments)}


def scripted():
    """Asks by what the question says; the last round's calls follow from what the answers hold."""

    def ask(messages):
        question, turns = messages[0]["content"], sum(m["role"] == "assistant" for m in messages)
        if question.startswith("driver") and turns == 0:
            return "looking", [call("1", query="damages", year_from=2012), call("2", query="damages", year_from=2012), {"id": "3", "name": "other", "arguments": "{}"}]
        if question.startswith("driver") and turns == 1:
            said = [m["content"] for m in messages if m["role"] == "tool"]
            assert "[Result" in said[0] and said[1] == chat.SEARCHED and said[2].startswith("unknown tool")
            return "more", [call("4", query="appeal costs"), call("5", query="damages", year_from=2012)]
        if question.startswith("driver") and turns == 2:
            said = [m["content"] for m in messages if m["role"] == "tool"]
            assert said[3].startswith("[Result 1] E") and said[4] == chat.SEARCHED
        if question == "ok":
            return "", [call("1", query="negligence")] if turns == 0 else []
        return "done", []

    return ask


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def index(spark, documents, tmp_path_factory):
    base = f"file://{tmp_path_factory.mktemp('chat')}/index"
    postings.build(fulltext.documents_with_terms(documents), base, 4, 2)
    return postings.Index(spark, base)


QUESTIONS = [(1, "driver negligence"), (2, "ok"), (3, None), (4, "   "), (5, "nothing matches zzz")]


@pytest.fixture(scope="module")
def told(spark, documents, index):
    questions = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    return chat.answer(questions, documents, chat.hybrid_searches(documents, index), scripted)


def test_rounds(told):
    searches = [tuple(r) for r in told["searches"].orderBy("query_id", "step").select("query_id", "step", "round", "query", "year_from", "repeated", F.col("error").isNotNull()).collect()]
    assert searches == [
        (1, 0, 0, "driver negligence", None, False, False), (1, 1, 1, "damages", 2012, False, False), (1, 2, 1, "damages", 2012, True, False), (1, 3, 1, None, None, False, True), (1, 4, 2, "appeal costs", None, False, False),
        (1, 5, 2, "damages", 2012, True, False), (2, 0, 1, "negligence", None, False, False), (5, 0, 0, "nothing matches zzz", None, False, False),
    ]
    sources = {(r.query_id, r.doc_id): (r.step, r.round) for r in told["sources"].collect()}
    # d has no year, so the year filter drops it; b was seen before the search for damages
    assert sources == {(1, "a"): (0, 0), (1, "b"): (0, 0), (1, "c"): (1, 1), (1, "e"): (4, 2), (2, "a"): (0, 1), (2, "b"): (0, 1)}
    assert told["sources"].count() == len(sources)


def test_answer_and_events(told):
    kept = {(r.query_id, r.doc_id) for r in told["kept"].collect()}
    summaries = {(r.query_id, r.doc_id): r.rating for r in told["summaries"].collect()}
    assert kept == set(summaries) and (1, "a") in kept
    assert summaries[1, "a"] == "HIGH" and {(r.query_id, r.doc_id) for r in told["shown"].collect()} == {k for k, v in summaries.items() if v in ("HIGH", "MEDIUM")}
    events = told["events"].orderBy("query_id", "seq").collect()
    names = [(r.seq, r.event) for r in events if r.query_id == 1]
    assert [n for _, n in names][:3] == ["searching", "sources", "searching"] and names[-1][1] == "done" and [s for s, _ in names] == [*range(1, len(names) + 1)]
    assert sum(n == "searching" for _, n in names) == 6 and sum(n == "sources" for _, n in names) == 3 and sum(n == "summaries" for _, n in names) == len([k for k in kept if k[0] == 1])
    assert [r.event for r in events if r.query_id == 5] == ["searching", "done"] and not [r for r in events if r.query_id in (3, 4)]
    assert json.loads(next(r.data for r in events if r.event == "reranked" and r.query_id == 2)) == {"kept": 2, "dropped": 0}


def test_no_more_rounds_than_asked(spark, documents, index):
    endless = lambda: lambda messages: ("", [call(str(len(messages)), query=f"damages {len(messages)}")])
    questions = spark.createDataFrame([(1, "contract")], "query_id long, text string")
    searches, sources = chat.converse(questions, documents, chat.hybrid_searches(documents, index), endless, rounds=2)
    assert [r.query for r in searches.orderBy("step").collect()] == ["contract", "damages 1", "damages 3"]
    assert {r.doc_id: r.step for r in sources.collect()} == {"c": 0, "d": 0, "b": 1}


def test_both_legs(spark, documents, index):
    """A level filters the vector leg of its own search alone."""
    provider = models.hashed_provider
    level = F.when(F.col("court") == "x", "supreme").otherwise("appeal")
    chunks = models.embedded(documents.select("doc_id", F.concat("doc_id", F.lit("#0")).alias("chunk_id"), level.alias("court_level"), "text"), provider)
    search = chat.hybrid_searches(documents, index, chunks, provider)
    asked = spark.createDataFrame([("s1", "damages for breach of contract", "appeal", None, None), ("s2", "damages for breach of contract", None, None, None), ("s3", "driver of a lorry, damages for negligence", "appeal", None, None)], "search_id string, text string, court_level string, year_from int, year_to int")
    got = {(r.search_id, r.doc_id): (r.vec_rank, r.bm25_rank) for r in search(asked).collect()}
    assert got["s1", "d"][0] == 1 and got["s2", "d"][0] == 1 and got["s3", "b"][0] is None and got["s3", "b"][1] == 1


def test_offline_model_and_arguments():
    ask = agent.keyword_model()
    assert json.loads(ask([{"role": "user", "content": "a bbb cc dddd eeeee"}])[1][0]["arguments"]) == {"query": "eeeee dddd bbb cc"}
    assert agent.arguments({"name": "search_cases", "arguments": "nope"}) == {"error": "arguments aren't JSON"}
    assert agent.arguments(call("1", query=" x ", court_level="odd", year_from="1999", year_to="soon")) == {"query": "x", "legal_context": None, "court_level": None, "year_from": 1999, "year_to": None}


def test_searches_of_the_plain_generator(spark):
    """The relation of searches without answers, with year bounds and repeats."""
    questions = spark.createDataFrame([(1, "driver of a car"), (2, ""), (3, "ok")], "query_id long, text string")
    make = lambda: lambda m: ("", [call("1", query="road", year_from=2005, year_to=2010), call("2", query="road", year_from=2005, year_to=2010), call("3", query="lane", year_from=2001)] if len(m) == 1 else [])
    found = agent.generated(questions, make)
    years = {r.query_id: (r.searches, r.year_from, r.year_to) for r in agent.applied_years(found).collect()}
    assert years == {1: (4, 2001, 2010), 3: (3, 2001, 2010)}
    assert [r.step for r in agent.distinct_searches(found).where("query_id = 1").orderBy("step").collect()] == [0, 1, 3]

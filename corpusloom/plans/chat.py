"""Questions as one run: rounds of searches that a tool-calling model asks for, rerank, summaries and events, all questions at once.

Each round is a dataflow over all open conversations: the model reads each conversation and
calls for searches; those of all questions are answered in one hybrid plan; what a question
hasn't seen before becomes its sources and the answer to the calls. Conversations, searches and
sources are tables that are written once a round and carried on, so a round's plan doesn't
grow with the rounds before it, and a lost executor costs its part of one round.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import dimensions as D
from corpusloom.functions import text as X
from corpusloom.operators import fusion, models, rerank, vector
from corpusloom.operators.postings import Index
from corpusloom.plans import agent, hybrid
from corpusloom.session import code_path, small, written

#: Answers searches (search_id, text, court_level, year_from, year_to): search_id, doc_id, score, rank, vec_rank, bm25_rank.
Search = Callable[[DataFrame], DataFrame]
#: Writes a summary as JSON: the question's focus and a document's text in.
Summarize = Callable[[str, str], str]

MESSAGES = "array<struct<role:string,content:string,tool_call_id:string,tool_calls:string>>"
CALLS = "array<struct<call_id:string,query:string,legal_context:string,court_level:string,year_from:int,year_to:int,error:string>>"
SEARCH = ["query", "court_level", "year_from", "year_to"]
NOTHING_NEW, SEARCHED, PREVIEW = "no new documents", "searched before", 400


def year_rule(year: Column, low: Column, high: Column) -> Column:
    """Bounds of a search's own, 0 or null being none; a year that is no number counts as 0."""
    known = F.coalesce(year.cast("string").try_cast("int"), F.lit(0))
    return ((F.coalesce(low, F.lit(0)) == 0) | (known >= low)) & ((F.coalesce(high, F.lit(0)) == 0) | (known <= high))


def hybrid_searches(documents: DataFrame, index: Index, chunks: DataFrame | None = None, embed: Callable[[], models.Embed] | None = None, scorer: str = "tf") -> Search:
    """Both legs over stored postings and, if given, chunks with vectors; a level filters the vector leg, years filter what was fused. documents: doc_id and year."""

    def run(searches: DataFrame) -> DataFrame:
        asked = written(searches.withColumnRenamed("search_id", "query_id"), "searches")
        t = written(hybrid.text_leg(index, asked.select("query_id", "text"), scorer), "text-leg")
        if chunks is None:
            found = fusion.rrf(t.where("false"), t)
        else:
            q = written(models.embedded(asked, embed, out="query_vector"), "search-vectors")
            legs = [hybrid.vector_leg(chunks, q.where(~F.coalesce(F.col("court_level").isin(*D.FILTER_LEVELS), F.lit(False))))]
            legs += [hybrid.vector_leg(chunks, q.where(F.col("court_level") == level), level=level) for level in D.FILTER_LEVELS]
            v = legs[0]
            for leg in legs[1:]:
                v = v.unionByName(leg)
            v = written(v, "vector-leg")
            found = fusion.with_bypass(fusion.rrf(v, t), v, t).drop("score_kind")
        found = written(found, "fused")  # 30 rows a search
        years = found.join(small(found.select("doc_id").distinct()).join(documents.select("doc_id", "year"), "doc_id"), "doc_id").join(small(asked.select("query_id", "year_from", "year_to")), "query_id")
        kept = years.where(year_rule(F.col("year"), F.col("year_from"), F.col("year_to")))
        return kept.select(F.col("query_id").alias("search_id"), "doc_id", "score", "rank", "vec_rank", "bm25_rank")

    return run


def _asked(talks: DataFrame, make: Callable[[], agent.Model]) -> DataFrame:
    """query_id, said, tool_calls (as the model gave them), calls (as far as they can be run)."""
    code_path(talks.sparkSession)
    names = [c.split(":")[0] for c in CALLS.removeprefix("array<struct<").removesuffix(">>").split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for frame in frames:
            rows = []
            for key, messages in zip(frame["query_id"], frame["messages"], strict=True):
                said, calls = ask([{k: v for k, v in dict(m).items() if v is not None} for m in messages])
                rows.append((key, said, json.dumps(calls), [{n: {"call_id": str(c.get("id")), **agent.arguments(c)}.get(n) for n in names} for c in calls]))
            yield pd.DataFrame(rows, columns=["query_id", "said", "tool_calls", "calls"])

    kind = talks.schema["query_id"].dataType.simpleString()
    return talks.select("query_id", F.from_json(F.to_json("messages"), MESSAGES).alias("messages")).mapInPandas(run, f"query_id {kind}, said string, tool_calls string, calls {CALLS}")


def converse(questions: DataFrame, documents: DataFrame, search: Search, make: Callable[[], agent.Model], rounds: int = agent.ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Searches and sources of questions (query_id, text) over documents (doc_id, title, court, year, text).

    searches: query_id, step, round, query, court_level, year_from, year_to, error, repeated.
    sources: query_id, doc_id, step, round, rank, score, vec_rank, bm25_rank; each document once a question, as the first search has it.
    A question of more than two characters is its own first search, which the model doesn't see as a call. Blank questions are asked nothing.
    """
    stripped = X.py_strip(F.coalesce(F.col("text"), F.lit("")))
    first = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("tool_calls")))
    talks = questions.select("query_id", stripped.alias("question")).where("question <> ''")
    talks = written(talks.select("query_id", "question", first.cast(MESSAGES).alias("messages"), (F.char_length("question") > agent.SHORT).cast("int").alias("step")), "talks")
    null = lambda kind: F.lit(None).cast(kind)
    own = talks.where("step = 1").select(
        "query_id", F.lit(0).alias("step"), F.lit(0).alias("round"), null("string").alias("call_id"), F.col("question").alias("query"), null("string").alias("court_level"), null("int").alias("year_from"), null("int").alias("year_to"), null("string").alias("error")
    )
    searches, sources = _searched(own, None, None, search)
    for number in range(1, rounds + 1):
        asked = written(_asked(talks, make).where(F.size("calls") > 0), "asked")
        calls = talks.select("query_id", "step").join(asked, "query_id").select("query_id", F.col("step").alias("_from"), F.posexplode("calls").alias("_p", "c"))
        calls = written(calls.select("query_id", (F.col("_from") + F.col("_p")).alias("step"), F.lit(number).alias("round"), "c.call_id", *[f"c.{s}" for s in SEARCH], "c.error"), "calls")
        if calls.isEmpty():
            break
        tried, found = _searched(calls, searches, sources, search)
        talks = _answered(talks, asked, tried, found, documents)
        searches, sources = searches.unionByName(tried), sources.unionByName(found)
    return searches.drop("call_id"), sources


def _searched(calls: DataFrame, searches: DataFrame | None, sources: DataFrame | None, search: Search) -> tuple[DataFrame, DataFrame]:
    """Runs calls that can be run and weren't before; marks those that were, and keeps of what is found what a question hasn't seen."""
    same = Window.partitionBy("query_id", *SEARCH).orderBy("step")
    tried = calls.withColumn("repeated", F.col("error").isNull() & (F.row_number().over(same) > 1))
    if searches is not None:
        before = searches.where("error IS NULL").select(F.col("query_id").alias("_q"), *[F.col(s).alias(f"_{s}") for s in SEARCH]).distinct()
        on = (F.col("query_id") == F.col("_q")) & F.lit(True)
        for s in SEARCH:
            on = on & F.col(s).eqNullSafe(F.col(f"_{s}"))
        tried = tried.join(before, on, "left").withColumn("repeated", F.col("repeated") | (F.col("_q").isNotNull() & F.col("error").isNull())).select(*calls.columns, "repeated")
    tried = written(tried, "tried")
    name = F.concat_ws(":", F.col("query_id").cast("string"), "step")
    new = written(tried.where("error IS NULL AND NOT repeated").select(name.alias("search_id"), "query_id", "step", "round", F.col("query").alias("text"), "court_level", "year_from", "year_to"), "new-searches")
    found = search(new.select("search_id", "text", "court_level", "year_from", "year_to")).join(small(new.select("search_id", "query_id", "step", "round")), "search_id")
    found = fusion.first_seen(found, "query_id", "step", "rank", "doc_id")
    if sources is not None:
        found = found.join(sources.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return tried, written(found.select("query_id", "doc_id", "step", "round", "rank", "score", "vec_rank", "bm25_rank"), "sources")


def _answered(talks: DataFrame, asked: DataFrame, tried: DataFrame, found: DataFrame, documents: DataFrame) -> DataFrame:
    """Conversations that go on: what the model said, and for each call what was found that is new, best first."""
    about = documents.join(small(found.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "title", "court", "year", F.left("text", F.lit(PREVIEW)).alias("preview"))
    line = rerank.result_text(F.col("rank"), F.coalesce("title", F.lit("")), F.coalesce("court", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("")), vector.percent(1 - F.col("score")), F.coalesce("preview", F.lit("")))
    lines = found.join(about, "doc_id").select("query_id", "step", F.struct("rank", "doc_id", line.alias("line")).alias("l")).groupBy("query_id", "step").agg(F.sort_array(F.collect_list("l")).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["line"]), "\n\n")
    said = F.coalesce("error", F.when(F.col("repeated"), F.lit(SEARCHED)), text, F.lit(NOTHING_NEW))
    tool = F.struct(F.lit("tool").alias("role"), said.alias("content"), F.col("call_id").alias("tool_call_id"), F.lit(None).cast("string").alias("tool_calls"))
    answers = tried.join(lines, ["query_id", "step"], "left").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("step", tool.alias("m")))).alias("_a"))
    model = F.struct(F.lit("assistant").alias("role"), F.col("said").alias("content"), F.lit(None).cast("string").alias("tool_call_id"), "tool_calls")
    joined = talks.join(asked.select("query_id", "said", "tool_calls"), "query_id").join(answers, "query_id")
    messages = F.concat("messages", F.array(model).cast(MESSAGES), F.transform("_a", lambda a: a["m"]).cast(MESSAGES))
    return written(joined.select("query_id", "question", messages.alias("messages"), (F.col("step") + F.size("_a")).alias("step")), "talks")


def summarized(kept: DataFrame, questions: DataFrame, documents: DataFrame, make: Callable[[], Summarize]) -> DataFrame:
    """query_id, doc_id, summary, rating, engagement: one call for each kept document with a text; an answer that is no summary, or none after an error, becomes the default one."""
    code_path(kept.sparkSession)
    rows = kept.select("query_id", "doc_id").join(documents.select("doc_id", "text").where("text <> ''"), "doc_id").join(questions.select("query_id", X.spoken_focus(F.col("text")).alias("focus")), "query_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        write = make()
        for frame in frames:
            answers = []
            for focus, text in zip(frame["focus"], frame["text"], strict=True):
                try:
                    answers.append(write(focus or "", text))
                except (OSError, TimeoutError):  # of the service; one document without a summary fails no others
                    answers.append(None)
            yield frame[["query_id", "doc_id"]].assign(answer=pd.Series(answers, index=frame.index, dtype=object))

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("query_id", "doc_id")]
    told = rows.select("query_id", "doc_id", "focus", "text").mapInPandas(run, f"{kinds[0]}, {kinds[1]}, answer string")
    return told.select("query_id", "doc_id", rerank.parsed_summary(F.col("answer")).alias("summary")).select("*", F.col("summary.relevance.rating").alias("rating"), F.col("summary.findings.engagement").alias("engagement"))


def overlap_summaries() -> Summarize:
    """An offline summariser: how much of the focus's words a text holds decides engagement and rating."""

    def write(focus: str, text: str) -> str:
        words = set(focus.lower().split())
        share = len(words & set(text.lower().split())) / len(words) if words else 0.0
        level = min(3, int((1 - share) * 4))
        found = {"engagement": D.ENGAGEMENTS[level], "analysis": f"{share:.2f}", "quote": ""}
        return json.dumps({"caseHeader": {"parties": "", "court": "", "date": "", "caseNumber": ""}, "status": "", "facts": "", "coreIssue": "", "findings": found, "outcome": "", "relevance": {"rating": [*D.RELEVANCE_ORDER][level], "reasoning": ""}})

    return write


def events(searches: DataFrame, sources: DataFrame, kept: DataFrame, summaries: DataFrame) -> DataFrame:
    """query_id, seq, event, data: what a client of each question is told, in order: its searches with their new sources, the rerank, each summary, the end."""
    key = lambda *c: F.struct(*[x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long") for x in c])
    rows = [searches.select("query_id", key(0, F.col("step"), 0).alias("at"), F.lit("searching").alias("event"), F.to_json(F.struct("query", "court_level", "year_from", "year_to")).alias("data"))]
    found = sources.groupBy("query_id", "step").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("documents"))  # a search finds 130 at most
    rows.append(found.select("query_id", key(0, F.col("step"), 1).alias("at"), F.lit("sources").alias("event"), F.to_json(F.struct("documents")).alias("data")))
    given = sources.groupBy("query_id").agg(F.count(F.lit(1)).alias("given"))
    held = given.join(kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("kept")), "query_id")
    rows.append(held.select("query_id", key(1, 0, 0).alias("at"), F.lit("reranked").alias("event"), F.to_json(F.struct("kept", (F.col("given") - F.col("kept")).alias("dropped"))).alias("data")))
    rows.append(held.select("query_id", key(2, 0, 0).alias("at"), F.lit("summarizing").alias("event"), F.to_json(F.struct(F.col("kept").alias("count"))).alias("data")))
    numbered = summaries.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    rows.append(numbered.select("query_id", key(3, F.col("_n"), 0).alias("at"), F.lit("summaries").alias("event"), F.to_json(F.struct(F.col("doc_id").alias("docId"), "summary")).alias("data")))
    rows.append(searches.select("query_id").distinct().select("query_id", key(4, 0, 0).alias("at"), F.lit("done").alias("event"), F.lit("{}").alias("data")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("seq"), "event", "data")


def answer(questions: DataFrame, documents: DataFrame, search: Search, make_model: Callable[[], agent.Model], make_summarizer: Callable[[], Summarize] = overlap_summaries, rounds: int = agent.ROUNDS) -> dict[str, DataFrame]:
    """The whole run: searches, sources, kept (reranked), summaries, shown (rated high or medium once all are there) and events of all questions."""
    searches, sources = converse(questions, documents, search, make_model, rounds)
    kept = written(hybrid.answer(questions.select("query_id", F.coalesce("text", F.lit("")).alias("text")), documents, sources.drop("rank")), "kept")
    summaries = written(summarized(kept, questions, documents, make_summarizer), "summaries")
    years = kept.select("query_id", "doc_id").join(documents.select("doc_id", "year"), "doc_id")
    shown = rerank.display(years.join(summaries.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi"), summaries)
    return {"searches": searches, "sources": sources, "kept": kept, "summaries": summaries, "shown": shown, "events": events(searches, sources, kept, summaries)}

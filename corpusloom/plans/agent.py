"""Generation of search queries by a tool-calling model: questions in, a relation of searches out. The model is a provider made on each task."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import dimensions as D
from corpusloom.session import code_path

#: Asks the model: messages in; its text and tool calls ({"id", "name", "arguments" as JSON}) out.
Model = Callable[[list[dict]], tuple[str, list[dict]]]

ROUNDS, OLD_ROUNDS = 10, 5
#: A question of more characters than this is itself the first search.
SHORT = 2
TOOL = {
    "name": "search_cases",
    "parameters": {
        "type": "object",
        "required": ["query"],
        "properties": {"query": {"type": "string"}, "legal_context": {"type": "string"}, "court_level": {"type": "string", "enum": D.FILTER_LEVELS}, "year_from": {"type": "integer"}, "year_to": {"type": "integer"}},
    },
}
SCHEMA = "step int, query string, legal_context string, court_level string, year_from int, year_to int, error string"


def arguments(call: dict) -> dict:
    """A call's arguments as far as the tool's schema knows them, or an error."""
    try:
        given = json.loads(call.get("arguments") or "{}")
    except ValueError:
        return {"error": "arguments aren't JSON"}
    if call.get("name") != TOOL["name"]:
        return {"error": f"unknown tool: {call.get('name')}"}
    if not isinstance(given, dict) or not str(given.get("query") or "").strip():
        return {"error": "query is required"}
    year = lambda v: int(v) if str(v or "").strip().isdigit() else None
    level = given.get("court_level")
    return {"query": str(given["query"]).strip(), "legal_context": given.get("legal_context"), "court_level": level if level in D.FILTER_LEVELS else None, "year_from": year(given.get("year_from")), "year_to": year(given.get("year_to"))}


def searches(question: str | None, ask: Model, rounds: int, answer: Callable[[dict], str]) -> Iterator[dict]:
    """The searches of one question: the question itself first, then what the model calls for, round by round, until it calls for none."""
    question = (question or "").strip()
    step = 0
    if len(question) > SHORT:
        yield {"step": step, "query": question}
        step += 1
    messages = [{"role": "user", "content": question}]
    for _ in range(rounds if question else 0):
        said, calls = ask(messages)
        if not calls:
            return
        messages.append({"role": "assistant", "content": said, "tool_calls": calls})
        for call in calls:
            found = arguments(call)
            yield {"step": step, **found}
            step += 1
            messages.append({"role": "tool", "tool_call_id": call.get("id"), "content": found.get("error") or answer(found)})


def generated(questions: DataFrame, make: Callable[[], Model], key: str = "query_id", text: str = "text", rounds: int = ROUNDS, answer: Callable[[dict], str] = lambda call: "searched") -> DataFrame:
    """key, step, query, legal_context, court_level, year_from, year_to, error: the searches of each question. A task makes its model once."""
    code_path(questions.sparkSession)
    columns = [key, *(c.split()[0] for c in SCHEMA.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for frame in frames:
            rows = [{key: k, **s} for k, t in zip(frame[key], frame[text], strict=True) for s in searches(t, ask, rounds, answer)]
            out = pd.DataFrame(rows, columns=columns)
            for c in ("step", "year_from", "year_to"):
                out[c] = out[c].astype("Int32")
            yield out.astype({c: object for c in ("query", "legal_context", "court_level", "error")}).where(lambda x: x.notna(), None)

    kind = questions.schema[key].dataType.simpleString()
    return questions.select(key, text).mapInPandas(run, f"{key} {kind}, {SCHEMA}")


def applied_years(found: DataFrame, key: str = "query_id") -> DataFrame:
    """key, searches, year_from and year_to: the least bounds that any of a question's searches applied, null where none did."""
    return found.where("error is null").groupBy(key).agg(F.count(F.lit(1)).alias("searches"), F.min("year_from").alias("year_from"), F.min("year_to").alias("year_to"))


def distinct_searches(found: DataFrame, key: str = "query_id") -> DataFrame:
    """Searches that say nothing new (same text and filters) once, the first one."""
    same = ["query", "court_level", "year_from", "year_to"]
    order = Window.partitionBy(key, *same).orderBy("step")
    return found.where("error is null").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "error")


def keyword_model(words: int = 4) -> Model:
    """An offline model: one call for the longest words of the question, then none. The same question gives the same calls anywhere."""

    def ask(messages: list[dict]) -> tuple[str, list[dict]]:
        if len(messages) > 1:
            return "done", []
        text = messages[0]["content"]
        chosen = sorted(dict.fromkeys(text.lower().split()), key=lambda w: (-len(w), w))[:words]
        return "", [{"id": "1", "name": TOOL["name"], "arguments": json.dumps({"query": " ".join(chosen)})}] if chosen else []

    return ask

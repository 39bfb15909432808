"""Registered event, job and evaluation queries over the whole tables: (query, SQL or None) by name."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from corpusloom.functions import dimensions as D
from corpusloom.functions import text as X
from corpusloom.operators import rerank, stats
from corpusloom.plans.catalog_retrieval import JUDGED, judged
from corpusloom.plans.catalog_text import DECISIONS, decisions
from corpusloom.session import table, work_path
from corpusloom.sources import file_index, index_writer, line_index, merge_log, sinks
from corpusloom.streaming import events as E
from corpusloom.streaming import event_sink, gate

n = lambda c: F.col(c).cast("long").alias(c)
i = lambda c: F.col(c).cast("int").alias(c)


def log(s, d):
    return E.timed(table(s, d, "events"))


# ---- events


def event_gap_max(s, d):
    return E.longest_gap(log(s, d)).select("user_id", n("max_gap_s"), n("events"))


def event_distribution(s, d):
    return stats.distribution(table(s, d, "events"), "event_type").select("event_type", n("n"))


def running_totals(s, d):
    return E.running_totals(log(s, d)).select("event_id", n("running_n"), F.round("running_value", 4).alias("running_value"))


def event_seq(s, d):
    return E.numbered(log(s, d)).select("event_id", i("seq"))


def session_windows_batch(s, d):
    got = E.sessions(log(s, d))
    return got.select("user_id", F.unix_timestamp("start").alias("start_s"), F.unix_timestamp("end").alias("end_s"), n("events"))


def stream_dedup(s, d):
    """The event log as a stream: each user's event types once within the watermark."""
    events = E.read_stream(s, d, "events.parquet")
    return E.run_once(E.first_seen(events, "user_id", "event_type", "36500 days").select("user_id", "event_type"), "stream_dedup", "append", work_path(s, "stream-dedup"))


def stream_totals(s, d):
    """The event log as a stream in complete mode."""
    events = E.read_stream(s, d, "events.parquet")
    got = E.run_once(E.totals(events), "stream_totals", "complete", work_path(s, "stream-totals"))
    return got.select("user_id", n("n"), F.round("value", 4).alias("value"))


def stream_windows(s, d):
    """Tumbling windows of an hour over the stream, in complete mode."""
    events = E.read_stream(s, d, "events.parquet")
    got = E.run_once(E.windows(events, "1 hour"), "stream_windows", "complete", work_path(s, "stream-windows"))
    return got.select(F.unix_timestamp("start").alias("start_s"), "event_type", n("n"))


def announced(events):
    """Sign-ups announce one to four summaries, other events are summaries of seven documents."""
    kind = F.when(F.col("event_type") == "signup", "expected").otherwise("summary")
    return events.select("user_id", "event_id", "ts", kind.alias("kind"), (F.col("event_id") % 4 + 1).alias("n"), (F.col("event_id") % 7).alias("doc_id"))


def stream_gate(s, d):
    """The event log as a stream; sessions end after six hours."""
    events = announced(E.read_stream(s, d, "events.parquet"))
    got = E.run_once(gate.all_arrived(events, idle=timedelta(hours=6)), "stream_gate", "append", work_path(s, "stream-gate"))
    return got.select("user_id", F.unix_micros("began").alias("began"), F.unix_micros("at").alias("at"), "expected", "summarized", "complete")


def stream_event_log(s, d):
    """The event log as a stream into the durable sink, and read back in order."""
    path = work_path(s, "event-log")
    told = E.read_stream(s, d, "events.parquet").select("user_id", "event_id", "ts", F.col("event_type").alias("event"), F.to_json(F.struct("value")).alias("data"))
    event_sink.write_events(told, path, work_path(s, "event-log-state")).awaitTermination()
    got = event_sink.in_order(event_sink.read_events(s, path, "user_id long, event_id long, event string, data string"))
    return got.select("user_id", "event_id", i("seq"), F.md5(sinks.event_text(F.col("event"), F.lit("x"))).alias("md5"))


def merge_log_latest(s, d):
    """Line items by order as updates in six batches, the later ship date winning; merged by levels."""
    rows, path = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.concat_ws("#", F.date_format("l_shipdate", "yyyyMMdd"), F.format_string("%02d#%012d", "l_linenumber", "l_partkey")).alias("v")), work_path(s, "merge-log")
    for epoch in range(6):
        merge_log.apply(rows.where(F.col("l_linenumber") % 6 == epoch), path, ["l_orderkey"], "v", epoch)
        merge_log.compact(s, path, ["l_orderkey"], "v")
    return merge_log.read(s, path, ["l_orderkey"], "v").select("l_orderkey", "l_linenumber", "l_quantity")


def indexed_lookup(s, d):
    """Documents of a few ids, from the files that the index names."""
    top = work_path(s, "lookup")
    table(s, d, "documents").repartition(16, "doc_id").write.parquet(f"{top}/table")
    file_index.build(s, f"{top}/table", f"{top}/index", ["doc_id"])
    return file_index.lookup(s, f"{top}/table", f"{top}/index", "doc_id", [0, 7, 77, 777, -1]).select("doc_id", "n_chars")


def keep_alive(s, d):
    return E.keep_alive(log(s, d)).select("user_id", n("batch"), n("done"), F.unix_micros("ts").alias("ts"))


def answered(s, d):
    """Errors answered by a purchase within two hours."""
    events = log(s, d)
    got = E.answered(events.where("event_type = 'error'"), events.where("event_type = 'purchase'"), "2 hours")
    return got.select("user_id", "asked_id", "answer_id", n("after_s"))


GATE = """WITH ev AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'signup' THEN event_id % 4 + 1 END AS n, CASE WHEN event_type <> 'signup' THEN event_id % 7 END AS doc FROM events),
paused AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM ev),
island AS (SELECT *, sum(CASE WHEN ts > prev + INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM paused),
once AS (SELECT *, CASE WHEN doc IS NOT NULL AND row_number() OVER (PARTITION BY user_id, k, doc ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS new FROM island),
run AS (SELECT user_id, k, ts, event_id, last_value(n IGNORE NULLS) OVER w AS expected, sum(new) OVER w AS summarized, min(ts) OVER (PARTITION BY user_id, k) AS began FROM once
  WINDOW w AS (PARTITION BY user_id, k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
met AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS r FROM run WHERE expected <= summarized) WHERE r = 1),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS r, max(k) OVER (PARTITION BY user_id) AS top FROM run) WHERE r = 1),
unmet AS (SELECT last.* FROM last ANTI JOIN met USING (user_id, k) WHERE expected IS NOT NULL AND (k < top OR ts + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)))
SELECT user_id, epoch_us(began) AS began, epoch_us(ts) AS at, expected::BIGINT AS expected, summarized::BIGINT AS summarized, true AS complete FROM met
UNION ALL SELECT user_id, epoch_us(began), epoch_us(ts), expected::BIGINT, summarized::BIGINT, false FROM unmet"""


# ---- jobs


def parsed(s, d):
    return decisions(s, d).select("doc_id", F.col("source").alias("court"), F.col("lang").alias("fmt"), X.word_count(F.col("text")).alias("words"), F.char_length("text").alias("chars"), X.count_refs(F.col("text")).alias("refs"))


def stats_by_court_format(s, d):
    got = stats.extraction_stats(parsed(s, d))
    return got.select("court", "fmt", n("documents"), n("words"), n("chars"), n("refs"), n("avg_words"))


def entries(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderstatus").alias("court"), F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.year("o_orderdate").cast("string")).alias("year"), F.concat(F.lit("/x/"), F.col("o_orderkey").cast("string"), F.lit(".html")).alias("file_path"), F.lit("").alias("url"), F.col("o_orderpriority").alias("title"), F.lit("").alias("date"))


def group_by_year_list(s, d):
    got = sinks.by_year(entries(s, d)).select("court", "total", F.explode("by_year").alias("year", "e"))
    return got.select("court", n("total"), "year", F.size("e").cast("long").alias("n"), F.md5(F.array_join(F.transform("e", lambda x: x["file_path"]), ",")).alias("paths"))


def index_files(s, d):
    """Indexes written as one JSON file a court, and their lines read back."""
    path = work_path(s, "index-files")
    index_writer.write(entries(s, d), path, "now")
    got = index_writer.read(s, path)
    return got.select("file", "court", "year", "file_path", "title")


def log_lines(s, d):
    """The middle third of a log of all documents' lengths, found by the positions of lines."""
    path = work_path(s, "log")
    table(s, d, "documents").orderBy("doc_id").select(F.to_json(F.struct("doc_id", F.char_length("text").alias("n_chars")))).write.text(path)
    index_path = work_path(s, "log-index")
    line_index.build(s, path).write.parquet(index_path)
    index = s.read.parquet(index_path)
    total = line_index.total(index)
    return line_index.records(index, total // 3, 2 * total // 3, "doc_id long, n_chars long")


def index_stats(s, d):
    got = stats.index_stats(entries(s, d).where("year <> ''"))
    return got.select("court", n("entries"), "first_year", "last_year")


def request_packing(s, d):
    got = sinks.request_packing(table(s, d, "documents").select(F.col("doc_id").alias("idx"), "text"), "model", 1536)
    return got.select(n("batch"), "custom_id", n("inputs"))


def insert_if_absent(s, d):
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")  # noqa: E741
    return sinks.insert_if_absent(l.where("l_returnflag = 'R'"), l, ["l_orderkey", "l_linenumber"], [F.col("l_quantity"), F.col("l_returnflag")])


def upsert_latest(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    old, new = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    return sinks.upsert(old, new, ["o_custkey"], "o_orderkey")


def resume_anti(s, d):
    done = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return sinks.resume(table(s, d, "customer").select("c_custkey"), done, ["c_custkey"])


def required_minus_existing(s, d):
    need = table(s, d, "nation").select(F.col("n_nationkey").alias("k"))
    return sinks.missing(need, table(s, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("k")))


def documents_table(s, d):
    """Rows as the document table stores them."""
    got = sinks.documents_table(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    return got.select("doc_id", F.md5("content").alias("md5"), F.size("terms").cast("long").alias("terms"))


def numbered_rows(s, d):
    """Positions as the chunk log has them."""
    return sinks.numbered(table(s, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", n("idx"))


def court_years(s, d):
    """Generated year pages of all courts."""
    return D.year_index_urls(s, "https://example.org").select("court_id", i("year"), "url")


# ---- evaluation


def hit_rate(s, d):
    got = stats.hit_rate(judged(s, d), query_key="query_id")
    return got.select(i("query_id"), n("high"), n("medium"), n("low"), n("none"), "hit_rate")


def _tracked(s, d):
    j = judged(s, d)
    cut = rerank.cutoff(rerank.keep_flags(j).where("eligible"), "query_id", "doc_id")
    truth = table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("item_id") % 3 + 1).cast("int")).alias("category"))
    return stats.ground_truth_tracking(truth, j.select("doc_id", F.col("bm25_rank").alias("rank")), cut.where("kept").select("doc_id", "place"), j.select("doc_id", "rating"))


def gt_tracking(s, d):
    return _tracked(s, d).select("doc_id", "category", i("source_rank"), i("rerank_place"), "rating")


def category_recall(s, d):
    return stats.category_recall(_tracked(s, d)).select("category", n("kept"), n("expected"))


def count_distinct_docs(s, d):
    return stats.distinct_documents(table(s, d, "labels").select("doc_id"), "doc_id").select(n("chunks"), n("documents"))


def duplicate_texts(s, d):
    """Texts that several documents have."""
    return stats.duplicates(table(s, d, "documents").select(F.md5("text").alias("md5")), "md5").select("md5", n("n"))


def token_cost(s, d):
    c = table(s, d, "conversations").select(F.element_at(F.array(*[F.lit(k) for k in D.PRICING]), (F.col("conv_id") % 3 + 1).cast("int")).alias("model"), F.when(F.col("role") == "user", F.char_length("text")).otherwise(0).alias("tokens_in"), F.when(F.col("role") != "user", F.char_length("text")).otherwise(0).alias("tokens_out"))
    return stats.token_usage(c, D.pricing(s)).select("model", n("tokens_in"), n("tokens_out"), "cost")


def last_user_message(s, d):
    return stats.last_user_message(table(s, d, "conversations"))


def display_progress(s, d):
    """Summaries that have arrived, by query."""
    j = judged(s, d)
    got = rerank.progress(j, j.where("n_chars % 3 <> 0"))
    return got.select(i("query_id"), n("summarized"), n("expected"), "percent", "all_done")


def sse_events(s, d):
    """Conversation turns as server-sent events."""
    data = F.to_json(F.struct("role", F.char_length("text").alias("n")))
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(sinks.event_text(F.lit("token"), data)).alias("md5"))


SESSIONS = """SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_s, floor(epoch(max(ts)) + 1800)::BIGINT AS end_s, count(*) AS events FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, k"""
YEARS = ", ".join(f"('{c}', '{b}', '{p}', {a}, {z})" for c, b, p, a, z in D.COURTS)
COST = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in D.PRICING.items())
WORDS = r"len(list_filter(regexp_split_to_array(regexp_replace(text, '[#*_\[\]()|>-]', ' ', 'g'), '\s+'), lambda w: w <> ''))"
TERMS = r"len(list_filter(regexp_split_to_array(lower(translate(text, chr(9) || chr(13), ' ')), '[^\p{L}\p{N}]+'), lambda w: w <> '' AND NOT list_contains([" + ", ".join(f"'{w}'" for w in D.STOP_WORDS) + "], w)))"
TRACKED = f"""{JUDGED}, k AS (SELECT doc_id, place FROM cut WHERE place <= least(75, greatest(30, strong))),
tr AS (SELECT item_id AS doc_id, ['A', 'B', 'C'][item_id % 3 + 1] AS category, bm25_rank, place, rating FROM benchmark b LEFT JOIN jud ON jud.doc_id = item_id LEFT JOIN k ON k.doc_id = item_id)"""

CATALOG = {
    "event_gap_max": (event_gap_max, "SELECT user_id, max(g)::BIGINT AS max_gap_s, count(*) AS events FROM (SELECT user_id, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS g FROM events) GROUP BY user_id"),
    "event_distribution": (event_distribution, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    "running_totals": (running_totals, "SELECT event_id, count(*) OVER w AS running_n, round(sum(value) OVER w, 4) AS running_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"),
    "event_seq": (event_seq, "SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS seq FROM events"),
    "session_windows_batch": (session_windows_batch, SESSIONS),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_totals": (stream_totals, "SELECT user_id, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY user_id"),
    "stream_gate": (stream_gate, GATE),
    "merge_log_latest": (merge_log_latest, "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_shipdate AS DATE) DESC, l_linenumber DESC, l_partkey DESC) AS r FROM lineitem) WHERE r = 1"),
    "indexed_lookup": (indexed_lookup, "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (0, 7, 77, 777, -1)"),
    "stream_event_log": (stream_event_log, "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS seq, md5('event: ' || event_type || chr(10) || 'data: x' || chr(10) || chr(10)) AS md5 FROM events"),
    "keep_alive": (keep_alive, "SELECT user_id, done // 5 AS batch, done, ts FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done, epoch_us(ts) AS ts FROM events) WHERE done % 5 = 0"),
    "answered": (answered, "SELECT a.user_id, a.event_id AS asked_id, b.event_id AS answer_id, (floor(epoch(b.ts)) - floor(epoch(a.ts)))::BIGINT AS after_s FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOURS"),
    "stream_windows": (stream_windows, "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "stats_by_court_format": (stats_by_court_format, f"SELECT source AS court, lang AS fmt, count(*) AS documents, sum({WORDS})::BIGINT AS words, sum(length(text))::BIGINT AS chars, sum(len(regexp_extract_all(text, '\\]\\([^)]*\\.md\\)')))::BIGINT AS refs, (sum({WORDS}) // count(*))::BIGINT AS avg_words FROM {DECISIONS} GROUP BY GROUPING SETS ((source), (lang), ())"),
    "group_by_year_list": (
        group_by_year_list,
        "WITH e AS (SELECT o_orderstatus AS court, CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE year(o_orderdate)::VARCHAR END AS year, '/x/' || o_orderkey || '.html' AS p FROM orders) SELECT court, (sum(count(*)) OVER (PARTITION BY court))::BIGINT AS total, year, count(*) AS n, md5(string_agg(p, ',' ORDER BY p)) AS paths FROM e GROUP BY court, year",
    ),
    "index_files": (index_files, "SELECT o_orderstatus || '.json' AS file, o_orderstatus AS court, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE year(o_orderdate)::VARCHAR END AS year, '/x/' || o_orderkey || '.html' AS file_path, o_orderpriority AS title FROM orders"),
    "log_lines": (log_lines, "SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id::BIGINT AS doc_id, length(text) AS n_chars FROM documents) WHERE idx >= (SELECT count(*) // 3 FROM documents) AND idx < (SELECT 2 * count(*) // 3 FROM documents)"),
    "index_stats": (index_stats, "SELECT o_orderstatus AS court, count(*) AS entries, min(year(o_orderdate))::VARCHAR AS first_year, max(year(o_orderdate))::VARCHAR AS last_year FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY ROLLUP (o_orderstatus)"),
    "request_packing": (request_packing, "SELECT b AS batch, 'b' || b || '-r' || (q * 100) || '-s' || (b * 50000 + q * 100) AS custom_id, n AS inputs FROM (SELECT doc_id // 50000 AS b, (doc_id % 50000) // 100 AS q, count(*) AS n FROM documents GROUP BY ALL)"),
    "insert_if_absent": (insert_if_absent, "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_returnflag) AS k FROM lineitem) l WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_orderkey = l.l_orderkey AND r.l_linenumber = l.l_linenumber)"),
    "upsert_latest": (upsert_latest, "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1"),
    "resume_anti": (resume_anti, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "required_minus_existing": (required_minus_existing, "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0"),
    "documents_table": (documents_table, f"SELECT doc_id::VARCHAR AS doc_id, md5(translate(text, chr(9) || chr(13), ' ')) AS md5, {TERMS} AS terms FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 50"),
    "numbered_rows": (numbered_rows, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders"),
    "court_years": (court_years, f"WITH c(court_id, base, pattern, a, z) AS (VALUES {YEARS}) SELECT court_id, y::INT AS year, 'https://example.org' || base || CASE pattern WHEN 'index_{{year}}' THEN 'index_' || y || '.html' ELSE y || '/index.html' END AS url FROM (SELECT *, unnest(range(a, z + 1)) AS y FROM c)"),
    "hit_rate": (hit_rate, f"WITH {JUDGED} SELECT query_id::INT AS query_id, count(*) FILTER (rating = 'HIGH') AS high, count(*) FILTER (rating = 'MEDIUM') AS medium, count(*) FILTER (rating = 'LOW') AS low, count(*) FILTER (rating = 'NONE') AS none, round(count(*) FILTER (rating IN ('HIGH', 'MEDIUM')) / greatest(count(*), 1), 6) AS hit_rate FROM jud GROUP BY query_id"),
    "gt_tracking": (gt_tracking, f"WITH {TRACKED} SELECT doc_id, category, bm25_rank::INT AS source_rank, place::INT AS rerank_place, rating FROM tr"),
    "category_recall": (category_recall, f"WITH {TRACKED} SELECT category, count(place) AS kept, count(*) AS expected FROM tr GROUP BY category"),
    "count_distinct_docs": (count_distinct_docs, "SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM labels"),
    "duplicate_texts": (duplicate_texts, "SELECT md5(text) AS md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "token_cost": (
        token_cost,
        f"WITH p(model, a, b) AS (VALUES {COST}), c AS (SELECT ['gpt-4o', 'o3-mini', 'claude'][conv_id % 3 + 1] AS model, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END)::BIGINT AS tokens_in, sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END)::BIGINT AS tokens_out FROM conversations GROUP BY 1) SELECT model, tokens_in, tokens_out, round(tokens_in / 1000000 * a::DOUBLE + tokens_out / 1000000 * b::DOUBLE, 6) AS cost FROM c JOIN p USING (model)",
    ),
    "last_user_message": (last_user_message, "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id"),
    "display_progress": (display_progress, f"WITH {JUDGED} SELECT query_id::INT AS query_id, count(*) FILTER (n_chars % 3 <> 0) AS summarized, count(*) AS expected, round(count(*) FILTER (n_chars % 3 <> 0) * 100 / count(*)) AS percent, count(*) FILTER (n_chars % 3 <> 0) >= count(*) AS all_done FROM jud GROUP BY query_id"),
    "sse_events": (sse_events, """SELECT conv_id, turn, md5('event: token' || chr(10) || 'data: {"role":"' || role || '","n":' || length(text) || '}' || chr(10) || chr(10)) AS md5 FROM conversations"""),
}

"""Analytics and audit queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import analytics as a
from corvane.operators import audit
from corvane.plans.governance import views
from corvane.plans.registry import query
from corvane.sources.views import duck, table

SINCE, UNTIL = "2024-01-05", "2024-01-20"
LOGS = f"WITH {duck('query_logs_v', 'answer_logs_v', 'citations_v', 'versions_v', 'documents_v', 'users_v', 'feedback_v', 'audit_v', 'conflicts_v', 'links_v', 'chunks_v')}"
INSIDE = f"created_at >= TIMESTAMP '{SINCE}' AND created_at < DATE '{UNTIL}' + 1"


@query(
    "l01_totals",
    f"""{LOGS} SELECT count(*) AS n, count(*) FILTER (outcome = 'answered') AS answered, count(*) FILTER (outcome = 'partial') AS partial, count(*) FILTER (outcome = 'abstained') AS abstained,
        quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95 FROM query_logs_v LEFT JOIN answer_logs_v USING (query_id)""",
)
def l01(spark, sf):
    return a.totals(*views(spark, sf, "query_logs_v", "answer_logs_v"))


@query("l01_sketched_percentiles")
def l01_sketched(spark, sf):
    """Latency percentiles of weeks, from sketches of days."""
    days = a.latency_sketches(table(spark, sf, "query_logs_v"))
    return a.sketched_percentiles(days.withColumn("week", F.date_trunc("week", "day")), ["week"])


@query("l02_routes_and_reasons", f"{LOGS} SELECT route, abstain_reason, count(*) AS n FROM query_logs_v JOIN answer_logs_v USING (query_id) GROUP BY 1, 2")
def l02(spark, sf):
    q, r = views(spark, sf, "query_logs_v", "answer_logs_v")
    return q.join(r, "query_id").groupBy("route", "abstain_reason").agg(F.count("*").alias("n"))


@query("l03_top_questions", f"{LOGS} SELECT lower(question) AS question, count(*) AS n FROM query_logs_v GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def l03(spark, sf):
    return a.top_questions(table(spark, sf, "query_logs_v"))


@query("l03_top_unanswered", f"{LOGS} SELECT lower(question) AS question, count(*) AS n FROM query_logs_v JOIN answer_logs_v USING (query_id) WHERE abstain_reason = 'not_found' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def l03b(spark, sf):
    return a.top_unanswered(*views(spark, sf, "query_logs_v", "answer_logs_v"))


@query("l04_top_documents", f"{LOGS} SELECT doc_code, count(*) AS n FROM citations_v JOIN versions_v USING (version_id) JOIN documents_v USING (document_id) JOIN query_logs_v ON answer_id = query_id GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def l04(spark, sf):
    return a.top_documents(*views(spark, sf, "citations_v", "versions_v", "documents_v", "query_logs_v"))


DAILY = "daily_v AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n, count(*) FILTER (outcome = 'abstained') AS declined FROM query_logs_v LEFT JOIN answer_logs_v USING (query_id) GROUP BY 1)"


@query("l05_daily_series", f"{LOGS}, {DAILY} SELECT * FROM daily_v")
def l05(spark, sf):
    return a.daily(*views(spark, sf, "query_logs_v", "answer_logs_v"))


@query(
    "l06_filled_daily_series",
    f"""{LOGS}, {DAILY} SELECT CAST(d AS DATE) AS day, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(declined, 0) AS BIGINT) AS declined, CAST(coalesce(n, 0) - coalesce(declined, 0) AS BIGINT) AS handled
        FROM (SELECT unnest(generate_series(DATE '2023-12-01', DATE '2024-03-31', INTERVAL 1 DAY)) AS d) LEFT JOIN daily_v ON day = CAST(d AS DATE)""",
)
def l06(spark, sf):
    return a.filled_daily(a.daily(*views(spark, sf, "query_logs_v", "answer_logs_v")), "2023-12-01", "2024-03-31")


@query("l07_abstention_rate", f"{LOGS} SELECT round(count(*) FILTER (outcome = 'abstained') / count(*), 4) AS rate FROM answer_logs_v")
def l07(spark, sf):
    return a.abstention_rate(table(spark, sf, "answer_logs_v"))


@query(
    "l07_queue_counts",
    f"""{LOGS} SELECT 'open conflicts' AS queue, count(*) AS n FROM conflicts_v WHERE status = 'open' UNION ALL SELECT 'feedback', count(*) FROM feedback_v WHERE status <> 'resolved' AND kind <> 'helpful'
        UNION ALL SELECT 'unconfirmed links', count(*) FROM links_v WHERE NOT confirmed UNION ALL SELECT 'drafts ready', count(*) FROM versions_v WHERE status = 'draft' AND ingest_status = 'ready'""",
)
def l07b(spark, sf):
    return a.queue_counts(*views(spark, sf, "conflicts_v", "feedback_v", "links_v", "versions_v"))


@query(
    "l08_usage_counters",
    f"""{LOGS}, newest AS (SELECT * FROM query_logs_v ORDER BY created_at DESC, query_id DESC LIMIT 5000), j AS (SELECT * FROM newest LEFT JOIN answer_logs_v USING (query_id))
        SELECT 'mode' AS counter, coalesce(generation_mode, 'not drafted') AS "value", count(*) AS n FROM j GROUP BY 2 UNION ALL SELECT 'route', route, count(*) FROM j GROUP BY 2
        UNION ALL SELECT 'redacted', CAST(pii_redacted AS VARCHAR), count(*) FROM j GROUP BY 2""",
)
def l08(spark, sf):
    return a.usage_counters(*views(spark, sf, "query_logs_v", "answer_logs_v"))


@query("l09_stage_means", "SELECT stage, round(avg(ms), 1) AS mean_ms FROM (SELECT unnest(['route', 'total']) AS stage, unnest([CAST(json_extract_string(props, '$.k') AS DOUBLE), floor(value)]) AS ms FROM events) WHERE ms IS NOT NULL GROUP BY 1")
def l09(spark, sf):
    k = F.from_json("props", "k double")["k"]
    timings = F.create_map(F.lit("route"), k, F.lit("total"), F.floor("value").cast("double"), F.lit("other"), k)
    return a.stage_means(table(spark, sf, "events").select(timings.alias("timings")))


@query(
    "l10_decision_trace",
    f"""{LOGS}, latest AS (SELECT * FROM query_logs_v ORDER BY created_at DESC, query_id DESC LIMIT 25) SELECT l.query_id, outcome, coalesce(cited, '') AS cited FROM latest l LEFT JOIN answer_logs_v USING (query_id)
        LEFT JOIN (SELECT answer_id, string_agg(doc_code || ' ' || version_label, '; ' ORDER BY marker) AS cited FROM citations_v JOIN versions_v USING (version_id) JOIN documents_v USING (document_id) GROUP BY 1) c ON c.answer_id = l.query_id""",
)
def l10(spark, sf):
    return a.decision_trace(*views(spark, sf, "query_logs_v", "answer_logs_v", "citations_v", "versions_v", "documents_v"))


@query(
    "l11_user_usage",
    f"""{LOGS}, q AS (SELECT user_id, count(*) AS questions, count(*) FILTER (outcome = 'answered') AS answered, count(*) FILTER (outcome = 'partial') AS partial, count(*) FILTER (outcome = 'abstained') AS abstained, max(created_at) AS last_question
        FROM query_logs_v LEFT JOIN answer_logs_v USING (query_id) WHERE {INSIDE} GROUP BY 1),
    d AS (SELECT actor_user_id AS user_id, count(*) FILTER (action = 'document.upload') AS uploads, count(*) FILTER (action IN ('document.approve', 'conflict.resolve', 'feedback.resolve')) AS reviews, max(created_at) AS last_action FROM audit_v WHERE {INSIDE} GROUP BY 1)
    SELECT user_id, display_name, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("questions", "answered", "partial", "abstained", "uploads", "reviews"))}, greatest(last_question, last_action) AS last_active
    FROM users_v LEFT JOIN q USING (user_id) LEFT JOIN d USING (user_id)""",
)
def l11(spark, sf):
    return a.user_usage(*views(spark, sf, "users_v", "query_logs_v", "answer_logs_v", "audit_v"), SINCE, UNTIL)


@query(
    "l12_amendment_list",
    f"""{LOGS} SELECT link_id, s.doc_code || ' ' || v.version_label AS source, t.doc_code || ' ' || coalesce('§' || target_section_path, '(whole document)') AS target, confirmed
        FROM links_v JOIN versions_v v ON source_version_id = v.version_id JOIN documents_v s ON s.document_id = v.document_id JOIN documents_v t ON t.document_id = target_document_id""",
)
def l12(spark, sf):
    return a.amendment_list(*views(spark, sf, "links_v", "versions_v", "documents_v"))


@query(
    "l13_conflict_list",
    f"""{LOGS}, label AS (SELECT chunk_id, doc_code || ' §' || section_path AS label FROM chunks_v JOIN versions_v USING (version_id) JOIN documents_v USING (document_id))
        SELECT conflict_id, status, a.label AS label_a, b.label AS label_b FROM conflicts_v JOIN label a ON a.chunk_id = chunk_a JOIN label b ON b.chunk_id = chunk_b WHERE status = 'open'""",
)
def l13(spark, sf):
    return a.conflict_list(*views(spark, sf, "conflicts_v", "chunks_v", "versions_v", "documents_v"), status="open")


@query("l14_feedback_inbox", f"{LOGS} SELECT feedback_id, kind FROM feedback_v WHERE status <> 'resolved' AND kind <> 'helpful' AND routed_to = 3")
def l14(spark, sf):
    return a.feedback_inbox(table(spark, sf, "feedback_v"), 3).select("feedback_id", "kind")


@query(
    "l15_route_feedback",
    f"""{LOGS}, o AS (SELECT answer_id, arg_min(owner_id, (marker, citation_id)) AS owner_id FROM citations_v JOIN versions_v USING (version_id) JOIN documents_v USING (document_id) WHERE owner_id IS NOT NULL GROUP BY 1),
        adm AS (SELECT arg_min(user_id, email) AS admin_id FROM users_v WHERE role = 'admin' AND is_active) SELECT feedback_id, CASE WHEN kind <> 'helpful' THEN coalesce(owner_id, admin_id) END AS routed_to FROM feedback_v LEFT JOIN o USING (answer_id), adm""",
)
def l15(spark, sf):
    return a.route_feedback(*views(spark, sf, "feedback_v", "citations_v", "versions_v", "documents_v", "users_v"))


@query("l16_history", f"{LOGS} SELECT user_id, CAST(place AS INTEGER) AS place, query_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, query_id DESC) AS place FROM query_logs_v) LEFT JOIN answer_logs_v USING (query_id) WHERE place <= 10")
def l16(spark, sf):
    return a.history(*views(spark, sf, "query_logs_v", "answer_logs_v"))


@query("l17_chunk_counts", f"{LOGS} SELECT version_id, count(chunk_id) AS n_chunks FROM versions_v LEFT JOIN chunks_v USING (version_id) GROUP BY 1")
def l17(spark, sf):
    return a.chunk_counts(*views(spark, sf, "versions_v", "chunks_v"))


@query("l18_task_usage", "SELECT event_type AS task, count(*) AS calls, count(*) FILTER (user_id % 7 = 0) AS failures, count(*) FILTER (user_id % 7 = 1) AS timeouts, round(avg(event_id % 100), 1) AS mean_ms FROM events GROUP BY 1")
def l18(spark, sf):
    r = F.when(F.col("user_id") % 7 == 0, "failed").when(F.col("user_id") % 7 == 1, "timeout").otherwise("ok")
    return a.task_usage(table(spark, sf, "events").select(F.col("event_type").alias("task"), r.alias("result"), (F.col("event_id") % 100).alias("ms")))


RECORD = """'{"action":"' || action || '","actor_user_id":"' || actor_user_id || '","created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","entity_id":' || coalesce('"' || entity_id || '"', 'null')
    || ',"entity_type":"' || entity_type || '","payload":' || CAST(json(payload) AS VARCHAR) || '}'"""


def day_chains(spark, sf):
    """The audit log chained per day."""
    return audit.append_chain(table(spark, sf, "audit_v").withColumn("chain", F.to_date("created_at")), "chain")


@query(
    "l19_verify_chain",
    f"""WITH {duck('audit_v')}, e AS (SELECT CAST(created_at AS DATE) AS chain, seq, row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY seq) AS place FROM audit_v),
        b AS (SELECT chain, min(seq) FILTER (seq % 997 = 0) AS changed, count(*) AS n FROM e GROUP BY 1)
        SELECT b.chain, changed IS NULL AS ok, CAST(coalesce(place - 1, n) AS BIGINT) AS events_checked, changed AS first_bad_seq, CASE WHEN changed IS NOT NULL THEN 'content changed' END AS reason FROM b LEFT JOIN e ON e.seq = changed""",
)
def l19(spark, sf):
    """Chains of the audit log, one a day, after some rows were changed."""
    changed = day_chains(spark, sf).withColumn("action", F.when(F.col("seq") % 997 == 0, "changed").otherwise(F.col("action")))
    return audit.verify_chains(changed, "chain")


@query(
    "l19_verify_whole_log",
    f"""WITH {duck('audit_v')}, e AS (SELECT seq, row_number() OVER (ORDER BY seq) AS place FROM audit_v), b AS (SELECT min(seq) FILTER (seq % 4999 = 7) AS changed, count(*) AS n FROM e)
        SELECT changed IS NULL AS ok, CAST(coalesce(place - 1, n) AS BIGINT) AS events_checked, changed AS first_bad_seq, CASE WHEN changed IS NOT NULL THEN 'content changed' END AS reason FROM b LEFT JOIN e ON e.seq = changed""",
)
def l19b(spark, sf):
    """The whole audit log as one chain, after some rows were changed."""
    chained = audit.append_chain(table(spark, sf, "audit_v").withColumn("log", F.lit(1)), "log")
    return audit.verify_chain(chained.withColumn("action", F.when(F.col("seq") % 4999 == 7, "changed").otherwise(F.col("action"))))


@query(
    "l20_append_chain",
    f"""WITH RECURSIVE {duck('audit_v')}, r AS (SELECT CAST(created_at AS DATE) AS chain, seq, row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY seq) AS place, {RECORD} AS record FROM audit_v),
        c AS (SELECT chain, place, seq, sha256('{audit.GENESIS}' || record) AS hash FROM r WHERE place = 1 UNION ALL SELECT r.chain, r.place, r.seq, sha256(c.hash || r.record) FROM c JOIN r ON r.chain = c.chain AND r.place = c.place + 1)
        SELECT chain, seq, hash FROM c""",
)
def l20(spark, sf):
    return day_chains(spark, sf).select("chain", "seq", "hash")


@query("l21_retained", f"{LOGS} SELECT query_id FROM query_logs_v WHERE created_at >= DATE '2024-07-15' - 180")
def l21(spark, sf):
    return a.retained(table(spark, sf, "query_logs_v"), "2024-07-15").select("query_id")


@query("a06_audit_export", f"{LOGS} SELECT seq, action, entity_id, payload, display_name AS actor FROM (SELECT * FROM audit_v WHERE {INSIDE} AND starts_with(action, 'document.') ORDER BY created_at DESC, seq DESC LIMIT 1000) LEFT JOIN users_v ON user_id = actor_user_id")
def a06(spark, sf):
    return a.audit_export(*views(spark, sf, "audit_v", "users_v"), SINCE, UNTIL, "document.")


@query("s07_stale_jobs", f"{LOGS} SELECT version_id FROM versions_v WHERE ingest_status = 'processing' AND created_at < TIMESTAMP '1997-01-01 00:00:00' - INTERVAL 900 SECOND")
def s07(spark, sf):
    return a.stale_jobs(table(spark, sf, "versions_v"), "1997-01-01 00:00:00").select("version_id")

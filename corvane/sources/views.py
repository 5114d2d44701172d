"""The governed-document tables as views over the given star-schema tables.

Each view is one SQL text that Spark and DuckDB both run, so queries and their defining SQL start alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "documents_v": """SELECT c_custkey AS document_id, concat('D-', CAST(c_custkey AS STRING)) AS doc_code, c_name AS title, lower(c_mktsegment) AS doc_type,
        c_nationkey % 5 AS department_id, c_custkey % 4 <> 0 AS network_wide, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 10 + 1 END AS owner_id FROM {customer}""",
    "document_branches_v": "SELECT c_custkey AS document_id, c_nationkey AS branch_id FROM {customer} WHERE c_custkey % 4 = 0",
    "branches_v": "SELECT n_nationkey AS branch_id, n_name AS branch_name FROM {nation}",
    "departments_v": "SELECT r_regionkey AS department_id, r_name AS department_name FROM {region}",
    "versions_v": """SELECT o_orderkey AS version_id, o_custkey AS document_id, concat('v', CAST(o_orderkey % 9 + 1 AS STRING)) AS version_label,
        CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'superseded' ELSE 'draft' END AS status, CAST(o_orderdate AS DATE) AS effective_from,
        CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS approved_at, CAST(CAST(o_orderdate AS DATE) + INTERVAL '730' DAY AS DATE) AS review_due,
        CASE WHEN o_orderkey % 10 < 8 THEN 'ready' WHEN o_orderkey % 10 = 8 THEN 'processing' ELSE 'failed' END AS ingest_status, o_orderdate AS created_at FROM {orders}""",
    "chunks_v": """SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS version_id, l_linenumber AS ordinal, min(l_partkey) AS part_id,
        concat(CAST(l_linenumber AS STRING), '.', CAST(min(l_partkey) % 5 AS STRING)) AS section_path, min(l_shipdate) AS updated_at FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "links_v": """SELECT o_orderkey AS link_id, o_orderkey AS source_version_id, o_custkey % (SELECT count(*) FROM {customer}) + 1 AS target_document_id,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 7 + 1 AS STRING)
            ELSE concat(CAST(o_orderkey % 7 + 1 AS STRING), '.', CAST(o_orderkey % 3 AS STRING)) END AS target_section_path,
        CAST(o_orderdate AS DATE) AS effective_from, o_orderkey % 3 <> 0 AS confirmed, o_orderdate AS created_at FROM {orders} WHERE o_orderpriority = '1-URGENT'""",
    "query_logs_v": """SELECT event_id AS query_id, user_id, ts AS created_at, concat('Question ', CAST(event_id % 50 AS STRING)) AS question,
        CASE WHEN event_type = 'error' THEN 'high_risk' ELSE 'answer' END AS route, value AS latency_ms, event_id % 9 = 0 AS pii_redacted, props FROM {events}""",
    "answer_logs_v": """SELECT event_id AS answer_id, event_id AS query_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'answered' WHEN event_type = 'view' THEN 'partial' ELSE 'abstained' END AS outcome,
        CASE event_type WHEN 'signup' THEN 'not_found' WHEN 'error' THEN 'high_risk' END AS abstain_reason,
        CASE event_id % 3 WHEN 0 THEN 'extractive' WHEN 1 THEN 'drafted' END AS generation_mode FROM {events} WHERE event_id % 11 <> 0""",
    "citations_v": """SELECT event_id * 10 + k AS citation_id, event_id AS answer_id, concat('S', CAST(k AS STRING)) AS marker, (event_id * 7 + k * 13) % (SELECT count(*) FROM {orders}) + 1 AS version_id,
        (event_id + k) % 5 <> 0 AS supported FROM {events} CROSS JOIN (SELECT CAST(1 AS BIGINT) AS k UNION ALL SELECT 2 UNION ALL SELECT 3) ks WHERE event_id % 11 <> 0 AND event_type IN ('click', 'purchase', 'view')""",
    "users_v": """SELECT s_suppkey AS user_id, s_name AS display_name, concat('user', CAST(s_suppkey AS STRING), '@example.org') AS email,
        CASE s_suppkey % 4 WHEN 0 THEN 'clinician' WHEN 1 THEN 'author' WHEN 2 THEN 'approver' ELSE 'admin' END AS role, s_nationkey AS branch_id, s_nationkey % 5 AS department_id, s_suppkey % 6 <> 0 AS is_active FROM {supplier}""",
    "contacts_v": """SELECT s_suppkey AS contact_id, s_name AS role_label, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END AS branch_id, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey % 5 END AS department_id,
        CASE s_suppkey % 3 WHEN 0 THEN 'high_risk' WHEN 1 THEN 'not_found' ELSE '' END AS escalation_for, s_suppkey % 9 AS priority FROM {supplier}""",
    "feedback_v": """SELECT event_id AS feedback_id, event_id AS answer_id, CASE event_id % 3 WHEN 0 THEN 'helpful' WHEN 1 THEN 'wrong' ELSE 'outdated' END AS kind,
        CASE WHEN event_id % 5 = 0 THEN 'resolved' ELSE 'open' END AS status, user_id % 10 + 1 AS routed_to, ts AS created_at FROM {events} WHERE event_id % 4 = 1""",
    "conflicts_v": """SELECT o_orderkey AS conflict_id, o_orderkey * 10 + 1 AS chunk_a, o_orderkey * 10 + 2 AS chunk_b,
        CASE o_orderkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'dismissed' END AS status, o_orderdate AS created_at FROM {orders} WHERE o_orderkey % 6 < 4""",
    "audit_v": """SELECT event_id AS seq, ts AS created_at, user_id % 40 + 1 AS actor_user_id, concat(CASE event_type WHEN 'click' THEN 'document.approve' WHEN 'view' THEN 'document.upload' WHEN 'purchase' THEN 'conflict.resolve'
        WHEN 'signup' THEN 'feedback.resolve' ELSE 'auth.login' END, '') AS action, CASE event_type WHEN 'click' THEN 'document' WHEN 'view' THEN 'document' WHEN 'purchase' THEN 'conflict'
        WHEN 'signup' THEN 'feedback' ELSE 'auth' END AS entity_type, CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 100 AS STRING) END AS entity_id, props AS payload FROM {events}""",
    "passages_v": """SELECT d.doc_id AS chunk_id, v.version_id AS version_id, v.document_id AS document_id, concat(CAST(d.doc_id % 7 + 1 AS STRING), '.', CAST(d.doc_id % 3 AS STRING)) AS section_path
        FROM (SELECT doc_id, doc_id % (SELECT count(*) FROM {customer}) + 1 AS governed FROM {documents} WHERE text IS NOT NULL) d JOIN (SELECT o_orderkey AS version_id, o_custkey AS document_id,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS nth, count(*) OVER (PARTITION BY o_custkey) AS n FROM {orders}) v ON v.document_id = d.governed AND v.nth = d.doc_id % v.n""",
    "questions_v": """SELECT item_id AS question_id, text AS question, CASE WHEN item_id % 5 < 4 THEN CAST(item_id % 25 AS INT) END AS branch_id,
        make_date(CAST(1994 + item_id % 5 AS INT), CAST(item_id * 5 % 12 + 1 AS INT), 15) AS as_of FROM {benchmark}""",
    "chunk_texts_v": """SELECT doc_id AS chunk_id, text, lang, source FROM {documents} WHERE text IS NOT NULL""",
}

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over given tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{b: table(spark, sf_dir, b) for b in BASE if "{" + b + "}" in text})


def duck(*names: str) -> str:
    """The views as the start of a DuckDB WITH clause."""
    return ",\n".join(f"{n} AS ({VIEWS[n].format(**{b: b for b in BASE})})" for n in names)

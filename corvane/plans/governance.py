"""Governance queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import governance as g
from corvane.plans.registry import query
from corvane.sources.views import duck, table

AS_OF = "1998-06-30"
BRANCH = 3

CURRENT = f"""current_v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY effective_from DESC, approved_at DESC NULLS LAST, version_id DESC) AS place
    FROM versions_v WHERE status = 'approved' AND effective_from <= DATE '{AS_OF}') WHERE place = 1)"""
ACTIVE = f"""active_v AS (SELECT l.* FROM links_v l WHERE confirmed AND effective_from <= DATE '{AS_OF}'
    AND source_version_id IN (SELECT version_id FROM versions_v WHERE status IN ('approved', 'superseded')))"""
MATCH = "(target_section_path IS NULL OR target_section_path = section_path OR starts_with(section_path, target_section_path || '.') OR starts_with(section_path, target_section_path || '#') OR starts_with(section_path, target_section_path || '('))"
SCOPE = f"scope_v AS (SELECT document_id FROM documents_v WHERE network_wide UNION SELECT document_id FROM document_branches_v WHERE branch_id = {BRANCH})"
HIDDEN = f"""hidden_v AS (SELECT DISTINCT chunk_id FROM (SELECT c.*, v.document_id FROM chunks_v c JOIN versions_v v USING (version_id)) c
    JOIN active_v ON target_document_id = c.document_id AND {MATCH})"""
ELIGIBLE = """eligible_v AS (SELECT c.*, v.document_id FROM chunks_v c JOIN current_v v USING (version_id) WHERE v.document_id IN (SELECT document_id FROM scope_v) AND chunk_id NOT IN (SELECT chunk_id FROM hidden_v))"""
BASE = f"WITH {duck('documents_v', 'document_branches_v', 'versions_v', 'chunks_v', 'links_v')},\n{CURRENT},\n{ACTIVE},\n{SCOPE},\n{HIDDEN},\n{ELIGIBLE}\n"


def views(spark, sf, *names):
    return [table(spark, sf, n) for n in names]


def eligible(spark, sf):
    """Chunks eligible for the branch as of the date."""
    chunks, versions, links, documents, branches = views(spark, sf, "chunks_v", "versions_v", "links_v", "documents_v", "document_branches_v")
    return g.eligible_chunks(chunks, versions, links, AS_OF, g.branch_scope(documents, branches, BRANCH))


@query("b01_current_versions", f"{BASE} SELECT document_id, version_id, effective_from FROM current_v")
def b01(spark, sf):
    return g.current_versions(table(spark, sf, "versions_v"), AS_OF).select("document_id", "version_id", "effective_from")


@query("b02_active_links", f"{BASE} SELECT link_id, target_document_id, target_section_path FROM active_v")
def b02(spark, sf):
    links, versions = views(spark, sf, "links_v", "versions_v")
    return g.active_links(links, versions, AS_OF).select("link_id", "target_document_id", "target_section_path")


@query("b03_section_matches", f"{BASE} SELECT link_id, count(*) AS n FROM (SELECT DISTINCT section_path FROM chunks_v) JOIN links_v ON {MATCH} GROUP BY link_id")
def b03(spark, sf):
    chunks, links = views(spark, sf, "chunks_v", "links_v")
    paths = chunks.select("section_path").distinct()
    return g.section_match_counts(paths, links)


@query("b04_superseded_chunks", f"{BASE} SELECT chunk_id FROM hidden_v")
def b04(spark, sf):
    chunks, versions, links = views(spark, sf, "chunks_v", "versions_v", "links_v")
    return g.superseded_chunks(g.with_document(chunks, versions), g.active_links(links, versions, AS_OF))


@query("b05_branch_scope", f"{BASE} SELECT document_id FROM scope_v")
def b05(spark, sf):
    documents, branches = views(spark, sf, "documents_v", "document_branches_v")
    return g.branch_scope(documents, branches, BRANCH)


@query("b06_eligible_chunks", f"{BASE} SELECT chunk_id, document_id, section_path FROM eligible_v")
def b06(spark, sf):
    return eligible(spark, sf).select("chunk_id", "document_id", "section_path")


@query(
    "b06_eligible_by_branch",
    f"""{BASE} SELECT n_nationkey AS branch_id, CAST((SELECT count(*) FROM chunks_v c JOIN current_v v USING (version_id) WHERE chunk_id NOT IN (SELECT chunk_id FROM hidden_v)
        AND v.document_id IN (SELECT document_id FROM documents_v WHERE network_wide UNION SELECT document_id FROM document_branches_v b WHERE b.branch_id = n_nationkey)) AS BIGINT) AS n_chunks FROM nation""",
)
def b06_all(spark, sf):
    return g.eligible_by_branch(*views(spark, sf, "chunks_v", "versions_v", "links_v", "documents_v", "document_branches_v", "branches_v"), AS_OF)


@query(
    "b07_drop_reasons",
    f"""{BASE} SELECT CASE WHEN v.status <> 'approved' THEN 'status: ' || v.status WHEN v.version_id NOT IN (SELECT version_id FROM current_v) THEN 'not current'
        WHEN chunk_id IN (SELECT chunk_id FROM hidden_v) THEN 'superseded' WHEN v.document_id NOT IN (SELECT document_id FROM scope_v) THEN 'other branch' END AS drop_reason, count(*) AS n
        FROM chunks_v JOIN versions_v v USING (version_id) GROUP BY 1""",
)
def b07(spark, sf):
    chunks, versions, links, documents, branches = views(spark, sf, "chunks_v", "versions_v", "links_v", "documents_v", "document_branches_v")
    marked = g.with_drop_reason(chunks, versions, links, AS_OF, g.branch_scope(documents, branches, BRANCH))
    return marked.groupBy("drop_reason").agg(F.count("*").alias("n"))


@query(
    "b08_refresh_statuses",
    f"""{BASE} SELECT v.version_id, v.status, CASE WHEN v.status = 'approved' AND v.version_id <> c.version_id AND v.effective_from <= c.effective_from THEN 'superseded' ELSE v.status END AS new_status
        FROM versions_v v LEFT JOIN current_v c USING (document_id)""",
)
def b08(spark, sf):
    return g.refresh_statuses(table(spark, sf, "versions_v"), AS_OF)


@query(
    "b09_amends",
    f"""{BASE} SELECT source_version_id AS version_id, string_agg(doc_code || ' §' || coalesce(target_section_path, ''), '; ' ORDER BY doc_code, coalesce(target_section_path, '')) AS amends
        FROM links_v JOIN documents_v ON target_document_id = document_id WHERE confirmed AND effective_from <= DATE '{AS_OF}' GROUP BY 1""",
)
def b09(spark, sf):
    links, documents = views(spark, sf, "links_v", "documents_v")
    return g.amends(links, documents, AS_OF)


@query(
    "b10_hides_sections",
    f"""{BASE} SELECT link_id, string_agg(section_path, ',' ORDER BY ordinal, section_path) AS sections FROM (SELECT link_id, section_path, min(ordinal) AS ordinal
        FROM chunks_v JOIN current_v v USING (version_id) JOIN links_v ON target_document_id = v.document_id AND {MATCH} GROUP BY 1, 2) GROUP BY 1""",
)
def b10(spark, sf):
    links, chunks, versions = views(spark, sf, "links_v", "chunks_v", "versions_v")
    return g.hides_sections(links, chunks, versions, AS_OF)


@query(
    "b11_clause_neighbours",
    f"WITH {duck('chunks_v')} SELECT chunk_id, lag(chunk_id) OVER o AS previous_id, lead(chunk_id) OVER o AS next_id FROM chunks_v WINDOW o AS (PARTITION BY version_id ORDER BY ordinal)",
)
def b11(spark, sf):
    return g.clause_neighbours(table(spark, sf, "chunks_v"))


@query(
    "b11_clause_view",
    f"""{BASE}, hiding AS (SELECT chunk_id, string_agg(l.link_id || ':' || s.version_label || ':' || coalesce(l.target_section_path, ''), ',' ORDER BY l.effective_from, l.link_id) AS superseded_by
            FROM (SELECT c.*, v.document_id FROM chunks_v c JOIN versions_v v USING (version_id)) c JOIN active_v l ON l.target_document_id = c.document_id AND {MATCH} JOIN versions_v s ON s.version_id = l.source_version_id GROUP BY 1),
        amended AS (SELECT source_version_id AS version_id, string_agg(doc_code || coalesce(' §' || target_section_path, ''), '; ' ORDER BY doc_code, target_section_path NULLS FIRST) AS amends FROM links_v JOIN documents_v ON document_id = target_document_id WHERE confirmed GROUP BY 1),
        near AS (SELECT chunk_id, version_id, lag(chunk_id) OVER o AS previous_id, lead(chunk_id) OVER o AS next_id FROM chunks_v WINDOW o AS (PARTITION BY version_id ORDER BY ordinal))
        SELECT chunk_id, doc_code, previous_id, next_id, coalesce(w.version_id = v.version_id, false) AS is_current, CASE WHEN w.version_id <> v.version_id THEN w.version_id END AS newer_id, coalesce(superseded_by, '') AS superseded_by, coalesce(amends, '') AS amends
        FROM near n JOIN versions_v v USING (version_id) JOIN documents_v d ON d.document_id = v.document_id LEFT JOIN current_v w ON w.document_id = v.document_id LEFT JOIN hiding USING (chunk_id) LEFT JOIN amended ON amended.version_id = v.version_id""",
)
def b11_view(spark, sf):
    """Every clause with its neighbours, what supersedes it, what its version amends and the newer version."""
    full = g.clause_view(*views(spark, sf, "chunks_v", "versions_v", "links_v", "documents_v"), AS_OF)
    section = lambda x, sign: F.coalesce(F.concat(F.lit(sign), x["section_path"]), F.lit(""))
    by = F.array_join(F.transform("superseded_by", lambda x: F.concat(x["link_id"].cast("string"), F.lit(":"), x["version_label"], F.lit(":"), F.coalesce(x["section_path"], F.lit("")))), ",")
    amends = F.array_join(F.transform("amends", lambda x: F.concat(x["doc_code"], section(x, " §"))), "; ")
    return full.select("chunk_id", "doc_code", "previous_id", "next_id", "is_current", F.col("newer_version.version_id").alias("newer_id"), by.alias("superseded_by"), amends.alias("amends"))


@query("b11_clause_outline", f"WITH {duck('chunks_v')} SELECT version_id, string_agg(section_path, ',' ORDER BY ordinal) AS outline FROM chunks_v GROUP BY 1")
def b11_outline(spark, sf):
    return g.clause_outline(table(spark, sf, "chunks_v")).select("version_id", F.array_join(F.transform("outline", lambda x: x["section_path"]), ",").alias("outline"))


@query(
    "b12_catalogue",
    f"""{BASE} SELECT d.document_id, doc_code, CAST(coalesce(n_versions, 0) AS BIGINT) AS n_versions, CAST(coalesce(n_drafts, 0) AS BIGINT) AS n_drafts, CAST(coalesce(f.n_chunks, 0) AS BIGINT) AS n_chunks, next_review, newest_label,
        coalesce(next_review < DATE '{AS_OF}', false) AS overdue FROM documents_v d LEFT JOIN (SELECT document_id, count(*) AS n_versions, count(*) FILTER (status = 'draft') AS n_drafts, sum(n) AS n_chunks,
        min(review_due) FILTER (status = 'approved') AS next_review, arg_max(version_label, (effective_from, created_at, version_id)) AS newest_label
        FROM versions_v LEFT JOIN (SELECT version_id, count(*) AS n FROM chunks_v GROUP BY 1) USING (version_id) GROUP BY 1) f USING (document_id)
        WHERE doc_type = 'building' AND contains(lower(doc_code) || ' ' || lower(title), '1')""",
)
def b12(spark, sf):
    return g.catalogue(*views(spark, sf, "documents_v", "versions_v", "chunks_v"), AS_OF, doc_type="building", text="1")


@query(
    "b13_review_reminders",
    f"""{BASE} SELECT doc_code, version_label, version_id, review_due, review_due < DATE '{AS_OF}' AS overdue FROM versions_v JOIN documents_v USING (document_id)
        WHERE status = 'approved' AND review_due <= DATE '{AS_OF}' + 30""",
)
def b13(spark, sf):
    return g.review_reminders(*views(spark, sf, "versions_v", "documents_v"), AS_OF)


@query("b14_stale_documents", f"{BASE} SELECT doc_code, version_id, CAST(DATE '{AS_OF}' - review_due AS INTEGER) AS days_overdue FROM versions_v JOIN documents_v USING (document_id) WHERE status = 'approved' AND review_due < DATE '{AS_OF}'")
def b14(spark, sf):
    return g.stale_documents(*views(spark, sf, "versions_v", "documents_v"), AS_OF)


@query(
    "b15_approval_gate",
    f"""{BASE} SELECT CASE WHEN status <> 'draft' THEN 'not a draft' WHEN ingest_status <> 'ready' THEN 'not ready' WHEN version_id % 4 = 1 AND version_id % 3 <> 0 THEN 'needs acknowledgement' END AS blocked, count(*) AS n FROM versions_v GROUP BY 1""",
)
def b15(spark, sf):
    v = table(spark, sf, "versions_v")
    v = v.withColumn("warnings", F.when(F.col("version_id") % 4 == 1, F.array(F.lit("date_mismatch"), F.lit("ocr_low_confidence")))).withColumn("min_confidence", F.lit(0.7)).withColumn("acknowledged", F.col("version_id") % 3 == 0)
    return g.approval_gate(v).groupBy("blocked").agg(F.count("*").alias("n"))


@query("b16_lifecycle_fold", f"WITH {duck('audit_v')} SELECT entity_id, arg_max(action, seq) AS state, max(seq) AS last_seq, count(*) AS n_changes FROM audit_v GROUP BY 1")
def b16(spark, sf):
    return g.fold_states(table(spark, sf, "audit_v"))


CHANGES = """SELECT entity_id, seq, CAST(actor_user_id AS BIGINT) AS actor, CASE WHEN action = 'document.approve' THEN 'approve' WHEN action = 'document.upload' AND seq % 5 = 0 THEN 'retire'
    WHEN action = 'conflict.resolve' THEN CASE seq % 3 WHEN 0 THEN 'resolve' WHEN 1 THEN 'dismiss' ELSE 'reopen' END ELSE 'other' END AS change FROM {audit_v} WHERE entity_id IS NOT NULL"""


@query(
    "b16_version_states",
    f"""WITH {duck('audit_v')}, c AS ({CHANGES.format(audit_v="audit_v")}), f AS (SELECT entity_id, min(seq) FILTER (change = 'approve') AS a, min(seq) FILTER (change = 'retire') AS r FROM c GROUP BY 1)
        SELECT f.entity_id, CASE WHEN r IS NOT NULL THEN 'retired' WHEN a IS NOT NULL THEN 'approved' ELSE 'draft' END AS status, c.actor AS approved_by, c.seq AS approved_seq, r AS retired_seq FROM f LEFT JOIN c ON c.seq = f.a AND (r IS NULL OR a < r)""",
)
def b16b(spark, sf):
    return g.fold_versions(spark.sql(CHANGES, audit_v=table(spark, sf, "audit_v")))


@query(
    "b16_resolutions",
    f"""WITH {duck('audit_v')}, c AS ({CHANGES.format(audit_v="audit_v")}), l AS (SELECT entity_id, max(seq) FILTER (change IN ('resolve', 'dismiss', 'reopen')) AS last_seq FROM c GROUP BY 1)
        SELECT l.entity_id, CASE c.change WHEN 'resolve' THEN 'resolved' WHEN 'dismiss' THEN 'dismissed' ELSE 'open' END AS status, CASE WHEN c.change <> 'reopen' THEN c.actor END AS resolved_by, last_seq FROM l LEFT JOIN c ON c.seq = last_seq""",
)
def b16c(spark, sf):
    return g.fold_resolutions(spark.sql(CHANGES, audit_v=table(spark, sf, "audit_v")))


@query("b17_role_visibility", f"WITH {duck('versions_v')} SELECT status, count(*) AS n FROM versions_v WHERE status <> 'draft' GROUP BY 1")
def b17(spark, sf):
    return g.visible_versions(table(spark, sf, "versions_v"), "clinician").groupBy("status").agg(F.count("*").alias("n"))


REQUESTS = """SELECT event_id AS request_id, CAST(user_id % 25 AS INTEGER) AS branch_id, CASE event_type WHEN 'error' THEN 'high_risk' WHEN 'signup' THEN 'not_found' ELSE 'clarify' END AS reason, CAST(user_id % 5 AS INTEGER) AS department_id FROM {events}"""


@query(
    "b18_escalation_contacts",
    f"""WITH {duck("contacts_v")}, r AS ({REQUESTS.format(events="events")}),
    p AS (SELECT request_id, contact_id, escalation_for = reason AS named, coalesce(c.department_id = r.department_id, false) AS inside, c.branch_id IS NOT NULL AS local, priority FROM r JOIN contacts_v c ON (c.branch_id IS NULL OR c.branch_id = r.branch_id)
        WHERE reason NOT IN ('clarify', 'out_of_scope') AND (escalation_for = reason OR escalation_for = '') AND (c.department_id IS NULL OR c.department_id = r.department_id OR reason = 'high_risk'))
    SELECT request_id, contact_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY named DESC, inside DESC, local DESC, priority, contact_id) AS place FROM p) WHERE place <= 4""",
)
def b18(spark, sf):
    requests = spark.sql(REQUESTS, events=table(spark, sf, "events"))
    return g.escalation_contacts(requests, table(spark, sf, "contacts_v"))


@query("b19_contact_list", f"WITH {duck('contacts_v')} SELECT contact_id, role_label, priority FROM contacts_v WHERE branch_id IS NULL OR branch_id = {BRANCH}")
def b19(spark, sf):
    return g.contact_list(table(spark, sf, "contacts_v"), BRANCH)


@query(
    "b20_link_problems",
    f"""{BASE} SELECT link_id, coalesce(l.effective_from, v.effective_from) AS effective_from, CASE WHEN v.document_id IS NULL THEN 'no source' WHEN v.document_id = target_document_id THEN 'amends itself' END AS problem
        FROM links_v l LEFT JOIN versions_v v ON source_version_id = version_id""",
)
def b20(spark, sf):
    return g.link_problems(*views(spark, sf, "links_v", "versions_v"))

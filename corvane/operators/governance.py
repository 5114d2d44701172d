"""Which version of a document is in force, which clauses an amendment hides, and who may see what."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day(value: date | str) -> Column:
    return F.lit(str(value)).cast("date")


def current_versions(versions: DataFrame, as_of) -> DataFrame:
    """Per document the approved version in effect: the latest effective_from, then approval (nulls last), then id."""
    order = Window.partitionBy("document_id").orderBy(F.desc("effective_from"), F.desc_nulls_last("approved_at"), F.desc("version_id"))
    live = versions.filter((F.col("status") == "approved") & (F.col("effective_from") <= day(as_of)))
    return live.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def active_links(links: DataFrame, versions: DataFrame, as_of) -> DataFrame:
    """Confirmed links in effect whose source version is approved or superseded."""
    sources = versions.filter(F.col("status").isin("approved", "superseded")).select(F.col("version_id").alias("source_version_id"))
    return links.filter(F.col("confirmed") & (F.col("effective_from") <= day(as_of))).join(sources, "source_version_id", "left_semi")


def section_matches(target: Column, path: Column) -> Column:
    """A null target matches every path; else the path equals it or goes on with ``.``, ``#`` or ``(``."""
    deeper = F.lit(False)
    for sign in (".", "#", "("):
        deeper = deeper | path.startswith(F.concat(target, F.lit(sign)))
    return target.isNull() | F.coalesce(target.eqNullSafe(path) | deeper, F.lit(False))


def covered(section_path: Column, covered_paths: Column | None = None) -> Column:
    """The paths a chunk stands for; its own path where none are listed."""
    own = F.array(section_path)
    return own if covered_paths is None else F.when(F.size(F.coalesce(covered_paths, F.array().cast("array<string>"))) > 0, covered_paths).otherwise(own)


def superseded_chunks(chunks: DataFrame, active: DataFrame) -> DataFrame:
    """chunk_id of chunks (with document_id and paths) that an active link hides.

    The join is on the document, with the section test as its condition; which side is broadcast, if any, is
    left to the planner, which knows the sizes.
    """
    targets = active.select(F.col("target_document_id").alias("document_id"), "target_section_path")
    hit = (chunks["document_id"] == targets["document_id"]) & F.exists(chunks["paths"], lambda p: section_matches(targets["target_section_path"], p))
    return chunks.join(targets, hit, "left_semi").select("chunk_id")


def with_document(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks of versions with the document and the covered paths of each."""
    return chunks.join(versions.select("version_id", "document_id"), "version_id").withColumn("paths", covered(F.col("section_path")))


def branch_scope(documents: DataFrame, branches: DataFrame, branch_id: int | None) -> DataFrame:
    """Documents that apply to a branch: network-wide ones, and those assigned to it. None: network-wide only."""
    wide = documents.filter("network_wide").select("document_id")
    if branch_id is None:
        return wide
    return wide.union(branches.filter(F.col("branch_id") == branch_id).select("document_id")).distinct()


def eligible_chunks(chunks: DataFrame, versions: DataFrame, links: DataFrame, as_of, scope: DataFrame | None = None) -> DataFrame:
    """Chunks of current versions that no active link hides and, given a scope, whose document is in it."""
    current = current_versions(versions, as_of)
    own = with_document(chunks, current)
    if scope is not None:
        own = own.join(scope, "document_id", "left_semi")
    return own.join(superseded_chunks(own, active_links(links, versions, as_of)), "chunk_id", "left_anti")


def eligible_by_branch(chunks: DataFrame, versions: DataFrame, links: DataFrame, documents: DataFrame, document_branches: DataFrame, branches: DataFrame, as_of) -> DataFrame:
    """(branch_id, n_chunks) over all branches at once.

    Chunks are counted per document first; network-wide counts are added to each branch's own, so chunks are
    never multiplied by branches.
    """
    per_doc = eligible_chunks(chunks, versions, links, as_of).groupBy("document_id").agg(F.count("*").alias("n"))
    wide = per_doc.join(documents.filter("network_wide"), "document_id", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("wide"))
    own = per_doc.join(document_branches, "document_id").join(documents.filter("not network_wide"), "document_id", "left_semi").groupBy("branch_id").agg(F.sum("n").alias("own"))
    return branches.select("branch_id").join(own, "branch_id", "left").crossJoin(wide).select("branch_id", (F.coalesce("own", F.lit(0)) + F.col("wide")).alias("n_chunks"))


def with_drop_reason(chunks: DataFrame, versions: DataFrame, links: DataFrame, as_of, scope: DataFrame) -> DataFrame:
    """Every chunk with the first reason to drop it, or null: status, not current, superseded, not this branch."""
    current = current_versions(versions, as_of).select("version_id", F.lit(True).alias("is_current"))
    own = with_document(chunks, versions).join(versions.select("version_id", "status"), "version_id").join(current, "version_id", "left")
    hidden = superseded_chunks(own, active_links(links, versions, as_of)).withColumn("hidden", F.lit(True))
    inside = scope.withColumn("in_scope", F.lit(True))
    reason = (
        F.when(F.col("status") != "approved", F.concat(F.lit("status: "), "status"))
        .when(F.col("is_current").isNull(), F.lit("not current"))
        .when(F.col("hidden").isNotNull(), F.lit("superseded"))
        .when(F.col("in_scope").isNull(), F.lit("other branch"))
    )
    return own.join(hidden, "chunk_id", "left").join(inside, "document_id", "left").withColumn("drop_reason", reason)


def refresh_statuses(versions: DataFrame, as_of) -> DataFrame:
    """(version_id, status, new_status): approved versions no later than the current one, and not it, are superseded."""
    now = current_versions(versions, as_of).select("document_id", F.col("version_id").alias("current_id"), F.col("effective_from").alias("current_from"))
    old = (F.col("status") == "approved") & (F.col("version_id") != F.col("current_id")) & (F.col("effective_from") <= F.col("current_from"))
    return versions.join(now, "document_id", "left").select("version_id", "status", F.when(old, F.lit("superseded")).otherwise(F.col("status")).alias("new_status"))


def amends(links: DataFrame, documents: DataFrame, as_of) -> DataFrame:
    """(version_id, amends): target ``code §section`` of confirmed links in effect, by code, whole documents first."""
    named = links.filter(F.col("confirmed") & (F.col("effective_from") <= day(as_of))).join(documents.select(F.col("document_id").alias("target_document_id"), "doc_code"), "target_document_id")
    item = F.struct("doc_code", F.coalesce("target_section_path", F.lit("")).alias("section"))
    text = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["doc_code"], F.lit(" §"), x["section"]))
    return named.groupBy(F.col("source_version_id").alias("version_id")).agg(F.array_join(text, "; ").alias("amends"))


def hides_sections(links: DataFrame, chunks: DataFrame, versions: DataFrame, as_of) -> DataFrame:
    """(link_id, sections): paths of the target's current version that each link covers, whatever its status, in order."""
    own = with_document(chunks, current_versions(versions, as_of)).select(F.col("document_id").alias("target_document_id"), "paths", "section_path", "ordinal")
    hit = own.join(links.select("link_id", "target_document_id", "target_section_path"), "target_document_id").filter(F.exists("paths", lambda p: section_matches(F.col("target_section_path"), p)))
    first = hit.groupBy("link_id", "section_path").agg(F.min("ordinal").alias("ordinal"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "section_path"))), lambda x: x["section_path"])
    return first.groupBy("link_id").agg(F.array_join(ordered, ",").alias("sections"))


def clause_neighbours(chunks: DataFrame) -> DataFrame:
    """(chunk_id, previous_id, next_id) by ordinal within the version."""
    order = Window.partitionBy("version_id").orderBy("ordinal")
    return chunks.select("chunk_id", F.lag("chunk_id").over(order).alias("previous_id"), F.lead("chunk_id").over(order).alias("next_id"))


def catalogue(documents: DataFrame, versions: DataFrame, chunks: DataFrame, as_of, *, status=None, doc_type=None, department=None, text=None, overdue=None) -> DataFrame:
    """One row per document: versions, drafts, chunks, next review over approved versions, overdue; filters optional."""
    docs = documents
    if doc_type is not None:
        docs = docs.filter(F.col("doc_type") == doc_type)
    if department is not None:
        docs = docs.filter(F.col("department_id") == department)
    if text is not None:
        docs = docs.filter(F.contains(F.lower("doc_code"), F.lit(text.lower())) | F.contains(F.lower("title"), F.lit(text.lower())))
    if status is not None:
        docs = docs.join(versions.filter(F.col("status") == status), "document_id", "left_semi")
    sized = versions.join(chunks.groupBy("version_id").agg(F.count("*").alias("n_chunks")), "version_id", "left")
    facts = sized.groupBy("document_id").agg(
        F.count("*").alias("n_versions"),
        F.count_if(F.col("status") == "draft").alias("n_drafts"),
        F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"),
        F.min(F.when(F.col("status") == "approved", F.col("review_due"))).alias("next_review"),
        F.max_by("version_label", F.struct("effective_from", "created_at", "version_id")).alias("newest_label"),
    )
    out = docs.join(facts, "document_id", "left").select(
        "document_id", "doc_code", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_versions", "n_drafts", "n_chunks")), "next_review", "newest_label", F.coalesce(F.col("next_review") < day(as_of), F.lit(False)).alias("overdue")
    )
    return out if overdue is None else out.filter(F.col("overdue") == overdue)


def review_reminders(versions: DataFrame, documents: DataFrame, today, horizon_days: int = 30) -> DataFrame:
    """Approved versions due for review within the horizon, with an overdue flag."""
    due = versions.filter((F.col("status") == "approved") & (F.col("review_due") <= F.date_add(day(today), horizon_days)))
    return due.join(documents.select("document_id", "doc_code"), "document_id").select("doc_code", "version_label", "version_id", "review_due", (F.col("review_due") < day(today)).alias("overdue"))


def stale_documents(versions: DataFrame, documents: DataFrame, today) -> DataFrame:
    """Approved versions past review, with the days they are overdue."""
    late = versions.filter((F.col("status") == "approved") & (F.col("review_due") < day(today)))
    return late.join(documents.select("document_id", "doc_code"), "document_id").select("doc_code", "version_id", F.datediff(day(today), "review_due").alias("days_overdue"))


def approval_gate(versions: DataFrame, warnings: str = "warnings", minimum: str = "min_confidence", acknowledged: str = "acknowledged") -> DataFrame:
    """Versions with ``blocked``: null if a draft may be approved, else the first reason against it."""
    needs = F.col(minimum).isNotNull() & ~F.coalesce(F.col(acknowledged), F.lit(False)) & F.exists(F.coalesce(F.col(warnings), F.array().cast("array<string>")), lambda w: w == "ocr_low_confidence")
    reason = F.when(F.col("status") != "draft", F.lit("not a draft")).when(F.col("ingest_status") != "ready", F.lit("not ready")).when(needs, F.lit("needs acknowledgement"))
    return versions.withColumn("blocked", reason)


def fold_states(changes: DataFrame, key: str = "entity_id", order: str = "seq", state: str = "action") -> DataFrame:
    """The last state and the number of changes of each entity of a change log."""
    return changes.groupBy(key).agg(F.max_by(state, order).alias("state"), F.max(order).alias("last_seq"), F.count("*").alias("n_changes"))


def fold_versions(changes: DataFrame, key: str = "entity_id") -> DataFrame:
    """(key, status, approved_by, approved_seq, retired_seq) of versions after changes (key, seq, change, actor).

    Only a draft can be approved, so the first approval counts, and none after the first retirement; retirement is final.
    """
    first = lambda change: F.min(F.when(F.col("change") == change, F.struct("seq", "actor")))
    each = changes.groupBy(key).agg(first("approve").alias("a"), first("retire").alias("r"))
    approved = F.when(F.col("r").isNull() | (F.col("a.seq") < F.col("r.seq")), F.col("a"))
    status = F.when(F.col("r").isNotNull(), "retired").when(F.col("a").isNotNull(), "approved").otherwise("draft")
    return each.select(key, status.alias("status"), approved["actor"].alias("approved_by"), approved["seq"].alias("approved_seq"), F.col("r.seq").alias("retired_seq"))


def fold_resolutions(changes: DataFrame, key: str = "entity_id") -> DataFrame:
    """(key, status, resolved_by, last_seq) of conflicts or feedback after changes (key, seq, change, actor).

    The last of resolve, dismiss and reopen decides; to reopen clears who resolved. Other changes have no effect.
    """
    of_state = changes.filter(F.col("change").isin("resolve", "dismiss", "reopen"))
    last = of_state.groupBy(key).agg(F.max(F.struct("seq", "change", "actor")).alias("x"))
    status = F.when(F.col("x.change") == "resolve", "resolved").when(F.col("x.change") == "dismiss", "dismissed").otherwise("open")
    everyone = changes.select(key).distinct().join(last, key, "left")
    return everyone.select(key, status.alias("status"), F.when(status != "open", F.col("x.actor")).alias("resolved_by"), F.col("x.seq").alias("last_seq"))


ROLES = ("clinician", "author", "approver", "admin")  # fixed order of rank


def visible_versions(versions: DataFrame, role: str) -> DataFrame:
    """Versions a role may see: drafts from author upwards."""
    return versions if ROLES.index(role) >= ROLES.index("author") else versions.filter("status <> 'draft'")


def escalation_contacts(requests: DataFrame, contacts: DataFrame, limit: int = 4) -> DataFrame:
    """(request_id, contact_id, place): contacts to offer for requests (branch_id, reason, department_id).

    A contact qualifies if it is network-wide or of the branch, its reason list is empty or names the reason,
    and it has no department, or the request's, or the reason is high risk. Best first: named for the reason,
    in the department, local, by priority, by id. Nothing is offered out of scope or for clarification.
    """
    r = requests.filter(~F.col("reason").isin("out_of_scope", "clarify")).select("request_id", F.col("branch_id").alias("r_branch"), "reason", F.col("department_id").alias("r_department"))
    # contacts of one branch, reason and department are in one order for every request: the first ones stand for all
    alike = Window.partitionBy("branch_id", "escalation_for", "department_id").orderBy("priority", "contact_id")
    first = contacts.select("contact_id", "branch_id", "department_id", "escalation_for", "priority").withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= limit)
    # requests of one branch, reason and department get the same contacts: they are ranked once a kind
    kinds = r.select("r_branch", "reason", "r_department").distinct()
    looks = kinds.withColumn("look_branch", F.explode(F.array_distinct(F.array("r_branch", F.lit(None).cast("int"))))).withColumn("look_for", F.explode(F.array("reason", F.lit(""))))
    both = looks.join(first, looks["look_branch"].eqNullSafe(first["branch_id"]) & (looks["look_for"] == first["escalation_for"]))
    named = F.col("escalation_for") == F.col("reason")
    in_department = F.coalesce(F.col("department_id") == F.col("r_department"), F.lit(False))
    ok = both.filter(F.col("department_id").isNull() | in_department | (F.col("reason") == "high_risk"))
    order = Window.partitionBy("r_branch", "reason", "r_department").orderBy(F.desc(named), F.desc(in_department), F.desc(F.col("branch_id").isNotNull()), "priority", "contact_id")
    ranked = ok.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select(F.col("r_branch").alias("k_branch"), F.col("reason").alias("k_reason"), F.col("r_department").alias("k_department"), "contact_id", "place")
    of = F.col("r_branch").eqNullSafe(F.col("k_branch")) & (F.col("reason") == F.col("k_reason")) & F.col("r_department").eqNullSafe(F.col("k_department"))
    return r.join(ranked, of).select("request_id", "contact_id", "place")


def section_match_counts(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(link_id, n): how many of ``paths(section_path)`` each link's target matches, as :func:`section_matches` says.

    Each path stands under itself and under all of its starts that end before ``.``, ``#`` or ``(``, so targets meet it
    by equality; a link without a target takes the number of all paths.
    """
    path = F.col("section_path")
    cuts = F.filter(F.sequence(F.lit(1), F.length(path)), lambda i: F.substring(path, i, F.lit(1)).isin(".", "#", "("))
    starts = F.array_distinct(F.concat(F.array(path), F.transform(cuts, lambda i: F.substring(path, F.lit(1), i - 1))))
    spread = paths.filter("section_path is not null and section_path <> ''").select(F.explode(starts).alias("target_section_path"), "section_path")
    met = links.filter("target_section_path is not null").join(spread, "target_section_path").groupBy("link_id").agg(F.count("*").alias("n"))
    every = links.filter("target_section_path is null").select("link_id").crossJoin(F.broadcast(paths.agg(F.count("*").alias("n"))))  # one row
    return met.unionByName(every.filter("n > 0"))


def contact_list(contacts: DataFrame, branch_id: int) -> DataFrame:
    """Network-wide contacts and those of a branch, by priority and label."""
    mine = contacts.filter(F.col("branch_id").isNull() | (F.col("branch_id") == branch_id))
    return mine.select("contact_id", "role_label", "priority").orderBy("priority", "role_label")


def link_problems(links: DataFrame, versions: DataFrame) -> DataFrame:
    """Links with their effective date (the source version's by default) and what is wrong with them, if anything."""
    source = versions.select(F.col("version_id").alias("source_version_id"), F.col("document_id").alias("source_document_id"), F.col("effective_from").alias("source_from"))
    joined = links.join(source, "source_version_id", "left")
    problem = F.when(F.col("source_document_id").isNull(), F.lit("no source")).when(F.col("source_document_id") == F.col("target_document_id"), F.lit("amends itself"))
    return joined.select("link_id", F.coalesce("effective_from", "source_from").alias("effective_from"), problem.alias("problem"))


def version_intervals(versions: DataFrame) -> DataFrame:
    """(document_id, version_id, valid_from, valid_to): the days on which each approved version is the current one.

    ``valid_to`` is the first day after, null where no later version follows. A version that another of the same day
    goes before is never current and has no row. On every day the rows agree with :func:`current_versions`.
    """
    order = Window.partitionBy("document_id").orderBy("effective_from", F.asc_nulls_first("approved_at"), "version_id")
    live = versions.filter((F.col("status") == "approved") & F.col("effective_from").isNotNull())
    dated = live.select("document_id", "version_id", F.col("effective_from").alias("valid_from"), F.lead("effective_from").over(order).alias("valid_to"))
    return dated.filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))


def chunk_intervals(chunks: DataFrame, versions: DataFrame, links: DataFrame) -> DataFrame:
    """(chunk_id, version_id, document_id, valid_from, valid_to): the days on which each chunk is eligible, whatever the branch.

    A chunk is eligible while its version is current, up to the first day of a confirmed link that hides its section.
    Links never end, so the earliest match settles all dates at once; no date is joined with chunks here.
    """
    own = with_document(chunks, versions)
    always = active_links(links, versions, "9999-12-31").select(F.col("target_document_id").alias("document_id"), "target_section_path", F.col("effective_from").alias("hidden_from"))
    hit = own.select("chunk_id", "document_id", "paths").join(always, "document_id").filter(F.exists("paths", lambda p: section_matches(F.col("target_section_path"), p)))
    hidden = hit.groupBy("chunk_id").agg(F.min("hidden_from").alias("hidden_from"))
    dated = own.select("chunk_id", "version_id", "document_id").join(version_intervals(versions).drop("document_id"), "version_id").join(hidden, "chunk_id", "left")
    until = F.least("valid_to", "hidden_from")  # nulls are left out
    return dated.select("chunk_id", "version_id", "document_id", "valid_from", until.alias("valid_to")).filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))


def scoped_intervals(intervals: DataFrame, documents: DataFrame, document_branches: DataFrame) -> DataFrame:
    """Intervals with ``branch_id``: null for network-wide documents, else a row for each branch of the document."""
    wide = documents.select("document_id", F.coalesce("network_wide", F.lit(False)).alias("wide"))
    with_wide = intervals.join(wide, "document_id")
    own = with_wide.filter("not wide").join(document_branches.select("document_id", F.col("branch_id").cast("int").alias("branch_id")).distinct(), "document_id")
    return own.drop("wide").unionByName(with_wide.filter("wide").drop("wide").withColumn("branch_id", F.lit(None).cast("int")))


def holds(as_of: Column, branch: Column) -> Column:
    """Whether a row of :func:`scoped_intervals` counts for a branch (null: network-wide only) on a day."""
    inside = (F.col("valid_from") <= as_of) & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of))
    return inside & (F.col("branch_id").isNull() | F.coalesce(F.col("branch_id") == branch, F.lit(False)))


def eligible_at(scoped: DataFrame, points: DataFrame, days: int = 128) -> DataFrame:
    """(point_id, chunk_id) of the chunks eligible for each of ``points(point_id, branch_id, as_of)``.

    A bucketed interval join: time is cut into spans of ``days``; an interval stands in each span that it touches
    between the first and the last day asked for, a point in one, and both meet by equality of span and of branch or
    network. Points of one branch and day share the work, and their pairs are spread only at the end.
    """
    asked = points.select("branch_id", "as_of").distinct()
    reach = asked.agg(F.min("as_of").alias("first"), F.max("as_of").alias("last"))
    span = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    bounded = scoped.join(F.broadcast(reach), (F.col("valid_from") <= F.col("last")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("first"))))  # one row of two days
    low, high = F.greatest("valid_from", "first"), F.least(F.date_sub("valid_to", 1), "last")
    spread = bounded.select("chunk_id", F.col("branch_id").alias("of"), "valid_from", "valid_to", F.explode(F.sequence(span(low), span(high))).alias("span"))
    at = asked.select("branch_id", "as_of", span(F.col("as_of")).alias("span"))
    # each point looks for its branch and, under a null, for the network
    looks = at.select("*", F.col("branch_id").alias("of")).filter("of is not null").unionByName(at.select("*", F.lit(None).cast("int").alias("of")))
    met = looks.join(spread, (looks["span"] == spread["span"]) & looks["of"].eqNullSafe(spread["of"]))
    inside = met.filter((F.col("valid_from") <= F.col("as_of")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("as_of")))).select("branch_id", "as_of", "chunk_id")
    named = points.select("point_id", F.col("branch_id").alias("b"), F.col("as_of").alias("d"))
    return inside.join(named, F.col("branch_id").eqNullSafe(F.col("b")) & (F.col("as_of") == F.col("d"))).select("point_id", "chunk_id")


def clause_outline(chunks: DataFrame) -> DataFrame:
    """(version_id, outline): the clauses of each version in order, without the chunks of single table rows, one row a version."""
    shown = ~(F.coalesce("is_table", F.lit(False)) & F.contains("heading", F.lit(" — row "))) if {"is_table", "heading"} <= set(chunks.columns) else F.lit(True)
    fields = [c for c in ("ordinal", "chunk_id", "section_path", "heading", "is_table", "page_start") if c in chunks.columns]
    return chunks.filter(F.coalesce(shown, F.lit(True))).groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("outline"))


def clause_view(chunks: DataFrame, versions: DataFrame, links: DataFrame, documents: DataFrame, as_of) -> DataFrame:
    """What a reader of each clause is told: its place, what supersedes it, what its version amends, and which version is newer.

    Result: (chunk_id, version_id, document_id, doc_code, is_current, previous_id, next_id, superseded_by, amends, newer_version).
    ``superseded_by``: (effective_from, link_id, doc_code, version_label, version_id, section_path) of the active links that hide
    the clause, oldest first; ``amends``: (doc_code, section_path) of the confirmed links of its version; ``newer_version``:
    the current version of its document where that is another, or null. The outline is a table of its own
    (:func:`clause_outline`), so it is not repeated with every clause.
    """
    codes = documents.select("document_id", "doc_code")
    own = with_document(chunks, versions)
    source = versions.select(F.col("version_id").alias("source_version_id"), F.col("document_id").alias("source_document_id"), F.col("version_label").alias("source_label"))
    named = active_links(links, versions, as_of).join(source, "source_version_id").join(codes.withColumnRenamed("document_id", "source_document_id"), "source_document_id")
    note = F.struct("effective_from", "link_id", "doc_code", F.col("source_label").alias("version_label"), F.col("source_version_id").alias("version_id"), F.col("target_section_path").alias("section_path"))
    into = named.select(F.col("target_document_id").alias("document_id"), "target_section_path", note.alias("note"))
    hit = own.select("chunk_id", "document_id", "paths").join(into, "document_id").filter(F.exists("paths", lambda p: section_matches(F.col("target_section_path"), p)))
    hiding = hit.groupBy("chunk_id").agg(F.array_sort(F.collect_list("note")).alias("superseded_by"))
    out = links.filter("confirmed").join(codes.withColumnRenamed("document_id", "target_document_id"), "target_document_id")
    amended = out.groupBy(F.col("source_version_id").alias("version_id")).agg(F.array_sort(F.collect_list(F.struct("doc_code", F.col("target_section_path").alias("section_path")))).alias("amends"))
    now = current_versions(versions, as_of).select("document_id", F.struct("version_id", "version_label", "effective_from").alias("current"))
    full = own.select("chunk_id", "version_id", "document_id").join(codes, "document_id").join(clause_neighbours(chunks), "chunk_id").join(hiding, "chunk_id", "left").join(amended, "version_id", "left").join(now, "document_id", "left")
    same = F.coalesce(F.col("current.version_id") == F.col("version_id"), F.lit(False))
    return full.select(
        "chunk_id", "version_id", "document_id", "doc_code", same.alias("is_current"), "previous_id", "next_id",
        F.coalesce("superseded_by", F.expr("filter(array(cast(null as struct<effective_from:date,link_id:bigint,doc_code:string,version_label:string,version_id:bigint,section_path:string>)), x -> x is not null)")).alias("superseded_by"),
        F.coalesce("amends", F.expr("filter(array(cast(null as struct<doc_code:string,section_path:string>)), x -> x is not null)")).alias("amends"),
        F.when(~same, F.col("current")).alias("newer_version"),
    )

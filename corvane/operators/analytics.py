"""Statistics over question, answer, citation and feedback logs, and work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_window(logs: DataFrame, since, until) -> DataFrame:
    """Rows created from ``since`` up to, not including, the day after ``until``."""
    return logs.filter((F.col("created_at") >= F.lit(str(since)).cast("timestamp")) & (F.col("created_at") < F.date_add(F.lit(str(until)).cast("date"), 1)))


def totals(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Counts by outcome and interpolated latency percentiles over questions with or without an answer."""
    joined = queries.join(answers.select("query_id", "outcome"), "query_id", "left")
    return joined.agg(
        F.count("*").alias("n"),
        *(F.count_if(F.col("outcome") == o).alias(o) for o in ("answered", "partial", "abstained")),
        F.percentile("latency_ms", 0.5).alias("p50"),
        F.percentile("latency_ms", 0.95).alias("p95"),
    )


#: Size of a latency sketch: 99 of 100 quantiles lie within RANK_ERROR of their rank, however many sketches are merged.
SKETCH_SIZE, RANK_ERROR = 800, 0.01


def latency_sketches(queries: DataFrame) -> DataFrame:
    """(day, n, sketch): a quantile sketch of the latencies of each day, of a few KB, whatever their number.

    Sketches of days, of batches of one day or of other tables merge (:func:`sketched_percentiles`), so percentiles of any
    window need no second look at the log. Null latencies are left out.
    """
    known = queries.filter("latency_ms is not null").select(F.to_date("created_at").alias("day"), F.col("latency_ms").cast("double").alias("latency"))
    return known.groupBy("day").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("latency", F.lit(SKETCH_SIZE)).alias("sketch"))


def sketched_percentiles(sketches: DataFrame, by: list[str], ranks: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(by, n, p50, p95, ...): percentiles of merged sketches (day, n, sketch), each within RANK_ERROR of its rank."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_SIZE)).alias("sketch"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(r).cast("double")).alias(f"p{round(100 * r)}") for r in ranks])


def top_questions(queries: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent questions regardless of case."""
    return queries.groupBy(F.lower("question").alias("question")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "question").limit(limit)


def top_unanswered(queries: DataFrame, answers: DataFrame, limit: int = 10) -> DataFrame:
    missing = answers.filter("abstain_reason = 'not_found'").select("query_id")
    return top_questions(queries.join(missing, "query_id", "left_semi"), limit)


def top_documents(citations: DataFrame, versions: DataFrame, documents: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Most cited documents; counts are made per version before documents are joined."""
    counted = citations.join(queries.select(F.col("query_id").alias("answer_id")), "answer_id", "left_semi").groupBy("version_id").agg(F.count("*").alias("n"))
    by_doc = counted.join(versions.select("version_id", "document_id"), "version_id").groupBy("document_id").agg(F.sum("n").alias("n"))
    return by_doc.join(documents.select("document_id", "doc_code"), "document_id").select("doc_code", "n").orderBy(F.desc("n"), "doc_code").limit(limit)


def daily(queries: DataFrame, answers: DataFrame) -> DataFrame:
    joined = queries.join(answers.select("query_id", "outcome"), "query_id", "left")
    return joined.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "abstained").alias("declined"))


def filled_daily(series: DataFrame, since, until) -> DataFrame:
    """Every day of the window, zero where nothing happened; handled = questions less declined."""
    spark = series.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(str(since)).cast("date"), F.lit(str(until)).cast("date"))).alias("day"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return days.join(series, "day", "left").select("day", zero("n"), zero("declined"), (F.coalesce("n", F.lit(0)) - F.coalesce("declined", F.lit(0))).alias("handled"))


def abstention_rate(answers: DataFrame) -> DataFrame:
    n = F.count("*")
    return answers.agg(F.when(n > 0, F.round(F.count_if(F.col("outcome") == "abstained") / n, 4)).otherwise(0.0).alias("rate"))


def queue_counts(conflicts: DataFrame, feedback: DataFrame, links: DataFrame, versions: DataFrame) -> DataFrame:
    """(queue, n) of what waits for someone."""
    parts = [
        ("open conflicts", conflicts.filter("status = 'open'")),
        ("feedback", feedback.filter("status <> 'resolved' and kind <> 'helpful'")),
        ("unconfirmed links", links.filter("not confirmed")),
        ("drafts ready", versions.filter("status = 'draft' and ingest_status = 'ready'")),
    ]
    out = None
    for name, rows in parts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("queue"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def usage_counters(queries: DataFrame, answers: DataFrame, newest: int = 5000) -> DataFrame:
    """(counter, value, n) over the newest questions: generation mode, route and redaction."""
    latest = queries.orderBy(F.desc("created_at"), F.desc("query_id")).limit(newest).join(answers.select("query_id", "generation_mode"), "query_id", "left")
    pairs = F.array(
        F.struct(F.lit("mode").alias("counter"), F.coalesce("generation_mode", F.lit("not drafted")).alias("value")),
        F.struct(F.lit("route").alias("counter"), F.col("route").alias("value")),
        F.struct(F.lit("redacted").alias("counter"), F.col("pii_redacted").cast("string").alias("value")),
    )
    return latest.select(F.explode(pairs).alias("p")).groupBy("p.counter", "p.value").agg(F.count("*").alias("n"))


def stage_means(timings: DataFrame, stages: tuple[str, ...] = ("route", "retrieve", "generate", "verify", "total")) -> DataFrame:
    """Mean milliseconds of the known stages of a map column ``timings``, one decimal."""
    each = timings.select(F.explode("timings").alias("stage", "ms")).filter(F.col("stage").isin(*stages) & F.col("ms").isNotNull())
    return each.groupBy("stage").agg(F.round(F.avg("ms"), 1).alias("mean_ms"))


def decision_trace(queries: DataFrame, answers: DataFrame, citations: DataFrame, versions: DataFrame, documents: DataFrame, limit: int = 25) -> DataFrame:
    """The latest questions with what they cite, in the string order of markers."""
    latest = queries.orderBy(F.desc("created_at"), F.desc("query_id")).limit(limit).join(answers.select("query_id", "outcome"), "query_id", "left")
    cited = citations.join(latest.select(F.col("query_id").alias("answer_id")), "answer_id", "left_semi").join(versions.select("version_id", "document_id", "version_label"), "version_id").join(documents.select("document_id", "doc_code"), "document_id")
    name = F.concat_ws(" ", "doc_code", "version_label")
    listed = cited.groupBy(F.col("answer_id").alias("query_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("marker", name.alias("name")))), lambda x: x["name"]), "; ").alias("cited"))
    return latest.join(listed, "query_id", "left").select("query_id", "outcome", F.coalesce("cited", F.lit("")).alias("cited"))


REVIEW_ACTIONS = ("document.approve", "conflict.resolve", "feedback.resolve")


def user_usage(users: DataFrame, queries: DataFrame, answers: DataFrame, audit: DataFrame, since, until) -> DataFrame:
    """Every user with questions by outcome in the window, action counts, and when last active; zeros kept.

    Both logs are cut to the window and summed per user before the join, so the date test belongs to the join
    and no user is lost.
    """
    asked = in_window(queries, since, until).join(answers.select("query_id", "outcome"), "query_id", "left").groupBy("user_id").agg(
        F.count("*").alias("questions"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("answered", "partial", "abstained")), F.max("created_at").alias("last_question")
    )
    did = in_window(audit, since, until).groupBy(F.col("actor_user_id").alias("user_id")).agg(F.count_if(F.col("action") == "document.upload").alias("uploads"), F.count_if(F.col("action").isin(*REVIEW_ACTIONS)).alias("reviews"), F.max("created_at").alias("last_action"))
    out = users.join(asked, "user_id", "left").join(did, "user_id", "left")
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("questions", "answered", "partial", "abstained", "uploads", "reviews")]
    return out.select("user_id", "display_name", *zeros, F.greatest("last_question", "last_action").alias("last_active"))


def amendment_list(links: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Source ``code label`` and target ``code §section`` of every link; pending ones are not confirmed."""
    own = versions.join(documents.select("document_id", "doc_code"), "document_id").select(F.col("version_id").alias("source_version_id"), F.concat_ws(" ", "doc_code", "version_label").alias("source"))
    to = documents.select(F.col("document_id").alias("target_document_id"), F.col("doc_code").alias("target_code"))
    where = F.coalesce(F.concat(F.lit("§"), "target_section_path"), F.lit("(whole document)"))
    return links.join(own, "source_version_id").join(to, "target_document_id").select("link_id", "source", F.concat_ws(" ", "target_code", where).alias("target"), "confirmed")


def conflict_list(conflicts: DataFrame, chunks: DataFrame, versions: DataFrame, documents: DataFrame, status: str | None = None) -> DataFrame:
    """Conflicts with a label of both sides; open first, then the newest."""
    rows = conflicts if status is None else conflicts.filter(F.col("status") == status)
    label = chunks.select("chunk_id", "version_id", "section_path").join(versions.select("version_id", "document_id"), "version_id").join(documents.select("document_id", "doc_code"), "document_id")
    label = label.select("chunk_id", F.concat_ws(" §", "doc_code", "section_path").alias("label"))
    sides = [label.select(F.col("chunk_id").alias(f"chunk_{s}"), F.col("label").alias(f"label_{s}")) for s in "ab"]
    return rows.join(sides[0], "chunk_a").join(sides[1], "chunk_b").select("conflict_id", "status", "label_a", "label_b").orderBy(F.col("status") != "open", F.desc("conflict_id"))


def feedback_inbox(feedback: DataFrame, user_id: int | None) -> DataFrame:
    """Unresolved feedback that is not praise, routed to a user; None (an admin): all of it."""
    rows = feedback.filter("status <> 'resolved' and kind <> 'helpful'")
    return rows if user_id is None else rows.filter(F.col("routed_to") == user_id)


def route_feedback(feedback: DataFrame, citations: DataFrame, versions: DataFrame, documents: DataFrame, users: DataFrame) -> DataFrame:
    """(feedback_id, routed_to): owner of the first cited document with one, in marker order, else the first active admin."""
    owned = citations.join(versions.select("version_id", "document_id"), "version_id").join(documents.filter("owner_id is not null").select("document_id", "owner_id"), "document_id")
    first = owned.groupBy("answer_id").agg(F.min_by("owner_id", F.struct("marker", "citation_id")).alias("owner_id"))
    admin = users.filter("role = 'admin' and is_active").agg(F.min_by("user_id", "email").alias("admin_id"))
    return feedback.join(first, "answer_id", "left").crossJoin(admin).select("feedback_id", F.when(F.col("kind") != "helpful", F.coalesce("owner_id", "admin_id")).alias("routed_to"))


def history(queries: DataFrame, answers: DataFrame, n: int = 10) -> DataFrame:
    """The latest ``n`` (1 to 50) questions of each user."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("query_id"))
    latest = queries.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(1, min(50, n)))
    return latest.join(answers.select("query_id", "outcome"), "query_id", "left").select("user_id", "place", "query_id", "outcome")


def chunk_counts(versions: DataFrame, chunks: DataFrame) -> DataFrame:
    counted = chunks.groupBy("version_id").agg(F.count("*").alias("n"))
    return versions.select("version_id").join(counted, "version_id", "left").select("version_id", F.coalesce("n", F.lit(0)).alias("n_chunks"))


def task_usage(calls: DataFrame) -> DataFrame:
    """Calls, failures, timeouts and mean milliseconds per task."""
    return calls.groupBy("task").agg(F.count("*").alias("calls"), F.count_if(F.col("result") == "failed").alias("failures"), F.count_if(F.col("result") == "timeout").alias("timeouts"), F.round(F.avg("ms"), 1).alias("mean_ms"))


def retained(logs: DataFrame, today, days: int = 180) -> DataFrame:
    """Log rows not older than the retention period."""
    return logs.filter(F.col("created_at") >= F.date_sub(F.lit(str(today)).cast("date"), days))


def audit_export(events: DataFrame, users: DataFrame, since, until, prefix: str = "", limit: int = 1000) -> DataFrame:
    """Audit events of a date range by action prefix, newest first, with actor names; limit between 1 and 10000."""
    rows = in_window(events, since, until).filter(F.startswith(F.col("action"), F.lit(prefix)))
    rows = rows.orderBy(F.desc("created_at"), F.desc("seq")).limit(max(1, min(10_000, limit)))
    return rows.join(users.select(F.col("user_id").alias("actor_user_id"), F.col("display_name").alias("actor")), "actor_user_id", "left").select("seq", "action", "entity_id", "payload", "actor")


def stale_jobs(versions: DataFrame, now, seconds: int = 900) -> DataFrame:
    """Versions in processing for longer than the job timeout."""
    return versions.filter((F.col("ingest_status") == "processing") & (F.col("created_at") < F.lit(str(now)).cast("timestamp") - F.expr(f"interval {seconds} seconds")))

"""Streaming queries over the given event and text tables, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.plans.registry import query
from corvane.plans.text import stems_sql
from corvane.sources.scratch import fresh_path
from corvane.sources.views import table
from corvane.streaming import budgets, jobs


def stream(spark, sf, name):
    """The table as a stream of its files, whether it is one file or a folder of files; times in the session's zone."""
    given = spark.read.parquet(f"{sf}/{name}.parquet")
    reader = spark.readStream.schema(given.schema)
    if given.inputFiles()[0].endswith(f"/{name}.parquet"):
        found = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    else:
        found = reader.parquet(f"{sf}/{name}.parquet")
    return found.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in given.columns else found


RATE = "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n, count(*) > 30 AS over FROM events GROUP BY 1, 2"


@query("s01_rate_windows", RATE)
def s01(spark, sf):
    return jobs.run_upserted(jobs.rate_windows(stream(spark, sf, "events")), fresh_path(spark), ["user_id", "minute"])


WALK = """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        walk AS (SELECT user_id, n, ts, true AS accepted, ts AS last FROM e WHERE n = 1
            UNION ALL SELECT e.user_id, e.n, e.ts, e.ts - w.last >= INTERVAL 3600 SECOND, CASE WHEN e.ts - w.last >= INTERVAL 3600 SECOND THEN e.ts ELSE w.last END FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
        SELECT user_id, ts, accepted FROM walk"""


@query("s02_sliding_budget", f"{WALK} WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 60 SECOND")
def s02(spark, sf):
    """Hits that the watermark, a minute behind the last one, has passed."""
    return jobs.run_appended(budgets.sliding_budget(stream(spark, sf, "events"), limit=1, seconds=3600), fresh_path(spark))


@query("s02_sliding_budget_batch", WALK)
def s02b(spark, sf):
    return jobs.sliding_budget_batch(table(spark, sf, "events"), limit=1, seconds=3600)


SESSIONS = """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 15 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k)"""


@query("s03_sessions", f'{SESSIONS} SELECT user_id, start, "end", n FROM g')
def s03(spark, sf):
    return jobs.sessions(table(spark, sf, "events"))


@query("s03_streamed_sessions", f'{SESSIONS} SELECT user_id, start, "end", n FROM g WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE')
def s03b(spark, sf):
    """Sessions as a stream: those that the watermark, half an hour behind the last event, has closed."""
    return jobs.run_appended(jobs.sessions(stream(spark, sf, "events")), fresh_path(spark))


@query("s04_incremental_ingest", "SELECT doc_id, CAST(length(text) AS INTEGER) AS size FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def s04(spark, sf):
    at = fresh_path(spark)
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{at}/kept/batch={batch}")
    fail = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{at}/failed/batch={batch}")
    prepare = lambda rows: rows.select("doc_id", F.length("text").alias("size"))
    jobs.ingest(stream(spark, sf, "documents"), prepare, write, fail, f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/kept").drop("batch")


@query("s04_ingested_chunks")
def s04b(spark, sf):
    """Chunks of all texts as the incremental ingest writes them."""
    at = fresh_path(spark)
    jobs.ingest_corpus(stream(spark, sf, "documents"), at, table(spark, sf, "documents_v").select("doc_code")).awaitTermination()
    return jobs.ingested(spark, at, "chunks")


@query("s05_streaming_dedup", "SELECT sha256(text) AS sha256, count(*) - count(*) + 1 AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def s05(spark, sf):
    """Each distinct text that arrives, once."""
    arriving = stream(spark, sf, "documents").filter("text is not null").select(F.lit("2024-01-01").cast("timestamp").alias("arrived"), F.col("text").alias("content"))
    return jobs.run_appended(jobs.new_files(arriving).select("sha256"), fresh_path(spark)).groupBy("sha256").agg(F.count("*").alias("n"))


@query("s06_daily_stats", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type IN ('signup', 'error')) AS declined FROM events GROUP BY 1")
def s06(spark, sf):
    return jobs.run_upserted(jobs.daily_stats(stream(spark, sf, "events")), fresh_path(spark), ["day"])


JOBS = """SELECT event_id % 5000 AS job_id, CASE WHEN event_type IN ('click', 'view') THEN 'processing' ELSE 'ready' END AS status, ts FROM {events}"""


@query(
    "s07_stale_jobs_stream",
    f"""WITH j AS ({JOBS.format(events='events')}), k AS (SELECT job_id, max(ts) FILTER (status = 'processing') AS started, max(ts) FILTER (status <> 'processing') AS ended FROM j GROUP BY 1)
        SELECT job_id, started FROM k WHERE started + INTERVAL 900 SECOND < (SELECT max(ts) FROM events) - INTERVAL 60 SECOND AND (ended IS NULL OR ended < started OR ended - started > INTERVAL 900 SECOND)""",
)
def s07_stream(spark, sf):
    """Jobs that stayed in processing for over 900 seconds, as timers report them."""
    rows = spark.sql(JOBS, events=stream(spark, sf, "events"))
    return jobs.run_appended(budgets.stale_jobs(rows), fresh_path(spark))


@query("s08_term_counts", f"SELECT term, count(*) AS df FROM (SELECT unnest({stems_sql('text')}) AS term FROM documents) GROUP BY 1")
def s08(spark, sf):
    return jobs.run_upserted(jobs.term_counts(stream(spark, sf, "documents")), fresh_path(spark), ["term"])

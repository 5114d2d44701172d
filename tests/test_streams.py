import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corvane.sources.scratch import fresh_path
from corvane.streaming import budgets, jobs

BEGIN = dt.datetime(2026, 1, 1, 12)
EVENTS = "user_id long, ts timestamp, event_type string"


class Feed:
    """A folder that grows by one file at a time, read one file a micro-batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/f{self.n:03d}")
        self.n += 1

    def stream(self):
        reader = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        return reader.parquet(self.folder)


def at(seconds):
    return BEGIN + dt.timedelta(seconds=seconds)


def test_late_hits_over_batches_and_a_restart_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(1)
    hits = sorted({(rng.randrange(3), rng.randrange(600)) for _ in range(150)}, key=lambda h: h[1] + rng.uniform(0, 50))  # up to 50 s out of order
    feed, path = Feed(spark, str(tmp_path / "in"), EVENTS), str(tmp_path / "out")
    parts = [hits[i : i + 40] for i in range(0, len(hits), 40)]
    rows = lambda part: [(u, at(s), "click") for u, s in part]
    for part in parts[:2]:
        feed.put(rows(part))
    run = lambda: jobs.run_appended(budgets.sliding_budget(feed.stream(), limit=3, seconds=60, late="1 minute"), path)
    run()
    for part in parts[2:]:
        feed.put(rows(part))
    feed.put([(99, at(10_000), "click")])  # moves the watermark past all others
    got = {tuple(r) for r in run().collect()}
    every = spark.createDataFrame([r for part in parts for r in rows(part)], EVENTS)
    want = {tuple(r) for r in jobs.sliding_budget_batch(every, limit=3, seconds=60).collect()}
    assert got == want and {a for _, _, a in want} == {True, False} and len(want) == len(hits)


def test_stale_jobs_by_timers(spark, tmp_path):
    schema = "job_id long, status string, ts timestamp"
    feed = Feed(spark, str(tmp_path / "in"), schema)
    feed.put([(1, "processing", at(0)), (2, "processing", at(10)), (3, "processing", at(20)), (None, "processing", at(20))])
    feed.put([(2, "ready", at(500)), (4, "processing", at(600))])
    feed.put([(3, "failed", at(2000)), (9, "ready", at(2000))])
    feed.put([(4, "ready", at(5000)), (9, "ready", at(9000))])
    got = jobs.run_appended(budgets.stale_jobs(feed.stream(), seconds=900), str(tmp_path / "out")).collect()
    assert sorted(tuple(r) for r in got) == [(1, at(0)), (3, at(20)), (4, at(600))]


@pytest.mark.parametrize("kind", ["minutes", "sessions"])
def test_state_falls_once_the_watermark_passes(spark, tmp_path, kind):
    feed = Feed(spark, str(tmp_path / "in"), EVENTS)
    for k in range(5):
        feed.put([(u, at(k * 3600 + 7 * u), "click") for u in range(30)])
    feed.put([(1, at(5), "click"), (1, at(5 * 3600), "click")])  # the first is too late
    made = jobs.rate_windows(feed.stream(), late="10 minutes") if kind == "minutes" else jobs.sessions(feed.stream(), late="10 minutes")
    held = []
    writer = made.writeStream.outputMode("update" if kind == "minutes" else "append").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/table/batch={n}"))
    running = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    running.awaitTermination()
    for p in running.recentProgress:
        held += [s["numRowsTotal"] for s in p["stateOperators"]]
    assert max(held) <= 2 * 30 * 4 and held[-1] <= 40, held  # not five hours of windows
    if kind == "minutes":
        rows = jobs.latest(spark, f"{tmp_path}/out", ["user_id", "minute"]).collect()
        assert sum(r.n for r in rows) == 151  # the late one is gone
    else:
        assert {r.n for r in spark.read.parquet(f"{tmp_path}/out/table").collect()} == {1}


def test_upserts_keep_the_newest_row(spark, tmp_path):
    feed = Feed(spark, str(tmp_path / "in"), EVENTS)
    feed.put([(1, at(0), "click"), (1, at(1), "error")])
    feed.put([(1, at(2), "signup"), (2, at(86_400), "click")])
    got = jobs.run_upserted(jobs.daily_stats(feed.stream()), str(tmp_path / "out"), ["day"])
    assert sorted((r.n, r.declined) for r in got.collect()) == [(1, 0), (3, 2)]
    assert spark.read.parquet(f"{tmp_path}/out/table").count() == 3  # a changed day was written twice, an unchanged one not


def test_ingest_leaves_no_trace_of_a_batch_that_failed(spark, tmp_path):
    schema = "doc_id long, text string"
    feed, path = Feed(spark, str(tmp_path / "in"), schema), str(tmp_path / "out")
    known = spark.createDataFrame([("CLN-GL-014",), ("CLN-GL-007",)], "doc_code string")
    feed.put([(1, "# Guide\n\n## 1 Scope\n" + "word " * 50), (2, None), (3, " ")])
    jobs.ingest_corpus(feed.stream(), path, known).awaitTermination()
    assert [r.doc_id for r in jobs.ingested(spark, path, "failures").orderBy("doc_id").collect()] == [2, 3]
    chunks = jobs.ingested(spark, path, "chunks")
    assert {r.doc_id for r in chunks.collect()} == {1}
    # a batch that wrote its chunks but not its manifest counts for nothing, and is replaced when it runs
    chunks.withColumn("doc_id", F.lit(77).cast("long")).write.parquet(f"{path}/chunks/batch=1")
    assert {r.doc_id for r in jobs.ingested(spark, path, "chunks").collect()} == {1}
    feed.put([(4, "## 2 More\n" + "word " * 60)])
    jobs.ingest_corpus(feed.stream(), path, known).awaitTermination()
    assert {r.doc_id for r in jobs.ingested(spark, path, "chunks").collect()} == {1, 4}
    assert spark.read.parquet(f"{path}/manifest").agg(F.sum("n_texts"), F.sum("n_failed")).first()[:] == (4, 2)


def test_a_user_has_one_timer_a_batch():
    from types import SimpleNamespace

    class Held:
        def __init__(self):
            self.rows = []

        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)
        clear = lambda self: self.rows.clear()
        appendList = lambda self, rows: self.rows.extend(rows)

        def put(self, rows):
            self.rows = list(rows)

    timers, budget = set(), budgets.SlidingBudget(limit=1, seconds=10)
    budget.init(SimpleNamespace(getListState=lambda name, schema: Held(), registerTimer=timers.add))
    out = []
    for first in (0, 50):
        list(budget.handleInputRows((1,), iter([SimpleNamespace(at=(first + i) * 1_000_000) for i in range(50)]), None))
        assert len(timers) <= 2  # not one for each hit
        for until in (first * 1000 + 20_500, first * 1000 + 60_500):
            for t in sorted(t for t in timers if t < until):
                timers.discard(t)
                out += budget.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda at=until: at), None)
    assert [(r.at // 1_000_000, r.accepted) for r in out] == [(i, i % 10 == 0) for i in range(100)]

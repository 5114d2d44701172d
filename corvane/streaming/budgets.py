"""Custom streaming state with timers: sliding budgets that place late hits by event time, and jobs that went stale."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks(spark: SparkSession) -> None:
    """State lists and timers need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def decide(times: list[int], limit: int, window: int, kept: list[int]) -> tuple[list[bool], list[int]]:
    """Whether each hit, in order of time, is accepted, given the accepted hits still inside the window; rejected hits leave no trace."""
    out = []
    for t in times:
        kept = [k for k in kept if t - k < window]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out, kept


class SlidingBudget(StatefulProcessor):
    """Hits wait in a list until the watermark passes them, then are decided in the order of their times.

    So a late hit, as long as it is not dropped, counts where it belongs, whatever batch brings it. The other list holds
    accepted hits inside the window, ``limit`` numbers at most. A timer stands at the first waiting time that each batch
    brings, and at the first that is left when one expires, so it comes no later than any waiting hit is due; a last one
    clears what is accepted once the window is over, so an idle user has no state.
    """

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.window = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long")
        self.accepted = handle.getListState("accepted", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        hits = [r.at for r in rows]
        self.waiting.appendList([(t,) for t in hits])
        self.handle.registerTimer(min(hits) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [x[0] for x in self.waiting.get()]
        due = sorted(t for t in waiting if t < until)
        before = [x[0] for x in self.accepted.get()]
        answers, kept = decide(due, self.limit, self.window, before)
        if due:
            left = [t for t in waiting if t >= until]
            self.waiting.put([(t,) for t in left]) if left else self.waiting.clear()
            if left:
                self.handle.registerTimer(min(left) // 1000 + 1)
        kept = [t for t in kept if t + self.window > until]
        if kept:
            self.accepted.put([(t,) for t in kept])
            self.handle.registerTimer((max(kept) + self.window) // 1000 + 1)
        elif before:
            self.accepted.clear()
        for t, ok in zip(due, answers, strict=True):
            yield Row(user_id=key[0], at=t, accepted=ok)


def sliding_budget(events: DataFrame, limit: int = 30, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """(user_id, ts, accepted): at most ``limit`` accepted hits of a user in any ``seconds``, for a stream of (user_id, ts).

    A hit is decided once the watermark has passed it; null users and times are left out.
    """
    use_rocks(events.sparkSession)
    rows = events.select(F.col("user_id").cast("long").alias("user_id"), "ts").filter("user_id is not null and ts is not null").withWatermark("ts", late)
    keyed = rows.select("user_id", "ts", F.unix_micros("ts").alias("at")).groupBy("user_id")
    out = keyed.transformWithState(SlidingBudget(limit, seconds), "user_id long, at long, accepted boolean", "Append", "EventTime")
    return out.select("user_id", F.timestamp_micros("at").alias("ts"), "accepted")


class StaleJobs(StatefulProcessor):
    """The start of each running job; a timer at its deadline reports it, the end of the job takes both away."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "at long, ended long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        start, ended = self.running.get() if self.running.exists() else (None, None)
        before = start
        for r in sorted(rows, key=lambda r: r.at):
            if r.status == "processing":
                start = r.at if start is None else max(start, r.at)
            else:
                ended = r.at if ended is None else max(ended, r.at)
        if before is not None:
            self.handle.deleteTimer((before + self.seconds * 1_000_000) // 1000 + 1)
        if start is not None:
            self.handle.registerTimer((start + self.seconds * 1_000_000) // 1000 + 1)
            self.running.update((start, ended))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.running.exists():
            start, ended = self.running.get()
            self.running.clear()
            if ended is None or ended < start or ended - start > self.seconds * 1_000_000:
                yield Row(job_id=key[0], at=start)


def stale_jobs(events: DataFrame, seconds: int = 900, late: str = "1 minute") -> DataFrame:
    """(job_id, started) of jobs that were ``processing`` for longer than ``seconds``, for a stream of (job_id, status, ts).

    A job is judged when the watermark passes its deadline, so its end may come late or before its start.
    """
    use_rocks(events.sparkSession)
    rows = events.select(F.col("job_id").cast("long").alias("job_id"), "status", "ts").filter("job_id is not null and ts is not null").withWatermark("ts", late)
    keyed = rows.select("job_id", "status", "ts", F.unix_micros("ts").alias("at")).groupBy("job_id")
    out = keyed.transformWithState(StaleJobs(seconds), "job_id long, at long", "Append", "EventTime")
    return out.select("job_id", F.timestamp_micros("at").alias("started"))

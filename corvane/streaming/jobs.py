"""Structured Streaming jobs over logs and arriving texts; each also runs on a batch table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.text import stemmed_words
from corvane.operators.metadata import detect_references, extract_metadata
from corvane.operators.structure import chunk_documents, markdown_blocks
from corvane.sources.scratch import written
from corvane.streaming.budgets import decide


def rate_windows(events: DataFrame, limit: int = 30, late: str = "10 minutes") -> DataFrame:
    """(user_id, minute, n, over): hits of each user in each clock minute."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("window.start").alias("minute"), "n", (F.col("n") > limit).alias("over"))


def sessions(events: DataFrame, idle: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of events with no longer gap than ``idle``."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", idle), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def daily_stats(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, n, declined) of log events."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type").isin("signup", "error")).alias("declined"))
    return grouped.select(F.to_date("window.start").alias("day"), "n", "declined")


def term_counts(passages: DataFrame) -> DataFrame:
    """(term, df) over all passages so far."""
    return passages.select(F.explode(stemmed_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def new_files(files: DataFrame, late: str = "1 day") -> DataFrame:
    """Files (arrived, content) whose hash did not arrive before within the watermark."""
    hashed = files.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    return hashed.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["sha256"])


HITS = "user_id long, ts timestamp, accepted boolean"


def sliding_budget_batch(events: DataFrame, limit: int = 30, seconds: int = 60) -> DataFrame:
    """(user_id, ts, accepted) of a batch table, as ``budgets.sliding_budget`` gives it for a stream.

    Hits are sorted by user and time inside partitions and folded as they come; of a user the accepted hits inside the
    window are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, kept = None, []
        for batch in batches:
            answers = []
            for own, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != user:
                    user, kept = own, []
                (ok,), kept = decide([at], limit, seconds * 1_000_000, kept)
                answers.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(answers, pa.bool_())], names=["user_id", "ts", "accepted"])

    rows = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts")).filter("user_id is not null and ts is not null")
    return rows.withColumn("at", F.unix_micros("ts")).repartition("user_id").sortWithinPartitions("user_id", "at").mapInArrow(run, HITS)


def ingest(source: DataFrame, prepare: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], fail: Callable[[DataFrame, int], None], checkpoint: str):
    """Start an incremental ingest: each batch is prepared and written; rows without content go to ``fail``.

    ``write`` gets the batch id, so that a batch that runs again replaces what it wrote before.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        empty = F.col("text").isNull() | (F.trim("text") == "")
        fail(rows.filter(empty).withColumn("error", F.lit("no content")), batch_id)
        write(prepare(rows.filter(~empty)), batch_id)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_appended(stream: DataFrame, path: str) -> DataFrame:
    """Run an append-mode stream over all that is there now; each batch is a folder, so one that runs again replaces itself."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/table/batch={batch_id}")

    stream.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/table")


def run_upserted(stream: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Run an update-mode stream over all that is there now into a table with one row for each value of ``keys``.

    Each batch writes the rows that it changed, and nothing else, as its own folder; :func:`latest` reads the newest row
    of each key. So Spark may drop a window's state once the watermark has passed it, and nothing is rewritten.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/table/batch={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return latest(stream.sparkSession, path, keys)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key of a table of :func:`run_upserted`."""
    rows = spark.read.parquet(f"{path}/table")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("row"))
    return newest.select(*keys, "row.*")


def ingest_corpus(source: DataFrame, path: str, known: DataFrame) -> StreamingQuery:
    """Start the incremental ingest of texts (doc_id, text): chunks, metadata, suggestions and failures of each batch.

    A batch writes one folder in each of ``chunks``, ``metadata``, ``suggestions`` (amendments of the documents in
    ``known(doc_code)`` that its texts announce) and ``failures`` (texts without content), and last its row of
    ``manifest``. Readers take the batches that the manifest names (:func:`ingested`), so one that failed on the way
    leaves no trace, and one that runs again replaces what it wrote.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = written(rows)
        empty = F.col("text").isNull() | (F.trim("text") == "")
        docs = rows.filter(~empty)
        read = extract_metadata(docs)
        tables = {
            "failures": rows.filter(empty).select("doc_id", F.lit("no content").alias("error")),
            "chunks": chunk_documents(markdown_blocks(docs)),
            "metadata": read,
            "suggestions": detect_references(docs.join(read.select("doc_id", F.col("doc_code").alias("self_code")), "doc_id"), known),
        }
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        counts = rows.agg(F.count("*").alias("n_texts"), F.count_if(empty).alias("n_failed"))
        counts.withColumn("ended", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch_id}")

    return source.select("doc_id", "text").writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def ingested(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of :func:`ingest_corpus`, of whole batches only."""
    done = spark.read.parquet(f"{path}/manifest").select("batch").distinct()
    return spark.read.parquet(f"{path}/{name}").join(done, "batch", "left_semi").drop("batch")

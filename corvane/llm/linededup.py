"""Removal of lines that many documents share, over levelled sorted runs of line hashes, in DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.runtime import drop_materialised, materialise, scratch_root

_BLANKS = " \t\n\x0b\f\r"


def digest(value: Column) -> Column:
    """The first 16 bytes of the SHA-256 of a string."""
    return F.substring(F.unhex(F.sha2(value.cast("binary"), 256)), 1, 16)


def stripped(line: Column) -> Column:
    """The line without blanks at both ends; few lines have any, and only those are trimmed."""
    outer = F.lit(False)
    for blank in _BLANKS:
        outer = outer | F.startswith(line, F.lit(blank)) | F.endswith(line, F.lit(blank))
    return F.when(outer, F.btrim(line, F.lit(_BLANKS))).otherwise(line)


def without_case(value: Column) -> Column:
    """A string that two values share only if they are equal once A-Z are in lower case.

    Bytes read as Latin-1 and put into lower case: A-Z become a-z, some lead bytes of longer characters become others.
    How many bytes follow a lead byte still tells which it was, so unlike characters stay unlike. ``translate`` on
    characters costs five times as much.
    """
    return F.lower(F.decode(value.cast("binary"), "ISO-8859-1"))


def version_of(text: Column) -> Column:
    """128 bits that tell texts of rows with one id apart."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def line_hashes(docs: DataFrame, least_chars: int) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, version, place, hash) of every line whose key has ``least_chars`` code points.

    The key is the line without outer blanks, A-Z in lower case. ``place`` counts lines from 0.
    """
    lines = docs.select("doc_id", version_of(F.col("text")).alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    keys = lines.select("doc_id", "version", "place", stripped(F.col("line")).alias("key")).filter(F.char_length("key") >= least_chars)
    return keys.select("doc_id", "version", "place", digest(without_case(F.col("key"))).alias("hash"))


class LineRuns:
    """Levelled sorted runs of line hashes: (hash, n, last), the number of documents that hold a line and the largest of them.

    A run is a table bucketed and sorted by hash, so that joins with it and merges of runs bring no exchange of
    their own to it. :meth:`add` takes the lines of a batch of documents, reduces them to one entry a hash, and
    merge-anti-joins that with the runs: an entry that a run settles (``enough`` documents, among them one with a
    larger id) says nothing new and is left out; the rest becomes a run of level 0. ``fan`` runs of a level are
    merged into one of the next. Batches may come in any order, but a document belongs to one batch; the fewest
    entries are written where larger ids come first. Lines of documents without an id are not counted.
    """

    def __init__(self, spark: SparkSession, enough: int = 3, fan: int = 3) -> None:
        self.spark, self.enough, self.fan = spark, enough, fan
        self.levels: list[list[DataFrame]] = []
        self.names: dict[int, str] = {}

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """Take in ``lines(doc_id, hash)``, the lines of one batch of documents."""
        own = lines.filter("doc_id is not null").groupBy("hash").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
        for run in self.runs():
            settled = run.filter(F.col("n") >= self.enough).select(F.col("hash").alias("known"), F.col("last").alias("known_last"))
            own = own.join(settled, (F.col("hash") == F.col("known")) & (F.col("known_last") >= F.col("last")), "left_anti")
        self._put(0, own)
        level = 0
        while len(self.levels[level]) >= self.fan:
            merged, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merge(merged))
            self._drop(merged)
            level += 1

    def settled(self) -> DataFrame:
        """(hash, last) of every line that ``enough`` documents hold."""
        return self._merge(self.runs()).filter(F.col("n") >= self.enough).select("hash", "last")

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = []

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        every = self.spark.createDataFrame([], "hash binary, n long, last long") if not runs else runs[0]
        for run in runs[1:]:
            every = every.union(run)
        return every.groupBy("hash").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def _put(self, level: int, entries: DataFrame) -> None:
        name = f"corvane_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{scratch_root(self.spark)}/{name.replace('_', '-')}"
        entries.write.format("parquet").bucketBy(buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        run = self.spark.table(name)
        self.names[id(run)] = name
        self.levels[level].append(run)

    def _drop(self, runs: list[DataFrame]) -> None:
        for run in runs:
            drop_materialised(run)
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(id(run))}")


def without_lines(text: Column, places: Column) -> Column:
    """``text`` without the lines at ``places`` (sorted, from 0): the stretches between them, so its cost is linear."""
    lines = F.split(text, "\n", -1)
    ends = F.concat(places, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1))
    kept = F.flatten(F.transform(starts, lambda start, k: F.slice(lines, start + 1, F.get(ends, k) - start)))
    return F.array_join(kept, "\n")


def dedup_lines(docs: DataFrame, enough: int = 3, least_chars: int = 20, batches: int = 4, fan: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, text, n_lines, n_dropped), one row per row.

    A line goes if its key (without outer blanks, A-Z in lower case) has ``least_chars`` code points at least and ``enough`` documents hold
    it, unless its document is the one with the largest id of them, which keeps all of its lines with that key.
    ``n_lines`` counts lines before, ``n_dropped`` those that went.

    One pass over the texts writes the hashes of their lines; ranges of ids, largest first, then go into
    :class:`LineRuns` as batches; lines of settled hashes are gathered per text and cut out in a last pass. Nothing
    but hashes is shuffled by line, and a line that a third of all documents hold is counted before it is shuffled;
    its join with the settled hashes is one that adaptive execution splits. Texts move only where the list of cut
    lines is too large to broadcast.

    A null or empty text is one empty line. Rows that repeat an id are one document, cut one by one. Rows without an
    id are not counted as holders and keep no line for being the last. Very long texts and lines are taken whole. An
    empty table gives an empty result; other columns have no effect, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = materialise(line_hashes(texts, least_chars))
    runs = LineRuns(spark, enough, fan)
    shares = [k / batches for k in range(1, batches)]
    cuts = sorted(set(lines.approxQuantile("doc_id", shares, 0.01)), reverse=True) if shares else []
    for low, high in zip([*cuts, None], [None, *cuts], strict=True):
        part = lines if low is None else lines.filter(F.col("doc_id") >= int(low))
        runs.add((part if high is None else part.filter(F.col("doc_id") < int(high))).select("doc_id", "hash"))
    hits = lines.join(runs.settled(), "hash").filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    cut = materialise(hits.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("place")).alias("places")))
    runs.close()
    drop_materialised(lines)
    cut = cut.select(F.col("doc_id").alias("cut_id"), F.col("version").alias("cut_version"), "places")
    joined = texts.join(cut, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (version_of(F.col("text")) == F.col("cut_version")), "left")
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1
    left = F.when(F.col("places").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("places")))
    return joined.select("doc_id", left.alias("text"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))


ORACLE_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT r, doc_id, len(lines) AS n_lines, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM texts),
keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM placed
),
shared AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.last AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id, n_lines
"""

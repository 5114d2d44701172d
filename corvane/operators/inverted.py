"""A stored inverted index: posting blocks with their maxima, delta segments and tombstones, as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import stem
from corvane.functions.words import STOPWORDS
from corvane.operators.retrieval import top_k
from corvane.sources.scratch import written

#: Passages whose ids share this quotient are one block of a posting list.
BLOCK = 256
#: Parts of a bucket, by block, that are sorted and written by tasks of their own: so many at least.
SLICES = 16
#: Postings, and pairs of question and passage, that one task holds, about; characters of text to a posting.
TASK_POSTINGS, TASK_PAIRS, POSTING_CHARS = 500_000, 8_000_000, 12
_SEGMENT = "segment int, bucket int, term string, block long, ids array<long>, tfs array<int>, plain array<boolean>, n int, max_tf int"
_TOMBSTONE = "segment int, chunk_id long"


def _counted(passages: DataFrame) -> DataFrame:
    """(chunk_id, word, tf) of the distinct words of each passage, counted inside its row: equal words of a sorted list are neighbours."""
    words = F.sort_array(F.regexp_extract_all(F.lower(F.col("text")), F.lit("[a-z][a-z0-9-]+"), F.lit(0)))
    listed = passages.select(F.col("chunk_id").cast("long").alias("chunk_id"), words.alias("words")).filter(F.size("words") > 0)
    opens = lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1))
    firsts = listed.withColumn("firsts", F.filter(F.sequence(F.lit(0), F.size("words") - 1), opens))
    entry = lambda at, j: F.struct(F.get("words", at).alias("word"), (F.coalesce(F.get("firsts", j + 1), F.size("words")) - at).alias("tf"))
    return firsts.select("chunk_id", F.explode(F.transform("firsts", entry)).alias("w")).select("chunk_id", "w.word", "w.tf")


def _blocked(each: DataFrame, buckets: int, n: int) -> DataFrame:
    """Postings (term, chunk_id, tf, plain) as sorted blocks of a list: (bucket, term, block, ids, tfs, plain, n, max_tf).

    Postings are shuffled once, by bucket and slice of blocks; rows of one term and passage are added up there. Of ``n``
    postings, about, a task takes ``TASK_POSTINGS``: there are more slices and tasks where there are more postings.
    """
    parts = max(each.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_POSTINGS))
    slices = max(SLICES, -(-4 * parts // buckets))
    block = F.floor(F.col("chunk_id") / BLOCK)
    keyed = each.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), F.pmod(block, F.lit(slices)).cast("int").alias("slice"), "term", block.alias("block"), "chunk_id", "tf", "plain").repartition(parts, "bucket", "slice")
    once = keyed.groupBy("bucket", "slice", "term", "block", "chunk_id").agg(F.sum("tf").cast("int").alias("tf"), F.max("plain").alias("plain"))
    row = F.struct("chunk_id", "tf", "plain")
    lists = once.groupBy("bucket", "slice", "term", "block").agg(F.array_sort(F.collect_list(row)).alias("list"), F.count_if("plain").cast("int").alias("n"), F.max("tf").alias("max_tf"))
    field = lambda name: F.transform("list", lambda x: x[name]).alias(name if name == "plain" else {"chunk_id": "ids", "tf": "tfs"}[name])
    return lists.select("bucket", "term", "block", field("chunk_id"), field("tf"), field("plain"), "n", "max_tf").sortWithinPartitions("bucket", "term", "block")


def posting_blocks(passages: DataFrame, buckets: int) -> DataFrame:
    """Posting blocks of ``passages(chunk_id, text)``.

    Words are counted inside their passage before they are stemmed, so one row a passage and distinct word is shuffled,
    once. A block holds ``BLOCK`` passages at most, so the list of a word that all passages hold is many rows. ``plain``
    marks passages that hold the term by a word that is no stop word; ``n`` counts them, as document frequencies do.
    """
    each = _counted(passages).select("chunk_id", stem(F.col("word")).alias("term"), "tf", (~F.col("word").isin(*STOPWORDS)).alias("plain"))
    n = passages.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // POSTING_CHARS
    return _blocked(each, buckets, n)


class InvertedIndex:
    """The index in one folder: ``postings`` by segment and bucket of the term, sorted by term, and ``tombstones``.

    :meth:`add` writes a segment for new or changed passages and marks what older segments say of them as dead;
    :meth:`remove` marks passages as dead; :meth:`compact` rewrites what lives as one segment in a new folder. Segments
    are only ever added, so readers see whole ones.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.last = -1

    def add(self, passages: DataFrame) -> InvertedIndex:
        """Index ``passages(chunk_id, text)``; ids that are known replace what was known. Null texts have no words."""
        known = passages.filter("chunk_id is not null")
        if self.last >= 0:
            self.remove(known.select("chunk_id"))
        self.last += 1
        blocks = posting_blocks(known, self.buckets)
        blocks.withColumn("segment", F.lit(self.last)).write.partitionBy("segment", "bucket").mode("append").parquet(f"{self.path}/postings")
        return self

    def remove(self, ids: DataFrame) -> None:
        """Mark passages of all segments so far as dead."""
        dead = ids.select(F.lit(self.last).alias("segment"), F.col("chunk_id").cast("long").alias("chunk_id")).distinct()
        dead.write.mode("append").parquet(f"{self.path}/tombstones")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as missing:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def blocks(self, terms: DataFrame | None = None) -> DataFrame:
        """Posting blocks, of ``terms(term)`` only if given: their buckets are pruned, then their rows."""
        every = self._read("postings", _SEGMENT)
        if terms is None:
            return every
        wanted = terms.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        return every.join(wanted, ["bucket", "term"], "left_semi")

    def live(self, blocks: DataFrame) -> DataFrame:
        """(term, block, chunk_id, tf, plain) of the postings of ``blocks`` that no later tombstone covers."""
        each = blocks.select("segment", "term", "block", F.explode(F.arrays_zip("ids", "tfs", "plain")).alias("p")).select("segment", "term", "block", F.col("p.ids").alias("chunk_id"), F.col("p.tfs").alias("tf"), F.col("p.plain").alias("plain"))
        dead = self._read("tombstones", _TOMBSTONE)
        if dead.isEmpty():
            return each.drop("segment")
        until = dead.groupBy("chunk_id").agg(F.max("segment").alias("until"))
        return each.join(until, "chunk_id", "left").filter(F.col("until").isNull() | (F.col("segment") > F.col("until"))).select("term", "block", "chunk_id", "tf", "plain")

    def term_stats(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df) of live passages. Without tombstones block sizes are summed and no list is opened."""
        blocks = self.blocks(terms)
        if self._read("tombstones", _TOMBSTONE).isEmpty():
            found = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        else:
            found = self.live(blocks).groupBy("term").agg(F.count_if("plain").alias("df"))
        return found.filter("df > 0")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(chunk_id, term, tf) of live passages."""
        return self.live(self.blocks(terms)).select("chunk_id", "term", "tf")

    def compact(self, path: str) -> InvertedIndex:
        """What lives, as the only segment of an index in another folder."""
        out = InvertedIndex(self.spark, path, self.buckets)
        out.last = 0
        n = self.blocks().agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
        rows = _blocked(self.live(self.blocks()), self.buckets, n).withColumn("segment", F.lit(0))
        rows.write.partitionBy("segment", "bucket").parquet(f"{path}/postings")
        return out

    def keyword_topk(self, terms: DataFrame, k: int = 40, allowed=None, first_blocks: int = 4) -> DataFrame:
        """(question_id, chunk_id, score, rank) for ``terms(question_id, term)``, as ``retrieval.keyword_topk`` gives it.

        Only the lists of question terms are read. A block's bound for a question is the sum of its maxima; the
        ``first_blocks`` best are scored, their k-th score is a threshold, and only blocks whose bound reaches it are
        opened after that. ``allowed(pairs)`` keeps the (question_id, chunk_id) pairs that count, before any ranking.
        Lists are opened by as many tasks as leave each about ``TASK_PAIRS`` pairs.
        """
        asked = written(terms.select("question_id", "term").distinct())
        lists = self.blocks(asked)
        wanted = asked.groupBy("term").agg(F.count("*").alias("times"))
        pairs = lists.groupBy("term").agg(F.sum("n").alias("n")).join(wanted, "term").agg(F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0))).first()[0]
        peaks = lists.groupBy("term", "block").agg(F.max("max_tf").alias("peak"))
        bounds = peaks.join(asked, "term").groupBy("question_id", "block").agg(F.sum("peak").alias("bound"))
        order = Window.partitionBy("question_id").orderBy(F.desc("bound"), "block")
        placed = written(bounds.withColumn("place", F.row_number().over(order)))
        dead = self._read("tombstones", _TOMBSTONE)
        dead = None if dead.isEmpty() else dead.groupBy("chunk_id").agg(F.max("segment").alias("until"))

        def scored(which: DataFrame, parts: int = 1) -> DataFrame:
            needed = which.select("question_id", "block").join(asked, "question_id")
            dealt = (lambda df: df.repartition(parts, "term", "block")) if parts > 2 else (lambda df: df)
            each = dealt(lists).join(dealt(needed), ["term", "block"]).select("question_id", "segment", F.explode(F.arrays_zip("ids", "tfs")).alias("p")).select("question_id", "segment", F.col("p.ids").alias("chunk_id"), F.col("p.tfs").alias("tf"))
            if dead is not None:
                each = each.join(dead, "chunk_id", "left").filter(F.col("until").isNull() | (F.col("segment") > F.col("until")))
            total = each.groupBy("question_id", "chunk_id").agg(F.sum("tf").alias("tf"))
            return total if allowed is None else allowed(total)

        head = scored(placed.filter(F.col("place") <= first_blocks))
        by_tf = Window.partitionBy("question_id").orderBy(F.desc("tf"))
        least = head.withColumn("n", F.row_number().over(by_tf)).filter(F.col("n") == k).select("question_id", F.col("tf").alias("least"))
        rest = placed.join(least, "question_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        r = F.col("tf") * 0.1
        return top_k(scored(rest, -(-pairs // TASK_PAIRS)).select("question_id", "chunk_id", F.round(r / (r + 1), 9).alias("score")), k)

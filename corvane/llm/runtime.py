"""Shared-folder tables, labelled samples and Arrow helpers for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset and the master local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_SCRATCH:
        _LOCAL_SCRATCH.append("file://" + tempfile.mkdtemp(prefix="corvane-"))
    return _LOCAL_SCRATCH[0]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The table cuts the lineage, survives lost executors, and forgets its partitioning, so a join on it
    gets an exchange of its own that adaptive execution can split where a key is hot.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/corvane-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialise` that nothing reads any more."""
    spark = df.sparkSession
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/corvane-" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, train, limit: int) -> DataFrame:
    """(doc_id, text, y) of about ``limit`` labelled rows at most, chosen by a hash of the id.

    Rows without id or label take no part; an id labelled twice takes the larger label. An id on many rows of ``docs``
    is one document and gives one row, the least of its texts.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & train(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    n = known.count()
    if n > limit:
        share = int(1_000_000 * limit / n)
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share)
    # at most about `limit` pairs of numbers: a fixed bound, whatever the input
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and, last, the text as a string under a name that clashes with none of them."""
    name = "text"
    while name in columns:
        name += "_"
    return docs.select(*columns, F.col("text").cast("string").alias(name))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and n + 1 offsets into them; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(offsets: np.ndarray, size: int):
    """Row ranges [i, j) that hold about ``size`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)

"""Tables written once in the folder that all executors share, and numbers that follow an order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset and the master local, a temporary folder of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="corvane-"))
    return _LOCAL[0]


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/corvane-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: evaluated once, and not again if an executor is lost."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Columns that hold places while rows are numbered; the low bits of AT count inside a partition.
AT, _PART, _BEFORE = "_at", "_part", "_before"
PLACE_BITS = 33


def in_order(rows: DataFrame, *by, parts: int | None = None) -> DataFrame:
    """``rows`` sorted by ``by`` over range partitions, ``parts`` if given, as a written table with ``AT``, a number that rises in that order.

    ``AT`` holds the partition and the place in it. Range bounds come from a sample, so a range-partitioned plan that
    is evaluated twice may place rows unlike; this one is evaluated by one write, whatever is read from it later.
    """
    ranged = rows.repartitionByRange(*([] if parts is None else [parts]), *by).sortWithinPartitions(*by)
    return written(ranged.withColumn(AT, F.monotonically_increasing_id()))


def part_of(at: str = AT) -> Column:
    return F.shiftright(at, PLACE_BITS)


def place_of(at: str = AT) -> Column:
    """The place in the partition, from 0 on."""
    return F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def numbered(rows: DataFrame, *by) -> DataFrame:
    """``rows`` with ``index``, their place from 1 on in the order of ``by``, without one partition for all of them.

    Counts of partitions, one small row each, give what stands before a partition; nothing else is shuffled again.
    """
    ordered = in_order(rows, *by)
    counts = ordered.groupBy(part_of().alias(_PART)).agg(F.count("*").alias("n"))
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition, no more
    before = counts.select(_PART, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(_BEFORE))
    placed = ordered.withColumn(_PART, part_of()).join(F.broadcast(before), _PART)
    return placed.withColumn("index", F.col(_BEFORE) + place_of() + 1).drop(_PART, _BEFORE, AT)

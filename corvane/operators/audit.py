"""Hash chain of audit events: hashing, verification and append."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.scratch import AT, PLACE_BITS, fresh_path, in_order, part_of, place_of

GENESIS = "0" * 64
#: Events of a piece of the log, about; one task sorts and chains a chain's share of a piece.
PIECE = 400_000


#: JSON escapes of the characters that a string must not hold as they are.
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_ESCAPES |= {chr(n): f"\\u{n:04x}" for n in range(32) if chr(n) not in _ESCAPES}


def json_string(value: Column) -> Column:
    """A string as JSON, characters beyond ASCII as they are; null as ``null``."""
    out = value
    for plain, escaped in _ESCAPES.items():
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    safe = F.when(value.rlike(r'[\x00-\x1f"\\]'), out).otherwise(value)  # few strings hold a character to escape
    return F.coalesce(F.concat(F.lit('"'), safe, F.lit('"')), F.lit("null"))


def canonical_record() -> Column:
    """The hashed fields of an event as JSON with sorted keys and no blanks.

    action, actor_user_id, created_at (UTC, microseconds), entity_id, entity_type and the payload, an object whose keys
    are sorted too; no payload is an empty object. A payload that is no JSON counts as a string.
    """
    text = lambda c: json_string(F.col(c).cast("string"))
    stamp = F.date_format(F.to_utc_timestamp("created_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    given = F.col("payload").cast("string")
    payload = F.coalesce(F.to_json(F.try_parse_json(given)), F.when(given.isNull(), F.lit("{}")), json_string(given))
    fields = {"action": text("action"), "actor_user_id": text("actor_user_id"), "created_at": F.concat(F.lit('"'), stamp, F.lit('+00:00"')), "entity_id": text("entity_id"), "entity_type": text("entity_type"), "payload": payload}
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def verify_chain(events: DataFrame) -> DataFrame:
    """(ok, events_checked, first_bad_seq, reason) of events with prev_hash and hash, one chain of any length.

    Each event needs only its predecessor. Hashes and their checks are made event by event, then written in the order
    of seq; neighbours meet in windows over the partitions of that table, and the last hash of each partition, one small
    row, is handed to the next. First the link to the previous hash counts, then the hash of the content.
    """
    expected = F.sha2(F.concat("prev_hash", canonical_record()).cast("binary"), 256)
    ordered = in_order(events.select("seq", "prev_hash", "hash", expected.eqNullSafe(F.col("hash")).alias("same")), "seq")
    last = ordered.groupBy(part_of().alias("part")).agg(F.max_by("hash", AT).alias("hash"))
    handed = last.select("part", F.lag("hash").over(Window.orderBy("part")).alias("handed"))  # a row for each partition
    within = Window.partitionBy("part").orderBy(AT)
    chain = ordered.withColumn("part", part_of()).join(F.broadcast(handed), "part").withColumn("before", F.coalesce(F.lag("hash").over(within), "handed", F.lit(GENESIS)))
    reason = F.when(~F.col("prev_hash").eqNullSafe(F.col("before")), F.lit("broken link")).when(~F.col("same"), F.lit("content changed"))
    found = chain.groupBy("part").agg(F.count("*").alias("n"), F.min(F.when(reason.isNotNull(), F.col(AT))).alias("bad_at"), F.min_by(F.struct("seq", reason.alias("reason")), F.when(reason.isNotNull(), F.col(AT))).alias("bad"))
    totals = found.agg(F.sum("n").alias("n"), F.min("bad_at").alias("bad_at"), F.min_by("bad", "bad_at").alias("bad"))
    before = found.join(F.broadcast(totals.select(part_of("bad_at").alias("bad_part"))), F.col("part") < F.col("bad_part")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"))
    checked = F.when(F.col("bad_at").isNull(), F.coalesce("n", F.lit(0))).otherwise(F.col("before") + place_of("bad_at"))
    return totals.crossJoin(before).select(F.col("bad_at").isNull().alias("ok"), checked.alias("events_checked"), F.col("bad.seq").alias("first_bad_seq"), F.col("bad.reason").alias("reason"))


def verify_chains(events: DataFrame, chain_col: str) -> DataFrame:
    """(chain, ok, events_checked, first_bad_seq, reason) of every chain, as :func:`verify_chain` gives it for one.

    A chain is one log's day, so neighbours meet in a window over a bounded chain; chains are checked side by side.
    """
    order = Window.partitionBy(chain_col).orderBy("seq")
    expected = F.sha2(F.concat("prev_hash", canonical_record()).cast("binary"), 256)
    last = F.coalesce(F.lag("hash").over(order), F.lit(GENESIS))
    reason = F.when(F.col("prev_hash") != last, F.lit("broken link")).when(F.col("hash") != F.col("expected"), F.lit("content changed"))
    checked = events.withColumn("expected", expected).withColumn("index", F.row_number().over(order)).withColumn("reason", reason)
    bad = F.min(F.when(F.col("reason").isNotNull(), F.struct("seq", "index", "reason"))).alias("bad")
    found = checked.groupBy(F.col(chain_col).alias("chain")).agg(F.count("*").alias("n"), bad)
    return found.select("chain", F.col("bad").isNull().alias("ok"), F.coalesce(F.col("bad.index") - 1, "n").cast("long").alias("events_checked"), F.col("bad.seq").alias("first_bad_seq"), F.col("bad.reason").alias("reason"))


def append_chain(events: DataFrame, chain_col: str, last_hashes: DataFrame | None = None) -> DataFrame:
    """Events with prev_hash and hash, chained per ``chain_col`` in order of seq, from each chain's last hash.

    A chain is serial by nature, its memory is not: the log is written in order, in pieces of about ``PIECE`` events, and
    each round chains the next piece of every chain, from the hash that the round before left. Chains are worked on
    side by side; a log of short chains takes one round.
    """
    ready = events.withColumn("record", canonical_record())
    ready = ready.withColumn("seed", F.lit(GENESIS)) if last_hashes is None else ready.join(last_hashes.select(chain_col, F.col("hash").alias("seed")), chain_col, "left").fillna({"seed": GENESIS})
    kept = [c for c in ready.columns if c not in ("record", "seed")]
    ordered = in_order(ready, chain_col, "seq", parts=-(-events.count() // PIECE) or 1)
    schema = ordered.select(*kept, AT).schema.add("prev_hash", "string").add("hash", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last, begun = None, "", False
        for batch in batches:
            before, after = [], []
            columns = [batch.column(batch.schema.get_field_index(c)) for c in (chain_col, "seed", "record")]
            for own, seed, record in zip(*(c.to_pylist() for c in columns), strict=True):
                if not begun or own != chain:
                    chain, last, begun = own, seed, True
                before.append(last)
                last = hashlib.sha256((last + record).encode()).hexdigest()
                after.append(last)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in (*kept, AT)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*kept, AT, "prev_hash", "hash"])

    chained = lambda rows: rows.repartition(chain_col).sortWithinPartitions(chain_col, AT).mapInArrow(run, schema)
    rounds = _continued(ordered, chain_col)
    if not rounds:
        return chained(ordered).drop(AT)
    spark, path = events.sparkSession, fresh_path(events.sparkSession)
    held = lambda heads: F.broadcast(spark.createDataFrame(heads, ordered.select(F.lit(0).alias("head_part"), F.col(chain_col).alias("head")).schema))
    of_head = (part_of() == F.col("head_part")) & F.col(chain_col).eqNullSafe(F.col("head"))
    chained(ordered.join(held([head for heads in rounds for head in heads]), of_head, "left_anti")).write.parquet(f"{path}/0")
    for n, heads in enumerate(rounds, 1):
        done = spark.read.schema(schema).parquet(f"{path}/{n - 1}")
        chains = held(heads).select("head").distinct()
        last = done.join(F.broadcast(chains), F.col(chain_col).eqNullSafe(F.col("head"))).groupBy("head").agg(F.max_by("hash", AT).alias("seed"))
        spans = [F.col(AT).between(part << PLACE_BITS, ((part + 1) << PLACE_BITS) - 1) for part, _ in heads]  # only these files are read
        rows = ordered.filter(reduce(or_, spans)).join(held(heads), of_head, "left_semi").drop("seed")
        chained(rows.join(F.broadcast(last), F.col(chain_col).eqNullSafe(F.col("head")), "left").drop("head")).write.parquet(f"{path}/{n}")
    return spark.read.schema(schema).parquet(*(f"{path}/{n}" for n in range(len(rounds) + 1))).drop(AT)


def _continued(ordered: DataFrame, chain_col: str) -> list[list[tuple]]:
    """Parts of ``ordered`` whose first chain goes on from the part before, with that chain: those that go on once, twice and so on.

    The driver sees one small row for each part.
    """
    ends = ordered.groupBy(part_of().alias("part")).agg(F.min_by(F.struct(chain_col), AT).alias("first"), F.max_by(F.struct(chain_col), AT).alias("last")).collect()
    rounds: dict[int, list[tuple]] = {}
    before, level = None, 0
    for end in sorted(ends, key=lambda end: end["part"]):
        first = end["first"][0]
        if before is not None and before["last"][0] == first:
            level = (level if before["first"][0] == first else 0) + 1
            rounds.setdefault(level, []).append((end["part"], first))
        else:
            level = 0
        before = end
    return [rounds[level] for level in sorted(rounds)]

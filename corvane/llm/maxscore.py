"""Exact top-k inner-product search by MaxScore over shards of dimension postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.runtime import materialise

#: Vectors of a shard: ``SHARD`` at least and ``LARGEST`` at most, between them a ``PARTS``-th of the table. Queries of a block.
SHARD, LARGEST, PARTS = 4096, 65_536, 64
QUERY_BLOCK = 65_536
#: Scores that a task holds at once: queries are searched in groups of so many pairs.
PAIRS = 1 << 20


class Shard:
    """Postings of one shard: for each dimension, the value that every vector has there.

    A dimension is a term. Its contribution to a query's score lies between two ends that the least and the greatest
    value of its list give, so the bounds work as in MaxScore over non-negative weights.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.vectors = np.ascontiguousarray(vectors[order])
        self.postings = np.ascontiguousarray(self.vectors.T)
        self.low, self.high = self.postings.min(axis=1), self.postings.max(axis=1)

    def top(self, query_id: int, query: np.ndarray, k: int, theta: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the ``k`` best vectors of at least ``theta``, ties to the smaller id."""
        _, at, scores = self.group(np.array([query_id]), query[None, :], k, np.array([theta]))
        return at, scores

    def groups(self, query_ids: np.ndarray, queries: np.ndarray, k: int, thetas: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """:meth:`group` over all queries, as many at a time as ``PAIRS`` allows."""
        size = max(1, PAIRS // max(1, len(self.ids)))
        for lo in range(0, len(queries), size):
            of, at, scores = self.group(query_ids[lo : lo + size], queries[lo : lo + size], k, thetas[lo : lo + size])
            yield of + lo, at, scores

    def group(self, query_ids: np.ndarray, queries: np.ndarray, k: int, thetas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, position and score of the ``k`` best vectors of each query of at least its theta, ties to the smaller id.

        The queries share an order of terms, the greatest bounds first, so their lists are read by matrix products.
        """
        none = -np.inf if queries.dtype.kind == "f" else np.iinfo(queries.dtype).min
        theta = np.where(np.isneginf(thetas), none, thetas).astype(queries.dtype)
        least, most = (pick(queries * self.low, queries * self.high) for pick in (np.minimum, np.maximum))
        terms = np.argsort(-(most - least).sum(axis=0), kind="stable")
        queries, least, most = queries[:, terms], least[:, terms], most[:, terms]
        zero = np.zeros((len(queries), 1), queries.dtype)
        rest = np.concatenate([np.cumsum(most[:, ::-1], axis=1)[:, ::-1], zero], axis=1)  # the most that terms[i:] give
        sure = np.concatenate([zero, np.cumsum(least, axis=1)], axis=1)  # the least that terms[:i] give
        first, last = np.searchsorted(self.ids, query_ids, "left"), np.searchsorted(self.ids, query_ids, "right")
        own = [(i, a, b) for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)) if a < b]
        lead = max(1, len(terms) // 8)
        reached = queries[:, :lead] @ self.postings[terms[:lead]]
        if len(self.ids) > 4 * k + 1 and (theta == none).any():
            # a first threshold from the vectors that lead in the strongest few terms
            seeds = np.argpartition(-reached, 4 * k, axis=1)[:, : 4 * k + 1]
            full = np.einsum("qsd,qd->qs", self.vectors[seeds[:, :, None], terms], queries)
            other = self.ids[seeds] != query_ids[:, None]
            kth = np.sort(np.where(other, full, none), axis=1)[:, -k]
            theta = np.where(other.sum(axis=1) >= k, np.maximum(theta, kth), theta)
        # essential terms: without them no vector of some query reaches its theta
        essential = max(lead, int(np.count_nonzero((sure[:, :-1] + rest[:, :-1] >= theta[:, None]).any(axis=0))))
        if lead < essential:
            reached += queries[:, lead:essential] @ self.postings[terms[lead:essential]]
        at, columns = essential, np.arange(len(self.ids))
        live = np.ones(reached.shape, bool)
        for i, a, b in own:
            live[i, a:b] = False
        # read the other terms while enough pairs stay competitive, then probe them pair by pair
        while at < len(terms):
            live &= reached + rest[:, at, None] >= theta[:, None]
            if np.count_nonzero(live) * 16 < live.size:
                break
            some = live.any(axis=0)
            if np.count_nonzero(some) * 2 < len(some):
                columns, live, reached = columns[some], live[:, some], reached[:, some]
            step = slice(at, at + 16)
            reached += queries[:, step] @ self.postings[terms[step]][:, columns]
            at = min(at + 16, len(terms))
        else:
            live &= reached >= theta[:, None]
        of, place = np.nonzero(live)
        scores, where = reached[of, place], columns[place]
        while at < len(terms) and len(of):
            step = slice(at, at + 16)
            scores = scores + np.einsum("pd,pd->p", queries[of, step], self.vectors[where[:, None], terms[step]])
            at = min(at + 16, len(terms))
            keep = scores + rest[of, at] >= theta[of]
            of, where, scores = of[keep], where[keep], scores[keep]
        order = np.lexsort((self.ids[where], -scores, of))
        of, where, scores = of[order], where[order], scores[order]
        nth = np.arange(len(of)) - np.searchsorted(of, of, "left")
        return of[nth < k], where[nth < k], scores[nth < k]


def packed_vectors(vectors: DataFrame) -> DataFrame:
    """``vectors(vec_id, z)`` -> (vec_id, size, raw): the components in the fewest bytes each, 2, 4 or 8, that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, raw = [], []
            for z in batch.column(1):
                values = z.values.to_numpy(zero_copy_only=False)
                most = max(-int(values.min(initial=0)) - 1, int(values.max(initial=0)))
                sizes.append(2 if most < 1 << 15 else 4 if most < 1 << 31 else 8)
                raw.append(values.astype(f"<i{sizes[-1]}").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int8()), pa.array(raw, pa.binary())], names=["vec_id", "size", "raw"])

    return vectors.select("vec_id", "z").mapInArrow(run, "vec_id long, size byte, raw binary")


def _rows(sizes: pa.Array, raw: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(r, f"<i{s}") for s, r in zip(sizes.to_pylist(), raw.to_pylist(), strict=True)]


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Rows padded with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for at, row in enumerate(rows):
        out[at, : len(row)] = row
    return out


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, z): floor(scale * x) of every component; vectors or components that are null or not finite are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))
    z = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), z.alias("z"))


def _searched(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Packed ``left(shard, block, ids, sizes, raws)`` and ``right(shard, block, q_ids, q_sizes, q_raws, thetas)`` -> (query_id, vec_id, score)."""
    work = left.join(right, ["shard", "block"]).select("ids", "sizes", "raws", "q_ids", "q_sizes", "q_raws", "thetas")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, raws, q_ids, q_sizes, q_raws, thetas = (batch.column(c)[i].values for c in range(7))
                rows, q_rows = _rows(sizes, raws), _rows(q_sizes, q_raws)
                width = max(map(len, [*rows, *q_rows]), default=0)
                v, qv = _matrix(rows, width), _matrix(q_rows, width)
                most = width * float(np.abs(v).max(initial=0)) * float(np.abs(qv).max(initial=0))
                if most < 2**52:
                    kind = np.float32 if most < 2**23 else np.float64  # sums of integers below 2**24 and 2**53 are exact
                    v, qv = v.astype(kind), qv.astype(kind)
                shard, asked = Shard(np.array(ids), v), np.array(q_ids)
                least = np.array([-np.inf if t is None else t for t in thetas.to_pylist()])
                for of, at, scores in shard.groups(asked, qv, k, least):
                    yield pa.RecordBatch.from_arrays([pa.array(asked[of]), pa.array(shard.ids[at]), pa.array(scores.astype(np.int64))], names=["query_id", "vec_id", "score"])

    return work.mapInArrow(run, "query_id long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``vectors(vec_id, z)``, ``queries(vec_id, z)`` -> (query_id, rank, vec_id, score).

    The ``k`` largest integer inner products of each query over all vectors whose id is not the query's, ties
    to the smaller vec_id. Vectors are dealt into about ``PARTS`` shards, more where one would pass ``LARGEST`` rows, and queries
    into blocks of about ``QUERY_BLOCK``, each packed into one row of 2 bytes a component where that holds it. One shard is searched
    first: its k-th score is a threshold with which a query goes to all shards. Every (shard, block) pair is one task
    row, searched by MaxScore, and the partial lists of a query are merged by a window that keeps ``k`` per task first.
    A shard is shipped once for each block of queries: at a fixed share of queries this grows with the square of the
    table, as the search does, divided by ``QUERY_BLOCK``; below ``PARTS * LARGEST`` vectors it grows with the table.

    A repeated vec_id counts once as a query (its smallest vector) and once a row as a candidate; vectors of
    unlike length are padded with zeros; other columns have no effect, whatever their names. Empty tables give an
    empty result.
    """
    queries = queries.groupBy("vec_id").agg(F.min("z").alias("z"))
    packed, sought = materialise(packed_vectors(vectors)), materialise(packed_vectors(queries))
    n, m = packed.count(), sought.count()
    shards, blocks = max(1, -(-n // max(SHARD, min(LARGEST, n // PARTS)))), max(1, -(-m // QUERY_BLOCK))
    dealt = lambda df, name, parts: df.withColumn(name, F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(parts)).cast("int"))
    lists = lambda prefix: [F.collect_list(c).alias(f"{prefix}{c}s") for c in ("size", "raw")]
    rows = dealt(packed, "shard", shards)
    asked = dealt(sought, "block", blocks)
    all_blocks, all_shards = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))

    def shard_rows(some: DataFrame) -> DataFrame:
        return some.groupBy("shard").agg(F.collect_list("vec_id").alias("ids"), *lists("")).withColumn("block", all_blocks)

    def block_rows(some: DataFrame, to) -> DataFrame:
        # a theta of null would fall out of the list, so it travels as the least number
        theta = F.collect_list(F.coalesce("theta", F.lit(float("-inf")))).alias("thetas")
        return some.groupBy("block").agg(F.collect_list("vec_id").alias("q_ids"), *lists("q_"), theta).withColumn("shard", to)

    first = _searched(shard_rows(rows.filter("shard = 0")), block_rows(asked.withColumn("theta", F.lit(None).cast("double")), F.lit(0)), k)
    theta = first.groupBy("query_id").agg(F.when((F.count("*") >= k) & (F.abs(F.min("score")) < 2**52), F.min("score").cast("double")).alias("theta"))
    asked = asked.join(theta, asked["vec_id"] == theta["query_id"], "left").drop("query_id")
    part = _searched(shard_rows(rows), block_rows(asked, all_shards), k)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

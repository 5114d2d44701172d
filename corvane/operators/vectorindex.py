"""An approximate vector index: k-means cells with product-quantised residuals as a stored table, exact scores at the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.retrieval import top_k

#: Rows that cells and codes are fitted on, at most; all rows are indexed.
SAMPLE_ROWS = 20_000
CENTROIDS = 256
QUERY_GROUP, CODED_ROWS = 64, 4096


def _lloyd(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k centres of the rows by Lloyd's rounds, begun at random rows; an empty cell takes a random row."""
    centres = rows[rng.choice(len(rows), k, replace=len(rows) < k)].copy()
    for _ in range(rounds):
        nearest = _nearest(rows, centres)
        for c in range(k):
            own = rows[nearest == c]
            centres[c] = own.mean(0) if len(own) else rows[rng.integers(len(rows))]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, in slices."""
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([np.argmax(rows[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(rows), 4096)] or [np.zeros(0, np.int64)])


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(lists), -1)


class VectorIndex:
    """Cells, codes and the folder of the coded table (cell, chunk_id, code), partitioned by cell.

    ``centres``: a row for each cell; ``books``: for each of ``parts`` slices of the dimensions, ``CENTROIDS`` centres of
    residuals; ``probes``: how many cells a query meets. All have a fixed size, whatever the corpus. Vectors are scaled to
    length one first.
    """

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray, books: list[np.ndarray], probes: int) -> None:
        self.spark, self.path, self.centres, self.books, self.probes = spark, path, centres, books, probes

    @property
    def slices(self) -> list[slice]:
        ends = np.cumsum([b.shape[1] for b in self.books]).tolist()
        return [slice(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _unit(df: DataFrame, key: str) -> DataFrame:
    """(id, vector) of vectors scaled to length one; null and zero vectors and null ids are left out."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    known = df.filter(F.col(key).isNotNull() & F.col("vector").isNotNull()).select(F.col(key).cast("long").alias("id"), "vector", norm.alias("norm")).filter("norm > 0")
    return known.select("id", F.transform("vector", lambda x: x.cast("double") / F.col("norm")).alias("vector"))


def _by_cell(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cells of each row, nearest first."""
    return np.argsort(0.5 * (centres**2).sum(1) - rows @ centres.T, axis=1, kind="stable")


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, rng: np.random.Generator) -> int:
    """The fewest cells that hold ``recall`` of the ``k`` nearest rows of the sample, over some of its rows as queries."""
    asked = sample[rng.choice(len(sample), min(400, len(sample)), replace=False)]
    near = np.argsort(-(asked @ sample.T), axis=1)[:, :k]
    place = np.argsort(_by_cell(asked, centres), axis=1)  # of each cell, for each query
    met = np.take_along_axis(place, _nearest(sample, centres)[near], 1)
    return int(np.quantile(met, recall, method="higher")) + 1


def build_index(vectors: DataFrame, path: str, cells: int | None = None, parts: int = 8, recall: float = 0.97, seed: int = 11) -> VectorIndex:
    """Fit cells and codes on a hash sample of ``vectors(chunk_id, vector)`` and write the coded table of all of them.

    Some ``SAMPLE_ROWS`` rows at most are fitted on, which the driver holds; about the square root of the number of
    vectors is the number of cells, 1024 at most. How many cells a query meets is set on the sample, so that ``recall`` of
    the 40 nearest are among them; nearest rows of a sample lie farther off than those of all, so it errs upwards. Coding is one pass without a shuffle but that by cell.
    """
    spark = vectors.sparkSession
    unit = _unit(vectors, "chunk_id")
    n = unit.count()
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    rows = unit.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("vector").limit(2 * SAMPLE_ROWS).collect()
    sample = np.array([r.vector for r in rows], np.float64)
    if not len(sample):
        sample = np.zeros((1, len((unit.first() or [0, [0.0]])[1])))
    rng = np.random.default_rng(seed)
    centres = _lloyd(sample, cells or min(1024, max(1, round(n**0.5))), rng)
    residuals = sample - centres[_nearest(sample, centres)]
    books = [_lloyd(part, min(CENTROIDS, len(sample)), rng, 6) for part in np.array_split(residuals, min(parts, sample.shape[1]), axis=1)]
    index = VectorIndex(spark, path, centres, books, _probes(sample, centres, 40, recall, rng))
    where = index.slices

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1))
            cell = _nearest(rows, centres)
            rest = rows - centres[cell]
            codes = np.stack([_nearest(rest[:, s], book) for s, book in zip(where, books, strict=True)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "chunk_id", "code"])

    coded = unit.mapInArrow(code, "cell int, chunk_id long, code binary")
    coded.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.partitionBy("cell").parquet(path)
    return index


def search(index: VectorIndex, queries: DataFrame, vectors: DataFrame, k: int = 40, probes: int | None = None, keep: int = 4, digits: int = 6) -> DataFrame:
    """(question_id, chunk_id, score, rank) for ``queries(question_id, vector)``: exact cosines of the best coded candidates.

    Each query meets the ``probes`` cells nearest to it; the coded rows of a cell are scored by table look-ups, batch by
    batch, and ``keep * k`` of each cell and query go on to exact scores against ``vectors(chunk_id, vector)``. Queries of
    a cell come to its rows by a join on the cell, in groups of some ``QUERY_GROUP`` queries and ``CODED_ROWS`` rows, so
    neither side of a cell is gathered whole, even one that copies fill.
    """
    centres, books, where = index.centres, index.books, index.slices
    probes = probes or index.probes

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _by_cell(_matrix(batch.column(1)), centres)[:, :probes]
            at = np.repeat(np.arange(batch.num_rows), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["cell", "id", "vector"])

    asked = _unit(queries, "question_id").mapInArrow(probe, "cell int, id long, vector array<double>")
    groups = max(1, queries.count() // QUERY_GROUP)
    grouped = asked.groupBy("cell", F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g")).agg(F.collect_list("id").alias("ids"), F.collect_list("vector").alias("vs"))
    coded = index.spark.read.schema("chunk_id long, code binary, cell int").parquet(index.path)
    sizes = coded.groupBy("cell").agg(F.count("*").alias("n"))  # a row for each cell, 1024 at most
    dealt = coded.join(F.broadcast(sizes), "cell").withColumn("b", F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("n") / CODED_ROWS)))
    blocks = dealt.groupBy("cell", "b").agg(F.collect_list("chunk_id").alias("chunk_ids"), F.collect_list("code").alias("codes"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_q, out_c, out_s = [], [], []
            for row in range(batch.num_rows):
                cell, ids, vs, chunk_ids, codes = (batch.column(c)[row] for c in range(5))
                q = _matrix(vs.values)
                stored = np.frombuffer(b"".join(codes.as_py()), np.uint8).reshape(-1, len(books))
                close = np.repeat((q @ centres[cell.as_py()])[:, None], len(stored), 1)
                for p, (s, book) in enumerate(zip(where, books, strict=True)):
                    close += (q[:, s] @ book.T)[:, stored[:, p]]
                n = min(keep * k, len(stored))
                best = np.argpartition(-close, n - 1, axis=1)[:, :n]
                out_q.append(np.repeat(ids.values.to_numpy(), n))
                out_c.append(chunk_ids.values.to_numpy()[best].ravel())
                out_s.append(np.take_along_axis(close, best, 1).ravel())
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_c, out_s)], names=["question_id", "chunk_id", "close"])

    pairs = grouped.join(blocks, "cell").select("cell", "ids", "vs", "chunk_ids", "codes").mapInArrow(score, "question_id long, chunk_id long, close double")
    candidates = top_k(pairs, keep * k, "close").select("question_id", "chunk_id")
    q = _unit(queries, "question_id").select(F.col("id").alias("question_id"), F.col("vector").alias("q"))
    c = _unit(vectors, "chunk_id").select(F.col("id").alias("chunk_id"), F.col("vector").alias("c"))
    dot = F.aggregate(F.zip_with("q", "c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    exact = candidates.join(q, "question_id").join(c, "chunk_id").select("question_id", "chunk_id", F.round(dot, digits).alias("score"))
    return top_k(exact, k)

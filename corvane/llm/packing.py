"""Vector best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.pretokens import WORD_PATTERN, id_bytes, little_endian, pretoken_table
from corvane.llm.runtime import materialise

#: Pieces that one group packs together.
GROUP_PIECES = 8192
#: Share of a sequence's tokens that may stay free without its pieces being packed again.
SLACK = 1 / 64
#: Weights of tokens, pieces and attention cost in the choice of a sequence.
WEIGHTS = (1.0, 0.25, 0.25)


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold: tokens, pieces, and attention cost (the sum of squared piece lengths)."""

    tokens: int = 4096
    pieces: int = 4096
    attention: int = 4096 * 4096


def pieces(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, piece, start, length, ids_crc32).

    A document is its ids followed by ``end_id``; only one longer than ``size`` is cut, every ``size`` ids. A
    null text counts as empty, so it is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = pretoken_table(vocabulary, WORD_PATTERN, str.lower, id_bytes)
        tail = little_endian([end_id])
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = b"".join(map(ids_of.__getitem__, ids_of.split(text.as_py() or ""))) + tail
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: Capacity, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in tokens) of each item, by vector best-fit decreasing.

    Items and residuals are vectors of tokens, pieces and attention cost, each as a share of its capacity. An
    item goes, among the open bins that can take it in every dimension, to the one with the least weighted
    norm of what would remain (``norm``) or the greatest weighted dot product of item and residual (``dot``),
    ties to the earliest; a new bin is opened only where none can take it.
    """
    caps = np.array([[capacity.tokens], [capacity.pieces], [capacity.attention]], float)
    n = len(lengths)
    needs = np.stack([lengths, np.ones(n, np.int64), lengths * lengths])
    if n and (needs.max(axis=1) > caps[:, 0]).any():
        raise ValueError(f"a piece of {lengths.max()} tokens exceeds the capacity of an empty sequence")
    scale = np.sqrt(np.array(weights)[:, None]) / caps  # a weighted residual is scale * residual
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left, number = np.zeros((3, n), np.int64), np.zeros(n, np.int64)  # residuals and numbers of open bins
    n_open = n_bins = 0
    least = needs.min(axis=1) if n else None
    for done, item in enumerate(np.argsort(-lengths, kind="stable")):
        need = needs[:, item]
        fits = np.flatnonzero((left[:, :n_open] >= need[:, None]).all(axis=0))
        if len(fits):
            room = left[:, fits]
            if rule == "norm":
                rest = (room - need[:, None]) * scale
                at = fits[int(np.argmin(np.einsum("ij,ij->j", rest, rest)))]
            else:
                at = fits[int(np.argmax((need[:, None] * scale * scale * room).sum(axis=0)))]
        else:
            at = n_open
            left[:, at], number[at] = caps[:, 0], n_bins
            n_open += 1
            n_bins += 1
        where[item], offset[item] = number[at], capacity.tokens - left[0, at]
        left[:, at] -= need
        if done % 64 == 63:  # bins that can take nothing more are closed
            keep = np.flatnonzero((left[:, :n_open] >= least[:, None]).all(axis=0))
            left[:, : len(keep)], number[: len(keep)] = left[:, keep], number[keep]
            n_open = len(keep)
    return where, offset


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pack_groups(cut: DataFrame, groups: int, level: int, capacity: Capacity, weights: tuple[float, float, float], rule: str) -> DataFrame:
    keyed = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level)), F.lit(groups)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        where, offset = best_fit(rows["length"].to_numpy(np.int64), capacity, weights, rule)
        rows["sequence_id"] = where + (rows["part"].to_numpy(np.int64) << 20) + (level << 58)
        rows["offset"] = offset
        return rows.drop(columns="part")

    return keyed.groupBy("part").applyInPandas(run, PLACED)


def pack(cut: DataFrame, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", group: int = GROUP_PIECES) -> DataFrame:
    """``cut(doc_id, piece, start, length, ids_crc32)``, a written table, with ``sequence_id`` and ``offset``.

    Pieces are dealt by a hash into groups of about ``group`` pieces, each packed on its own. What ends in
    sequences with more than ``SLACK`` of their tokens free is dealt and packed again, until one group holds it
    all or a round gains nothing; so part-filled sequences do not grow with the number of groups.
    """
    columns, done = cut.columns, []
    groups, level = max(1, -(-cut.count() // group)), 0
    placed = materialise(_pack_groups(cut, groups, level, capacity, weights, rule))
    while groups > 1 and level < 20:
        filled = placed.groupBy("sequence_id").agg(F.sum("length").alias("filled"), F.count("*").alias("n"))
        loose = materialise(filled.filter(F.col("filled") < capacity.tokens * (1 - SLACK)))
        pieces_left, bins, tokens = loose.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum("filled"), F.lit(0))).first()
        fewer = max(1, -(-pieces_left // group))
        if bins - -(-tokens // capacity.tokens) < fewer:  # no more to gain than a round may leave
            break
        done.append(placed.join(loose, "sequence_id", "left_anti").select(*columns, "sequence_id", "offset"))
        level += 1
        groups, before = fewer, groups
        placed = materialise(_pack_groups(placed.join(loose, "sequence_id", "left_semi").select(*columns), groups, level, capacity, weights, rule))
        if groups >= before:
            break
    return reduce(DataFrame.unionByName, done, placed)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> DataFrame:
    """Tokenise, cut and pack ``docs(doc_id, text)``: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Every document is packed once per row, repeated rows included; null and empty texts are one-token
    documents; a very long text is many pieces, dealt like all others; an empty table gives an empty result; other
    columns have no effect, whatever their names.
    """
    return pack(materialise(pieces(docs, vocabulary, capacity.tokens)), capacity, weights, rule)

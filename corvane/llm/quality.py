"""Quality scores: histogram gradient-boosted trees over statistics of a text, flattened into arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.runtime import labelled_sample, utf8, with_text
from corvane.llm.wordhash import hashed_words

#: At most about this many labelled rows are read to fit the trees.
SAMPLE_ROWS = 20_000

_CLASSES = np.zeros((256, 8))
_CLASSES[list(range(ord("a"), ord("z") + 1)), 0] = 1
_CLASSES[list(range(ord("A"), ord("Z") + 1)), 1] = 1
_CLASSES[list(range(ord("0"), ord("9") + 1)), 2] = 1
_CLASSES[[0x20, 9, 11, 12, 13], 3] = 1
_CLASSES[[10], 4] = 1
_CLASSES[[ord(c) for c in ".,;:'\"-()"], 5] = 1
_CLASSES[[ord(c) for c in "!?#$%&*+/<=>@[\\]^_`{|}~"], 6] = 1
_CLASSES[128:, 7] = 1
FEATURES = (
    "log_bytes", "log_words", "lower", "upper", "digit", "space", "newline", "stop", "symbol", "beyond_ascii",
    "mean_word", "deviation_word", "longest_word", "distinct_words", "distinct_pairs", "repeated_next", "commonest_word",
    "pipe", "exclaim", "hash_dollar", "percent_amp_star", "brace", "distinct_lines", "mean_line",
)


def _statistics(histogram: np.ndarray, words: np.ndarray, lengths: np.ndarray, text: bytes) -> list[float]:
    size, n = max(1.0, float(histogram.sum())), len(words)
    part = histogram @ _CLASSES / size
    sign = lambda chars: float(sum(histogram[ord(c)] for c in chars)) / size
    lines = text.split(b"\n")
    if n:
        ordered = np.sort(words)
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        runs = np.diff(edges)
        pairs = np.sort(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if n > 1 else words
        distinct_pairs = (1 + np.count_nonzero(pairs[1:] != pairs[:-1])) / max(1, len(pairs))
        per_word = [float(lengths.mean()), float(lengths.std()), float(lengths.max()), len(runs) / n, distinct_pairs, float(np.count_nonzero(words[1:] == words[:-1])) / n, float(runs.max()) / n]
    else:
        per_word = [0.0] * 7
    return [
        float(np.log1p(histogram.sum())), float(np.log1p(n)), *part.tolist(), *per_word,
        sign("|"), sign("!"), sign("#$"), sign("%&*"), sign("{}<>[]"), len(set(lines)) / len(lines), float(np.log1p(size / len(lines))),
    ]


def text_statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each whole text; a null counts as an empty text."""
    data, offsets = utf8(column)
    out = np.zeros((len(column), len(FEATURES)))
    for i, j, words, lengths, at in hashed_words(data, offsets):
        for k in range(j - i):
            text = data[offsets[i + k] : offsets[i + k + 1]]
            lo, hi = at[k], at[k + 1]
            out[i + k] = _statistics(np.bincount(text, minlength=256), words[lo:hi], lengths[lo:hi], text.tobytes())
    return out


@dataclass(frozen=True)
class Forest:
    """Trees side by side in flat arrays; a leaf points at itself, so every row takes ``depth`` equal steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.bias + self.value[node].sum(axis=1))))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Boosted trees with logistic loss, grown level by level over histograms of quantile bins."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    n, d = x.shape
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    margin = np.full(n, bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(left))
        right.append(len(right))
        value.append(v)
        return len(value) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(node(0.0))
        where = np.full(n, roots[-1])
        level = [roots[-1]]
        for step in range(depth + 1):
            grown = []
            for at in level:
                rows = np.flatnonzero(where == at)
                g, h = grad[rows].sum(), hess[rows].sum()
                value[at] = float(-rate * g / (h + ridge))
                if step == depth or len(rows) < 2 * least:
                    continue
                index = (binned[rows] + np.arange(d) * bins).ravel()
                total = lambda v, i=index: np.bincount(i, np.repeat(v, d), d * bins).reshape(d, bins).cumsum(axis=1)
                gl, hl, nl = total(grad[rows]), total(hess[rows]), total(np.ones(len(rows)))
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                for f in range(d):
                    gain[f, len(cuts[f]) :] = 0
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] <= 1e-6:
                    continue
                feature[at], threshold[at], left[at], right[at] = int(f), float(cuts[f][b]), node(0.0), node(0.0)
                goes = binned[rows, f] <= b
                where[rows[goes]], where[rows[~goes]] = left[at], right[at]
                grown += [left[at], right[at]]
            level = grown
        margin = margin + np.array(value)[where]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, bias)


def fit_quality(docs: DataFrame, labels: DataFrame, train, limit: int = SAMPLE_ROWS) -> Forest:
    """Fit the trees on at most about ``limit`` labelled rows for which ``train(doc_id)`` holds.

    The statistics of the sample are made in Spark; only they, a bounded number of rows, reach the driver.
    """
    sample = labelled_sample(docs, labels, "quality", train, limit).select("y", "doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_statistics(batch.column(2))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], names=["y", "doc_id", "x"])

    rows = sample.mapInArrow(run, "y int, doc_id long, x array<double>").toArrow().sort_by("doc_id")
    if rows.num_rows == 0:
        return fit_forest(np.zeros((1, len(FEATURES))), np.ones(1), trees=1)
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, len(FEATURES))
    return fit_forest(x, rows.column("y").to_numpy().astype(float))


def score_quality(docs: DataFrame, forest: Forest, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and ``score`` double, from 0 to 1, of each whole text.

    A null text scores as an empty one. Equal texts score alike. An empty table gives an empty result.
    """
    schema = docs.select(*columns).schema.add("score", "double")
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_statistics(batch.column(k))
            scores = [forest.scores(x[i : i + 1024]) for i in range(0, len(x), 1024)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*columns, "score"])

    return with_text(docs, columns).mapInArrow(run, schema)

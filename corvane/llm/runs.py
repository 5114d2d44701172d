"""Periodic runs of words: suffix trees of a stretch and its reversal, constant-time LCE, Lyndon roots extended both ways."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Two neighbouring periods of a run share every window of this many words; see :func:`stretches`.
WINDOW = 5
_PLACES = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of numbers from 1 on, closed by 0, and its leaves in two orders.

    ``rank[i]`` and ``rank_down[i]`` are the places of suffix i among all, by rising and by falling numbers; a
    suffix that ends comes first in both. :meth:`lce` is the string depth of the lowest common ancestor of two
    leaves, a range minimum over the Euler tour. Of the tour only the shallowest depth between two neighbouring
    leaves is kept, so its sparse table takes n log n numbers.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        self.text = np.append(symbols, 0)
        self.size = len(self.text)
        self._build(self.text.tolist(), int(self.text.max()) + 1)
        self.rank, between = self._tour(descending=False)
        self.rank_down, _ = self._tour(descending=True)
        self.table = [between]
        while (step := 1 << (len(self.table) - 1)) * 2 <= len(between):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))

    def _build(self, text: list[int], width: int) -> None:
        """Edges by node * width + first symbol; ``begin`` and ``end`` of the label above each node."""
        edges: dict[int, int] = {}
        begin, end, link, suffix = [-1], [-1], [0], [-1]
        n = len(text)
        node = edge = length = left = 0
        for i in range(n):
            symbol = text[i]
            left += 1
            fresh = 0
            while left:
                if not length:
                    edge = i
                key = node * width + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(begin)
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    suffix.append(i - left + 1)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    at = begin[child]
                    span = end[child] - at
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if text[at + length] == symbol:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    middle = len(begin)
                    begin += (at, i)
                    end += (at + length, n)
                    link += (0, 0)
                    suffix += (-1, i - left + 1)
                    edges[key] = middle
                    edges[middle * width + symbol] = middle + 1
                    begin[child] = at + length
                    edges[middle * width + text[at + length]] = child
                    if fresh:
                        link[fresh] = middle
                    fresh = middle
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self.keys = np.fromiter(edges.keys(), np.int64, len(edges))
        self.children = np.fromiter(edges.values(), np.int64, len(edges))
        self.width = width
        self.label = (np.array(end) - np.array(begin)).tolist()
        self.suffix = suffix

    def _tour(self, descending: bool) -> tuple[np.ndarray, np.ndarray]:
        """Place of each suffix in the order of leaves, and the depth of the fork before each leaf but the first."""
        parent, symbol = np.divmod(self.keys, self.width)
        # the stack takes children in reverse, so the last of a node's children here is visited first
        order = np.lexsort((np.where(symbol == 0, self.width, symbol) if descending else -symbol, parent))
        children = self.children[order].tolist()
        bounds = np.searchsorted(parent[order], np.arange(len(self.label) + 1)).tolist()
        label, suffix = self.label, self.suffix
        rank = np.zeros(self.size, np.int64)
        between: list[int] = []
        stack, depths = children[bounds[0] : bounds[1]], [0] * (bounds[1] - bounds[0])
        fork, place = -1, 0
        while stack:
            node, above = stack.pop(), depths.pop()
            if fork < 0:
                fork = above
            if suffix[node] >= 0:
                rank[suffix[node]] = place
                if place:
                    between.append(fork)
                place += 1
                fork = -1
            else:
                lo, hi = bounds[node], bounds[node + 1]
                stack += children[lo:hi]
                depths += [above + label[node]] * (hi - lo)
        return rank, np.array(between, np.int32)

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes i and j, which differ, element by element."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at, row = level == k, self.table[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k))])
        return out


def next_smaller(rank: list[int]) -> np.ndarray:
    """The next place with a smaller rank, for all places but the last."""
    out = np.zeros(len(rank) - 1, np.int64)
    stack: list[int] = []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def maximal_runs(symbols: np.ndarray) -> np.ndarray:
    """(start, length, period) of every maximal run of at least two periods, each once, in that order.

    The longest Lyndon word at a place ends before the next smaller suffix. By the runs theorem each run holds a
    Lyndon root, for one of the two orders of symbols, that is the longest at its place; so every such word is
    extended by LCE to the right in the tree of the sequence and to the left in that of its reversal.
    """
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    found = []
    for rank in (ahead.rank, ahead.rank_down):
        first = np.arange(n)
        period = next_smaller(rank.tolist()) - first
        first, period = first[first + period < n], period[first + period < n]
        if not len(first):
            continue
        right = ahead.lce(first, first + period)
        left = np.zeros(len(first), np.int64)
        inner = first > 0
        left[inner] = back.lce(n - first[inner], n - first[inner] - period[inner])
        whole = left + period + right >= 2 * period
        found.append(np.stack([first - left, left + period + right, period], 1)[whole])
    every = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def stretches(symbols: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint ranges of places that hold every run of LEAST_WORDS words and LEAST_PERIODS periods whole.

    In such a run of length L and period q, each window of five words that starts q or more words after the run's
    start also stands q words before; there are m = L - q - 4 >= 1 of them in a row, and L >= 4 q gives q <= (m + 4) / 3.
    So the windows with an earlier copy at most (m + 4) / 3 words back, in rows of m, mark all runs; each row is
    widened by that distance before and by the window after. Windows are compared by hash: equal hashes of unlike
    windows only widen what is searched.
    """
    n = len(symbols)
    if n < LEAST_WORDS:
        return []
    x = symbols.astype(np.uint64)
    m = n - WINDOW + 1
    hashes = x[:m] * _PLACES[0]
    for k in range(1, WINDOW):
        hashes += (x[k : m + k] + np.uint64(k)) * _PLACES[k]
    order = np.argsort(hashes, kind="stable")
    again = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    if not len(again):
        return []
    back = np.full(m, n, np.int64)
    back[order[again + 1]] = order[again + 1] - order[again]
    marked = back < n
    while True:
        edges = np.diff(np.concatenate(([0], marked.view(np.int8), [0])))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if not len(begin):
            return []
        reach = (end - begin + WINDOW - 1) // (LEAST_PERIODS - 1)
        far = np.zeros(m, np.int64)
        far[marked] = np.repeat(reach, end - begin)
        near = marked & (back <= far)
        if near.sum() == marked.sum():
            break
        marked = near
    out: list[tuple[int, int]] = []
    for lo, hi in zip(np.maximum(begin - reach, 0).tolist(), np.minimum(end + WINDOW - 1, n).tolist(), strict=True):
        while out and lo < out[-1][1]:
            earlier = out.pop()
            lo, hi = min(lo, earlier[0]), max(hi, earlier[1])
        out.append((lo, hi))
    return out


def runs_of(symbols: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of LEAST_WORDS words and LEAST_PERIODS periods at least, by start, then period."""
    parts = []
    for lo, hi in stretches(symbols):
        _, dense = np.unique(symbols[lo:hi], return_inverse=True)
        found = maximal_runs(dense.astype(np.int64) + 1)
        found[:, 0] += lo
        parts.append(found[found[:, 1] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * found[:, 2])])
    return np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)


def repeated_tail(n: int, seed: int) -> np.ndarray | None:
    """Numbers of the words that stand at each place once a text of ``n`` words is damaged; None if it is not."""
    if seed % 10 or not n:
        return None
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places < a, places, a + (places - a) % p)


def collapsed(words: list[bytes], found: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Words outside every run, or in the first period of each run that holds them, and their places."""
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, found[:, 0] + found[:, 2], 1)
    np.add.at(covered, found[:, 0] + found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    return [words[i] for i in kept.tolist()], kept


FIELDS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, damage: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, n_words, runs, collapsed), one row per row, of whole texts.

    Words are runs of characters other than 0x20 and 0x09-0x0D, numbered from 0. ``runs`` lists (start, length,
    period) of each stretch of consecutive words with smallest period ``period`` that no neighbour extends, of
    six words and four periods at least, by start, then period. ``collapsed`` has one space between the words that
    no run repeats: a word goes if a run holds it after that run's first period. ``damage`` first overwrites the
    tails of a tenth of the texts by copies of themselves, chosen by the id (:func:`repeated_tail`).

    Only the stretches of a text that windows of five words mark (:func:`stretches`, no run is lost) become suffix
    trees; all runs come from the trees. A text is worked on alone, so its memory, some 0.5 KB a word of its longest
    stretch, is bounded by the text. Null and empty texts have no words and no runs; texts without an id are not
    damaged. Repeated rows stay. An empty table gives an empty result; other columns have no effect.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, texts = [], [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (raw.as_py() or b"").split()
                tail = repeated_tail(len(words), zlib.crc32(str(doc_id).encode())) if damage and doc_id is not None else None
                if tail is not None:
                    words = [words[i] for i in tail.tolist()]
                numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
                of_text = runs_of(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                counts.append(len(words))
                found.append([{"start": s, "length": k, "period": p} for s, k, p in of_text.tolist()])
                texts.append(b" ".join(collapsed(words, of_text)[0] if len(of_text) else words))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id long, {FIELDS}")


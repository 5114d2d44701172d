"""Benchmark decontamination: a BM25 index of test items, block-max WAND per passage, overlap verification."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.runtime import materialise, with_text

#: Items in one index; more items are split into several indexes, run over all documents one after another.
INDEX_ITEMS = 20_000
INDEX_CHARS = 16_000_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str], width: int) -> set[tuple[str, ...]]:
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


class Item:
    """A test item: its last sentence counts as the answer, what comes before as the question."""

    def __init__(self, item_id: int, text: str, width: int) -> None:
        self.item_id, self.words = item_id, words_of(text)
        sentences = [s for s in _SENTENCE.split(text.strip()) if words_of(s)]
        self.answer = words_of(sentences[-1]) if len(sentences) > 1 else []
        question = self.words[: len(self.words) - len(self.answer)]
        if len(question) < width:  # too short to stand alone: the whole item is the question
            question, self.answer = self.words, []
        self.question = grams(question, width)

    def overlap(self, passage: list[str], width: int) -> tuple[float, float]:
        """Shares of the question and of the answer that stand in the passage.

        Both count ``width``-word runs; an answer of fewer words counts as one run of its own length.
        """
        there = grams(passage, width)
        question = len(self.question & there) / len(self.question) if self.question else 0.0
        if not self.answer:
            return question, question
        size = min(width, len(self.answer))
        own = grams(self.answer, size)
        return question, len(own & (there if size == width else grams(passage, size))) / len(own)

    def share(self, passage: list[str], width: int) -> float:
        """The greater of the whole item's share in the passage and the lesser one of question and answer."""
        whole = grams(self.words, width)
        size = min(width, len(self.words))
        return max(len(whole & grams(passage, size)) / len(whole), min(self.overlap(passage, width)))


def _greatest_loss(runs: set[tuple[str, ...]], weight: dict[str, float], overlap: float) -> float:
    """No less than the weight of the words that can be missing where at least ``overlap`` of the runs stand.

    A missing word takes along every run it is in, and a run is taken by no more words than it is long.
    """
    width = max(map(len, runs), default=0)
    room, lost = width * math.floor((1 - overlap) * len(runs) + 1e-9), 0.0
    inside = Counter(w for run in runs for w in set(run))
    for word in sorted(inside, key=lambda w: inside[w] / max(weight[w], 1e-12)):
        if room <= 0:
            break
        lost += weight[word] * min(1.0, room / inside[word])
        room -= inside[word]
    return lost


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range each number of the ranges [start, stop) is of, and the numbers."""
    n = stops - starts
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + starts[owner]


class Index:
    """An inverted index of items. A posting holds the term's BM25 weight divided by the item's own score.

    An item therefore scores 1 against a passage that holds all its words, or more with ``reach``, an (overlap, width,
    threshold): then each passage that can hold the item at that overlap scores the threshold. Items of like vocabulary and length
    stand in one block of ``BLOCK``; for each term the index lists the blocks it occurs in, in order, with its
    greatest weight there.
    """

    BLOCK = 8
    #: Passages that are searched together.
    TOGETHER = 4096

    def __init__(self, items: list[Item], k1: float = 1.2, b: float = 0.75, reach: tuple[float, int, float] | None = None) -> None:
        counts = {id(i): Counter(i.words) for i in items}
        df = Counter(w for c in counts.values() for w in c)
        common = {w: k for k, (w, _) in enumerate(df.most_common())}
        self.items = sorted(items, key=lambda i: (min(map(common.__getitem__, i.words)), len(i.words), i.item_id))
        mean = max(1.0, sum(len(i.words) for i in items) / max(1, len(items)))
        self.term = {w: t for t, w in enumerate(df)}
        idf = {w: math.log(1 + (len(items) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        self.weights: list[dict[int, float]] = []
        maxima: list[dict[int, float]] = [{} for _ in df]
        for at, item in enumerate(self.items):
            c = counts[id(item)]
            weight = {w: idf[w] * n * (k1 + 1) / (n + k1 * (1 - b + b * len(item.words) / mean)) for w, n in c.items()}
            own = sum(weight.values())
            if reach:
                overlap, width, threshold = reach
                loss = max(sum(_greatest_loss(runs, weight, overlap) for runs in parts) for parts in ([grams(item.words, width)], [item.question, grams(item.answer, width)]))
                own = min(own, max(own - loss, 1e-9) / threshold)
            self.weights.append({self.term[w]: x / own for w, x in weight.items()})
            for t, x in self.weights[-1].items():
                maxima[t][at // self.BLOCK] = max(x, maxima[t].get(at // self.BLOCK, 0.0))
        self.blocks = -(-len(items) // self.BLOCK)
        self.starts = np.concatenate([[0], np.cumsum([len(m) for m in maxima])]).astype(np.int64)
        listed = [sorted(m.items()) for m in maxima]
        self.block = np.array([k for m in listed for k, _ in m] + [self.blocks], np.int32)  # the last stands past every list
        self.maximum = np.array([x for m in listed for _, x in m] + [0.0], float)
        self.key = np.repeat(np.arange(len(maxima)), np.diff(self.starts)) * self.blocks + self.block[:-1]
        # the items behind each posting of a block: their places in the block and weights
        postings = sorted((t * self.blocks + at // self.BLOCK, at % self.BLOCK, x) for at, weight in enumerate(self.weights) for t, x in weight.items())
        self.members = np.append(np.searchsorted(np.array([k for k, _, _ in postings], np.int64), self.key), len(postings))
        self.place, self.weight = np.array([k for _, k, _ in postings], np.int64), np.array([x for _, _, x in postings], float)
        self.most = np.array([max(m.values()) for m in maxima] + [0.0])  # the last is for words of no item
        self.longest = max((len(i.words) for i in items), default=1)

    def pivots(self, passage: np.ndarray, term: np.ndarray, n: int, threshold: float) -> np.ndarray:
        """Numbers passage * blocks + block of the blocks whose maxima for a passage's terms reach the threshold, sorted.

        Block-max WAND, each step taken for all passages at once. The cursors of a passage stand in the order of
        their blocks; the pivot is the block at which the running sum of the terms' greatest weights reaches the
        threshold. Cursors before it skip to it by a search in their lists, blocks in between are never read. The
        pivot block counts where the maxima of the cursors on it reach the threshold; then these move on. A
        passage without a pivot is done.
        """
        threshold -= 1e-9
        cursor, most, passage = self.starts[term], self.most[term], passage.astype(np.int32)
        now = self.block[cursor]
        found: list[np.ndarray] = []
        while len(passage):
            order = np.argsort(passage * np.int32(self.blocks) + now, kind="stable")
            owner, total = passage[order], np.cumsum(most[order])
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            before = np.repeat(total[begin] - most[order[begin]], np.diff(np.append(begin, len(owner))))
            enough = np.flatnonzero(total - before >= threshold)
            first = enough[np.concatenate([[True], owner[enough[1:]] != owner[enough[:-1]]])] if len(enough) else enough
            pivot = np.full(n, -1, np.int32)
            pivot[owner[first]] = now[order[first]]
            to = pivot[passage]
            behind = np.flatnonzero(now < to)
            cursor[behind] = np.searchsorted(self.key, term[behind] * self.blocks + to[behind])
            self._move(cursor, term, now, behind)
            on = np.flatnonzero(now == to)
            reached = np.flatnonzero(np.bincount(passage[on], self.maximum[cursor[on]], n) >= threshold)
            found.append(reached * self.blocks + pivot[reached].astype(np.int64))
            cursor[on] += 1
            self._move(cursor, term, now, on)
            live = np.flatnonzero((to >= 0) & (now < self.blocks))
            passage, term, cursor, most, now = passage[live], term[live], cursor[live], most[live], now[live]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def scored(self, pivots: np.ndarray, term: np.ndarray, bounds: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
        """(passage, item) for the items of the pivot blocks whose full scores reach the threshold."""
        passage, block = np.divmod(pivots, self.blocks)
        owner, at = _ranges(bounds[passage], bounds[passage + 1])
        wanted = term[at] * self.blocks + block[owner]
        list_ = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        there = np.flatnonzero(self.key[list_] == wanted)
        of, posting = _ranges(self.members[list_[there]], self.members[list_[there] + 1])
        slot = owner[there][of] * self.BLOCK + self.place[posting]
        for hit in np.flatnonzero(np.bincount(slot, self.weight[posting], len(pivots) * self.BLOCK) >= threshold - 1e-9).tolist():
            pivot, item = divmod(hit, self.BLOCK)
            yield int(passage[pivot]), int(block[pivot]) * self.BLOCK + item

    def _move(self, cursor: np.ndarray, term: np.ndarray, now: np.ndarray, moved: np.ndarray) -> None:
        """Set the blocks on which moved cursors stand; past its list a cursor stands past every block."""
        at = cursor[moved]
        now[moved] = np.where(at < self.starts[term[moved] + 1], self.block[at], self.blocks)

    def passages(self, texts: Iterable[str], threshold: float, span: int) -> Iterator[tuple[int, list[str], list[int]]]:
        """(text number, passage, items that reach the threshold in it): windows of ``span`` words, half overlapping."""
        half, unknown = span // 2, len(self.term)
        held: list[tuple[int, list[str], np.ndarray, int, int]] = []  # text, its words, their terms, first passage and end
        count = 0
        for number, text in enumerate(texts):
            words = words_of(text)
            ids = np.fromiter(map(self.term.get, words, repeat(unknown)), np.int64, len(words))
            last = max(1, -(-(len(words) - half) // half))
            for first in range(0, last, self.TOGETHER):
                end = min(last, first + self.TOGETHER)
                if held and count + end - first > self.TOGETHER:
                    yield from self._together(held, count, threshold, span)
                    held, count = [], 0
                held.append((number, words, ids, first, end))
                count += end - first
        if held:
            yield from self._together(held, count, threshold, span)

    def _together(self, held: list, count: int, threshold: float, span: int) -> Iterator[tuple[int, list[str], list[int]]]:
        half, unknown = span // 2, len(self.term)
        size, keys, of = unknown + 1, [], []
        for number, words, ids, first, end in held:
            base, lo, hi = len(of), first * half, min((end - 1) * half + span, len(words))
            own = np.arange(lo, hi) // half - first  # each position lies in the passage that starts before it and in the one before that
            keys.append((base + np.minimum(own, end - first - 1)) * size + ids[lo:hi])
            keys.append((base + own[half:] - 1) * size + ids[lo + half : hi])
            of += [(number, words, k * half) for k in range(first, end)]
        key = np.concatenate(keys)
        key = np.sort(key[key % size != unknown])
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        passage, term = key // size, key % size
        keep = np.bincount(passage, self.most[term], count)[passage] >= threshold - 1e-9
        passage, term = passage[keep], term[keep]
        bounds = np.searchsorted(passage, np.arange(count + 1))
        found: dict[int, list[int]] = defaultdict(list)
        pivots = self.pivots(passage, term, count, threshold)
        for i in range(0, len(pivots), self.TOGETHER):
            for k, item in self.scored(pivots[i : i + self.TOGETHER], term, bounds, threshold):
                found[k].append(item)
        for k, items in found.items():
            number, words, start = of[k]
            yield number, words[max(0, start - half) : start + span + half], items


def contaminated(docs: DataFrame, benchmark: DataFrame, columns: list[str], overlap: float = 0.8, width: int = 5, threshold: float = 0.6) -> DataFrame:
    """``columns`` of ``docs`` with ``item_ids`` (sorted array of leaked items) and ``overlap`` (the greatest).

    Every passage of every whole text queries a BM25 index of the items; each item that scores at least
    ``threshold`` of its own score, or less where ``overlap`` can be reached with less, is verified: the whole item, or both its question and its answer, must share
    at least ``overlap`` of their ``width``-word runs with the passage. Words are compared in lower case without signs.

    Items with a null id or without a word leak nowhere; null and empty texts hold no leak; items that repeat
    leak together. Very long texts are searched ``Index.TOGETHER`` passages at a time. One index holds at most
    about ``INDEX_ITEMS`` items and ``INDEX_CHARS`` characters; that part of the benchmark is broadcast, and each
    worker builds its index once. A larger benchmark is taken in parts, one scan of all texts after another, so
    that one part is in memory at a time.
    """
    usable = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    n, chars = usable.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // INDEX_ITEMS), -(-chars // INDEX_CHARS))
    part_of = lambda part: sorted((r.item_id, r.text) for r in usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect())
    texts = with_text(docs, columns)
    if parts == 1:
        return _scan(texts, part_of(0), columns, overlap, width, threshold)
    # a leak depends on the text alone: each part leaves the digests of the texts in which it found some
    name = texts.columns[-1]
    digests = texts.select(F.sha2(F.col(name).cast("binary"), 256).alias("digest"), F.col(name).alias("text"))
    found = [materialise(_scan(digests, part_of(part), ["digest"], overlap, width, threshold).filter("size(item_ids) > 0").distinct()) for part in range(parts)]
    leaks = reduce(DataFrame.unionByName, found).groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("leaked"), F.max("overlap").alias("most"))
    keyed = texts.select(F.struct(*columns).alias("row"), F.sha2(F.col(name).cast("binary"), 256).alias("digest"))
    joined = keyed.join(leaks, "digest", "left")
    return joined.select("row.*", F.coalesce("leaked", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("most", F.lit(0.0)).alias("overlap"))


_index: dict[tuple, Index] = {}  # the index that this worker built last


def _scan(docs: DataFrame, items: list[tuple[int, str]], columns: list[str], overlap: float, width: int, threshold: float) -> DataFrame:
    schema = docs.select(*columns).schema.add("item_ids", T.ArrayType(T.LongType())).add("overlap", "double")
    k = len(columns)
    part = docs.sparkSession.sparkContext.broadcast(items)
    name = (uuid.uuid4().hex, overlap, width, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _index:
            _index.clear()
            _index[name] = Index([item for item in (Item(i, t, width) for i, t in part.value) if item.words], reach=(overlap, width, threshold))
        index = _index[name]
        for batch in batches:
            leaked: list[dict[int, float]] = [{} for _ in range(batch.num_rows)]
            for number, passage, hits in index.passages((t.as_py() or "" for t in batch.column(k)), threshold, max(128, 2 * index.longest)):
                for item in map(index.items.__getitem__, hits):
                    share = item.share(passage, width)
                    if share >= overlap:
                        leaked[number][item.item_id] = max(share, leaked[number].get(item.item_id, 0.0))
            ids, best = [sorted(x) for x in leaked], [max(x.values(), default=0.0) for x in leaked]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())], names=[*columns, "item_ids", "overlap"])

    return docs.mapInArrow(run, schema)

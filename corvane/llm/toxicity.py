"""Toxicity scores from a weighted grammar of finite-state transducers over clauses.

The lexicon of insults (whole words and productive stems) is learned from labelled rows. Insult, threat, target,
negation and reported-speech transducers are composed into one weighted machine that reads a clause as a
sequence of word classes; the best path of a clause gives its patterns. The arc weights of the patterns are those
of a logistic model over how often each stands in a text, which also turns them into the text's score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.runtime import labelled_sample, materialise, with_text

# Seed words of each class, in English, German, French and Spanish.
SEED_INSULTS = ("clown", "disgusting", "idiot", "idiota", "imbécile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
THREATS = ("beat", "burn", "destroy", "hurt", "kill", "shoot", "stab", "strangle", "töten", "tuer", "matar", "verletzen", "frapper", "golpear")
INTENT = ("will", "going", "want", "wants", "wanna", "gonna", "quiero", "veux", "möchte", "shall", "should", "must", "werde", "wird", "vais", "va", "voy", "vamos", "let's", "i'll", "we'll")
TARGETS = ("you", "your", "you're", "yours", "yourself", "yourselves", "himself", "herself", "themselves", "dir", "te", "he", "she", "they", "them", "him", "her", "people", "du", "dich", "ihr", "euch", "tu", "toi", "vous", "eres", "usted", "ustedes", "ellos")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "don't", "won't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás", "ni")
REPORTS = ("said", "says", "call", "called", "calls", "wrote", "quoted", "claimed", "reported", "sagte", "nannte", "dit", "écrit", "dijo", "llamó", "according")

PATTERNS = ("insult", "aimed insult", "negated insult", "reported insult", "threat", "weak threat")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_BREAK = re.compile(r"[.!?;:\n]")
STEM_LENGTHS = (4, 5, 6, 7)
#: At most about this many labelled rows are read to fit the lexicon and the weights.
SAMPLE_ROWS = 20_000
ROUNDS = 4


@dataclass(frozen=True)
class Transducer:
    """A finite-state transducer over word classes that may have several arcs for one class.

    ``arcs[state, class]`` are alternatives (next state, emitted class). A class without arcs passes unchanged and
    leads to ``otherwise[state]``; a state without such an entry has no way on. A clause must end in ``final``.
    """

    arcs: dict[tuple[int, str], tuple[tuple[int, str], ...]]
    otherwise: dict[int, int]
    final: frozenset[int]

    def step(self, state: int, c: str) -> tuple[tuple[int, str], ...]:
        if found := self.arcs.get((state, c)):
            return found
        return ((self.otherwise[state], c),) if state in self.otherwise else ()


def _window(opener: str, rewrites: dict[str, str], reach: int, stop: str = "") -> Transducer:
    """Rewrites classes that follow ``opener`` within ``reach`` words, and not after a ``stop`` in between."""
    arcs = {(s, opener): ((1, opener),) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, c): ((s, to),) for c, to in rewrites.items()}
        if stop:
            arcs[s, stop] = ((0, stop),)
    return Transducer(arcs, {s: s + 1 if 0 < s < reach else 0 for s in range(reach + 1)}, frozenset(range(reach + 1)))


def _imperative(machine: Transducer, verb: str, threat: str, target: str) -> Transducer:
    """``machine``, but a verb that opens a clause and has a target right after it is a threat too."""
    shifted = {(s + 2, c): tuple((to + 2, out) for to, out in ways) for (s, c), ways in machine.arcs.items()}
    first = {(0, c): ways for (s, c), ways in shifted.items() if s == 2}
    # a guess: in state 1 the next word has to be the target
    first[0, verb] = ((1, threat), *first.get((0, verb), ((2, verb),)))
    otherwise = {s + 2: to + 2 for s, to in machine.otherwise.items()}
    return Transducer(shifted | first | {(1, target): ((2, target),)}, otherwise | {0: otherwise[2]}, frozenset({0, *(s + 2 for s in machine.final)}))


def _target(before: int, after: int) -> Transducer:
    """Aims insults (i, j) at a target at most ``before`` words earlier or ``after`` later, intended threats (t) at any of the clause.

    A target still to come is a guess: the state then owes one, within ``after`` words for an insult, by the end of
    the clause for a threat, and a path that does not pay has no way on or does not end in a final state.
    """
    states = [(near, seen, due, owed) for near in range(before + 1) for seen in (0, 1) for due in range(after + 1) for owed in (0, 1)]
    number = {s: k for k, s in enumerate(states)}
    arcs: dict[tuple[int, str], tuple[tuple[int, str], ...]] = {}
    otherwise: dict[int, int] = {}
    for (near, seen, due, owed), k in number.items():
        arcs[k, "P"] = ((number[before, 1, 0, 0], "P"),)
        if due == 1:  # the next word has to be the target
            continue
        later = (max(near - 1, 0), seen, max(due - 1, 0), owed)
        otherwise[k] = number[later]
        for c in "ij":
            guess = (later[0], seen, due - 1 if due else after, owed)
            arcs[k, c] = ((number[later], "a"),) if near else ((number[later], c), (number[guess], "a"))
        arcs[k, "t"] = ((number[later], "T"),) if seen else ((number[later], "t"), (number[(*later[:3], 1)], "T"))
    return Transducer(arcs, otherwise, frozenset(k for (_, _, due, owed), k in number.items() if not due and not owed))


# Classes: I insult, V violent verb, W intent, P target, N negation, R report, o other; i and j the first and further
# words of an insult, a an aimed one, t and T a threat without and with a target, n negated, r reported, w weakened.
INSULT = Transducer({(0, "I"): ((1, "i"),), (1, "I"): ((1, "j"),)}, {0: 0, 1: 0}, frozenset((0, 1)))
THREAT = _imperative(_window("W", {"V": "t"}, 6), "V", "t", "P")  # an intent, then a violent verb; or an order
TARGET = _target(5, 3)
NEGATE = _window("N", {"i": "n", "j": "n", "a": "n", "T": "w", "t": "w"}, 4, "P")  # a negation before, with no target between
REPORT = _window("R", {"i": "r", "j": "r", "a": "r", "T": "w", "t": "w"}, 8)  # a report verb earlier in the clause
CASCADE = (INSULT, THREAT, TARGET, NEGATE, REPORT)
_EMITS = {"i": 0, "j": 0, "a": 1, "n": 2, "r": 3, "T": 4, "t": 5, "V": 5, "w": 5}
#: Arc weights by emitted pattern before any are learned.
PRIOR = (3.0, 3.5, 1.5, 1.5, 3.0, 0.5)


class Grammar:
    """The composition of the five transducers, with the weight of the emitted pattern on each arc.

    A composed state is one state of each transducer; each transducer reads what the one before emits. Arcs are
    composed when first met and kept. A clause scores the weight of its best path.
    """

    def __init__(self, weights: tuple[float, ...] = PRIOR, cascade: tuple[Transducer, ...] = CASCADE) -> None:
        self.weights, self.cascade = weights, cascade
        self.number: dict[tuple[int, ...], int] = {(0,) * len(cascade): 0}
        self.states = list(self.number)
        self.arcs: dict[tuple[int, str], list[tuple[int, int, float]]] = {}

    def _compose(self, state: int, c: str) -> list[tuple[int, int, float]]:
        ways: list[tuple[tuple[int, ...], str]] = [((), c)]
        for machine, own in zip(self.cascade, self.states[state], strict=True):
            ways = [((*done, to), out) for done, read in ways for to, out in machine.step(own, read)]
        found = []
        for reached, out in ways:
            if reached not in self.number:
                self.number[reached] = len(self.states)
                self.states.append(reached)
            pattern = _EMITS.get(out, -1)
            found.append((self.number[reached], pattern, self.weights[pattern] if pattern >= 0 else 0.0))
        self.arcs[state, c] = found
        return found

    def best(self, classes: Iterable[str]) -> tuple[float, tuple[int, ...]]:
        """Weight of the best path through a clause, and how often it emits each pattern."""
        front: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, (0,) * len(PATTERNS))}
        arcs = self.arcs
        for c in classes:
            reached: dict[int, tuple[float, tuple[int, ...]]] = {}
            for state, (weight, counts) in front.items():
                for to, pattern, more in arcs[state, c] if (state, c) in arcs else self._compose(state, c):
                    if to not in reached or weight + more > reached[to][0]:
                        reached[to] = (weight + more, (*counts[:pattern], counts[pattern] + 1, *counts[pattern + 1 :]) if pattern >= 0 else counts)
            front = reached
        ends = [w for s, w in front.items() if all(own in m.final for own, m in zip(self.states[s], self.cascade, strict=True))]
        return max(ends, key=lambda w: w[0])


@dataclass(frozen=True)
class Lexicon:
    """Insults as whole words and as stems (prefixes of words)."""

    words: frozenset[str]
    stems: frozenset[str]

    def trigger(self) -> re.Pattern:
        """Finds words that can start a match; texts without one need no clause analysis."""
        stems = [re.escape(s) + r"[^\W\d_]*" for s in sorted(self.stems)]
        words = [re.escape(w) for w in sorted({*self.words, *THREATS})]
        return re.compile(r"(?<![^\W\d_])(?:" + "|".join([*words, *stems]) + r")(?![^\W\d_])")

    def classes(self, word: str) -> str:
        if word in self.words or any(word[:n] in self.stems for n in STEM_LENGTHS):
            return "I"
        for c, known in (("V", THREATS), ("W", INTENT), ("P", TARGETS), ("N", NEGATIONS), ("R", REPORTS)):
            if word in known:
                return c
        return "o"


def clause_patterns(text: str, lexicon: Lexicon, trigger: re.Pattern, grammar: Grammar) -> list[int]:
    """How often each of ``PATTERNS`` stands on the best paths of the clauses of a whole text.

    Clauses are read whole, however long; only those with a word that can start a match are read at all.
    """
    lowered = text.lower()
    counts = [0] * len(PATTERNS)
    begin = done = 0
    for hit in trigger.finditer(lowered):
        if hit.start() < done:
            continue
        for b in _BREAK.finditer(lowered, done, hit.start()):
            begin = b.end()
        begin = max(begin, done)
        end = _BREAK.search(lowered, hit.end())
        done = end.end() if end else len(lowered)
        found = grammar.best(lexicon.classes(w[0]) for w in _WORD.finditer(lowered, begin, done))[1]
        counts = [a + b for a, b in zip(counts, found, strict=True)]
    return counts


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    weights: tuple[float, ...]
    bias: float

    def grammar(self) -> Grammar:
        """The machine with the learned weights on its arcs."""
        return Grammar(self.weights)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + np.log1p(counts) @ np.array(self.weights))))


def _features(text: str) -> set[str]:
    """Distinct words of a text, and their prefixes marked by a leading ^."""
    words = {w[0] for w in _WORD.finditer(text.lower())}
    return words | {"^" + w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n}


def _counted(sample: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """(feature, n): in how many texts each feature occurs; partial counts are made in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found = _features(text or "")
                counts.update(found if wanted is None else found & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["feature", "n"])

    return sample.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _fit_lexicon(sample: DataFrame) -> Lexicon:
    """Greedy cover of the toxic sample by precise words and stems.

    Candidates are features of at least three distinct toxic texts, at least 95 % of whose texts (weighted to
    equal classes) are toxic. They are taken in order of how many toxic texts they add, so that words that
    merely come with an insult, as in groups of copies, add nothing and stay out.
    """
    texts = sample.groupBy("text").agg(F.max("y").alias("y"))
    toxic, clean = texts.filter("y = 1"), texts.filter("y = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    if n_toxic == 0:
        return Lexicon(frozenset(SEED_INSULTS), frozenset())
    least = max(3, n_toxic // 400)
    # features of a bounded sample that many of its toxic texts share: their number is bounded too
    seen = {r.feature: r.n for r in _counted(toxic, None).filter(F.col("n") >= least).collect()}
    bad = {r.feature: r.n for r in _counted(clean, frozenset(seen)).collect()}

    def precise(f: str) -> bool:
        p, q = seen[f] / n_toxic, (bad.get(f, 0) + 0.5) / (n_clean + 1)
        return p / (p + q) >= 0.95 and bad.get(f, 0) <= 0.01 * seen[f]

    candidates = frozenset(f for f in seen if precise(f))
    covers: dict[str, set[int]] = {f: set() for f in candidates}
    members: list[set[str]] = []

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(_features(t or "") & candidates) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["found"])

    for k, r in enumerate(toxic.select("text").mapInArrow(matched, "found array<string>").collect()):
        members.append(set(r.found))
        for f in r.found:
            covers[f].add(k)
    words, stems = set(), set()
    gain = 2 if n_toxic >= 60 else 1
    while covers:
        best = max(covers, key=lambda f: (len(covers[f]), f[0] != "^", len(f), f))
        new = set(covers.pop(best))
        if len(new) < gain:
            break
        (stems if best[0] == "^" else words).add(best.lstrip("^"))
        for k in new:
            for f in members[k]:
                if f in covers:
                    covers[f].discard(k)
    # what the cover left out because better-known words stand beside it, but is as frequent and as precise
    for f in candidates:
        if f[0] != "^" and seen[f] >= 0.1 * n_toxic and bad.get(f, 0) == 0:
            words.add(f)
    # and productive stems: shortest first, with several endings, in no clean text
    endings = Counter("^" + w[:n] for w in candidates if w[0] != "^" for n in STEM_LENGTHS if len(w) > n)
    for f in sorted(candidates, key=lambda f: (len(f), f)):
        if f[0] == "^" and endings[f] >= 4 and bad.get(f, 0) == 0 and seen[f] >= 0.01 * n_toxic and not any(f[1:].startswith(s) for s in stems):
            stems.add(f[1:])
    return Lexicon(frozenset(words | set(SEED_INSULTS)), frozenset(stems))


def _pattern_counts(docs: DataFrame, lexicon: Lexicon, columns: list[str], weights: tuple[float, ...]) -> DataFrame:
    """``columns`` and ``counts``, an array of how often each pattern matches in ``text`` on the best paths under ``weights``."""
    schema = docs.select(*columns).schema.add("counts", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigger, grammar = lexicon.trigger(), Grammar(weights)
        for batch in batches:
            counts = [clause_patterns(t.as_py() or "", lexicon, trigger, grammar) for t in batch.column(len(columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(counts, pa.list_(pa.int32()))], names=[*columns, "counts"])

    return with_text(docs, columns).mapInArrow(run, schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train, limit: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn lexicon and weights from at most about ``limit`` labelled rows for which ``train(doc_id)`` holds.

    Which path is best depends on the weights, so patterns are counted again under the weights learned from them, until
    these stay or ``ROUNDS`` are over. Repeated rows count once in the lexicon and as often as they stand in the weights.
    """
    sample = materialise(labelled_sample(docs, labels, "toxic", train, limit).select("text", "y"))
    lexicon = _fit_lexicon(sample)
    weights, bias = PRIOR, -1.0
    for _ in range(ROUNDS):
        rows = sorted((r.y, tuple(r.counts), r["count"]) for r in _pattern_counts(sample, lexicon, ["y"], weights).groupBy("y", "counts").count().collect())
        if {y for y, _, _ in rows} != {0, 1}:
            return ToxicityModel(lexicon, PRIOR, -1.0)
        before, (weights, bias) = weights, _fit_weights(rows)
        if np.allclose(weights, before, rtol=1e-6):
            break
    return ToxicityModel(lexicon, weights, bias)


def _fit_weights(rows: list[tuple[int, tuple[int, ...], int]]) -> tuple[tuple[float, ...], float]:
    """Arc weights and bias from (label, pattern counts, number of texts)."""
    x = np.log1p(np.array([counts for _, counts, _ in rows], float))
    y = np.array([label for label, _, _ in rows], float)
    times = np.array([n for _, _, n in rows], float)
    times = times / times.sum()
    # logistic regression by gradient steps; a matched pattern never lowers a score
    w, b = np.ones(x.shape[1]), -2.0
    for _ in range(4000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = times * (p - y)
        w = np.maximum(w - 4.0 * (x.T @ g + 1e-5 * w), 0.0)
        b -= 4.0 * g.sum()
    # patterns too rare to learn from keep the order of the grammar: plain and aimed insults weigh most
    w[0] = max(w[0], 1e-3)
    w[1] = max(w[1], w[0])
    for k, share in ((2, 0.5), (3, 0.5), (4, 1.0), (5, 0.05)):
        met = x[:, k] > 0
        if not met.any():
            w[k] = share * w[0]
        elif k < 5 and times[met] @ y[met] >= 0.9 * times[met].sum():
            w[k] = w[0]  # the labels do not excuse this pattern
    w[4] = max(w[4], w[5])
    return tuple(float(v) for v in w), float(b)


def score_toxicity(docs: DataFrame, model: ToxicityModel, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and ``score`` double, from 0 to 1, of each whole text.

    A null text scores as an empty one: the model's score of no match at all. Equal texts score alike, very long
    ones are read whole, an empty table gives an empty result, and no column but the text has an effect.
    """
    schema = docs.select(*columns).schema.add("score", "double")
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigger, grammar = model.lexicon.trigger(), model.grammar()
        for batch in batches:
            counts = [clause_patterns(t.as_py() or "", model.lexicon, trigger, grammar) for t in batch.column(k)]
            scores = model.scores(np.array(counts, float).reshape(-1, len(PATTERNS)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(scores)], names=[*columns, "score"])

    return with_text(docs, columns).mapInArrow(run, schema)

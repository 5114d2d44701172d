import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm.entries import op12_periodic_runs
from corvane.llm.runs import SuffixTree, find_runs, maximal_runs, runs_of, stretches


def by_hand(words, least=6, periods=4):
    """Runs straight from their definition: for every period, maximal stretches of words that equal those before."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= 2 * q:
                out.setdefault((i, j + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items() if e - s >= max(least, periods * q) and smallest(words[s:e]) == q)


def smallest(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[:-q])


def numbers(words):
    return np.array([ord(w) if isinstance(w, str) else w for w in words], np.int64)


def test_all_runs_of_small_words():
    rng = random.Random(1)
    for _ in range(400):
        words = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(0, 40))]
        got = [tuple(r) for r in maximal_runs(numbers(words) + 1).tolist()]
        assert got == sorted(got, key=lambda r: (r[0], r[2])) and sorted(got) == by_hand(words, 0, 2), words


def test_long_runs_in_marked_stretches():
    rng = random.Random(2)
    for k in range(300):
        words = []
        while len(words) < 60:
            unit = [rng.randrange(rng.choice([2, 4, 30])) for _ in range(rng.randrange(1, 9))]
            words += (unit * rng.randrange(1, 8))[: rng.randrange(1, 40)]
        assert [tuple(r) for r in runs_of(numbers(words)).tolist()] == by_hand(words), (k, words)


def test_tree_orders_and_extensions():
    rng = random.Random(3)
    for _ in range(60):
        words = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 50))]
        tree, n = SuffixTree(numbers(words)), len(words)
        assert sorted(range(n + 1), key=lambda i: words[i:]) == np.argsort(tree.rank).tolist()
        assert sorted(range(n + 1), key=lambda i: [-w for w in words[i:]]) == np.argsort(tree.rank_down).tolist()
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
        a, b = np.array(pairs).T
        want = [next((k for k in range(n) if i + k >= n or j + k >= n or words[i + k] != words[j + k]), n) for i, j in pairs]
        assert tree.lce(a, b).tolist() == want


def test_texts_without_near_copies_build_no_tree():
    words = list(range(3000))
    assert stretches(numbers(words)) == [] and stretches(numbers(words + words)) == []
    assert stretches(numbers([*words, *[5000, 5001] * 4, *words]))[0][0] >= 2990


SCHEMA = "doc_id long, text string"


def test_texts_by_hand(spark):
    rows = [(1, "a b c\t" * 4), (1, "a b c\t" * 4), (None, "x " * 6), (3, None), (4, ""), (5, " \n"), (6, "x x x x x"), (7, "é É é É é É é É z"), (8, "w w " * 6)]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("runs"), F.lit(2).alias("collapsed"), F.lit(3).alias("n_words"))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(docs).collect()), key=repr)
    want = [(1, 12, [(0, 12, 3)], "a b c")] * 2 + [(3, 0, [], ""), (4, 0, [], ""), (5, 0, [], ""), (6, 5, [], "x x x x x"), (7, 9, [(0, 8, 2)], "é É z"), (8, 6, [(0, 6, 1)], "w w"), (None, 6, [(0, 6, 1)], "x")]
    assert got == sorted(want, key=repr)
    assert find_runs(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    words[20_000:32_000] = (words[20_000:22_000] * 6)[:12_000]
    words[50_000:50_030] = ["no"] * 30
    row = find_runs(spark.createDataFrame([(1, " ".join(words))], SCHEMA)).first()
    assert [tuple(r) for r in row.runs] == [(20_000, 12_000, 2_000), (50_000, 30, 1)]
    assert row.collapsed.split(" ") == words[:22_000] + words[32_000:50_001] + words[50_030:]


def damaged(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_on_given_texts(spark, sf):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for row in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = damaged(row.doc_id, row.text)
        runs = [r for r in by_hand(words)] if len(words) < 1500 else None
        if runs is None:
            continue
        runs.sort(key=lambda r: (r[0], r[2]))
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        rest = (*best, 1000 * best[1] // best[2] if runs else None)
        want[row.doc_id] = (len(runs), *rest, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    got = {r.doc_id: tuple(r)[1:] for r in op12_periodic_runs(spark, sf).collect()}
    assert len(want) > 150 and sum(w[0] > 0 for w in want.values()) > 10
    assert {k: got[k] for k in want} == want

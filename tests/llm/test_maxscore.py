import random

import numpy as np

from corvane.llm.maxscore import Shard, exact_top_k, integer_vectors


def brute(ids, vectors, query_id, query, k):
    scored = sorted((-int(np.dot(query, v)), i) for i, v in zip(ids, vectors, strict=True) if i != query_id)
    return [(i, -s) for s, i in scored[:k]]


def test_shards_equal_brute_force():
    rng = np.random.default_rng(3)
    for n, d, spread in ((1, 4, 9), (7, 16, 3), (300, 64, 90), (800, 24, 2)):
        ids, v = rng.permutation(n * 3)[:n], rng.integers(-spread, spread + 1, (n, d)).astype(float)
        shard = Shard(ids, v)
        for a in range(0, n, 5):
            at, scores = shard.top(int(ids[a]), v[a], 5)
            assert list(zip(shard.ids[at].tolist(), scores.astype(int).tolist(), strict=True)) == brute(ids.tolist(), v, ids[a], v[a], 5)


def test_query_over_many_shards(spark, monkeypatch):
    from corvane.llm import maxscore

    monkeypatch.setattr(maxscore, "SHARD", 50)
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", 4)
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(20)]  # ties
    odd = [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8)]
    v = integer_vectors(spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").repartition(3))
    z = {r.vec_id: np.array(r.z) for r in v.collect()}
    assert set(z) == {i for i, _ in rows}
    got = {}
    for r in exact_top_k(v, v.filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ids = list(z)
    assert set(got) == {i for i in ids if i % 50 == 0}
    for q, found in got.items():
        assert [found[k] for k in range(1, 6)] == brute(ids, [z[i] for i in ids], q, z[q], 5)
    assert exact_top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_short_and_large_vectors(spark):
    v = spark.createDataFrame([(0, [2**40, 1]), (1, [2**20]), (2, [3, 2**41, 5]), (2, [3, 2**41, 5])], "vec_id long, z array<long>")
    got = [(r.vec_id, r.score) for r in exact_top_k(v, v.filter("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got == [(1, 2**60), (2, 3 * 2**40 + 2**41), (2, 3 * 2**40 + 2**41)]


def test_clashing_columns(spark):
    rows = [(i, [i % 7 - 3, i % 5], "x", i, b"", 0.5, 1) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, z array<long>, shard string, block int, raw binary, theta double, rank int")
    plain = v.select("vec_id", "z")
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(exact_top_k(v, v.filter("vec_id % 10 = 0"), 3)) == order(exact_top_k(plain, plain.filter("vec_id % 10 = 0"), 3))


def test_groups_of_queries_equal_brute_force(monkeypatch):
    from corvane.llm import maxscore

    monkeypatch.setattr(maxscore, "PAIRS", 3000)
    rng = np.random.default_rng(5)
    for n, d, spread, kind in ((3, 4, 5, np.float32), (400, 40, 90, np.float32), (700, 24, 1, np.float64), (300, 20, 2**28, np.int64)):
        ids, v = rng.permutation(n * 3)[:n], rng.integers(-spread, spread + 1, (n, d)).astype(kind)
        ids[1] = ids[0]  # a repeated id is no candidate of its own query
        shard = Shard(ids, v)
        exact = v.astype(np.int64)
        for theta in (-np.inf, float(spread)):
            got = {i: [] for i in range(n)}
            for of, at, scores in shard.groups(ids, v, 5, np.full(n, theta)):
                for i, a, s in zip(of.tolist(), shard.ids[at].tolist(), scores.tolist(), strict=True):
                    got[i].append((a, int(s)))
            for i in range(n):
                assert got[i] == [(a, s) for a, s in brute(ids.tolist(), exact, ids[i], exact[i], 5) if s >= theta]


def test_a_query_block_is_shipped_a_bounded_number_of_times(spark, monkeypatch):
    from corvane.llm import maxscore

    monkeypatch.setattr(maxscore, "SHARD", 2)
    monkeypatch.setattr(maxscore, "PARTS", 8)
    v = spark.createDataFrame([(i, [i % 11 - 5, i % 7 - 3]) for i in range(400)], "vec_id long, z array<long>")
    shipped, searched = [], maxscore._searched
    monkeypatch.setattr(maxscore, "_searched", lambda left, right, k: shipped.append(right.count()) or searched(left, right, k))
    assert exact_top_k(v, v.filter("vec_id % 50 = 0"), 5).count() == 40
    assert max(shipped) <= 8  # not one for every two vectors

"""Exact vector search: nothing is gathered, and blocks and shares of any size give what all pairs give."""

import contextlib
import io
import os

import duckdb
import numpy as np
import pytest

from corvane.operators import retrieval as r
from corvane.plans import registry, retrieval  # noqa: F401  (importing a module registers its queries)
from corvane.sources.views import BASE

SF = "/root/testdata/sf0.001"
KINDS = "vector array<{}>, doc double"


def tables(spark, kind="double", n_queries=40, n_vectors=500, dim=6):
    """Vectors of few values, so that many score alike; some ids twice, one vector under many ids."""
    rng = np.random.default_rng(9)
    some = lambda: [float(x) for x in rng.integers(-2, 3, dim)]
    odd = [(None, [1.0] * dim, 0.0), (7001, None, 0.0), (7002, [0.0] * dim, 0.0), (7003, [1.0, None] + [0.5] * (dim - 2), 0.0)]
    vectors = [(n, some(), float(n % 5)) for n in range(n_vectors)] + [(n, some(), 1.0) for n in range(0, n_vectors, 9)] + [(9000 + n, [1.0] * dim, float(n % 5)) for n in range(90)]
    queries = [(n, some(), float(n % 5)) for n in range(n_queries)] + [(3, some(), 2.0), (4, [1.0] * dim, 3.0)]
    made = lambda rows, key: spark.createDataFrame([*rows, *odd], f"{key} long, " + KINDS.format(kind)).repartition(5)
    return queries, vectors, made(queries, "question_id"), made(vectors, "chunk_id")


def by_hand(queries, vectors, k, counts=lambda q, c: True):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    found = {}
    for q, a, s in queries:
        found.setdefault(q, []).extend((-round(float(unit(a) @ unit(b)), 6) + 0.0, c) for c, b, t in vectors if any(a) and any(b) and counts(s, t))
    return sorted((q, c, -score, n) for q, rows in found.items() for n, (score, c) in enumerate(sorted(rows)[:k], 1))


def rows(df):
    return sorted((x.question_id, x.chunk_id, round(x.score, 6), x["rank"]) for x in df.collect())


@pytest.mark.parametrize("block,share,kind", [(7, 30, "double"), (1000, 30, "float"), (7, 1000, "float")])
def test_blocks_and_shares_give_what_all_pairs_give(spark, monkeypatch, block, share, kind):
    monkeypatch.setattr(r, "QUERY_BLOCK", block, raising=False)
    monkeypatch.setattr(r, "SHARE_ROWS", (share, share), raising=False)
    queries, vectors, q, c = tables(spark, kind)
    assert rows(r.vector_topk(q, c, k=12)) == by_hand(queries, vectors, 12)
    got = r.vector_topk(q, c, k=12, tags=("doc",), allowed=lambda a, b, scores: (a[:, :1] != b[:, 0]) & (scores < 0.9))
    near = lambda s, t: s != t
    unlike = [x for x in by_hand(queries, vectors, 10_000, near) if x[2] < 0.9]
    want = [x for q_id in sorted({x[0] for x in unlike}) for x in sorted((x for x in unlike if x[0] == q_id), key=lambda x: x[3])[:12]]
    assert [x[:3] for x in sorted(rows(got), key=lambda x: (x[0], x[3]))] == [x[:3] for x in want]


def test_batches_and_many_queries(spark):
    """More queries than are scored at a time, and batches that end within a share."""
    queries, vectors, q, c = tables(spark, "float", 300, 700)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert rows(r.vector_topk(q, c, k=5)) == by_hand(queries, vectors, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_sides(spark):
    _, _, q, c = tables(spark)
    assert r.vector_topk(q.limit(0), c).count() == 0 and r.vector_topk(q, c.limit(0)).count() == 0


def test_blocks_are_neither_gathered_nor_broadcast(spark):
    """Adaptive execution broadcast the blocks of queries, once for each block of vectors, as it saw the size of one copy."""
    _, _, q, c = tables(spark)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        r.vector_topk(q, c).explain()
    assert "collect_list" not in out.getvalue() and "Join" not in out.getvalue() and "Broadcast" not in out.getvalue()


def test_only_distinct_vectors_are_searched(spark, monkeypatch, tmp_path):
    """A vector that many chunks have is one row of the search; ids of vectors may repeat, and a vector be null."""
    for t in BASE:
        if t != "embeddings":
            os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    rng = np.random.default_rng(4)
    made = [(n, [float(x) for x in rng.normal(size=5)], 0) for n in [*range(101), *range(0, 101, 5)]]
    spark.createDataFrame([*made, (101, None, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    met, search = [], r.vector_topk
    monkeypatch.setattr(r, "vector_topk", lambda q, c, *a, **b: met.append(c.count()) or search(q, c, *a, **b))
    got = registry.QUERIES["h06_vector_topk"](spark, str(tmp_path))
    duck = duckdb.connect()
    for t in BASE:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet{'/*.parquet' if t == 'embeddings' else ''}'")
    want = duck.sql(registry.ORACLE_SQL["h06_vector_topk"]).fetchall()
    assert rows(got) == sorted((a, b, round(s, 6), n) for a, b, s, n in want) and len(want) == 80
    assert met[0] <= len(made)

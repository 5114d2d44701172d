import numpy as np
import pytest

from corvane.operators import retrieval as r
from corvane.operators import vectorindex
from corvane.plans import registry, retrieval  # noqa: F401  (importing a module registers its queries)
from corvane.sources.scratch import fresh_path


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_at_40_over_all_ids_divisible_by_100(spark, sf):
    row = registry.QUERIES["h06_index_recall"](spark, sf).first()
    assert row.n > 0 and row.recall >= 0.9, row


def test_scores_are_exact_and_copies_are_split(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in (rng.normal(size=12) if k % 3 else np.ones(12))]) for k in range(15_000)] + [(20_000, None), (20_001, [0.0] * 12), (None, [1.0] * 12)]
    vectors = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    queries = vectors.filter("chunk_id % 1000 = 1").withColumnRenamed("chunk_id", "question_id")
    index = vectorindex.build_index(vectors, fresh_path(spark), cells=40)
    stored = spark.read.parquet(index.path)
    assert stored.count() == 15_000 and stored.select("chunk_id").distinct().count() == 15_000
    got = vectorindex.search(index, queries, vectors, k=10, probes=40, keep=20)
    exact = r.vector_topk(queries, vectors, k=10)
    fields = lambda df, *names: sorted(map(tuple, df.select(*names).collect()))
    distinct = "question_id % 3 <> 0"  # a copy has thousands of equals, of which any may be found
    assert fields(got.filter(distinct), "question_id", "chunk_id", "score", "rank") == fields(exact.filter(distinct), "question_id", "chunk_id", "score", "rank")
    assert fields(got, "question_id", "rank", "score") == fields(exact, "question_id", "rank", "score")
    assert vectorindex.search(index, queries.limit(0), vectors).count() == 0


def test_an_empty_table_gives_an_empty_index(spark):
    none = spark.createDataFrame([], "chunk_id long, vector array<double>")
    index = vectorindex.build_index(none, fresh_path(spark))
    asked = spark.createDataFrame([(1, [1.0])], "question_id long, vector array<double>")
    assert vectorindex.search(index, asked, none).count() == 0

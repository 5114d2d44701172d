import numpy as np
import pyarrow as pa

from corvane.llm.quality import FEATURES, fit_forest, fit_quality, score_quality, text_statistics
from corvane.llm.runtime import fold


def test_forest_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    forest = fit_forest(x[:3000], y[:3000])
    assert ((forest.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.97


def test_flat_traversal_equals_walking_each_tree():
    rng = np.random.default_rng(1)
    x, y = rng.random((500, 4)), rng.integers(0, 2, 500).astype(float)
    forest = fit_forest(x, y, trees=10)

    def walk(row):
        total = forest.bias
        for node in forest.roots:
            while forest.left[node] != node:
                node = (forest.left if row[forest.feature[node]] <= forest.threshold[node] else forest.right)[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.scores(x[:100]), [walk(r) for r in x[:100]])


def test_statistics_of_odd_texts():
    x = text_statistics(pa.array([None, "", " ", "a b a\na b a", "é" * 70_000, "word " * 400_000]))
    assert x.shape == (6, len(FEATURES)) and np.isfinite(x).all() and (x[0] == x[1]).all()
    assert x[3, FEATURES.index("distinct_words")] == 2 / 6 and x[3, FEATURES.index("distinct_lines")] == 0.5


def test_fit_and_score(spark):
    good, bad = "plain words of some prose that reads on and on {}", "### $$$ {} %%% &&& !!!"
    rows = [(i, (bad if i % 4 == 0 else good).format(i)) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(None, 1)], "doc_id long, quality int")
    forest = fit_quality(docs, labels, lambda d: fold(d, 5) != 0)
    got = {r.doc_id: r.score for r in score_quality(docs, forest, ["doc_id"]).collect()}
    assert len(got) == 401 and all((got[i] >= 0.3) == (i % 4 != 0) for i in range(400))
    assert score_quality(docs.limit(0), fit_quality(docs.limit(0), labels.limit(0), lambda d: fold(d, 5) != 0), ["doc_id"]).count() == 0


def test_repeated_rows_clashing_columns_and_one_class(spark):
    rows = [(i % 3, f"some text {i % 3} of words", 0.5, i) for i in range(30)] + [(None, None, 0.5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, y int")
    for labels in ([(0, 1), (1, 1), (2, 1)], [(0, 0), (1, 0), (2, 0)], [(0, 1), (0, 0), (1, 0)]):
        forest = fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), lambda d: fold(d, 5) != 9)
        got = score_quality(docs, forest, ["doc_id"]).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert len({(r.doc_id, r.score) for r in got}) == 4  # equal texts score alike

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import governance as g
from corvane.operators import retrieval as r
from corvane.operators.inverted import InvertedIndex
from corvane.plans import registry, retrieval  # noqa: F401  (importing a module registers its queries)
from corvane.sources.scratch import fresh_path

WORDS = ["heparin", "doses", "dosing", "the", "being", "be", "renal", "limits", "limit", "aPTT", "ward", "x"]


def passages(spark, rng, ids):
    return spark.createDataFrame([(k, None if rng.random() < 0.05 else " ".join(rng.choices(WORDS, k=rng.randrange(0, 30)))) for k in ids], "chunk_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_deltas_and_tombstones_equal_a_rebuild(spark):
    rng = random.Random(1)
    first, changed, more = passages(spark, rng, range(700)).cache(), passages(spark, rng, range(300, 500)).cache(), passages(spark, rng, range(5000, 5100)).cache()
    gone = spark.createDataFrame([(k,) for k in range(0, 700, 9)], "chunk_id long")
    index = InvertedIndex(spark, fresh_path(spark), buckets=4).add(first).add(changed).add(more)
    index.remove(gone)
    live = first.join(changed, "chunk_id", "left_anti").unionByName(changed).unionByName(more).join(gone, "chunk_id", "left_anti").cache()
    rebuilt = InvertedIndex(spark, fresh_path(spark), buckets=4).add(live)
    compacted = index.compact(fresh_path(spark))
    terms = spark.createDataFrame([(1, "heparin"), (1, "dos"), (2, "limit"), (2, "renal"), (2, "ward"), (3, "nowhere")], "question_id long, term string")
    stats, posts, best = rows(r.term_stats(live)), rows(r.postings(live)), rows(r.keyword_topk(terms, live, k=15).select("question_id", "chunk_id", "score", "rank"))
    for one in (index, rebuilt, compacted):
        assert rows(one.term_stats()) == stats
        assert rows(one.postings().select("chunk_id", "term", "tf")) == posts
        assert rows(one.keyword_topk(terms, k=15, first_blocks=1).select("question_id", "chunk_id", "score", "rank")) == best
    assert {x.term for x in index.blocks(terms).select("term").distinct().collect()} == {"heparin", "dos", "limit", "renal", "ward"}
    assert InvertedIndex(spark, fresh_path(spark)).add(first.limit(0)).keyword_topk(terms).count() == 0


def test_intervals_agree_with_every_day(spark):
    rng = random.Random(2)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    stamp = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(k)
    versions = [(v, rng.randrange(6), rng.choice(["approved", "approved", "superseded", "draft"]), day(rng.randrange(12)), rng.choice([None, stamp(rng.randrange(5))])) for v in range(40)]
    chunks = [(c, rng.randrange(40), rng.choice(["1", "1.2", "2", "2.1#1", "3(a)", "0"])) for c in range(120)]
    links = [(k, rng.randrange(40), rng.randrange(6), rng.choice([None, "1", "2.1", "3"]), day(rng.randrange(14)), rng.random() < 0.4) for k in range(8)]
    documents, branches = [(d, d % 2 == 0) for d in range(6)], [(d, b) for d in range(6) for b in range(3) if (d + b) % 3]
    v = spark.createDataFrame(versions, "version_id long, document_id long, status string, effective_from date, approved_at timestamp").cache()
    c = spark.createDataFrame(chunks, "chunk_id long, version_id long, section_path string").cache()
    x = spark.createDataFrame(links, "link_id long, source_version_id long, target_document_id long, target_section_path string, effective_from date, confirmed boolean").cache()
    d, b = spark.createDataFrame(documents, "document_id long, network_wide boolean"), spark.createDataFrame(branches, "document_id long, branch_id int")
    scoped = g.scoped_intervals(g.chunk_intervals(c, v, x), d, b).cache()
    points = [(k, branch, day(k)) for k in range(0, 15, 4) for branch in (None, 0, 2)]
    points = [(n, p[1], p[2]) for n, p in enumerate(points)]
    got = g.eligible_at(scoped, spark.createDataFrame(points, "point_id long, branch_id int, as_of date"), days=3).collect()
    found = {}
    for point_id, chunk_id in got:
        found.setdefault(point_id, []).append(chunk_id)
    for n, branch, as_of in points:
        want = g.eligible_chunks(c, v, x, as_of, g.branch_scope(d, b, branch)).select("chunk_id").collect()
        assert sorted(found.get(n, [])) == sorted(w.chunk_id for w in want), (branch, as_of)
    assert sum(map(len, found.values())) > 20


def test_pool_boosts_and_maxp_by_hand(spark):
    fused = spark.createDataFrame([(1, c, 0.1, c) for c in range(1, 15)], "question_id long, chunk_id long, rrf double, rank int")
    keyed = spark.createDataFrame([(1, c) for c in (2, 9, 11, 12, 14)], "question_id long, chunk_id long")
    assert [x.chunk_id for x in r.build_pool(fused, keyed).orderBy("rank").collect()] == [*range(1, 9), 9, 11, 12]
    rows_ = [(1, 0.5, True, "circular", True, dt.date(2026, 1, 1)), (2, 0.5, False, "circular", False, dt.date(2024, 1, 2)), (3, 0.5, False, "policy", True, dt.date(2020, 1, 1))]
    given = spark.createDataFrame(rows_, "chunk_id long, rerank double, branch_specific boolean, doc_type string, amends_something boolean, effective_from date")
    assert [x.final for x in r.authority_boosts(given, "2026-01-01").orderBy("chunk_id").collect()] == [0.67, 0.5, 0.5]
    pool = spark.createDataFrame([(1, "heparin dose limit", 7, "Guide", "nothing here")], "question_id long, question string, chunk_id long, title string, text string")
    windows = spark.createDataFrame([(7, 0, "the ward"), (7, 1, "heparin only"), (7, 2, "heparin dose"), (7, 3, "heparin dose limit")], "chunk_id long, pos int, window string")
    assert tuple(r.maxp(pool, windows).first()) == (1, 7, 1.0, 3)
    none = spark.createDataFrame([(7, 4, "unlike"), (7, 5, "words")], "chunk_id long, pos int, window string")
    assert tuple(r.maxp(pool.withColumn("title", F.lit("heparin dose")), none).first()) == (1, 7, 0.6667, 4)


def test_batch_search_reads_tables_a_fixed_number_of_times(spark):
    plan = registry.QUERIES["h16_batch_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 20, plan.count("Relation [")


@pytest.mark.parametrize("branch", [None, 1])
def test_a_question_sees_its_own_branch_and_day_only(spark, branch):
    day = dt.date(2025, 5, 5)
    texts = spark.createDataFrame([(k, "P", "h", "heparin dose for the ward") for k in range(1, 5)], "chunk_id long, title string, heading string, text string")
    scoped = spark.createDataFrame([(1, dt.date(2025, 1, 1), None, None), (2, dt.date(2025, 6, 1), None, None), (3, dt.date(2025, 1, 1), dt.date(2025, 5, 5), None), (4, dt.date(2025, 1, 1), None, 1)], "chunk_id long, valid_from date, valid_to date, branch_id int")
    asked = spark.createDataFrame([(9, "heparin dose", branch, day)], "question_id long, question string, branch_id int, as_of date")
    facts = texts.select("chunk_id", F.lit("policy").alias("doc_type"), F.lit(day).alias("effective_from"), F.lit(False).alias("branch_specific"), F.lit(None).cast("date").alias("amends_from"))
    vectors = texts.select("chunk_id", F.array(F.lit(1.0), F.col("chunk_id").cast("double")).alias("vector"))
    index = InvertedIndex(spark, fresh_path(spark), buckets=2).add(texts)
    keys = spark.createDataFrame([(9, "heparin")], "question_id long, term string")
    got = r.batch_search(asked, texts, index, asked.select("question_id", F.array(F.lit(1.0), F.lit(1.0)).alias("vector")), vectors, scoped, facts, keys).collect()
    assert {x.chunk_id for x in got} == ({1} if branch is None else {1, 4})
    assert all(x.rerank == 1.0 and x.key_boost == 0.25 and x.final == 1.27 and x.in_context for x in got)


def test_hashed_search_gives_what_a_join_of_buckets_gives(spark):
    """Zero and null vectors take no part, and only colliding pairs inside the radius count."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(5)
    rows = [(n, rng.normal(size=8).tolist()) for n in range(60)]
    vectors = spark.createDataFrame([*rows, (90, [0.0] * 8), (91, None)], "chunk_id long, vector array<double>")
    asked = vectors.filter("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "question_id")
    got = {(x.question_id, x.chunk_id) for x in r.lsh_topk(asked, vectors, k=70, bucket_length=0.3, tables=2, radius=1.0).collect()}
    unit = spark.createDataFrame([(n, Vectors.dense(np.array(v) / np.linalg.norm(v))) for n, v in rows], ["id", "unit"])
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=0.3, numHashTables=2, seed=11).fit(unit)
    pairs = model.approxSimilarityJoin(unit.filter("id % 10 = 0"), unit, 1.0)
    assert got == {(x.datasetA.id, x.datasetB.id) for x in pairs.collect()}


def test_tasks_of_the_index_take_bounded_shares(spark, tmp_path, monkeypatch):
    from corvane.operators import inverted, retrieval

    monkeypatch.setattr(inverted, "TASK_POSTINGS", 20)
    monkeypatch.setattr(inverted, "TASK_PAIRS", 50)
    passages = spark.createDataFrame([(n * 97, f"heparin dose{n % 7} ward{n % 3} aptt check of the pump {'heparin ' * (n % 5)}") for n in range(120)], "chunk_id long, text string")
    blocks = inverted.posting_blocks(passages, 4)
    assert blocks.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism  # as many as the postings need
    terms = spark.createDataFrame([(q, t) for q in range(6) for t in ("heparin", "ward1", f"dose{q}", "pump")], "question_id long, term string")
    index = inverted.InvertedIndex(spark, str(tmp_path / "index"), 4).add(passages)
    parts = []
    deal = type(terms).repartition
    monkeypatch.setattr(type(terms), "repartition", lambda df, n, *by: parts.append(n) or deal(df, n, *by))
    got = index.keyword_topk(terms, 10)
    assert max(p for p in parts if isinstance(p, int)) > 2
    rows = lambda df: sorted(tuple(r) for r in df.select("question_id", "chunk_id", "score", "rank").collect())
    assert rows(got) == rows(retrieval.keyword_topk(terms, passages, 10))

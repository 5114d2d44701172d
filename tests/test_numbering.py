import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import audit, evaluation
from corvane.sources.scratch import numbered, written


def log(spark, n):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    return spark.range(n).select(
        (F.col("id") * 3 + 1).alias("seq"), F.lit("document.upload").alias("action"), (F.col("id") % 40).alias("actor_user_id"), at.alias("created_at"),
        (F.col("id") % 100).cast("string").alias("entity_id"), F.lit("document").alias("entity_type"), F.to_json(F.struct(F.col("id").alias("n"), F.lit("x" * 40).alias("text"))).alias("payload"), F.lit(1).alias("log"),
    )


@pytest.fixture(scope="module")
def chain(spark):
    return written(audit.append_chain(log(spark, 1_000_000).repartition(13), "log"))


@pytest.mark.parametrize(("parts", "adaptive", "n"), [(8, "true", 100_000), (64, "true", 1_000_000), (200, "false", 20_000)])
def test_an_intact_long_chain(spark, chain, parts, adaptive, n):
    chain = chain.filter(F.col("seq") <= 3 * (n - 1) + 1)
    had = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        assert tuple(audit.verify_chain(chain).first()) == (True, n, None, None)
        if n == 100_000:
            changed = chain.withColumn("payload", F.when(F.col("seq") == 3 * 77_000 + 1, F.lit("{}")).otherwise(F.col("payload")))
            assert tuple(audit.verify_chain(changed).first()) == (False, 77_000, 3 * 77_000 + 1, "content changed")
            missing = chain.filter(F.col("seq") != 3 * 50_000 + 1)
            assert tuple(audit.verify_chain(missing).first()) == (False, 50_000, 3 * 50_001 + 1, "broken link")
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)


def test_numbers_follow_the_order(spark):
    rows = spark.range(300_000).select(F.xxhash64("id").alias("key"), F.repeat(F.lit("payload"), 9).alias("before"))
    got = numbered(rows.repartition(11), "key")
    first = got.select("index", "key").orderBy("index")
    assert got.columns == ["key", "before", "index"] and got.select("index").distinct().count() == 300_000
    assert got.agg(F.min("index"), F.max("index")).first()[:] == (1, 300_000)
    assert [r.key for r in first.limit(5).collect()] == sorted(r.key for r in rows.select("key").collect())[:5]
    assert numbered(rows.limit(0), "key").count() == 0


def test_chain_that_is_empty(spark):
    assert tuple(audit.verify_chain(audit.append_chain(log(spark, 0), "log")).first()) == (True, 0, None, None)


def test_nearest_rank_at_other_partition_counts(spark):
    rows = spark.range(100_000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    want = {(g, float(sorted(range(g, 100_000, 3))[round(0.95 * (len(range(g, 100_000, 3)) - 1))])) for g in range(3)}
    for parts in (3, 50):
        assert {tuple(r) for r in evaluation.nearest_rank(rows.repartition(parts), "g", "v", 0.95, "p").collect()} == want


def test_merged_latency_sketches_keep_their_rank(spark):
    import random

    from corvane.operators import analytics

    rng = random.Random(7)
    rows = [(k, f"2026-01-{1 + k % 20:02d} 10:00:00", None if k % 50 == 0 else rng.lognormvariate(5, 1.2)) for k in range(60_000)]
    logs = spark.createDataFrame(rows, "query_id long, at string, latency_ms double").select("query_id", F.to_timestamp("at").alias("created_at"), "latency_ms")
    days = analytics.latency_sketches(logs.filter("query_id % 2 = 0")).unionByName(analytics.latency_sketches(logs.filter("query_id % 2 = 1")))
    got = analytics.sketched_percentiles(days, []).first()
    exact = sorted(r[2] for r in rows if r[2] is not None)
    assert got.n == len(exact)
    for rank, value in ((0.5, got.p50), (0.95, got.p95), (0.99, got.p99)):
        assert abs(sum(x <= value for x in exact) / len(exact) - rank) <= analytics.RANK_ERROR
    assert analytics.sketched_percentiles(analytics.latency_sketches(logs.limit(0)), ["day"]).count() == 0


def test_sections_counted_by_starts_of_paths(spark):
    import random

    from corvane.operators import governance as g

    rng = random.Random(8)
    path = lambda: "".join(rng.choice(["1", "2", "12", ".", "#", "(", "a)"]) for _ in range(rng.randrange(1, 6)))
    paths = spark.createDataFrame([(p,) for p in {path() for _ in range(150)}], "section_path string")
    links = spark.createDataFrame([(k, rng.choice([None, path(), path()])) for k in range(120)], "link_id long, target_section_path string")
    want = paths.join(links, g.section_matches(F.col("target_section_path"), F.col("section_path"))).groupBy("link_id").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, g.section_match_counts(paths, links).collect())) == sorted(map(tuple, want.collect()))


def test_chains_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(audit, "PIECE", 300)
    sizes = {"a": 40, "b": 1500, "c": 1, "d": 700, None: 350, "e": 20}
    names = [name for name, n in sizes.items() for _ in range(n)]
    random.Random(3).shuffle(names)
    rows = [(name, seq, "x", seq % 7, None, "y", None) for seq, name in enumerate(names)]
    events = spark.createDataFrame(rows, "log string, seq long, action string, actor_user_id long, entity_id string, entity_type string, payload string").withColumn("created_at", F.timestamp_seconds("seq")).repartition(5)
    seeds = spark.createDataFrame([("b", "f" * 64)], "log string, hash string")
    records = {r["seq"]: r["record"] for r in events.select("seq", audit.canonical_record().alias("record")).collect()}
    for known, begin in ((None, {}), (seeds, {"b": "f" * 64})):
        got = audit.append_chain(events, "log", known).collect()
        assert sorted(r["seq"] for r in got) == list(range(len(rows)))
        last = {name: begin.get(name, audit.GENESIS) for name in sizes}
        for r in sorted(got, key=lambda r: r["seq"]):
            assert r["prev_hash"] == last[r["log"]]
            last[r["log"]] = hashlib.sha256((r["prev_hash"] + records[r["seq"]]).encode()).hexdigest()
            assert r["hash"] == last[r["log"]]

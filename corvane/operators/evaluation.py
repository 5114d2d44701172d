"""Scoring of retrieval and answers against a labelled question set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.scratch import numbered, written


def containing_passages(items: DataFrame, documents: DataFrame, key: int = 12) -> DataFrame:
    """(question_id, chunk_id) of documents that contain the whole text of an item, from the start of a word on.

    The first ``key`` characters of an item (all, if it has fewer) are looked up at every word start of a document:
    an equality join of short keys; only then are the texts of what was found fetched and compared in full. Items
    without text match nothing.
    """
    asked = items.select(F.col("item_id").alias("question_id"), F.trim("text").alias("item")).filter("item <> ''").withColumn("key", F.substring("item", 1, key))
    sizes = sorted(r[0] for r in asked.select(F.length("key")).distinct().collect())  # `key` numbers at most
    starts = F.regexp_extract_all(F.col("text"), F.lit(r"(?s)(?<!\S)(?=(\S.{0," + str(key - 1) + r"}))"), F.lit(1))
    cut = lambda n: F.transform(starts, lambda s: F.substring(s, 1, n))
    keys = F.array_distinct(F.flatten(F.array(*map(cut, sizes)))) if sizes else F.array().cast("array<string>")
    texts = documents.filter("text is not null").select(F.col("doc_id").alias("chunk_id"), "text")
    near = written(texts.select("chunk_id", F.explode(keys).alias("key")).join(asked.select("question_id", "key"), "key").select("question_id", "chunk_id").distinct())  # of known size, so texts move only for many
    hit = near.join(texts, "chunk_id").join(asked.drop("key"), "question_id").filter(F.contains("text", "item"))
    return hit.select("question_id", "chunk_id").distinct()


def gold_reference(reference: Column) -> Column:
    """``DOC@VERSION#SECTION`` as a struct."""
    part = lambda n: F.regexp_extract(reference, r"^([^@]+)@([^#]+)#(.+)$", n)
    return F.struct(part(1).alias("doc_code"), part(2).alias("version_label"), part(3).alias("section"))


def matches_gold(reference: Column, doc_code: Column, version_label: Column, section_path: Column, covered: Column) -> Column:
    g = gold_reference(reference)
    return (g["doc_code"] == doc_code) & (g["version_label"] == version_label) & ((g["section"] == section_path) | F.array_contains(covered, g["section"]))


def first_gold_rank(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(question_id, first_rank): rank of the first gold passage, null on a miss."""
    return gold.join(ranked.select("question_id", "chunk_id", "rank"), ["question_id", "chunk_id"], "left").groupBy("question_id").agg(F.min("rank").alias("first_rank"))


def recall_and_mrr(ranks: DataFrame, k: int) -> DataFrame:
    return ranks.agg(
        F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 4).alias("mrr"),
        F.round(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), 4).alias("recall"),
    )


def citation_precision(cited: DataFrame, allowed: DataFrame) -> DataFrame:
    """Mean over questions of the share of citations that are gold."""
    ok = allowed.select("question_id", "chunk_id").distinct().withColumn("ok", F.lit(1.0))
    each = cited.join(ok, ["question_id", "chunk_id"], "left").groupBy("question_id").agg(F.avg(F.coalesce("ok", F.lit(0.0))).alias("p"))
    return each.agg(F.round(F.avg("p"), 4).alias("precision"))


def category_totals(scored: DataFrame) -> DataFrame:
    return scored.groupBy("category").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))


def nearest_rank(rows: DataFrame, by: str, value: str, p: float, name: str) -> DataFrame:
    """The value at index round-half-even(p * (n - 1)) of each group, in order, nulls left out.

    Rows are numbered once in the order of group and value, over range partitions, so a large group lies in many of
    them; a group's rows follow each other, and its wanted one is found by its number.
    """
    placed = written(numbered(rows.filter(F.col(value).isNotNull()).select(by, value), F.asc_nulls_first(by), value))
    wanted = placed.groupBy(F.col(by).alias("group")).agg((F.min("index") + F.bround(F.lit(p) * (F.count("*") - 1)).cast("long")).alias("index"))
    return placed.join(wanted, "index").select(by, F.col(value).alias(name))


def gate(metrics: DataFrame, thresholds: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, value, passed) of a one-row table of metrics; an unknown value passes."""
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(op).alias("op"), F.lit(float(t)).alias("threshold")) for m, (op, t) in thresholds.items()])
    each = metrics.select(F.explode(items).alias("x")).select("x.*")
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return each.select("metric", "value", F.coalesce(ok, F.lit(True)).alias("passed"))


def score_items(items: DataFrame, responses: DataFrame) -> DataFrame:
    """(question_id, checks, passed) for items (expectation, gold, must_not_cite, must_include) and responses
    (outcome, route, cited, retrieved, answer).

    An expected answer must be answered with a gold passage retrieved and cited, every fact included and
    nothing forbidden cited; other expectations must be routed or declined as asked.
    """
    r = items.join(responses, "question_id", "left")
    empty = F.array().cast("array<string>")
    some = lambda a, b: F.arrays_overlap(F.coalesce(a, empty), F.coalesce(b, empty))
    fact_in = lambda f: F.exists(F.split(f, r"\|"), lambda x: F.contains(F.lower("answer"), F.lower(x)))
    answer = F.col("expect") == "answer"
    checks = {
        "answered": ~answer | F.col("outcome").isin("answered", "partial"),
        "retrieved_gold": ~answer | some("retrieved", "gold"),
        "cited_gold": ~answer | some("cited", "gold"),
        "nothing_forbidden": ~some("cited", "must_not_cite"),
        "facts": ~answer | F.forall(F.coalesce("must_include", empty), fact_in),
        "routed": answer | (F.col("expect") == F.col("route")) | ((F.col("expect") == "abstain") & (F.col("outcome") == "abstained")),
    }
    named = {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}
    passed = F.lit(True)
    for v in named.values():
        passed = passed & v
    return r.select("question_id", "category", F.struct(*[v.alias(k) for k, v in named.items()]).alias("checks"), passed.alias("passed"))

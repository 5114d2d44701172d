"""Contradictions: quantities in context, pair tests, similar clauses, and what to show."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import words as W
from corvane.functions.text import normal_number, normal_unit, stem
from corvane.operators.retrieval import vector_topk
from corvane.sources.scratch import written

# A quantity with its comparator, bounds and unit, and what counts as a word beside it.
_QUANTITY = re.compile(rf"(?<![\w.])([<>≥≤]=?\s*)?(\d{{1,3}}(?:,\d{{3}})+|\d+(?:\.\d+)?)(?:\s*(?:–|-|to)\s*(\d+(?:\.\d+)?))?\s*({W.UNITS})?(?![\w])", re.IGNORECASE)
_WORDS = re.compile(r"[A-Za-z][A-Za-z-]+")


def quantities(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", before: int = 8, after: int = 4) -> DataFrame:
    """(chunk_id, pos, end, comparator, value, unit, raw, context): one row per quantity of each text, citation markers removed.

    ``context`` holds the sorted stems of the last ``before`` and next ``after`` words of the whole text, without stop
    words and the generic ones. The tasks only find places and neighbours; all forms are made natively.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for chunk_id, text in zip(rows["chunk_id"], rows["text"], strict=True):
                words, ends = [], []
                for m in _QUANTITY.finditer(text):
                    for w in _WORDS.finditer(text, ends[-1] if ends else 0, m.start()):  # each word is met once
                        words.append(w[0])
                        ends.append(w.end())
                    near = words[len(words) - min(before, len(words)) :] + [w[0] for w in islice(_WORDS.finditer(text, m.end()), after)]
                    found.append((chunk_id, m.start(), m.end(), (m[1] or "").strip(), m[2], m[3], m[4], m[0].strip(), near))
            yield pd.DataFrame(found, columns=["chunk_id", "pos", "end", "comparator", "low", "high", "unit", "raw", "near"])

    text = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"\[S\d+\]", "")
    source = chunks.select(F.col(id_col).cast("long").alias("chunk_id"), text.alias("text"))
    spans = source.mapInPandas(run, "chunk_id long, pos int, end int, comparator string, low string, high string, unit string, raw string, near array<string>")
    generic = chunks.sparkSession.range(1).select(F.transform(F.array(*map(F.lit, W.GENERIC_CONTEXT)), stem)).first()[0]  # once, not for each row
    stops, generic = F.array(*map(F.lit, W.STOPWORDS)), F.array(*map(F.lit, generic))
    lower = F.filter(F.transform("near", F.lower), lambda w: (F.length(w) > 2) & ~F.array_contains(stops, w))
    value = F.concat_ws("-", normal_number(F.col("low")), normal_number(F.col("high")))
    context = F.array_sort(F.array_except(F.array_distinct(F.transform(lower, stem)), generic))
    return spans.select("chunk_id", "pos", "end", "comparator", value.alias("value"), normal_unit(F.col("unit")).alias("unit"), "raw", context.alias("context"))


def conflict_pairs(pairs: DataFrame, found: DataFrame, min_overlap: int = 2) -> DataFrame:
    """(a, b, value_a, value_b, unit, overlap, confidence) of pairs (a, b) whose quantities contradict.

    Same unit, unlike values, shared context of at least ``min_overlap`` stems, and neither side holds the
    other's value with that unit; the first pair of quantities with the largest overlap stands for the pair.
    """
    usable = found.filter(~F.col("unit").isin("", "beds", "times"))
    grouped = usable.groupBy("chunk_id", "unit").agg(F.collect_list(F.struct("pos", "value", "context")).alias("list"), F.collect_set("value").alias("values"))
    listed = written(grouped)  # texts are searched once, whatever is joined to what they hold
    side = lambda s: listed.select(F.col("chunk_id").alias(s), "unit", F.col("list").alias(f"list_{s}"), F.col("values").alias(f"values_{s}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "unit"])
    lacking = lambda s, other: F.explode(F.filter(f"list_{s}", lambda x: ~F.array_contains(F.col(f"values_{other}"), x["value"]))).alias(f"of_{s}")
    both = both.select("a", "b", "unit", lacking("a", "b"), "list_b", "values_a").select("a", "b", "unit", "of_a", lacking("b", "a"))
    met = both.withColumn("overlap", F.size(F.array_intersect("of_a.context", "of_b.context"))).filter(F.col("overlap") >= min_overlap)
    both = met.select("a", "b", "unit", "overlap", *(F.col(f"of_{s}")[name].alias(f"{name}_{s}") for s in ("a", "b") for name in ("pos", "value")))
    order = Window.partitionBy("a", "b").orderBy(F.desc("overlap"), "pos_a", "pos_b")
    best = both.withColumn("place", F.row_number().over(order)).filter("place = 1")
    confidence = F.round(F.least(F.lit(0.95), 0.6 + 0.07 * F.col("overlap")), 4)
    return best.select("a", "b", "value_a", "value_b", "unit", "overlap", confidence.alias("confidence"))


def similar_clauses(queries: DataFrame, clauses: DataFrame, k: int = 5, cross_department: float = 0.88) -> DataFrame:
    """(a, b, similarity): for each clause of ``queries`` the ``k`` most alike of other documents.

    Both sides: chunk_id, document_id, network_wide, department_id, vector. The network-wide flags must be
    equal, and the departments too unless the similarity reaches ``cross_department``.
    """
    def allowed(q, c, scores):
        same = lambda n: q[:, None, n] == c[None, :, n]
        return ~same(0) & same(1) & (same(2) | (scores >= cross_department))

    ready = lambda df: df.withColumn("department_id", F.coalesce(F.col("department_id"), F.lit(-1)))
    found = vector_topk(ready(queries).withColumnRenamed("chunk_id", "question_id"), ready(clauses), k, 6, ("document_id", "network_wide", "department_id"), allowed)
    return found.select(F.col("question_id").alias("a"), F.col("chunk_id").alias("b"), F.col("score").alias("similarity"))


def new_pairs(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs in the order of their ids as text, once each, without those stored already."""
    swap = F.col("a").cast("string") > F.col("b").cast("string")
    ordered = pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b")).distinct()
    return ordered.join(stored.select(F.col("chunk_a").alias("a"), F.col("chunk_b").alias("b")), ["a", "b"], "left_anti")


def newer_side(conflicts: DataFrame, effective: DataFrame, cited: DataFrame) -> DataFrame:
    """Conflicts that touch a cited chunk, with the chunk of later date as ``newer``, null on a tie."""
    sides = [conflicts.join(cited.select(F.col("chunk_id").alias(s)), s, "left_semi") for s in ("chunk_a", "chunk_b")]  # two equality joins, not one by OR
    touching = sides[0].unionByName(sides[1]).distinct()
    e = lambda s: effective.select(F.col("chunk_id").alias(f"chunk_{s}"), F.col("effective_from").alias(f"from_{s}"))
    both = touching.join(e("a"), "chunk_a").join(e("b"), "chunk_b")
    newer = F.when(F.col("from_a") > F.col("from_b"), F.col("chunk_a")).when(F.col("from_b") > F.col("from_a"), F.col("chunk_b"))
    return both.withColumn("newer", newer).drop("from_a", "from_b")


def _open_touching(context: DataFrame, stored: DataFrame, least: float) -> DataFrame:
    """(question_id, a, b, conflict) of open stored pairs with a side that is relevant to the question; two equality joins, not one by OR."""
    keep = context.filter(F.col("rerank") >= least).select("question_id", "chunk_id")
    number = F.col("conflict_id") if "conflict_id" in stored.columns else F.struct("chunk_a", "chunk_b")
    known = stored.filter("status = 'open'").select(F.col("chunk_a").alias("a"), F.col("chunk_b").alias("b"), number.alias("conflict"))
    sides = [keep.join(known, keep["chunk_id"] == known[side]).select("question_id", "a", "b", "conflict") for side in ("a", "b")]
    return sides[0].unionByName(sides[1]).distinct()


def conflict_partners(context: DataFrame, stored: DataFrame, eligible: DataFrame, least: float = 0.35) -> DataFrame:
    """(question_id, chunk_id, rerank): the other sides of open stored conflicts that a question's context lacks.

    Only ``eligible`` chunks come in: (chunk_id), or (question_id, chunk_id) where each question has its own. A side takes
    the re-rank score of the one that brings it, by the first conflict of several.
    """
    pairs = _open_touching(context, stored, least)
    each = pairs.select("question_id", "conflict", F.col("a").alias("chunk_id"), F.col("b").alias("other")).unionByName(pairs.select("question_id", "conflict", F.col("b").alias("chunk_id"), F.col("a").alias("other")))
    there = context.select("question_id", F.col("chunk_id").alias("other"), "rerank")
    lacking = each.join(context.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti").join(there, ["question_id", "other"])
    allowed = lacking.join(eligible.select(*[c for c in ("question_id", "chunk_id") if c in eligible.columns]).distinct(), [c for c in ("question_id", "chunk_id") if c in eligible.columns], "left_semi")
    return allowed.groupBy("question_id", "chunk_id").agg(F.min_by("rerank", "conflict").alias("rerank"))


def query_conflicts(context: DataFrame, stored: DataFrame, found: DataFrame, least: float = 0.35, partners: DataFrame | None = None) -> DataFrame:
    """(question_id, a, b, origin): open stored conflicts of the context, and new ones inside it.

    ``context``: question_id, chunk_id, document_id, network_wide, rerank and, if known, effective_from. A stored conflict
    counts if one side is relevant and both are in the context or among its ``partners`` (:func:`conflict_partners`). Pairs
    that were settled before are skipped. Of a new pair the side with the older effective date is ``a``.
    """
    known = context.select("question_id", "chunk_id")
    if partners is not None:
        known = known.unionByName(partners.select("question_id", "chunk_id"))
    side = lambda name: known.distinct().withColumnRenamed("chunk_id", name)
    kept = _open_touching(context, stored, least).join(side("a"), ["question_id", "a"], "left_semi").join(side("b"), ["question_id", "b"], "left_semi").select("question_id", "a", "b")
    good = context.filter(F.col("rerank") >= least)
    dated = F.col("effective_from") if "effective_from" in context.columns else F.lit(None).cast("date")
    x = good.select("question_id", F.col("chunk_id").alias("a"), F.col("document_id").alias("doc_a"), dated.alias("from_a"), "network_wide")
    y = good.select("question_id", F.col("chunk_id").alias("b"), F.col("document_id").alias("doc_b"), dated.alias("from_b"), "network_wide")
    inside = x.join(y, ["question_id", "network_wide"]).filter("a < b and doc_a <> doc_b").select("question_id", "a", "b", F.coalesce(F.col("from_b") < F.col("from_a"), F.lit(False)).alias("turned"))
    fresh = inside.join(new_pairs(inside.select("a", "b").distinct(), stored), ["a", "b"], "left_semi")
    tested = fresh.join(conflict_pairs(fresh.select("a", "b").distinct(), found), ["a", "b"], "left_semi")
    older, newer = F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b"))
    return kept.distinct().withColumn("origin", F.lit("stored")).unionByName(tested.select("question_id", older.alias("a"), newer.alias("b"), F.lit("new").alias("origin")))

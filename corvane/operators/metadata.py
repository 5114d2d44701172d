"""Header metadata, its validation, mismatch warnings, and references to amended documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import loose_date

# Patterns of header fields and references (fixed values).
CODE = r"[A-Z]{1,5}(?:-[A-Z0-9]{1,6}){1,3}"
DATE = r"(\d{4}-\d{2}-\d{2}|\d{1,2}\s+[A-Za-z]+\s+\d{4})"
FIELDS = {
    "doc_code": r"(?im)^\s*(?:document\s+code|doc(?:ument)?\s+(?:no|number|id)|(?:circular|sop|protocol)\s+(?:no|number)|reference)\.?\s*[:\-]\s*(" + CODE + r")\b",
    "version_label": r"(?im)^\s*version\s*[:\-]?\s*v?(\d+(?:\.\d+)?)\b",
    "effective_from": r"(?im)^\s*effective(?:\s+(?:from|date))?\s*[:\-]?\s*" + DATE,
    "review_due": r"(?im)^\s*(?:review\s+(?:due|date)|next\s+review)\s*[:\-]?\s*" + DATE,
}
TRIGGER = r"(?i)\b(?:supersed\w*|amend\w*|replac\w*|revok\w*|withdraw\w*|substitut\w*|in\s+partial\s+modification\s+of|modif\w*|rescind\w*|stands?\s+cancelled|no\s+longer\s+appl\w*)"
SECTION = r"(?i)(?:§\s*|\bsection\s+|\bclause\s+|\bpara(?:graph)?\s+)(\d{1,2}(?:\.\d{1,2}){0,4})"
_TABLE_RULE = r"^\|?(\s*:?-{3,}:?\s*\|?)+$"


def flatten_tables(text, between: str = " "):
    """Table rows ``| k | v |`` become lines ``k: v``; separator rows go."""
    row = lambda line: F.trim(line).rlike(r"^\|.*\|$")
    cells = lambda line: F.filter(F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    flat = lambda line: F.when(~row(line), line).otherwise(F.when(F.size(cells(line)) > 1, F.concat(cells(line)[0], F.lit(": "), F.array_join(F.slice(cells(line), F.lit(2), F.size(cells(line))), between))).otherwise(F.array_join(cells(line), "")))
    kept = F.filter(F.split(text, "\n"), lambda line: ~F.trim(line).rlike(_TABLE_RULE) | ~row(line))
    return F.array_join(F.transform(kept, flat), "\n")


def extract_metadata(docs: DataFrame, head: int = 4000) -> DataFrame:
    """(doc_id, doc_code, version_label, effective_from, review_due, title) read off the head of each text; null if absent."""
    text = flatten_tables(F.substring(F.coalesce("text", F.lit("")), 1, head))
    got = {name: F.nullif(F.regexp_extract("flat", pattern, 1), F.lit("")) for name, pattern in FIELDS.items()}
    for name in ("effective_from", "review_due"):
        got[name] = loose_date(got[name])
    title = F.nullif(F.trim(F.regexp_extract("flat", r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    return docs.select("doc_id", text.alias("flat")).select("doc_id", *[c.alias(n) for n, c in got.items()], title.alias("title"))


def validate_metadata(submitted: DataFrame) -> DataFrame:
    """Submitted rows with ``errors``, the list of what is wrong."""
    bad = lambda test, text: F.when(F.coalesce(test, F.lit(True)), F.lit(text))
    errors = F.array(
        bad(~F.col("doc_code").rlike(f"^{CODE}$"), "document code"),
        bad(F.trim("title") == "", "title"),
        bad(~F.col("version_label").rlike(r"^[A-Za-z0-9][A-Za-z0-9 ._-]{0,39}$"), "version label"),
        F.when(F.col("review_due") < F.col("effective_from"), F.lit("review before effect")),
        F.when(~F.col("network_wide") & F.col("branch_id").isNull(), F.lit("branch missing")),
    )
    return submitted.withColumn("errors", F.array_compact(errors))


def metadata_warnings(submitted: DataFrame, extracted: DataFrame) -> DataFrame:
    """(doc_id, warnings): fields whose extracted value differs from the submitted one; absent values warn of nothing."""
    both = submitted.alias("s").join(extracted.alias("x"), "doc_id")
    bare = lambda c: F.regexp_replace(F.lower(F.trim(c)), "^v", "")
    differs = {"doc_code": F.col("s.doc_code") != F.col("x.doc_code"), "version_label": bare(F.col("s.version_label")) != bare(F.col("x.version_label")), "effective_from": F.col("s.effective_from") != F.col("x.effective_from")}
    items = [F.when(test, F.struct(F.concat(F.lit(name), F.lit("_mismatch")).alias("code"), F.lit(name).alias("field"), F.concat(F.lit("document says "), F.col(f"x.{name}").cast("string")).alias("message"))) for name, test in differs.items()]
    return both.select("doc_id", F.array_compact(F.array(*items)).alias("warnings"))


def low_confidence_pages(versions: DataFrame, least: float = 0.80) -> DataFrame:
    """Versions with the sorted pages below ``least`` and the minimum over pages, from a map page -> confidence."""
    low = F.map_filter("page_confidence", lambda _, v: v < least)
    return versions.withColumn("low_pages", F.array_sort(F.map_keys(low))).withColumn("min_confidence", F.array_min(F.map_values("page_confidence")))


def detect_references(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, target_code, section, evidence): amendments of other known documents that a text announces.

    Sentences with a trigger word are split off; each known code in them other than the document's own takes
    the sections between it and the next code, else the last section before it, else none. The first evidence
    of each (code, section) stays, at most 500 characters.
    """
    marked = F.regexp_replace(flatten_tables(F.coalesce("text", F.lit("")), " · "), r"\n(?=[^\n:]{1,60}: )", "\n\n")
    sentence = F.posexplode(F.split(marked, r"(?<=[.;])\s+|\n{2,}")).alias("n", "sentence")
    hot = docs.select("doc_id", "self_code", sentence).filter(F.col("sentence").rlike(TRIGGER))
    # a sentence cut before every code: part k starts with code k, part 0 is what comes before
    parts = F.split(F.regexp_replace("sentence", rf"\b({CODE})\b", "\u0001$1"), "\u0001")
    cut = hot.withColumn("parts", parts)
    each = cut.select("doc_id", "self_code", "n", "sentence", "parts", F.posexplode("parts").alias("k", "part")).filter("k > 0")
    after = F.regexp_extract_all("part", F.lit(SECTION), F.lit(1))
    earlier = F.regexp_extract_all(F.array_join(F.slice("parts", 1, F.col("k")), " "), F.lit(SECTION), F.lit(1))
    sections = F.when(F.size(after) > 0, after).when(F.size(earlier) > 0, F.slice(earlier, -1, 1)).otherwise(F.array(F.lit(None).cast("string")))
    found = each.select("doc_id", "self_code", "n", "k", "sentence", F.regexp_extract("part", f"^({CODE})", 1).alias("target_code"), F.posexplode_outer(sections).alias("p", "section"))
    other = found.filter(~F.col("target_code").eqNullSafe(F.col("self_code"))).join(known.select(F.col("doc_code").alias("target_code")).distinct(), "target_code", "left_semi")
    first = other.groupBy("doc_id", "target_code", "section").agg(F.min_by("sentence", F.struct("n", "k", "p")).alias("evidence"))
    return first.select("doc_id", "target_code", "section", F.substring(F.trim("evidence"), 1, 500).alias("evidence"))


def new_suggestions(suggested: DataFrame, stored: DataFrame) -> DataFrame:
    """Suggestions (source_id, target_id, section) that are not stored yet; two null sections are equal."""
    s, t = suggested.alias("s"), stored.alias("t")
    same = (F.col("s.source_id") == F.col("t.source_id")) & (F.col("s.target_id") == F.col("t.target_id")) & F.col("s.section").eqNullSafe(F.col("t.section"))
    return s.join(t, same, "left_anti")

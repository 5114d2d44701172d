"""Detection and redaction of personal data: patterns per text, then names, overlaps and replacement in Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.scratch import written

# Patterns (fixed values): entity, expression, score, group, whether it may be a name.
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mstr|Master|Dr|Shri|Shree|Sri|Smt|Kumari|Kum|Baby|Sh)"
_NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}"
PATTERNS = (
    ("MRN", r"(?i)\b(?:UHID|MRN|IPD?\s?No\.?|OPD?\s?No\.?|CR\s?No\.?|Hosp(?:ital)?\s?(?:No\.?|ID)|Reg(?:istration)?\s?No\.?|Patient\s?ID|Bed\s?Head\s?Ticket)\s*[:#.\-]?\s*[A-Za-z0-9][A-Za-z0-9/\-]{3,19}\b", 0.95, 0, False),
    ("MRN", r"\b[A-Z]{2,5}\d{6,12}\b", 0.6, 0, False),
    ("ABHA", r"(?<!\d)\d{2}[\s-]\d{4}[\s-]\d{4}[\s-]\d{4}(?![\d])|(?<!\d)\d{14}(?!\d)", 0.9, 0, False),
    ("ABHA", r"(?i)\b[A-Za-z0-9._]{3,32}@(?:abdm|sbx|ndhm)\b", 0.95, 0, False),
    ("ID_NUMBER", r"(?<!\d[\s-])(?<!\d)[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}(?![\s-]?\d)", 0.85, 0, False),
    ("PHONE", r"(?<![\d+])(?:(?:\+|00)91[\s-]?|0)?[6-9]\d{4}[\s-]?\d{5}(?![\s-]?\d)", 0.85, 0, False),
    ("PHONE", r"(?<!\d)0\d{2,4}[\s-]\d{6,8}(?!\d)", 0.7, 0, False),
    ("EMAIL", r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b", 0.95, 0, False),
    ("DOB", r"(?i)\b(?:DOB|D\.O\.B\.?|date\s+of\s+birth|born\s+on)\s*[:\-]?\s*\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}", 0.95, 0, False),
    ("PERSON", rf"\b{_TITLE}\.?\s+{_NAME}", 0.9, 0, False),
    ("PERSON", rf"\b(?:[Pp]atient|[Pp]t\.?|[Nn]ame)(?:\s+(?:named|called|name\s*is|is)|\s*:)?\s+({_NAME})", 0.85, 1, True),
    ("PERSON", r"\b(?:to|for|give|gave|with|on|about|of)\s+([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})?)\b", 0.6, 1, True),
)
_RUNS, _ODD = re.compile(r"\d+"), ("\u0130", "\u0131", "\u017f", "\u212a")  # letters beyond ASCII that (?i) takes for i, s and k
_LABEL = re.compile(r"no(?:" + "|".join(rf"(?<={x}no)|(?<={x}\sno)" for x in ("ip", "ipd", "op", "opd", "cr", "hosp", "hospital", "reg", "registration")) + ")|id(?:" + "|".join(rf"(?<={x}id)|(?<={x}\sid)" for x in ("hosp", "hospital", "patient")) + ")")
_WORDS = [re.compile(rf"{w}(?<!\w{w})") for w in ("patient", "Patient", "pt", "Pt", "name", "Name")]
_SHORT = re.compile(r"Sh[.\s]")
_TITLES = ("Mr", "Ms", "Miss", "Master", "Dr", "Shr", "Sri", "Smt", "Kum", "Baby")
_AFTER = re.compile(r"[A-Z](?<=[orehntf\s]\s[A-Z])[a-z]{2}")


def _digits(text: str) -> int:
    """Length of the longest run of digits."""
    if not any(d in text for d in "0123456789") and text.isascii():
        return 0
    return max(map(len, _RUNS.findall(text)), default=0)


def _labelled(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in ("uhid", "mrn", "ticket")) or any(c in text for c in _ODD) or _LABEL.search(low) is not None


#: For each pattern what any text with a match holds, found faster than the match: (text, longest run of digits) -> whether to search it.
_NEEDS = (
    lambda text, run: _labelled(text),
    lambda text, run: run >= 6,
    lambda text, run: run >= 4,
    lambda text, run: "@" in text,
    lambda text, run: run >= 4,
    lambda text, run: run >= 5,
    lambda text, run: run >= 6,
    lambda text, run: "@" in text,
    lambda text, run: run >= 1,
    lambda text, run: any(t in text for t in _TITLES) or _SHORT.search(text) is not None,
    lambda text, run: any(w.search(text) for w in _WORDS),
    lambda text, run: _AFTER.search(text) is not None,
)
SPANS = "doc_id long, entity string, start int, end int, score double, name_like boolean, value string"


def detect(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per pattern match, with character offsets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(e, re.compile(p), s, g, n, needs) for (e, p, s, g, n), needs in zip(PATTERNS, _NEEDS, strict=True)]
        for rows in batches:
            out = [
                (doc, e, m.start(g), m.end(g), s, n, m[g])
                for doc, text in zip(rows["doc_id"], rows["text"], strict=True)
                if text
                for run in (_digits(text),)
                for e, p, s, g, n, needs in compiled
                if needs(text, run)
                for m in p.finditer(text)
            ]
            yield pd.DataFrame(out, columns=["doc_id", "entity", "start", "end", "score", "name_like", "value"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, SPANS)


def guard_names(spans: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Spans that may be names shrink to their tokens outside the vocabulary (word); those without any go.

    The vocabulary is joined, not carried into tasks: it is as large as the corpus makes it.
    """
    sure, maybe = spans.filter("not name_like"), spans.filter("name_like")
    tokens = maybe.select("doc_id", "entity", "start", "score", F.posexplode(F.split("value", r"(?<=\s)(?=\S)")).alias("k", "token"))
    order = Window.partitionBy("doc_id", "start", "score").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    tokens = tokens.withColumn("at", F.col("start") + F.coalesce(F.sum(F.length("token")).over(order), F.lit(0))).withColumn("word", F.lower(F.trim("token")))
    capital = F.col("token").rlike("^[A-Z][a-z]") | (F.col("token").rlike("^[A-Z]+\\s*$") & (F.length(F.trim("token")) > 4))
    unknown = tokens.filter(capital).join(vocabulary.select("word").distinct(), "word", "left_anti")
    shrunk = unknown.groupBy("doc_id", "entity", F.col("start").alias("span"), "score").agg(F.min("at").cast("int").alias("start"), F.max(F.col("at") + F.length(F.trim("token"))).cast("int").alias("end"))
    return sure.select("doc_id", "entity", "start", "end", "score").unionByName(shrunk.select("doc_id", "entity", "start", "end", "score"))


def merge_spans(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a text become one, of the entity with the higher score (the earlier on ties)."""
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), F.desc("score"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return opened.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("entity", F.struct(-F.col("score"), "start")).alias("entity")).drop("island")


def redact(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(doc_id, redacted, entities, changed): spans replaced by ``<ENTITY>``; the values found are not kept."""
    spans = written(detect(docs))  # texts are searched once; spans are read as sure ones and as names
    spans = merge_spans(guard_names(spans, vocabulary) if vocabulary is not None else spans.select("doc_id", "entity", "start", "end", "score"))
    listed = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity"))).alias("spans"), F.array_sort(F.collect_set("entity")).alias("entities"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(listed, "doc_id", "left")
    seed = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["entity"], F.lit(">")).alias("out"), s["end"].alias("at"))
    done = F.aggregate("spans", seed, step)
    redacted = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text"))))
    return joined.select("doc_id", redacted.alias("redacted"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.col("spans").isNotNull().alias("changed"))


def corpus_vocabulary(*texts: DataFrame) -> DataFrame:
    """Distinct lower-case words of the given one-column tables of text."""
    out = None
    for t in texts:
        words = t.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(t.columns[0]).cast("string"), F.lit(""))), F.lit(r"[a-z][a-z'-]+"), F.lit(0))).alias("word"))
        out = words if out is None else out.union(words)
    return out.distinct()

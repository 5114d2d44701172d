"""Licence scans by canonical digest lookup, in DataFrame functions only."""

from __future__ import annotations

import hashlib
import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.license_texts import EQUIVALENT, KNOWN, TRIGGERS

#: Known licences at most: their digests are held in one literal map.
KNOWN_ROWS = 5000
#: Words that follow "copyright" in sentences of licences; a line wrapped there is no copyright line.
_SENTENCE = "a also an and applies are as at by can claim disclaimer doctrines for from has have holder holders if in interest interests into is it law laws like license licenses licence licences list may must notice notices of on or owner owners ownership patent permission protection resulting right rights shall statement statements status term terms that the this those to treaty under which with you"
_SENTENCE_WORD = rf"(?:{'|'.join(_SENTENCE.replace(' the ', ' ').split())}|the (?:{'|'.join('above following interest disclaimer covered combined application software program library work license licence document package'.split())}))(?![\p{{L}}\p{{N}}])"
_COPYRIGHT = (
    rf"(?dm)^[^\p{{L}}\p{{N}}\n]*(?:copyright(?![\p{{L}}\p{{N}}])[^\p{{L}}\p{{N}}\n]*(?!{_SENTENCE_WORD})[\p{{L}}\p{{N}}][^\n]*"
    rf"|\(c\)[^\p{{L}}\p{{N}}\n]+(?!{_SENTENCE_WORD})[\p{{L}}\p{{N}}][^\n]*|© [^\n]*|all rights reserved[^\p{{L}}\p{{N}}\n]*)$"
)
_SIGNS = r"[^\p{L}\p{N}\n]+"


def _apart(words: str) -> str:
    """Words with a blank of their own on either side, so that spellings are found whole and side by side."""
    return " " + "  ".join(words.split()) + " "


def canonical(text: Column) -> Column:
    """Lower case, copyright lines gone, signs and blanks as blanks, equal spellings alike, whole words only; lines stay."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT, ""), _SIGNS, "  ")
    out = F.concat(F.lit(" "), F.replace(bare, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for spelling, same in EQUIVALENT:
        out = F.replace(out, F.lit(_apart(spelling)), F.lit(_apart(same)))
    return out


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def canonical_digest(text: str) -> str:
    """The same digest in Python, for the fixed table of known texts, which are plain ASCII."""
    plain = lambda pattern: pattern.replace(r"\p{L}\p{N}", "a-z0-9").replace("(?dm)", "(?m)")
    out = re.sub(plain(_SIGNS), "  ", re.sub(plain(_COPYRIGHT), "", text.lower()))
    out = " " + out.replace("\n", " \n ") + " "
    for spelling, same in EQUIVALENT:
        out = out.replace(_apart(spelling), _apart(same))
    return hashlib.sha256(re.sub("[ \n]+", " ", out).strip(" ").encode()).hexdigest()


def known_digests() -> dict[str, str]:
    return {canonical_digest(text): name for name, text in KNOWN}


def known_rows() -> list[tuple[str, str]]:
    """(license_id, text): the notices and short licences of ``KNOWN`` and the whole texts in ``license_files``."""
    folder = resources.files("corvane.llm").joinpath("license_files")
    whole = [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in folder.iterdir() if f.name.endswith(".txt")]
    return [*KNOWN, *sorted(whole)]


def known_texts(spark: SparkSession) -> DataFrame:
    """The rows of :func:`known_rows` as a table."""
    return spark.createDataFrame(known_rows(), "license_id string, text string")


def license_scan(docs: DataFrame, columns: list[str], texts: DataFrame | None = None) -> DataFrame:
    """``columns`` of ``docs`` with ``license_id``, ``notice_ids`` and ``n_notices``.

    ``texts(license_id, text)`` are the known licences, :func:`known_texts` if not given. ``license_id``: the
    licence whose known text equals the whole text in canonical form, by a hash join of digests (null if none).
    ``notice_ids``: the sorted distinct licences whose known text equals one line, and ``n_notices`` the number of
    such lines. Null and empty texts match nothing; where two licences have one text, the first name counts. Where
    every known text holds one of ``TRIGGERS``, only texts and lines that do are put into canonical form: no other
    can match. At most ``KNOWN_ROWS`` known licences may be given, so their broadcast has a fixed size. Rows of ``docs``
    that repeat stay, each with its own result; very long texts are read whole; an empty table gives an empty result; columns
    of ``docs`` beside ``columns`` and the text have no effect, whatever their names.
    """
    spark = docs.sparkSession
    hint = lambda c: F.exists(F.array(*map(F.lit, TRIGGERS)), lambda t: F.contains(c, t))
    given = (known_texts(spark) if texts is None else texts).filter("license_id is not null and text is not null").select("license_id", F.col("text").cast("string").alias("text"))
    form = one_line(canonical(F.col("text")))
    rows = given.select("license_id", form.alias("form"), hint(F.col("form")).alias("hinted")).filter("form != ''").select("license_id", F.sha2(F.col("form").cast("binary"), 256).alias("digest"), "hinted").limit(KNOWN_ROWS + 1).collect()
    if len(rows) > KNOWN_ROWS:
        raise ValueError(f"more than {KNOWN_ROWS} known licences")
    table = {r.digest: r.license_id for r in sorted(rows, key=lambda r: r.license_id, reverse=True)}
    if not all(r.hinted for r in rows):
        hint = lambda c: F.lit(True)
    known = spark.createDataFrame(sorted(table.items()), "whole_digest string, license_id string")
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    by_digest = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair]).cast("map<string,string>")
    form = F.when(hint(low), canonical(F.col("text").cast("string")))
    lines = F.filter(F.split("form", "\n"), hint)
    found = F.filter(F.transform(lines, lambda line: F.element_at(by_digest, F.sha2(one_line(line).cast("binary"), 256))), lambda x: x.isNotNull())
    prepared = docs.select(*columns, form.alias("form"))
    scanned = prepared.select(
        *columns,
        F.sha2(one_line(F.col("form")).cast("binary"), 256).alias("whole_digest"),
        F.coalesce(found, F.array().cast("array<string>")).alias("found"),
    )
    joined = scanned.join(F.broadcast(known), "whole_digest", "left")
    return joined.select(*columns, "license_id", F.array_sort(F.array_distinct("found")).alias("notice_ids"), F.size("found").cast("long").alias("n_notices"))


def oracle_sql() -> str:
    """The same scan of ``documents`` as DuckDB SQL, whose expressions have no look-around: lines are tested one by one."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    sign, letter = r"[^\p{L}\p{N}]", r"[\p{L}\p{N}]"
    sentence = _SENTENCE_WORD.removesuffix(r"(?![\p{L}\p{N}])")
    heads = [(rf"^{sign}*copyright{sign}+", ""), (rf"^{sign}*\(c\){sign}+", "")]
    dropped = " OR ".join(
        [f"(regexp_matches(x, {quote(head + letter)}) AND NOT regexp_matches(x, {quote(head + '(?:' + sentence + ')(?:' + sign + '|$)')}))" for head, _ in heads]
        + [f"regexp_matches(x, {quote(rf'^{sign}*© ')})", f"regexp_matches(x, {quote(rf'^{sign}*all rights reserved{sign}*$')})"]
    )
    form = f"' ' || replace(regexp_replace(array_to_string(list_transform(string_split(lower(text), chr(10)), lambda x: CASE WHEN {dropped} THEN '' ELSE x END), chr(10)), {quote(_SIGNS)}, '  ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for spelling, same in EQUIVALENT:
        form = f"replace({form}, {quote(_apart(spelling))}, {quote(_apart(same))})"
    hint = lambda c: "(" + " OR ".join(f"contains({c}, {quote(t)})" for t in TRIGGERS) + ")"
    digest = lambda c: f"sha256(trim(regexp_replace({c}, '[ \\n]+', ' ', 'g'), ' '))"
    table = {canonical_digest(text): name for name, text in sorted(known_rows(), reverse=True)}
    rows = ", ".join(f"({quote(d)}, {quote(n)})" for d, n in sorted(table.items()))
    return f"""
    WITH known(digest, license_id) AS (VALUES {rows}),
    forms AS (SELECT doc_id, row_number() OVER () AS r, CASE WHEN {hint("lower(coalesce(text, ''))")} THEN {form} END AS form FROM documents),
    lines AS (SELECT r, license_id FROM (SELECT r, unnest(string_split(form, chr(10))) AS line FROM forms) l JOIN known ON digest = {digest("line")}),
    notices AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids, count(*) AS n FROM lines GROUP BY r)
    SELECT doc_id, k.license_id AS license_id, coalesce(ids, '') AS notices, CAST(coalesce(n, 0) AS BIGINT) AS n_notices
    FROM forms LEFT JOIN known k ON k.digest = {digest("form")} LEFT JOIN notices USING (r)
    """

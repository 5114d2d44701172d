"""Column functions over text: words, stems, numbers, units, markers, headings, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import words as W


def _all(pattern: str, text: Column, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def content_words(text: Column) -> Column:
    """Distinct lower-case words of letters, digits and hyphens, longer than one character, without stop words."""
    found = F.filter(_all(r"[a-zA-Z][a-zA-Z0-9-]*", F.coalesce(text, F.lit(""))), lambda w: F.length(w) > 1)
    return F.array_except(F.array_distinct(F.transform(found, F.lower)), F.array(*map(F.lit, W.STOPWORDS)))


def stem(word: Column) -> Column:
    """The first matching ending off, if three characters stay, then a final e off a word of five or more."""
    cut = word
    for suffix in reversed(W.SUFFIXES):
        n = len(suffix)
        cut = F.when(word.endswith(suffix) & (F.length(word) - n >= 3), F.substring(word, F.lit(1), F.length(word) - n)).otherwise(cut)
    return F.when(cut.endswith("e") & (F.length(cut) >= 5), F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)


def stemmed_words(text: Column) -> Column:
    return F.array_distinct(F.transform(content_words(text), stem))


def strip_markers(text: Column) -> Column:
    return F.regexp_replace(text, r"\[S\d+\]", " ")


def markers(text: Column) -> Column:
    """Distinct citation markers in order of appearance; ``[S1, S2]`` counts as two."""
    return F.array_distinct(_all(r"\[(S\d+)\]", split_markers(text), 1))


def split_markers(text: Column) -> Column:
    """``[S1, S2]`` becomes ``[S1][S2]``; other text stays."""
    return F.regexp_replace(text, r"(?<=S\d{1,9})\s*,\s*(?=S\d+[^\[]*\])", "][")


def normal_number(raw: Column) -> Column:
    """Thousands commas and trailing zeros of the fraction removed."""
    plain = F.regexp_replace(raw, ",", "")
    return F.when(F.contains(plain, F.lit(".")), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)


def numbers(text: Column) -> Column:
    """Distinct numbers of a text in normal form, markers aside."""
    found = _all(r"(?<![\w.])\d{1,3}(?:,\d{3})+(?:\.\d+)?|(?<![\w.])\d+(?:\.\d+)?", strip_markers(text))
    return F.array_distinct(F.transform(found, normal_number))


def normal_unit(unit: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(unit, F.lit(""))), " ", "")
    known = F.create_map(*[F.lit(x) for pair in W.UNIT_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, plain), plain)


def or_query(question: Column) -> Column:
    """Distinct lower-case tokens, single characters only if digits, joined by `` or ``."""
    tokens = F.array_distinct(_all(r"[a-z0-9]+(?:\.[0-9]+)?", F.lower(question)))
    return F.array_join(F.filter(tokens, lambda t: (F.length(t) > 1) | t.rlike("^[0-9]$")), " or ")


def embedding_tokens(text: Column) -> Column:
    return _all(r"[a-z0-9]+(?:[./-][a-z0-9]+)*", F.lower(text))


def token_count(text: Column) -> Column:
    return F.size(_all(r"(?U)\w+|[^\w\s]", text))


def normal_fact(text: Column) -> Column:
    """Lower case, dashes, times signs and micro signs unified, commas inside numbers gone, single blanks."""
    same = F.translate(F.lower(text), "–—−×μ", "---xµ")
    return F.trim(F.regexp_replace(F.regexp_replace(same, r"(\d),(?=\d{3})", "$1"), r"\s+", " "))


def has_fact(text: Column, fact: Column) -> Column:
    """Whether any of the alternatives ``a|b`` of a fact stands in the text."""
    return F.exists(F.split(fact, r"\|"), lambda f: F.contains(normal_fact(text), normal_fact(f)))


def snippet(text: Column, size: int = 320) -> Column:
    """Single blanks; a longer text is cut at the last blank before ``size`` and gets an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(flat, 1, size)
    at_blank = F.regexp_replace(head, " [^ ]*$", "")
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(at_blank, F.lit("…")))


def parent_path(path: Column) -> Column:
    base = F.substring_index(F.substring_index(path, "#", 1), "-", 1)
    return F.when(F.contains(base, F.lit(".")), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(F.lit(""))


def heading_number(line: Column) -> Column:
    """Struct of the section number of a heading line (null if none) and its title."""
    text = F.trim(F.regexp_replace(F.trim(line), "^#+", ""))
    tries = (
        r"(?i)^(?:appendix|annex(?:ure)?|schedule)\s+([A-Z])\b[\s.:—–-]*(.*)$",
        r"^([A-Z]\.\d{1,2}(?:\.\d{1,2}){0,3})\.?\s+(.+)$",
        r"(?i)^(?:section|clause|§)?\s*(\d{1,2}(?:\.\d{1,2}){0,4})\.?(?:\s+|$)(.*)$",
        r"^([A-Z])\.\s+(.+)$",
    )
    number, title = F.lit(None).cast("string"), text
    for pattern in reversed(tries):
        hit = text.rlike(pattern)
        rest = F.regexp_replace(F.regexp_extract(text, pattern, 2), r"^[\s.:—–-]+|[\s.:—–-]+$", "")
        number = F.when(hit, F.regexp_extract(text, pattern, 1)).otherwise(number)
        title = F.when(hit, F.when(rest == "", text).otherwise(rest)).otherwise(title)
    return F.struct(number.alias("number"), title.alias("title"))


def loose_date(value: Column) -> Column:
    """ISO, or day, English month name and year; else null."""
    text = F.initcap(F.regexp_replace(F.trim(value), r"\s+", " "))
    return F.coalesce(F.try_to_date(F.trim(value), "yyyy-MM-dd"), F.try_to_date(text, "d MMMM yyyy"))


def sentences(text: Column) -> Column:
    """Sentences of a line; citation markers after the full stop stay with their sentence."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])((?:\s*\[S\d+\])+)", "$2$1"), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def markdown_row(row: Column) -> Column:
    """Cells of a table row between pipes, trimmed."""
    return F.transform(F.split(F.regexp_replace(F.trim(row), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def scrub(text: Column) -> Column:
    for pattern, to in W.SCRUB:
        text = F.regexp_replace(text, pattern, to)
    return text


def record_hash(previous: Column, record: Column) -> Column:
    return F.sha2(F.concat(previous, record).cast("binary"), 256)


def abbreviations_in(text: Column) -> Column:
    """(term, meaning) of the known abbreviations of a text, longest term first.

    A term must stand alone, not inside a word or next to a hyphen; one whose meaning the text holds is left out.
    The dictionary is a fixed list, so this is one expression per term.
    """
    found = []
    for term, meaning, cased in sorted(W.ABBREVIATIONS, key=lambda t: (-len(t[0]), t[0])):
        pattern = ("" if cased else "(?i)") + r"(?<![\w-])" + term.replace(" ", r"[\s-]?") + r"(?![\w-])"
        found.append(F.when(text.rlike(pattern) & ~F.contains(F.lower(text), F.lit(meaning.lower())), F.struct(F.lit(term).alias("term"), F.lit(meaning).alias("meaning"))))
    return F.array_compact(F.array(*found))


def expand_queries(questions: DataFrame, id_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """(id, expansions, expanded): each question with the meanings of its abbreviations, each once."""
    text = F.col(text_col)
    meanings = F.array_distinct(F.transform(abbreviations_in(text), lambda a: a["meaning"]))
    joined = F.array_join(meanings, "; ")
    return questions.select(id_col, meanings.alias("expansions"), F.when(joined == "", text).otherwise(F.concat(text, F.lit(" ("), joined, F.lit(")"))).alias("expanded"))

"""Dictionaries from files: terms found in whole texts by one automaton, whatever their number."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries at most, checked before a dictionary is shipped to the tasks: some 50 MB as an automaton.
MAX_ENTRIES = 200_000
MAX_GAPS = 4


class Entry(NamedTuple):
    """A term, what it means, and whether its case counts."""

    term: str
    meaning: str
    cased: bool


def read_dictionary(spark: SparkSession, path: str) -> list[Entry]:
    """Entries of a text file of lines ``term<TAB>meaning[<TAB>cased]``; blank lines and lines that open with # are left out."""
    lines = spark.read.text(path).filter("trim(value) <> '' and not startswith(ltrim(value), '#')").limit(MAX_ENTRIES + 1).collect()
    entries = []
    for line in lines:
        term, meaning, *flags = [x.strip() for x in line.value.split("\t")] + [""] * (line.value.count("\t") == 0)
        if term:
            entries.append(Entry(term, meaning, "cased" in flags))
    return checked(entries)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term): distinct stems of the words of a text file of entities; lines that open with # are left out."""
    from corvane.functions.text import stemmed_words

    return spark.read.text(path).filter("not startswith(ltrim(value), '#')").select(F.explode(stemmed_words(F.col("value"))).alias("term")).distinct()


def checked(entries: Iterable[Entry]) -> list[Entry]:
    out = list(dict.fromkeys(entries))
    if len(out) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entries")
    return out


def _low(text: str) -> str:
    """Lower case and single blanks for each white character, place by place."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return "".join(" " if c.isspace() else c for c in low) if any(c.isspace() and c != " " for c in low) else low


class Finder:
    """The automaton of a dictionary: a trie of all spellings with failure links, read once along a text.

    A term stands alone, not inside a word or next to a hyphen; a blank in it may be missing or a hyphen in the text.
    """

    def __init__(self, entries: list[Entry]) -> None:
        self.entries = entries
        self.trie = ahocorasick.Automaton()
        spellings: dict[str, list[tuple[int, str]]] = {}
        for k, e in enumerate(entries):
            parts = e.term.split()
            gaps = len(parts) - 1
            for joints in itertools.product(("", " ", "-"), repeat=gaps) if gaps <= MAX_GAPS else ((j,) * gaps for j in ("", " ", "-")):
                spelling = "".join(x for pair in itertools.zip_longest(parts, joints, fillvalue="") for x in pair)
                spellings.setdefault(_low(spelling), []).append((k, spelling))
        for low, found in spellings.items():
            self.trie.add_word(low, (len(low), found))
        if spellings:
            self.trie.make_automaton()

    def find(self, text: str) -> list[int]:
        """Numbers of the entries whose term stands in the text."""
        if not len(self.trie):
            return []
        low, found = _low(text), set()
        alone = lambda i: not (0 <= i < len(text)) or not (text[i].isalnum() or text[i] in "_-")
        for last, (size, entries) in self.trie.iter(low):
            first = last + 1 - size
            if alone(first - 1) and alone(last + 1):
                own = "".join(" " if c.isspace() else c for c in text[first : last + 1])
                found.update(k for k, spelling in entries if not self.entries[k].cased or own == spelling)
        return sorted(found, key=lambda k: (-len(self.entries[k].term), self.entries[k].term, k))


def expansions(docs: DataFrame, entries: Iterable[Entry], id_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """(id, expansions, expanded): for each whole text its terms with their meanings, longest term first, and the text with them.

    A meaning that the text holds already, or that a longer term gave, is left out. Null texts have none. The dictionary
    is shipped once a task and its size is checked; texts are read once each, however many terms there are.
    """
    known = checked(entries)
    pair = pa.struct([("term", pa.string()), ("meaning", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(known)
        for batch in batches:
            lists = []
            for text in batch.column(1).to_pylist():
                taken, seen, low = [], set(), (text or "").lower()
                for k in finder.find(text or ""):
                    meaning = known[k].meaning
                    if meaning.lower() not in seen and meaning.lower() not in low:
                        seen.add(meaning.lower())
                        taken.append({"term": known[k].term, "meaning": meaning})
                lists.append(taken)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pair))], names=["id", "text", "expansions"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, "id long, text string, expansions array<struct<term:string,meaning:string>>")
    joined = F.array_join(F.transform("expansions", lambda x: x["meaning"]), "; ")
    text = F.when(F.size("expansions") == 0, F.col("text")).otherwise(F.concat("text", F.lit(" ("), joined, F.lit(")")))
    return found.select(F.col("id").alias(id_col), "expansions", text.alias("expanded"))

"""Extractive answers from passages, and verification of each claim against the passages it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import words as W
from corvane.functions.text import abbreviations_in, markers, numbers, sentences, stem, stemmed_words, strip_markers
from corvane.operators.conflicts import quantities
from corvane.operators.scoring import Scorer


def passages(context: DataFrame) -> DataFrame:
    """Context rows (question_id, place, title, heading, text) with marker ``S1``.. and the body that claims are held against.

    Where rows have ``supersedes``, an array of (doc_code, section_path) that the passage's document amends, the body
    opens with a note of them.
    """
    named = F.transform("supersedes", lambda x: F.concat(x["doc_code"], F.coalesce(F.concat(F.lit(" §"), F.nullif(x["section_path"], F.lit(""))), F.lit("")))) if "supersedes" in context.columns else None
    note = None if named is None else F.when(F.size("supersedes") > 0, F.concat(F.lit("(This document amends "), F.array_join(named, "; "), F.lit(")")))
    body = F.concat_ws("\n", *([] if note is None else [note]), "heading", "text")
    return context.withColumn("marker", F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("question_id").orderBy("place")).cast("string"))).withColumn("body", body)


def claims(drafts: DataFrame) -> DataFrame:
    """``drafts(question_id, draft)`` -> (question_id, line, pos, prefix, claim, cited): sentences of lines, bullets kept apart."""
    lines = drafts.select("question_id", F.posexplode(F.split(F.coalesce("draft", F.lit("")), "\n")).alias("line", "raw")).filter("trim(raw) <> ''")
    bullet = r"^\s*(?:[-*•]|\d+[.)])\s+"
    split = lines.withColumn("prefix", F.regexp_extract("raw", bullet, 0)).withColumn("body", F.regexp_replace("raw", bullet, ""))
    each = split.select("question_id", "line", "prefix", F.posexplode(sentences(F.col("body"))).alias("pos", "claim"))
    return each.withColumn("cited", markers(F.col("claim"))).select("question_id", "line", "pos", F.when(F.col("pos") == 0, F.col("prefix")).otherwise("").alias("prefix"), "claim", "cited")


def _meta() -> Column:
    return F.transform(F.array(*map(F.lit, W.CITATION_WORDS)), stem)


#: What names a passage in a citation: its numbers may stand in a claim.
SOURCE_COLUMNS = ("doc_code", "section_path", "version_label", "effective_from")


def verify_claims(made: DataFrame, known: DataFrame, least: float = 0.75) -> DataFrame:
    """(question_id, line, pos, prefix, claim, cited, supported, score, issue) of every claim.

    In order: no citation; no cited passage that is known; a number that no known cited passage holds, be it in the body
    or in any of ``SOURCE_COLUMNS`` that ``known`` has; then the share of the claim's stems, citation words aside, that one cited passage, or all together, cover.
    """
    each = made.withColumn("marker", F.explode_outer("cited"))
    facts = known.select("question_id", "marker", stemmed_words(F.col("body")).alias("stems"), numbers(F.concat_ws(" ", "body", *[F.col(c).cast("string") for c in SOURCE_COLUMNS if c in known.columns])).alias("nums"))
    joined = each.join(facts, ["question_id", "marker"], "left")
    own = F.array_except(stemmed_words(strip_markers(F.col("claim"))), _meta())
    cover = lambda there: F.when(F.size("own") == 0, 1.0).otherwise(F.round(F.size(F.array_intersect("own", there)) / F.size("own"), 4))
    scored = joined.withColumn("own", own).withColumn("one", F.when(F.col("stems").isNotNull(), cover(F.col("stems"))))
    keys = ["question_id", "line", "pos"]
    folded = scored.groupBy(*keys).agg(
        F.first("prefix").alias("prefix"), F.first("claim").alias("claim"), F.first("cited").alias("cited"), F.first("own").alias("own"), F.max("one").alias("best"),
        F.flatten(F.collect_list("stems")).alias("all"), F.flatten(F.collect_list("nums")).alias("nums"), F.count("stems").alias("known"),
    )
    score = F.greatest(F.coalesce("best", F.lit(0.0)), cover(F.array_distinct("all")))
    loose = F.array_except(numbers(F.col("claim")), F.col("nums"))
    issue = (
        F.when(F.size("cited") == 0, F.lit("no citation"))
        .when(F.col("known") == 0, F.lit("unknown source"))
        .when(F.size(loose) > 0, F.concat(F.lit("number not in source: "), F.array_join(F.array_sort(loose), ", ")))
        .when(score < least, F.lit("not supported"))
    )
    return folded.select(*keys, "prefix", "claim", "cited", issue.isNull().alias("supported"), F.when(issue.isNull(), score).otherwise(F.lit(0.0)).alias("score"), issue.alias("issue"))


def assemble(verdicts: DataFrame) -> DataFrame:
    """(question_id, answer, used, outcome, n_claims, n_supported): supported claims only, in order, line by line."""
    ok = F.when(F.col("supported"), F.struct("line", "pos", "prefix", "claim", "cited"))
    folded = verdicts.groupBy("question_id").agg(F.array_sort(F.collect_list(ok)).alias("kept"), F.count("*").alias("n_claims"), F.count_if("supported").alias("n_supported"))
    text = F.aggregate(
        "kept",
        F.struct(F.lit("").alias("out"), F.lit(-1).alias("line")),
        lambda acc, c: F.struct(F.concat(acc["out"], F.when(acc["line"] < 0, "").when(acc["line"] == c["line"], " ").otherwise("\n"), c["prefix"], c["claim"]).alias("out"), c["line"].alias("line")),
    )["out"]
    used = F.array_distinct(F.flatten(F.transform("kept", lambda c: c["cited"])))
    outcome = F.when(F.col("n_supported") == F.col("n_claims"), "answered").when(F.col("n_supported") > 0, "partial").otherwise("abstained")
    return folded.select("question_id", text.alias("answer"), used.alias("used"), outcome.alias("outcome"), "n_claims", "n_supported")


def marker_support(verdicts: DataFrame) -> DataFrame:
    """(question_id, marker, supported, support): per cited marker the best score of the claims it supports."""
    each = verdicts.select("question_id", F.explode("cited").alias("marker"), "supported", "score")
    return each.groupBy("question_id", "marker").agg(F.bool_or("supported").alias("supported"), F.round(F.max(F.when(F.col("supported"), F.col("score"))), 4).alias("support"))


def quick_value_check(values: DataFrame, known: DataFrame) -> DataFrame:
    """Quick values (question_id, marker, value) with ``ok``: in the source's body, or all of their numbers are."""
    both = values.join(known.select("question_id", "marker", "body"), ["question_id", "marker"], "left")
    nums = numbers(F.col("value"))
    return both.withColumn("ok", F.coalesce(F.contains("body", "value") | ((F.size(nums) > 0) & (F.size(F.array_except(nums, numbers(F.col("body")))) == 0)), F.lit(False))).drop("body")


# Marks of emphasis, quotes and lists, what opens a list item, headings that give a document's reasons,
# and questions about reasons or about a document's data.
_MARKUP = r"\*\*|__|`|^\s*>\s?|^\s*(?:[-*+•]|\d{1,2}[.)])\s+"
_ITEM = r"^(?:[-*+•]|\d{1,2}[.)]|\([a-z]{1,2}\)|\([ivx]{1,5}\))\s+"
_REASONS = r"(?i)^(background|purpose|introduction|rationale|document information)\b"
_ASKS_WHY = r"(?i)\b(why|purpose|background|reason|rationale)\b"
_ASKS_DATA = r"(?i)\b(effective|version|issued|owner|review due|date of)\b"


def answer_units(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id, ord, unit, cells, lead, lead_unit): what can be quoted of each chunk (id, heading, text), in order.

    Sentences of three words or more, of paragraphs and list items whose wrapped lines are joined, and table rows as
    ``heading — header: cell; …`` with ``cells``, an array of (label, value). ``lead`` is the ``ord`` of the sentence
    just before a row's table, ``lead_unit`` its text, if there is one. Lines are sorted by window inside a chunk.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, _MARKUP, ""), r"\s+", " "))
    lines = chunks.select(id_col, "heading", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n?|\n")).alias("n", "raw")).withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    kind = F.when(F.col("line") == "", "blank").when(F.col("line").startswith("|"), "table").when(F.col("line").rlike(_ITEM), "item").otherwise("text")
    order = Window.partitionBy(id_col).orderBy("n")
    before = F.coalesce(F.lag("kind").over(order), F.lit("blank"))
    opens = (F.col("kind") != before) & ~((F.col("kind") == "text") & (before == "item")) | (F.col("kind") == "item")
    grouped = lines.withColumn("kind", kind).withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("kind <> 'blank'")

    prose = grouped.filter("kind <> 'table'").groupBy(id_col, "group").agg(F.min("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ").alias("body"))
    sentences_ = prose.select(id_col, "group", "n", F.posexplode(F.split(plain(F.col("body")), r"(?<=[.;])\s+(?=[A-Z(])")).alias("m", "unit")).filter(F.size(F.split("unit", r"\s+")) >= 3)
    none = F.lit(None).cast("array<struct<label:string,value:string>>")

    table = grouped.filter("kind = 'table'").withColumn("cells", F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)))
    table = table.filter(~F.forall("cells", lambda c: (c == "") | c.rlike(r"^:?-{3,}:?$")))
    inside = Window.partitionBy(id_col, "group").orderBy("n")
    table = table.withColumn("head", F.first("cells").over(inside)).withColumn("place", F.row_number().over(inside)).filter("place > 1")
    pairs = F.filter(F.zip_with("head", "cells", lambda h, v: F.struct(plain(h).alias("label"), plain(v).alias("value"))), lambda x: x["label"].isNotNull() & (F.coalesce(x["value"], F.lit("")) != ""))
    body = F.array_join(F.transform("pairs", lambda x: F.concat(x["label"], F.lit(": "), x["value"])), "; ")
    rows = table.withColumn("pairs", pairs).select(id_col, "group", "n", F.lit(0).alias("m"), F.concat(F.coalesce("heading", F.lit("")), F.lit(" — "), body).alias("unit"), F.col("pairs").alias("cells"))

    units = sentences_.select(id_col, "group", "n", "m", F.regexp_replace("unit", r"\s+$", "").alias("unit"), none.alias("cells")).unionByName(rows)
    along = Window.partitionBy(id_col).orderBy("n", "m")
    units = units.withColumn("ord", F.row_number().over(along) - 1).withColumn("before", F.when(F.lag("cells").over(along).isNull(), F.lag(F.struct("ord", "unit")).over(along)))
    first = F.first("before").over(Window.partitionBy(id_col, "group").orderBy("n", "m"))
    return units.withColumn("lead", F.when(F.col("cells").isNotNull(), first)).select(id_col, "ord", "unit", "cells", F.col("lead.ord").alias("lead"), F.col("lead.unit").alias("lead_unit"))


def _concepts(words: Column, glossary: Column) -> Column:
    """For each word its alternatives, each a set of stems: itself, and the other form of abbreviations it is part of."""
    forms = F.transform(glossary, lambda g: F.struct(stemmed_words(g["term"]).alias("t"), stemmed_words(g["meaning"]).alias("m")))

    def of(word: Column) -> Column:
        meant = F.transform(F.filter(forms, lambda g: F.array_contains(g["t"], word) & (F.size(g["m"]) > 0)), lambda g: g["m"])
        short = F.transform(F.filter(forms, lambda g: ~F.array_contains(g["t"], word) & F.array_contains(g["m"], word) & (F.size(g["t"]) > 0)), lambda g: g["t"])
        return F.concat(F.array(F.array(word)), meant, short)

    return F.transform(words, of)


def _matched(concepts: Column, words: Column) -> Column:
    return F.size(F.filter(concepts, lambda alternatives: F.exists(alternatives, lambda a: F.size(F.array_except(a, words)) == 0)))


def query_concepts(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """(question_id, concepts, words, numbers, keys, asks_why, asks_data) of questions (question_id, question) and key terms (question_id, term)."""
    own = terms.groupBy("question_id").agg(F.collect_set("term").alias("own"))
    known = questions.join(own, "question_id", "left").withColumn("glossary", abbreviations_in(F.col("question")))
    stems, keys = stemmed_words(F.col("question")), F.coalesce("own", F.array().cast("array<string>"))
    made = known.withColumn("concepts", _concepts(stems, F.col("glossary"))).withColumn("keys", _concepts(keys, F.col("glossary")))
    words = F.array_distinct(F.flatten(F.flatten("concepts")))
    return made.select("question_id", "concepts", words.alias("words"), numbers(F.col("question")).alias("numbers"), "keys", F.col("question").rlike(_ASKS_WHY).alias("asks_why"), F.col("question").rlike(_ASKS_DATA).alias("asks_data"))


def _probe(question: Column) -> Column:
    """A question with what its abbreviations mean, as a relevance model reads it."""
    known = F.array_join(F.transform(abbreviations_in(question), lambda g: F.concat(g["term"], F.lit(" = "), g["meaning"])), "; ")
    return F.when(known == "", question).otherwise(F.concat(question, F.lit(" ("), known, F.lit(")")))


def scored_units(questions: DataFrame, context: DataFrame, terms: DataFrame, lead: int = 3, scorer: Scorer | None = None) -> DataFrame:
    """Units of every passage of a question with ``lexical`` and ``score``, the passage's columns and the question's concepts.

    ``considered`` marks the first ``lead`` passages and later ones that hold a key term, found once a passage.

    Lexical: the share of concepts in the unit, heading and title, 0.8 for a shared number, 0.6 of the share of key
    terms and half the passage's re-rank score. The score adds 0.3 where a passage is the branch's own, and takes 0.35
    off for headings that give reasons and for document headers, unless the question asks for those; and, given a
    ``scorer``, 1.5 times its score of the question with its expansions and ``heading: unit``.
    """
    given = context.columns
    optional = {"section_path": F.lit(""), "branch_specific": F.lit(False), "doc_code": F.lit(""), "effective_from": F.lit(None).cast("date")}
    numbered = passages(context.withColumns({c: v for c, v in optional.items() if c not in given})).drop("body")
    units = answer_units(numbered.select("chunk_id", "heading", "text").dropDuplicates(["chunk_id"]))
    named = _matched(F.col("keys"), stemmed_words(F.concat_ws(" ", "heading", "text", "title"))) > 0
    asked = numbered.join(query_concepts(questions, terms), "question_id").withColumn("considered", F.when(F.col("place") <= lead, True).when(F.size("keys") > 0, named).otherwise(False))
    both = asked.drop("text").join(units, "chunk_id")
    us = stemmed_words(F.concat_ws(" ", "unit", "heading", "title"))
    both = both.withColumn("us", us).withColumn("own_numbers", numbers(F.col("unit"))).withColumn("key_hits", _matched(F.col("keys"), F.col("us")))
    lexical = _matched(F.col("concepts"), F.col("us")) / F.greatest(F.size("concepts"), F.lit(1)) + 0.8 * F.arrays_overlap("numbers", "own_numbers").cast("int") + F.when(F.size("keys") > 0, 0.6 * F.col("key_hits") / F.size("keys")).otherwise(0.0) + 0.5 * F.col("rerank")
    prior = 0.3 * F.col("branch_specific").cast("int") - 0.35 * (F.trim("heading").rlike(_REASONS) & ~F.col("asks_why")).cast("int") - 0.35 * ((F.col("section_path") == "0") & ~F.col("asks_data")).cast("int")
    semantic = F.lit(0.0)
    if scorer is not None:
        both = both.join(questions.select("question_id", _probe(F.col("question")).alias("probe")), "question_id")
        semantic = 1.5 * scorer(F.col("probe"), F.concat_ws(": ", "heading", "unit"))
    return both.withColumn("lexical", F.round(lexical, 6)).withColumn("score", F.round(lexical + prior + semantic, 6))


def extractive_answers(questions: DataFrame, context: DataFrame, terms: DataFrame, conflicts: DataFrame | None = None, least: float = 0.34, lead: int = 3, scorer: Scorer | None = None) -> DataFrame:
    """(question_id, answer, not_found, quick_values): the units that best answer each question, quoted with their marker.

    ``questions``: question_id, question; ``context``: question_id, chunk_id, place, title, heading, text, rerank, and
    if known section_path, branch_specific, doc_code, effective_from; ``terms``: question_id, term, the key terms.
    Units of the first ``lead`` passages and of every later one with a key term compete; where there are key terms
    only units that name one. The best is quoted with up to two of the next three of the same passage that score three
    quarters of it, and agree with it on whether they hold a number of the question; then the sentences before their
    tables that cover more of the question. ``conflicts`` (question_id, marker_a, marker_b) adds what the other side
    says and which is newer. ``quick_values``: up to four (label, value, source) of the quoted cells and quantities.
    """
    every = scored_units(questions, context, terms, lead, scorer)
    usable = every.filter(F.col("considered") & ((F.size("keys") == 0) | (F.col("key_hits") > 0)))
    along, all_of = Window.partitionBy("question_id").orderBy(F.desc("score"), "place", "ord"), Window.partitionBy("question_id")
    usable = usable.withColumn("hit", F.arrays_overlap("numbers", "own_numbers"))
    tops = {"n": F.row_number().over(along), "top": F.first("marker").over(along), "best": F.first("score").over(along), "top_hit": F.first("hit").over(along), "most": F.max("lexical").over(all_of)}
    fits = (F.col("marker") == F.col("top")) & (F.col("score") >= 0.75 * F.col("best")) & ((F.size("numbers") == 0) | (F.col("hit") == F.col("top_hit")))
    chosen = usable.withColumns(tops).filter((F.col("most") >= least) & (F.col("n") <= 4) & ((F.col("n") == 1) | fits))
    lead_words = F.when(F.col("lead").isNotNull(), stemmed_words(F.concat_ws(" ", "lead_unit", "heading", "title")))
    listed = F.slice(F.array_sort(F.collect_list(F.struct("n", "ord", "unit", "cells", "us", "lead", "lead_unit", lead_words.alias("lead_us")))), 1, 3)
    each = chosen.groupBy("question_id").agg(F.first("top").alias("marker"), F.first("words").alias("words"), listed.alias("c")).withColumn("covered", F.flatten(F.transform("c", lambda x: x["us"])))
    adds = lambda x: x["lead"].isNotNull() & ~F.exists("c", lambda y: y["ord"] == x["lead"]) & (F.size(F.array_except(F.array_intersect(x["lead_us"], "words"), "covered")) > 0)
    cells = "array<struct<label:string,value:string>>"
    one = lambda o, u, c: F.struct(o.alias("ord"), u.alias("unit"), c.cast(cells).alias("cells"))
    leads = F.array_distinct(F.transform(F.filter("c", adds), lambda x: one(x["lead"], x["lead_unit"], F.lit(None))))
    quoted = each.select("question_id", "marker", F.sort_array(F.concat(F.transform("c", lambda x: one(x["ord"], x["unit"], x["cells"])), leads)).alias("quoted"))

    sentence = lambda text, marker: F.concat(F.regexp_replace(text, r"[ ;.]+$", ""), F.lit(". ["), marker, F.lit("]"))
    made = quoted.select("question_id", F.array_join(F.transform("quoted", lambda x: sentence(x["unit"], F.col("marker"))), "\n").alias("answer"))
    if conflicts is not None:
        sides = conflicts.withColumn("note", F.xxhash64("marker_a", "marker_b")).join(quoted.select("question_id", F.col("marker").alias("top")), "question_id").filter("top in (marker_a, marker_b)")
        sides = sides.withColumn("other", F.when(F.col("top") == F.col("marker_a"), F.col("marker_b")).otherwise(F.col("marker_a")))
        facts = every.select("question_id", "marker", "doc_code", "section_path", "effective_from").distinct()
        said = every.withColumn("k", F.row_number().over(Window.partitionBy("question_id", "marker").orderBy(F.desc("score"), "ord"))).filter("k = 1").select("question_id", F.col("marker").alias("other"), "unit")
        side = lambda c: facts.select("question_id", F.col("marker").alias(c), F.col("doc_code").alias(f"code_{c}"), F.col("section_path").alias(f"path_{c}"), F.col("effective_from").alias(f"from_{c}"))
        full = sides.join(said, ["question_id", "other"]).join(side("marker_a"), ["question_id", "marker_a"]).join(side("marker_b"), ["question_id", "marker_b"])
        is_a, first = F.col("other") == F.col("marker_a"), F.col("from_marker_a") >= F.col("from_marker_b")
        pick = lambda test, c: F.when(test, F.col(f"{c}_marker_a")).otherwise(F.col(f"{c}_marker_b"))
        however = F.concat(F.lit("However, "), pick(is_a, "code"), F.lit(" §"), pick(is_a, "path"), F.lit(" states: "), F.col("unit"))
        newer = F.concat(pick(first, "code"), F.lit(" has the later effective date ("), F.coalesce(pick(first, "from").cast("string"), F.lit("unknown")), F.lit(")"))
        notes = full.select("question_id", F.col("note").alias("at"), F.concat(sentence(however, F.col("other")), F.lit("\n"), sentence(newer, F.when(first, F.col("marker_a")).otherwise(F.col("marker_b")))).alias("line"))
        added = notes.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("notes"))
        made = made.join(added, "question_id", "left").select("question_id", F.concat_ws("\n", "answer", "notes").alias("answer"))
    units = quoted.select("question_id", "marker", F.explode("quoted").alias("q")).select("question_id", "marker", "q.*")
    out = questions.select("question_id").join(made, "question_id", "left").join(quick_values(units), "question_id", "left")
    empty = F.array().cast("array<struct<label:string,value:string,source:string>>")
    return out.select("question_id", "answer", F.col("answer").isNull().alias("not_found"), F.coalesce("quick_values", empty).alias("quick_values"))


def quick_values(quoted: DataFrame, most: int = 4) -> DataFrame:
    """(question_id, quick_values) of quoted units (question_id, marker, ord, unit, cells).

    The second to fourth cell of a table row under their headers; else those of a unit's first two quantities that have
    a unit, under the last three words before them. Equal values of one source count once.
    """
    cells = quoted.filter("cells is not null").select("question_id", "marker", "ord", F.posexplode(F.slice("cells", 2, 3)).alias("k", "c")).select("question_id", "marker", "ord", "k", "c.label", "c.value")
    texts = quoted.filter("cells is null").withColumn("id", F.xxhash64("question_id", "marker", "ord"))
    found = quantities(texts.select("id", "unit"), "id", "unit").withColumn("k", F.row_number().over(Window.partitionBy("chunk_id").orderBy("pos")) - 1).filter("k < 2 and unit <> ''")
    near = texts.select("id", "question_id", "marker", "ord", F.col("unit").alias("whole")).join(found, F.col("id") == F.col("chunk_id"))
    words = F.regexp_extract_all(F.substring(F.col("whole"), F.lit(1), F.col("pos")), F.lit("[A-Za-z]+"), F.lit(0))
    label = F.array_join(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), F.lit(3)), " ")
    sized = near.select("question_id", "marker", "ord", "k", F.when(label == "", "Value").otherwise(label).alias("label"), F.col("raw").alias("value"))
    place = F.struct("ord", "k")
    once = cells.unionByName(sized).groupBy("question_id", "marker", F.lower("value").alias("same")).agg(F.min_by("label", place).alias("label"), F.min_by("value", place).alias("value"), F.max(place).alias("place"))
    listed = F.array_sort(F.collect_list(F.struct("place", "label", "value", F.col("marker").alias("source"))))
    kept = F.transform(F.slice(listed, 1, most), lambda q: F.struct(q["label"].alias("label"), q["value"].alias("value"), q["source"].alias("source")))
    return once.groupBy("question_id").agg(kept.alias("quick_values"))

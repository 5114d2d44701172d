import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions.dictionary import MAX_ENTRIES, Entry, Finder, checked, expansions, read_dictionary, read_lexicon
from corvane.operators import answers
from corvane.operators import retrieval as r
from corvane.operators.scoring import pair_scorer


def by_pattern(entries, text):
    found = []
    for k, e in enumerate(entries):
        pattern = r"[\s-]?".join(map(re.escape, e.term.split()))
        if re.search(rf"(?<![\w-]){pattern}(?![\w-])", text, 0 if e.cased else re.IGNORECASE):
            found.append(k)
    return sorted(found, key=lambda k: (-len(entries[k].term), entries[k].term, k))


def test_finder_equals_patterns():
    rng = random.Random(1)
    pieces = ["pip", "taz", "IV", "iv", "a", "ICU", "ab", "b-c", "é", "x1", "ÄÖ"]
    for _ in range(60):
        entries = checked(Entry(" ".join(rng.choices(pieces, k=rng.randrange(1, 4))), "m", rng.random() < 0.4) for _ in range(rng.randrange(1, 12)))
        finder = Finder(entries)
        for _ in range(40):
            text = "".join(rng.choice(pieces + ["Pip", "äö", "É"]) + rng.choice([" ", "-", "", "\n", "\t", ", ", "_"]) for _ in range(rng.randrange(0, 9)))
            assert finder.find(text) == by_pattern(entries, text), (entries, text)


def test_fifty_thousand_terms_over_whole_texts(spark, tmp_path):
    lines = ["# brands and short forms", "", *(f"term{k} x{k}\tmeaning of {k}" + ("\tcased" if k % 3 == 0 else "") for k in range(50_000))]
    (tmp_path / "terms.txt").write_text("\n".join(lines))
    entries = read_dictionary(spark, str(tmp_path / "terms.txt"))
    assert len(entries) == 50_000 and sum(e.cased for e in entries) == 16_667
    rows = [(1, "word " * 100_000 + "TERM7-x7 and term9x9, TERM9 X9"), (2, None), (3, "term49999 x49999 gives meaning of 49999"), (4, "term30 X30")]
    got = {x.question_id: ([e.term for e in x.expansions], x.expanded) for x in expansions(spark.createDataFrame(rows, "question_id long, question string"), entries).collect()}
    assert got[1][0] == ["term7 x7", "term9 x9"] and got[1][1].endswith(" (meaning of 7; meaning of 9)")
    assert got[2] == ([], None) and got[3][0] == [] and got[4][0] == []
    with pytest.raises(ValueError):
        checked(Entry(str(k), "", False) for k in range(MAX_ENTRIES + 1))
    (tmp_path / "lexicon.txt").write_text("# names\nHeparin doses\ndosing\n")
    assert {x.term for x in read_lexicon(spark, str(tmp_path / "lexicon.txt")).collect()} == {"heparin", "dose", "dos"}


def test_entities_covered_by_an_expansion(spark):
    terms = spark.createDataFrame([(1, "tazocin"), (1, "dengu"), (2, "tazocin")], "question_id long, term string")
    stats = spark.createDataFrame([("piperacillin", 4)], "term string, df long")
    found = expansions(spark.createDataFrame([(1, "Tazocin for dengue"), (2, "tazocin?")], "question_id long, question string").filter("question_id = 1"), [Entry("Tazocin", "piperacillin-x or piperacillin", False)])
    assert sorted(map(tuple, r.uncovered_entities(terms, stats, ["tazocin", "dengu"], found).collect())) == [(1, "dengu"), (2, "tazocin")]
    assert r.uncovered_entities(terms, stats, ["tazocin", "dengu"]).count() == 3


def test_a_relevance_model_orders_units_and_windows(spark):
    questions = spark.createDataFrame([(1, "Which pack is for ICU bleeding?")], "question_id long, question string")
    text = "Bleeding needs units of blood at once. Pack 1 holds four units of cells."
    context = spark.createDataFrame([(1, 7, 1, "Guide", "Packs", text, 0.5)], "question_id long, chunk_id long, place int, title string, heading string, text string, rerank double")
    terms = spark.createDataFrame([], "question_id long, term string")
    model = pair_scorer(lambda qs, ts: [1.0 if "Pack 1" in t and "intensive care unit" in q and t.startswith("Packs: ") else 0.0 for q, t in zip(qs, ts, strict=True)], size=1)
    plain = {x.unit: x.score for x in answers.scored_units(questions, context, terms).collect()}
    tuned = {x.unit: x.score for x in answers.scored_units(questions, context, terms, scorer=model).collect()}
    assert {u: round(tuned[u] - plain[u], 6) for u in plain} == {"Bleeding needs units of blood at once.": 0.0, "Pack 1 holds four units of cells.": 1.5}
    assert answers.extractive_answers(questions, context, terms, scorer=model).first().answer.startswith("Pack 1")
    pool = spark.createDataFrame([(1, "q", 7, "T", "view")], "question_id long, question string, chunk_id long, title string, text string")
    windows = spark.createDataFrame([(7, 0, "first"), (7, 1, "second")], "chunk_id long, pos int, window string")
    best = r.maxp(pool, windows, scorer=pair_scorer(lambda qs, ts: [0.9 if t == "second" else 0.2 for t in ts])).first()
    assert (best.rerank, best.best_window) == (0.9, 1)
    failing = pair_scorer(lambda qs, ts: 1 / 0)
    assert [x[0] for x in pool.select(failing(F.col("question"), F.col("text"))).collect()] == [0.0]


def test_stored_conflicts_bring_in_their_other_side(spark):
    from corvane.operators import conflicts

    rows = [(1, 10, 1, True, 0.9, "2025-01-01"), (1, 20, 2, True, 0.8, "2024-01-01"), (1, 30, 3, True, 0.1, "2024-06-01"), (2, 20, 2, True, 0.5, "2024-01-01"), (1, 50, 5, False, 0.7, "2024-01-01")]
    context = spark.createDataFrame(rows, "question_id long, chunk_id long, document_id long, network_wide boolean, rerank double, day string").withColumn("effective_from", F.to_date("day"))
    stored = spark.createDataFrame([(1, 10, 99, "open"), (2, 98, 20, "open"), (3, 20, 97, "dismissed"), (4, 30, 96, "open"), (5, 20, 99, "open"), (6, 95, 94, "open")], "conflict_id long, chunk_a long, chunk_b long, status string")
    eligible = spark.createDataFrame([(99,), (96,), (97,), (95,)], "chunk_id long")  # 98 is not
    partners = conflicts.conflict_partners(context, stored, eligible).cache()
    assert sorted(map(tuple, partners.collect())) == [(1, 99, 0.9), (2, 99, 0.5)]
    texts = spark.createDataFrame([(10, "Infuse heparin at 12 units/kg per hour."), (20, "Infuse heparin at 18 units/kg per hour."), (30, "x"), (50, "Infuse heparin at 20 units/kg per hour.")], "chunk_id long, text string")
    found = conflicts.query_conflicts(context, stored, conflicts.quantities(texts), partners=partners)
    got = sorted(map(tuple, found.collect()))
    assert [g for g in got if g[3] == "stored"] == [(1, 10, 99, "stored"), (1, 20, 99, "stored"), (2, 20, 99, "stored")]
    assert [g for g in got if g[3] == "new"] == [(1, 20, 10, "new")]  # the older date first; not across the network mark
    alone = conflicts.query_conflicts(context, stored, conflicts.quantities(texts))
    assert not [g for g in alone.collect() if g.origin == "stored"]


def test_plain_blocks_by_hand(spark):
    from corvane.operators import structure

    text = "1.2 Dosing\nGive once daily.\nThen rest.\n\n- item one\n  goes on\n(a) item two\nWARD RULES\n  a lone indent\nNot a heading, with a comma.\nSection 4 Scope"
    got = structure.plain_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("block_no").collect()
    assert [(b.type, b.text) for b in got] == [
        ("heading", "1.2 Dosing"), ("paragraph", "Give once daily.\nThen rest."), ("item", "- item one\n  goes on"), ("item", "(a) item two"),
        ("heading", "WARD RULES"), ("paragraph", "  a lone indent\nNot a heading, with a comma."), ("heading", "Section 4 Scope"),
    ]
    assert all(text[b.char_start : b.char_end] == b.text for b in got)

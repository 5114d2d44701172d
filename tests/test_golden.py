"""Golden cases of the governed-document operators."""

from datetime import date

from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.operators import answers, audit, conflicts, evaluation, governance, metadata, privacy, retrieval, routing, structure


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_section_matches(spark):
    cases = [("4.2", "4.2", True), ("4.2", "4.2.1", True), ("4.2", "4.2#2", True), ("4.2", "4.2(a)", True), ("4", "4.2", True), (None, "7", True), ("4.2", "4.20", False), ("4.2", "4.1", False), ("%", "4", False)]
    df = spark.createDataFrame(cases, "target string, path string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", governance.section_matches(F.col("target"), F.col("path"))).collect())


def versions(spark, rows):
    return spark.createDataFrame([(i, d, s, date.fromisoformat(e), None) for i, d, s, e in rows], "version_id long, document_id long, status string, effective_from date, approved_at timestamp")


def test_current_and_refresh(spark):
    v = versions(spark, [(1, 1, "approved", "2026-01-01"), (2, 1, "approved", "2026-06-01"), (3, 1, "approved", "2027-01-01"), (4, 1, "draft", "2026-07-01"), (5, 2, "retired", "2026-01-01"), (6, 2, "superseded", "2025-01-01")])
    assert [r.version_id for r in governance.current_versions(v, "2026-09-30").collect()] == [2]
    changed = {r.version_id: r.new_status for r in governance.refresh_statuses(v, "2026-09-30").collect()}
    assert changed == {1: "superseded", 2: "approved", 3: "approved", 4: "draft", 5: "retired", 6: "superseded"}


def test_links_hide_clauses(spark):
    v = versions(spark, [(1, 1, "approved", "2026-01-01"), (10, 9, "approved", "2026-01-01"), (11, 9, "draft", "2026-01-01"), (12, 9, "superseded", "2026-01-01")])
    d = date(2026, 3, 1)
    links = spark.createDataFrame(
        [(1, 10, 1, "4.2", d, True), (2, 11, 1, "5", d, True), (3, 12, 1, "6", d, True), (4, 10, 1, "7", d, False), (5, 10, 1, "8", date(2027, 1, 1), True), (6, 10, 2, None, d, True)],
        "link_id long, source_version_id long, target_document_id long, target_section_path string, effective_from date, confirmed boolean",
    )
    chunks = spark.createDataFrame([(k, 1, 1, [p]) for k, p in enumerate(["4.2", "4.2.1", "4.20", "5", "6.1", "7", "8"])] + [(90, 1, 1, ["3", "4.2"])], "chunk_id long, version_id long, document_id long, paths array<string>")
    hidden = {r.chunk_id for r in governance.superseded_chunks(chunks, governance.active_links(links, v, "2026-09-30")).collect()}
    assert hidden == {0, 1, 4, 90}


def test_heading_numbers(spark):
    want = {"4.2.1 Rate change": ("4.2.1", "Rate change"), "Section 5 Scope": ("5", "Scope"), "Appendix B — Forms": ("B", "Forms"), "A.1 Checklist": ("A.1", "Checklist"), "C. Contacts": ("C", "Contacts"), "Background": (None, "Background")}
    df = spark.createDataFrame([(k,) for k in want], "line string")
    got = {r.line: (r.h.number, r.h.title) for r in df.select("line", t.heading_number(F.col("line")).alias("h")).collect()}
    assert got == want


def test_parents_dates_stems(spark):
    paths = {"4.2.1": "4.2", "4": "", "4.1-4.2": "4", "7#2": ""}
    got = {r.p: r.x for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", t.parent_path(F.col("p")).alias("x")).collect()}
    assert got == paths
    assert one(spark, t.loose_date(F.lit("3 march 2026"))) == date(2026, 3, 3) and one(spark, t.loose_date(F.lit("soon"))) is None
    for word, stem in {"infusions": "infusion", "rates": "rate", "sing": "sing", "used": "used", "policies": "polic"}.items():
        assert one(spark, t.stem(F.lit(word))) == stem


def test_markers_and_sentences(spark):
    assert one(spark, t.markers(F.lit("A [S1, S2]. B [S2] [S10]."))) == ["S1", "S2", "S10"]
    assert one(spark, F.size(t.sentences(F.lit("One fact. [S1] Another one [S2]. Third?")))) == 3
    assert one(spark, t.numbers(F.lit("10,000 units [S3], 2.50 and 7."))) == ["10000", "2.5", "7"]


def test_quantities_and_conflicts(spark):
    text = "Give >= 25,000 units in 50 ml every 6 hours, aPTT 60-85 seconds [S3]."
    found = conflicts.quantities(spark.createDataFrame([(1, text)], "chunk_id long, text string")).orderBy("pos").collect()
    assert [(q.value, q.unit, q.comparator) for q in found] == [("25000", "units", ">="), ("50", "ml", ""), ("6", "h", ""), ("60-85", "s", "")]
    assert all(text[q.pos : q.end].strip() == q.raw for q in found)
    far = "alpha " + "1, " * 400 + "5 mg " + "2; " * 300 + "omega"  # neighbours are words, however far
    last = conflicts.quantities(spark.createDataFrame([(1, far)], "chunk_id long, text string")).filter("unit = 'mg'").first()
    assert {"alpha", "omega"} <= set(last.context)
    rows = [(1, "Repeat the aPTT heparin sample every 6 hours until therapeutic"), (2, "Repeat the aPTT heparin sample every 4 hours until therapeutic"), (3, "Repeat the aPTT heparin sample every 6 hours until therapeutic"), (4, "Dilute in 50 ml saline"), (5, "Infuse with 100 ml saline")]
    q = conflicts.quantities(spark.createDataFrame(rows, "chunk_id long, text string"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "a long, b long")
    got = conflicts.conflict_pairs(pairs, q).collect()
    assert [(r.a, r.b, r.value_a, r.value_b) for r in got] == [(1, 2, "6", "4")] and got[0].confidence >= 0.7


def test_fusion_keeps_first_seen_order(spark):
    lists = [["a", "b", "c"], ["b", "a"]]
    dfs = [spark.createDataFrame([(1, c, k) for k, c in enumerate(x, 1)], "question_id long, chunk_id string, rank int") for x in lists]
    got = [(r.chunk_id, round(r.rrf, 9)) for r in retrieval.rrf(dfs).orderBy("rank").collect()]
    assert got == [("a", round(1 / 61 + 1 / 62, 9)), ("b", round(1 / 61 + 1 / 62, 9)), ("c", round(1 / 63, 9))]
    assert retrieval.rrf(dfs, limit=2).count() == 2


def test_references(spark):
    rows = [(1, "C-1", "In partial modification of P-ICU-07 §4.2, note this."), (2, "C-1", "Section 5.3 of P-ED-01 is replaced."), (3, "C-1", "P-ED-01 section 1 and section 2 are amended."), (4, "C-1", "See P-ED-01 section 9."), (5, "P-ED-01", "This amends P-ED-01 and X-99 §1."), (6, "C-1", "P-ED-01 is withdrawn.")]
    docs = spark.createDataFrame(rows, "doc_id long, self_code string, text string")
    known = spark.createDataFrame([("P-ICU-07",), ("P-ED-01",)], "doc_code string")
    got = {(r.doc_id, r.target_code, r.section) for r in metadata.detect_references(docs, known).collect()}
    assert got == {(1, "P-ICU-07", "4.2"), (2, "P-ED-01", "5.3"), (3, "P-ED-01", "1"), (3, "P-ED-01", "2"), (6, "P-ED-01", None)}


def test_redaction(spark):
    rows = [(1, "Mail a.b@c.org or call 98765 43210."), (2, "Give heparin to Anil today"), (3, "give Heparin to Ward"), (4, None), (5, "MRN: AB12345 for Mr. Ravi Kumar")]
    vocabulary = spark.createDataFrame([("heparin",), ("ward",)], "word string")
    got = {r.doc_id: (r.redacted, r.changed) for r in privacy.redact(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary).collect()}
    assert got[1] == ("Mail <EMAIL> or call <PHONE>.", True) and got[2] == ("Give heparin to <PERSON> today", True)
    assert got[3] == (rows[2][1], False) and got[4] == (None, False)
    assert "<MRN>" in got[5][0] and "<PERSON>" in got[5][0] and "Ravi" not in got[5][0]


def test_routes(spark):
    cases = {"Heparin rate for a 70 kg man": "high_risk", "Should I stop warfarin": "high_risk", "My patient is bleeding, what dose": "high_risk", "hello!": "out_of_scope", "who won the cricket": "out_of_scope", "dose?": "clarify", "How much?": "clarify", "What is the heparin storage policy on wards": "answer"}
    df = spark.createDataFrame([(q,) for q in cases], "question string")
    got = routing.route(df, ["heparin"]).collect()
    assert {r.question: r.route for r in got} == cases
    assert all((r.clarifying_question == routing.CLARIFY) == (r.route == "clarify") for r in got)
    field = spark.createDataFrame([("who answers a code blue cardiac arrest",), ("the news today",), ("what does a NEWS2 above 7 trigger",)], "question string")
    assert [r.route for r in routing.route(field, []).collect()] == ["answer", "out_of_scope", "answer"]


def test_lifecycle(spark):
    rows = [("a", 1, "approve", 7), ("a", 2, "approve", 8), ("b", 1, "retire", 7), ("b", 2, "approve", 8), ("c", 1, "approve", 5), ("c", 2, "retire", 6), ("d", 1, "upload", 1)]
    v = {r.entity_id: tuple(r)[1:] for r in governance.fold_versions(spark.createDataFrame(rows, "entity_id string, seq long, change string, actor long")).collect()}
    assert v == {"a": ("approved", 7, 1, None), "b": ("retired", None, None, 1), "c": ("retired", 5, 1, 2), "d": ("draft", None, None, None)}
    rows = [("a", 1, "resolve", 7), ("a", 2, "reopen", 8), ("b", 1, "dismiss", 7), ("c", 1, "reopen", 1), ("c", 2, "resolve", 2), ("c", 3, "note", 3), ("d", 1, "note", 1)]
    v = {r.entity_id: tuple(r)[1:] for r in governance.fold_resolutions(spark.createDataFrame(rows, "entity_id string, seq long, change string, actor long")).collect()}
    assert v == {"a": ("open", None, 2), "b": ("dismissed", 7, 1), "c": ("resolved", 2, 2), "d": ("open", None, None)}


def test_markdown_chunks(spark):
    text = "# Guide\n\nIntro words here.\n\n## 4.2 Dosing\nFirst line\nsecond line\n\n- (a) one\n  more\n- (b) two\n\n| H | V |\n|---|---|\n| x | 1 |\n\n---\n## 4.3 Scope\n" + "Long sentence number one goes on. " * 120
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    blocks = structure.markdown_blocks(docs).orderBy("block_no").collect()
    assert [b.type for b in blocks] == ["heading", "paragraph", "heading", "paragraph", "item", "item", "table", "heading", "paragraph"]
    assert all(text[b.char_start : b.char_end] == b.text for b in blocks)
    assert [list(r) for r in blocks[6].rows] == [["H", "V"], ["x", "1"]] and blocks[4].text == "- (a) one\n  more"
    chunks = structure.chunk_documents(structure.markdown_blocks(docs)).orderBy("ordinal").collect()
    assert all(c.token_count <= 400 for c in chunks) and {"4.3#1", "4.3#2"} <= {c.section_path for c in chunks}
    assert any(c.covered_paths == ["4.2", "4.2(a)", "4.2(b)"] for c in chunks)


def test_a_long_clause_of_one_part_takes_no_tiny_neighbour(spark):
    text = "## 4.1 Long\n" + "word " * 500 + "\n\n## 4.2 Tiny\nFew words.\n\n## 4.3 Tiny\nFew words.\n\n## 5 Last\n" + "word " * 60
    docs = spark.createDataFrame([(k, text) for k in (1, 2)], "doc_id long, text string")
    chunks = structure.chunk_documents(structure.markdown_blocks(docs)).orderBy("doc_id", "ordinal").collect()
    assert [(c.doc_id, c.ordinal, c.section_path) for c in chunks] == [(k, n, p) for k in (1, 2) for n, p in enumerate(("4.1#1", "4.2-4.3", "5"))]
    assert chunks[0].token_count == 500 and chunks[1].heading == "Tiny; Tiny"


def test_chain(spark):
    rows = [(k, f"2026-01-0{k} 10:00:00", 7, "a", "t", str(k), "{}") for k in range(1, 6)]
    schema = "seq long, created_at string, actor_user_id long, action string, entity_type string, entity_id string, payload string"
    events = spark.createDataFrame(rows, schema).withColumn("created_at", F.to_timestamp("created_at")).withColumn("log", F.lit(1))
    chain = audit.append_chain(events, "log").cache()
    assert tuple(audit.verify_chain(chain).first()) == (True, 5, None, None)
    changed = chain.withColumn("payload", F.when(F.col("seq") == 3, "{1}").otherwise(F.col("payload")))
    broken = chain.filter("seq <> 2")
    for events, want in ((chain, (True, 5, None, None)), (changed, (False, 2, 3, "content changed")), (broken, (False, 1, 3, "broken link"))):
        assert tuple(audit.verify_chain(events).first()) == want and tuple(audit.verify_chains(events, "log").first()) == (1, *want)


def test_canonical_records_and_hashes(spark):
    import hashlib
    import json

    payloads = ['{"b": 2, "a": "x"}', "{}", None, '{"z": [1, {"y": null, "b": true}], "é": "ü \\" \\\\"}']
    rows = [(k, "2026-01-02 03:04:05.000678", None if k == 1 else f"u{k}", 'act "q" \\ \n\t\x01\x1f é', "doc", None if k == 2 else "7", p) for k, p in enumerate(payloads)]
    schema = "seq long, created_at string, actor_user_id string, action string, entity_type string, entity_id string, payload string"
    events = spark.createDataFrame(rows, schema).withColumn("created_at", F.to_timestamp("created_at")).withColumn("log", F.lit(1))
    last = audit.GENESIS
    for r in sorted(audit.append_chain(events, "log").withColumn("record", audit.canonical_record()).collect(), key=lambda r: r.seq):
        fields = {"actor_user_id": r.actor_user_id, "action": r.action, "entity_type": r.entity_type, "entity_id": r.entity_id, "payload": json.loads(r.payload or "{}"), "created_at": "2026-01-02T03:04:05.000678+00:00"}
        assert r.record == json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.prev_hash == last and r.hash == hashlib.sha256((last + r.record).encode()).hexdigest()
        last = r.hash


def test_claims(spark):
    drafts = spark.createDataFrame([(1, "- Check aPTT every 6 hours [S1]. Uncited words stay here.\nRun at 18 units [S1].\nSeen elsewhere [S7].")], "question_id long, draft string")
    context = spark.createDataFrame([(1, 1, "Guide", "Dosing", "Check the aPTT every 6 hours and run at 12 units.", 0.9)], "question_id long, place int, title string, heading string, text string, rerank double")
    verdicts = answers.verify_claims(answers.claims(drafts), answers.passages(context))
    got = {(r.line, r.pos): r.issue for r in verdicts.collect()}
    assert got == {(0, 0): None, (0, 1): "no citation", (1, 0): "number not in source: 18", (2, 0): "unknown source"}
    stray = spark.createDataFrame([(1, "Check the aPTT now [S1][S9]. See §4.2 of G-7 v3, 2026 [S1]. Not 5 [S1][S9].")], "question_id long, draft string")
    full = context.withColumns({"doc_code": F.lit("G-7"), "section_path": F.lit("4.2"), "version_label": F.lit("v3"), "effective_from": F.lit("2026-02-01").cast("date"), "supersedes": F.expr("array(named_struct('doc_code', 'G-1', 'section_path', '2'), named_struct('doc_code', 'G-2', 'section_path', cast(null as string)))")})
    known = answers.passages(full)
    assert known.first().body == "(This document amends G-1 §2; G-2)\nDosing\nCheck the aPTT every 6 hours and run at 12 units."
    issues = [r.issue for r in answers.verify_claims(answers.claims(stray), known, least=0.5).orderBy("pos").collect()]
    assert issues[0] is None and "number" not in (issues[1] or "") and issues[2] == "number not in source: 5"
    done = answers.assemble(verdicts).first()
    assert done.outcome == "partial" and done.answer.startswith("- Check aPTT every 6 hours") and done.used == ["S1"]


def test_gate_passes_unknown(spark):
    metrics = spark.createDataFrame([(0.95, None, 2.0)], "recall double, precision double, leaks double")
    got = {r.metric: r.passed for r in evaluation.gate(metrics, {"recall": (">=", 0.9), "precision": (">=", 0.8), "leaks": ("<=", 0.0)}).collect()}
    assert got == {"recall": True, "precision": True, "leaks": False}


def test_eligibility_and_drop_reasons_agree(spark):
    """The filter and the reasons are made in different ways and must name the same chunks, at any date."""
    from corvane.sources.views import table

    sf = "/root/testdata/sf0.001"
    chunks, v, links, docs, branches = (table(spark, sf, n) for n in ("chunks_v", "versions_v", "links_v", "documents_v", "document_branches_v"))
    for as_of in ("1993-05-01", "1996-01-01", "1998-06-30"):
        for branch in (None, 3):
            scope = governance.branch_scope(docs, branches, branch)
            kept = {r.chunk_id for r in governance.eligible_chunks(chunks, v, links, as_of, scope).select("chunk_id").collect()}
            free = {r.chunk_id for r in governance.with_drop_reason(chunks, v, links, as_of, scope).filter("drop_reason is null").select("chunk_id").collect()}
            assert kept == free


def test_gold_passages_hold_whole_items(spark):
    item = "The whole item counts, " + "from its first word to the very last " * 5 + "one."
    items = spark.createDataFrame([(1, item), (2, "tiny"), (3, "  "), (4, item[:30] + " but another end")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "x " + item + " y"), (11, item[:-6]), (12, "a tiny one"), (13, "\ntiny"), (14, None), (15, item)], "doc_id long, text string")
    assert {tuple(r) for r in evaluation.containing_passages(items, docs).collect()} == {(1, 10), (1, 15), (2, 12), (2, 13)}


def test_nearest_rank_of_one_large_group(spark):
    rows = [("a", float(k * 7919 % 5000)) for k in range(5000)] + [("b", 1.0), ("b", 3.0), ("b", None), ("c", None)]
    got = evaluation.nearest_rank(spark.createDataFrame(rows, "g string, v double").repartition(7), "g", "v", 0.95, "p").collect()
    assert {tuple(r) for r in got} == {("a", 4749.0), ("b", 3.0)}


def test_answer_units(spark):
    text = "Intro **bold** words here. Second\nwrapped sentence follows\n\n- item one is here\n- two\n\nUse this table now:\n| Drug | Dose | Route |\n|---|:---:|---|\n| A | 5 mg | IV |\n| B |  | oral |\nAfter the table comes text."
    got = answers.answer_units(spark.createDataFrame([(1, "Doses", text), (2, "", None)], "chunk_id long, heading string, text string")).orderBy("ord").collect()
    assert [r.unit for r in got] == ["Intro bold words here.", "Second wrapped sentence follows", "item one is here", "Use this table now:", "Doses — Drug: A; Dose: 5 mg; Route: IV", "Doses — Drug: B; Route: oral", "After the table comes text."]
    assert [r.lead for r in got] == [None] * 4 + [3, 3, None] and [c.value for c in got[4].cells] == ["A", "5 mg", "IV"]


def test_extractive_answers(spark):
    questions = spark.createDataFrame([(1, "What is the heparin dose"), (2, "TPN rate at 40 ml/h"), (3, "Who owns the moon"), (4, "zorbium limit")], "question_id long, question string")
    rows = [
        (1, 10, 1, "Guide", "Dosing", "Give heparin dose of 80 units per kg now. Unrelated words stand here too.", 0.9), (1, 11, 2, "Guide", "Background", "The heparin dose has a long history here.", 0.9),
        (2, 20, 1, "Food", "Rates", "Total parenteral nutrition needs a doctor to sign:\n| State | Rate |\n|---|---|\n| Start | 40 ml/h |\n| Later | 60 ml/h |", 0.8),
        (3, 30, 1, "Guide", "Dosing", "Nothing of that kind is said in this text.", 0.0),
        *((4, 40 + k, k, "Guide", "Other", "Plain words about other things entirely.", 0.5) for k in range(1, 5)), (4, 45, 5, "Guide", "Late", "The zorbium limit is 7 mg a day. Plain words about other things.", 0.5),
    ]
    context = spark.createDataFrame(rows, "question_id long, chunk_id long, place int, title string, heading string, text string, rerank double").withColumn("doc_code", F.concat(F.lit("D-"), "chunk_id")).withColumn("section_path", F.lit("4")).withColumn("effective_from", F.date_add(F.lit("2025-12-31").cast("date"), F.col("chunk_id").cast("int")))
    terms = spark.createDataFrame([(4, "zorbium")], "question_id long, term string")
    notes = spark.createDataFrame([(1, "S1", "S2")], "question_id long, marker_a string, marker_b string")
    got = {r.question_id: r for r in answers.extractive_answers(questions, context, terms, notes).collect()}
    assert got[1].answer.split("\n") == ["Give heparin dose of 80 units per kg now. [S1]", "However, D-11 §4 states: The heparin dose has a long history here. [S2]", "D-11 has the later effective date (2026-01-11). [S2]"]
    assert [(q.label, q.value) for q in got[1].quick_values] == [("heparin dose of", "80 units")]
    assert got[2].answer.startswith("Rates — State: Start; Rate: 40 ml/h. [S1]") or "Rate: 40 ml/h. [S1]" in got[2].answer
    assert "60 ml/h" not in got[2].answer and ("Rate", "40 ml/h", "S1") in [tuple(q) for q in got[2].quick_values]
    assert got[3].not_found and got[3].answer is None and got[3].quick_values == []
    assert got[4].answer == "The zorbium limit is 7 mg a day. [S5]" and not got[4].not_found

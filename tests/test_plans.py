"""Plans keep what scale depends on: pruned scans, pushed filters, partial steps before exchanges."""

import contextlib
import io
import re

import pytest

from corvane.plans import registry
from corvane.plans import analytics, corpus, governance, retrieval, streams, text  # noqa: F401

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scans_read_only_needed_columns(spark):
    p = plan(registry.QUERIES["b06_eligible_chunks"](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert schemas and not any("l_extendedprice" in s or "o_totalprice" in s or "c_acctbal" in s for s in schemas)


def test_filters_reach_the_scan(spark):
    p = plan(registry.QUERIES["b01_current_versions"](spark, SF))
    assert "PushedFilters: [" in p and "IsNotNull(o_orderdate)" in p


@pytest.mark.parametrize("name", ["b01_current_versions", "h05_keyword_topk", "h06_vector_topk", "l16_history"])
def test_top_k_is_limited_before_the_exchange(spark, name):
    p = plan(registry.QUERIES[name](spark, SF))
    assert p.count("WindowGroupLimit") >= 2


def test_no_cartesian_product_over_chunks(spark):
    for name in ("b04_superseded_chunks", "b06_eligible_chunks", "b10_hides_sections", "j02_conflict_pairs", "j04_new_pairs", "m01_gold_passages"):
        assert "CartesianProduct" not in plan(registry.QUERIES[name](spark, SF)), name


#: Queries with the blocked matrix product of the vector search, the one step of theirs in Arrow tasks.
VECTOR = ("h06_vector_topk", "h06_lsh_recall", "h06_index_recall", "h07_rank_fusion", "h09_lexical_rerank")


def test_native_queries_run_no_python(spark):
    for name in sorted(registry.QUERIES):
        if name[:2] in ("b0", "b1", "b2", "h0", "m0") and name not in ("h06_lsh_recall", "h06_index_recall"):
            python = "ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups" + ("" if name in VECTOR else "|MapInArrow")
            assert not re.search(python, plan(registry.QUERIES[name](spark, SF))), name


def test_vector_search_joins_by_blocks(spark):
    p = plan(registry.QUERIES["h06_vector_topk"](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p and "MapInArrow" in p


@pytest.fixture
def small_broadcasts(spark):
    """Texts of sf0.001 count as too large to broadcast, as those of a large table are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["h09_lexical_rerank", "h14_context_cut"])
def test_texts_of_pools_are_not_shuffled(spark, small_broadcasts, name):
    assert "SortMergeJoin" not in plan(registry.QUERIES[name](spark, SF))


def test_texts_of_contexts_are_joined_once(spark, small_broadcasts):
    from corvane.plans.corpus import context_rows

    p = plan(context_rows(spark, SF))
    assert "Exchange" not in p and "Join" not in p


def test_texts_with_items_are_not_shuffled(spark, small_broadcasts):
    p = plan(retrieval.gold(spark, SF))
    assert "SortMergeJoin" not in p


@pytest.mark.parametrize("name", ["h03_key_terms", "h04_uncovered_entities"])
def test_statistics_of_question_terms_come_from_the_index(spark, name):
    p = plan(registry.QUERIES[name](spark, SF))
    assert "/postings" in p and "regexp_extract_all(lower(text" not in p


def test_index_shuffles_postings_once(spark):
    from corvane.operators.inverted import posting_blocks

    df = posting_blocks(retrieval.passages(spark, SF), 32)
    assert plan(df).split("== Physical Plan ==")[1].split("\n\n")[0].count("Exchange") == 1


def test_texts_are_searched_once_for_conflicts(spark):
    from corvane.operators import conflicts

    texts = spark.createDataFrame([(1, "Repeat the heparin aptt check every 6 hours on the ward"), (2, "Repeat the heparin aptt check every 8 hours on the ward")], "chunk_id long, text string")
    found = conflicts.conflict_pairs(spark.createDataFrame([(1, 2)], "a long, b long"), conflicts.quantities(texts))
    assert "InPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.a, r.b, r.value_a, r.value_b) for r in found.collect()] == [(1, 2, "6", "8")]


def test_patterns_are_left_out_only_where_they_cannot_match():
    import random
    import re

    from corvane.operators import privacy

    rng = random.Random(8)
    labels = ["UHID", "mrn", "IPNo", "IPD No.", "opd\tNO", "CR No", "HospID", "Hospital No", "Reg No", "Registration no.", "Patient ID", "patİent id", "Hoſp No", "bed head ticKet", "Bed Head Ticket", "DOB", "d.o.b.", "born on"]
    names = ["Mr", "Mrs.", "Mstr", "Dr", "Sh.", "Sh", "Shree", "Kumari", "patient", "Pt.", "pt", "name is", "Name:", "kept", "to", "for", "gave", "about", "of\n"]
    values = ["A1234/x", "ABC123456", "12 3456 7890 1234", "12345678901234", "x.yz@abdm", "2345 6789 0123", "+91 98765 43210", "040-1234567", "a@b.org", "1/2/1990", "Asha Rao", "ASHA", "١٢٣٤٥٦٧", "plain", "Xyé"]
    compiled, hits = [re.compile(p[1]) for p in privacy.PATTERNS], [0] * len(privacy.PATTERNS)
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice((labels, names, values))) + rng.choice((" ", "  ", "\n", "", ": ", ". ")) for _ in range(rng.randint(1, 4)))
        run = privacy._digits(text)
        for n, (needs, pattern) in enumerate(zip(privacy._NEEDS, compiled, strict=True)):
            if pattern.search(text):
                hits[n] += 1
                assert needs(text, run), (n, text)
    assert min(hits) > 0


def test_texts_are_searched_once_for_redaction(spark):
    from corvane.operators import privacy

    docs = spark.createDataFrame([(1, "Call Asha Rao or write to asha@example.org"), (2, None), (3, "nothing here")], "doc_id long, text string")
    done = privacy.redact(docs, privacy.corpus_vocabulary(docs.select("text").filter("doc_id > 1")))
    assert "InPandas" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: r.changed for r in done.collect()} == {1: True, 2: False, 3: False}

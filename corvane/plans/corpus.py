"""Corpus-preparation, privacy, routing and answer queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.text import stemmed_words
from corvane.operators import answers, conflicts, evaluation, metadata, privacy, routing, structure
from corvane.plans.analytics import RECORD
from corvane.plans.governance import views
from corvane.plans.registry import query
from corvane.plans.retrieval import KEYWORD, PASSAGES, POSTS, TERMS, gold, keyword, passages, questions, rare_terms
from corvane.plans.text import stem_sql, stems_sql
from corvane.functions import words as W
from corvane.sources import corpus
from corvane.sources.scratch import written
from corvane.sources.views import duck, table


#: Sentences of a line in SQL: a mark before white space ends one, once citation markers stand before the mark.
SENTENCES = r"string_split(regexp_replace(regexp_replace({}, '([.!?])((?:\s*\[S\d+\])+)', '\2\1', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query("a04_refuse_duplicates", "SELECT min(doc_id) AS doc_id FROM documents WHERE doc_id % 10 <> 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 10 = 0) GROUP BY text")
def a04(spark, sf):
    docs = texts(spark, sf)
    stored = docs.filter("doc_id % 10 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return corpus.refuse_duplicates(docs.filter("doc_id % 10 <> 0"), stored, "text", "doc_id").select("doc_id")


@query("a05_new_versions", f"WITH {duck('versions_v')} SELECT version_id FROM versions_v WHERE version_id % 2 = 1 AND (document_id, version_label) NOT IN (SELECT document_id, version_label FROM versions_v WHERE version_id % 2 = 0)")
def a05(spark, sf):
    v = table(spark, sf, "versions_v")
    return corpus.new_versions(v.filter("version_id % 2 = 1"), v.filter("version_id % 2 = 0")).select("version_id")


@query("a10_corpus_vocabulary", "SELECT DISTINCT unnest(regexp_extract_all(lower(x), '[a-z][a-z''-]+')) AS word FROM (SELECT text AS x FROM documents UNION ALL SELECT n_name FROM nation)")
def a10(spark, sf):
    return privacy.corpus_vocabulary(texts(spark, sf).select("text"), table(spark, sf, "nation").select("n_name"))


@query("e01_markdown_blocks")
def e01(spark, sf):
    return structure.markdown_blocks(texts(spark, sf)).select("doc_id", "block_no", "type", "char_start", "char_end", "text")


@query("e01_blocks_cover_texts", "SELECT * FROM (SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\\s*(-{3,}|\\*{3,}|_{3,})\\s*$'))) AS BIGINT) AS n_lines FROM (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents)) WHERE n_lines > 0")
def e01b(spark, sf):
    """Lines of all blocks of a text: every line that is not blank, once."""
    return structure.markdown_blocks(texts(spark, sf)).groupBy("doc_id").agg(F.sum(F.size(F.split("text", "\n"))).alias("n_lines"))


@query("e02_plain_blocks")
def e02(spark, sf):
    return structure.plain_blocks(texts(spark, sf)).select("doc_id", "block_no", "type", "char_start", "char_end")


@query("e03_html_blocks", "SELECT page_id, CAST(len(list_filter(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '(?s)<(?:p|h1)>(.*?)(?:<p>|</p>|</h1>|$)', 1), lambda x: true)) > 0 AS BOOLEAN) AS has_blocks FROM pages")
def e03(spark, sf):
    found = structure.html_blocks(table(spark, sf, "pages")).select("page_id").distinct().withColumn("has_blocks", F.lit(True))
    return table(spark, sf, "pages").select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("has_blocks", F.lit(False)).alias("has_blocks"))


@query("e04_table_rows", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || ',' || o_orderpriority || ',' || o_orderstatus AS cells FROM orders")
def e04(spark, sf):
    from corvane.functions.text import markdown_row

    row = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), "o_orderpriority", F.lit("|"), "o_orderstatus", F.lit(" |"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(markdown_row(row), ",").alias("cells"))


@query("e06_clause_chunks")
def e06(spark, sf):
    """Clause chunks of all documents: segmentation, packing of long clauses, tables, merging of tiny ones (E6 to E10)."""
    return structure.chunk_documents(structure.markdown_blocks(texts(spark, sf))).select("doc_id", "ordinal", "section_path", "token_count", "char_start", "char_end")


@query("e12_span_union", "SELECT l_orderkey AS chunk_id, CAST(min(l_linenumber) AS BIGINT) AS page_start, CAST(max(l_linenumber) AS BIGINT) AS page_end, count(DISTINCT l_linenumber) AS n_boxes FROM lineitem GROUP BY 1")
def e12(spark, sf):
    boxes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").cast("long").alias("page"), F.col("l_tax").alias("x0"), F.col("l_discount").alias("y0"), F.col("l_quantity").alias("x1"), F.col("l_extendedprice").alias("y1"))
    u = structure.box_union(boxes)
    return u.select("chunk_id", "page_start", "page_end", F.size("boxes").cast("long").alias("n_boxes"))


@query("e13_context_header", f"WITH {duck('chunks_v', 'versions_v', 'documents_v')} SELECT chunk_id, left('[' || doc_code || ' ' || version_label || ' §' || section_path || '] ' || p_name, 600) AS header FROM chunks_v JOIN versions_v USING (version_id) JOIN documents_v USING (document_id) JOIN part ON p_partkey = part_id")
def e13(spark, sf):
    c, v, d, p = views(spark, sf, "chunks_v", "versions_v", "documents_v", "part")
    full = c.join(v.select("version_id", "document_id", "version_label"), "version_id").join(d.select("document_id", "doc_code"), "document_id").join(p.select(F.col("p_partkey").alias("part_id"), "p_name"), "part_id")
    return full.select("chunk_id", structure.context_header(F.col("doc_code"), F.col("version_label"), F.col("section_path"), F.col("p_name")).alias("header"))


@query("e16_sentences", "SELECT conv_id, turn, CAST(len(list_filter(" + SENTENCES.format("text") + ", lambda s: trim(s) <> '')) AS INTEGER) AS n FROM conversations")
def e16(spark, sf):
    from corvane.functions.text import sentences

    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(sentences(F.col("text"))).alias("n"))


HEAD = "concat('# ', c_name, char(10), 'Document code: P-', CAST(c_custkey AS STRING), char(10), '| Version | v', CAST(c_custkey % 9 + 1 AS STRING), ' |', char(10), 'Effective from: 2024-0', CAST(c_custkey % 9 + 1 AS STRING), '-15', char(10), 'Review due: 3 March 2026')"


@query("c01_extract_metadata", "SELECT c_custkey AS doc_id, 'P-' || CAST(c_custkey AS VARCHAR) AS doc_code, CAST(c_custkey % 9 + 1 AS VARCHAR) AS version_label, CAST('2024-0' || CAST(c_custkey % 9 + 1 AS VARCHAR) || '-15' AS DATE) AS effective_from, DATE '2026-03-03' AS review_due, c_name AS title FROM customer")
def c01(spark, sf):
    return metadata.extract_metadata(table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(HEAD).alias("text")))


@query(
    "c03_validate_metadata",
    f"""WITH {duck('documents_v', 'versions_v')} SELECT version_id, concat_ws('; ', CASE WHEN version_id % 5 = 0 THEN 'document code' END, CASE WHEN version_id % 7 = 0 THEN 'title' END, CASE WHEN version_id % 3 = 0 THEN 'review before effect' END, CASE WHEN NOT network_wide THEN 'branch missing' END) AS errors FROM versions_v JOIN documents_v USING (document_id)""",
)
def c03(spark, sf):
    v = table(spark, sf, "versions_v").join(table(spark, sf, "documents_v"), "document_id")
    k = F.col("version_id")
    rows = v.withColumns({"doc_code": F.when(k % 5 == 0, F.lower("doc_code")).otherwise(F.col("doc_code")), "title": F.when(k % 7 == 0, F.lit("  ")).otherwise(F.col("title")), "review_due": F.when(k % 3 == 0, F.date_sub("effective_from", 1)).otherwise(F.col("review_due")), "branch_id": F.lit(None).cast("int")})
    return metadata.validate_metadata(rows).select("version_id", F.array_join("errors", "; ").alias("errors"))


@query("c04_metadata_warnings", "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN 'doc_code,' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN 'effective_from' ELSE '' END AS fields FROM customer")
def c04(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    found = metadata.extract_metadata(c.select(k.alias("doc_id"), F.expr(HEAD).alias("text")))
    date = F.to_date(F.concat(F.lit("2024-0"), (k % 9 + 1).cast("string"), F.lit("-15")))
    sent = c.select(k.alias("doc_id"), F.concat(F.when(k % 4 == 0, "Q-").otherwise("P-"), k.cast("string")).alias("doc_code"), F.concat(F.lit("V"), (k % 9 + 1).cast("string")).alias("version_label"), F.when(k % 3 == 0, F.date_add(date, 1)).otherwise(date).alias("effective_from"))
    warned = metadata.metadata_warnings(sent, found)
    has = lambda f, tail: F.when(F.exists("warnings", lambda w: w["field"] == f), F.lit(f + tail)).otherwise("")
    return warned.select("doc_id", F.concat(has("doc_code", ","), has("effective_from", "")).alias("fields"))


@query("c05_low_confidence_pages", "SELECT l_orderkey AS version_id, coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY CAST(p AS VARCHAR)) FILTER (c < 0.8), '') AS low_pages, min(c) AS min_confidence FROM (SELECT l_orderkey, l_linenumber AS p, min(l_quantity) / 50.0 AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def c05(spark, sf):
    pages = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_quantity") / 50.0).alias("c"))
    v = pages.groupBy(F.col("l_orderkey").alias("version_id")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string"), "c"))).alias("page_confidence"))
    return metadata.low_confidence_pages(v).select("version_id", F.array_join("low_pages", ",").alias("low_pages"), "min_confidence")


@query("c06_detect_references", "SELECT o_orderkey AS doc_id, 'P-' || CAST(o_custkey AS VARCHAR) AS target_code, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 9 + 1 AS VARCHAR) || '.2' END AS section FROM orders WHERE o_orderkey % 4 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)")
def c06(spark, sf):
    o = table(spark, sf, "orders")
    where = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" §"), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(".2"))).otherwise("")
    lead = F.when(F.col("o_orderkey") % 3 == 2, F.concat(F.lit("Section "), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(".2 of "))).otherwise("")
    verb = F.when(F.col("o_orderkey") % 4 != 0, F.lit(" is amended. It stands.")).otherwise(" is cited. It stands.")
    text = F.concat(F.lit("A preface. "), lead, F.lit("P-"), F.col("o_custkey").cast("string"), where, verb)
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("Z-SELF").alias("self_code"), text.alias("text"))
    known = table(spark, sf, "customer").select(F.concat(F.lit("P-"), F.col("c_custkey").cast("string")).alias("doc_code"))
    return metadata.detect_references(docs, known).select("doc_id", "target_code", "section")


LINK = "SELECT source_version_id AS source_id, target_document_id AS target_id, target_section_path AS section FROM links_v"


@query("c07_new_suggestions", f"WITH {duck('links_v')} SELECT link_id FROM links_v a WHERE link_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM links_v b WHERE b.link_id % 3 = 0 AND a.link_id = b.link_id AND a.target_document_id = b.target_document_id AND a.target_section_path IS NOT DISTINCT FROM b.target_section_path)")
def c07(spark, sf):
    links = table(spark, sf, "links_v").select("link_id", F.col("source_version_id").alias("source_id"), F.col("target_document_id").alias("target_id"), F.col("target_section_path").alias("section"))
    return metadata.new_suggestions(links.filter("link_id % 2 = 1"), links.filter("link_id % 3 = 0").drop("link_id")).select("link_id")


@query("g01_redact")
def g01(spark, sf):
    docs = texts(spark, sf)
    out = privacy.redact(docs, privacy.corpus_vocabulary(docs.select("text")))
    return out.select("doc_id", "redacted", F.array_join("entities", ",").alias("entities"), "changed")


@query("g04_email_counts", "SELECT source, count(*) FILTER (regexp_matches(text, '\\b[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+\\b')) AS n FROM documents GROUP BY 1")
def g04(spark, sf):
    found = privacy.detect(texts(spark, sf)).filter("entity = 'EMAIL'").select("doc_id").distinct().withColumn("hit", F.lit(True))
    return table(spark, sf, "documents").join(found, "doc_id", "left").groupBy("source").agg(F.count_if("hit").alias("n"))


@query("g05_route", "SELECT event_id, ['high_risk', 'out_of_scope', 'clarify', 'answer'][event_id % 4 + 1] AS route FROM events")
def g05(spark, sf):
    k = F.col("event_id") % 4
    q = F.when(k == 0, F.concat(F.lit("Heparin for a man of "), (F.col("event_id") % 40 + 50).cast("string"), F.lit(" kg"))).when(k == 1, "who won the cricket").when(k == 2, "dose?").otherwise("How is heparin stored on the ward")
    return routing.route(table(spark, sf, "events").select("event_id", q.alias("question")), ["heparin"]).select("event_id", "route")


@query("g05_route_conversations")
def g05b(spark, sf):
    turns = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return routing.route(turns, ["heparin"]).select("conv_id", "turn", "route", "reason")


QTEXT = "concat('Give heparin infusion check aptt sample after ', CAST(CAST(l_quantity AS INT) AS STRING), ' hours of therapy ward')"


@query("j01_quantities", "SELECT l_orderkey * 10 + l_linenumber AS chunk_id, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS value, 'h' AS unit FROM lineitem")
def j01(spark, sf):
    c = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.expr(QTEXT).alias("text"))
    return conflicts.quantities(c).select("chunk_id", "value", "unit")


@query("j02_conflict_pairs", "SELECT a.o_orderkey AS a, b.o_orderkey AS b, CAST(a.o_orderkey % 5 + 2 AS VARCHAR) AS value_a, CAST(b.o_orderkey % 5 + 2 AS VARCHAR) AS value_b FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 5 <> b.o_orderkey % 5")
def j02(spark, sf):
    o = table(spark, sf, "orders")
    q = conflicts.quantities(o.select(F.col("o_orderkey").alias("chunk_id"), F.concat(F.lit("Repeat the aptt sample heparin check every "), (F.col("o_orderkey") % 5 + 2).cast("string"), F.lit(" hours until target reached")).alias("text")))
    pairs = o.select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"))
    return conflicts.conflict_pairs(pairs, q).select("a", "b", "value_a", "value_b")


@query("j04_new_pairs", f"WITH {duck('conflicts_v')}, p AS (SELECT DISTINCT CASE WHEN CAST(x AS VARCHAR) > CAST(y AS VARCHAR) THEN y ELSE x END AS a, CASE WHEN CAST(x AS VARCHAR) > CAST(y AS VARCHAR) THEN x ELSE y END AS b FROM (SELECT o_orderkey * 10 + 2 AS x, o_orderkey * 10 + 1 AS y FROM orders)) SELECT a, b FROM p WHERE (a, b) NOT IN (SELECT chunk_a, chunk_b FROM conflicts_v)")
def j04(spark, sf):
    pairs = table(spark, sf, "orders").select((F.col("o_orderkey") * 10 + 2).alias("a"), (F.col("o_orderkey") * 10 + 1).alias("b"))
    return conflicts.new_pairs(pairs, table(spark, sf, "conflicts_v"))


def context_rows(spark, sf):
    """The first six passages of each question with their texts, written: few rows are joined to texts that stay in place, once."""
    top = written(keyword(spark, sf).filter("rank <= 6")).join(passages(spark, sf), "chunk_id")
    return written(top.select("question_id", "chunk_id", F.col("rank").alias("place"), F.lit("Corpus").alias("title"), F.lit("text").alias("heading"), "text", F.col("score").alias("rerank")))


@query("j05_query_conflicts")
def j05(spark, sf):
    ctx = context_rows(spark, sf).withColumn("document_id", F.col("chunk_id")).withColumn("network_wide", F.lit(True))
    stored = ctx.groupBy("question_id").agg(F.min("chunk_id").alias("chunk_a"), F.max("chunk_id").alias("chunk_b")).withColumn("status", F.when(F.col("question_id") % 2 == 0, "open").otherwise("dismissed")).drop("question_id").distinct()
    return conflicts.query_conflicts(ctx, stored, conflicts.quantities(ctx.select("chunk_id", "text").distinct()))


@query("j06_newer_side", f"WITH {duck('conflicts_v', 'chunks_v', 'versions_v')} SELECT conflict_id, CAST(NULL AS BIGINT) AS newer FROM conflicts_v JOIN chunks_v a ON a.chunk_id = chunk_a JOIN chunks_v b ON b.chunk_id = chunk_b WHERE chunk_a % 3 = 0 OR chunk_b % 3 = 0")
def j06(spark, sf):
    c, chunks, v = views(spark, sf, "conflicts_v", "chunks_v", "versions_v")
    effective = chunks.join(v.select("version_id", "effective_from"), "version_id").select("chunk_id", "effective_from")
    cited = c.select(F.explode(F.array("chunk_a", "chunk_b")).alias("chunk_id")).filter("chunk_id % 3 = 0").distinct()
    return conflicts.newer_side(c, effective, cited).select("conflict_id", "newer")


@query("k04_extractive_answers")
def k04(spark, sf):
    return answers.extractive_answers(questions(spark, sf), context_rows(spark, sf), rare_terms(spark, sf))


def drafts(spark, sf):
    """A draft per question: its own text as one cited claim, and one uncited line."""
    return questions(spark, sf).select("question_id", F.concat(F.lit("- "), F.regexp_replace("question", r"[.!?]\s+", " "), F.lit(" [S1]\nPlainly uncited words here.")).alias("draft"))


@query(
    "k06_claims",
    r"""WITH d AS (SELECT item_id AS question_id, '- ' || regexp_replace(text, '[.!?]\s+', ' ', 'g') || ' [S1]' || chr(10) || 'Plainly uncited words here.' AS draft FROM benchmark),
    l AS (SELECT question_id, unnest(string_split(draft, chr(10))) AS raw FROM d), b AS (SELECT question_id, regexp_replace(raw, '^\s*(?:[-*•]|\d+[.)])\s+', '') AS body FROM l WHERE trim(raw) <> ''),
    s AS (SELECT question_id, unnest("""
    + SENTENCES.format("body")
    + r""") AS claim FROM b)
    SELECT question_id, CAST(count(*) AS INTEGER) AS n_claims, CAST(count(*) FILTER (regexp_matches(claim, '\[S\d+\]')) AS INTEGER) AS n_cited FROM s WHERE trim(claim) <> '' GROUP BY 1""",
)
def k06(spark, sf):
    made = answers.claims(drafts(spark, sf))
    return made.groupBy("question_id").agg(F.count("*").cast("int").alias("n_claims"), F.count_if(F.size("cited") > 0).cast("int").alias("n_cited"))


META = "[" + ", ".join(stem_sql(f"'{w}'") for w in W.CITATION_WORDS) + "]"
CHECKED = f"""WITH {PASSAGES}, {TERMS}, {POSTS}, {KEYWORD}, own AS (SELECT question_id, text AS body, regexp_replace(q, '[.!?]\\s+', ' ', 'g') AS q, list_filter({stems_sql('q')}, lambda w: NOT list_contains({META}, w)) AS own
        FROM (SELECT k.question_id, b.text AS q, d.text FROM kw k JOIN benchmark b ON b.item_id = k.question_id JOIN docs d USING (chunk_id) WHERE k.rank = 1)),
    judged AS (SELECT question_id, q, CASE WHEN len(own) = 0 THEN 1.0 ELSE round(len(list_intersect(own, {stems_sql("'text ' || body")})) / len(own), 4) END AS score FROM own)"""


@query(
    "k08_verified_claims",
    f"""{CHECKED} SELECT question_id, 0 AS line, 0 AS pos, score >= 0.75 AS supported, CASE WHEN score >= 0.75 THEN CAST(score AS DOUBLE) ELSE 0.0 END AS score, CASE WHEN score < 0.75 THEN 'not supported' END AS issue FROM judged
        UNION ALL SELECT item_id, 1, 0, false, 0.0, 'no citation' FROM benchmark""",
)
def k08(spark, sf):
    return answers.verify_claims(answers.claims(drafts(spark, sf)), answers.passages(context_rows(spark, sf))).select("question_id", "line", "pos", "supported", "score", "issue")


@query(
    "k10_assembled_answers",
    f"""{CHECKED} SELECT question_id, CASE WHEN score >= 0.75 THEN '- ' || regexp_replace(q, '[.!?]$', '') || ' [S1]' || regexp_extract(q, '[.!?]$') ELSE '' END AS answer, CASE WHEN score >= 0.75 THEN 'partial' ELSE 'abstained' END AS outcome,
        2 AS n_claims, CASE WHEN score >= 0.75 THEN 1 ELSE 0 END AS n_supported FROM judged""",
)
def k10(spark, sf):
    verdicts = answers.verify_claims(answers.claims(drafts(spark, sf)), answers.passages(context_rows(spark, sf)))
    return answers.assemble(verdicts).select("question_id", "answer", "outcome", "n_claims", "n_supported")


VERDICTS = """SELECT event_id % 997 AS question_id, CAST(event_id / 997 AS INT) AS line, 0 AS pos, '' AS prefix, concat('claim ', CAST(event_id AS STRING)) AS claim, event_type = 'click' OR event_type = 'view' AS supported, round(value / 1000, 3) AS score,
    concat('S', CAST(event_id % 3 + 1 AS STRING)) AS marker FROM {events}"""


@query("k12_outcomes", f"WITH v AS ({VERDICTS.format(events='events')}) SELECT question_id, CASE WHEN bool_and(supported) THEN 'answered' WHEN bool_or(supported) THEN 'partial' ELSE 'abstained' END AS outcome, count(*) AS n_claims, count(*) FILTER (supported) AS n_supported FROM v GROUP BY 1")
def k12(spark, sf):
    v = spark.sql(VERDICTS, events=table(spark, sf, "events")).withColumn("cited", F.array("marker"))
    return answers.assemble(v).select("question_id", "outcome", "n_claims", "n_supported")


@query("k12_marker_support", f"WITH v AS ({VERDICTS.format(events='events')}) SELECT question_id, marker, bool_or(supported) AS supported, round(max(score) FILTER (supported), 4) AS support FROM v GROUP BY 1, 2")
def k12b(spark, sf):
    v = spark.sql(VERDICTS, events=table(spark, sf, "events")).withColumn("cited", F.array("marker"))
    return answers.marker_support(v)


@query("a07_first_supported_claims", f"WITH v AS ({VERDICTS.format(events='events')}) SELECT question_id, marker, arg_min(claim, line) AS claim_text FROM v WHERE supported GROUP BY 1, 2")
def a07(spark, sf):
    v = spark.sql(VERDICTS, events=table(spark, sf, "events")).withColumn("cited", F.array("marker"))
    return corpus.first_supported_claims(v)


@query("m02_item_checks", "SELECT event_id AS question_id, event_type IN ('click', 'view', 'purchase') AND event_id % 5 <> 0 AS passed FROM events")
def m02(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("question_id"), "event_type")
    one = lambda s: F.array(F.lit(s))
    items = e.select("question_id", F.lit("facts").alias("category"), F.lit("answer").alias("expect"), one("A@v1#1").alias("gold"), one("B@v1#1").alias("must_not_cite"), one("six|6 h").alias("must_include"))
    outcome = F.when(F.col("event_type").isin("click", "view", "purchase"), "answered").otherwise("abstained")
    cited = F.when(F.col("question_id") % 5 == 0, F.array(F.lit("A@v1#1"), F.lit("B@v1#1"))).otherwise(one("A@v1#1"))
    responses = e.select("question_id", outcome.alias("outcome"), F.lit("answer").alias("route"), cited.alias("cited"), one("A@v1#1").alias("retrieved"), F.lit("Every SIX hours").alias("answer"))
    return evaluation.score_items(items, responses).select("question_id", "passed")


@query("f11_question_gold_overlap")
def f11(spark, sf):
    """Shared stems of each question and its gold passages."""
    both = gold(spark, sf).join(questions(spark, sf), "question_id").join(passages(spark, sf), "chunk_id")
    return both.select("question_id", "chunk_id", F.size(F.array_intersect(stemmed_words(F.col("question")), stemmed_words(F.col("text")))).alias("shared"))


@query("f11_hash_embeddings", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[a-z0-9]') THEN 1.0 ELSE 0.0 END AS norm FROM documents")
def f11b(spark, sf):
    from corvane.functions.embedding import hash_embed

    v = hash_embed(texts(spark, sf), "doc_id")
    return v.select("doc_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))), 4).alias("norm"))


@query("e15_answer_units")
def e15(spark, sf):
    """Answer units of all documents."""
    units = answers.answer_units(passages(spark, sf).withColumn("heading", F.lit("text")))
    return units.select("chunk_id", "ord", "unit", F.size("cells").alias("n_cells"), "lead")


@query("k11_quick_value_check", "SELECT event_id AS question_id, event_id % 2 = 0 OR event_id % 6 = 3 AS ok FROM events")
def k11(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("question_id"))
    k = F.col("question_id")
    values = e.select("question_id", F.lit("S1").alias("marker"), F.when(k % 2 == 0, "12 units").when(k % 6 == 3, "every 6 to 12").otherwise("9 units").alias("value"))
    known = e.select("question_id", F.lit("S1").alias("marker"), F.lit("Run at 12 units, then 6 units").alias("body"))
    return answers.quick_value_check(values, known).select("question_id", "ok")


@query("k01_passages", "SELECT event_id % 97 AS question_id, count(*) AS n, 'S' || CAST(count(*) AS VARCHAR) AS last_marker FROM events GROUP BY 1")
def k01(spark, sf):
    ctx = table(spark, sf, "events").select((F.col("event_id") % 97).alias("question_id"), F.col("event_id").alias("place"), F.lit("T").alias("title"), F.lit("H").alias("heading"), F.lit("text").alias("text"))
    return answers.passages(ctx).groupBy("question_id").agg(F.count("*").alias("n"), F.max_by("marker", "place").alias("last_marker"))


@query("f14_record_hash", "SELECT event_id, sha256(repeat('0', 64) || props) AS hash FROM events")
def f14(spark, sf):
    from corvane.functions.text import record_hash

    return table(spark, sf, "events").select("event_id", record_hash(F.lit("0" * 64), F.col("props")).alias("hash"))


@query("m01_gold_references", f"WITH {duck('chunks_v', 'versions_v', 'documents_v')} SELECT chunk_id FROM chunks_v JOIN versions_v USING (version_id) JOIN documents_v USING (document_id) WHERE doc_code || '@' || version_label || '#' || section_path IN (SELECT 'D-' || CAST(c_custkey AS VARCHAR) || '@v3#2.1' FROM customer)")
def m01_references(spark, sf):
    """Chunks that a gold reference ``code@label#section`` names."""
    c, v, d = views(spark, sf, "chunks_v", "versions_v", "documents_v")
    full = c.join(v.select("version_id", "document_id", "version_label"), "version_id").join(d.select("document_id", "doc_code"), "document_id")
    wanted = table(spark, sf, "customer").select(F.concat(F.lit("D-"), F.col("c_custkey").cast("string"), F.lit("@v3#2.1")).alias("reference")).withColumn("doc_code", evaluation.gold_reference(F.col("reference"))["doc_code"])
    hit = evaluation.matches_gold(F.col("reference"), F.col("doc_code"), F.col("version_label"), F.col("section_path"), F.array("section_path"))
    return full.join(wanted, "doc_code").filter(hit).select("chunk_id")


@query("f13_canonical_records", f"WITH {duck('audit_v')} SELECT seq, {RECORD} AS record FROM audit_v")
def f13(spark, sf):
    from corvane.operators.audit import canonical_record

    return table(spark, sf, "audit_v").select("seq", canonical_record().alias("record"))

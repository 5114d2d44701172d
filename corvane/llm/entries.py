"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import licenses, linededup, repair
from corvane.llm.chat import rotate_perspectives
from corvane.llm.decontam import contaminated
from corvane.llm.htmltext import extract_main_text
from corvane.llm.linededup import dedup_lines
from corvane.llm.maxscore import exact_top_k, integer_vectors
from corvane.llm.minhash import near_duplicates
from corvane.llm.packing import pack_documents
from corvane.llm.quality import fit_quality, score_quality
from corvane.llm.runs import find_runs
from corvane.llm.runtime import fold, read_table
from corvane.llm.tokencount import token_counts
from corvane.llm.toxicity import fit_toxicity, score_toxicity

TOXIC_AT, QUALITY_AT = 0.7, 0.3


def with_id(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``documents``."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``; fitted without the held-out third. A null id is not held out."""
    docs, labels = with_id(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, lambda doc_id: fold(doc_id, 3) != 1)
    scored = score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op3_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the five best vectors for each id divisible by 50."""
    vectors = integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


OP3_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS z FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.z, c.z) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 5
"""


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``documents``."""
    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, contaminated, item_ids, overlap) of every row of ``documents``."""
    found = contaminated(with_id(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "overlap")


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, participant, rendered, mask, n_turns, n_chars, n_masked) of every perspective of ``conversations``."""
    views = rotate_perspectives(read_table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return views.select("conv_id", "participant", "rendered", mask.alias("mask"), "n_turns", "n_chars", "n_masked")


OP6_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, replace(coalesce(nullif(lower(trim(regexp_replace(role, '[\t\n\x0B\f\r ]+', ' ', 'g'), ' ')), ''), 'unknown'), '<|', '<\|') AS speaker, replace(coalesce(text, ''), '<|', '<\|') AS body
    FROM conversations WHERE conv_id IS NOT NULL
), people AS (SELECT DISTINCT conv_id, speaker AS participant FROM turns WHERE speaker <> 'system'),
views AS (
    SELECT t.*, participant, '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head
    FROM turns t JOIN people USING (conv_id)
), parts AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS part FROM views),
placed AS (
    SELECT *, row_number() OVER o AS place, sum(length(part)) OVER (o ROWS UNBOUNDED PRECEDING) AS "end" FROM parts
    WINDOW o AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, body)
), spans AS (SELECT *, CASE WHEN speaker = participant THEN "end" - length(part) + length(head) END AS span_start FROM placed)
SELECT conv_id, participant, string_agg(part, '' ORDER BY place) AS rendered,
    coalesce(string_agg(CAST(CAST(span_start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST("end" - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY place), '') AS mask,
    count(*) AS n_turns, CAST(max("end") AS BIGINT) AS n_chars, CAST(coalesce(sum("end" - 1 - span_start), 0) AS BIGINT) AS n_masked
FROM spans GROUP BY conv_id, participant
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``documents``."""
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, license_id, notices, n_notices) of every row of ``documents``."""
    found = licenses.license_scan(with_id(read_table(spark, sf_dir, "documents")), ["doc_id"])
    return found.select("doc_id", "license_id", F.array_join("notice_ids", ",").alias("notices"), "n_notices")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``; fitted without the held-out fifth. A null id is not held out."""
    docs, labels = with_id(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "labels")
    forest = fit_quality(docs, labels, lambda doc_id: fold(doc_id, 5) != 0)
    scored = score_quality(docs, forest, ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY_AT).cast("int").alias("predicted"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id of ``conversations``, damaged as the contract says."""
    return repair.repair_query(spark, read_table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every row of ``documents``, damaged as the contract says."""
    found = find_runs(read_table(spark, sf_dir, "documents"), damage=True)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"), sha(listed).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of ``documents``."""
    left = dedup_lines(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_toxicity, op3_maxscore_top_k, op4_best_fit_packing, op5_decontamination,
        op6_chat_perspectives, op7_token_counts, op8_html_text, op9_license_scan, op10_quality, op11_conversation_repair, op12_periodic_runs, op13_line_dedup,
    )
}

ORACLE_SQL = {"op3_maxscore_top_k": OP3_SQL, "op6_chat_perspectives": OP6_SQL, "op9_license_scan": licenses.oracle_sql(), "op11_conversation_repair": repair.ORACLE_SQL, "op13_line_dedup": linededup.ORACLE_SQL}

"""Corpus preparation in five stages; each is written as Parquet and read again as the documents of the next.

Every stage takes any table with the columns of ``documents``; further columns are dropped, whatever their names. Null
and empty texts are scored, compared and packed as empty ones; they have no duplicates and no leaks. Rows without an
id are scored like others, stay in the near-duplicate stage and are packed. Rows that repeat an id are one document:
they stay or go together. An empty table gives an empty result. Very long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.decontam import contaminated
from corvane.llm.entries import QUALITY_AT, TOXIC_AT
from corvane.llm.minhash import near_duplicates
from corvane.llm.packing import pack_documents
from corvane.llm.quality import fit_quality, score_quality
from corvane.llm.runtime import fold, materialise, read_table
from corvane.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3 for quality."""
    forest = fit_quality(docs, read_table(spark, sf_dir, "labels"), lambda doc_id: fold(doc_id, 5) != 0)
    return score_quality(docs, forest, COLUMNS).filter(F.col("score") >= QUALITY_AT).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 for toxicity."""
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"), lambda doc_id: fold(doc_id, 3) != 1)
    return score_toxicity(docs, model, COLUMNS).filter(F.col("score") < TOXIC_AT).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more): the smallest doc_id.

    Documents without an id cannot be told apart by it and stay.
    """
    kept = near_duplicates(docs, percent=80, bands=31).filter("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item."""
    found = contaminated(docs, read_table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.filter(F.size("item_ids") == 0).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences of at most 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Trained and tokenised stages have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each materialised for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

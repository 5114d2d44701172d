"""Reading corpora, manifests, question sets and dictionaries; refusing duplicates; writing results."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = {"md": "markdown", "markdown": "markdown", "txt": "plain", "html": "html", "htm": "html"}  # fixed values

MANIFEST = """documents array<struct<doc_code string, title string, doc_type string, department string, owner string, applies_to_all_branches boolean, branches array<string>,
    versions array<struct<label string, file string, status string, effective_from date, review_due date>>>>,
    supersessions array<struct<source string, target string, section string, effective_from date, confirmed boolean, note string>>"""

QUESTIONS = "id string, category string, question string, user string, expect string, gold array<string>, must_include array<string>, must_not_cite array<string>, also_ok array<string>, pii array<string>, conflict boolean"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, sha256, text) of the text files under a folder; unknown suffixes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    known = files.withColumn("kind", F.try_element_at(kinds, suffix)).filter("kind is not null")
    return known.select("path", "kind", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(versions, links) of a JSON manifest; a link's source is ``code@label``, no section means the whole document."""
    raw = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    d = raw.select(F.explode("documents").alias("d")).select("d.*")
    versions = d.withColumn("v", F.explode("versions")).select("doc_code", "title", "doc_type", "department", "owner", "applies_to_all_branches", "branches", "v.*")
    s = raw.select(F.explode("supersessions").alias("s")).select("s.*")
    links = s.withColumn("source_code", F.substring_index("source", "@", 1)).withColumn("source_label", F.substring_index("source", "@", -1))
    return versions, links


def resolve_links(links: DataFrame, versions: DataFrame) -> DataFrame:
    """Links whose source version exists, joined on code and label."""
    return links.join(versions.select(F.col("doc_code").alias("source_code"), F.col("label").alias("source_label")), ["source_code", "source_label"], "left_semi")


def read_questions(spark: SparkSession, path: str, only: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A JSON Lines question set; ``only`` selects by id or category, ``limit`` takes the first ids."""
    rows = spark.read.schema(QUESTIONS).json(path)
    if only:
        rows = rows.filter(F.col("id").isin(only) | F.col("category").isin(only))
    return rows if limit is None else rows.orderBy("id").limit(limit)


def refuse_duplicates(incoming: DataFrame, stored: DataFrame, content: str = "content", key: str = "id") -> DataFrame:
    """Incoming rows with their SHA-256 whose content is not stored yet; of equal contents the smallest key stays."""
    hashed = incoming.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    first = hashed.groupBy("sha256").agg(F.min(key).alias(key))
    return hashed.join(first, ["sha256", key], "left_semi").join(stored.select("sha256"), "sha256", "left_anti")


def new_versions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Versions whose (document_id, version_label) is not stored yet."""
    return incoming.join(stored.select("document_id", "version_label"), ["document_id", "version_label"], "left_anti")


def rewrite_chunks(chunks: DataFrame, path: str, scratch: str, buckets: int = 256) -> None:
    """Replace all chunks of the versions at hand in a table of hash buckets of version_id.

    Only the buckets that the versions fall in are read and written again (a dynamic partition overwrite), by
    way of a table in the shared ``scratch`` folder, so that a lost executor or a second run changes nothing.
    """
    spark = chunks.sparkSession
    keyed = chunks.withColumn("bucket", F.pmod(F.xxhash64("version_id"), F.lit(buckets)).cast("int"))
    merged = keyed
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        same = stored.select(*keyed.columns).join(keyed.select("bucket").distinct(), "bucket", "left_semi").join(keyed.select("version_id").distinct(), "version_id", "left_anti")
        merged = keyed.unionByName(same)
    at = f"{scratch.rstrip('/')}/rewrite-{uuid.uuid4().hex}"
    merged.write.parquet(at)
    spark.read.parquet(at).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def first_supported_claims(verdicts: DataFrame) -> DataFrame:
    """(question_id, marker, claim_text): the first supported claim that cites each marker."""
    each = verdicts.filter("supported").select("question_id", F.explode("cited").alias("marker"), "line", "pos", "claim")
    return each.groupBy("question_id", "marker").agg(F.min_by("claim", F.struct("line", "pos")).alias("claim_text"))


def write_log(rows: DataFrame, path: str) -> None:
    """Append log rows by the day they were made."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def write_report(items: DataFrame, summary: DataFrame, path: str) -> None:
    """An evaluation report: items and one summary row as JSON."""
    items.write.mode("overwrite").json(f"{path}/items")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def latest_rows(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter("place = 1").drop("place")

"""Text-function queries over whole texts of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.functions import words as W
from corvane.plans.registry import query
from corvane.sources.views import table

STOP = "[" + ", ".join(f"'{w}'" for w in W.STOPWORDS) + "]"


def words_sql(c: str) -> str:
    return f"list_filter(list_distinct(list_transform(regexp_extract_all(coalesce({c}, ''), '[a-zA-Z][a-zA-Z0-9-]*'), lambda w: lower(w))), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))"


def stem_sql(w: str) -> str:
    cut = "CASE " + " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) - {len(s)} >= 3 THEN left({w}, length({w}) - {len(s)})" for s in W.SUFFIXES) + f" ELSE {w} END"
    return f"(CASE WHEN ends_with({cut}, 'e') AND length({cut}) >= 5 THEN left({cut}, length({cut}) - 1) ELSE {cut} END)"


def stems_sql(c: str) -> str:
    return f"list_distinct(list_transform({words_sql(c)}, lambda w: {stem_sql('w')}))"


def joined(words):
    return F.array_join(F.array_sort(words), " ")


@query("f01_content_words", f"SELECT doc_id, array_to_string(list_sort({words_sql('text')}), ' ') AS words FROM documents")
def f01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", joined(t.content_words(F.col("text"))).alias("words"))


@query("f02_stems", f"SELECT word, {stem_sql('word')} AS stem FROM (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM documents)")
def f02(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(t.content_words(F.col("text"))).alias("word")).distinct()
    return words.select("word", t.stem(F.col("word")).alias("stem"))


@query("f03_stemmed_words", f"SELECT doc_id, CAST(len({stems_sql('text')}) AS INTEGER) AS n_stems FROM documents")
def f03(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(t.stemmed_words(F.col("text"))).alias("n_stems"))


AMOUNT = "concat('ext. ', CAST(l_extendedprice AS STRING), ' at 1,250.50 [S2], 3.10 and ', CAST(l_linenumber AS STRING))"


@query(
    "f04_numbers",
    """SELECT l_returnflag, CAST(count(DISTINCT n) AS BIGINT) AS n_numbers FROM (SELECT l_returnflag, unnest([CASE WHEN contains(CAST(l_quantity AS VARCHAR), '.') THEN regexp_replace(regexp_replace(CAST(l_quantity AS VARCHAR), '0+$', ''), '\\.$', '') ELSE CAST(l_quantity AS VARCHAR) END, '1250.5', '3.1', CAST(l_linenumber AS VARCHAR)]) AS n FROM lineitem) GROUP BY 1""",
)
def f04(spark, sf):
    text = F.concat(F.lit("of "), F.col("l_quantity").cast("string"), F.lit(" at 1,250.50 [S2], 3.10 and "), F.col("l_linenumber").cast("string"))
    found = table(spark, sf, "lineitem").select("l_returnflag", F.explode(t.numbers(text)).alias("n"))
    return found.groupBy("l_returnflag").agg(F.countDistinct("n").alias("n_numbers"))


UNIT_CASES = "CASE event_id % 6 WHEN 0 THEN 'Hours' WHEN 1 THEN 'IU' WHEN 2 THEN 'ml / hr' WHEN 3 THEN 'mg' WHEN 4 THEN 'Units/kg/Hour' ELSE NULL END"
UNIT_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in W.UNIT_ALIASES.items()) + "}"


@query("f06_normal_units", f"SELECT event_id, coalesce({UNIT_MAP}[u], u) AS unit FROM (SELECT event_id, replace(lower(coalesce({UNIT_CASES}, '')), ' ', '') AS u FROM events)")
def f06(spark, sf):
    return table(spark, sf, "events").select("event_id", t.normal_unit(F.expr(UNIT_CASES)).alias("unit"))


@query("f07_markers", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'S1' ELSE 'S' || CAST(event_id % 4 AS VARCHAR) || ' S9' END AS markers FROM events")
def f07(spark, sf):
    k = (F.col("event_id") % 4).cast("string")
    text = F.when(k == "0", F.lit("One [S1]. Two [S1].")).otherwise(F.concat(F.lit("A claim [S"), k, F.lit(", S9] and [S"), k, F.lit("].")))
    return table(spark, sf, "events").select("event_id", F.array_join(t.markers(text), " ").alias("markers"))


@query("f09_or_query", "SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[0-9]+)?')), lambda w: length(w) > 1 OR regexp_matches(w, '^[0-9]$'))), ' ') AS terms FROM benchmark")
def f09(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(F.split(t.or_query(F.col("text")), " or ")), " ").alias("terms"))


@query("f10_embedding_tokens", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+(?:[./-][a-z0-9]+)*')) AS INTEGER) AS n_tokens FROM documents")
def f10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(t.embedding_tokens(F.col("text"))).alias("n_tokens"))


@query("f12_normal_fact", "SELECT event_id, trim(regexp_replace(lower('Dose ' || CAST(event_id * 1000 AS VARCHAR) || ' - 5  UNITS'), '\\s+', ' ', 'g')) AS fact, event_id % 2 = 0 AS found FROM events")
def f12(spark, sf):
    raw = F.concat(F.lit("Dose "), (F.col("event_id") * 1000).cast("string"), F.lit(" – 5  UNITS"))
    fact = F.when(F.col("event_id") % 2 == 0, F.lit("7 units|- 5 Units")).otherwise(F.lit("nine|ten"))
    return table(spark, sf, "events").select("event_id", t.normal_fact(raw).alias("fact"), t.has_fact(raw, fact).alias("found"))


@query("f15_json_access", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def f15(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))


def scrub_sql(c: str) -> str:
    """The scrubber without look-around: the digits' neighbours are taken and put back, twice, since neighbours may share one."""
    for pattern, mark in W.SCRUB:
        core = pattern.removeprefix(r"(?<!\d)").removesuffix(r"(?!\d)").replace("'", "''")
        if core == pattern:
            c = f"regexp_replace({c}, '{core}', '{mark}', 'g')"
        else:
            once = lambda x: rf"regexp_replace({x}, '(^|[^0-9])(?:{core})($|[^0-9])', '\1{mark}\2', 'g')"  # noqa: B023, E731
            c = once(once(c))
    return c


@query("f16_scrub", f"SELECT doc_id, {scrub_sql('text')} AS scrubbed FROM documents")
def f16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.scrub(F.col("text")).alias("scrubbed"))


@query("f17_snippet", "SELECT doc_id, CASE WHEN length(s) <= 320 THEN s ELSE regexp_replace(left(s, 320), ' [^ ]*$', '') || '…' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)")
def f17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.snippet(F.col("text")).alias("snippet"))


HEADINGS = "CASE o_orderkey % 5 WHEN 0 THEN concat('Section ', CAST(o_orderkey % 9 AS STRING), '.', CAST(o_custkey % 4 AS STRING), ' Scope') WHEN 1 THEN 'Appendix B — Forms' WHEN 2 THEN 'A.1 Checklist' WHEN 3 THEN 'C. Contacts' ELSE 'Background' END"


@query(
    "e05_heading_number",
    "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey % 9 AS VARCHAR) || '.' || CAST(o_custkey % 4 AS VARCHAR) WHEN 1 THEN 'B' WHEN 2 THEN 'A.1' WHEN 3 THEN 'C' END AS number, ['Scope', 'Forms', 'Checklist', 'Contacts', 'Background'][o_orderkey % 5 + 1] AS title FROM orders",
)
def e05(spark, sf):
    h = t.heading_number(F.expr(HEADINGS))
    return table(spark, sf, "orders").select("o_orderkey", h["number"].alias("number"), h["title"].alias("title"))


@query("e07_token_count", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+|[^\\p{L}\\p{N}\\p{M}_\\s]')) AS INTEGER) AS n_tokens FROM documents")
def e07(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.token_count(F.col("text")).alias("n_tokens"))


@query("e11_parent_path", "SELECT path, CASE WHEN contains(base, '.') THEN regexp_replace(base, '\\.[^.]*$', '') ELSE '' END AS parent FROM (SELECT path, split_part(split_part(path, '#', 1), '-', 1) AS base FROM (SELECT CAST(l_linenumber AS VARCHAR) || '.' || CAST(l_partkey % 5 AS VARCHAR) || CASE l_suppkey % 3 WHEN 0 THEN '#2' WHEN 1 THEN '-4.9' ELSE '' END AS path FROM lineitem))")
def e11(spark, sf):
    tail = F.when(F.col("l_suppkey") % 3 == 0, "#2").when(F.col("l_suppkey") % 3 == 1, "-4.9").otherwise("")
    path = F.concat(F.col("l_linenumber").cast("string"), F.lit("."), (F.col("l_partkey") % 5).cast("string"), tail)
    return table(spark, sf, "lineitem").select(path.alias("path")).select("path", t.parent_path(F.col("path")).alias("parent"))


@query("c02_loose_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def c02(spark, sf):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.lower(F.date_format("o_orderdate", "d MMMM yyyy"))).otherwise(F.date_format("o_orderdate", "MM/yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", t.loose_date(raw).alias("day"))


@query("f08_expand_queries", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ICU dose of IV fluid (intensive care unit; intravenous)' WHEN 1 THEN 'aptt and activated partial thromboplastin time' ELSE 'icu IV-line' END AS expanded FROM events")
def f08(spark, sf):
    q = F.when(F.col("event_id") % 3 == 0, "ICU dose of IV fluid").when(F.col("event_id") % 3 == 1, "aptt and activated partial thromboplastin time").otherwise("icu IV-line")
    return t.expand_queries(table(spark, sf, "events").select("event_id", q.alias("question")), "event_id").select("event_id", "expanded")

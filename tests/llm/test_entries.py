"""Every registered query of the ten operators on given tables; its SQL where there is one."""

import datetime
import decimal

import duckdb
import pytest

from corvane.llm import entries

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, decimal.Decimal | float):
        return round(float(value), 6)
    return value.isoformat() if isinstance(value, datetime.date) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = db.execute(entries.ORACLE_SQL[name])
    got = entries.QUERIES[name](spark, DIR)
    assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize(("name", "table"), [(n, "pages" if "op8" in n else "documents") for n in sorted(set(entries.QUERIES) - set(entries.ORACLE_SQL))])
def test_covers_its_whole_table(spark, name, table):
    key = "page_id" if table == "pages" else "doc_id"
    got = entries.QUERIES[name](spark, DIR).select(key).distinct()
    assert got.count() == spark.read.parquet(f"{DIR}/{table}.parquet").select(key).distinct().count()

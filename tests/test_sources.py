"""Reading corpora, manifests and question sets; writing chunks, logs and reports."""

import json

from pyspark.sql import functions as F

from corvane.functions.embedding import hash_embed
from corvane.operators import analytics
from corvane.sources import corpus


def test_read_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.MD").write_text("# Título")
    (tmp_path / "sub/b.html").write_text("<p>x</p>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.text, len(r.sha256)) for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.MD": ("markdown", "# Título", 64), "b.html": ("html", "<p>x</p>", 64)}


def test_manifest_and_questions(spark, tmp_path):
    version = {"label": "v1", "file": "a.md", "status": "approved", "effective_from": "2026-01-01"}
    manifest = {
        "documents": [{"doc_code": "P-1", "title": "T", "versions": [version, version | {"label": "v2"}]}],
        "supersessions": [{"source": "P-1@v2", "target": "P-9", "effective_from": "2026-02-01", "confirmed": True}, {"source": "P-1@v7", "target": "P-9", "section": "4"}],
    }
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    versions, links = corpus.read_manifest(spark, str(tmp_path / "m.json"))
    assert {(r.doc_code, r.label) for r in versions.collect()} == {("P-1", "v1"), ("P-1", "v2")}
    good = corpus.resolve_links(links, versions).collect()
    assert [(r.source_code, r.source_label, r.section) for r in good] == [("P-1", "v2", None)]
    rows = [{"id": f"q{k}", "category": "a" if k % 2 else "b", "question": "?", "expect": "answer"} for k in range(6)]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, rows)))
    read = lambda **k: [r.id for r in corpus.read_questions(spark, str(tmp_path / "q.jsonl"), **k).orderBy("id").collect()]
    assert read(only=["a", "q0"]) == ["q0", "q1", "q3", "q5"] and read(limit=2) == ["q0", "q1"]


def test_rewriting_chunks_is_idempotent(spark, tmp_path):
    path, scratch = str(tmp_path / "chunks"), str(tmp_path / "scratch")
    chunks = lambda v, n: spark.range(n).select(F.lit(v).cast("long").alias("version_id"), F.col("id").alias("ordinal"))
    corpus.rewrite_chunks(chunks(1, 5).unionByName(chunks(2, 3)), path, scratch, 2)
    for _ in range(2):
        corpus.rewrite_chunks(chunks(2, 4), path, scratch, 2)
        assert {r.version_id: r.n for r in spark.read.parquet(path).groupBy("version_id").agg(F.count("*").alias("n")).collect()} == {1: 5, 2: 4}


def test_logs_and_reports(spark, tmp_path):
    logs = spark.createDataFrame([(1, "2026-01-01 10:00:00"), (2, "2026-01-02 10:00:00")], "query_id long, at string").select("query_id", F.to_timestamp("at").alias("created_at"))
    corpus.write_log(logs, str(tmp_path / "log"))
    corpus.write_log(logs, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).filter("day = '2026-01-02'").count() == 2
    corpus.write_report(logs, logs.limit(1), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/items")).count() == 2 and spark.read.json(str(tmp_path / "report/summary")).count() == 1
    assert [r.query_id for r in analytics.in_window(logs, "2026-01-02", "2026-01-02").collect()] == [2]


def test_hash_embedding(spark):
    got = {r.doc_id: r.embedding for r in hash_embed(spark.createDataFrame([(1, "Heparin 4.2 rate"), (2, "heparin 4.2 RATE!"), (3, None)], "doc_id long, text string"), "doc_id", dim=32).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and set(got[3]) == {0.0}

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from corvane.llm.linededup import LineRuns, dedup_lines, digest, without_case

BLANKS = " \t\n\x0b\f\r"
SCHEMA = "doc_id long, text string"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANKS))


def by_hand(rows, enough=3, least=20):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key_of(line)) >= least:
                holders[key_of(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key_of(x)]) < enough or doc_id == max(holders[key_of(x)])]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def run(spark, rows, **how):
    return sorted(map(tuple, dedup_lines(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=repr)


def test_random_texts_of_few_lines(spark):
    rng = random.Random(5)
    lines = [f"{w} the line that several documents may hold" for w in ("One", "TWO", " three", "Fünf\t", "ÄÖ")] + ["", "short", "x" * 19, "é" * 20, " " * 30, "Ü" * 20]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "", "\n".join(rng.choices(lines, k=rng.randrange(1, 9)))])) for _ in range(80)]
    rows += rows[:6]
    for batches, fan in ((1, 2), (5, 2), (4, 3)):
        assert run(spark, rows, batches=batches, fan=fan) == by_hand(rows)


def test_edges_of_texts_and_keys(spark):
    a, b = "a line of twenty characters or more", "B" * 20
    rows = [(1, a), (2, f"\t{a.upper()} \r\n"), (3, f"{a}\nend\n{a}"), (1, a), (None, a), (4, b), (4, b), (4, b), (5, b), (6, "x" * 19), (7, "x" * 19), (8, "x" * 19), (9, ""), (10, None), (11, "\n\n")]
    assert run(spark, rows) == by_hand(rows)
    got = {r[0]: r for r in run(spark, rows) if r[0] in (2, 3, 5, 11)}
    assert got[2] == (2, "", 2, 1) and got[3] == (3, f"{a}\nend\n{a}", 3, 0) and got[5] == (5, b, 1, 0) and got[11] == (11, "\n\n", 3, 0)


def test_long_text_empty_table_and_clashing_columns(spark):
    shared = [f"shared line number {k} of the long text" for k in range(4000)]
    rows = [(k, "\n".join(shared[:: k + 1] + [f"own line of document {k}, long enough"])) for k in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("hash", "last", "place", "places", "version", "n", "cut_id")])
    assert sorted(map(tuple, dedup_lines(docs).collect()), key=repr) == by_hand(rows)
    assert run(spark, []) == []


def test_runs_are_merged_by_level_and_leave_out_what_is_settled(spark):
    runs = LineRuns(spark, enough=3, fan=3)
    batch = lambda *rows: spark.createDataFrame([(d, h.encode()) for d, h in rows], "doc_id long, hash binary")
    runs.add(batch((30, "a"), (31, "a"), (32, "a"), (30, "b")))
    runs.add(batch((20, "a"), (21, "a"), (20, "b")))
    assert [len(x) for x in runs.levels] == [2]
    assert [bytes(r.hash) for r in runs.levels[0][1].collect()] == [b"b"]  # "a" was settled by larger ids
    runs.add(batch((40, "a"), (10, "b"), (None, "c")))
    assert [len(x) for x in runs.levels] == [0, 1]
    assert {(bytes(r.hash), r.last) for r in runs.settled().collect()} == {(b"a", 40), (b"b", 30)}
    plan = runs.runs()[0]._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan or "Bucketed" in plan
    runs.close()


def test_native_plan(spark):
    plan = dedup_lines(spark.createDataFrame([(1, "x")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert len(spark.range(1).select(digest(F.lit("x")).alias("d")).first().d) == 16


def test_folding_keeps_unlike_characters_apart(spark):
    characters = [chr(c) for c in (*range(32, 0x600), *range(0x1E00, 0x2100), 0x10400, 0x10428, 0x1F600) if not 0xD800 <= c < 0xE000]
    pairs = [x + y for x in characters[::7] for y in "Aa\u00c9\u00e9"] + characters
    got = {r.t: r.k for r in spark.createDataFrame([(p,) for p in pairs], "t string").select("t", without_case(F.col("t")).alias("k")).collect()}
    plain = {t: re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in got}
    assert len(set(got.values())) == len(set(plain.values())) and len({(got[t], plain[t]) for t in got}) == len(set(plain.values()))

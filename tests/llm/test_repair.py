import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from corvane.llm import repair
from corvane.llm.repair import BLOCK, conversation_digests, damaged, repair_conversations, repair_kinds, repair_query

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"


def faults_of(rows):
    """(role, text, fault) of sorted rows, by the wording of the contract."""
    seen, out = set(), []
    for _, role, text in rows:
        last = text.strip(SPACE)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def by_hand(rows):
    """(cost, audit, lines) from a table of the best (cost, audit, lines) for every word of initials read so far, cut to its state."""
    state_of = lambda word: None if word and not re.fullmatch("s?(ua)*u?", word) else (min(len(word), 1), word[-1:])
    best = {"": (0, "", ())}  # by a shortest word of the state

    def closure(table):
        out = dict(table)
        for _ in range(4):
            for word, (cost, audit, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    offer(out, word + role[0], (cost + 2, audit + "I", (*lines, f"{role}:")))
        return out

    def offer(table, word, value):
        if state_of(word) is None:
            return
        word = {"": "", "s": "s", "u": "u", "a": "ua"}[word[-1:]]
        if word not in table or value[:2] < table[word][:2]:
            table[word] = value

    for role, text, fault in faults_of(rows):
        out = {}
        for word, (cost, audit, lines) in closure(best).items():
            offer(out, word, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            offer(out, word + (role[:1] or "-"), (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            for new in ("user", "assistant"):
                offer(out, word + new[0], (cost + 2 + more, audit + "R", (*lines, f"{new}:{text}")))
        best = out
    return min(v for k, v in closure(best).items() if k in ("", "ua"))


def report_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults = [f for _, _, f in faults_of(rows)]
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, lines = by_hand(rows)
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_division_is_audit_least():
    rng = random.Random(1)
    names = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    for _ in range(600):
        kinds = [rng.choice([8, *range(8)]) for _ in range(rng.randrange(1, 12))]
        rows = [(k, names[kind & 3] if kind != 8 else "user", "" if kind == 8 else f"text {k}" + ("." if kind < 4 else "")) for k, kind in enumerate(kinds)]
        assert repair_kinds(bytes(kinds)) == by_hand(rows)[:2], kinds


def run(spark, rows, schema=SCHEMA):
    done = repair_conversations(spark.createDataFrame(rows, schema))
    digests = {r.conv_id: r.sha256 for r in conversation_digests(done.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.conv_id, empty)) for r in done.report.collect()}


def test_odd_conversations(spark):
    rng = random.Random(2)
    roles = ["system", "user", "assistant", "tool", "", "User", "student"]
    texts = ["Fine.", "Fine", "what?", "", " \t\n", "é!", "é", "Ok!  \n", "a.\x0b"]
    rows = [(rng.choice([None, *range(25)]), rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(220)]
    want = {}
    for conv_id in {r[0] for r in rows}:
        want[conv_id] = report_by_hand([r[1:] for r in rows if r[0] == conv_id])
    assert run(spark, rows) == want
    assert run(spark, []) == {}
    nulls = run(spark, [(1, 0, None, None), (1, None, None, "x."), (1, 1, "user", None)])
    assert nulls[1] == report_by_hand([(0, "", ""), (None, "", "x."), (1, "user", "")])


def test_one_conversation_over_many_blocks_and_partitions(spark):
    rng = random.Random(3)
    n = 3 * BLOCK
    rows = [(1, k // 2, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["", "same.", f"text {k}.", f"cut {k}"])) for k in range(n)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")] + [(3, 5, "user", "same row.")] * (2 * BLOCK)
    got = run(spark, rows)
    for conv_id in (1, 2, 3):
        assert got[conv_id] == report_by_hand([r[1:] for r in rows if r[0] == conv_id]), conv_id


def test_clashing_columns_and_real_turns(spark):
    rows = [(7, 0, "user", "Hi"), (7, 2, "user", "Yes."), (7, 3, "tool", "42."), (7, 9, "user", "Bye.")]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("at", "kind", "same", "seen", "tie", "nth", "edit", "begin")])
    done = repair_conversations(docs)
    turns = [(r.edit, r.turn, r.role, r.text) for r in done.turns.orderBy("at", "nth").collect()]
    report = done.report.first()
    assert (report.cost, report.audit) == by_hand([r[1:] for r in rows])[:2]
    assert "".join(t[0] for t in turns) == report.audit.replace("D", "")
    assert re.fullmatch("s?(ua)+", "".join(t[2][0] for t in turns))


def test_query_with_nulls_equals_sql(spark):
    rng = random.Random(4)
    roles, texts = [None, "system", "user", "assistant", "tool"], [None, "", "Well. Yes!", "no", "a?b", "wait..."]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for _ in range(300)]
    table = spark.createDataFrame(rows, SCHEMA)
    db = duckdb.connect()
    db.register("conversations", table.toArrow())
    want = db.execute(repair.ORACLE_SQL)
    names = [d[0] for d in want.description]
    got = repair_query(spark, table).select(*names)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
    assert damaged(table.limit(0)).count() == 0 and repair_query(spark, table.limit(0)).count() == 0

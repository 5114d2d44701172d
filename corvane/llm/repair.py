"""Cheapest repair of conversations to alternating turns, by Hirschberg's division on four-state cost vectors.

Role initials of a repaired conversation spell ``(s?(ua)+)?``. The four states of a reader of such a word: nothing
read, ``s`` read, ``u`` read, ``a`` read; the first and the last may end it. Which role an inserted or re-roled turn
takes follows from the state, so a list of edits, written by initials, fixes the whole repair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.runtime import drop_materialised, materialise

START, S, U, A = range(4)
STATES = (START, S, U, A)
ENDS = (START, A)
#: The state after the next role, and the user or assistant turn that a state asks for.
AFTER = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
ASKED = {START: U, S: U, U: A, A: U}
ROLE = {U: "user", A: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NONE = 1 << 60
#: Rows of a conversation that are one block of the division across tasks.
BLOCK = 4096
#: A kind of row in one byte: its initial's place here and 4 if truncated; DROP must be deleted.
INITIALS, DROP = "sua", 8


@cache
def insertions(state: int) -> tuple[tuple[int, str], ...]:
    """(state, letters) after no insertion, one, two: more come back to a state that fewer reach."""
    out, letters = [(state, "")], ""
    while (state := ASKED[state]) not in [s for s, _ in out]:
        letters += "I"
        out.append((state, letters))
    return tuple(out)


@cache
def steps(kind: int) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """[from][to]: the cost and the letters, inserts and then the row's own, of the best way past one row."""
    best: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in STATES]

    def offer(here: int, there: int, cost: int, letters: str) -> None:
        if best[here][there] is None or (cost, letters) < best[here][there]:
            best[here][there] = (cost, letters)

    extra = TRUNCATED if kind != DROP and kind & 4 else 0
    for here in STATES:
        for state, inserted in insertions(here):
            cost = INSERT * len(inserted)
            offer(here, state, cost + DELETE, inserted + "D")
            if kind == DROP:
                continue
            initial = (INITIALS + "?")[kind & 3]
            if (state, initial) in AFTER:
                offer(here, AFTER[state, initial], cost + extra, inserted + "K")
            offer(here, ASKED[state], cost + REROLE + extra, inserted + "R")
    return tuple(map(tuple, best))


@cache
def step_matrix(kind: int) -> tuple[tuple[tuple[int, int], ...], ...]:
    """[from][to]: cost and the place of the letters among those of the same ``from``."""
    out = []
    for row in steps(kind):
        order = sorted(x[1] for x in row if x)
        out.append(tuple((x[0], order.index(x[1])) if x else (NONE, 0) for x in row))
    return tuple(out)


def forward(vector, matrix):
    """Costs and ranks of the four states after a step; ``vector`` has a pair for each state.

    Of two ways of one cost the one with the ASCII-least letters counts. Letters of ways that end in a row's own
    edit are no prefixes of each other, and unlike states have unlike letters; so ways are compared by the rank of
    the state they came through, then by the rank within the step. Ranks are places among four: no letters are kept.
    """
    ways = []
    for there in STATES:
        best = min((vector[k][0] + matrix[k][there][0], vector[k][1], matrix[k][there][1]) for k in STATES)
        ways.append(best)
    order = sorted(w[1:] for w in ways if w[0] < NONE)
    return tuple((w[0], order.index(w[1:])) if w[0] < NONE else (NONE, 0) for w in ways)


def backward(costs, matrix):
    """Least cost from each state over a step and on to the end; ``costs`` are those after it."""
    return tuple(min(min(matrix[k][there][0] + costs[there] for there in STATES), NONE) for k in STATES)


def unit(state: int):
    return tuple((0 if k == state else NONE, 0) for k in STATES)


def block_matrix(kinds: bytes):
    """[from][to]: cost and rank of the best way past all rows of a block: vectors from all four states at once."""
    rows = [unit(s) for s in STATES]
    for kind in kinds:
        rows = [forward(r, step_matrix(kind)) for r in rows]
    return tuple(rows)


def crossing(matrices, cut: int, lo: int, hi: int, first: int, last: list[int]) -> int:
    """The state at ``cut`` of the audit-least cheapest way over ``matrices[lo:hi]``: both vectors meet there."""
    ahead = unit(first)
    for k in range(lo, cut):
        ahead = forward(ahead, matrices(k))
    behind = tuple(last)
    for k in range(hi - 1, cut - 1, -1):
        behind = backward(behind, matrices(k))
    return min(STATES, key=lambda s: (ahead[s][0] + behind[s], ahead[s][1]))


def divide(matrices, n: int, first: int, last: list[int]) -> list[int]:
    """States before, between and after the ``n`` steps of the audit-least cheapest way, in linear space.

    ``last`` are the costs of ending in each state. The middle state is settled by :func:`crossing`, then both
    halves on their own; a settled state has cost 0 and the others cannot be reached.
    """
    states = [first] * (n + 1)
    states[n] = crossing(matrices, n, 0, n, first, last)
    open_ = [(0, n)]
    while open_:
        lo, hi = open_.pop()
        if hi - lo < 2:
            continue
        cut = (lo + hi) // 2
        states[cut] = crossing(matrices, cut, lo, hi, states[lo], [0 if s == states[hi] else NONE for s in STATES])
        open_ += [(lo, cut), (cut, hi)]
    return states


#: Costs and letters of what may be inserted after the last row.
CLOSING = tuple(min(((INSERT * len(w), w) for s, w in insertions(k) if s in ENDS), default=(NONE, "")) for k in STATES)


def edits(kinds: bytes, first: int, last: int) -> list[tuple[str, int]]:
    """For each row of a block the inserts before it with its own edit, as letters, and the state before them."""
    states = divide(lambda k: step_matrix(kinds[k]), len(kinds), first, [0 if s == last else NONE for s in STATES])
    return [(steps(kind)[a][b][1], a) for kind, a, b in zip(kinds, states, states[1:], strict=False)]


def repair_kinds(kinds: bytes) -> tuple[int, str]:
    """(cost, audit) of one conversation by the same division, for use outside of tables."""
    ahead = unit(START)
    for kind in kinds:
        ahead = forward(ahead, step_matrix(kind))
    last = [c for c, _ in CLOSING]
    end = min(STATES, key=lambda s: (ahead[s][0] + last[s], ahead[s][1]))
    return ahead[end][0] + last[end], "".join(w for w, _ in edits(kinds, START, end)) + CLOSING[end][1]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` as the contract of the query damages them, chosen by crc32 of ``conv_id:turn``; nulls count as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), how.alias("how")).filter("how <> 0")
    text = F.when(F.col("how") == 1, F.lit("")).when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


class Repaired:
    """``turns``: the repaired conversations; ``report``: one row a conversation."""

    def __init__(self, turns: DataFrame, report: DataFrame) -> None:
        self.turns, self.report = turns, report


_PIECE = "conv_id long, begin long, kinds binary, opens string, closes string, illegal long, n_blank long, n_again long, n_truncated long, costs array<long>, ranks array<int>"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one conversation and block, from sorted rows, as pieces with their matrices.

    State is carried over batches, so a block may span them; at most ``BLOCK`` rows of one byte are held.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("begin", pa.int64()), ("kinds", pa.binary()), ("opens", pa.string()), ("closes", pa.string()), ("illegal", pa.int64()), ("n_blank", pa.int64()), ("n_again", pa.int64()), ("n_truncated", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))])
    key, piece = None, {}

    def closed(p: dict) -> dict:
        matrix = block_matrix(bytes(p["kinds"]))
        return p | {"kinds": bytes(p["kinds"]), "costs": [c for row in matrix for c, _ in row], "ranks": [r for row in matrix for _, r in row]}

    for batch in batches:
        out = []
        for at, conv_id, kind, blank, again, initial in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (at // BLOCK, conv_id) != key:
                if key is not None:
                    out.append(closed(piece))
                key = (at // BLOCK, conv_id)
                piece = {"conv_id": conv_id, "begin": at, "kinds": bytearray(), "opens": initial, "illegal": 0, "n_blank": 0, "n_again": 0, "n_truncated": 0}
            else:
                piece["illegal"] += piece["closes"] + initial not in ("su", "ua", "au")
            piece["closes"] = initial
            piece["kinds"].append(DROP if blank or again else kind)
            piece["n_blank"] += blank
            piece["n_again"] += again and not blank
            piece["n_truncated"] += not blank and not again and kind & 4 > 0
        yield pa.RecordBatch.from_pylist(out, schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([closed(piece)], schema)


_CHAINED = "conv_id long, begin long, kinds binary, first int, last int, closing string, cost long, illegal long"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states before and after every piece: the division over a conversation's pieces, by their matrices.

    Pieces come sorted by conversation and place. A piece is a block of rows, so what is held of a conversation is
    a byte a row and a matrix for thousands of rows. A conversation's cost and illegal pairs go with its first piece.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("begin", pa.int64()), ("kinds", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("closing", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])
    held: list[dict] = []

    def solved() -> list[dict]:
        matrices = [tuple(tuple(zip(p["costs"][4 * k : 4 * k + 4], p["ranks"][4 * k : 4 * k + 4], strict=True)) for k in STATES) for p in held]
        states = divide(matrices.__getitem__, len(held), START, [c for c, _ in CLOSING])
        cost = sum(m[a][b][0] for m, a, b in zip(matrices, states, states[1:], strict=False)) + CLOSING[states[-1]][0]
        illegal = sum(p["illegal"] for p in held) + sum(a["closes"] + b["opens"] not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
        return [
            {"conv_id": p["conv_id"], "begin": p["begin"], "kinds": p["kinds"], "first": states[k], "last": states[k + 1], "closing": CLOSING[states[-1]][1] if k == len(held) - 1 else "", "cost": 0 if k else cost, "illegal": 0 if k else illegal}
            for k, p in enumerate(held)
        ]

    for batch in batches:
        out: list[dict] = []
        for p in batch.to_pylist():
            if held and held[0]["conv_id"] != p["conv_id"]:
                out += solved()
                held = []
            held.append(p)
        yield pa.RecordBatch.from_pylist(out, schema)
    if held:
        yield pa.RecordBatch.from_pylist(solved(), schema)


_LETTERS = "conv_id long, begin long, audit string, cost long, illegal long, edits array<struct<at:long,letters:string,state:int,role:string>>"


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of every row of every piece."""
    edit = pa.struct([("at", pa.int64()), ("letters", pa.string()), ("state", pa.int32()), ("role", pa.string())])
    schema = pa.schema([("conv_id", pa.int64()), ("begin", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("edits", pa.list_(edit))])
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            rows = []
            done = edits(p["kinds"], p["first"], p["last"])
            for k, (letters, state) in enumerate(done):
                closing = p["closing"] if k == len(done) - 1 else ""
                role = None
                if letters.endswith("R"):
                    role = ROLE[ASKED[insertions(state)[len(letters) - 1][0]]]
                rows.append({"at": p["begin"] + k, "letters": letters + closing, "state": state, "role": role})
            out.append({"conv_id": p["conv_id"], "begin": p["begin"], "audit": "".join(r["letters"] for r in rows), "cost": p["cost"], "illegal": p["illegal"], "edits": rows})
        yield pa.RecordBatch.from_pylist(out, schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that each row leaves, inserted ones included."""
    schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("nth", pa.int32()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            state = r["state"]
            for nth, letter in enumerate(r["letters"]):
                turn = {"conv_id": r["conv_id"], "at": r["at"], "nth": nth, "edit": letter}
                if letter == "I":
                    state = ASKED[state]
                    out.append(turn | {"turn": None, "role": ROLE[state], "text": ""})
                elif letter != "D":
                    role = r["new_role"] or r["role"]
                    state = AFTER[state, role[:1]]
                    out.append(turn | {"turn": r["turn"], "role": role, "text": r["text"]})
        yield pa.RecordBatch.from_pylist(out, schema)


_TURNS = "conv_id long, at long, nth int, edit string, turn long, role string, text string"


def repair_conversations(conversations: DataFrame) -> Repaired:
    """``conversations(conv_id, turn, role, text)`` -> :class:`Repaired`, by the cheapest edits, of equal ones the ASCII-least.

    Rows of a conversation are in the order of turn (nulls first), role and text. A row's first fault counts: blank
    (nothing but 0x20 and 0x09-0x0D), duplicate (role and text seen earlier), truncated (the last other character is
    none of ``.!?``). Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert of an empty user or assistant
    turn 2; blank and duplicate rows must be deleted, a truncated row that stays adds 1.

    ``turns``: (conv_id, at, nth, edit, turn, role, text), which (at, nth) puts in order. ``report``:
    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation that has rows.

    Rows are range-partitioned and sorted once and written, so a conversation may span many partitions and blocks.
    Duplicates are found by a grouped minimum of places. Each block becomes a matrix of costs and ranks from any of
    the four states to any other; the division runs over the blocks of a conversation, then over the rows of each
    block on its own. Of one conversation a byte a row meets in one task, as its audit in the result does anyway;
    its texts never do. Null roles and texts count as empty; rows without an id are a conversation of their own.
    Repeated rows are duplicates. An empty table gives empty results; other columns have no effect.
    """
    spark = conversations.sparkSession
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the tie column lets equal rows, which any order suits, go to several partitions
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(width, *order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    # partition and place in one number, read back from here and never evaluated again
    ordered = materialise(dealt.withColumn("at", F.monotonically_increasing_id()))

    same = F.sha2(F.concat(F.sha2(F.col("role").cast("binary"), 256), "text").cast("binary"), 256)
    ending = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + F.when(ending.isin(".", "!", "?"), 0).otherwise(4)
    narrow = materialise(ordered.select("at", "conv_id", "turn", kind.alias("kind"), (ending == "").alias("blank"), initial.alias("initial"), same.alias("same")))
    seen = narrow.groupBy("conv_id", "same").agg(F.min("at").alias("seen"), F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("seen_id"), F.col("same").alias("seen_same"), "seen")
    marked = narrow.join(seen, F.col("conv_id").eqNullSafe(F.col("seen_id")) & (F.col("same") == F.col("seen_same")), "left")
    again = F.coalesce(F.col("at") > F.col("seen"), F.lit(False))
    flagged = marked.select("at", "conv_id", "kind", "blank", again.alias("again"), "initial")
    pieces = materialise(flagged.repartition(F.expr(f"at div {BLOCK}")).sortWithinPartitions("at").mapInArrow(_pieces, _PIECE))
    chained = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "begin").mapInArrow(_chained, _CHAINED)
    edited = materialise(chained.repartition("begin").mapInArrow(_letters, _LETTERS))

    each = edited.select(F.explode("edits").alias("e")).select(F.col("e.at").alias("at"), F.col("e.letters").alias("letters"), F.col("e.state").alias("state"), F.col("e.role").alias("new_role"))
    turns = ordered.join(each, "at").select("conv_id", "at", "turn", "role", "text", "letters", "state", "new_role").mapInArrow(_turns, _TURNS)

    counts = pieces.groupBy("conv_id").agg(F.sum("n_blank").alias("blank"), F.sum("n_again").alias("duplicate"), F.sum("n_truncated").alias("truncated"))
    audits = edited.groupBy(F.col("conv_id").alias("of")).agg(
        F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "audit"))), lambda p: p["audit"]), "").alias("audit"),
    )
    gaps = narrow.groupBy(F.col("conv_id").alias("gap_id")).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    report = counts.join(audits, F.col("conv_id").eqNullSafe(F.col("of"))).join(gaps, F.col("conv_id").eqNullSafe(F.col("gap_id")))
    report = report.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repaired(turns, report)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``role:text`` of all turns, joined by line feeds.

    A digest is sequential, so one task reads the turns of a conversation in order; it holds one digest and no texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, None, False
        names = ["conv_id", "sha256"]
        for batch in batches:
            ids, digests = [], []
            for conv_id, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if begun and conv_id != key:
                    ids.append(key)
                    digests.append(state.hexdigest())
                if not begun or conv_id != key:
                    key, state, begun = conv_id, hashlib.sha256(), True
                else:
                    state.update(b"\n")
                state.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=names)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=names)

    lines = turns.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"), "at", "nth")
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "nth").select("conv_id", "line").mapInArrow(run, "conv_id long, sha256 string")


def repair_query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The report and the digest of every conversation id, damaged first."""
    done = repair_conversations(damaged(conversations))
    turns = materialise(done.turns)
    digests = materialise(conversation_digests(turns)).select(F.col("conv_id").alias("digest_id"), "sha256")
    drop_materialised(turns)
    report = done.report.withColumnRenamed("conv_id", "report_id")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.join(report, F.col("conv_id").eqNullSafe(F.col("report_id")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("digest_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )


ORACLE_SQL = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)
    )
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), hashed AS (
    SELECT *, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ord(substr(key, i, 1)) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS how
    FROM keyed, crc_table
), broken AS (
    SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM hashed, (VALUES (1), (2)) copies(k) WHERE how <> 0 AND (k = 1 OR how = 3)
), placed AS (
    SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS ending FROM broken
), faulty AS (
    SELECT *, ending = '' AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY place) AS seen, ending <> '' AND seen > 1 AS again, ending <> '' AND seen = 1 AND ending NOT IN ('.', '!', '?') AS cut, left(role, 1) AS initial,
        lag(left(role, 1)) OVER (PARTITION BY c ORDER BY place) AS earlier FROM placed
), moves(state, next, letters, cost, kind, role) AS (
    SELECT s.state, e.next, repeat('I', s.n) || e.letter, 2 * s.n + e.cost, e.kind, s.inserted || e.role
    FROM (VALUES (0, 0, 0, ''), (0, 2, 1, 'u'), (0, 3, 2, 'ua'), (1, 1, 0, ''), (1, 2, 1, 'u'), (1, 3, 2, 'ua'), (2, 2, 0, ''), (2, 3, 1, 'a'), (3, 3, 0, ''), (3, 2, 1, 'u')) s(state, here, n, inserted)
    JOIN (VALUES (0, 0, 'D', 3, 'any', ''), (1, 1, 'D', 3, 'any', ''), (2, 2, 'D', 3, 'any', ''), (3, 3, 'D', 3, 'any', ''), (0, 1, 'K', 0, 's', 'k'), (0, 2, 'K', 0, 'u', 'k'), (1, 2, 'K', 0, 'u', 'k'), (2, 3, 'K', 0, 'a', 'k'), (3, 2, 'K', 0, 'u', 'k'),
        (0, 2, 'R', 2, 'row', 'U'), (1, 2, 'R', 2, 'row', 'U'), (2, 3, 'R', 2, 'row', 'A'), (3, 2, 'R', 2, 'row', 'U')) e(state, next, letter, cost, kind, role) ON s.here = e.state
), walk AS (
    SELECT c, CAST(0 AS BIGINT) AS place, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'turns': CAST([] AS VARCHAR[])} AS best FROM (SELECT DISTINCT c FROM faulty)
    UNION ALL
    SELECT w.c, f.place, m.next, min({
        'cost': w.best.cost + m.cost + CASE WHEN f.cut AND m.letters NOT LIKE '%D' THEN 1 ELSE 0 END, 'audit': w.best.audit || m.letters,
        'turns': w.best.turns || list_transform(string_split(m.role, ''), lambda x: CASE x WHEN 'u' THEN 'user:' WHEN 'a' THEN 'assistant:' WHEN 'k' THEN f.role || ':' || f.text WHEN 'U' THEN 'user:' || f.text WHEN 'A' THEN 'assistant:' || f.text ELSE NULL END)})
    FROM walk w JOIN faulty f ON f.c = w.c AND f.place = w.place + 1
    JOIN moves m ON m.state = w.state AND (m.kind = 'any' OR NOT f.blank AND NOT f.again AND (m.kind = 'row' OR m.kind = f.initial))
    GROUP BY w.c, f.place, m.next
), ended AS (
    SELECT w.c, min({'cost': best.cost + closing.cost, 'audit': best.audit || closing.letters, 'turns': best.turns || closing.turns}) AS best
    FROM walk w JOIN (SELECT c, max(place) AS place FROM faulty GROUP BY c) l USING (c, place)
    JOIN (VALUES (0, 0, '', CAST([] AS VARCHAR[])), (1, 4, 'II', ['user:', 'assistant:']), (2, 2, 'I', ['assistant:']), (3, 0, '', CAST([] AS VARCHAR[]))) closing(state, cost, letters, turns) ON closing.state = w.state
    GROUP BY w.c
), counted AS (
    SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated,
        count(*) FILTER (place > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY c
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
    CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(list_filter(best.turns, lambda x: x IS NOT NULL), chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted ON o.conv_id IS NOT DISTINCT FROM counted.conv_id LEFT JOIN ended USING (c)
"""

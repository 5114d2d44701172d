import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corvane.llm.packing import WEIGHTS, Capacity, best_fit, pack, pack_documents
from corvane.llm.pretokens import BYTE_PATTERN, WORD_PATTERN, Pretokens
from corvane.llm.runtime import materialise
from corvane.llm.tokencount import token_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n", "Hello  world's it's\tI'LL 12³ ½ a−b “q” don’t 'tis ''s !'s  \n\n x", "ÀÉ İstanbul ΣΑΣ σ", "<|endoftext|> hi <|startoftext|>", "a\xa0b   c\x1cd",
    "日本語 テキスト", "😀 hi 👩‍👩‍👧", "\r\n\r\n a ", "é" * 50, "Ǆǅǆ ŉ ſ ß ẞ", "a\x85b", "\x00\x01 a_b __ x", "x <| y", "é café", "word " * 9000, "'" * 40, "a" * 3000, "   lead", "trail   ", "1234567 ²²",
]


@pytest.mark.parametrize(("path", "pattern", "prepare"), [(WORDS, WORD_PATTERN, str.lower), (BYTES, BYTE_PATTERN, str)])
def test_ids_equal_the_library(path, pattern, prepare):
    tokenizer, table = Tokenizer.from_file(path), Pretokens(path, pattern, prepare, lambda pieces: [p.id for p in pieces])
    texts = [t or "" for t in TEXTS] * 2
    got = [[i for p in table.split(t) for i in table[p]] for t in texts]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_no_result(monkeypatch):
    from corvane.llm import pretokens

    monkeypatch.setattr(pretokens, "CACHE", 40)
    texts = [f"some {i} words {chr(97 + i % 26) * (i % 7 + 1)} again" for i in range(900)]
    table = Pretokens(BYTES, BYTE_PATTERN, str, len)
    got = [sum(table[p] for p in table.split(t)) for t in texts]
    tokenizer = Tokenizer.from_file(BYTES)
    assert got == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts] and len(table) <= 40


def test_token_counts(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, "again", 2), (None, "none", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    tokenizer = Tokenizer.from_file(BYTES)
    want = sorted((str(d), len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, BYTES).collect()) == want
    assert token_counts(docs.limit(0), BYTES).count() == 0


def test_round_trip_and_packing(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "some more words " * (i * 37 % 900)) for i in range(200)] + [(5, TEXTS[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = pack_documents(docs, WORDS).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    want = defaultdict(int)
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[d, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    have = defaultdict(int)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert have == want
    rooms = defaultdict(list)
    for r in got:
        rooms[r.sequence_id].append((r.offset, r.length))
    for places in rooms.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(rooms) <= 1.01 * sum(r.length for r in got) / 4096 + 1
    assert pack_documents(docs.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 500, 1200)
    capacity = Capacity(tokens=1000, pieces=4, attention=400_000)
    where, offset = best_fit(lengths, capacity, (1.0, 0.5, 0.5), rule)
    for b in set(where.tolist()):
        own = lengths[where == b]
        assert own.sum() <= 1000 and len(own) <= 4 and (own**2).sum() <= 400_000
        assert sorted(offset[where == b].tolist()) == [0, *np.cumsum(own[np.argsort(offset[where == b])])[:-1].tolist()]
    with pytest.raises(ValueError, match="exceeds"):
        best_fit(np.array([2000]), capacity)


def brute_best_fit(lengths, capacity, weights, rule):
    """The same choice with every open bin scored for every item, one at a time."""
    caps, bins, out = (capacity.tokens, capacity.pieces, capacity.attention), [], {}
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = (int(lengths[item]), 1, int(lengths[item]) ** 2)
        scored = []
        for k, left in enumerate(bins):
            if all(a >= b for a, b in zip(left, need, strict=True)):
                if rule == "norm":
                    score = sum(w * ((a - b) / c) ** 2 for w, a, b, c in zip(weights, left, need, caps, strict=True))
                else:
                    score = -sum(w * a / c * b / c for w, a, b, c in zip(weights, left, need, caps, strict=True))
                scored.append((round(score, 12), k))
        if not scored:
            bins.append(list(caps))
            scored = [(0.0, len(bins) - 1)]
        k = min(scored)[1]
        out[item] = (k, caps[0] - bins[k][0])
        bins[k] = [a - b for a, b in zip(bins[k], need, strict=True)]
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [Capacity(), Capacity(tokens=1000, pieces=5, attention=420_000)])
def test_choice_of_bins_against_brute_force(rule, capacity):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 600, 400)
    for weights in (WEIGHTS, (0.3, 1.0, 2.0)):
        where, offset = best_fit(lengths, capacity, weights, rule)
        want = brute_best_fit(lengths, capacity, weights, rule)
        assert [(int(a), int(b)) for a, b in zip(where, offset, strict=True)] == [want[i] for i in range(len(lengths))]


def test_weights_change_the_choice():
    """In production capacities too, pieces and attention cost have a say in the choice."""
    lengths = np.random.default_rng(4).integers(1, 1500, 600)
    tokens_only, _ = best_fit(lengths, Capacity(), (1.0, 0.0, 0.0))
    all_three, _ = best_fit(lengths, Capacity())
    assert (tokens_only != all_three).any() and all_three.max() <= 1.01 * lengths.sum() / 4096 + 1


def test_leftovers_of_groups_are_packed_again(spark):
    """Many groups leave no more part-filled sequences than one; very many pieces of one document too."""
    rows = [(1, k, 4096 * k, 4096 if k % 3 else 1500, k) for k in range(600)] + [(10 + i, 0, 0, 30 + i * 7 % 900, i) for i in range(2400)]
    cut = materialise(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"))
    placed = pack(cut, group=100).collect()
    assert sorted(tuple(r)[:5] for r in placed) == sorted(rows)
    rooms = defaultdict(list)
    for r in placed:
        rooms[r.sequence_id].append((r.offset, r.length))
    for places in rooms.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r[3] for r in rows)
    once = len({r.sequence_id for r in pack(cut, group=10**6).collect()})
    assert len(rooms) <= once + 3 and once <= 1.01 * total / 4096 + 1


def test_packing_ignores_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, 8), (1, "a b c", 7, 8), (None, None, 1, 1)], "doc_id long, text string, sequence_id int, offset int")
    assert sorted((str(r.doc_id), r.piece, r.length) for r in pack_documents(docs, WORDS).collect()) == [("1", 0, 4), ("1", 0, 4), ("None", 0, 1)]

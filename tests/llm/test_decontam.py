import random

import numpy as np

from corvane.llm.decontam import Index, Item, contaminated, words_of


def brute(index, text, threshold, span):
    words, half = words_of(text), span // 2
    out = set()
    for start in range(0, max(1, len(words) - half), half):
        there = {index.term[w] for w in words[start : start + span] if w in index.term}
        out |= {i for i, weight in enumerate(index.weights) if sum(x for t, x in weight.items() if t in there) >= threshold - 1e-9}
    return out


def prose(rng, n):
    common = ["the", "of", "and", "to", "in"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(900)}" for _ in range(n))


def test_retrieves_all_above_threshold():
    rng = random.Random(2)
    items = [Item(i, prose(rng, rng.randint(5, 60)) + ".", 5) for i in range(150)]
    index = Index(items)
    hits = 0
    for n in (0, 1, 40, 127, 128, 129, 700, 9000):
        for threshold in (0.15, 0.3, 0.6):
            text = prose(rng, n) + " " + " ".join(items[n % 150].words) + " " + prose(rng, n // 2)
            got: dict[int, set[int]] = {0: set(), 1: set(), 2: set()}
            for number, _, found in index.passages([text, "", text[: len(text) // 2]], threshold, 128):
                got[number].update(found)
            assert got == {0: brute(index, text, threshold, 128), 1: set(), 2: brute(index, text[: len(text) // 2], threshold, 128)}
            hits += len(got[0])
    assert hits > 100


def test_pivots_skip_blocks():
    """A passage whose terms reach the threshold in one block only reads few others."""
    rng = random.Random(6)
    items = [Item(i, " ".join(["the", *(f"i{i}w{k}" for k in range(20))]), 5) for i in range(800)]
    index = Index(items)
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                reads.append(len(at))
            return np.ndarray.__getitem__(self, at)

    index.maximum = index.maximum.view(Counted)
    text = " ".join(["the"] * 50 + items[rng.randrange(800)].words)
    assert len(list(index.passages([text], 0.6, 128))) == 1
    assert 0 < sum(map(int, reads)) < 100 < index.blocks * 2


def test_recall_of_the_threshold():
    """Every item whose runs stand in a text at 0.8 is retrieved: all items against all texts."""
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randint(8, 60)), prose(rng, rng.randint(2, 12))) for i in range(60)]
    index = Index([Item(i, f"{q}. {a}.", 5) for i, q, a in items], reach=(0.8, 5, 0.6))
    texts = []
    for _ in range(300):
        _, q, a = rng.choice(items)
        words = f"{q} {a}".split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "edit"
        texts.append(" ".join([prose(rng, rng.randint(0, 90)), *words, prose(rng, rng.randint(0, 90))]))
    got = [set() for _ in texts]
    for number, passage, hits in index.passages(texts, 0.6, max(128, 2 * index.longest)):
        got[number] |= {index.items[h].item_id for h in hits if index.items[h].share(passage, 5) >= 0.8}
    want = [set(leaked_in(text, items)) for text in texts]
    assert sum(map(len, want)) > 150 and got == want


def test_finds_leaks_and_leaves_clean_texts(spark):
    rng = random.Random(4)
    tests = [(i, f"{prose(rng, 25)}. {prose(rng, 8)}.") for i in range(30)] + [(30, "Short one. Yes."), (31, ""), (None, prose(rng, 20)), (32, None), (7, "a b")]
    rows, leaks = [], {}
    for i in range(120):
        text = prose(rng, rng.randint(0, 400))
        if i % 4 == 0:
            item = tests[i % 30][1]
            text += "\n" + (item.upper() if i % 8 else item.replace(" ", "\n ")) + "\n" + prose(rng, 300)
            leaks[i] = i % 30
        elif i % 4 == 1:  # the question alone is no leak of an item with an answer
            text += " " + tests[i % 30][1].split(". ")[0] + " " + prose(rng, 30)
        rows.append((i, text, "x"))
    rows += [(500, None, None), (501, "", None), (501, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, overlap string")
    bench = spark.createDataFrame(tests, "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in contaminated(docs, bench, ["doc_id"]).collect()}
    assert {d for d, ids in got.items() if ids} == set(leaks) and all(leaks[d] in got[d] for d in leaks)
    assert len(contaminated(docs, bench, ["doc_id"]).collect()) == len(rows)
    assert contaminated(docs, bench.limit(0), ["doc_id"]).filter("size(item_ids) > 0").count() == 0
    assert contaminated(docs.limit(0), bench, ["doc_id"]).count() == 0


def leaked_in(text, items, overlap=0.8, width=5):
    """Items of which the whole, or both question and answer, stand in the text; every run is compared."""
    runs = lambda words, n: {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}
    share = lambda part, words: len(runs(part, min(width, len(part))) & runs(words, min(width, len(part)))) / len(runs(part, min(width, len(part))))
    words, out = words_of(text), []
    for item_id, question, answer in items:
        q, a = words_of(question), words_of(answer)
        if share(q + a, words) >= overlap or share(q, words) >= overlap and share(a, words) >= overlap:
            out.append(item_id)
    return out


def near_copies(rng, items):
    rows = []
    for i, (_, question, answer) in enumerate(items):
        edited = answer.split()
        edited[len(edited) // 2] = "edited"
        for k, copy in enumerate((f"{question}. {answer}.", f"{question}. {' '.join(edited)}.", question, f"{question}. {' '.join(edited[:2])}.")):
            rows.append((4 * i + k, f"{prose(rng, rng.randint(0, 300))} {copy} {prose(rng, 150)}"))
    return rows


def test_one_word_edits_in_short_last_sentences(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, 52 - i), prose(rng, 8 - i % 6)) for i in range(24)]
    rows = near_copies(rng, items)
    want = {d: leaked_in(text, items) for d, text in rows}
    assert all(d // 4 in want[d] for d in want if d % 4 == 1 and d < 40) and any(not ids for ids in want.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"{q}. {a}.") for i, q, a in items], "item_id long, text string")
    assert {r.doc_id: r.item_ids for r in contaminated(docs, bench, ["doc_id"]).collect()} == want


def test_heavy_words_in_the_edited_end(spark):
    question = " ".join(random.Random(5).choices("the of and to in".split(), k=70))
    items = [(0, question, "quark lepton gluon boson"), *((i, "the of and to in " * 3 + f"w{i}", "in the") for i in range(1, 40))]
    bench = spark.createDataFrame([(i, f"{q}. {a}.") for i, q, a in items], "item_id long, text string")
    docs = spark.createDataFrame([(0, question + " and more")], "doc_id long, text string")
    assert contaminated(docs, bench, ["doc_id"]).first().item_ids == leaked_in(question + " and more", items) == [0]


def test_parts_give_the_same_leaks(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, prose(rng, 40), prose(rng, 6)) for i in range(20)]
    rows = near_copies(rng, items)
    docs = spark.createDataFrame([*rows, *rows[:9], (None, rows[0][1]), (500, None), (501, ""), (501, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"{q}. {a}.") for i, q, a in items], "item_id long, text string")
    result = lambda: sorted(map(str, contaminated(docs, bench, ["doc_id"]).collect()))
    whole = result()
    monkeypatch.setattr("corvane.llm.decontam.INDEX_ITEMS", 6)
    assert result() == whole and len(whole) == len(rows) + 13

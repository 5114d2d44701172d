import random
import re

from corvane.llm.components import connected_components
from corvane.llm.minhash import near_duplicates


def brute(rows, percent=85, width=5):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(a & sets[j])
            if inter and 100 * inter >= percent * (len(a) + len(sets[j]) - inter):
                up[top(i)] = top(j)
    first = {}
    for i, (doc, _) in enumerate(rows):  # texts under one id are one document
        if sets[i] and doc is not None:
            up[top(i)] = top(first.setdefault(doc, i))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(doc, least.get(top(i), doc))
    return {(doc, len(sets[i]), least[top(i)], doc == least[top(i)]) for i, (doc, _) in enumerate(rows)}


def drift(rng, words, n):
    """Copies of copies, each a few words away from an earlier one."""
    made = [words]
    while len(made) < n:
        copy = list(rng.choice(made))
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        made.append(copy)
    return made


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(200, i) for i in range(201, 300)] + [(5, 5), (7, 6), (None, 3), (400, 401)]
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 1) for i in range(1, 61)} | {(i, 200) for i in range(200, 300)} | {(400, 400), (401, 400)}


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(60)]
    texts += [" ".join(t) for t in drift(rng, rng.choices(vocabulary, k=146), 150)]
    texts += [" ".join(t) for t in drift(rng, rng.choices(vocabulary, k=700), 40)]
    texts += texts[:25] + [texts[70].upper(), texts[71].replace(" ", "\t\n "), "", "   ", "a b", "A  b", "é É", "é é"]
    texts += ["tail of few"] * 30
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = brute(rows)
    for options in ({"block": 16, "block_shingles": 3000}, {"hot": 3, "block": 4}):
        got = near_duplicates(docs, **options).collect()
        assert {tuple(r)[:4] for r in got} == expected and len(got) == len(rows)


def test_one_id_on_several_texts(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    a, b = rng.sample(words, 100), rng.sample(words, 100)
    near = lambda text: [*text[:-1], "other"]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join(near(a))), (8, " ".join(near(b))), (9, " ".join(rng.sample(words, 100))), (5, "")]
    for order in (rows, rows[::-1]):
        got = near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True)]


def test_large_group_of_one_template(spark):
    """20,000 variants of a template: every set meets its centre once, no block holds them all."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(20_000):
        text = list(base)
        text[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(text)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).groupBy("component_id").count().collect()
    assert [tuple(r) for r in got] == [(0, 20_000)]


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "one two three four five six", 9), (3, "one two three four five six", 9), (None, "one two three four five six", 9), (4, "lonely " * 3000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(near_duplicates(docs).collect(), key=str)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (3, 2, 3, True), (4, 1, 4, True)]
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None] == [(2, 3, False)]
    assert near_duplicates(docs.limit(0)).count() == 0

import random
from time import process_time

from pyspark.sql import functions as F

from corvane.llm.runtime import fold
from corvane.llm.toxicity import _EMITS, CASCADE, PRIOR, Grammar, Lexicon, ToxicityModel, clause_patterns, fit_toxicity, score_toxicity

LEXICON = Lexicon(frozenset({"idiot"}), frozenset({"lowe"}))


def patterns(text):
    return clause_patterns(text, LEXICON, LEXICON.trigger(), Grammar())


def test_clauses():
    #                       insult aimed negated reported threat weak
    assert patterns("an idiot. fine") == [1, 0, 0, 0, 0, 0]
    assert patterns("you are an idiot") == [0, 1, 0, 0, 0, 0]
    assert patterns("that is not idiot talk") == [0, 0, 1, 0, 0, 0]
    assert patterns("She said: hello. He called him idiot") == [0, 0, 0, 1, 0, 0]
    assert patterns("I will kill you") == [0, 0, 0, 0, 1, 0]
    assert patterns("they kill time") == [0, 0, 0, 0, 0, 1]
    assert patterns("You. loweischaft!") == [1, 0, 0, 0, 0, 0]
    assert patterns("idiotic slowe yellow") == [0] * 6
    assert patterns("") == [0] * 6
    assert patterns("idiot " * 3000)[0] == 3000
    assert patterns("idiot, you are") == [0, 1, 0, 0, 0, 0]
    assert patterns("an idiot that nobody has ever seen near you") == [1, 0, 0, 0, 0, 0]
    assert patterns("never again whatever comes will I hurt you") == [0, 0, 0, 0, 1, 0]  # a negation reaches four words
    assert patterns("never will I hurt you") == patterns("I will not hurt you") == [0, 0, 0, 0, 0, 1]


def test_clauses_are_read_whole():
    for n in (1, 10, 60, 5000):
        assert patterns("i will kill " + "and so on " * n + "you") == [0, 0, 0, 0, 1, 0]
        assert patterns("i will kill " + "and so on " * n + "it") == [0, 0, 0, 0, 0, 1]
        assert patterns("you " + "and so on " * n + "i will kill") == [0, 0, 0, 0, 1, 0]
    began = process_time()
    patterns("you idiot kill will not said " * 20_000)
    assert process_time() - began < 10


def brute(classes):
    """The best weight over all outputs of the transducers, one after another, each path written out."""

    def outputs(machine, read):
        paths = [(0, ())]
        for c in read:
            paths = [(to, (*out, o)) for state, out in paths for to, o in machine.step(state, c)]
        return {out for state, out in paths if state in machine.final}

    texts = {tuple(classes)}
    for machine in CASCADE:
        texts = {out for text in texts for out in outputs(machine, text)}
    return max(sum(PRIOR[_EMITS[c]] for c in text if c in _EMITS) for text in texts)


def test_composition_against_brute_force():
    rng = random.Random(1)
    grammar = Grammar()
    for _ in range(1500):
        classes = rng.choices("IVWPNRo", (4, 2, 2, 2, 1, 1, 3), k=rng.randint(0, 9))
        weight, counts = grammar.best(classes)
        assert abs(weight - brute(classes)) < 1e-9
        assert abs(weight - sum(n * w for n, w in zip(counts, PRIOR, strict=True))) < 1e-9
        assert sum(counts) == sum(c in "IV" for c in classes)


def test_learns_words_and_stems(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = rng.choices(words, k=30)
        toxic = i % 6 == 0
        if toxic:
            text[rng.randrange(30)] = rng.choice(["zzblork", "yyquix"]) if i % 4 else "wwem" + rng.choice(words)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = fit_toxicity(docs, known, lambda d: fold(d, 3) != 1)
    assert {"zzblork", "yyquix"} <= model.lexicon.words
    held = {r.doc_id: r.score for r in score_toxicity(docs.filter(fold(F.col("doc_id"), 3) == 1), model, ["doc_id"]).collect()}
    truth = dict(labels)
    assert sum((s >= 0.7) == bool(truth[d]) for d, s in held.items()) >= 0.98 * len(held)


def test_nulls_and_clashing_columns(spark):
    model = ToxicityModel(LEXICON, (3.0,) * 6, -1.0)
    docs = spark.createDataFrame([(1, None, "x", 1.0), (1, "", "x", 1.0), (None, "idiot", None, 0.5)], "doc_id long, text string, counts string, score double")
    got = score_toxicity(docs, model, ["doc_id"]).collect()
    assert len(got) == 3 and got[0].score == got[1].score < 0.5 < got[2].score
    assert score_toxicity(docs.limit(0), model, ["doc_id"]).count() == 0
    assert fit_toxicity(docs.limit(0), docs.select("doc_id", F.lit(1).alias("toxic")).limit(0), lambda d: fold(d, 3) != 1).lexicon.words


CLAUSES = [
    ("I am going to kill you", "threat"), ("I want to hurt you", "threat"), ("kill yourself", "threat"), ("I will slowly and painfully kill you", "threat"), ("we will burn them all", "threat"),
    ("I will not kill you", "weak threat"), ("he said he will kill you", "weak threat"), ("kill the process", "weak threat"), ("they shoot films", "weak threat"), ("I will beat the eggs", "weak threat"), ("kill the process if you like", "weak threat"),
    ("you are an idiot", "aimed insult"), ("what an idiot you are", "aimed insult"), ("you are not smart you idiot", "aimed insult"), ("don't you see, idiot", "aimed insult"),
    ("you are not an idiot", "negated insult"), ("you are not at all an idiot", "negated insult"), ("never an idiot", "negated insult"), ("du bist kein idiot", "negated insult"),
    ("No one would ever call you an idiot", "reported insult"), ("she called him an idiot", "reported insult"), ("he wrote that the mayor is a moron", "reported insult"),
    ("idiot", "insult"), ("a pathetic film of an hour", "insult"),
]


def test_patterns_of_clauses():
    from corvane.llm.toxicity import PATTERNS, SEED_INSULTS, Grammar, Lexicon, clause_patterns

    lexicon = Lexicon(frozenset(SEED_INSULTS), frozenset())
    for text, want in CLAUSES:
        counts = clause_patterns(text, lexicon, lexicon.trigger(), Grammar())
        assert {PATTERNS[k] for k, n in enumerate(counts) if n} == {want}, (text, counts)


def test_an_id_on_many_rows_is_one_labelled_row(spark):
    from corvane.llm.runtime import labelled_sample

    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "other"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    got = sorted(map(tuple, labelled_sample(docs, labels, "toxic", lambda c: c > 0, 100).collect()))
    assert got == [(1, "text 0", 1), (2, "other", 0)]

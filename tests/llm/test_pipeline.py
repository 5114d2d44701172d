import re
from collections import Counter

import corpus_pipeline
from corvane.llm.runtime import read_table

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    labels = {r.doc_id: r for r in read_table(spark, SF, "labels").collect()}
    kept = [{r.doc_id: r.text for r in docs.collect()}]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(stage(spark, frames[-1], SF).cache())
        assert frames[-1].columns == docs.columns
        kept.append({r.doc_id: r.text for r in frames[-1].collect()})
        assert kept[-1].items() <= kept[-2].items()
    good = [d for d, r in labels.items() if r.quality == 1]
    bad = [d for d, r in labels.items() if r.quality == 0]
    assert sum(d in kept[1] for d in good) >= 0.95 * len(good) and sum(d not in kept[1] for d in bad) >= 0.6 * len(bad)
    toxic = [d for d, r in labels.items() if r.toxic == 1 and d in kept[1]]
    clean = [d for d, r in labels.items() if r.toxic == 0 and d in kept[1]]
    assert sum(d in kept[2] for d in clean) >= 0.95 * len(clean) and sum(d not in kept[2] for d in toxic) >= 0.6 * len(toxic)

    sets = {d: shingle_set(t) for d, t in kept[2].items()}
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert set(kept[3]) == {d for d in ids if top(d) == d}

    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in read_table(spark, SF, "benchmark").collect()]
    plain = {d: " ".join(re.findall(r"\w+", (t or "").lower())) for d, t in kept[3].items()}
    assert set(kept[4]) == {d for d, t in plain.items() if not any(i in t for i in items)}

    packed = corpus_pipeline.STAGES[-1][1](spark, frames[-1], SF).collect()
    assert {r.doc_id for r in packed} == set(kept[4])
    room = Counter()
    for r in packed:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 4096


def test_stages_on_odd_rows(spark):
    """Null ids and texts, repeated rows, clashing columns and an empty table, in every stage."""
    good = "The committee met on Monday and spoke at length about the new bridge, its cost and the years it would take to build it."
    rows = [(1, good, "en", "web", 9), (1, good, "en", "web", 9), (2, good + " Indeed.", "en", None, None), (3, None, None, None, None), (4, "", "", "", 0), (None, good, "en", "web", 1), (None, None, None, None, None)]
    more = [(*r, 0.1, ["x"], [1], True, 5, "t") for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, counts array<string>, item_ids array<int>, kept boolean, component_id int, text_ string"
    docs = spark.createDataFrame(more, schema)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == corpus_pipeline.COLUMNS
        found = [tuple(r) for r in got.collect()]
        assert not Counter(found) - Counter(rows), name
        assert stage(spark, empty, SF).count() == 0
        if name == "near duplicates":
            assert Counter(found) == Counter(r for r in rows if r[0] != 2)
        if name == "benchmark decontamination":
            assert Counter(found) == Counter(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in packed) == Counter(r[0] for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0

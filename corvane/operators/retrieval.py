"""Batch retrieval: term statistics, keyword and vector top-k, fusion, re-ranking, boosts and gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import content_words, stem, stemmed_words
from corvane.operators.governance import holds
from corvane.operators.structure import passage_windows
from corvane.sources.scratch import written


def term_stats(passages: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): in how many passages each stemmed word occurs."""
    return passages.select(F.explode(stemmed_words(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def add_term_stats(stats: DataFrame, more: DataFrame) -> DataFrame:
    """Statistics of two disjoint sets of passages, added."""
    return stats.unionByName(more).groupBy("term").agg(F.sum("df").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def question_terms(questions: DataFrame, id_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """(question_id, term) of the distinct stemmed words of each question."""
    return questions.select(F.col(id_col).alias("question_id"), F.explode(stemmed_words(F.col(text_col))).alias("term"))


def key_terms(terms: DataFrame, stats: DataFrame, n: int, lexicon: list[str], max_ratio: float = 0.12, least: int = 3) -> DataFrame:
    """(question_id, term): lexicon entities the corpus knows, if a question has any, else its rare words."""
    known = terms.join(stats, "term").filter("df > 0").withColumn("entity", F.col("term").isin(lexicon) if lexicon else F.lit(False))
    any_entity = F.max("entity").over(Window.partitionBy("question_id"))
    rare = (F.col("df") <= max(least, int(max_ratio * n))) & ~F.col("term").rlike("^[0-9]+$")
    return known.withColumn("any", any_entity).filter(F.when(F.col("any"), F.col("entity")).otherwise(rare)).select("question_id", "term")


def uncovered_entities(terms: DataFrame, stats: DataFrame, lexicon: list[str], expansions: DataFrame | None = None) -> DataFrame:
    """(question_id, term): lexicon entities of a question that no passage holds.

    ``expansions(question_id, expansions)`` are the abbreviations and brands of a question with their meanings: an entity
    is covered too where a passage holds a word of what it is short for.
    """
    known = stats.filter("df > 0").select("term")
    missing = terms.filter(F.col("term").isin(lexicon)).join(known, "term", "left_anti").select("question_id", "term")
    if expansions is None:
        return missing
    each = expansions.select("question_id", F.explode("expansions").alias("x")).select("question_id", stemmed_words(F.col("x.term")).alias("shorts"), F.explode(stemmed_words(F.col("x.meaning"))).alias("term"))
    covered = each.join(known, "term", "left_semi").select("question_id", F.explode("shorts").alias("term")).distinct()
    return missing.join(covered, ["question_id", "term"], "left_anti")


def postings(passages: DataFrame, terms: DataFrame | None = None, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, term, tf) of the stemmed words of passages; only of ``terms(term)`` if given, dropped before anything is counted."""
    words = passages.select(F.col(id_col).alias("chunk_id"), F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z][a-z0-9-]+"), F.lit(0))).alias("word"))
    found = words.select("chunk_id", stem(F.col("word")).alias("term"))
    if terms is not None:
        found = found.join(terms.select("term").distinct(), "term", "left_semi")
    return found.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def top_k(scored: DataFrame, k: int, score: str = "score", id_col: str = "chunk_id", by: str = "question_id") -> DataFrame:
    """The ``k`` best rows of each question, ties to the smaller id, with ``rank``."""
    order = Window.partitionBy(by).orderBy(F.desc(score), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def keyword_topk(terms: DataFrame, passages: DataFrame, k: int = 40, eligible: DataFrame | None = None) -> DataFrame:
    """(question_id, chunk_id, score, rank): r / (r + 1) with r a tenth of the matched term frequencies.

    ``terms``: (question_id, term). Eligibility comes before the texts are read, and words of no question are
    dropped before any is counted.
    """
    if eligible is not None:
        passages = passages.join(eligible.select("chunk_id"), "chunk_id", "left_semi")
    total = postings(passages, terms).join(terms, "term").groupBy("question_id", "chunk_id").agg(F.sum("tf").alias("tf"))
    r = F.col("tf") * 0.1
    return top_k(total.select("question_id", "chunk_id", F.round(r / (r + 1), 9).alias("score")), k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Queries of a block, and the least and most vectors of a share of the table that a block meets in one pass.
QUERY_BLOCK, SHARE_ROWS = 8192, (4096, 262_144)
#: Queries whose scores against a batch of vectors are held at a time.
SCORED_QUERIES = 128


class _Best:
    """The ``k`` best vectors so far of each query of a block, by score, then by id; vectors come batch by batch."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, tags: np.ndarray, k: int, digits: int, allowed) -> None:
        self.ids, self.rows, self.tags, self.k, self.digits, self.allowed = ids, rows, tags, k, digits, allowed
        self.found = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        self.least = np.full(len(ids), -2.0)  # below any cosine

    def meet(self, ids: np.ndarray, rows: np.ndarray, tags: np.ndarray) -> None:
        for lo in range(0, len(self.ids), SCORED_QUERIES):
            some = slice(lo, lo + SCORED_QUERIES)
            scores = self.rows[some] @ rows.T
            if self.allowed is not None:
                scores = np.round(scores, self.digits)
                scores[~self.allowed(self.tags[some], tags, scores)] = -np.inf
            may = scores >= (self.least[some] - 10.0**-self.digits)[:, None]  # rounding may lift a score by half of that
            for at in np.flatnonzero(may.any(1)):
                near = np.flatnonzero(may[at])
                score = np.round(scores[at, near], self.digits)
                if len(near) > self.k:
                    high = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
                    near, score = near[high], score[high]
                score, near = np.concatenate([self.found[lo + at][0], score]), np.concatenate([self.found[lo + at][1], ids[near]])
                order = np.lexsort((near, -score))[: self.k]
                self.found[lo + at] = score[order], near[order]
                if len(order) == self.k:
                    self.least[lo + at] = score[order[-1]]

    def batch(self) -> pa.RecordBatch:
        scores, ids = (np.concatenate(x) for x in zip(*self.found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, [len(x) for x, _ in self.found])), pa.array(ids), pa.array(scores)], names=["question_id", "chunk_id", "score"])


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 40, digits: int = 6, tags: tuple[str, ...] = (), allowed=None) -> DataFrame:
    """(question_id, chunk_id, score, rank) for queries (question_id, vector) over chunks (chunk_id, vector): exact cosines.

    Queries are dealt into blocks, chunks into shares; the rows of a block and a share come to one task, sorted so that
    the queries come first, and the chunks pass by them in batches, of which ``k`` rows a query are kept. A task holds a
    block and a batch, however large the shares are; nothing is gathered into lists or broadcast.
    ``allowed(query_tags, chunk_tags, scores)`` gives a mask of the pairs that count, from the columns ``tags`` of both
    sides as numbers. Null ids and null and zero vectors take no part.
    """
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    narrow = all(df.schema["vector"].dataType.elementType.typeName() == "float" for df in (queries, vectors))
    n_queries, n_vectors = queries.count(), vectors.count()
    n_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    n_shares = max(1, -(-n_vectors // min(max(n_vectors // 64, SHARE_ROWS[0]), SHARE_ROWS[1])))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def placed(df: DataFrame, key: str, block, share, stored: int) -> DataFrame:
        known = df.filter(F.col(key).isNotNull() & F.col("vector").isNotNull() & (norm > 0))
        rows = known.select(F.col(key).cast("long").alias("id"), F.col("vector").cast("array<float>" if narrow else "array<double>").alias("v"), F.array(*[F.col(t).cast("double") for t in tags]).cast("array<double>").alias("t"))
        each = rows.select(block.alias("block"), "*").select(share.alias("share"), "*")  # one of the two is exploded
        return each.select(((F.col("block") * n_shares + F.col("share")) * 2 + stored).alias("at"), "id", "v", "t")

    rows = placed(queries, "question_id", dealt(n_blocks), spread(n_shares), 0).unionByName(placed(vectors, "chunk_id", spread(n_blocks), dealt(n_shares), 1))
    ordered = rows.repartition(F.shiftright("at", 1)).sortWithinPartitions("at")

    def unpacked(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        matrix = lambda lists: np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(lists), -1)
        v = matrix(rows.column(2))
        return rows.column(1).to_numpy(zero_copy_only=False), v / np.linalg.norm(v, axis=1, keepdims=True), matrix(rows.column(3)) if tags else np.zeros((len(v), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, asked, best = None, [], None
        for batch in batches:
            at = batch.column(0).to_numpy()
            ends = [*(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for lo, hi in zip([0, *ends], ends):
                if lo == hi:
                    continue
                if at[lo] >> 1 != pair:
                    if best is not None:
                        yield best.batch()
                    pair, asked, best = at[lo] >> 1, [], None
                some = unpacked(batch.slice(lo, hi - lo))
                if not at[lo] & 1:
                    asked.append(some)
                    continue
                if asked:
                    best, asked = _Best(*map(np.concatenate, zip(*asked, strict=True)), k, digits, allowed), []
                if best is not None:
                    best.meet(*some)
        if best is not None:
            yield best.batch()

    pairs = ordered.mapInArrow(run, "question_id long, chunk_id long, score double")
    return top_k(pairs, k)


def rrf(lists: list[DataFrame], k: int = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (question_id, chunk_id, rank): sums of 1 / (k + rank).

    Equal sums keep the order in which chunks first appear: by rank in the first list, then in the next.
    """
    merged = None
    for n, ranked in enumerate(lists):
        one = ranked.select("question_id", "chunk_id", "rank", F.lit(n).alias("list"))
        merged = one if merged is None else merged.unionByName(one)
    places = [F.min(F.when(F.col("list") == n, F.col("rank"))).alias(f"rank_{n}") for n in range(len(lists))]
    fused = merged.groupBy("question_id", "chunk_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("rrf"), *places)
    order = Window.partitionBy("question_id").orderBy(F.desc("rrf"), *(F.asc_nulls_last(f"rank_{n}") for n in range(len(lists))), "chunk_id")
    out = fused.withColumn("rank", F.row_number().over(order)).select("question_id", "chunk_id", "rrf", "rank")
    return out if limit is None else out.filter(F.col("rank") <= limit)


def lexical_score(question: Column, passage: Column) -> Column:
    """Share of the question's stems in the passage, four digits; 0 for a question without stems."""
    q = stemmed_words(question)
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, stemmed_words(passage))) / F.size(q), 4)).otherwise(0.0)


def maxp(pool: DataFrame, windows: DataFrame, keep: int = 2, chunk_chars: int = 600, scorer=lexical_score) -> DataFrame:
    """(question_id, chunk_id, rerank, best_window): the best of ``keep`` windows and of the whole view.

    ``pool``: question_id, question, chunk_id, title, text; ``windows``: chunk_id, pos, window. Windows are
    kept by the number of question words in them, earlier ones first. The whole view never names a window:
    the first kept one stands for it. ``scorer`` may be a relevance model, see ``scoring.pair_scorer``.
    """
    overlap = F.size(F.array_intersect(content_words(F.col("question")), content_words(F.col("window"))))
    each = pool.join(windows, "chunk_id").withColumn("overlap", overlap)
    order = Window.partitionBy("question_id", "chunk_id").orderBy(F.desc("overlap"), "pos")
    kept = each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    kept = kept.withColumn("score", scorer(F.col("question"), F.col("window")))
    best = kept.groupBy("question_id", "chunk_id").agg(F.max("score").alias("window_score"), F.max_by("pos", F.struct("score", -F.col("place"))).alias("top"), F.min_by("pos", "place").alias("first"))
    view = F.concat_ws("\n", "title", F.substring("text", 1, chunk_chars))
    whole = pool.select("question_id", "chunk_id", scorer(F.col("question"), view).alias("whole"))
    both = whole.join(best, ["question_id", "chunk_id"], "left")
    score = F.greatest("whole", F.coalesce("window_score", F.lit(0.0)))
    return both.select("question_id", "chunk_id", score.alias("rerank"), F.when(F.col("window_score") >= F.col("whole"), F.col("top")).otherwise(F.col("first")).alias("best_window"))


def build_pool(fused: DataFrame, keyed: DataFrame, size: int = 8, extra: int = 3) -> DataFrame:
    """The first ``size`` chunks of each question and up to ``extra`` later ones that hold a key term.

    ``keyed``: (question_id, chunk_id) of chunks that hold a key term.
    """
    first = fused.filter(F.col("rank") <= size)
    later = fused.filter(F.col("rank") > size).join(keyed.distinct(), ["question_id", "chunk_id"], "left_semi")
    order = Window.partitionBy("question_id").orderBy("rank")
    later = later.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= extra).drop("n")
    return first.unionByName(later)


def authority_boosts(candidates: DataFrame, as_of, branch: float = 0.10, circular: float = 0.05, recency: float = 0.02, half_life: int = 730) -> DataFrame:
    """Candidates with branch, circular and recency boosts and ``final``, the re-rank score plus their sum."""
    age = F.datediff(as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date"), "effective_from")
    out = candidates.withColumns(
        {
            "branch_boost": F.when(F.col("branch_specific"), F.lit(branch)).otherwise(0.0),
            "circular_boost": F.when((F.col("doc_type") == "circular") & F.col("amends_something"), F.lit(circular)).otherwise(0.0),
            "recency_boost": F.round(recency * F.greatest(F.lit(0.0), 1 - age / half_life), 4),
        }
    )
    return out.withColumn("final", F.round(F.col("rerank") + F.col("branch_boost") + F.col("circular_boost") + F.col("recency_boost"), 6))


def key_term_boost(matched: Column, n_terms: Column, weight: float = 0.25) -> Column:
    return F.when(n_terms > 0, F.round(weight * matched / n_terms, 4)).otherwise(0.0)


def context_cut(ranked: DataFrame, reranked: int = 12, context: int = 6) -> DataFrame:
    """The ``reranked`` best rows of each question by (final, rerank), the first ``context`` of them marked."""
    order = Window.partitionBy("question_id").orderBy(F.desc("final"), F.desc("rerank"), "chunk_id")
    return ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= reranked).withColumn("in_context", F.col("place") <= context)


def relevance_gate(context: DataFrame, questions: DataFrame, uncovered: DataFrame, least: float = 0.35) -> DataFrame:
    """(question_id, best, n_useful, not_found): whether what was found is good enough to answer from.

    Useful rows score at least half of ``least`` or hold a key term; where none does, all count.
    """
    useful = (F.col("rerank") >= 0.5 * least) | (F.col("key_boost") > 0)
    found = context.groupBy("question_id").agg(F.max("rerank").alias("best"), F.count_if(useful).alias("useful"), F.count("*").alias("n"))
    gaps = uncovered.select("question_id").distinct().withColumn("gap", F.lit(True))
    joined = questions.select("question_id").join(found, "question_id", "left").join(gaps, "question_id", "left")
    n_useful = F.when(F.coalesce("useful", F.lit(0)) > 0, F.col("useful")).otherwise(F.coalesce("n", F.lit(0)))
    missing = F.col("best").isNull() | (F.col("best") < least) | F.col("gap").isNotNull()
    return joined.select("question_id", "best", n_useful.alias("n_useful"), missing.alias("not_found"))


def amending_from(links: DataFrame) -> DataFrame:
    """(version_id, amends_from): the first day on which a version has a confirmed link in effect."""
    return links.filter("confirmed").groupBy(F.col("source_version_id").alias("version_id")).agg(F.min("effective_from").alias("amends_from"))


def batch_search(questions: DataFrame, passages: DataFrame, index, question_vectors: DataFrame, vectors: DataFrame, scoped: DataFrame, facts: DataFrame, keys: DataFrame, k: int = 40, config: dict | None = None) -> DataFrame:
    """Hybrid search for many questions, each with its own branch and day; one row a chunk that is kept.

    ``questions(question_id, question, branch_id, as_of)``, the text expanded already; ``passages(chunk_id, title,
    heading, text)`` and their ``index``; ``question_vectors(question_id, vector)`` and ``vectors(chunk_id, vector)``;
    ``scoped``: the days and branches of chunks (``governance.scoped_intervals``); ``facts(chunk_id, doc_type, effective_from,
    branch_specific, amends_from)``; ``keys(question_id, term)``, the key terms. Result: (question_id, chunk_id, rank, rerank,
    key_boost, final, place, in_context).

    Keyword and vector lists of ``k`` eligible chunks are fused; the pool holds the first ones and later ones with a
    key term; the best passage window counts; boosts are added and the context is cut. Eligibility is a condition on
    the pairs that the lists meet, before they are ranked: no question is joined with all eligible chunks. Keyword
    list, fused list, pool and windows are written once each, so every table is read a fixed number of times.
    """
    how = {"pool": 8, "extra": 3, "reranked": 12, "context": 6} | (config or {})
    asked = written(questions.select("question_id", "question", F.col("branch_id").cast("int").alias("branch_id"), "as_of"))
    scoped = written(scoped.select("chunk_id", "valid_from", "valid_to", "branch_id"))
    when = asked.select("question_id", F.col("branch_id").alias("asked_branch"), "as_of")

    def allowed(pairs: DataFrame) -> DataFrame:
        dated = pairs.join(when, "question_id").join(scoped, "chunk_id")
        return dated.filter(holds(F.col("as_of"), F.col("asked_branch"))).select(*pairs.columns)

    keyword = written(index.keyword_topk(question_terms(asked), k, allowed))
    days = lambda c, other: F.coalesce(F.datediff(c, F.lit("1970-01-01").cast("date")), F.lit(other)).cast("double")
    dated = vectors.join(scoped, "chunk_id").select("chunk_id", "vector", days(F.col("valid_from"), 0).alias("a"), days(F.col("valid_to"), 10**7).alias("b"), F.coalesce("branch_id", F.lit(-1)).cast("double").alias("c"))
    looking = question_vectors.join(when, "question_id").select("question_id", "vector", days(F.col("as_of"), -1).alias("a"), F.lit(0.0).alias("b"), F.coalesce("asked_branch", F.lit(-2)).cast("double").alias("c"))
    near = vector_topk(looking, dated, k, tags=("a", "b", "c"), allowed=_in_force)
    fused = written(rrf([keyword, near], limit=k))

    found = written(index.postings(keys).join(fused.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    matched = written(found.join(keys, "term").join(fused.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_semi").groupBy("question_id", "chunk_id").agg(F.count("*").alias("m")))
    pool = written(build_pool(fused, matched.select("question_id", "chunk_id"), how["pool"], how["extra"]))  # of known size, so texts stay in place
    texts = written(passages.join(pool.select("chunk_id"), "chunk_id", "left_semi"))
    candidates = written(pool.join(texts, "chunk_id").join(asked.select("question_id", "question"), "question_id"))
    best = maxp(candidates, passage_windows(texts)).join(candidates.select("question_id", "chunk_id", "rank"), ["question_id", "chunk_id"])

    order = Window.partitionBy("question_id").orderBy(F.desc("rerank"), "rank")
    best = best.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= how["reranked"]).drop("n")
    boosted = authority_boosts(best.join(when, "question_id").join(facts, "chunk_id").withColumn("amends_something", F.coalesce(F.col("amends_from") <= F.col("as_of"), F.lit(False))), F.col("as_of"))
    n_keys = keys.groupBy("question_id").agg(F.count("*").alias("n_keys"))
    keyed = boosted.join(matched, ["question_id", "chunk_id"], "left").join(n_keys, "question_id", "left")
    bonus = F.coalesce(key_term_boost(F.coalesce("m", F.lit(0)), F.col("n_keys")), F.lit(0.0))
    final = keyed.withColumn("key_boost", bonus).withColumn("final", F.round(F.col("final") + F.col("key_boost"), 6))
    return context_cut(final, how["reranked"], how["context"]).select("question_id", "chunk_id", "rank", "rerank", "key_boost", "final", "place", "in_context")


def _in_force(questions: np.ndarray, chunks: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Mask of the pairs whose chunk holds on the question's day (first tags: from, to) for its branch (-1: network-wide)."""
    day, branch = questions[:, :1], questions[:, 2:]
    return (chunks[:, 0] <= day) & (day < chunks[:, 1]) & ((chunks[:, 2] == -1) | (chunks[:, 2] == branch))


def hydrate(candidates: DataFrame, chunks: DataFrame, versions: DataFrame, documents: DataFrame, document_branches: DataFrame) -> DataFrame:
    """Candidates with their version, document and the array of branches of the document."""
    branches = document_branches.groupBy("document_id").agg(F.array_sort(F.collect_set("branch_id")).alias("branch_ids"))
    out = candidates.join(chunks, "chunk_id").join(versions, "version_id").join(documents, "document_id").join(branches, "document_id", "left")
    return out.withColumn("branch_ids", F.coalesce("branch_ids", F.array().cast("array<int>")))


def lsh_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, bucket_length: float = 0.5, tables: int = 12, radius: float = 1.3) -> DataFrame:
    """Approximate vector top-k: random-projection hashing of unit vectors, then exact cosine of what collides.

    A pair counts if it shares a bucket of any table and lies within ``radius``. Hashes travel as tags of the blocks of
    :func:`vector_topk`, so a colliding pair is a bit of a mask and never a row: what is shuffled does not depend on how wide buckets are.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = lambda df, key: df.filter(F.col("vector").isNotNull() & (norm > 0)).select(key, "vector", array_to_vector(F.transform("vector", lambda x: x.cast("double") / norm)).alias("unit"))
    q, c = unit(queries, "question_id"), unit(vectors, "chunk_id")
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=11).fit(c)
    tags = tuple(f"hash_{n}" for n in range(tables))
    hashed = lambda df: model.transform(df).select(*df.columns[:2], *(vector_to_array(F.col("hashes")[n])[0].alias(t) for n, t in enumerate(tags)))

    def collide(a: np.ndarray, b: np.ndarray, scores: np.ndarray) -> np.ndarray:
        met = np.zeros(scores.shape, bool)
        for n in range(tables):
            met |= a[:, None, n] == b[None, :, n]
        return met & (scores > 1 - radius**2 / 2)  # of unit vectors, the squared distance is twice what the cosine lacks to 1

    return vector_topk(hashed(q), hashed(c), k, tags=tags, allowed=collide)

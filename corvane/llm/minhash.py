"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import connected_components
from corvane.llm.runtime import drop_materialised, materialise, utf8
from corvane.llm.wordhash import mix, shingle_sets

SLOTS = 1 << 18


class Circulant:
    """Signatures from two permutations of ``SLOTS`` slots.

    The first permutation scatters a shingle's slot once; coordinate k is the least value of the second,
    shifted circularly by k, over the scattered slots. All coordinates of a shingle are therefore one
    contiguous window of the second permutation, and a signature is the columnwise minimum of windows.
    """

    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows, n = bands, rows, bands * rows
        self.scatter = rng.permutation(SLOTS)
        shifted = rng.permutation(SLOTS).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([shifted, shifted[: n - 1]]), n)
        self.places = rng.integers(1, 2**63, (1, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(1, 2**63, bands, dtype=np.uint64)

    def signature(self, shingle_set: np.ndarray) -> np.ndarray:
        at = self.scatter[(shingle_set >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)]
        least = self.windows[at[:8192]].min(axis=0)
        for k in range(8192, len(at), 8192):
            np.minimum(least, self.windows[at[k : k + 8192]].min(axis=0), out=least)
        return least

    def band_hashes(self, signature: np.ndarray) -> np.ndarray:
        parts = signature.reshape(self.bands, self.rows).astype(np.uint64) * self.places
        return mix(parts.sum(axis=1, dtype=np.uint64) + self.salt).view(np.int64)


def set_hash(values: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set of shingle hashes, as two signed integers."""
    return values.sum(dtype=np.uint64).view(np.int64), mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): the set's size, a 128-bit hash of it, and its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(bands, rows)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n = batch.num_rows
            sizes, a, b = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            found: list[np.ndarray] = []
            for row, values in shingle_sets(data, offsets, width):
                sizes[row] = len(values)
                if len(values):
                    a[row], b[row] = set_hash(values)
                    found.append(circulant.band_hashes(circulant.signature(values)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(a), pa.array(b), band_lists(found, sizes > 0, bands)], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"]
            )

    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def band_lists(found: list[np.ndarray], present: np.ndarray, bands: int) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(present * bands)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))


def class_sets(classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``classes(node, rep, set_a, set_b)`` -> (node, values): the set as sorted 64-bit integers.

    An id may stand on several texts: only the text whose set has the class's hash counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = list(zip(*(batch.column(k).to_pylist() for k in (1, 2)), strict=True))
            data, offsets = utf8(batch.column(3))
            rows, values = [], []
            for row, found in shingle_sets(data, offsets, width):
                if len(found) and set_hash(found) == wanted[row]:
                    rows.append(row)
                    values.append(found.tobytes())
            nodes = batch.column(0).take(pa.array(rows, pa.int64()))
            for i in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([nodes[i : i + 512], pa.array(values[i : i + 512], pa.binary())], names=["node", "values"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    return classes.join(texts, "rep").select("node", "set_a", "set_b", "text").mapInArrow(run, "node long, values binary")


def long_bands(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """``sets(node, n, values)`` -> (node, n, bands) with bands of more rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(bands, rows, seed=11)
        for batch in batches:
            found = [circulant.band_hashes(circulant.signature(np.frombuffer(v.as_py(), np.uint64))) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], band_lists(found, np.ones(len(found), bool), bands)], names=["node", "n", "bands"])

    return sets.select("node", "n", "values").mapInArrow(run, "node long, n long, bands array<long>")


def forest(ids: list[int], side: np.ndarray, cluster: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of pairs with 100 * intersection >= percent * union.

    Only pairs of different clusters count, and of different sides where both sides are present.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    shared = np.zeros((len(sets), len(sets)), np.float32 if sizes.max(initial=0) < 1 << 24 else np.float64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    common = np.bincount(column, minlength=1) > 1
    keep = common[column] if len(column) else new
    column, owner = (np.cumsum(common) - 1)[column[keep]], owner[keep]
    width = int(common.sum())
    for lo in range(0, width, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        has = np.zeros((len(sets), min(4096, width - lo)), shared.dtype)
        has[owner[i:j], column[i:j] - lo] = 1
        shared += has @ has.T
    inter = np.rint(shared).astype(np.int64)
    linked = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
    linked &= (sizes[:, None] > 0) & (sizes[None, :] > 0) & (cluster[:, None] != cluster[None, :])
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    left, right = np.nonzero(np.triu(linked, 1))
    up = list(range(len(sets)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    edges = []
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        if (p := top(x)) != (q := top(y)):
            up[p] = q
            edges.append((ids[x], ids[y]))
    return edges


def block_links(pairs: DataFrame, percent: int) -> DataFrame:
    """Rows (bucket, i, j, block, node, cluster, values), clustered and sorted by (bucket, i, j) -> links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list) -> list[tuple[int, int]]:
            rows = list({r[2]: r for r in rows}.values())  # rows of one node are equal
            if len(rows) < 2:
                return []
            side = np.array([r[1] != r[0][1] for r in rows])
            return forest([r[2] for r in rows], side, np.array([r[3] for r in rows]), [np.frombuffer(r[4], np.uint64) for r in rows], percent)

        held: list = []
        out: list[tuple[int, int]] = []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            rest = (batch.column(k).to_pylist() for k in (3, 4, 5))
            for key, block, node, cluster, values in zip(keys, *rest, batch.column(6), strict=True):
                if held and held[0][0] != key:
                    out += solve(held)
                    held = []
                held.append((key, block, node, cluster, values.as_py()))
            if out:
                yield edge_batch(out)
                out = []
        if held and (out := solve(held)):
            yield edge_batch(out)

    return pairs.mapInArrow(run, "a long, b long")


def star_links(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (first, salt, member, node, values), clustered and sorted by the first four -> links (first, node).

    In each (first, salt) the centre's own row comes before its members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, centre = (0, -1), np.zeros(0, np.uint64)
        for batch in batches:
            first, salt, member, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            lengths = pc.binary_length(batch.column(4)).to_numpy(zero_copy_only=False) // 8
            new = np.flatnonzero((np.diff(first) != 0) | (np.diff(salt) != 0)) + 1
            found: list[tuple[int, int]] = []
            for i, j in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                if (int(first[i]), int(salt[i])) != unit:
                    unit, centre = (int(first[i]), int(salt[i])), np.frombuffer(batch.column(4)[i].as_py(), np.uint64)
                some = np.arange(i, j)[member[i:j] == 1]
                if not len(some):
                    continue
                flat = np.frombuffer(b"".join(batch.column(4)[some[0] : some[-1] + 1].to_pylist()), np.uint64)
                size = lengths[some]
                at = np.minimum(np.searchsorted(centre, flat), len(centre) - 1)
                inter = np.add.reduceat(centre[at] == flat, np.cumsum(size) - size, dtype=np.int64)
                linked = some[100 * inter >= percent * (len(centre) + size - inter)]
                found += zip([unit[0]] * len(linked), node[linked].tolist(), strict=True)
            if found:
                yield edge_batch(found)

    return rows.mapInArrow(run, "a long, b long")


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def band_count(percent: int, rows: int, miss: float = 1e-7) -> int:
    """Bands of ``rows`` rows with which a pair at ``percent`` shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


class Matcher:
    """The steps of :func:`near_duplicates` that find links between set classes, over tables in the shared folder.

    ``sets(node, n, values)`` are the sets of all nodes that share a bucket. Labels (node, cluster) mark nodes that
    are known to be connected: equal labels mean one component, unequal ones nothing.
    """

    def __init__(self, percent: int, block: int, block_shingles: int) -> None:
        self.percent, self.block, self.block_shingles = percent, block, block_shingles
        self.made: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.made.append(materialise(df))
        return self.made[-1]

    def drop(self) -> None:
        for table in self.made:
            drop_materialised(table)

    def parts(self, count, total, size: int, shingles: int):
        return F.greatest(F.lit(1), F.ceil(count / size), F.ceil(total / shingles)).cast("int")

    def shared(self, banded: DataFrame) -> DataFrame:
        """``banded(node, n, bands)`` -> (bucket, first, m, total, node, n): members of buckets of two or more, first the smallest."""
        members = banded.select("node", "n", F.explode("bands").alias("bucket"))
        several = members.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("m"), F.sum("n").alias("total")).filter("m > 1")
        return self.keep(members.join(several, "bucket").select("bucket", "first", "m", "total", "node", "n"))

    def stars(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Links among ``pairs(first, m, total, node)``. A centre whose bucket is large goes to several tasks."""
        salt = F.pmod(F.xxhash64("node", F.lit("salt")), self.parts(F.col("m"), F.col("total"), 1024, 1_000_000))
        ends = F.explode(F.array(F.struct(F.lit(1).alias("member"), F.col("node").alias("end")), F.struct(F.lit(0).alias("member"), F.col("first").alias("end"))))
        rows = pairs.select("first", salt.alias("salt"), ends.alias("e")).select("first", "salt", "e.member", F.col("e.end").alias("node")).distinct()
        full = rows.join(sets.select("node", "values"), "node").select("first", "salt", "member", "node", "values")
        return self.keep(star_links(full.repartition("first", "salt").sortWithinPartitions("first", "salt", "member", "node"), self.percent))

    def hook(self, labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels after more links: of two linked clusters the greater takes the smaller's label, then that one's own."""
        side = lambda c, to: labels.select(F.col("node").alias(c), F.col("cluster").alias(to))
        ends = links.join(side("a", "ca"), "a").join(side("b", "cb"), "b").filter("ca <> cb")
        move = self.keep(ends.groupBy(F.greatest("ca", "cb").alias("cluster")).agg(F.min(F.least("ca", "cb")).alias("to")))
        jump = move.join(move.select(F.col("cluster").alias("to"), F.col("to").alias("top")), "to", "left").select("cluster", F.coalesce("top", "to").alias("to"))
        return self.keep(labels.join(jump, "cluster", "left").select("node", F.coalesce("to", "cluster").alias("cluster")))

    def rest(self, shared: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What the firsts' stars leave: (bucket, node, cluster) without the firsts, and the buckets that hold several clusters.

        Buckets with the same members count once. ``major`` is a bucket's largest cluster, ``centre`` some member of
        it, ``minors`` the number of members outside it.
        """
        placed = self.keep(shared.filter("node <> first").join(labels, "node").select("bucket", "node", "n", "cluster"))
        each = placed.groupBy("bucket", "cluster").agg(
            F.count("*").alias("m"), F.sum("n").alias("total"), F.min_by("node", F.xxhash64("node", F.lit("centre"))).alias("centre"),
            F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64("node", F.lit("h"))).alias("g"),
        )
        largest = F.struct("m", "cluster")
        of_bucket = each.groupBy("bucket").agg(
            F.count("*").alias("clusters"), F.max_by("cluster", largest).alias("major"), F.max_by("centre", largest).alias("centre"), F.max("m").alias("majors"), F.max_by("total", largest).alias("major_total"),
            F.sum("m").alias("m"), F.sum("total").alias("total"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"),
        )
        once = [F.min(c).alias(c) for c in ("bucket", "major", "centre", "majors", "major_total", "m", "total")]
        several = of_bucket.filter("clusters > 1").groupBy("h", "g").agg(*once)
        return placed, self.keep(several.withColumn("minors", F.col("m") - F.col("majors")).withColumn("minor_total", F.col("total") - F.col("major_total")).drop("h", "g"))

    def settle(self, shared: DataFrame, labels: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame, DataFrame]:
        """Labels and links after stars, and what they leave of ``shared`` as :meth:`rest` gives it.

        First every bucket's first is a centre, then some member of each bucket's largest cluster, for the members outside it.
        """
        links = [self.stars(shared.filter("node <> first"), sets)]
        labels = self.hook(labels, links[0])
        placed, several = self.rest(shared, labels)
        wide = several.filter(F.col("minors") > self.block // 8).select("bucket", "major", F.col("centre").alias("first"), F.col("minors").alias("m"), F.col("minor_total").alias("total"))
        links.append(self.stars(placed.join(wide, "bucket").filter("cluster <> major"), sets))
        if not links[1].isEmpty():
            labels = self.hook(labels, links[1])
            placed, several = self.rest(shared, labels)
        return labels, links, placed, several

    def blocks(self, placed: DataFrame, several: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between different clusters of one bucket: minors with each other and with the members of the major.

        Both are dealt into blocks; each pair of blocks with a minor one is a unit of work that emits a spanning
        forest of its links. A major is shipped once for each block of minors.
        """
        n_minor = self.parts(F.col("minors"), F.col("minor_total"), self.block, self.block_shingles)
        n_major = self.parts(F.col("majors"), F.col("major_total"), 4 * self.block, 2 * self.block_shingles)
        at = several.select("bucket", "major", n_minor.alias("n_minor"), n_major.alias("n_major"))
        is_major, spread = F.col("cluster") == F.col("major"), F.xxhash64("node", F.lit("block"))
        own = F.when(is_major, F.col("n_minor") + F.pmod(spread, F.col("n_major"))).otherwise(F.pmod(spread, F.col("n_minor"))).cast("int")
        last = F.when(is_major, F.col("n_minor") - 1).otherwise(F.col("n_minor") + F.col("n_major") - 1)
        dealt = placed.join(at, "bucket").select("bucket", "node", "cluster", own.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
        keyed = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "cluster")
        rows = keyed.join(sets.select("node", "values"), "node").select("bucket", "i", "j", "block", "node", "cluster", "values")
        return self.keep(block_links(rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"), self.percent))


def shared_id_links(full: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) between the set classes of texts that stand under one id; none if no id has two sets."""
    ends = [f(c).alias(f"{c}_{n}") for c in ("set_a", "set_b") for n, f in (("least", F.min), ("most", F.max))]
    several = full.filter("doc_id is not null").groupBy("doc_id").agg(*ends).filter("set_a_least <> set_a_most or set_b_least <> set_b_most").select("doc_id")
    if several.isEmpty():
        return None
    rows = full.join(several, "doc_id", "left_semi").select("doc_id", "set_a", "set_b").distinct().join(classes, ["set_a", "set_b"]).select("doc_id", "node")
    return rows.join(rows.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b").filter("a <> b")


def near_duplicates(
    docs: DataFrame, percent: int = 85, width: int = 5, bands: int = 25, rows: int = 5, long_rows: int = 10, hot: int = 512, block: int = 256, block_shingles: int = 200_000
) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, n_shingles, component_id, kept), one row per row.

    Two documents are linked when 100 * |intersection| >= ``percent`` * |union| of their sets of distinct
    ``width``-word shingles; ``component_id`` is the smallest doc_id reachable over links.

    1. Every text becomes a set size, a 128-bit set hash and ``bands`` band hashes of a circulant MinHash
       signature. Texts of equal sets are one class before anything is paired. A pair at similarity 0.85 shares
       no band with probability (1 - 0.85**5)**25 = 4e-7.
    2. In each band bucket the first member is compared with every other on full sets, and the verified links
       are contracted to clusters: a bucket of near copies of its first is settled by as many comparisons as it
       has members. Members outside the largest cluster meet a second centre from it.
    3. A bucket that still holds several clusters is settled in blocks: the members outside its largest cluster
       with each other and with that cluster. Buckets with the same members count once. Where more than ``hot``
       members stand outside, they are first dealt anew by bands of ``long_rows`` rows, as many as keep the
       chance of a missed pair below 1e-7, and steps 2 and 3 run on those buckets.
    4. Components over the verified links. Texts under one doc_id belong to one document, so they are linked.

    Null, empty and blank texts have an empty set, link with nothing and keep their own id. Rows that repeat
    a text share a component; a row with a null id gets the component of its text, null if alone. Other columns
    are ignored, whatever their names. An empty table gives an empty result.
    """
    m = Matcher(percent, block, block_shingles)
    sketch = materialise(sketches(docs, width, bands, rows))
    full = sketch.filter("n_shingles > 0")
    grouped = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    classes = m.keep(grouped.filter("rep is not null").withColumn("node", F.monotonically_increasing_id()))

    shared = m.shared(classes)
    involved = shared.select("node").distinct().join(classes.select("node", "rep", "set_a", "set_b"), "node")
    values = class_sets(involved, docs, width)
    sets = m.keep(values.withColumn("n", (F.octet_length("values") / 8).cast("long")))
    labels, links, placed, several = m.settle(shared, sets.select("node", F.col("node").alias("cluster")), sets)
    crowded = several.filter(F.col("minors") > hot)
    if not crowded.isEmpty():
        nodes = placed.join(crowded.select("bucket"), "bucket", "left_semi").select("node").distinct()
        longer = m.shared(m.keep(long_bands(sets.join(nodes, "node", "left_semi"), band_count(percent, long_rows), long_rows)))
        _, more, long_placed, long_several = m.settle(longer, labels, sets)
        links += more
        placed, several = placed.unionByName(long_placed), several.filter(F.col("minors") <= hot).unionByName(long_several)
    links.append(m.blocks(placed, several, sets))
    if (same_id := shared_id_links(full, classes)) is not None:
        links.append(same_id)
    clusters = m.keep(connected_components(reduce(DataFrame.unionByName, links)).select("node", F.col("component").alias("cluster")))

    placed = classes.join(clusters, "node", "left").select("set_a", "set_b", "rep", F.coalesce("cluster", "node").alias("cluster"))
    least = placed.groupBy("cluster").agg(F.min("rep").alias("component"))
    final = materialise(placed.join(least, "cluster").select("set_a", "set_b", "component"))
    m.drop()
    out = sketch.join(final, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))

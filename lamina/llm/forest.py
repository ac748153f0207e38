"""Embedding near-duplicates with a forest of random-projection trees.

A node of a tree splits at the median of a random projection of its own, recursively; vectors within `spill` quantiles of a median go to both
sides. Medians are fitted on a bounded sample, yet every vector is routed. Vectors that share a leaf of any tree are compared in
double precision, and those at or over the threshold link. Equal vectors are routed once. A pair that meets in several leaves counts in the least of
them, which both vectors' lists of leaves tell, so a leaf returns a count and a root for each vector and never its pairs. Where the sample allows no deeper trees, leaves are compared
in pairs of blocks that go to many tasks. Vectors of each length have a forest of their own.

Groups that outgrow a leaf never meet the trees. The sample shows where they are: a pivot amid each, whose core are the vectors within
the threshold's angle of it. What links with a vector of the core lies within twice that angle, in the shell. Core and shell are
compared whole, in pairs of blocks that go to many tasks; the trees get the vectors outside all cores.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import cut, read
from lamina.operators.components import components

TREES = 8
LEAF = 256
SPILL = 0.05
#: Bytes of vectors that the medians are fitted on, at most, as single-precision numbers; trees get no deeper than FEWEST sampled vectors a leaf allow.
SAMPLE = 96 << 20
FEWEST = 8
BLOCK = 1024
#: Sampled vectors that show a group, and vectors of a group that the trees are spared, at least.
SEEN = 32
CROWD = 512
#: A core or shell is cut into about so many blocks, of so many vectors at least and at most.
CUTS, LEAST, MOST = 8, 1024, 16_384
#: For rounding, in radians.
SLACK = 1e-6


def packed(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, key, vec): the doubles of each vector and their digest, both null if it can't link (null, zero, or a null or non-finite component)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, vecs = [], []
            for v in b.column("v").to_pylist():
                x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
                x = x + 0.0  # no negative zeros
                good = len(x) > 0 and bool(np.isfinite(x).all()) and bool((x != 0).any())
                vecs.append(x.tobytes() if good else None)
                keys.append(hashlib.blake2b(vecs[-1], digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "key", "vec"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(work, "vec_id long, key binary, vec binary")


def _unit(raw: list[bytes]) -> np.ndarray:
    """Unit vectors of equal length."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def directions(nodes: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """The random directions of nodes, of +1 and -1: the bits of mixed hashes of seed, node and place."""
    x = (nodes.astype(np.uint64)[:, None] << np.uint64(16)) + np.arange(1, -(-dim // 64) + 1, dtype=np.uint64) + (np.uint64(seed) << np.uint64(56))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8), axis=1)[:, :dim] * 2.0 - 1.0


class Forest:
    """Trees over unit vectors of one length; for each inner node the bounds between which a vector goes both ways."""

    def __init__(self, sample: np.ndarray, n: int, trees: int, leaf: int, spill: float, seed: int) -> None:
        deepest = int(math.log2(max(1, len(sample) / FEWEST)))
        self.levels = max(0, min(deepest, math.ceil(math.log2(max(1, n / leaf)))))
        self.trees = trees if self.levels else 1
        self.seed = seed
        # vectors of a leaf are compared in so many blocks
        self.cuts = max(1, math.ceil(n / (1 << self.levels) / (8 * leaf)))
        self.low = np.zeros((self.trees, 1 << self.levels))
        self.high = np.zeros((self.trees, 1 << self.levels))
        for t in range(self.trees):
            node = np.ones(len(sample), np.int64)
            for level in range(self.levels):
                first = 1 << level
                x = self.project(sample, np.arange(len(sample)), node, t)
                order = np.lexsort((x, node))
                starts = np.searchsorted(node[order], np.arange(first, 2 * first + 1))
                sizes = np.diff(starts)
                at = lambda q: np.where(sizes > 0, x[order[np.minimum(starts[:-1] + (q * np.maximum(sizes - 1, 0)).astype(np.int64), len(x) - 1)]], 0.0)  # noqa: B023, E731
                self.low[t, first : 2 * first], self.high[t, first : 2 * first] = at(0.5 - spill), at(0.5 + spill)
                node = 2 * node + (x >= at(0.5)[node - first])

    def project(self, x: np.ndarray, row: np.ndarray, node: np.ndarray, tree: int) -> np.ndarray:
        """The projections of rows of x on the directions of their nodes."""
        out = np.zeros(len(row))
        names, of = np.unique(node, return_inverse=True)
        if len(names) * 64 < len(row):
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(len(names) + 1)).tolist()
            for d, s, e in zip(directions(names + (tree << 32), x.shape[1], self.seed), ends, ends[1:], strict=False):
                out[order[s:e]] = x[row[order[s:e]]] @ d
            return out
        for at in range(0, len(row), 1 << 14):
            some = slice(at, at + (1 << 14))
            own, back = np.unique(of[some], return_inverse=True)
            out[some] = np.einsum("ij,ij->i", x[row[some]], directions(names[own] + (tree << 32), x.shape[1], self.seed)[back])
        return out

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each unit vector falls in; leaves are numbered through all trees."""
        rows, names = [], []
        for t in range(self.trees):
            row, node = np.arange(len(x)), np.ones(len(x), np.int64)
            for _ in range(self.levels):
                v = self.project(x, row, node, t)
                left, right = v < np.maximum(self.high[t, node], np.nextafter(self.low[t, node], np.inf)), v >= self.low[t, node]
                row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
            rows.append(row)
            names.append((node - (1 << self.levels)) + (t << self.levels))
        return np.concatenate(rows), np.concatenate(names)


def pivots(sample: np.ndarray, n: int, threshold: float, leaf: int, seed: int, crowd: int = CROWD) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors amid the groups of about `crowd` or more of the `n` vectors, and which of the sample are in no core.

    A group that outgrows a leaf fills whole leaves of a tree, so each leaf offers its sampled vector with most links; the mean of what
    that links with is the pivot, unless the vector's own core is larger.
    """
    least = max(SEEN, math.ceil(crowd * len(sample) / max(n, 1)))
    free = np.ones(len(sample), bool)
    found: list[np.ndarray] = []
    if len(sample) < least:
        return np.zeros((0, sample.shape[1])), free
    row, name = Forest(sample, n, 1, max(leaf, crowd // 2), 0.0, seed).leaves(sample)
    order = np.argsort(name, kind="stable")
    nodes = np.split(row[order], np.flatnonzero(np.diff(name[order])) + 1)
    radius = math.cos(min(math.acos(max(-1.0, min(1.0, threshold))) + SLACK, math.pi))
    more = True
    while more:
        more = False
        for node in nodes:
            own = node[free[node]][:crowd]
            if len(own) < SEEN // 4:
                continue
            x = sample[own]
            links = (x @ x.T >= threshold).sum(1)
            if links.max() < SEEN // 4:
                continue
            one = x[links.argmax()]
            core = free & (sample @ one >= radius)
            middle = sample[core].sum(0)
            middle /= np.linalg.norm(middle)
            wide = free & (sample @ middle >= radius)
            pivot, core = (middle, wide) if wide.sum() >= core.sum() else (one, core)
            if core.sum() >= least:
                found.append(pivot)
                free &= ~core
                more = True
    return np.array(found, np.float64).reshape(len(found), sample.shape[1]), free


def _cores(x: np.ndarray, centre: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first pivot whose core each unit vector is in (-1: none), and (row, pivot) of every shell that it is in."""
    if not len(centre):
        return np.full(len(x), -1), np.zeros(0, np.int64), np.zeros(0, np.int64)
    angle = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    p = x @ centre.T
    inside = p >= math.cos(min(angle, math.pi))
    core = np.where(inside.any(1), inside.argmax(1), -1)
    row, pivot = np.nonzero(p >= math.cos(min(2 * angle, math.pi)))
    return core, row, pivot


def _tile_links(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row that each row and each column of the tile `near` reaches; as many as rows and columns if it reaches none."""
    rows, cols = near.shape
    big = rows + cols
    left, right = np.where(near.any(1), np.arange(rows), big), np.full(cols, big)
    while True:
        right = np.minimum(right, np.where(near, left[:, None], big).min(0))
        new = np.minimum(left, np.where(near, right[None], big).min(1))
        if (new == left).all():
            break
        left = new
    return left, right


LINKS = "id long, links long, root long"


def _compared(ids: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, counted: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows link and the least row that each reaches, of the rows `a` with the rows `b`, tile by tile; counted(near, p, q) adds up the pairs of a tile."""
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(a), BLOCK):
        p = a[s : s + BLOCK]
        for t in range(0, len(b), BLOCK):
            q = b[t : t + BLOCK]
            near = (x[p] @ x[q].T >= threshold) & (ids[p][:, None] != ids[q][None])
            if not near.any():
                continue
            counted(near, p, q)
            left, right = _tile_links(near)
            for own, at in ((p, left), (q, right)):
                linked = at < len(p) + len(q)
                ends.append((own[linked], p[at[linked]]))
    label, linked = np.arange(len(ids)), np.zeros(len(ids), bool)
    if ends:
        i, j = (np.concatenate(z) for z in zip(*ends, strict=True))
        linked[i] = True
        while True:
            old = label.copy()
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (old == label).all():
                break
    return linked, label


def _in_blocks(threshold: float):
    """Links of a block of a core with a block of its shell."""

    def work(table: pa.Table) -> pa.Table:
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy().astype(np.float64)
        inner, mine = np.asarray(table.column("inner").to_pylist(), bool), np.asarray(table.column("mine").to_pylist(), bool)
        x = _unit(table.column("vec").to_pylist())
        count = np.zeros(len(ids))

        def counted(near: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
            whole = near.astype(np.float64)
            count[p] += whole @ n[q]
            count[q] += np.where(inner[q], 0, n[p] @ whole)  # those in a core count in their own core's blocks

        linked, label = _compared(ids, x, np.flatnonzero(mine), np.flatnonzero(~mine), threshold, counted)
        return pa.table({"id": ids[linked], "links": count[linked].astype(np.int64), "root": ids[label[linked]]})

    return work


def _core_links(distinct: DataFrame, centres: dict[int, tuple[int, np.ndarray]], threshold: float) -> DataFrame:
    """(id, links, root) of the pairs of which one at least is in a core; centres: by bytes of a vector, the number of the first pivot, and the pivots."""
    spark = distinct.sparkSession
    held = spark.sparkContext.broadcast(centres)

    def shells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, size in _alike(batches):
            if size not in held.value:
                continue
            first, centre = held.value[size]
            core, row, pivot = _cores(_unit(b.column("vec").to_pylist()), centre, threshold)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pivot + first, pa.int64()), pa.array(core[row] >= 0), pa.array(core[row] == pivot), *[b.column(c).take(at) for c in ("id", "n", "vec")]], ["pivot", "inner", "own", "id", "n", "vec"]
            )

    shell = cut(distinct.select("bytes", "id", "n", "vec").mapInArrow(shells, "pivot long, inner boolean, own boolean, id long, n long, vec binary"), "shells")
    blocks = lambda c: F.ceil(c / F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.ceil(c / CUTS)))).cast("int")
    sizes = shell.groupBy("pivot").agg(blocks(F.sum(F.col("own").cast("long"))).alias("cores"), blocks(F.count("*")).alias("shells"))
    dealt = shell.join(F.broadcast(sizes), "pivot")
    of = lambda many: F.pmod(F.xxhash64("id"), F.col(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    cols = ("pivot", "inner", "id", "n", "vec")
    a = dealt.where("own").select(*cols, of("cores").alias("p"), each("shells").alias("q"), F.lit(True).alias("mine"))
    b = dealt.where("cores > 0").select(*cols, of("shells").alias("q"), each("cores").alias("p"), F.lit(False).alias("mine"))
    return a.unionByName(b).groupBy("pivot", "p", "q").applyInArrow(_in_blocks(threshold), LINKS)


def _alike(batches: Iterator[pa.RecordBatch], most: int = 2048) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Parts of batches whose vectors have the same length, and the bytes of one."""
    for whole in batches:
        for start in range(0, whole.num_rows, most):
            b = whole.slice(start, most)
            sizes = b.column("bytes").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                yield b.take(pa.array(np.flatnonzero(sizes == size))), size


def _in_leaf(threshold: float):
    """Links of a leaf's vectors, or of the pairs of its blocks p and q."""

    def work(table: pa.Table) -> pa.Table:
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        leaf, first, other = (int(table.column(c)[0].as_py()) for c in ("leaf", "p", "q"))
        block = table.column("own").to_numpy()
        lists = table.column("leaves").to_pylist()
        width = max(map(len, lists))
        # only leaves before this one matter; rows are padded with values that never match
        own = np.full((len(ids), width), -1, np.int64)
        for i, x in enumerate(lists):
            own[i, : len(x)] = x
        x = _unit(table.column("vec").to_pylist())
        count = np.zeros(len(ids), np.int64)
        a, b = np.flatnonzero(block == first), np.flatnonzero(block == other)

        def counted(near: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
            i, j = np.nonzero(near)
            i, j = p[i], q[j]
            if first == other:  # each pair once
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 1 << 16):
                u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                before = np.zeros(len(u), bool)
                for k in range(width):
                    mine = own[u, k]
                    before |= ((mine[:, None] == own[v]).any(1)) & (mine >= 0) & (mine < leaf)
                np.add.at(count, u[~before], n[v[~before]])
                np.add.at(count, v[~before], n[u[~before]])

        linked, label = _compared(ids, x, a, b, threshold, counted)
        return pa.table({"id": ids[linked], "links": count[linked], "root": ids[label[linked]]})

    return work


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE, seed: int = 5, crowd: int = CROWD, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors of different lengths not with each other.
    Equal vectors link with each other. Rows with a null id count as vectors, are
    never a component's least, and have kept false. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = cut(packed(vectors, id_col, vec_col), "vectors")
    of = rows.where("vec is not null").groupBy("key").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    distinct = cut(of.withColumn("id", F.monotonically_increasing_id()).withColumn("bytes", F.length("vec")), "distinct")
    total = distinct.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    n, most = total["n"], int(total["n"] * min(1.0, sample / max(1, (total["bytes"] or 0) // 2)))
    some = distinct.where(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 30)) < int(0.95 * most / max(n, 1) * (1 << 30)) if most < n else F.lit(True)).select("bytes", "vec").limit(max(most, 1)).toArrow()
    sizes = some.column("bytes").to_numpy()
    forests, centres, first = {}, {}, 0
    for size in np.unique(sizes).tolist():
        drawn = _unit([v for v, s in zip(some.column("vec").to_pylist(), sizes.tolist(), strict=True) if s == size])
        many = math.ceil(n * len(drawn) / len(sizes))
        centre, free = pivots(drawn, many, threshold, leaf, seed, crowd)
        forests[size] = Forest(drawn[free], math.ceil(many * free.sum() / len(drawn)), trees, leaf, spill, seed), centre
        if len(centre):
            centres[size] = first, centre
            first += len(centre)
    del some
    forest = spark.sparkContext.broadcast(forests)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, size in _alike(batches):
            x = _unit(b.column("vec").to_pylist())
            # a length of which the sample has none is one leaf
            trees_, middle = forest.value.get(size) or (Forest(x[:0], 0, 1, 1, 0.0, seed), x[:0])
            outside = np.flatnonzero(_cores(x, middle, threshold)[0] < 0)
            row, name = trees_.leaves(x[outside])
            row = outside[row]
            order = np.lexsort((name, row))
            row, name = row[order], name[order]
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(name, pa.int64()))
            at = pa.array(row)
            columns = {"leaf": pa.array(name, pa.int64()), "cuts": pa.array(np.full(len(row), trees_.cuts, np.int32)), **{c: b.column(c).take(at) for c in ("bytes", "id", "n", "vec")}, "leaves": lists.take(at)}
            yield pa.RecordBatch.from_pydict(columns)

    routed = distinct.select("bytes", "id", "n", "vec").mapInArrow(route, "leaf long, cuts int, bytes int, id long, n long, vec binary, leaves array<long>")
    own = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    met = routed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    met = met.select("bytes", "leaf", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "n", "vec", "leaves")
    found = met.groupBy("bytes", "leaf", "p", "q").applyInArrow(_in_leaf(threshold), LINKS)
    if centres:
        found = found.union(_core_links(distinct, centres, threshold))
    found = cut(found, "links")
    labels = cut(components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))), "labels")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = distinct.select("key", "least", "n", "id").join(links, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = named.withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    info = cut(named.join(least, "component").select("key", (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("n_links"), "component_id"), "info")
    out = rows.select("vec_id", "key").join(info, "key", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")), F.lit(False)).alias("kept"),
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector. Rows as for `near_duplicates`."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))

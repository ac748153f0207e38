"""SimHash near-duplicates: fingerprints, key shards and BK-trees whose edges are integer Hamming distances.

Each shard is the set of fingerprints that agree in the bits of one key. Its members form a BK-tree (children keyed by
their distance to the parent); a search follows only the edges within the radius. The trees of a shuffle partition are
built and searched together, level by level, on flat arrays.

A shard of over `most` fingerprints is hot. Some PIVOTS of its members form a tree, and all its members are searched in it; those that
link with one part of the pivots are known to be joined. Only the members outside the largest part so joined are made into trees again, which
all members of the shard are searched in: every pair that is not known to be joined is met, and work is in proportion to the shard times what lies outside.
These trees are broadcast while they hold BROADCAST fingerprints at most; beyond, they meet salted slices of the shard, batch by batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import jaccard
from lamina.llm.common import bound_batches, cut, joined, read, runs, shingles, slices
from lamina.operators.components import components

FRONTIER = 1 << 18  # (query, node) pairs that a search holds at once, about
#: Fingerprints of trees that are broadcast, at most (8 or 32 bytes each), and queries that meet one copy of a larger set of trees.
BROADCAST = 1 << 18
QUERIES = 1 << 16
#: Members that join a crowded group before its others search: in a task, and (pivots, about) in a hot shard.
HEADS = 8
PIVOTS = 64
#: Fingerprints of an evenly filled shard of drawn keys, and the chance that drawn keys and radius lose a pair of just the similarity wanted.
SHARD = 128
MISS = 0.002


def fingerprint(text: bytes, k: int = 4) -> bytes:
    """Big-endian SimHash of 64 bits of a text's shingles, repeats included; a shingle's hash is its XXH64 with seed 42."""
    parts = shingles(text, k)
    if not parts:
        return bytes(8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(parts), 1 << 14):
        some = parts[at : at + (1 << 14)]
        raw = b"".join([xxhash.xxh64_digest(s, 42) for s in some])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(some), 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(parts)).tobytes()


def wide(hashes: np.ndarray, bits: int) -> bytes:
    """SimHash of `bits` bits, a multiple of 64, of a set of 64-bit hashes, each mixed anew for every 64 bits."""
    if not len(hashes):
        return bytes(bits // 8)
    ones = np.zeros(bits, np.int64)
    steps = np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 1 << 14):
        x = hashes[at : at + (1 << 14), None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(doc_id, fp binary) for each row; a null text counts as empty, a null id stays null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(t, k) for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "fp"])

    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return bound_batches(some).mapInArrow(work, "doc_id long, fp binary")


def pigeonhole(bits: int, radius: int, n: int) -> list[np.ndarray]:
    """Bit sets of which two fingerprints within `radius` share one at least: all choices of `a` of radius + a blocks.

    `a` grows with the number of fingerprints, so that a key's shard stays small for evenly spread ones.
    """
    for a in (1, 2, 3, 4):
        blocks = np.array_split(np.arange(bits), radius + a)
        if n <= 4 * 2 ** (a * (bits // (radius + a))) or a == 4:
            return [np.concatenate(c) for c in combinations(blocks, a)]
    raise AssertionError


def agreement(similarity: float) -> float:
    """The share of bits in which the fingerprints of two sets of that Jaccard similarity agree."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def _lost(bits: int, agree: float, radius: int, size: int, many: int) -> float:
    """The chance that a pair whose bits agree with a chance of `agree` differs in more than `radius` or in each of `many` drawn sets of `size`."""
    lost = 0.0
    for d in range(bits + 1):
        weight = math.exp(math.lgamma(bits + 1) - math.lgamma(d + 1) - math.lgamma(bits - d + 1) + d * math.log1p(-agree) + (bits - d) * math.log(agree))
        hit = math.prod(max(0, bits - d - i) / (bits - i) for i in range(size))
        lost += weight * (1.0 if d > radius else (1 - hit) ** many)
    return lost


def sampled_keys(bits: int, agree: float, radius: int, n: int, miss: float = MISS, seed: int = 11) -> list[np.ndarray]:
    """Seeded random bit sets, for `n` fingerprints of which shards are to hold about SHARD.

    So many that a pair of agreement `agree` is lost, by them or by the radius, with a chance of `miss` at most at any n.
    """
    size = max(12, math.ceil(math.log2(max(n, 1) / SHARD)))
    low, high = 1, 2
    while _lost(bits, agree, radius, size, high) > miss:
        low, high = high, 2 * high
        if high > 1 << 20:
            raise ValueError("the radius alone loses more than that")
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if _lost(bits, agree, radius, size, middle) > miss else (low, middle)
    rng = np.random.default_rng(seed)
    return [rng.permutation(bits)[:size] for _ in range(high)]


def _keyed(fps: DataFrame, keys: list[np.ndarray]) -> DataFrame:
    """(key, fp): each fingerprint once under each key; the number of the bit set is part of the key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column("fp").to_pylist()
            on = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), axis=1)
            fp = pa.array(raw, pa.binary())
            for j, bits in enumerate(keys):
                key = on[:, bits].astype(np.int64) @ (1 << np.arange(len(bits), dtype=np.int64)) + (j << 48)
                yield pa.RecordBatch.from_arrays([pa.array(key), fp], ["key", "fp"])

    return fps.select("fp").mapInArrow(work, "key long, fp binary")


def _words(raw: list[bytes]) -> np.ndarray:
    """Fingerprints as rows of uint64 words."""
    return np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(len(raw), -1)


class Trees:
    """A BK-tree for each group of fingerprints (rows of uint64 words; groups sorted, from 0)."""

    def __init__(self, fps: np.ndarray, group: np.ndarray) -> None:
        self.fps = fps
        self.base = fps.shape[1] * 64 + 1
        heads = runs(group)[:-1] if len(group) else np.zeros(0, np.int64)
        self.root = np.full(int(group[-1]) + 1 if len(group) else 0, -1, np.int64)
        self.root[group[heads]] = heads
        self.sizes = np.bincount(group, minlength=len(self.root))
        # every member walks down from its group's root; the first to take an edge becomes the child there
        active = np.delete(np.arange(len(fps)), heads)
        at = self.root[group]
        codes, kids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(active):
            code = at[active] * self.base + self._distance(fps[active], at[active])
            order = np.argsort(code, kind="stable")
            code, active = code[order], active[order]
            first = runs(code)
            child = active[first[:-1]]
            codes.append(code[first[:-1]])
            kids.append(child)
            at[active] = np.repeat(child, np.diff(first))
            active = np.delete(active, first[:-1])
        codes_, kids_ = np.concatenate(codes), np.concatenate(kids)
        order = np.argsort(codes_)
        self.codes, self.kids = codes_[order], kids_[order]

    def _distance(self, x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ self.fps[nodes]).sum(1, dtype=np.int64)

    def search(self, x: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row of x, member) within `radius`, of rows that name a group (-1: none), some at a time; edges that differ from the row's distance by more aren't followed."""
        queries = np.flatnonzero(group >= 0)
        sizes = self.sizes[group[queries]]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(FRONTIER, int(sizes.sum()) + FRONTIER, FRONTIER))
        for q in np.split(queries, np.unique(cuts)):
            node = self.root[group[q]]
            while len(q):
                d = self._distance(x[q], node)
                hit = d <= radius
                yield q[hit], node[hit]
                low = np.searchsorted(self.codes, node * self.base + np.maximum(d - radius, 0))
                many = np.searchsorted(self.codes, node * self.base + np.minimum(d + radius, self.base - 1), "right") - low
                q = np.repeat(q, many)
                step = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)
                node = self.kids[np.repeat(low, many) + step]

    def roots(self, group: np.ndarray, radius: int) -> np.ndarray:
        """The least member that each member reaches over links within its group.

        A few heads join a crowded group first; members of its largest part so joined need not search for each other.
        """
        label = np.arange(len(self.fps))
        large = np.flatnonzero(self.sizes[group] > 8 * HEADS)
        if len(large):
            first, many = self.root[group[large]], self.sizes[group[large]]
            for j in range(HEADS):
                head = first + many * j // HEADS
                near = self._distance(self.fps[large], head) <= radius
                label = joined(label, large[near], head[near])
        names, count = np.unique(label, return_counts=True)
        order = np.lexsort((count, group[names]))
        major = np.full(len(self.root), -1, np.int64)
        major[group[names[order]]] = names[order]  # the last written is the largest
        outside = np.where((label != major[group]) & (self.sizes[group] > 1), group, -1)
        for a, b in self.search(self.fps, outside, radius):
            label = joined(label, a, b)
        return label


def _links_of(raw: list[bytes], root: np.ndarray) -> pa.RecordBatch:
    rows = np.flatnonzero(root != np.arange(len(raw))).tolist()
    return pa.RecordBatch.from_arrays([pa.array([raw[i] for i in rows], pa.binary()), pa.array([raw[i] for i in root[rows].tolist()], pa.binary())], ["a", "b"])


def _in_shards(radius: int):
    """Spanning links (a, b) of the whole shards of a partition, sorted by key; none holds more than `most` rows."""

    def solve(key: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
        pick = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(pick):
            return _links_of([], np.zeros(0, np.int64))
        group = np.unique(group[pick], return_inverse=True)[1]
        own = [raw[i] for i in pick.tolist()]
        return _links_of(own, Trees(_words(own), group).roots(group, radius))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.zeros(0, np.int64), []
        for b in batches:
            if not b.num_rows:
                continue
            held_key = np.concatenate((held_key, b.column("key").to_numpy(zero_copy_only=False)))
            held += b.column("fp").to_pylist()
            if len(held) >= 200_000 and held_key[0] != held_key[-1]:
                end = int(np.flatnonzero(held_key != held_key[-1])[-1]) + 1
                yield solve(held_key[:end], held[:end])
                held_key, held = held_key[end:].copy(), held[end:]
        if held:
            yield solve(held_key, held)

    return work


KNOWN = "key long, fp binary, root binary, own boolean"


class _Known:
    """Answers queries: one row (key, fp, root, own) for each, root being that of the first pivot found; rows that aren't `own` link two roots that a query joins."""

    def __init__(self, radius: int, raw: list[bytes], root: list[bytes], group: np.ndarray) -> None:
        self.radius, self.trees = radius, Trees(_words(raw), group)
        names, self.of = np.unique(np.array(root, object), return_inverse=True) if root else (np.zeros(0, object), np.zeros(0, np.int64))
        self.names = names.tolist()

    def answer(self, key: np.ndarray, fp: list[bytes], group: np.ndarray) -> pa.RecordBatch:
        found = [np.unique(np.stack((row, self.of[node])), axis=1) for row, node in self.trees.search(_words(fp), group, self.radius) if len(row)]
        pair = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        first = np.ones(pair.shape[1], bool)
        first[1:] = pair[0, 1:] != pair[0, :-1]
        at = np.full(len(fp), -1, np.int64)
        at[pair[0, first]] = pair[1, first]
        joins = np.unique(np.stack((at[pair[0, ~first]], pair[1, ~first])), axis=1).T.tolist()
        name = lambda i: None if i < 0 else self.names[i]
        n = len(joins)
        keys = np.concatenate((key, np.full(n, key[0])))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array([*fp, *[name(a) for a, _ in joins]], pa.binary()), pa.array([*map(name, at.tolist()), *[name(b) for _, b in joins]], pa.binary()), pa.array(np.arange(len(keys)) < len(fp))], ["key", "fp", "root", "own"])


def _met(members: DataFrame, queries: DataFrame, radius: int, most: int) -> DataFrame:
    """KNOWN of all `queries` (key, fp) against the `members` (key, fp) of the same key."""
    spark = members.sparkSession
    sizes = cut(members.groupBy("key").agg(F.ceil(F.count("*") / most).cast("int").alias("trees")), "hot-trees")
    dealt = members.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))

    def rooted_in(table: pa.Table) -> pa.Table:
        raw = table.column("fp").to_pylist()
        root = Trees(_words(raw), group := np.zeros(len(raw), np.int64)).roots(group, radius)
        return table.select(["key", "part", "fp"]).append_column("root", pa.array([raw[i] for i in root.tolist()], pa.binary()))

    rooted = cut(dealt.groupBy("key", "part").applyInArrow(rooted_in, "key long, part int, fp binary, root binary"), "hot-rooted")
    if rooted.count() <= BROADCAST:
        held = rooted.select("key", "fp", "root").toArrow().sort_by("key")
        keys, group = np.unique(held.column("key").to_numpy(), return_inverse=True)
        shared = spark.sparkContext.broadcast((held.column("fp").to_pylist(), held.column("root").to_pylist(), group, keys))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            raw, root, group, keys = shared.value
            known = _Known(radius, raw, root, group)
            for b in batches:
                for start in range(0, b.num_rows, 2048):
                    key = b.column("key").slice(start, 2048).to_numpy(zero_copy_only=False)
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    yield known.answer(key, b.column("fp").slice(start, 2048).to_pylist(), np.where(keys[at] == key, at, -1))

        return queries.select("key", "fp").mapInArrow(near, KNOWN)

    salts = cut(queries.groupBy("key").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts")), "hot-salts")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    trees = rooted.join(salts, "key").select("key", "part", to_all("salts").alias("salt"), F.lit(True).alias("member"), "fp", "root")
    asking = queries.join(salts, "key").join(sizes, "key").select("key", to_all("trees").alias("part"), F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("member"), "fp", F.lit(None).cast("binary").alias("root"))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, raw, root, known = None, [], [], None
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                b = whole.slice(start, 2048)
                key, part, salt = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "salt"))
                member = np.asarray(b.column("member").to_pylist(), bool)
                new = np.ones(b.num_rows, bool)
                new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (salt[1:] != salt[:-1]) | (member[1:] != member[:-1])
                starts = np.flatnonzero(new).tolist()
                fp, roots = b.column("fp").to_pylist(), b.column("root").to_pylist()
                for s, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
                    name = (key[s], part[s], salt[s])
                    if name != now:
                        now, raw, root, known = name, [], [], None
                    if member[s]:
                        raw += fp[s:e]
                        root += roots[s:e]
                        continue
                    known = known or _Known(radius, raw, root, np.zeros(len(raw), np.int64))
                    yield known.answer(key[s:e], fp[s:e], np.full(e - s, 0 if raw else -1))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return trees.union(asking).repartition(parts, "key", "part", "salt").sortWithinPartitions("key", "part", "salt", F.desc("member")).mapInArrow(streamed, KNOWN)


def _hot_links(rows: DataFrame, counts: DataFrame, radius: int, most: int) -> DataFrame:
    """Links (a, b) that join all pairs within the radius of the hot shards' rows (key, fp); counts: (key, n)."""
    pivots = rows.join(counts, "key").where(F.pmod(F.xxhash64("fp", F.lit(3)), F.ceil(F.col("n") / PIVOTS)) == 0).select("key", "fp")
    first = cut(_met(pivots, rows, radius, most), "hot-first")
    parts = first.where("own and root is not null").groupBy("key", "root").agg(F.count("*").alias("n"))
    major = cut(parts.groupBy("key").agg(F.max_by("root", "n").alias("major")), "hot-major")
    outside = first.where("own").join(major, "key", "left").where("root is null or root <> major").select("key", "fp")
    outside = cut(outside, "hot-outside")
    found = first
    if not outside.isEmpty():
        asked = rows.join(outside.select("key").distinct(), "key", "left_semi")
        found = found.union(cut(_met(outside, asked, radius, most), "hot-second"))
    return found.where("root is not null and fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b"))


def links(fps: DataFrame, radius: int, keys: list[np.ndarray], most: int = 4096) -> DataFrame:
    """Links (a, b binary) that join all pairs of distinct fingerprints within the radius that share a key."""
    spark = fps.sparkSession
    keyed = _keyed(fps, keys)
    counts = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most), "hot-keys")
    hot = counts.count()
    # 16 bytes a key: broadcast up to 100,000 hot keys, shuffle beyond
    named = F.broadcast(counts.select("key")) if hot <= 100_000 else counts.select("key")
    cold = keyed.join(named, "key", "left_anti") if hot else keyed
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cold.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_in_shards(radius), "a binary, b binary")
    if hot:
        rows = cut(keyed.join(named, "key", "left_semi"), "hot")
        found = found.union(_hot_links(rows, counts, radius, most))
    return cut(found.distinct(), "links")


def _named(edges: DataFrame, bits: int) -> DataFrame:
    """Links between nodes: the 64 bits themselves, or the XXH64 of longer fingerprints."""
    node = (lambda c: F.conv(F.hex(c), 16, -10).cast("long")) if bits == 64 else F.xxhash64  # signed: two's complement
    return edges.select(node("a").alias("a"), node("b").alias("b"))


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, most: int = 4096) -> DataFrame:
    """(doc_id, fp binary, component_id): documents whose fingerprints of 64 bits link, and through them, share a component.

    Two fingerprints link at `radius` differing bits or fewer, and no such pair is lost. component_id is the least doc_id of the component.

    Null text: empty. Texts without words have fingerprint 0 and link like any other. Repeated rows share a component.
    Rows with a null doc_id stay, take part and get their component's least id, null if it has none. An empty table gives
    an empty result; other columns are ignored.
    """
    rows = cut(fingerprints(docs, k=k), "fingerprints")
    node = F.conv(F.hex("fp"), 16, -10).cast("long")
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", node), "fps")
    label = cut(components(_named(links(fps, radius, pigeonhole(64, radius, fps.count()), most), 64)), "labels")
    linked = fps.join(label, "node").select("fp", "component", "least")
    least = linked.groupBy("component").agg(F.min("least").alias("first"))
    of = fps.select("fp", "least").join(linked.select("fp", "component").join(least, "component").select("fp", "first"), "fp", "left")
    of = cut(of.select("fp", F.coalesce("first", "least").alias("component_id")), "of")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def similar_texts(docs: DataFrame, k: int = 5, threshold: float = 0.8, bits: int = 256, radius: int = 64, most: int = 4096, block: int = jaccard.BLOCK, crowd: int = jaccard.CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): texts whose sets of distinct shingles have a Jaccard similarity of `threshold` or more, and through
    them others, share a component, named by its least doc_id.

    SimHash proposes: fingerprints of the distinct shingles that the BK-trees link within a radius far wider than such pairs need form a cluster. Within a cluster
    all pairs not known to be joined are compared by their shingle sets themselves (as 64-bit hashes), so nothing less similar ever links. A pair of just
    the threshold is proposed but for a chance of MISS, at any number of texts.

    Null text: empty. Texts without words link with each other. Rows with a null doc_id take part and get their component's least id,
    null if it has none. An empty table gives an empty result; other columns are ignored.
    """
    rows = cut(jaccard.sets(docs, k, lambda own: wide(own, bits), id_col, text_col), "sets")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bytes").alias("bytes"))
    nodes = cut(firsts.select("digest", "least", "fp", "bytes", F.xxhash64("fp").alias("place")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    fps = cut(nodes.select("fp").distinct(), "fps")
    proposed = _named(links(fps, radius, sampled_keys(bits, agreement(threshold), radius, fps.count()), most), bits)
    # texts of different sets may share a fingerprint, alone or in a wider cluster
    shared = nodes.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").select(F.col("place").alias("a"), F.col("place").alias("b"))
    label = components(proposed.union(shared)).withColumnRenamed("node", "place")
    member = nodes.select("place", "node", "digest", "bytes").join(label, "place").select("node", "digest", "bytes", F.col("component").alias("cluster"))
    edges = jaccard.in_clusters(rows, cut(member, "clusters"), threshold, block, crowd)
    label = cut(components(edges), "labels")
    linked = nodes.select("node", "digest", "least").join(label, "node")
    least = linked.groupBy("component").agg(F.min("least").alias("first"))
    of = nodes.select("digest", "least").join(linked.join(least, "component").select("digest", "first"), "digest", "left")
    of = cut(of.select("digest", F.coalesce("first", "least").alias("component_id")), "of")
    return rows.select("doc_id", "digest").join(of, "digest").select("doc_id", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Rows as for `near_duplicates`."""
    found = near_duplicates(read(spark, sf_dir, "documents"), k=4, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")

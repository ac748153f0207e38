"""The exact check behind SimHash: Jaccard similarities of sets of distinct shingles within clusters that SimHash proposed.

Clusters beyond a block are compared in pairs of blocks that go to many tasks. In a task a search starts from each text not yet reached and compares it
with those not yet reached, so what is known to be joined isn't compared again, and only spanning links leave.

In a crowded cluster all texts first meet some heads, in slices. Those that are similar to heads of one part are known to be joined; only texts outside the largest part
so joined are then compared with the whole cluster. So a large group of near copies takes time in proportion to its size times what lies outside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import bound_batches, cut, joined, shingles, slices

#: Texts or bytes of shingles of a block, about.
BLOCK, BLOCK_BYTES = 256, 8 << 20
#: Clusters of more texts are crowded, and have about so many heads.
CROWD, HEADS = 1024, 24


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The sorted distinct XXH64 of a text's shingles."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, set(shingles(text, k))), np.uint64))


def sets(docs: DataFrame, k: int, sketch: Callable[[np.ndarray], bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, bytes, fp, shingles) of each row, fp being the `sketch` of its set; a null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                own = [shingle_set(t, k) for t in batch.column("text").to_pylist()]
                raw = [s.tobytes() for s in own]
                digest = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
                columns = [pa.array(digest, pa.binary()), pa.array(list(map(len, raw)), pa.int64()), pa.array(list(map(sketch, own)), pa.binary()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "digest", "bytes", "fp", "shingles"])

    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return bound_batches(some).mapInArrow(work, "doc_id long, digest binary, bytes long, fp binary, shingles binary")


def similar(own: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (i, j) of the graph of all pairs whose Jaccard similarity is `threshold` or more."""
    sizes = np.array(list(map(len, own)), np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    words, at = np.unique(np.concatenate([own[i] for i in order]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(words), np.int64)
    reached = np.zeros(len(own), bool)
    a, b = [], []
    for first in range(len(own)):
        if reached[first] or not sizes[first]:
            continue
        reached[first] = True
        queue = [first]
        while queue:
            one = queue.pop()
            # only sets of sizes within the threshold of each other can be so similar
            low, high = np.searchsorted(sizes, [max(1, int(sizes[one] * threshold)), int(sizes[one] / threshold) + 2])
            left = low + np.flatnonzero(~reached[low:high])
            if not len(left):
                continue
            mine = at[starts[one] : starts[one] + sizes[one]]
            mark[mine] = 1
            if 4 * len(left) < high - low:
                shared = np.array([mark[at[starts[i] : starts[i] + sizes[i]]].sum() for i in left])
            else:
                base = starts[low]
                shared = np.add.reduceat(mark[at[base : starts[high - 1] + sizes[high - 1]]], starts[low:high] - base)[left - low]
            mark[mine] = 0
            new = left[shared >= threshold * (sizes[one] + sizes[left] - shared) - 1e-9]
            reached[new] = True
            a.append(np.full(len(new), one))
            b.append(new)
            queue.extend(new.tolist())
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(a)], order[np.concatenate(b)]


def _in_blocks(threshold: float):
    def work(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        a, b = similar([np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()], threshold)
        return pa.table({"a": node[a], "b": node[b]})

    return work


def _against(own: list[np.ndarray], some: list[int], threshold: float) -> np.ndarray:
    """Of each set whether it is similar enough to each of `some` of them, a row a set."""
    sizes = np.array(list(map(len, own)), np.int64)
    words, at = np.unique(np.concatenate(own), return_inverse=True)
    row = np.repeat(np.arange(len(own)), sizes)
    ends = np.cumsum(sizes)
    out = np.zeros((len(own), len(some)), bool)
    mark = np.zeros(len(words), np.int64)
    for j, i in enumerate(some):
        mine = at[ends[i] - sizes[i] : ends[i]]
        mark[mine] = 1
        shared = np.bincount(row, mark[at], len(own))
        mark[mine] = 0
        out[:, j] = (shared > 0) & (shared >= threshold * (sizes[i] + sizes - shared) - 1e-9)
    return out


KNOWN = "cluster long, node long, root long, own boolean"


def _to_heads(threshold: float):
    """KNOWN of a slice's texts: the root of the first head that each is similar to; rows that aren't `own` link two roots that a text joins."""

    def work(table: pa.Table) -> pa.Table:
        node, head = table.column("node").to_numpy(), np.asarray(table.column("head").to_pylist(), bool)
        own = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        heads, texts = np.flatnonzero(head), np.flatnonzero(~head)
        heads = heads[np.argsort(node[heads])]
        a, b = similar([own[i] for i in heads], threshold) if len(heads) else (heads, heads)
        label = joined(np.arange(len(heads)), a, b)
        near = _against(own, heads.tolist(), threshold)[texts]
        first = np.where(near.any(1), label[near.argmax(1)], -1) if len(heads) else np.full(len(texts), -1)
        i, j = np.nonzero(near & (first >= 0)[:, None])
        joins = np.unique(np.stack((first[i], label[j])), axis=1) if len(i) else np.zeros((2, 0), np.int64)
        joins = joins[:, joins[0] != joins[1]]
        names = node[heads]
        root = [None if x < 0 else int(names[x]) for x in first.tolist()] + names[joins[1]].tolist()
        nodes = np.concatenate((node[texts], names[joins[0]]))
        n = len(nodes)
        return pa.table({"cluster": pa.array(np.full(n, table.column("cluster")[0].as_py())), "node": pa.array(nodes, pa.int64()), "root": pa.array(root, pa.int64()), "own": pa.array(np.arange(n) < len(texts))})

    return work


def _beside(threshold: float):
    """Links of some texts with all of a block."""

    def work(table: pa.Table) -> pa.Table:
        node, mine = table.column("node").to_numpy(), np.asarray(table.column("mine").to_pylist(), bool)
        own = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        some = np.flatnonzero(mine)
        i, j = np.nonzero(_against(own, some.tolist(), threshold))
        label = joined(np.arange(len(own)), i, some[j])
        linked = np.flatnonzero(label != np.arange(len(own)))
        return pa.table({"a": node[linked], "b": node[label[linked]]})

    return work


def _crowded(held: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links (a, b) that join all pairs of crowded clusters that are similar enough."""
    slices_ = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") / BLOCK_BYTES)).cast("int")
    texts = held.withColumn("slices", slices_)
    is_head = F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("n") / HEADS)) == 0
    heads = texts.where(is_head).select("cluster", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("head"), "node", "shingles")
    each = texts.select("cluster", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int").alias("slice"), F.lit(False).alias("head"), "node", "shingles")
    known = cut(each.union(heads).groupBy("cluster", "slice").applyInArrow(_to_heads(threshold), KNOWN), "known")
    parts = known.where("own and root is not null").groupBy("cluster", "root").agg(F.count("*").alias("size"))
    major = cut(parts.groupBy("cluster").agg(F.max_by("root", "size").alias("major")), "major")
    outside = known.where("own").join(major, "cluster", "left").where("root is null or root <> major").select("cluster", "node")
    outside = cut(outside.withColumn("mine", F.lit(True)), "outside")
    found = known.where("root is not null and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    left = outside.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("many"))
    if outside.isEmpty():
        return found
    all_ = texts.join(cut(left, "left"), "cluster").withColumn("q", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = all_.join(outside.select("node", "mine"), "node").select("cluster", F.pmod(F.xxhash64("node", F.lit(9)), F.col("many")).cast("int").alias("p"), to_all("slices").alias("q"), "node", "shingles", "mine")
    others = all_.select("cluster", to_all("many").alias("p"), "q", "node", "shingles", F.lit(False).alias("mine"))
    return found.union(mine.union(others).groupBy("cluster", "p", "q").applyInArrow(_beside(threshold), "a long, b long"))


def in_clusters(rows: DataFrame, member: DataFrame, threshold: float, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that join all pairs of a cluster that are similar enough; rows: as from `sets`; member: (node, digest, bytes, cluster)."""
    sizes = member.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("bytes").alias("total")).where("n > 1")
    dealt = cut(member.join(sizes, "cluster").select("digest", "node", "cluster", "n", "total"), "dealt")
    # 60 bytes a text: broadcast up to 200,000 texts, shuffle beyond
    few = dealt.count() <= 200_000
    held = cut(rows.select("digest", "shingles").join(F.broadcast(dealt) if few else dealt, "digest").dropDuplicates(["node"]).drop("digest"), "held")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") / BLOCK_BYTES)).cast("int")
    some = held.where(F.col("n") <= crowd).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array("own"))))
    met = some.select("cluster", "node", "own", "shingles", other.alias("other"))
    met = met.select("cluster", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "shingles")
    found = met.groupBy("cluster", "p", "q").applyInArrow(_in_blocks(threshold), "a long, b long")
    return found if sizes.where(F.col("n") > crowd).isEmpty() else found.union(_crowded(held.where(F.col("n") > crowd), threshold, block))

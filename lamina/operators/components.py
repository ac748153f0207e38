"""Weak and strong connected components of edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.scratch import cut, indexed


#: Edges that one task labels (16 bytes each); more are labelled in rounds.
ONE_TASK = 2000


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of n rows that each row reaches over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if ends:
        u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[joined(at[: len(u)], at[len(u) :], len(nodes))])], ["node", "component"])


def components(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for each node of `edges` (a, b long): component is the least node reachable either way.

    Alternates large-star and small-star steps: each is one grouped minimum (combined before the shuffle) and one
    join on the same key. The minima are tables, so that both sides of the join are plain exchanges, which adaptive execution splits where
    a hub is hot. Rounds are logarithmic in the longest path;
    each ends in a table in the shared folder. Up to `one_task` edges are labelled by one task instead, with the same result. Self loops make their node known. Empty edges give an
    empty table.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null").distinct(), "edges")
    if one_task and e.count() <= one_task:
        return e.coalesce(1).mapInArrow(_in_one_task, "node long, component long")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    e = e.where("u <> v")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.count_distinct("u")).first()
        stars = now[0] == now[2] and e.select(F.col("v").alias("u")).distinct().join(e.select("u").distinct(), "u", "left_semi").isEmpty()
        if now == before or stars:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def labelled(found: DataFrame) -> DataFrame:
    """(node, label): components numbered from 0 in the order of their least node."""
    names = indexed(found.select("component").distinct(), "component", "label")
    return found.join(names, "component").select("node", "label")


#: Graphs of so many edges at most (16 bytes each) are labelled in the driver, where a round costs no job; larger ones by joins.
SMALL = 100_000


def _small(edges: DataFrame, small: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The ends of all edges if there are `small` at most."""
    t = edges.select("src", "dst").where("src is not null and dst is not null").limit(small + 1).toArrow() if small else None
    if t is None or t.num_rows > small:
        return None
    return t.column("src").to_numpy().astype(np.int64), t.column("dst").to_numpy().astype(np.int64)


def _labels(edges: DataFrame, nodes: np.ndarray, least: np.ndarray) -> DataFrame:
    """(node, label) from the least member of each node's component."""
    table = pa.table({"node": pa.array(nodes, pa.int64()), "label": pa.array(np.unique(least, return_inverse=True)[1], pa.int64())})
    return edges.sparkSession.createDataFrame(table)


def _tarjan(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least member of each node's strong component."""
    order = np.argsort(src, kind="stable")
    first = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    to = dst[order].tolist()
    index, low, least = [-1] * n, [0] * n, np.zeros(n, np.int64)
    held, inside, count = [], [False] * n, 0
    for root in range(n):
        if index[root] >= 0:
            continue
        index[root] = low[root] = count
        count += 1
        held.append(root)
        inside[root] = True
        path = [(root, first[root])]
        while path:
            v, at = path.pop()
            if at < first[v + 1]:
                path.append((v, at + 1))
                w = to[at]
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    held.append(w)
                    inside[w] = True
                    path.append((w, first[w]))
                elif inside[w]:
                    low[v] = min(low[v], index[w])
                continue
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[v])
            if low[v] == index[v]:
                cut_at = len(held) - 1 - held[::-1].index(v)
                own = held[cut_at:]
                del held[cut_at:]
                for w in own:
                    inside[w] = False
                least[own] = min(own)
    return least


def weak_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, label) of a graph (src, dst), directions ignored."""
    ends = _small(edges, small)
    if ends is not None:
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        return _labels(edges, nodes, joined(at[: len(ends[0])], at[len(ends[0]) :], len(nodes)))
    return labelled(components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), one_task=min(small, ONE_TASK)))


def _reach(edges: DataFrame, nodes: DataFrame, max_rounds: int) -> DataFrame:
    """(node, least): the least node from which each node of an unfinished part can be reached along the edges."""
    state = nodes.select("node", F.col("node").alias("least"))
    for _ in range(max_rounds):
        step = state.join(edges, state["node"] == edges["src"]).select(F.col("dst").alias("node"), "least")
        new = cut(state.union(step).groupBy("node").agg(F.min("least").alias("least")), "reach")
        changed = new.join(state.withColumnRenamed("least", "old"), "node").where("least <> old").isEmpty()
        state = new
        if changed:
            return state
    raise RuntimeError(f"reachability did not settle in {max_rounds} rounds")


def strong_components(edges: DataFrame, max_rounds: int = 10_000, small: int = SMALL) -> DataFrame:
    """(node, label) of a directed graph (src, dst): nodes that reach each other share a label, numbered by least node.

    Forward and backward: every node takes the least node that reaches it; of the nodes so coloured, those that reach
    the colour's own node form its component. They are taken out and the rest is done again. Each round settles a component in
    every colour.
    """
    ends = _small(edges, small)
    if ends is not None:
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        return _labels(edges, nodes, _tarjan(len(nodes), at[: len(ends[0])], at[len(ends[0]) :]))
    e = cut(edges.select("src", "dst").distinct(), "edges")
    left = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "nodes")
    done = None
    while not left.isEmpty():
        colour = cut(_reach(e, left, max_rounds), "colour")
        inside = e.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").where("a = b").select("src", "dst", F.col("a").alias("colour"))
        inside = cut(inside, "inside")
        found = colour.where("node = least").select("node", F.col("least").alias("component"))
        size = -1
        while True:
            back = inside.join(found.select(F.col("node").alias("dst"), "component"), "dst").where("colour = component").select(F.col("src").alias("node"), "component")
            found = cut(found.union(back).distinct(), "found")
            now = found.count()
            if now == size:
                break
            size = now
        done = found if done is None else done.union(found)
        left = cut(left.join(found, "node", "left_anti"), "left")
        e = cut(e.join(left.toDF("src"), "src", "left_semi").join(left.toDF("dst"), "dst", "left_semi"), "edges")
    if done is None:
        return edges.sparkSession.createDataFrame([], "node long, label long")
    return labelled(cut(done, "strong"))

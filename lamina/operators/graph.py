"""Operators on neighbour graphs (src, dst, rank, dist), whose rank 0 is the node itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.components import weak_components
from lamina.operators.knn import ASKING, PAIRS, RUN, TASKS, _exact, _vectors, nearest, nearest_of_others, packed, precision, unpacked
from lamina.scratch import cut

#: Components whose centroids the driver holds at most to span them by a tree.
MOST_COMPONENTS = 4096
SLICE = 4096
#: Bytes of two components at most that are met with others in one batch.
SMALL_BYTES = 16 << 10


def ranked(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, dist) with ranks by (self first, dist, dst)."""
    order = Window.partitionBy("src").orderBy((F.col("src") != F.col("dst")).cast("int"), "dist", "dst")
    return edges.withColumn("rank", (F.row_number().over(order) - 1).cast("int")).select("src", "dst", "rank", "dist")


def _mirrored(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst", "dist")
    return e.union(e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))


def symmetric_min(edges: DataFrame) -> DataFrame:
    """Every edge both ways, at the lesser of its distances."""
    return ranked(_mirrored(edges).groupBy("src", "dst").agg(F.min("dist").alias("dist")))


def symmetric_mean(edges: DataFrame) -> DataFrame:
    """Every edge both ways, at the mean of its distances, a missing one counting as 0."""
    half = _mirrored(edges.where("src <> dst")).groupBy("src", "dst").agg((F.sum("dist") * 0.5).alias("dist"))
    return ranked(half.union(edges.where("src = dst").select("src", "dst", "dist")))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def with_self(edges: DataFrame, k: int) -> DataFrame:
    """Rows of k at most that start with the node itself: if it was missing, the farthest makes room."""
    own = edges.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(0.0).alias("dist"))
    others = edges.where("src <> dst and dst is not null").select("src", "dst", "dist")
    return ranked(own.union(others)).where(F.col("rank") < k)


def incomplete(edges: DataFrame, k: int) -> DataFrame:
    """(src) of the rows with fewer than k found neighbours."""
    return edges.groupBy("src").agg(F.count("dst").alias("n")).where(F.col("n") < k).select("src")


def repeated(edges: DataFrame) -> DataFrame:
    """(src, dst) of neighbours that a row holds more than once."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1").select("src", "dst")


def decreasing(edges: DataFrame) -> DataFrame:
    """(src) of rows whose distances decrease somewhere along the ranks."""
    before = F.lag("dist").over(Window.partitionBy("src").orderBy("rank"))
    return edges.withColumn("_before", before).where("dist < _before").select("src").distinct()


def edge_distance(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, dist) of pairs (a, b); null where b is no direct neighbour of a."""
    return pairs.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "dist"), ["a", "b"], "left")


def centroids(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, features): the mean of each component's points by dimension; `labels` is (node, label)."""
    long = points.join(labels, points["point_id"] == labels["node"]).select("label", F.posexplode("features").alias("dim", "x"))
    means = long.groupBy("label", "dim").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("features"))


def spanning_tree(centres: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a least spanning tree of all rows, by growing it from row 0."""
    n = len(centres)
    best, near = np.full(n, np.inf), np.zeros(n, int)
    inside, at, out = np.zeros(n, bool), 0, []
    for _ in range(n - 1):
        inside[at] = True
        d = ((centres - centres[at]) ** 2).sum(1)
        closer = d < best
        best[closer], near[closer] = d[closer], at
        best[inside] = np.inf
        at = int(np.argmin(best))
        out.append((int(near[at]), at))
    return out


def _closest_of_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As `closest_pairs`, of rows (a, b, x, y) with the points of both sides."""
    for batch in batches:
        (ends, ids, x), (ends_y, others, y) = ((np.append(0, np.cumsum(c.value_lengths().to_numpy())), c.flatten().field("point_id").to_numpy(), _vectors(c.flatten().field("features"))) for c in (batch.column("x"), batch.column("y")))
        many = np.diff(ends) * np.diff(ends_y)
        for rows in np.split(np.arange(len(many)), np.flatnonzero(np.diff(np.cumsum(many) // PAIRS)) + 1):
            row = np.repeat(rows, many[rows])
            at = np.arange(len(row)) - np.repeat(np.cumsum(many[rows]) - many[rows], many[rows])
            i, j = ends[row] + at // np.diff(ends_y)[row], ends_y[row] + at % np.diff(ends_y)[row]
            dist = _exact(x[i], y[j], "L2")
            order = np.lexsort((others[j], ids[i], dist, row))
            order = order[np.isfinite(dist[order])]
            best = order[np.unique(row[order], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(row[best])), batch.column("b").take(pa.array(row[best])), pa.array(ids[i[best]]), pa.array(others[j[best]]), pa.array(dist[best])], ["a", "b", "src", "dst", "dist"])


def closest_pairs(points: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, src, dst, dist): of each pair of components (a, b) the two closest points, src in a and dst in b; ties by ids.

    Components meet in slices, so a large one is many tasks; some slices of either side meet in a task, which returns one row. Pairs of SMALL_BYTES at most are rows, many of which meet in a batch.
    """
    own = points.join(labels, points["point_id"] == labels["node"]).select(F.col("label").cast("long").alias("label"), "point_id", "features")
    parts = own.groupBy("label").agg(F.ceil(F.count("*") / SLICE).alias("slices"), F.count("*").alias("points"))
    dealt = own.join(parts.drop("points"), "label").withColumn("slice", F.pmod(F.xxhash64("point_id"), F.col("slices")))
    kind = precision(points)
    width = points.agg(F.coalesce(F.max(F.size("features")), F.lit(1))).first()[0]
    asked = pairs.join(parts.toDF("a", "na", "ma"), "a").join(parts.toDF("b", "nb", "mb"), "b")
    asked = cut(asked.withColumn("small", (F.col("ma") + F.col("mb")) * 8 * width <= SMALL_BYTES).drop("ma", "mb"), "sizes")
    few, sizes = asked.where("small").select("a", "b"), asked.where("not small").drop("small")
    lists = own.join(parts.where(F.col("points") * 8 * width <= SMALL_BYTES).select("label"), "label", "left_semi").groupBy("label").agg(F.collect_list(F.struct("point_id", "features")).alias("x"))
    lists = cut(lists, "small")
    near = few.join(lists.toDF("a", "x"), "a").join(lists.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_closest_of_small, "a long, b long, src long, dst long, dist double")
    if sizes.isEmpty():
        return near
    met = sizes.select(F.col("a").alias("label")).union(sizes.select("b")).distinct()
    whole = cut(packed(dealt.join(met, "label", "left_semi"), ("label", "slices", "slice"), kind), "slices")
    last = lambda many, each: F.floor((F.col(many) - 1) / each).cast("long")
    left = sizes.join(whole.select(F.col("label").alias("a"), F.floor(F.col("slice") / ASKING).cast("long").alias("asks"), "ids", "xs"), "a")
    left = left.select("a", "b", "asks", F.explode(F.sequence(F.lit(0).cast("long"), last("nb", RUN))).alias("run"), "ids", "xs")
    right = sizes.join(whole.select(F.col("label").alias("b"), F.floor(F.col("slice") / RUN).cast("long").alias("run"), "ids", "xs"), "b")
    right = right.select("a", "b", F.explode(F.sequence(F.lit(0).cast("long"), last("na", ASKING))).alias("asks"), "run", "ids", "xs")
    keys = ("a", "b", "asks", "run")
    many = max(4 * TASKS, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"a": [], "b": [], "src": [], "dst": [], "dist": []}
        if len(left) and len(right):
            src, dst, dist = nearest(*unpacked(left, kind), *unpacked(right, kind), 1, "L2", apart=False)
            if len(src):
                best = np.lexsort((dst, src, dist))[0]
                out = {"a": left.column("a")[:1], "b": left.column("b")[:1], "src": src[[best]], "dst": dst[[best]], "dist": dist[[best]]}
        return pa.table(out, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("src", pa.int64()), ("dst", pa.int64()), ("dist", pa.float64())]))

    left, right = (x.toDF(*keys, "ids", "xs").repartition(many, *keys).groupBy(*keys) for x in (left, right))
    found = left.cogroup(right).applyInArrow(work, "a long, b long, src long, dst long, dist double")
    least = F.min(F.struct("dist", "src", "dst"))
    return near.unionByName(found.groupBy("a", "b").agg(least.alias("m")).select("a", "b", "m.src", "m.dst", "m.dist"))


def spanning_pairs(centres: DataFrame) -> DataFrame:
    """(a, b): the edges of the least spanning tree of all centres (point_id, features), found by tables: in each round every tree so far takes its shortest edge to another.

    What a centre found nearest outside its tree holds until both are in one tree, and is a least distance from then on: only centres whose tree may have a shorter edge through them ask again.
    """
    tree = centres.sparkSession.createDataFrame([], "a long, b long")
    placed = cut(centres.select("point_id", "features", F.col("point_id").alias("group")), "placed")
    if placed.limit(2).count() < 2:
        return tree
    near = cut(nearest_of_others(placed, placed), "near")
    edge = F.struct("dist", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("gb").alias("to"))
    while True:
        group = placed.select("point_id", "group")
        own = near.join(group.toDF("src", "ga"), "src").join(group.toDF("dst", "gb"), "dst")
        known = cut(own.withColumn("limit", F.min(F.when(F.col("ga") != F.col("gb"), F.col("dist"))).over(Window.partitionBy("ga"))), "known")
        stale = F.col("ga") == F.col("gb")
        asks = known.where(stale & (F.col("limit").isNull() | (F.col("dist") <= F.col("limit")))).select(F.col("src").alias("point_id"))
        again = cut(nearest_of_others(placed.join(asks, "point_id", "left_semi"), placed), "again")
        near = cut(near.join(again.select("src"), "src", "left_anti").unionByName(again), "near")
        fresh = again.join(group.toDF("src", "ga"), "src").join(group.toDF("dst", "gb"), "dst")
        best = cut(known.where(~stale).select("src", "dst", "dist", "ga", "gb").unionByName(fresh.select("src", "dst", "dist", "ga", "gb")).groupBy("ga").agg(F.min(edge).alias("best")), "best")
        tree = cut(tree.union(best.select("best.a", "best.b")).distinct(), "tree")
        joined = cut(weak_components(best.select(F.col("ga").alias("src"), F.col("best.to").alias("dst"))), "joined")
        if joined.agg(F.max("label")).first()[0] == 0:
            return tree
        placed = cut(placed.join(joined.toDF("group", "label"), "group").select("point_id", "features", F.col("label").alias("group")), "placed")


def connected(points: DataFrame, edges: DataFrame, most: int = MOST_COMPONENTS) -> DataFrame:
    """The graph with edges added both ways until it is one component.

    Components are spanned by a least tree of their centroids (grown in the driver up to `most`, by tables beyond); along each of its edges the closest two points are joined, at their
    true distance.
    """
    labels = cut(weak_components(edges), "labels")
    n = labels.agg(F.max("label")).first()[0]
    if not n:
        return edges
    centre = cut(centroids(points, labels).withColumnRenamed("label", "point_id"), "centres")
    if n + 1 <= most:
        rows = centre.orderBy("point_id").collect()
        tree = spanning_tree(np.array([r["features"] for r in rows]))
        pairs = points.sparkSession.createDataFrame([(rows[a]["point_id"], rows[b]["point_id"]) for a, b in tree], "a long, b long")
    else:
        pairs = spanning_pairs(centre)
    new = cut(closest_pairs(points, labels, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "joins")
    both = new.select("src", "dst", "dist").union(new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))
    fresh = both.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").where("src <> dst")
    return cut(ranked(edges.select("src", "dst", "dist").union(fresh)), "connected")

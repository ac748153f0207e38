"""Distances between components, each for a table of pairs (a, b): tables in, (a, b, dist) out.

`members` is (component_id, point_id).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.paths import group_distances, reversed_edges, set_distances
from lamina.scratch import cut


#: Points of a component that one task takes at once.
BLOCK = 1024
#: Components of so many bytes at most are met many pairs at once: so many pairs at least where there are as many, of so many components a side at most, about; of dense pairs of FEW a side. Numbers held at once.
SMALL_BYTES, BUCKET_PAIRS, BUCKET_SIDE, FEW, NUMBERS = 16 << 10, 1024, 4096, 256, 1 << 20


def represented(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(component_id, dst): the distinct neighbours, self included, of all points of a component."""
    return members.join(edges.select(F.col("src").alias("point_id"), "dst"), "point_id").select("component_id", "dst").distinct()


def overlap(pairs: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """1 - |U(a) and U(b)| / min(|U(a)|, |U(b)|) of the neighbours that the components represent."""
    u = cut(represented(members, edges), "represented")
    n = u.groupBy("component_id").agg(F.count("*").alias("n"))
    shared = pairs.join(u.toDF("a", "dst"), "a").join(u.toDF("b", "dst"), ["b", "dst"]).groupBy("a", "b").agg(F.count("*").alias("c"))
    sizes = pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").join(shared, ["a", "b"], "left")
    return sizes.select("a", "b", (1 - F.coalesce("c", F.lit(0)) / F.least("na", "nb")).alias("dist"))


def hausdorff(distances: DataFrame) -> DataFrame:
    """(a, b, dist) from the distances (a, b, x, y, d) of members x of a and y of b: the farthest that any member is from the other side."""
    there = distances.groupBy("a", "b", "x").agg(F.min("d").alias("m")).groupBy("a", "b").agg(F.max("m").alias("u"))
    back = distances.groupBy("a", "b", "y").agg(F.min("d").alias("m")).groupBy("a", "b").agg(F.max("m").alias("v"))
    return there.join(back, ["a", "b"]).select("a", "b", F.greatest("u", "v").alias("dist"))


def _drawn(members: DataFrame, samples: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes; all members of components of samples^2 at most; and `samples` seeded members of each."""
    sizes = members.groupBy("component_id").agg(F.count("*").alias("n"))
    whole = members.join(sizes.where(F.col("n") <= samples * samples).select("component_id"), "component_id", "left_semi")
    order = Window.partitionBy("component_id").orderBy(F.xxhash64(F.lit(seed), "point_id"), "point_id")
    some = members.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= samples).drop("_at")
    return sizes, whole, some


def chosen_members(pairs: DataFrame, members: DataFrame, samples: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, point_id) of either side: all members, or, if `samples` is given, so many drawn ones where |A| * |B| exceeds samples^2 and the side has more."""
    if samples is None:
        both = pairs.select("a", "b")
        return both.join(members.toDF("a", "point_id"), "a").select("a", "b", "point_id"), both.join(members.toDF("b", "point_id"), "b").select("a", "b", "point_id")
    sizes, whole, some = _drawn(members, samples, seed)
    sized = cut(pairs.select("a", "b").join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b"), "sized")
    large = F.col("na") * F.col("nb") > samples * samples

    def side(c: str, n: str) -> DataFrame:
        few = sized.where(~large | (F.col(n) <= samples)).select("a", "b").join(whole.toDF(c, "point_id"), c)
        many = sized.where(large & (F.col(n) > samples)).select("a", "b").join(some.toDF(c, "point_id"), c)
        return few.select("a", "b", "point_id").union(many.select("a", "b", "point_id"))

    members_by = [f.name for f in members.schema]
    assert members_by == ["component_id", "point_id"], members_by
    return side("a", "na"), side("b", "nb")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, ids and vectors of a column of lists of (point_id, features)."""
    rows = column.flatten()
    ends = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
    x = rows.field("features").flatten().to_numpy(zero_copy_only=False)
    return ends, rows.field("point_id").to_numpy(zero_copy_only=False), x.reshape(len(rows), -1)


def _least(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The square of each point's distance to the nearest of the other side."""
    d = np.stack([((y - p) ** 2).sum(1) for p in x])
    return d.min(1), d.min(0)


def _of_small(pairs: DataFrame, packed: DataFrame, components: int) -> DataFrame:
    """(a, b, left, point_id, d), as `euclid` has them of single blocks, for pairs of small components: dealt so that a component's points are sent once for all of its pairs in a bucket."""
    n = pairs.count()
    groups = max(math.ceil(components / BUCKET_SIDE), min(math.ceil(components / FEW), math.isqrt(n // BUCKET_PAIRS)), 1)
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    dealt = pairs.select((group("a") * groups + group("b")).alias("bucket"), "a", "b")
    ends = dealt.select("bucket", F.col("a").alias("component_id")).union(dealt.select("bucket", "b")).distinct().join(packed.select("component_id", "x"), "component_id").select(F.col("bucket").alias("at"), "component_id", "x")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (left.column(c).to_numpy() for c in ("a", "b"))
        far = np.zeros(len(a))
        if len(a):
            right = right.sort_by("component_id")
            cuts, _, x = _lists(right.column("x").combine_chunks())
            i, j = (np.searchsorted(right.column("component_id").to_numpy(), c) for c in (a, b))
            many = np.diff(cuts)
            kinds, kind = np.unique(np.stack((many[i], many[j])), axis=1, return_inverse=True)
            kind = kind.ravel()
            for k, (m, n) in enumerate(kinds.T.tolist()):
                rows, step = np.flatnonzero(kind == k), max(1, NUMBERS // (m * n * x.shape[1]))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    p, q = x[cuts[i[some], None] + np.arange(m)], x[cuts[j[some], None] + np.arange(n)]
                    d = ((p[:, :, None] - q[:, None]) ** 2).sum(3)
                    far[some] = np.maximum(d.min(2).max(1), d.min(1).max(1))
        return pa.table({"a": a, "b": b, "d": np.sqrt(far)})

    found = dealt.groupBy("bucket").cogroup(ends.groupBy("at")).applyInArrow(work, "a long, b long, d double")
    return found.select("a", "b", F.lit(None).cast("boolean").alias("left"), F.lit(None).cast("long").alias("point_id"), "d")


def euclid(pairs: DataFrame, members: DataFrame, points: DataFrame, samples: int | None = None, seed: int = 1) -> DataFrame:
    """Symmetric Hausdorff distance over the points' L2 distances; for single points their distance.

    The members of each side meet in blocks of BLOCK points, so a pair of large components is many tasks. A pair of single blocks returns its distance; of others each pair of blocks
    returns its points' least distances. Components of SMALL_BYTES at most meet in buckets of many pairs.
    """
    members, asked = members.select("component_id", "point_id"), pairs.select("a", "b").distinct()
    vectors = points.select("point_id", F.col("features").cast("array<double>").alias("features"))

    def pack(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"{name}_blocks"))
        dealt = df.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("point_id"), F.col(f"{name}_blocks")).cast("int"))
        return dealt.join(vectors, "point_id").groupBy(*keys, f"{name}_blocks", "block").agg(F.collect_list(F.struct("point_id", "features")).alias(name)).drop("block")

    if samples is None:
        packed = cut(pack(members, ["component_id"], "x"), "members")
        width = F.size(F.element_at("x", 1)["features"])
        sizes = packed.groupBy("component_id").agg(F.max(8 * F.size("x") * width <= SMALL_BYTES).alias("small"), F.max("x_blocks").alias("blocks")).withColumn("small", F.col("small") & (F.col("blocks") == 1)).drop("blocks")
        sized = cut(asked.join(sizes.toDF("a", "a_small"), "a").join(sizes.toDF("b", "b_small"), "b").select("a", "b", (F.col("a_small") & F.col("b_small")).alias("small")), "sized")
        small = _of_small(sized.where("small").select("a", "b"), packed, packed.select("component_id").distinct().count())
        asked = sized.where("not small").select("a", "b")
        both = asked.join(packed.toDF("a", "x_blocks", "x"), "a").join(packed.toDF("b", "y_blocks", "y"), "b")
    else:
        left, right = chosen_members(asked, members, samples, seed)
        both = pack(left, ["a", "b"], "x").join(pack(right, ["a", "b"], "y"), ["a", "b"])
    fields = {"a": pa.int64(), "b": pa.int64(), "left": pa.bool_(), "point_id": pa.int64(), "d": pa.float64()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (i_ends, i, x), (j_ends, j, y) = _lists(batch.column("x")), _lists(batch.column("y"))
            whole = (batch.column("x_blocks").to_numpy() == 1) & (batch.column("y_blocks").to_numpy() == 1)
            single = whole & (np.diff(i_ends) == 1) & (np.diff(j_ends) == 1)
            far = np.zeros(batch.num_rows)
            far[single] = ((x[i_ends[:-1][single]] - y[j_ends[:-1][single]]) ** 2).sum(1)
            parts = []
            for row in np.flatnonzero(~single).tolist():
                p, q = slice(*i_ends[row : row + 2]), slice(*j_ends[row : row + 2])
                there, back = _least(x[p], y[q])
                if whole[row]:
                    far[row] = max(there.max(), back.max())
                else:
                    parts.append((row, np.arange(len(there) + len(back)) < len(there), np.concatenate((i[p], j[q])), np.concatenate((there, back))))
            row = np.concatenate([np.flatnonzero(whole), *[np.full(len(n), r) for r, _, n, _ in parts]])
            n = int(whole.sum())
            ids = pa.array(np.concatenate([np.zeros(n, np.int64), *[p[2] for p in parts]]))
            left = pa.array(np.concatenate([np.zeros(n, bool), *[p[1] for p in parts]]), mask=np.arange(len(row)) < n)
            d = np.sqrt(np.concatenate([far[whole], *[p[3] for p in parts]]))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(row)), batch.column("b").take(pa.array(row)), left, ids, pa.array(d)], list(fields))

    found = both.mapInArrow(work, "a long, b long, left boolean, point_id long, d double")
    found = cut(found.union(small) if samples is None else found, "least")
    least = found.where("left is not null").groupBy("a", "b", "left", "point_id").agg(F.min("d").alias("d")).groupBy("a", "b").agg(F.max("d").alias("dist"))
    return found.where("left is null").select("a", "b", F.col("d").alias("dist")).union(least)


def geodesic(pairs: DataFrame, members: DataFrame, edges: DataFrame, samples: int | None = None, seed: int = 1) -> DataFrame:
    """Symmetric Hausdorff distance over shortest paths along the graph; null where no path leads across for one of the members.

    A search from all members of a at once tells how far each member of b is from the set, one against the edges' direction from those of b the other half: one search each way for a component,
    whatever its pairs, and a row a pair (|a| + |b| rows through graphs that are not sent whole). Drawn members make a set of their own for each pair.
    """
    members, asked = members.select("component_id", "point_id"), pairs.select("a", "b").distinct()
    if samples is None:
        there = group_distances(edges, members, asked)
        back = group_distances(reversed_edges(edges), members, asked.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("b").alias("a"), F.col("a").alias("b"), "dist")
        far = there.union(back).withColumnRenamed("dist", "d")
    else:
        far = None
        known = cut(asked.withColumn("pair", F.monotonically_increasing_id()), "pairs")
        left, right = (cut(side.join(known, ["a", "b"]), "drawn") for side in chosen_members(known, members, samples, seed))
        own = lambda side: side.select(F.col("pair").alias("set_id"), F.col("point_id").alias("node"))
        for sources, wanted, way in [(own(left), right, edges), (own(right), left, reversed_edges(edges))]:
            targets = wanted.select(F.col("pair").alias("set_id"), F.col("point_id").alias("node"))
            found = set_distances(way, sources, targets.distinct())
            d = F.coalesce("dist", F.lit(float("inf")))
            one = wanted.withColumn("set_id", F.col("pair")).withColumnRenamed("point_id", "node").join(found, ["set_id", "node"], "left").groupBy("a", "b").agg(F.max(d).alias("d"))
            far = one if far is None else far.union(one)
    return far.groupBy("a", "b").agg(F.max("d").alias("dist")).withColumn("dist", F.when(F.col("dist") < float("inf"), F.col("dist")))


def bhattacharyya(pairs: DataFrame, walks: DataFrame) -> DataFrame:
    """1 - sum of sqrt(p * q) over the columns that the rows a and b of `walks` (row_id, col_id, value) share."""
    a = walks.select(F.col("row_id").alias("a"), "col_id", F.col("value").alias("p"))
    b = walks.select(F.col("row_id").alias("b"), "col_id", F.col("value").alias("q"))
    both = pairs.select("a", "b").join(a, "a").join(b, ["b", "col_id"]).groupBy("a", "b").agg(F.sum(F.sqrt(F.col("p") * F.col("q"))).alias("c"))
    return pairs.select("a", "b").join(both, ["a", "b"], "left").select("a", "b", (1 - F.coalesce("c", F.lit(0.0))).alias("dist"))


def single_overlap(pairs: DataFrame, walks: DataFrame, one_way: bool = False) -> DataFrame:
    """1 - the greater of walks[a, b] and walks[b, a]; `one_way`: 1 - walks[a, b]."""
    there = walks.select(F.col("row_id").alias("a"), F.col("col_id").alias("b"), F.col("value").alias("p"))
    back = walks.select(F.col("col_id").alias("a"), F.col("row_id").alias("b"), F.col("value").alias("q"))
    both = pairs.select("a", "b").join(there, ["a", "b"], "left").join(back, ["a", "b"], "left")
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    return both.select("a", "b", (1 - (p if one_way else F.greatest(p, q))).alias("dist"))


def weighted_jaccard(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, value): the sum of lesser over the sum of greater values, of all columns of the sparse rows a and b."""
    a = pairs.select("a", "b").join(rows.select(F.col("row_id").alias("a"), "col_id", F.col("value").alias("p")), "a").select("a", "b", "col_id", "p", F.lit(0.0).alias("q"))
    b = pairs.select("a", "b").join(rows.select(F.col("row_id").alias("b"), "col_id", F.col("value").alias("q")), "b").select("a", "b", "col_id", F.lit(0.0).alias("p"), "q")
    both = a.union(b).groupBy("a", "b", "col_id").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    return both.groupBy("a", "b").agg((F.sum(F.least("p", "q")) / F.sum(F.greatest("p", "q"))).alias("value"))

"""Sparse matrices as entries (row_id, col_id, value): merging, top entries, products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.scratch import cut

#: Entries of a column beyond which the rows that share it are compared in blocks, rows of a block, and columns that a task spreads out at once.
HEAVY = 2000
ROWS, COLUMNS = 1024, 2048


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.withColumnsRenamed({"row_id": "_r", "col_id": "row_id"}).withColumnRenamed("_r", "col_id").select(*matrix.columns)


def remove_diagonal(matrix: DataFrame) -> DataFrame:
    """Without the diagonal, but for rows that hold nothing else."""
    n = F.count("*").over(Window.partitionBy("row_id"))
    return matrix.withColumn("_n", n).where("row_id <> col_id or _n = 1").drop("_n")


def prune(matrix: DataFrame, limit: float) -> DataFrame:
    return matrix.where(F.col("value") > limit)


def top_k(matrix: DataFrame, k: int, largest: bool = True, value: str = "value") -> DataFrame:
    """The k largest (or smallest) entries of each row; of equal ones those with the least column."""
    order = F.desc(value) if largest else F.asc(value)
    return matrix.withColumn("_rank", F.row_number().over(Window.partitionBy("row_id").orderBy(order, "col_id"))).where(F.col("_rank") <= k).drop("_rank")


def exclusive_offsets(degrees: DataFrame, key: str = "src", count: str = "degree") -> DataFrame:
    """(key, offset): the sum of the counts of all smaller keys, by ranges of the key so that no task sees all rows."""
    dealt = cut(degrees.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "offsets")
    sums = dealt.groupBy("_range").agg(F.sum(count).alias("_n"))
    before = sums.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.sum(count).over(Window.partitionBy("_range").orderBy(key)) - F.col(count)
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").select(key, (F.col("_own") + F.col("_before")).cast("long").alias("offset"))


def merge_rows(matrix: DataFrame, parents: DataFrame, weight_by_row_nnz: bool = False) -> DataFrame:
    """Rows and columns of merged components added up: M[p(i), p(j)] = sum of R[i, j].

    `parents` is (component_id, parent_id). With `weight_by_row_nnz` each row counts as often as it has entries, over the sum of these weights.
    """
    up_row = parents.select(F.col("component_id").alias("row_id"), F.col("parent_id").alias("_row"))
    up_col = parents.select(F.col("component_id").alias("col_id"), F.col("parent_id").alias("_col"))
    both = matrix.select("row_id", "col_id", "value").join(up_row, "row_id").join(up_col, "col_id")
    if not weight_by_row_nnz:
        return both.groupBy(F.col("_row").alias("row_id"), F.col("_col").alias("col_id")).agg(F.sum("value").alias("value"))
    sizes = matrix.groupBy("row_id").agg(F.count("*").alias("_w"))
    total = sizes.join(up_row, "row_id").groupBy("_row").agg(F.sum("_w").alias("_total"))
    merged = both.join(sizes, "row_id").groupBy("_row", "_col").agg(F.sum(F.col("value") * F.col("_w")).alias("value"))
    return merged.join(total, "_row").select(F.col("_row").alias("row_id"), F.col("_col").alias("col_id"), (F.col("value") / F.col("_total")).alias("value"))


def merge_graph_min(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """(src, dst, rank, dist) between merged components: the least distance of any of their members, self first at 0."""
    up_src = parents.select(F.col("component_id").alias("src"), F.col("parent_id").alias("_src"))
    up_dst = parents.select(F.col("component_id").alias("dst"), F.col("parent_id").alias("_dst"))
    between = edges.join(up_src, "src").join(up_dst, "dst").groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.min("dist").alias("dist")).where("src <> dst")
    own = parents.select(F.col("parent_id").alias("src")).distinct().select("src", F.col("src").alias("dst"), F.lit(0.0).alias("dist"))
    order = Window.partitionBy("src").orderBy((F.col("src") != F.col("dst")).cast("int"), "dist", "dst")
    return own.union(between).withColumn("rank", (F.row_number().over(order) - 1).cast("int")).select("src", "dst", "rank", "dist")


def _roots(matrix: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """(row_id, col_id, s): roots of the values, of rows with a size (row_id, size) times its root."""
    if sizes is None:
        return matrix.select("row_id", "col_id", F.sqrt("value").alias("s"))
    return matrix.join(sizes.select("row_id", "size"), "row_id").select("row_id", "col_id", F.sqrt(F.col("value") * F.col("size")).alias("s"))


def pair_similarity(matrix: DataFrame, limit: float = 1e-4, negative_log: bool = True, sizes: DataFrame | None = None) -> DataFrame:
    """(row_id, col_id, value) of each two rows that share a column: the sum of sqrt(p * q) where it exceeds `limit`, or minus its logarithm; with `sizes` (row_id, size)
    times the root of both rows' sizes.

    Half of the product is computed, the other half mirrored. A column of n entries meets itself n(n-1)/2 times, and all these pairs are returned: where only the best are wanted,
    `nearest_rows` has no such columns.
    """
    half = _roots(matrix, sizes)
    other = half.toDF("b", "col_id", "t")
    c = half.join(other, "col_id").where("row_id < b").groupBy("row_id", "b").agg(F.sum(F.col("s") * F.col("t")).alias("c")).where(F.col("c") > limit)
    value = F.greatest(-F.ln("c"), F.lit(0.0)) if negative_log else F.col("c")
    c = c.select("row_id", F.col("b").alias("col_id"), value.alias("value"))
    return c.union(transpose(c))


def _best_of_blocks(row: dict, k: int, limit: float, negative_log: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other row, value) of the k best of each row of one block among those of another, and the other way round."""
    (ids, x), (others, y) = ((np.frombuffer(row[s]["ids"], np.int64), [np.frombuffer(row[s][c], t) for c, t in (("row", np.int32), ("col", np.int64), ("s", float))]) for s in ("left", "right"))
    c = np.zeros((len(ids), len(others)))
    shared = np.intersect1d(x[1], y[1])
    for a in range(0, len(shared), COLUMNS):
        part = shared[a : a + COLUMNS]
        wide = []
        for n, (r, col, s) in ((len(ids), x), (len(others), y)):
            at = np.minimum(np.searchsorted(part, col), len(part) - 1)
            own = part[at] == col
            wide.append(np.zeros((n, len(part))))
            wide[-1][r[own], at[own]] = s[own]
        c += wide[0] @ wide[1].T
    c[ids[:, None] == others[None]] = 0
    value = np.full(c.shape, np.inf)
    value[c > limit] = np.maximum(-np.log(c[c > limit]), 0.0) if negative_log else -c[c > limit]
    same = len(ids) == len(others) and (ids == others).all()
    for v, own, far in ((value, ids, others), (value.T, others, ids))[: 1 if same else 2]:
        by_id = np.argsort(far)
        best = by_id[np.argsort(v[:, by_id], axis=1, kind="stable")[:, :k]]
        r = np.repeat(np.arange(len(own)), best.shape[1])
        found = v[r, best.ravel()]
        some = np.isfinite(found)
        yield own[r[some]], far[best.ravel()[some]], found[some] if negative_log else -found[some]


def nearest_rows(matrix: DataFrame, k: int, limit: float = 1e-4, negative_log: bool = True, sizes: DataFrame | None = None, heavy: int = HEAVY) -> DataFrame:
    """(row_id, col_id, value): of each row the k best of `pair_similarity`, ties by the lesser row, without all pairs being written.

    Rows that share a column of more than `heavy` entries meet in pairs of blocks, a product of which keeps the k best a row; only their other pairs are joined by column. So a
    column in every row is a matter of all pairs of blocks, and none of one task.
    """
    half = cut(_roots(matrix, sizes), "roots")
    crowded = cut(half.groupBy("col_id").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("col_id"), "crowded")
    rows = cut(half.join(crowded, "col_id", "left_semi").select("row_id").distinct().withColumn("dense", F.lit(True)), "dense")
    light = half.join(crowded, "col_id", "left_anti").join(rows, "row_id", "left").select("row_id", "col_id", "s", F.coalesce("dense", F.lit(False)).alias("dense"))
    pairs = light.join(light.toDF("b", "col_id", "t", "other"), "col_id").where("row_id < b and not (dense and other)")
    c = pairs.groupBy("row_id", "b").agg(F.sum(F.col("s") * F.col("t")).alias("c")).where(F.col("c") > limit)
    value = F.greatest(-F.ln("c"), F.lit(0.0)) if negative_log else F.col("c")
    c = c.select("row_id", F.col("b").alias("col_id"), value.alias("value"))
    found = c.union(transpose(c))
    n = rows.count()
    if n:
        many = -(-n // ROWS)

        def pack(table: pa.Table) -> pa.Table:
            ids, at = np.unique(table.column("row_id").to_numpy(), return_inverse=True)
            data = {"ids": ids.tobytes(), "row": at.astype(np.int32).tobytes(), "col": table.column("col_id").to_numpy().tobytes(), "s": table.column("s").to_numpy().tobytes()}
            return pa.table({"block": table.column("block")[:1].cast(pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in data.items()}})

        dealt = half.join(rows, "row_id", "left_semi").select(F.pmod(F.xxhash64("row_id"), F.lit(many)).cast("int").alias("block"), F.col("row_id").cast("long"), F.col("col_id").cast("long"), "s")
        blocks = cut(dealt.groupBy("block").applyInArrow(pack, "block int, ids binary, row binary, col binary, s binary"), "row-blocks")
        whole = F.struct("ids", "row", "col", "s")
        left = blocks.select(F.explode(F.sequence("block", F.lit(many - 1))).alias("other"), whole.alias("left"))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    for r, o, v in _best_of_blocks(b.slice(i, 1).to_pylist()[0], k, limit, negative_log):
                        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(o), pa.array(v)], ["row_id", "col_id", "value"])

        met = left.join(blocks.select(F.col("block").alias("other"), whole.alias("right")), "other").select("left", "right").repartition(min(many * (many + 1) // 2, 4096))
        found = found.union(met.mapInArrow(meet, "row_id long, col_id long, value double"))
    return top_k(found, k, largest=not negative_log)


def is_same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two matrices have the same entries, exactly."""
    names = ["row_id", "col_id", "value"]
    return a.select(*names).exceptAll(b.select(*names)).isEmpty() and b.select(*names).exceptAll(a.select(*names)).isEmpty()


def is_symmetric(matrix: DataFrame) -> bool:
    return is_same(matrix, transpose(matrix))


def from_edges(edges: DataFrame) -> DataFrame:
    """A graph's distances as a matrix, without the self entries."""
    return edges.where("src <> dst").select(F.col("src").alias("row_id"), F.col("dst").alias("col_id"), F.col("dist").alias("value"))


def sub_matrix(matrix: DataFrame, rows: DataFrame, boundary: bool = False) -> DataFrame:
    """Entries of the rows named (row_id) and, without `boundary`, of columns among them, scaled so that all sum to the number of rows."""
    own = matrix.join(rows.select("row_id"), "row_id", "left_semi")
    if not boundary:
        own = own.join(rows.select(F.col("row_id").alias("col_id")), "col_id", "left_semi")
    total = own.agg(F.sum("value").alias("_t"), F.count_distinct("row_id").alias("_n"))
    return own.crossJoin(F.broadcast(total)).select("row_id", "col_id", (F.col("value") * F.col("_n") / F.col("_t")).alias("value"))

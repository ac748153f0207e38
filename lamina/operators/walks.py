"""Random walks over rows of transition probabilities (row_id, col_id, p).

Each step is drawn from a hash of (seed, start, walk, step), so walks do not depend on partitions, tasks or the way they are computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.scalar import step_weight, uniform
from lamina.functions.scaling import row_unit_sum
from lamina.operators.sparse import prune, remove_diagonal
from lamina.scratch import cut
from lamina.settings import WalkSettings

#: Transitions of a table that is sent whole to each executor (20 bytes each); larger ones are walked by joins.
MOST_ENTRIES = 4_000_000

# The primes of the XXH64 hash.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def hash_longs(*values: np.ndarray | int) -> np.ndarray:
    """The same as the SQL function xxhash64 over long columns."""
    h: np.ndarray = np.uint64(42)
    with np.errstate(over="ignore"):
        for v in values:
            x = np.asarray(v, np.int64).astype(np.uint64)
            h = h + P5 + np.uint64(8)
            h = h ^ _rotl(x * P2, 31) * P1
            h = _rotl(h, 27) * P1 + P4
            h = (h ^ h >> np.uint64(33)) * P2
            h = (h ^ h >> np.uint64(29)) * P3
            h = h ^ h >> np.uint64(32)
    return h


def uniforms(seed: int, *key: np.ndarray | int) -> np.ndarray:
    """As `lamina.functions.scalar.uniform`."""
    return (hash_longs(seed, *key).astype(np.int64) % (1 << 52)) / float(1 << 52)


def prune_limit(settings: WalkSettings) -> float:
    """The value at or under which visits are dropped: what a step, `prune_steps` before the end, counts; at most one half."""
    step = min(settings.length - 1, settings.prune_steps)
    if step <= 0:
        return settings.prune_value
    left = settings.length - step
    if settings.weighting == "FIRST_VISIT":
        return min(0.5, step / settings.length)
    if settings.weighting == "CONSTANT":
        return min(0.5, float(left))
    return min(0.5, step_weight(left, settings.length, settings.weighting)) if settings.weighting in ("LINEAR", "NORMAL") else settings.prune_value


def cumulative(steps: DataFrame) -> DataFrame:
    """`steps` with upto: the running sum of p in each row, by ascending column."""
    return steps.withColumn("upto", F.sum("p").over(Window.partitionBy("row_id").orderBy("col_id")))


def _by_kernel(steps: DataFrame, starts: DataFrame, s: WalkSettings) -> DataFrame:
    t = steps.select("row_id", "col_id", "p").orderBy("row_id", "col_id").toArrow()
    row, col, p = (t.column(c).to_numpy() for c in ("row_id", "col_id", "p"))
    nodes, first = np.unique(row, return_index=True)
    ends = np.append(first[1:], len(row))
    # cumulative within each row, shifted by the row's place so that one search serves all rows
    total = np.cumsum(p)
    upto = total - np.repeat(np.concatenate(([0.0], total))[first], ends - first)
    shared = starts.sparkSession.sparkContext.broadcast((nodes, first, ends, col, np.minimum(upto, 1.0) + np.repeat(np.arange(len(nodes)), ends - first) * 2.0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, first, ends, col, keys = shared.value
        walk = np.arange(s.num_walks)
        for batch in batches:
            ids = batch.column("row_id").to_numpy()
            for some in np.array_split(ids, max(1, len(ids) // 256)):
                at = np.repeat(some, s.num_walks)
                start, number = at, np.tile(walk, len(some))
                hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for step in range(s.length):
                    i = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
                    known = nodes[i] == at
                    place = np.searchsorted(keys, i * 2.0 + uniforms(s.seed, start, number, np.int64(step)), side="right")
                    moves = known & (place < ends[i])
                    at = np.where(moves, col[np.minimum(place, len(col) - 1)], at)
                    hits.append((start, at, np.full(len(at), step + 1 if s.weighting == "FIRST_VISIT" else step_weight(step, s.length, s.weighting), np.float64)))
                a, b, w = (np.concatenate(x) for x in zip(*hits, strict=True))
                if s.weighting == "FIRST_VISIT":
                    n = np.tile(number, s.length)
                    order = np.lexsort((w, b, n, a))
                    a, b, n, w = a[order], b[order], n[order], w[order]
                    new = np.ones(len(a), bool)
                    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (n[1:] != n[:-1])
                    new &= a != b  # a walk has been at its start already
                    a, b, w = a[new], b[new], w[new]
                elif s.weighting == "ONLYLAST":
                    a, b, w = a[w > 0], b[w > 0], w[w > 0]
                if not len(a):
                    continue
                order = np.lexsort((b, a))
                a, b, w = a[order], b[order], w[order]
                heads = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
                sums = np.add.reduceat(w, heads)
                if s.weighting == "FIRST_VISIT":
                    mean = sums / np.diff(np.append(heads, len(a)))
                    sums = np.maximum(s.length - mean, 0) / max(s.length - 1, 1)  # arrivals in step 1 to L count 1 to 0
                yield pa.RecordBatch.from_arrays([pa.array(a[heads]), pa.array(b[heads]), pa.array(sums)], ["row_id", "col_id", "value"])

    return starts.select("row_id").mapInArrow(work, "row_id long, col_id long, value double")


def _by_joins(steps: DataFrame, starts: DataFrame, s: WalkSettings) -> DataFrame:
    """A table of walkers, one row each, joined with the rows they stand on, step by step."""
    rows = cut(cumulative(steps).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("col_id", "upto"))).alias("out")), "rows")
    at = starts.select(F.col("row_id").alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(s.num_walks - 1).cast("long"))).alias("walk")).withColumn("at", F.col("start"))
    visits = None
    for step in range(s.length):
        u = uniform(s.seed, F.col("start"), F.col("walk"), F.lit(step).cast("long"))
        moved = at.withColumn("u", u).join(rows, at["at"] == rows["row_id"], "left")
        to = F.filter("out", lambda x: x["upto"] > F.col("u")).getItem(0)["col_id"]
        at = cut(moved.select("start", "walk", F.coalesce(to, "at").alias("at")), "walkers")
        one = at.select("start", "walk", F.col("at").alias("col_id"), F.lit(step).alias("step"), F.lit(step_weight(step, s.length, s.weighting)).alias("w"))
        visits = one if visits is None else visits.union(one)
    if s.weighting == "FIRST_VISIT":
        first = visits.where("start <> col_id").groupBy("start", "walk", "col_id").agg((F.min("step") + 1).alias("step"))
        mean = first.groupBy("start", "col_id").agg(F.avg("step").alias("m"))
        weight = F.greatest(s.length - F.col("m"), F.lit(0.0)) / max(s.length - 1, 1)
        return mean.select(F.col("start").alias("row_id"), "col_id", weight.alias("value"))
    return visits.where("w > 0").groupBy(F.col("start").alias("row_id"), "col_id").agg(F.sum("w").alias("value"))


def hits(steps: DataFrame, settings: WalkSettings, starts: DataFrame | None = None, most: int = MOST_ENTRIES) -> DataFrame:
    """(row_id, col_id, value): weighted visits of the walks from each start (row_id); the start itself does not count as a visit.

    In each step a walk moves to the first column, ascending, at which the row's running sum exceeds a draw from 0 to 1, and stays if none does.
    """
    starts = steps.select("row_id").distinct() if starts is None else starts
    return (_by_kernel if steps.count() <= most else _by_joins)(steps, starts, settings)


def random_walks(steps: DataFrame, settings: WalkSettings, starts: DataFrame | None = None, most: int = MOST_ENTRIES) -> DataFrame:
    """Visits pruned, without the diagonal unless a row has nothing else, and each row summing to 1."""
    found = hits(steps, settings, starts, most)
    limit = prune_limit(settings)
    return row_unit_sum(remove_diagonal(prune(found, limit) if limit > 0 else found))

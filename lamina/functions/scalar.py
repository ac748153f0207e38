"""Scalar expressions: distances of arrays, clamps, step weights, grid arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-6
# Steps to the neighbours of a pixel as (row, column), in the order that decides ties.
FOUR = ((-1, 0), (0, 1), (1, 0), (0, -1))
EIGHT = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def unrolled(a: Column, b: Column, dim: int, term) -> Column:
    """A sum over the elements of two arrays, written out so that it becomes generated code."""
    x = lambda c, i: c.getItem(i).cast("double")
    parts = [term(x(a, i), x(b, i)) for i in range(dim)]
    while len(parts) > 1:  # a balanced tree keeps the expression shallow
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else F.lit(0.0)


def l2_squared(a: Column, b: Column, dim: int) -> Column:
    return unrolled(a, b, dim, lambda x, y: (x - y) * (x - y))


def l2(a: Column, b: Column, dim: int) -> Column:
    return F.sqrt(l2_squared(a, b, dim))


def inner_product(a: Column, b: Column, dim: int) -> Column:
    return unrolled(a, b, dim, lambda x, y: x * y)


def cosine(a: Column, b: Column, dim: int) -> Column:
    return inner_product(a, b, dim) / F.sqrt(inner_product(a, a, dim) * inner_product(b, b, dim))


def floor_to_zero(c: Column, epsilon: float = EPSILON) -> Column:
    """Values that are zero but for rounding."""
    return F.when(c <= epsilon, F.lit(0.0)).otherwise(c)


def logistic(c: Column, top: float = 1.0, growth: float = 1.0, middle: float = 0.0) -> Column:
    return top / (1 + F.exp(-growth * (c - middle)))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def inverse_linear(c: Column) -> Column:
    return 1 / (1 + c)


def inverse(c: Column) -> Column:
    return F.when(c != 0, 1 / c)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def step_weight(step: int, length: int, weighting: str) -> float:
    """What a visit in step `step` (from 0) of a walk of `length` steps counts."""
    if weighting == "LINEAR":
        return 1 - step / length
    if weighting == "NORMAL":
        return math.exp(-0.5 * (3 * step / length) ** 2)
    if weighting == "ONLYLAST":
        return float(step == length - 1)
    return 1.0


def about_zero(c: Column, epsilon: float = EPSILON) -> Column:
    return F.abs(c) < epsilon


def about_equal(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    return F.abs(a - b) < epsilon


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.lower(text).contains(F.lower(part))


def pairs(df: DataFrame, column: str) -> DataFrame:
    """(a, b): all pairs a < b of a column's values; for short lists, such as the components of one level."""
    left, right = df.select(F.col(column).alias("a")), df.select(F.col(column).alias("b"))
    return left.join(right, F.col("a") < F.col("b"))


def values_occurring_once(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("_n")).where("_n = 1").select(column)


def uniform_integer(low: int, high: int, seed: int, *key: Column) -> Column:
    """A seeded whole number from low to high, the same for the same key on any partitioning."""
    return (low + F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(high - low + 1))).cast("long")


def uniform(seed: int, *key: Column) -> Column:
    """A seeded number from 0 to below 1 for each key."""
    return F.pmod(F.xxhash64(F.lit(seed).cast("long"), *key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def in_disc(radius: float, seed: int, *key: Column) -> tuple[Column, Column]:
    """A seeded point, evenly spread over a disc."""
    r, angle = radius * F.sqrt(uniform(seed, *key)), 2 * math.pi * uniform(seed + 1, *key)
    return r * F.cos(angle), r * F.sin(angle)


def pixel_neighbors(points: DataFrame, rows: int, cols: int, connection: str = "FOUR") -> DataFrame:
    """(point_id, neighbor_id, ord): the neighbours inside the grid of each point, which lies at (id div cols, id mod cols)."""
    steps = FOUR if connection == "FOUR" else EIGHT
    step = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(i).alias("ord")) for i, (r, c) in enumerate(steps)]))
    r, c = F.floor(F.col("point_id") / cols) + F.col("s.dr"), F.col("point_id") % cols + F.col("s.dc")
    return points.select("point_id", step.alias("s")).where((r >= 0) & (r < rows) & (c >= 0) & (c < cols)).select("point_id", (r * cols + c).cast("long").alias("neighbor_id"), F.col("s.ord").alias("ord"))

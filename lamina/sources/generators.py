"""Seeded point clouds; a point's place depends on its id and the seed only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.scalar import uniform

TAU = 2 * math.pi


def _normal(seed: int, *key: Column) -> Column:
    """Seeded standard normal values, from two even ones."""
    return F.sqrt(-2 * F.ln(1 - uniform(seed, *key))) * F.cos(TAU * uniform(seed + 7919, *key))


def _points(ids: DataFrame, *axes: Column) -> DataFrame:
    return ids.select("point_id", F.array(*[a.cast("float") for a in axes]).alias("features"))


def _ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "point_id")


def uniform_points(spark: SparkSession, n: int, dims: int, seed: int = 1, low: float = 0.0, high: float = 1.0) -> DataFrame:
    axis = lambda i: low + (high - low) * uniform(seed + i, F.col("point_id"))
    return _points(_ids(spark, n), *[axis(i) for i in range(dims)])


def swiss_roll(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """t = 1.5 pi (1 + 2u): (t cos t, t sin t, 21 u')."""
    i = F.col("point_id")
    t = 1.5 * math.pi * (1 + 2 * uniform(seed, i))
    e = [noise * _normal(seed + 100 + k, i) for k in range(3)]
    return _points(_ids(spark, n), t * F.cos(t) + e[0], t * F.sin(t) + e[1], 21 * uniform(seed + 1, i) + e[2])


def s_curve(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """t = 3 pi (u - 0.5): (sin t, sign(t) (cos t - 1), 2 u')."""
    i = F.col("point_id")
    t = 3 * math.pi * (uniform(seed, i) - 0.5)
    e = [noise * _normal(seed + 100 + k, i) for k in range(3)]
    return _points(_ids(spark, n), F.sin(t) + e[0], F.signum(t) * (F.cos(t) - 1) + e[1], 2 * uniform(seed + 1, i) + e[2])


def gaussians(spark: SparkSession, n: int, centers: list[tuple[float, float, float]], seed: int = 1) -> DataFrame:
    """Unit normal clouds around the centres, n div len(centers) points each; the last has the rest as well. `label` names the cloud."""
    i, each = F.col("point_id"), max(1, n // len(centers))
    label = F.least(F.floor(i / each), F.lit(len(centers) - 1)).cast("int")
    axis = lambda k: F.element_at(F.array(*[F.lit(float(c[k])) for c in centers]), label + 1) + _normal(seed + k, i)
    return _ids(spark, n).select("point_id", label.alias("label"), F.array(*[axis(k).cast("float") for k in range(3)]).alias("features"))

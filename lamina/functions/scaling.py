"""Scaling of points by channel, and of sparse rows (row_id, col_id, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.aggregates import quantile
from lamina.settings import SCALERS, one_of


def channels(points: DataFrame) -> DataFrame:
    """(point_id, channel, value): the long form of points."""
    return points.select("point_id", F.posexplode("features").alias("channel", "value")).withColumn("value", F.col("value").cast("double"))


def points_of(long: DataFrame) -> DataFrame:
    """(point_id, features): the points of a long form."""
    cells = F.array_sort(F.collect_list(F.struct("channel", "value")))
    return long.groupBy("point_id").agg(F.transform(cells, lambda s: s["value"]).alias("features"))


def _stats(points: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates by channel: as many rows as there are channels."""
    return channels(points).groupBy("channel").agg(*aggregates)


def _scaled(points: DataFrame, stats: DataFrame, value: Column) -> DataFrame:
    """Each feature through `value`, an expression in `x` and the channel's statistics `s`, without exploding the points.

    The statistics are one row a channel, gathered into one array: their size is that of a single point.
    """
    names = stats.columns
    row = stats.agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_stats"))
    pair = points.crossJoin(F.broadcast(row))
    features = F.transform(F.arrays_zip(F.col("features").alias("x"), F.col("_stats").alias("s")), value)
    return pair.withColumn("features", features).select(*points.columns)


def standard(points: DataFrame) -> DataFrame:
    """(x - mean) / population deviation by channel; channels without spread become 0."""
    stats = _stats(points, F.avg("value").alias("m"), F.stddev_pop("value").alias("d"))
    return _scaled(points, stats, lambda z: F.when(z["s"]["d"] > 0, (z["x"] - z["s"]["m"]) / z["s"]["d"]).otherwise(F.lit(0.0)))


def uniform(points: DataFrame) -> DataFrame:
    """x / greatest by channel, the least not moved; channels whose greatest is 0 stay."""
    stats = _stats(points, F.max("value").alias("m"))
    return _scaled(points, stats, lambda z: F.when(z["s"]["m"] != 0, z["x"] / z["s"]["m"]).otherwise(z["x"].cast("double")))


def min_max(points: DataFrame) -> DataFrame:
    """(x - least) / range by channel; a range of 0 counts as 1."""
    stats = _stats(points, F.min("value").alias("a"), F.max("value").alias("z"))
    return _scaled(points, stats, lambda z: (z["x"] - z["s"]["a"]) / F.when(z["s"]["z"] > z["s"]["a"], z["s"]["z"] - z["s"]["a"]).otherwise(F.lit(1.0)))


def robust(points: DataFrame) -> DataFrame:
    """All values cut to 0 and the 0.95 quantile of them all, then divided by it; a quantile of 0 leaves the cut values."""
    top = quantile(channels(points), "value", 0.95, "linear").withColumnRenamed("quantile", "_top")
    cut = lambda x: F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.col("_top"))
    return points.crossJoin(F.broadcast(top)).withColumn("features", F.transform("features", lambda x: F.when(F.col("_top") != 0, cut(x) / F.col("_top")).otherwise(cut(x)))).select(*points.columns)


def scale(points: DataFrame, scaler: str) -> DataFrame:
    one_of("scaler", scaler, SCALERS)
    return {"NONE": lambda p: p, "STANDARD": standard, "UNIFORM": uniform, "ROBUST": robust}[scaler](points)


def unit_sum(c: Column) -> Column:
    """Values of an array over their sum."""
    total = F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return F.transform(c, lambda x: x / total)


def max_abs(c: Column) -> Column:
    """Values of an array over the greatest absolute one."""
    top = F.array_max(F.transform(c, F.abs))
    return F.transform(c, lambda x: x / top)


def row_unit_sum(matrix: DataFrame, row: str = "row_id", value: str = "value") -> DataFrame:
    """Each row of a sparse matrix over its sum; rows that sum to 0 stay."""
    total = F.sum(value).over(Window.partitionBy(row))
    return matrix.withColumn(value, F.when(total != 0, F.col(value) / total).otherwise(F.col(value)))


def matrix_unit_sum(matrix: DataFrame, value: str = "value") -> DataFrame:
    """A sparse matrix over the sum of all its values."""
    total = matrix.agg(F.sum(value).alias("_total"))
    return matrix.crossJoin(F.broadcast(total)).withColumn(value, F.when(F.col("_total") != 0, F.col(value) / F.col("_total")).otherwise(F.col(value))).drop("_total")


def rows_by(matrix: DataFrame, weights: DataFrame, row: str = "row_id", value: str = "value") -> DataFrame:
    """Each row of a sparse matrix over the weight that `weights` (row_id, weight) has for it."""
    return matrix.join(weights.toDF(row, "_weight"), row).withColumn(value, F.col(value) / F.col("_weight")).drop("_weight")


def row_min_max(matrix: DataFrame, row: str = "row_id", value: str = "value") -> DataFrame:
    """Each row's values from 0 to 1; a range of 0 counts as 1."""
    w = Window.partitionBy(row)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return matrix.withColumn(value, (F.col(value) - low) / F.when(high > low, high - low).otherwise(F.lit(1.0)))

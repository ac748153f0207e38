"""Quantiles, histograms and sparsity figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.scratch import cut


def quantile(df: DataFrame, column: str, q: float, interpolation: str = "midpoint", ignore: tuple[float, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, quantile): exact, at place q * (n - 1). `linear` weighs the two values there, `midpoint` takes their mean if they are two.

    Nulls and ignored values don't count. Groups without values have no row, but an ungrouped result has one, null.
    """
    rows = df.where(~F.col(column).isin(list(ignore))) if ignore else df
    value = F.col(column).cast("double")
    if interpolation == "linear":
        return rows.groupBy(*by).agg(F.percentile(value, F.lit(q)).alias("quantile"))
    if interpolation != "midpoint":
        raise ValueError(f"interpolation: {interpolation!r}")
    # both neighbours of the place are exact percentiles themselves, at whole ranks
    n = rows.groupBy(*by).agg(F.count(value).alias("_n"))
    place = (F.col("_n") - 1) * F.lit(q)
    whole = F.abs(place - F.round(place)) < 1e-9
    ranks = n.select(*by, F.when(whole, F.round(place)).otherwise(F.floor(place)).cast("long").alias("_lo"), F.when(whole, F.round(place)).otherwise(F.ceil(place)).cast("long").alias("_hi"))
    counted = rows.where(value.isNotNull()).groupBy(*by, value.alias("_v")).agg(F.count("*").alias("_c"))
    if by:
        upto = counted.withColumn("_end", F.sum("_c").over(Window.partitionBy(*by).orderBy("_v")))
    else:  # ranges of values are summed up apart, so that no task sees all values
        dealt = cut(counted.repartitionByRange("_v").withColumn("_range", F.spark_partition_id()), "quantile")
        before = dealt.groupBy("_range").agg(F.sum("_c").alias("_own")).select("_range", (F.sum("_own").over(Window.orderBy("_range")) - F.col("_own")).alias("_before"))
        upto = dealt.join(F.broadcast(before), "_range").withColumn("_end", F.col("_before") + F.sum("_c").over(Window.partitionBy("_range").orderBy("_v")))
    upto = upto.withColumn("_start", F.col("_end") - F.col("_c"))
    both = upto.join(ranks, list(by)) if by else upto.crossJoin(F.broadcast(ranks))
    at = lambda r: F.max(F.when((F.col("_start") <= F.col(r)) & (F.col(r) < F.col("_end")), F.col("_v")))
    return both.groupBy(*by).agg(((at("_lo") + at("_hi")) / 2).alias("quantile"))


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float, weight: Column | None = None) -> DataFrame:
    """(bin, count): equal bins from low to high, high in the last; -1 counts what is below, `bins` what is above. Nulls don't count."""
    value = F.col(column).cast("double")
    place = F.floor((value - low) / (high - low) * bins)
    bin_ = F.when(value < low, F.lit(-1)).when(value > high, F.lit(bins)).otherwise(F.least(place, F.lit(bins - 1)))
    return df.where(value.isNotNull()).groupBy(bin_.cast("long").alias("bin")).agg((F.count("*") if weight is None else F.sum(weight)).alias("count"))


def sparsity(matrix: DataFrame, rows: int, threshold: float = 0.0, row: str = "row_id", value: str = "value") -> DataFrame:
    """One row: entries, entries above a threshold, mean entries a row, and the share of a square matrix that is empty."""
    n = F.count("*")
    return matrix.agg(n.alias("nnz"), F.count_if(F.col(value) > threshold).alias("above"), (n / rows).alias("mean_row"), (1 - n / (float(rows) * rows)).alias("sparsity"))

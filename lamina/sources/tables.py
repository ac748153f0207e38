"""Points and results as Parquet; nested vectors, matrices and graphs are tables of entries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import schema
from lamina.operators.hierarchy import Hierarchy
from lamina.operators.levels import distribution_stats
from lamina.scratch import put


def read_points(spark: SparkSession, path: str, id_col: str, vec_col: str, cols: int | None = None) -> DataFrame:
    """(point_id, row, col, features); without `cols` the grid is the one of `grid`."""
    raw = spark.read.parquet(path).select(F.col(id_col).cast("long").alias("point_id"), F.col(vec_col).cast("array<float>").alias("features"))
    width = cols or grid(raw.count())[1]
    return raw.select("point_id", F.floor(F.col("point_id") / width).cast("int").alias("row"), (F.col("point_id") % width).cast("int").alias("col"), "features")


def grid(n: int) -> tuple[int, int]:
    """(rows, cols) of the grid of n pixels with the least width that is no less than its height."""
    cols = next(d for d in range(max(1, int(n**0.5)), n + 1) if d * d >= n and n % d == 0) if n else 1
    return n // cols if n else 0, cols


def write(df: DataFrame, path: str, by_level: bool = False, codec: str = "lz4") -> None:
    """A table as Parquet, compressed; levels in folders of their own, so that reading one skips the others."""
    out = df.write.mode("overwrite").option("compression", codec)
    (out.partitionBy("level") if by_level else out).parquet(path)


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table written before; `kind` names its schema in `lamina.schema`."""
    return spark.read.schema(getattr(schema, kind)).parquet(path)


def write_hierarchy(h: Hierarchy, folder: str) -> None:
    for name in ("membership", "parents", "neighbors", "walks"):
        if getattr(h, name):
            write(h.table(name), f"{folder}/{name}", by_level=True)


def write_rows(df: DataFrame, path: str) -> None:
    """Nested vectors: one row an inner vector (row_id, values)."""
    df.write.mode("overwrite").option("compression", "lz4").parquet(path)


def write_stats(h: Hierarchy, distributions: dict[int, DataFrame], path: str) -> None:
    """Statistics of the levels and of their distributions as one JSON file."""
    spark = h.membership[0].sparkSession
    rows = [r.asDict() for r in distribution_stats(distributions, spark).orderBy("level").collect()]
    put(spark, path, json.dumps({"levels": h.stats, "distributions": rows}, indent=2).encode())

"""Tables in the folder that driver and executors share, which end a lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: What the names of tables in the catalog start with whose files lie in the scratch folder.
TABLES = "lamina_scratch_"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, in a local session, a folder of our own where that is unset. On a cluster it must be set: no executor sees another's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lamina-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _file(spark: SparkSession, path: str) -> tuple:
    """A path, and the file system that it lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file wherever Spark can write."""
    at, system = _file(spark, path)
    out = system.create(at, True)
    out.write(bytearray(data))
    out.close()


def put_parts(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    """Write a file part by part wherever Spark can write; no more than a part is held."""
    at, system = _file(spark, path)
    out = system.create(at, True)
    for p in parts:
        out.write(bytearray(p))
    out.close()


def get(spark: SparkSession, path: str) -> bytes:
    """Read a small file from wherever Spark can read."""
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _file(spark, path)
    return system.exists(at)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/lamina-scratch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `cut` made and that nothing will read again; others stay."""
    for df in tables:
        path = getattr(df, "_lamina_path", None)
        if path:
            at, system = _file(df.sparkSession, path)
            system.delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table in the scratch folder, and its entry in the catalog if it has one; call it when all results have been written."""
    for table in spark.catalog.listTables(pattern=f"{TABLES}*"):
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    at, system = _file(spark, f"{shared_dir(spark)}/lamina-scratch")
    system.delete(at, True)


def indexed(df: DataFrame, key: str, name: str) -> DataFrame:
    """`df` (distinct keys) with a number from 0 in the order of `key`, without one task that sees all rows.

    Rows are dealt by range; each range is ranked alone and starts where the ranges before it end.
    """
    dealt = cut(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return dealt.withColumn(name, rank).join(F.broadcast(before), "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")

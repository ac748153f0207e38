"""Stages that are computed once: their tables lie in a folder, under a name made of all settings that matter and of the data."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.scratch import exists, get, put
from lamina.settings import run_id

VERSION = "1"


def fingerprint(df: DataFrame) -> str:
    """A name for a table's rows, whatever their order: their number, and the sum and the exclusive or of their hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    row = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return ":".join(map(str, row))


class Stages:
    """Tables of stages under a folder that Spark reads and writes. A stage is loaded only if all before it were."""

    def __init__(self, spark: SparkSession, folder: str, data: str) -> None:
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), data
        self.fresh = False

    def table(self, name: str, settings: Any, build: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table: read if it was made from the same settings and data, else built and written."""
        return self.tables(name, settings, lambda: {"rows": build()})["rows"]

    def tables(self, name: str, settings: Any, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """As `table`, for a stage of several tables by name. A file that is written last tells that all are there."""
        self.name = run_id(settings, data=f"{VERSION}/{self.name}/{name}")
        folder = f"{self.folder}/{name}-{self.name}"
        if self.fresh or not exists(self.spark, f"{folder}/names.json"):
            self.fresh = True
            made = build()
            for key, df in made.items():
                df.write.mode("overwrite").option("compression", "lz4").parquet(f"{folder}/{key}")
            put(self.spark, f"{folder}/names.json", json.dumps(sorted(made)).encode())
        return {key: self.spark.read.parquet(f"{folder}/{key}") for key in json.loads(get(self.spark, f"{folder}/names.json"))}

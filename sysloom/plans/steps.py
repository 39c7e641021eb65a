"""Chains of operators whose results are kept by what they were made from."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sysloom.functions.scalars import step_key


class Steps:
    """Results of steps as Parquet under ``folder``, named by their keys; a step with the same parent, name, version and parameters is read, not run again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.hits, self.misses = spark, folder.rstrip("/"), 0, 0

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def run(self, parent: str, name: str, version: str, parameters: Mapping[str, Any], make: Callable[[], DataFrame]) -> tuple[str, DataFrame]:
        """The step's key and its result."""
        key = step_key(parent, name, version, parameters)
        path = f"{self.folder}/{key}"
        if self._exists(f"{path}/_SUCCESS"):  # written last, so half-written results don't count
            self.hits += 1
        else:
            self.misses += 1
            make().write.mode("overwrite").parquet(path)
        return key, self.spark.read.parquet(path)

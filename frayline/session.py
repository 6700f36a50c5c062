"""Sessions come from the caller; this only lets Python workers import the package from a source folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def workers_find_package(spark: SparkSession) -> None:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)

"""Severities and defaults of the experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The native parameter of each corruption at severities 1 to 5.
SEVERITY = {
    "gaussian_noise": (8.0, 16.0, 24.0, 40.0, 64.0),
    "gaussian_blur": (0.5, 1.0, 2.0, 3.5, 5.0),
    "cutout": (0.05, 0.10, 0.20, 0.35, 0.50),
    "mask": (0.10, 0.20, 0.40, 0.60, 0.80),
    "shuffle": (0.10, 0.20, 0.40, 0.60, 0.80),
    "replace": (0.10, 0.20, 0.40, 0.60, 0.80),
}
IMAGE, TEXT = ("gaussian_noise", "gaussian_blur", "cutout"), ("mask", "shuffle", "replace")
SEEDS, K_POOL, PAIRS_MAIN, PAIRS_RETRIEVAL = (0, 1, 2), 64, 300, 1000


def severity(kind: str, level: int) -> float:
    """The parameter of a corruption; severity 0 is the clean item and has none."""
    if kind not in SEVERITY:
        raise KeyError(f"unknown corruption: {kind}")
    if level not in range(1, 6):
        raise ValueError(f"severity must be 1 to 5, not {level}")
    return SEVERITY[kind][level - 1]


def severity_column(kind: str, level: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in SEVERITY[kind]]), level.cast("int") - 1)


def severity_table(spark: SparkSession) -> DataFrame:
    rows = [("image" if k in IMAGE else "text", k, i + 1, v) for k, values in SEVERITY.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "modality string, corruption_type string, severity int, param double")

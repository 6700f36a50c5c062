"""Resumable measurement runs: cells (a model and a seed) that are written, marked as done, and skipped by the next run.

A cell is one partition folder.  Writing overwrites just the folders of the cells at hand, and a
cell counts as done only when its marker is there, which is written after its rows; so a run that
was killed at any point is started again with the same call and ends with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import exists

#: Cells that one run may plan: reports have a few models and seeds.
MOST_CELLS = 10_000


def _table(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def done_cells(spark: SparkSession, path: str, cell: list[str]) -> set[tuple]:
    """Cells whose marker is there."""
    if not exists(spark, _table(path, "done")):
        return set()
    rows = spark.read.parquet(_table(path, "done")).select(*cell).distinct().limit(MOST_CELLS + 1).collect()
    return {tuple(map(str, r)) for r in rows}


def planned_cells(rows: DataFrame, path: str, cell: list[str]) -> list[tuple]:
    """Cells of ``rows`` that are not done yet, in order."""
    found = rows.select(*[F.col(c).cast("string").alias(c) for c in cell]).distinct().limit(MOST_CELLS + 1).collect()
    if len(found) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    done = done_cells(rows.sparkSession, path, cell)
    return sorted(c for c in map(tuple, found) if c not in done)


def run_cells(rows: DataFrame, path: str, cell: tuple[str, ...] = ("model", "seed"), at_once: int = 16, after: Callable[[list[tuple]], None] | None = None) -> list[tuple]:
    """Write the rows of every cell that is not done, ``at_once`` cells in a job; returns the cells written.

    ``after`` is called when a job's rows are written and before its markers are: where tests
    end a run.  Rows with a null in their cell are left out.
    """
    cell, spark = list(cell), rows.sparkSession
    for c in cell:
        rows = rows.where(F.col(c).isNotNull())
    todo = planned_cells(rows, path, cell)
    for at in range(0, len(todo), at_once):
        part = todo[at : at + at_once]
        wanted = F.struct(*[F.col(c).cast("string") for c in cell]).isin(*[F.struct(*[F.lit(x) for x in c]) for c in part])  # a filter that reaches the scan's partitions
        own = rows.where(wanted)
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cell).parquet(_table(path, "rows"))
        if after is not None:
            after(part)
        written = spark.read.parquet(_table(path, "rows")).where(wanted).groupBy(*[F.col(c).cast("string").alias(c) for c in cell]).agg(F.count("*").alias("n"))
        written.coalesce(1).write.mode("append").parquet(_table(path, "done"))
    return todo


def cell_rows(spark: SparkSession, path: str, cell: tuple[str, ...] = ("model", "seed")) -> DataFrame:
    """The rows of the cells that are done; those of a job that did not end are left out."""
    done = spark.read.parquet(_table(path, "done")).select(*cell).distinct()
    rows = spark.read.parquet(_table(path, "rows"))
    return rows.withColumns({c: F.col(c).cast("string") for c in cell}).join(done, list(cell), "left_semi")

"""Sinks of measurement tables and report texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MEASUREMENTS, require_columns


def append_measurements(rows: DataFrame, path: str) -> None:
    """Append as Parquet by (spoke, model, seed): readers prune folders; doubles to six places, further columns left out."""
    names = [f.name for f in MEASUREMENTS.fields]
    require_columns(rows, names)
    rows.select(names).withColumn("value", F.round("value", 6)).write.mode("append").partitionBy("spoke", "model", "seed").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, nullValue="")


def latex_rows(summary: DataFrame, columns: list[str], order: list[str]) -> str:
    """Body of a LaTeX table from a small summary (one row a cell of the report)."""
    rows = summary.select(columns).orderBy(order).collect()
    cells = lambda r: " & ".join("n/a" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r)
    return " \\\\\n".join(cells(r) for r in rows)


def report_section(title: str, summary: DataFrame, order: list[str]) -> str:
    """A heading and the rows of a small summary as text."""
    rows = summary.orderBy(order).collect()
    lines = [", ".join(f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in r.asDict().items()) for r in rows]
    return "\n".join([title, "-" * len(title), *lines])

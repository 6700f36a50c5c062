"""An extension: measurements that arrive as a stream are appended batch by batch, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import append_measurements


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    def add(batch: DataFrame, number: int) -> None:
        append_measurements(batch, f"{path}/batch={number}") if not _done(batch, path, number) else None

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _done(batch: DataFrame, path: str, number: int) -> bool:
    """Whether a batch that is being replayed is complete already."""
    try:
        batch.sparkSession.read.text(f"{path}/batch={number}/_SUCCESS")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False
    return True

"""Manifests that grow by batches: ``python -m frayline.streaming.manifest --source DIR --out DIR --checkpoint DIR [--target N]``.

Every batch is a folder of its number, so a batch that is replayed replaces itself or, where it
is complete, is left alone.  Contents that earlier batches hold are not added again, and the
run ends as soon as the manifest has as many items as are wanted.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.manifest import MANIFEST, dedup_by_content, new_items
from ..sources.views import exists
from .append import _done


def read_batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The manifest up to a batch, or nothing yet."""
    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before)


def append_batch(batch: DataFrame, number: int, path: str, content: Column, order: str, target: int | None = None) -> int:
    """Add what is new in a batch; how many items the manifest has then.

    The items of a batch are written before they count, and a complete batch is not written again.
    """
    spark = batch.sparkSession
    if not _done(batch, path, number):
        have = read_batches(spark, path, number)
        if have is None:
            fresh = dedup_by_content(batch.where(content.isNotNull()), content, order)
            fresh = fresh if target is None else fresh.orderBy(order).limit(target)
        else:
            fresh = new_items(have, batch, content, order, target)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return read_batches(spark, path).count()


def build_manifest(items: DataFrame, path: str, checkpoint: str, content: Column, order: str, target: int | None = None) -> int:
    """Run a stream of items into a manifest until it is exhausted or the target is reached; how many items there are.

    Started again with the same folders it goes on behind the last batch that is complete.
    """
    spark, reached = items.sparkSession, []
    have = read_batches(spark, path)
    if target is not None and have is not None and (n := have.count()) >= target:
        return n

    def add(batch: DataFrame, number: int) -> None:
        if not reached and (n := append_batch(batch, number, path, content, order, target)) >= (target if target is not None else n + 1):
            reached.append(n)

    run: StreamingQuery = items.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not run.awaitTermination(1):
        if reached:
            run.stop()
    have = read_batches(spark, path)
    return 0 if have is None else have.count()


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("source", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--target", type=int)
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    items = spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", 1).json(args.source)
    print(build_manifest(items, args.out, args.checkpoint, F.col("bytes_hex"), "id", args.target))
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Run registered queries over a data folder: ``python -m frayline.plans.run --data DIR --out DIR [--dry-run] [QUERY ...]``.

Each result is written as Parquet in a folder of its name; a query that fails is reported and the others go on.
With ``--cells`` the measurements of every (model, seed) are written instead; a run that was stopped goes on where it was.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cells, experiment, queries, reports  # noqa: F401  (they register their queries)
from .queries import QUERIES


def run(spark: SparkSession, data: str, out: str, names: list[str] | None = None, dry_run: bool = False) -> dict[str, str]:
    """What became of each query: ``planned``, ``written`` or its error."""
    if unknown := [n for n in names or [] if n not in QUERIES]:
        raise KeyError(f"unknown queries: {unknown}")
    found = {}
    for name in names or sorted(QUERIES):
        found[name] = "planned"
        if not dry_run:
            try:
                QUERIES[name](spark, data).write.mode("overwrite").parquet(f"{out}/{name}")
                found[name] = "written"
            except Exception as e:  # noqa: BLE001
                found[name] = f"failed: {str(e).splitlines()[0][:200]}"
    return found


def measurements(spark: SparkSession, data: str) -> DataFrame:
    """Retention under all conditions as rows of the measurement table; the label of a pair's vectors stands for the model."""
    rows = experiment.retention_conditions(spark, data)
    models = queries.read(spark, data, "embeddings").where("vec_id % 2 = 0").select(F.expr("vec_id div 2").alias("pair_id"), F.concat(F.lit("model"), (F.col("label") % 3).cast("string")).alias("model"))
    image = F.col("direction") == "i2t"
    rows = rows.join(models, "pair_id").withColumns(
        {
            "seed": (F.col("pair_id") % 3).cast("int"), "match_retention_direction": F.col("direction"), "vision_corruption": F.when(image, F.col("corruption")).otherwise("none"),
            "text_corruption": F.when(image, "none").otherwise(F.col("corruption")), "image_severity": F.when(image, F.col("severity")).otherwise(0), "text_severity": F.when(image, 0).otherwise(F.col("severity")),
        }
    )
    return experiment.base_rows(rows, spoke="match_retention")


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--cells", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args(arguments)
    if args.cells:
        spark = SparkSession.builder.getOrCreate()
        rows = measurements(spark, args.data)
        for c in cells.planned_cells(rows, args.out, ["model", "seed"]) if args.dry_run else cells.run_cells(rows, args.out):
            print(f"{'/'.join(c)}: {'planned' if args.dry_run else 'written'}")
        return 0
    found = run(SparkSession.builder.getOrCreate(), args.data, args.out, args.names or None, args.dry_run)
    for name, state in found.items():
        print(f"{name}: {state}")
    return int(any(s.startswith("failed") for s in found.values()))


if __name__ == "__main__":
    sys.exit(main())

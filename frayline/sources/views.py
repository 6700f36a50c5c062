"""Checked reading and lookups: inputs that must exist, joins on the full key, baselines that must be there."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What identifies a corrupted item.
KEY = ("seed", "pair_id", "corruption", "severity")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds anything at a path of any store."""
    try:
        spark.read.format("binaryFile").load(path).schema  # noqa: B018
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False
    return True


def require_inputs(spark: SparkSession, paths: list[str]) -> None:
    """Fail before any work if an input is missing."""
    if missing := [p for p in paths if not exists(spark, p)]:
        raise FileNotFoundError(f"missing inputs: {missing}")


def read_first(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The Parquet table at the first path that exists: newer generations come first."""
    for path in paths:
        if exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(f"none of {paths}")


def read_config(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON file of settings, read through Spark."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def rows_of(measurements: DataFrame, spoke: str, **equal: object) -> DataFrame:
    """The measurements of one spoke, and of the given values of other columns."""
    rows = measurements.where(F.col("spoke") == spoke)
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return rows


def with_damage(scores: DataFrame, damage: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Scores with the damage of their full key; a key that the damage table repeats is an error, not more rows."""
    columns = [c for c in damage.columns if c not in key]
    once = damage.groupBy(*key).agg(*[F.max(c).alias(c) for c in columns], F.count("*").alias("_copies"))
    checked = once.withColumn("_copies", F.when(F.col("_copies") > 1, F.raise_error(F.lit("damage keys repeat"))).otherwise(F.lit(0)))
    return scores.join(checked, list(key)).where("_copies = 0").drop("_copies")


def clean_baseline(rows: DataFrame, group: list[str], value: str = "value", severities: tuple[str, ...] = ("severity",)) -> DataFrame:
    """``clean``: mean of the rows of each group whose severities are all 0; there is no fallback to others."""
    for name in severities:
        rows = rows.where(F.coalesce(F.col(name).cast("int"), F.lit(-1)) == 0)
    return rows.groupBy(*group).agg(F.avg(value).alias("clean"), F.count("*").alias("clean_n"))


def require_clean(rows: DataFrame, **of: object) -> float:
    """The clean baseline of one model (and metric); raises where there is none."""
    for name, value in of.items():
        rows = rows.where(F.col(name) == value)
    found = clean_baseline(rows, [], severities=("image_severity", "text_severity")).first()
    if not found["clean_n"]:
        raise ValueError(f"no clean baseline of {of}")
    return found["clean"]


def looked_up(rows: DataFrame, table: DataFrame, key: list[str], value: str) -> DataFrame:
    """``value`` of a small table for every row; a key that it lacks is an error."""
    found = rows.join(table.select(*key, F.col(value).alias("_found")), key, "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no entry for"), *[F.col(k).cast("string") for k in key])).cast("double")
    return found.withColumn(value, F.coalesce("_found", missing)).drop("_found")


def pivot_once(rows: DataFrame, index: str, column: str, values: list, value: str) -> DataFrame:
    """A pivot without aggregation; a repeated cell is an error."""
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("repeated cell in a pivot")).cast("double")).otherwise(F.max(value))
    return rows.groupBy(index).pivot(column, values).agg(once)


def in_order(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """``position`` of each value in a stated order; values outside it are left out."""
    table = rows.sparkSession.createDataFrame(list(enumerate(order)), f"position int, {column} string")
    return rows.join(F.broadcast(table), column)


def balanced(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Two arms side by side (``value_a``, ``value_b``); raises unless both have the same keys, each once."""
    one, two = (x.groupBy(*key).agg(F.avg("value").alias(f"value_{n}"), F.count("*").alias(f"_{n}")) for x, n in ((a, "a"), (b, "b")))
    both = one.join(two, key, "full")
    odd = both.where("_a is null or _b is null or _a <> _b").limit(1).count()
    if odd:
        raise ValueError("paired arms need the same keys")
    return both.drop("_a", "_b")


def parts_of(rows: int, spark: SparkSession, each: int = 1 << 18) -> int:
    """Partitions for so many rows: those of the session, or as many more as keep each at ``each`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


_own_folder: list[str] = []


def settled(df: DataFrame) -> DataFrame:
    """The rows written once in the folder that driver and executors share (a folder of our own on a local master without one).

    Sums of doubles depend on the order of their terms, so a mean that is worked out twice may differ
    in its last bits: what is joined with itself by such a value has to be settled first.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append(f"file://{tempfile.mkdtemp(prefix='settled-')}")
        folder = _own_folder[0]
    path = f"{folder.rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)

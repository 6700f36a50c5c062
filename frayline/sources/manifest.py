"""Manifests of items: content dedup, seeded slices and disjoint pools, all by hashes instead of a shared generator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MANIFEST = T.StructType([T.StructField("id", T.LongType()), T.StructField("caption", T.StringType()), T.StructField("bytes_hex", T.StringType()), T.StructField("sha256", T.StringType())])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of items, payload decoded from hex; a missing file is an empty manifest."""
    try:
        raw = spark.read.schema(MANIFEST).json(path, multiLine=True)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], MANIFEST)
    return raw.withColumn("bytes", F.unhex("bytes_hex"))


def read_csv(spark: SparkSession, paths: list[str], schema: T.StructType, seeds: list[int] | None = None) -> DataFrame:
    """CSV files of one schema as one table; with ``seeds`` each file's rows get its seed."""
    parts = [spark.read.schema(schema).csv(p, header=True, nullValue="") for p in paths]
    if seeds is not None:
        parts = [p.withColumn("seed", F.lit(s)) for p, s in zip(parts, seeds, strict=True)]
    return reduce(DataFrame.unionByName, parts)


def dedup_by_content(items: DataFrame, content: Column, order: str) -> DataFrame:
    """One row of each content hash, the first in ``order``; an aggregate of the least row, so a hot content is combined map-side."""
    row = F.struct(F.col(order), *[c for c in items.columns if c != order])
    best = items.withColumn("sha256", F.sha2(content, 256)).groupBy("sha256").agg(F.min(row).alias("r"))
    return best.select("sha256", "r.*")


def new_items(manifest: DataFrame, batch: DataFrame, content: Column, order: str, target: int | None = None) -> DataFrame:
    """The items of a batch whose content a manifest (``sha256``) lacks, each content once; at most what is missing to ``target``."""
    fresh = dedup_by_content(batch.where(content.isNotNull()), content, order).join(manifest.select("sha256"), "sha256", "left_anti")
    return fresh if target is None else fresh.orderBy(order).limit(max(0, target - manifest.count()))


def draw(seed: Column | int, *parts: Column | str) -> Column:
    """A uniform hash of a seed and keys; orders by it are random permutations that any engine with md5 can repeat."""
    first = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws("|", first.cast("string"), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def seeded_slice(items: DataFrame, key: str, seed: int, n: int, offset: int = 0) -> DataFrame:
    """Rows offset..offset+n-1 of the seed's permutation, with their ``rank``: only the first offset+n rows are ever brought together."""
    top = items.withColumn("draw", draw(seed, key)).orderBy("draw", key).limit(offset + n)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy("draw", key)).cast("long") - 1)
    return ranked.where(F.col("rank") >= offset).drop("draw")


def disjoint_pool(items: DataFrame, key: str, skip: DataFrame, seed: int, n: int) -> DataFrame:
    """n rows of the seed's permutation whose key is not in ``skip``."""
    return seeded_slice(items.join(skip.select(key).distinct(), key, "left_anti"), key, seed, n)


def require_rows(df: DataFrame, n: int) -> DataFrame:
    if (have := df.count()) < n:
        raise RuntimeError(f"{n} rows wanted, {have} available")
    return df


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def assert_no_duplicate_ids(df: DataFrame, key: str) -> None:
    found = [r[0] for r in duplicate_ids(df, key).orderBy(key).limit(10).collect()]
    if found:
        raise ValueError(f"duplicate ids, the first ones: {found}")

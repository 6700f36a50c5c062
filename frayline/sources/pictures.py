"""Pictures from files: decoded by Spark's reader in the JVM, damaged ones as rows with an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def byte_at(data: Column, i: Column) -> Column:
    """The number at place i (from 0) of a binary, as a double."""
    return F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("double")


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """``origin, height, width, px, error`` of the pictures under a path, in any store and any format that the JVM decodes.

    ``px`` has red, green and blue of each pixel, row by row, 0 to 255; grey pictures have three equal
    numbers and transparency is left out.  A file that cannot be decoded has null sizes and an ``error``.
    """
    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    n = F.col("nChannels")
    at = lambda i: F.floor(i / 3).cast("int") * n + F.when(n == 1, 0).otherwise(2 - i % 3)  # noqa: E731  (stored as blue, green, red)
    numbers = F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") * 3 - 1), lambda i: byte_at(F.col("data"), at(i)))
    good = F.col("height") > 0
    return raw.select(
        "origin", F.when(good, F.col("height")).alias("height"), F.when(good, F.col("width")).alias("width"), F.when(good, numbers).alias("px"), F.when(~good, F.lit("not a picture")).alias("error"),
    )


def centre_square(pictures: DataFrame) -> DataFrame:
    """The largest square in the middle of every picture, as ``px`` and ``side``."""
    side = F.least("height", "width")
    top, left = F.floor((F.col("height") - F.col("side")) / 2).cast("int"), F.floor((F.col("width") - F.col("side")) / 2).cast("int")
    row, column = lambda i: F.floor(F.floor(i / 3) / F.col("side")).cast("int"), lambda i: (F.floor(i / 3) % F.col("side")).cast("int")
    spot = lambda i: ((row(i) + top) * F.col("width") + column(i) + left) * 3 + i % 3
    rows = pictures.where("error is null").withColumn("side", side)
    return rows.withColumn("px", F.transform(F.sequence(F.lit(0), F.col("side") * F.col("side") * 3 - 1), lambda i: F.get("px", spot(i)))).drop("height", "width", "error")

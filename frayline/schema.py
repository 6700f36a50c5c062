"""The long measurement table and its reading: one row is one (model, pair, condition, metric)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the measurement table, in order, and the values they may take.
MEASUREMENTS = T.StructType(
    [
        T.StructField("run_tag", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("pair_id", T.LongType()),
        T.StructField("vision_corruption", T.StringType()),
        T.StructField("image_severity", T.IntegerType()),
        T.StructField("text_corruption", T.StringType()),
        T.StructField("text_severity", T.IntegerType()),
        T.StructField("spoke", T.StringType()),
        T.StructField("depth", T.StringType()),
        T.StructField("depth_layer_index", T.IntegerType()),
        T.StructField("match_retention_direction", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("k_pool", T.IntegerType()),
        T.StructField("n_eval", T.IntegerType()),
        T.StructField("notes", T.StringType()),
    ]
)


def typed(raw: DataFrame, schema: T.StructType = MEASUREMENTS, strict: bool = False) -> DataFrame:
    """Cast string columns to the schema: empty cells and NaN become null; absent columns are null.

    Unreadable cells become null as well or, with ``strict``, raise.
    """
    out = []
    for f in schema.fields:
        if f.name not in raw.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        cell = F.nullif(F.col(f.name).cast("string"), F.lit(""))
        value = cell if isinstance(f.dataType, T.StringType) else cell.cast(f.dataType) if strict else cell.try_cast(f.dataType)
        if isinstance(f.dataType, T.DoubleType):
            value = F.when(~F.isnan(value), value)
        out.append(value.alias(f.name))
    return raw.select(out)


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")

"""Quantile bins by value edges, and average-tie percentile ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.corrupt import let

CUTS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
#: Stretches that the distinct values of a group are cut into when they are ranked; a square, for the two steps of the search.
STRETCHES, STEP = 256, 16
#: Ranks of the cuts are within this share of their places.
ACCURACY = 20_000


def _stretch(value: Column, cuts: Column) -> Column:
    """How many of the cuts (in order) lie below a value: those of every ``STEP``-th first, then those in between."""
    coarse = F.size(F.filter(cuts, lambda c, i: ((i + 1) % STEP == 0) & (c < value)))
    fine = lambda n: n * STEP + F.size(F.filter(F.slice(cuts, n * STEP + 1, STEP - 1), lambda c: c < value))
    return let(coarse, fine).cast("int")


def placed(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Counts ``_n`` of the distinct values of each group and the ``_stretch`` that a value lies in; stretches are in order.

    Cuts are approximate quantiles of the distinct values (a sketch of bounded size for each
    group), so stretches hold about the same number of them wherever the values lie.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    cuts = counts.groupBy(*group).agg(F.percentile_approx(value, [i / STRETCHES for i in range(1, STRETCHES)], ACCURACY).alias("_cuts"))
    return _joined(counts, cuts, group).select(*group, value, "_n", _stretch(F.col(value), F.col("_cuts")).alias("_stretch"))


def counted(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Counts of the distinct values of each group in order: ``_n``, ``_before`` (rows of smaller values) and ``_all``.

    Ranks are summed inside a stretch of values and over stretches, so a large group is many tasks' work.
    """
    rows = placed(df, group, value)
    sums = rows.groupBy(*group, "_stretch").agg(F.sum("_n").alias("_m"))
    whole = Window.partitionBy(*group)
    up_to = whole.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({"_start": F.sum("_m").over(up_to) - F.col("_m"), "_all": F.sum("_m").over(whole)}).drop("_m")
    inside = Window.partitionBy(*group, "_stretch").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.join(sums, [*group, "_stretch"]).withColumn("_before", F.col("_start") + F.sum("_n").over(inside) - F.col("_n"))
    return ranked.select(*group, value, "_n", "_before", "_all")


def _joined(df: DataFrame, few: DataFrame, group: list[str]) -> DataFrame:
    """With one small row of each group, or the one row if there are no groups."""
    return df.join(few, group) if group else df.crossJoin(few)


def quintile_edges(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Linear-interpolated quantiles of each group, one small row a group: joined back, never windowed."""
    rows = counted(df, group, value)
    edges = []
    for cut in CUTS:
        place = F.lit(cut) * (F.col("_all") - 1)
        at = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col(value)))
        edges += [at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))]
    got = rows.groupBy(*group).agg(*[e.alias(f"_e{i}") for i, e in enumerate(edges)])
    spots = [(f"_e{3 * i}", f"_e{3 * i + 1}", f"_e{3 * i + 2}") for i in range(len(CUTS))]
    return got.select(*group, F.array(*[F.col(a) + (F.col(b) - F.col(a)) * F.col(w) for a, b, w in spots]).alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """Right-closed bin among the distinct edges, from 1; null for null values and where all values are equal."""
    below = F.size(F.filter(F.array_distinct(F.slice(edges, 1, 5)), lambda e: e < value))
    return F.when(value.isNotNull() & (F.get(edges, F.lit(0)) < F.get(edges, F.lit(5))), F.greatest(F.lit(1), below))


def assign_quintile(df: DataFrame, group: list[str], value: str, name: str = "quintile") -> DataFrame:
    """Add the bin number ``name``; rows stay where they are, as those of a few groups would be a few tasks' work."""
    edges = F.broadcast(quintile_edges(df, group, value))  # six numbers a group
    return _joined(df, edges, group).withColumn(name, bin_of(F.col(value), F.col("edges"))).drop("edges")


def percentile_rank(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Average-tie rank over the group's size, in (0, 1].

    Ranks come from counts of distinct values, so that what is sorted shrinks with ties.  They are
    joined to the values, which must be the same when worked out again (``views.settled``).
    """
    share = (F.col("_before") + (F.col("_n") + 1) / 2) / F.col("_all")
    return df.join(counted(df, group, value).select(*group, value, share.alias(name)), [*group, value], "left")


def require_distinct_edges(edges: DataFrame) -> None:
    """Raise if a group's edges coincide, for uses in which ties must not merge bins."""
    if edges.where(F.size(F.array_distinct("edges")) < len(CUTS)).limit(1).count():
        raise ValueError("bin edges must be unique")

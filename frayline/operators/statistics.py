"""Paired and rank statistics: sums and ranks in Spark, p-values of single numbers in small functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.views import settled
from .binning import counted, percentile_rank


def ols(y: str, x: str) -> list[Column]:
    """Slope, intercept and R2; R2 is null where either side is constant."""
    flat = (F.var_pop(y) == 0) | (F.var_pop(x) == 0)
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.when(~flat, F.regr_r2(y, x)).alias("r2")]


def cohens_d_paired(diff: str) -> Column:
    sd = F.stddev_samp(diff)
    return F.when(sd > 0, F.avg(diff) / sd)


def cohens_d_independent(mean_a: Column, mean_b: Column, var_a: Column, var_b: Column) -> Column:
    pooled = F.sqrt((var_a + var_b) / 2)
    return F.when(pooled > 0, (mean_a - mean_b) / pooled)


def cohens_d_binary(p1: Column, p2: Column) -> Column:
    """Effect size of two shares."""
    return cohens_d_independent(p1, p2, p1 * (1 - p1), p2 * (1 - p2))


def wilcoxon(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Signed-rank test of each group: zero differences dropped, average ranks, the smaller of the two rank sums.

    ``n`` (differences that are not zero), ``w`` and two-sided ``p``.  Groups of fewer than two
    pairs have null ``w`` and ``p``; with fewer than two differences that are not zero, ``w``
    is null and ``p`` 1.  Ranks come from counts of distinct sizes; a group is never one task's.
    """
    diffs = settled(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*group, (F.col(a) - F.col(b)).alias("d")).withColumn("size", F.abs("d")))
    signs = diffs.where("d <> 0").groupBy(*group, "size").agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    ranked = signs.join(counted(diffs.where("d <> 0"), group, "size"), [*group, "size"])
    rank, ties = F.col("_before") + (F.col("_n") + 1) / 2, F.col("_n").cast("double")
    sums = ranked.groupBy(*group).agg(
        F.sum(rank * F.col("up")).alias("plus"), F.sum(rank * F.col("down")).alias("minus"), F.max("_all").alias("n"), F.sum(ties * ties * ties - ties).alias("ties")
    )
    found = _joined_all(diffs.groupBy(*group).agg(F.count("*").alias("pairs")), sums, group).withColumn("n", F.coalesce("n", F.lit(0)))
    w = F.when(F.col("n") >= 2, F.least("plus", "minus"))
    p = F.when(F.col("pairs") < 2, None).when(F.col("n") < 2, F.lit(1.0)).otherwise(_p_of(F.least("plus", "minus"), F.col("n"), F.col("ties")))
    return found.select(*group, "n", w.alias("w"), p.cast("double").alias("p"))


def _joined_all(few: DataFrame, fewer: DataFrame, group: list[str]) -> DataFrame:
    return few.join(fewer, group, "left") if group else few.crossJoin(fewer)


def wilcoxon_p(w: float, n: int, ties: float = 0.0) -> float:
    """Two-sided: exact by counting sign patterns up to 50 pairs without ties, else the normal limit.

    ``ties``: the sum of t**3 - t over groups of t equal sizes.
    """
    if n < 2:
        return 1.0
    if n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(math.floor(w)) + 1]) / 2**n)
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def _numbers(function):
    """A column function of single numbers (one row a group); nulls give null."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([None if any(pd.isna(x) for x in row) else function(*row) for row in zip(*columns, strict=True)], dtype=float)

    return run


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average-tie ranks; null for fewer than three pairs.

    The values are settled first: ranks are joined to them, so they must not be worked out anew.
    """
    rows = settled(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, x, y))
    ranked = percentile_rank(percentile_rank(rows, group, x, "_rx"), group, y, "_ry")
    return ranked.groupBy(*group).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("_rx", "_ry")).alias("rho"))


def seed_pairs_spearman(values: DataFrame, group: list[str], unit: list[str]) -> DataFrame:
    """Rank correlation of every two seeds over their common units (``seed, value`` and the unit's columns), in each group."""
    other = values.select(*group, *unit, F.col("seed").alias("seed_b"), F.col("value").alias("y"))
    both = values.select(*group, *unit, F.col("seed").alias("seed_a"), F.col("value").alias("x")).join(other, [*group, *unit]).where("seed_a < seed_b")
    return spearman(both, [*group, "seed_a", "seed_b"], "x", "y")


def per_cell_spearman(rows: DataFrame, cell: list[str]) -> DataFrame:
    """``seed_a, seed_b, n, rho`` of each cell over its pairs; repeated pairs count as their mean, ranks are taken after the join."""
    return seed_pairs_spearman(rows.groupBy(*cell, "pair_id", "seed").agg(F.avg("value").alias("value")), cell, ["pair_id"])


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or 1e-300)
        c = 1 + top / (c or 1e-300)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def spearman_p(rho: float, n: int) -> float:
    if n < 3:
        return math.nan
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


_p_of = _numbers(lambda w, n, ties: wilcoxon_p(float(w), int(n), float(ties)))
#: Two-sided p-value of a rank correlation ``rho`` of ``n`` pairs, as a column.
p_of_rho = _numbers(lambda rho, n: spearman_p(float(rho), int(n)))

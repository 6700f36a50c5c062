"""Bootstrap intervals of many cells at once: weights by hashes, replicates in vectors, sums by Spark.

Resampling n rows with replacement gives every row a count whose limit is a Poisson number of
mean 1.  Here a row has that number for each draw, taken from a hash of its key and of the draw;
so no row is repeated, no group is gathered, and any engine with md5 and whole numbers repeats
the draws.  A task adds up the weights and weighted values of its rows, for all draws at once, in
one vector for each cell; vectors are added up in a tree, ``FAN_IN`` at a time.  Where a task has
few rows of a cell it hands these on instead, as they are smaller than a vector.

Two levels: each draw takes as many seeds as the group has, with replacement, and a resample of
the rows of each of them (another one for a seed that is taken twice); its mean is the mean of
these means.  A resample in which all weights are 0 counts as the rows' own mean; with n rows that
happens in a share exp(-n) of the draws.  Rows that share a key are resampled together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.corrupt import let
from ..sources.views import balanced

#: Fixed values of the hashes, below 2**32: draw, arm and choice of seeds.
DRAW, ARM, CHOICE = 0x9E3779B1, 0x85EBCA77, 0x7F4A7C15
#: A 16-bit number has the weight of how many of these it reaches: the Poisson distribution of mean 1.
STEPS = tuple(int(np.ceil(65536 * c)) for c in np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(8)]))
#: Vectors that one task adds up, rows of a cell beyond which a task makes a vector, and rows that a task holds.
FAN_IN, FEW, HELD = 16, 4096, 1 << 19
#: Different values of a cell's rows up to which the weights of the rows of each are counted.
KINDS = 8
_WEIGHT = np.searchsorted(STEPS, np.arange(65536), side="right").astype(np.float64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


@cache
def _choices(n_boot: int, k: int, salt: int) -> np.ndarray:
    """Which of k seeds each place of each draw takes."""
    at = np.arange(n_boot * k, dtype=np.uint32) * np.uint32(DRAW) + np.uint32((salt * ARM + CHOICE) % (1 << 32))
    return _mixed(at) % np.uint32(k)


@cache
def _places(n_boot: int, k: int, s: int, salt: int) -> np.ndarray:
    """Hashes of the places that take the seed."""
    at = np.flatnonzero(_choices(n_boot, k, salt) == s).astype(np.uint32)
    return _mixed(at * np.uint32(DRAW) + np.uint32(salt * ARM % (1 << 32)))


def _halves(one: np.ndarray, two: np.ndarray, places: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The mixed hashes of some rows at some places, but for the last step of the bijection, which leaves their upper halves alone."""
    np.multiply(two[:, None], places, out=u)
    u += one[:, None]
    for down, factor in ((np.uint32(16), 0x85EBCA6B), (np.uint32(13), 0xC2B2AE35)):
        np.right_shift(u, down, out=v)
        u ^= v
        u *= np.uint32(factor)
    return u


def _counts(one: np.ndarray, two: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums of weights for every place, in whole numbers of a byte for some rows at a time."""
    steps, out = [np.uint16(s) for s in STEPS if s < 1 << 16], np.zeros(len(places), np.uint32)
    wide = min(len(places), 1 << 14)
    tall = max(8, min(32, (1 << 16) // max(1, wide)))  # weights are 7 at most, so a byte holds the sum of 32 rows
    x, y, halves, reached, weights = (np.empty((tall, wide), kind) for kind in (np.uint32, np.uint32, np.uint16, bool, np.uint8))
    for left in range(0, len(places), wide):
        own = places[left : left + wide]
        for at in range(0, len(one), tall):
            n = len(one[at : at + tall])
            u, v, h, r, w = (t[:n, : len(own)] for t in (x, y, halves, reached, weights))
            np.right_shift(_halves(one[at : at + n], two[at : at + n], own, u, v), np.uint32(16), out=h, casting="unsafe")
            np.greater_equal(h, steps[0], out=w.view(bool))
            for step in steps[1:]:
                np.greater_equal(h, step, out=r)
                w += r.view(np.uint8)
            out[left : left + wide] += w.sum(axis=0, dtype=np.uint8)
    return out


def _sums(one: np.ndarray, two: np.ndarray, values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums of weights, and of each weighted value (rows of ``values``), for every place.

    Where rows have few different values (hits), the weights of the rows of each are counted: cheaper, and exact in any order.
    """
    out = np.zeros((1 + len(values), len(places)))
    if len(one) and np.isfinite(values).all():
        kinds, which = np.unique(values, axis=1, return_inverse=True)
        if kinds.shape[1] <= KINDS:
            for i in range(kinds.shape[1]):
                own = which.ravel() == i
                out += np.concatenate([[1.0], kinds[:, i]])[:, None] * _counts(one[own], two[own], places)
            return out
    factors = np.vstack([np.ones(len(one)), values])
    tall, wide = 16, 2048  # a tile stays in the cache
    for left in range(0, len(places), wide):
        own = places[left : left + wide]
        x, y, weights = np.empty((tall, len(own)), np.uint32), np.empty((tall, len(own)), np.uint32), np.empty((tall, len(own)))
        for at in range(0, len(one), tall):
            n = len(one[at : at + tall])
            u, w = _halves(one[at : at + n], two[at : at + n], own, x[:n], y[:n]), weights[:n]
            u >>= np.uint32(16)
            np.take(_WEIGHT, u, out=w, mode="clip")
            out[:, left : left + wide] += factors[:, at : at + n] @ w
    return out


class _Cell:
    """The rows of one cell and seed that a task has met: a vector, and rows that are not in it yet."""

    def __init__(self, named: pa.RecordBatch, places: np.ndarray, m: int) -> None:
        self.named, self.places, self.m = named, places, m
        self.rows, self.n, self.vector, self.total = [], 0, None, np.zeros(1 + m)

    def add(self, one: np.ndarray, two: np.ndarray, values: np.ndarray) -> None:
        self.rows.append((one, two, values))
        self.n += len(one)
        self.total += np.concatenate([[len(one)], values.sum(axis=1)])
        if self.n > FEW:
            self.fold()

    def fold(self) -> None:
        if self.n or self.vector is None:
            one, two, values = (np.concatenate([r[i] for r in self.rows], axis=-1) for i in range(3)) if self.rows else (np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty((self.m, 0)))
            got = _sums(one, two, values, self.places)
            self.vector = got if self.vector is None else self.vector + got
            self.rows, self.n = [], 0

    def record(self, part: int) -> pa.RecordBatch:
        if self.vector is not None:
            self.fold()
        raw = b"" if not self.rows else b"".join(np.concatenate([r[i] for r in self.rows], axis=-1).tobytes() for i in range(3))
        vector = b"" if self.vector is None else self.vector.tobytes()
        extra = [pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in (self.total.tobytes(), raw, vector))]
        return pa.RecordBatch.from_arrays([*self.named.columns, *extra], [*self.named.schema.names, "_part", "_total", "_raw", "_vector"])


def _unpack(raw: bytes, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) // (8 + 8 * m)
    return np.frombuffer(raw, np.uint32, n), np.frombuffer(raw, np.uint32, n, 4 * n), np.frombuffer(raw, np.float64, n * m, 8 * n).reshape(m, n)


def _with_seeds(rows: DataFrame, group: list[str]) -> DataFrame:
    """``_s`` and ``_k``: the number of a row's seed among those of its group, and how many these are."""
    seeds = rows.groupBy(*group).agg(F.array_sort(F.collect_set("_seed")).alias("_seeds"))
    if not group:
        both = rows.crossJoin(F.broadcast(seeds))  # one row
    else:
        few = seeds.select(*[F.col(g).alias(f"_of_{g}") for g in group], "_seeds")
        same = [rows[g].eqNullSafe(few[f"_of_{g}"]) for g in group]
        both = rows.join(few, same).drop(*[f"_of_{g}" for g in group])
    return both.withColumns({"_s": F.array_position("_seeds", F.col("_seed")).cast("int") - 1, "_k": F.size("_seeds")}).drop("_seeds", "_seed")


def replicates(rows: DataFrame, group: list[str], values: list[str], key: list[str], seed: str | None = None, n_boot: int = 1000, salt: Column | None = None, partitions: int | None = None) -> DataFrame:
    """``n``, ``<value>`` (the mean of all rows) and ``<value>_draws`` (``n_boot`` resampled means) of each group, for all values with the same draws.

    ``key`` identifies a row; ``seed`` is the upper level, if any; ``salt`` (a small whole number, one
    for each group) tells arms apart that are to be resampled by themselves although they share keys.
    Rows with a null among their values, or a null seed, do not count.  ``partitions`` (the
    session's by default): into how many the rows are dealt.
    """
    m = len(values)
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key]))
    word = lambda k: F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")
    for v in [*values, *([seed] if seed else [])]:
        rows = rows.where(F.col(v).isNotNull())
    numbers = [F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)]
    rows = rows.select(*group, *([F.col(seed).alias("_seed")] if seed else []), (F.lit(0) if salt is None else salt).cast("int").alias("_salt"), word(0).alias("_one"), word(1).alias("_two"), *numbers)
    rows = _with_seeds(rows, group) if seed else rows.withColumns({"_s": F.lit(0), "_k": F.lit(1)})
    cell = [*group, "_salt", "_s", "_k"]
    few = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = partitions or few
    # a row costs a tenth of a millisecond, so slim rows are dealt out evenly
    rows = rows.select(*cell, "_one", "_two", *[f"_v{i}" for i in range(m)]).repartition(partitions, "_one", "_two")
    rows = rows.sortWithinPartitions(*cell, "_one", "_two", *[f"_v{i}" for i in range(m)])  # sums of doubles have their terms in one order
    kinds = dict(rows.dtypes)
    named = ", ".join(f"`{c}` {kinds[c]}" for c in cell)
    wide = f"{named}, _part int, _total binary, _raw binary, _vector binary"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, _Cell] = {}
        part, held = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.select(cell).to_pandas()
            one, two = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.uint32) for c in ("_one", "_two"))
            numbers = np.array([batch.column(f"_v{i}").to_numpy(zero_copy_only=False) for i in range(m)])
            for name, own in keys.groupby(cell, dropna=False, sort=False).indices.items():
                if name not in cells:
                    k = keys.iloc[own[0]]
                    cells[name] = _Cell(batch.select(cell).slice(int(own[0]), 1), _places(n_boot, int(k["_k"]), int(k["_s"]), int(k["_salt"])), m)
                cells[name].add(one[own], two[own] | np.uint32(1), numbers[:, own])
            held += batch.num_rows
            if held > HELD:
                yield from (c.record(part) for c in cells.values())
                cells, held = {}, 0
        yield from (c.record(part) for c in cells.values())

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("_part")
        first = table.slice(0, 1).combine_chunks().to_batches()[0]
        of = first.to_pylist()[0]
        found = _Cell(first.select(cell), _places(n_boot, of["_k"], of["_s"], of["_salt"]), m)
        vector, total = np.zeros((1 + m, len(found.places))), np.zeros(1 + m)
        for raw, made, sums in zip(table["_raw"], table["_vector"], table["_total"], strict=True):
            total += np.frombuffer(sums.as_py())
            if raw.as_py():
                found.add(*_unpack(raw.as_py(), m))
            if made.as_py():
                vector += np.frombuffer(made.as_py()).reshape(vector.shape)
        found.fold()
        found.vector, found.total = found.vector + vector, total
        return pa.Table.from_batches([found.record(of["_up"])])

    def finish(table: pa.Table) -> pa.Table:
        rows = table.sort_by("_s").to_pylist()
        k, salt, total = rows[0]["_k"], rows[0]["_salt"], np.zeros(1 + m)
        means = np.full((m, n_boot * k), np.nan)
        for row in rows:
            own, sums = np.frombuffer(row["_total"]), np.frombuffer(row["_vector"]).reshape(1 + m, -1)
            total += own
            plain = (own[1:] / own[0])[:, None]
            means[:, _choices(n_boot, k, salt) == row["_s"]] = np.where(sums[0] > 0, sums[1:] / np.maximum(sums[0], 1), plain)
        draws = means.reshape(m, n_boot, k).mean(axis=2)
        out = [pa.array([int(total[0])], pa.int64())]
        for i in range(m):
            out += [pa.array([total[1 + i] / total[0]]), pa.array([draws[i]], pa.list_(pa.float64()))]
        head = table.slice(0, 1).select(group) if group else None
        return pa.table([*(head.columns if group else []), *out], names=[*group, "n", *[x for v in values for x in (v, f"{v}_draws")]])

    found = rows.mapInArrow(partial, wide)
    for _ in range(max(1, int(np.ceil(np.log(partitions) / np.log(FAN_IN))))):
        dealt = found.withColumn("_up", F.floor(F.col("_part") / FAN_IN).cast("int"))
        found = dealt.repartition(few, *cell, "_up").groupBy(*cell, "_up").applyInArrow(merge, wide)
    done = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "n long", *[f"`{v}` double, `{v}_draws` array<double>" for v in values]])
    return found.groupBy(*group).applyInArrow(finish, done)


def quantile_of(draws: Column, share: float) -> Column:
    """Linearly interpolated quantile of an array."""

    def at(x: Column) -> Column:
        place = F.lit(share) * (F.size(x) - 1)
        low, high = F.get(x, F.floor(place).cast("int")), F.get(x, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    return let(F.array_sort(draws), at)


def bounds(draws: Column, ci: float = 0.95) -> list[Column]:
    """``lo`` and ``hi`` of a vector of draws."""
    return [quantile_of(draws, (1 - ci) / 2).alias("lo"), quantile_of(draws, (1 + ci) / 2).alias("hi")]


def difference(one: Column, two: Column) -> Column:
    """Draw by draw."""
    return F.zip_with(one, two, lambda a, b: a - b)


def _identified(values: DataFrame, key: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """Rows and their key; rows without one of its columns are told apart by their place in the table instead."""
    if all(c in values.columns for c in key):
        return values, list(key)
    return values.withColumn("_place", F.monotonically_increasing_id()), [*[c for c in key if c in values.columns], "_place"]


def percentile_interval(draws: DataFrame, group: list[str], ci: float = 0.95) -> DataFrame:
    """``lo, hi`` of each group of draws given as rows (``mean``)."""
    edges = F.percentile("mean", F.array(F.lit((1 - ci) / 2), F.lit((1 + ci) / 2)))
    return draws.groupBy(*group).agg(edges.alias("e")).select(*group, F.get("e", F.lit(0)).alias("lo"), F.get("e", F.lit(1)).alias("hi"))


def hierarchical_draws(values: DataFrame, group: list[str], n_boot: int) -> DataFrame:
    """``boot, mean`` of each group (``values`` has ``seed, pair_id, value``)."""
    values, names = _identified(values, ("seed", "pair_id"))
    rows = replicates(values, group, ["value"], names, "seed", n_boot)
    return rows.select(*group, F.posexplode("value_draws").alias("boot", "mean"))


def hierarchical_interval(values: DataFrame, group: list[str], n_boot: int = 10_000, ci: float = 0.95, key: tuple[str, ...] = ("seed", "pair_id"), partitions: int | None = None) -> DataFrame:
    """``point, lo, hi`` of each group; the point weights observations, the draws weight seeds."""
    values, names = _identified(values, key)
    rows = replicates(values, group, ["value"], names, "seed", n_boot, partitions=partitions)
    return rows.select(*group, F.col("value").alias("point"), *bounds(F.col("value_draws"), ci))


def unpaired_difference(values: DataFrame, group: list[str], n_boot: int = 10_000, ci: float = 0.95, key: tuple[str, ...] = ("seed", "pair_id")) -> DataFrame:
    """``point, lo, hi`` of the difference of two independent arms (``arm`` true minus false), each resampled by itself.

    Arms may have different seeds, pairs and sizes.  A group without one of them has nulls.
    """
    values, names = _identified(values, key)
    rows = replicates(values.where("arm is not null"), [*group, "arm"], ["value"], names, "seed", n_boot, F.when(F.col("arm"), 1).otherwise(2))
    side = lambda c, which: F.first(F.when(F.col("arm") == which, F.col(c)), ignorenulls=True)
    wide = rows.groupBy(*group).agg(*[side(c, w).alias(f"{n}_{c}") for w, n in ((True, "a"), (False, "b")) for c in ("value", "value_draws")])
    return wide.select(*group, (F.col("a_value") - F.col("b_value")).alias("point"), *bounds(difference(F.col("a_value_draws"), F.col("b_value_draws")), ci))


def paired_difference(a: DataFrame, b: DataFrame, group: list[str], n_boot: int = 10_000, ci: float = 0.95) -> DataFrame:
    """``diff, lo, hi`` of two arms that share seeds and pairs: each draw takes the same ones on both sides.

    Arms are ``group``, ``seed, pair_id, value``; raises if their keys differ.
    """
    both = balanced(a, b, [*group, "seed", "pair_id"]).withColumn("value", F.col("value_a") - F.col("value_b"))
    return hierarchical_interval(both, group, n_boot, ci).withColumnRenamed("point", "diff")


def flat_interval(rows: DataFrame, group: list[str], key: list[str], n_boot: int = 1000, ci: float = 0.95) -> DataFrame:
    """``n, mean, lo, hi`` of each group, rows resampled at one level; a group of one row has no interval."""
    found = replicates(rows, group, ["value"], key, None, n_boot)
    lo, hi = bounds(F.col("value_draws"), ci)
    return found.select(*group, "n", F.col("value").alias("mean"), F.when(F.col("n") > 1, lo).alias("lo"), F.when(F.col("n") > 1, hi).alias("hi"))


def matched_arms(rows: DataFrame, group: list[str], arm: str, one: object, two: object, key: list[str], n_boot: int = 1000, ci: float = 0.95) -> DataFrame:
    """Both arms of each group with their intervals, and their difference.

    ``one_n, one_mean, one_lo, one_hi``, the same of ``two``, ``diff, lo, hi``, and ``significant``
    (``lo > 0``).  Rows are resampled at one level, each arm by itself; arms of fewer than two rows
    have no interval; groups need both arms.
    """
    cells = replicates(rows.where(F.col(arm).isin(one, two)), [*group, arm], ["value"], key, None, n_boot, F.when(F.col(arm) == one, 1).otherwise(2))
    side = lambda c, which: F.first(F.when(F.col(arm) == which, F.col(c)), ignorenulls=True)
    wide = cells.groupBy(*group).agg(*[side(c, w).alias(f"{n}_{c}") for w, n in ((one, "one"), (two, "two")) for c in ("n", "value", "value_draws")]).where("one_n is not null and two_n is not null")
    out = []
    for n in ("one", "two"):
        lo, hi = bounds(F.col(f"{n}_value_draws"), ci)
        out += [F.col(f"{n}_n"), F.col(f"{n}_value").alias(f"{n}_mean"), F.when(F.col(f"{n}_n") > 1, lo).alias(f"{n}_lo"), F.when(F.col(f"{n}_n") > 1, hi).alias(f"{n}_hi")]
    lo, hi = bounds(difference(F.col("one_value_draws"), F.col("two_value_draws")), ci)
    enough = (F.col("one_n") > 1) & (F.col("two_n") > 1)
    made = wide.select(*group, *out, (F.col("one_value") - F.col("two_value")).alias("diff"), F.when(enough, lo).alias("lo"), F.when(enough, hi).alias("hi"))
    return made.withColumn("significant", F.coalesce(F.col("lo") > 0, F.lit(False)))


def draws_sql(source: str, group: list[str], key: list[str], n_boot: int, seed: str | None = None, salt: str = "0", value: str = "value", name: str = "draws") -> str:
    """DuckDB SQL of ``replicates``: common tables that end in ``name`` (group, ``boot, mean``) and ``name_points`` (group, ``n, point``)."""
    by = "".join(f"{g}, " for g in group)
    same = lambda a, b: " AND ".join([f"{a}.{g} IS NOT DISTINCT FROM {b}.{g}" for g in group] or ["true"])
    mixed = lambda inner: (
        "(SELECT * REPLACE (xor(x, x >> 16) AS x) FROM (SELECT * REPLACE (xor(x, x >> 13) * 3266489909 % 4294967296 AS x) FROM "
        f"(SELECT * REPLACE (xor(x, x >> 16) * 2246822507 % 4294967296 AS x) FROM {inner})))"
    )
    word = lambda k: f"('0x' || substr(md5(concat_ws('|', {', '.join(key)})), {1 + 8 * k}, 8))::UBIGINT"
    weight = " + ".join(f"(x >> 16 >= {s})::INT" for s in STEPS)
    seed_of = seed or "0"
    return f"""{name}_rows AS (SELECT {by}{seed_of} AS sd, ({salt})::UBIGINT AS salt, {value}::DOUBLE AS v, {word(0)} AS one, {word(1)} | 1::UBIGINT AS two FROM {source} WHERE {value} IS NOT NULL AND {seed_of} IS NOT NULL),
{name}_seeds AS (SELECT {by}sd, any_value(salt) AS salt, count(*) AS sn, sum(v) AS sv, row_number() OVER ({'PARTITION BY ' + ', '.join(group) if group else ''} ORDER BY sd) - 1 AS s, count(*) OVER ({'PARTITION BY ' + ', '.join(group) if group else ''}) AS k FROM {name}_rows GROUP BY {by}sd),
{name}_kinds AS (SELECT DISTINCT k, salt FROM {name}_seeds),
{name}_all AS (SELECT k, salt, unnest(range((k * {n_boot})::BIGINT))::UBIGINT AS e FROM {name}_kinds),
{name}_hashed AS (SELECT * FROM {mixed(f"(SELECT k, salt, e, (e * {DRAW} + salt * {ARM}) % 4294967296 AS x FROM {name}_all)")}),
{name}_chosen AS (SELECT k, salt, e, (x % k::UBIGINT)::BIGINT AS s FROM {mixed(f"(SELECT k, salt, e, (e * {DRAW} + salt * {ARM} + {CHOICE}) % 4294967296 AS x FROM {name}_all)")}),
{name}_taken AS (SELECT g.*, c.e AS e, h.x AS h FROM {name}_seeds g JOIN {name}_chosen c ON g.k = c.k AND g.salt = c.salt AND g.s = c.s JOIN {name}_hashed h ON h.k = c.k AND h.salt = c.salt AND h.e = c.e),
{name}_sums AS (SELECT {by}sd, e, sum(w) AS w, sum(w * v) AS wv FROM (SELECT {by}sd, e, v, {weight} AS w FROM {mixed(f"(SELECT {''.join(f't.{g}, ' for g in group)}t.sd, t.e, r.v, (r.one + r.two * t.h) % 4294967296 AS x FROM {name}_taken t JOIN {name}_rows r ON {same('t', 'r')} AND t.sd = r.sd)")}) GROUP BY {by}sd, e),
{name}_means AS (SELECT {''.join(f's.{g}, ' for g in group)}s.e // g.k AS boot, CASE WHEN s.w > 0 THEN s.wv / s.w ELSE g.sv / g.sn END AS m FROM {name}_sums s JOIN {name}_seeds g ON {same('s', 'g')} AND s.sd = g.sd),
{name} AS (SELECT {by}boot::BIGINT AS boot, avg(m) AS mean FROM {name}_means GROUP BY {by}boot),
{name}_points AS (SELECT {by}count(*) AS n, avg(v) AS point FROM {name}_rows {'GROUP BY ' + ', '.join(group) if group else ''})"""

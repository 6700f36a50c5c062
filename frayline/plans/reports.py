"""Queries of the experiments and their reports, with the same rows in DuckDB SQL.

Stand-ins: a line item is one measured hit of a (model, seed, pair) under one corruption of
one side (its line number, modulo 6, is the severity); ``lineitem`` grouped by that key without
the model is the damage table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IMAGE, TEXT
from ..functions import vectors
from ..operators import binning, bootstrap, statistics
from ..sources import manifest, views
from .queries import _ARMS, _MEASURED, _binned, arms, measured, query, r6, read

_KINDS = "[" + ", ".join(f"'{k}'" for k in (*IMAGE, *TEXT)) + "]"
_ROWS = f"""hits AS (SELECT l_returnflag AS model, CAST(l_suppkey % 3 AS INT) AS seed, l_partkey AS pair_id, ({_KINDS})[1 + l_orderkey % 6] AS corruption,
  CASE WHEN l_orderkey % 6 < 3 THEN 'i2t' ELSE 't2i' END AS direction, CAST((l_linenumber - 1) % 6 AS INT) AS severity, CASE WHEN l_quantity * (l_linenumber + 2) < 120 THEN 1::DOUBLE ELSE 0::DOUBLE END AS hit, l_orderkey AS item, l_linenumber AS line FROM lineitem),
dmg AS (SELECT CAST(l_suppkey % 3 AS INT) AS seed, l_partkey AS pair_id, ({_KINDS})[1 + l_orderkey % 6] AS corruption, CAST((l_linenumber - 1) % 6 AS INT) AS severity, max(round(l_discount * 100) + l_linenumber) AS damage FROM lineitem GROUP BY ALL),
joined AS (SELECT * FROM hits JOIN dmg USING (seed, pair_id, corruption, severity) WHERE severity > 0)"""


def _rows(spark, sf) -> DataFrame:
    kind = F.get(F.array(*[F.lit(k) for k in (*IMAGE, *TEXT)]), (F.col("l_orderkey") % 6).cast("int"))
    return read(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("model"), (F.col("l_suppkey") % 3).cast("int").alias("seed"), F.col("l_partkey").alias("pair_id"), kind.alias("corruption"),
        F.when(F.col("l_orderkey") % 6 < 3, "i2t").otherwise("t2i").alias("direction"), ((F.col("l_linenumber") - 1) % 6).cast("int").alias("severity"),
        F.when(F.col("l_quantity") * (F.col("l_linenumber") + 2) < 120, 1.0).otherwise(0.0).alias("hit"), (F.round(F.col("l_discount") * 100) + F.col("l_linenumber")).alias("d"),
        F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("line"),
    )


def hits(spark, sf) -> DataFrame:
    return _rows(spark, sf).drop("d")


def _parts(spark, sf) -> int:
    """Partitions of the line items: their number grows with the table, not what a task holds."""
    return views.parts_of(read(spark, sf, "lineitem").count(), spark)


def joined(spark, sf) -> DataFrame:
    """Hits with their damage; both sides are dealt by the full key into the same partitions, once."""
    rows = _rows(spark, sf).where("severity > 0").repartition(_parts(spark, sf), *views.KEY)
    return views.with_damage(rows.drop("d"), rows.groupBy(*views.KEY).agg(F.max("d").alias("damage")))


@query(f"WITH {_ROWS} SELECT model, direction, corruption, severity, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(damage), 6) AS damage FROM joined GROUP BY ALL")
def full_key_damage_join(spark, sf):
    """Scores with the damage of seed, pair, corruption type and severity, by condition."""
    return joined(spark, sf).groupBy("model", "direction", "corruption", "severity").agg(F.count("*").alias("n"), r6(F.avg("hit"), "hit"), r6(F.avg("damage"), "damage"))


@query(f"WITH {_ROWS}, g AS (SELECT *, model || corruption AS mc FROM joined), {_binned('g', 'damage', 'b', 'mc')} SELECT model, corruption, quintile, count(*) AS n, round(avg(hit), 6) AS hit FROM b GROUP BY ALL HAVING count(*) >= 10")
def per_corruption_quintiles(spark, sf):
    """Quintiles within model and corruption; cells of fewer than ten rows are left out."""
    rows = binning.assign_quintile(joined(spark, sf), ["model", "corruption"], "damage")
    return rows.groupBy("model", "corruption", "quintile").agg(F.count("*").alias("n"), r6(F.avg("hit"), "hit")).where("n >= 10")


_CLEAN = "clean AS (SELECT model, direction, avg(hit) AS clean, count(*) AS clean_n FROM hits WHERE severity = 0 GROUP BY ALL)"


def clean_means(spark, sf) -> DataFrame:
    return views.clean_baseline(hits(spark, sf).withColumnRenamed("hit", "value"), ["model", "direction"])


@query(f"WITH {_ROWS}, {_CLEAN} SELECT model, direction, severity, round(avg(hit), 6) AS hit, round(any_value(clean), 6) AS clean, round(any_value(clean) - avg(hit), 6) AS fall FROM hits JOIN clean USING (model, direction) WHERE severity > 0 GROUP BY ALL")
def baseline_lookup(spark, sf):
    """Each model's clean baseline looked up for its conditions; a model without one is an error."""
    cells = hits(spark, sf).where("severity > 0").groupBy("model", "direction", "severity").agg(F.avg("hit").alias("hit"))
    both = views.looked_up(cells, clean_means(spark, sf), ["model", "direction"], "clean")
    return both.select("model", "direction", "severity", r6("hit", "hit"), r6("clean", "clean"), r6(F.col("clean") - F.col("hit"), "fall"))


_GLOBAL = f"{_ROWS}, {_CLEAN}, {_binned('joined', 'damage', 'b', 'direction')}"


@query(f"WITH {_GLOBAL}, q AS (SELECT model, direction, avg(hit) FILTER (WHERE quintile = 1) AS q1, avg(hit) FILTER (WHERE quintile = 5) AS q5 FROM b GROUP BY ALL), f AS (SELECT model, direction, q1, q5, clean - q5 AS fall FROM q JOIN clean USING (model, direction)) "
       "SELECT i.model AS model, round(i.q1, 6) AS i2t_q1, round(i.q5, 6) AS i2t_q5, round(t.q1, 6) AS t2i_q1, round(t.q5, 6) AS t2i_q5, round(i.fall, 6) AS i2t_fall, round(t.fall, 6) AS t2i_fall, round(t.fall - i.fall, 6) AS gap FROM f i JOIN f t ON i.model = t.model AND i.direction = 'i2t' AND t.direction = 't2i'")  # fmt: skip
def headline_falls(spark, sf):
    """Clean recall minus that of the worst quintile (edges over all models) on both sides, and the gap."""
    rows = binning.assign_quintile(joined(spark, sf), ["direction"], "damage")
    at = lambda q: F.avg(F.when(F.col("quintile") == q, F.col("hit")))
    cells = views.looked_up(rows.groupBy("model", "direction").agg(at(1).alias("q1"), at(5).alias("q5")), clean_means(spark, sf), ["model", "direction"], "clean")
    cells = cells.withColumn("fall", F.col("clean") - F.col("q5"))
    of = lambda d, c: F.max(F.when(F.col("direction") == d, F.col(c)))
    wide = cells.groupBy("model").agg(*[of(d, c).alias(f"{d}_{c}") for d in ("i2t", "t2i") for c in ("q1", "q5", "fall")])
    return wide.select("model", *[r6(f"{d}_{c}", f"{d}_{c}") for d in ("i2t", "t2i") for c in ("q1", "q5", "fall")], r6(F.col("t2i_fall") - F.col("i2t_fall"), "gap"))


@query(f"WITH {_ROWS}, {_CLEAN} SELECT h.model AS model, h.corruption AS corruption, round(avg(hit), 6) AS hit, count(*) AS n, round(any_value(clean), 6) AS other_clean FROM hits h JOIN clean c ON h.model = c.model AND h.direction <> c.direction WHERE severity = 5 GROUP BY ALL")
def corruption_breakdown(spark, sf):
    """Each corruption at severity 5, against the clean value of the opposite direction."""
    cells = hits(spark, sf).where("severity = 5").groupBy("model", "direction", "corruption").agg(F.avg("hit").alias("hit"), F.count("*").alias("n"))
    other = clean_means(spark, sf).select("model", F.when(F.col("direction") == "i2t", "t2i").otherwise("i2t").alias("direction"), "clean")
    return views.looked_up(cells, other, ["model", "direction"], "clean").select("model", "corruption", r6("hit", "hit"), "n", r6("clean", "other_clean"))


@query(f"WITH {_ROWS} SELECT model, corruption, round(avg(hit) FILTER (WHERE severity = 1), 6) AS s1, round(avg(hit) FILTER (WHERE severity = 5), 6) AS s5, round(avg(hit) FILTER (WHERE severity = 1) - avg(hit) FILTER (WHERE severity = 5), 6) AS fall FROM hits GROUP BY ALL")
def per_corruption_table(spark, sf):
    at = lambda s: F.avg(F.when(F.col("severity") == s, F.col("hit")))
    rows = hits(spark, sf).groupBy("model", "corruption").agg(at(1).alias("s1"), at(5).alias("s5"))
    return rows.select("model", "corruption", r6("s1", "s1"), r6("s5", "s5"), r6(F.col("s1") - F.col("s5"), "fall"))


@query(f"WITH {_ROWS}, p AS (SELECT model, avg(hit) FILTER (WHERE corruption = 'shuffle') AS shuffle, avg(hit) FILTER (WHERE corruption = 'mask') AS mask FROM hits WHERE severity = 5 GROUP BY ALL) SELECT model, round(shuffle, 6) AS shuffle, round(mask, 6) AS mask, round(CASE WHEN mask > 0 THEN shuffle / mask END, 6) AS ratio FROM p")
def shuffle_mask_ratio(spark, sf):
    at = lambda k: F.avg(F.when(F.col("corruption") == k, F.col("hit")))
    rows = hits(spark, sf).where("severity = 5").groupBy("model").agg(at("shuffle").alias("shuffle"), at("mask").alias("mask"))
    return rows.select("model", r6("shuffle", "shuffle"), r6("mask", "mask"), r6(F.try_divide("shuffle", "mask"), "ratio"))


@query(f"WITH {_ROWS}, {_binned('joined', 'damage', 'b', 'direction')}, q AS (SELECT model, direction, {', '.join(f'avg(hit) FILTER (WHERE quintile = {k}) AS q{k}' for k in (1, 4, 5))} FROM b GROUP BY ALL) "
       "SELECT model, direction, round(q1 - q5, 6) AS gap, round(CASE WHEN q5 > 0 THEN q1 / q5 END, 6) AS ratio, round(q5 - q4, 6) AS bump FROM q")  # fmt: skip
def quintile_gaps(spark, sf):
    """First against last quintile, and the step from the fourth to the fifth."""
    rows = binning.assign_quintile(joined(spark, sf), ["direction"], "damage")
    at = lambda q: F.avg(F.when(F.col("quintile") == q, F.col("hit"))).alias(f"q{q}")
    rows = rows.groupBy("model", "direction").agg(at(1), at(4), at(5))
    return rows.select("model", "direction", r6(F.col("q1") - F.col("q5"), "gap"), r6(F.try_divide("q1", "q5"), "ratio"), r6(F.col("q5") - F.col("q4"), "bump"))


@query(f"WITH {_ROWS}, {_binned('joined', 'damage', 'b', 'direction')}, m AS (SELECT model, direction, quintile, seed, avg(hit) AS v, count(*) AS n FROM b GROUP BY ALL) SELECT model, direction, quintile, sum(n)::BIGINT AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, round(min(v), 6) AS low, round(max(v), 6) AS high FROM m GROUP BY ALL")
def quintile_summary(spark, sf):
    """Both directions by quintile: mean and spread of the seeds' means."""
    seeds = binning.assign_quintile(joined(spark, sf), ["direction"], "damage").groupBy("model", "direction", "quintile", "seed").agg(F.avg("hit").alias("v"), F.count("*").alias("n"))
    return seeds.groupBy("model", "direction", "quintile").agg(F.sum("n").alias("n"), r6(F.avg("v"), "mean"), r6(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), "sd"), r6(F.min("v"), "low"), r6(F.max("v"), "high"))


@query(f"WITH {_ROWS}, a AS (SELECT model, severity, avg(hit) AS v FROM hits WHERE seed < 2 GROUP BY ALL), b AS (SELECT model, severity, avg(hit) AS v FROM hits GROUP BY ALL) SELECT model, {', '.join(f'round(max(b.v - a.v) FILTER (WHERE severity = {s}), 6) AS s{s}' for s in range(6))} FROM a JOIN b USING (model, severity) GROUP BY 1")
def aggregate_check(spark, sf):
    """An older aggregate (two seeds) against the newer one, by model and severity."""
    old = hits(spark, sf).where("seed < 2").groupBy("model", "severity").agg(F.avg("hit").alias("old"))
    new = hits(spark, sf).groupBy("model", "severity").agg(F.avg("hit").alias("new"))
    rows = views.pivot_once(old.join(new, ["model", "severity"]).withColumn("change", F.col("new") - F.col("old")), "model", "severity", list(range(6)), "change")
    return rows.select("model", *[r6(F.col(f"`{s}`"), f"s{s}") for s in range(6)])


@query(f"WITH {_ROWS}, l AS (SELECT model, corruption, avg(hit) AS v FROM hits WHERE severity IN (1, 5) AND seed = 2 GROUP BY ALL) SELECT model, {', '.join(f'round(max(v) FILTER (WHERE corruption = {chr(39)}{k}{chr(39)}), 6) AS {k}' for k in (*IMAGE, *TEXT))} FROM l GROUP BY 1")
def late_fidelity_pivot(spark, sf):
    """The last depth (here the last seed) by corruption, a row a model."""
    cells = hits(spark, sf).where("severity in (1, 5) and seed = 2").groupBy("model", "corruption").agg(F.avg("hit").alias("v"))
    return views.pivot_once(cells, "model", "corruption", [*IMAGE, *TEXT], "v").select("model", *[r6(k, k) for k in (*IMAGE, *TEXT)])


@query(f"WITH {_ROWS}, c AS (SELECT model, pair_id, seed, avg(hit) AS v FROM hits GROUP BY ALL), j AS (SELECT a.model AS model, a.seed AS seed_a, b.seed AS seed_b, a.v AS x, b.v AS y FROM c a JOIN c b ON a.model = b.model AND a.pair_id = b.pair_id AND a.seed < b.seed), "
       "k AS (SELECT *, rank() OVER (PARTITION BY model, seed_a, seed_b ORDER BY x) + (count(*) OVER (PARTITION BY model, seed_a, seed_b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY model, seed_a, seed_b ORDER BY y) + (count(*) OVER (PARTITION BY model, seed_a, seed_b, y) - 1) / 2.0::DOUBLE AS ry FROM j) "
       "SELECT model, seed_a, seed_b, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY ALL")  # fmt: skip
def per_cell_spearman(spark, sf):
    """Rank correlation of the pairs of every two seeds, by model; repeated pairs count as their mean."""
    return statistics.per_cell_spearman(hits(spark, sf).withColumnRenamed("hit", "value"), ["model"]).select("model", "seed_a", "seed_b", "n", r6("rho", "rho"))


@query(f"WITH {_ROWS}, c AS (SELECT model, corruption, severity, seed, avg(hit) AS v FROM hits GROUP BY ALL), j AS (SELECT a.model AS model, a.seed AS seed_a, b.seed AS seed_b, a.v AS x, b.v AS y FROM c a JOIN c b ON a.model = b.model AND a.corruption = b.corruption AND a.severity = b.severity AND a.seed < b.seed), "
       "k AS (SELECT *, rank() OVER (PARTITION BY model, seed_a, seed_b ORDER BY x) + (count(*) OVER (PARTITION BY model, seed_a, seed_b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY model, seed_a, seed_b ORDER BY y) + (count(*) OVER (PARTITION BY model, seed_a, seed_b, y) - 1) / 2.0::DOUBLE AS ry FROM j), r AS (SELECT model, corr(rx, ry) AS rho FROM k GROUP BY model, seed_a, seed_b) "
       "SELECT model, round(min(rho), 6) AS low, round(quantile_cont(rho, 0.5), 6) AS median, round(avg(rho), 6) AS mean FROM r GROUP BY 1")  # fmt: skip
def reliability_by_model(spark, sf):
    """Least, median and mean rank correlation of the seeds' cell means, a row a model."""
    cells = hits(spark, sf).groupBy("model", "corruption", "severity", "seed").agg(F.avg("hit").alias("value"))
    rho = statistics.seed_pairs_spearman(cells, ["model"], ["corruption", "severity"])
    return rho.groupBy("model").agg(r6(F.min("rho"), "low"), r6(F.percentile("rho", F.lit(0.5)), "median"), r6(F.avg("rho"), "mean"))


_LO_HI = lambda draws: f"quantile_cont({draws}, 0.025) AS lo, quantile_cont({draws}, 0.975) AS hi"


def _matched_sql(source: str, group: list[str], arm: str, one: str, two: str, key: list[str], names: tuple[str, str], n_boot: int = 1000) -> str:
    """Rows of ``bootstrap.matched_arms`` of a common table, rounded."""
    g = ", ".join(group)
    join = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in group)
    return f"""{bootstrap.draws_sql(source, [*group, arm], key, n_boot, None, f"CASE WHEN {arm} = '{one}' THEN 1 ELSE 2 END")},
ends AS (SELECT {g}, {arm}, {_LO_HI("mean")} FROM draws GROUP BY ALL),
gaps AS (SELECT {", ".join(f"a.{c} AS {c}" for c in group)}, {_LO_HI("a.mean - b.mean")} FROM draws a JOIN draws b ON {join("a", "b")} AND a.boot = b.boot AND a.{arm} = '{one}' AND b.{arm} = '{two}' GROUP BY ALL)
SELECT {", ".join(f"a.{c} AS {c}" for c in group)}, {", ".join(f"{x}.n AS {n}_n, round({x}.point, 6) AS {n}_mean, round(CASE WHEN {x}.n > 1 THEN e{x}.lo END, 6) AS {n}_lo, round(CASE WHEN {x}.n > 1 THEN e{x}.hi END, 6) AS {n}_hi" for x, n in zip("ab", names))},
  round(a.point - b.point, 6) AS diff, round(CASE WHEN a.n > 1 AND b.n > 1 THEN gaps.lo END, 6) AS lo, round(CASE WHEN a.n > 1 AND b.n > 1 THEN gaps.hi END, 6) AS hi, coalesce(a.n > 1 AND b.n > 1 AND gaps.lo > 0, false) AS significant
FROM draws_points a JOIN draws_points b ON {join("a", "b")} AND a.{arm} = '{one}' AND b.{arm} = '{two}' JOIN gaps ON {join("a", "gaps")} JOIN ends ea ON {join("a", "ea")} AND ea.{arm} = '{one}' JOIN ends eb ON {join("a", "eb")} AND eb.{arm} = '{two}'"""


def _matched(rows: DataFrame, group: list[str], arm: str, one: str, two: str, key: list[str], names: tuple[str, str]) -> DataFrame:
    found = bootstrap.matched_arms(rows, group, arm, one, two, key)
    sides = [c for x, n in zip(("one", "two"), names, strict=True) for c in (F.col(f"{x}_n").alias(f"{n}_n"), *[r6(f"{x}_{k}", f"{n}_{k}") for k in ("mean", "lo", "hi")])]
    return found.select(*group, *sides, r6("diff", "diff"), r6("lo", "lo"), r6("hi", "hi"), "significant")


@query(f"WITH {_ROWS}, v AS (SELECT model, severity, direction, item, line, hit AS value FROM hits), {_matched_sql('v', ['model', 'severity'], 'direction', 'i2t', 't2i', ['item', 'line'], ('image', 'text'))}")
def matched_cells_flat_bootstrap(spark, sf):
    """Both arms of every (model, severity) with flat intervals of 1,000 draws, their difference, and whether it lies above zero."""
    return _matched(hits(spark, sf).withColumnRenamed("hit", "value"), ["model", "severity"], "direction", "i2t", "t2i", ["item", "line"], ("image", "text"))


_BY_ARM = f"{_ARMS}, v AS (SELECT model, quintile, 'image' AS arm, pair_id, severity, value FROM i WHERE quintile IS NOT NULL UNION ALL SELECT model, quintile, 'text', pair_id, severity, value FROM t WHERE quintile IS NOT NULL)"
_QUINTILE_TEST = _matched_sql("v", ["model", "quintile"], "arm", "image", "text", ["pair_id", "severity"], ("image", "text"))


def _quintile_test(spark, sf) -> DataFrame:
    rows = arms(spark, sf).where("quintile is not null").withColumn("arm", F.when(F.col("arm") == "damage_image", "image").otherwise("text"))
    return _matched(rows, ["model", "quintile"], "arm", "image", "text", ["pair_id", "severity"], ("image", "text"))


@query(f"WITH {_BY_ARM}, {_QUINTILE_TEST}")
def matched_quintile_interval(spark, sf):
    """Both arms in each (model, quintile) of their own damage, with intervals, and whether the image side is significantly higher."""
    return _quintile_test(spark, sf)


@query(f"SELECT model, count(*) AS quintiles, count(*) FILTER (WHERE diff > 0) AS image_higher, count(*) FILTER (WHERE significant) AS image_significant, bool_and(diff > 0) AS every_higher, bool_and(significant) AS every_significant FROM (WITH {_BY_ARM}, {_QUINTILE_TEST}) GROUP BY 1")
def matched_quintile_significance(spark, sf):
    """In how many matched quintiles of a model the image side is higher, and significantly so."""
    up = F.col("diff") > 0
    rows = _quintile_test(spark, sf).groupBy("model")
    return rows.agg(F.count("*").alias("quintiles"), F.count_if(up).alias("image_higher"), F.count_if("significant").alias("image_significant"), F.bool_and(up).alias("every_higher"), F.bool_and("significant").alias("every_significant"))


_PAIRED = "v AS (SELECT CAST(item_id % 3 AS INT) AS seed, item_id AS pair_id, length(text)::DOUBLE - (length(text)::DOUBLE / 2 + item_id % 7) AS value FROM benchmark)"


@query(f"WITH {_PAIRED}, {bootstrap.draws_sql('v', [], ['seed', 'pair_id'], 10_000, 'seed')} SELECT round((SELECT point FROM draws_points), 6) AS diff, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM draws")
def paired_bootstrap_difference(spark, sf):
    """Both arms resampled by the same seeds and pairs, 10,000 draws; arms of other keys would raise."""
    arm = lambda value: read(spark, sf, "benchmark").selectExpr("cast(item_id % 3 as int) as seed", "item_id as pair_id", f"{value} as value")
    found = bootstrap.paired_difference(arm("cast(char_length(text) as double)"), arm("char_length(text) / 2D + item_id % 7"), [])
    return found.select(r6("diff", "diff"), r6("lo", "lo"), r6("hi", "hi"))


#: Every row in every cell of the reports that it belongs to.
_CELLS = f"""{_ROWS}, {_binned("joined", "damage", "b", "direction")}, v AS (SELECT 'quintile' AS report, model, direction, 'Q' || quintile AS cell, seed, item, line, hit AS value FROM b WHERE quintile IS NOT NULL
UNION ALL SELECT 'clean', model, direction, '', seed, item, line, hit FROM hits WHERE severity = 0 UNION ALL SELECT 'corruption', model, direction, corruption || ' ' || severity, seed, item, line, hit FROM hits WHERE severity IN (1, 5))"""
_CELL = ["report", "model", "direction", "cell"]


@query(f"WITH {_CELLS}, {bootstrap.draws_sql('v', _CELL, ['item', 'line'], 10_000, 'seed')}, q AS (SELECT report, model, direction, cell, {_LO_HI('mean')} FROM draws GROUP BY ALL), m AS (SELECT report, model, direction, cell, seed, avg(value) AS s FROM v GROUP BY ALL), sd AS (SELECT report, model, direction, cell, avg(s) AS seed_mean, coalesce(stddev_samp(s), 0) AS seed_sd FROM m GROUP BY ALL) "
       "SELECT report, model, direction, cell, n, round(point, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, round(seed_mean, 6) AS seed_mean, round(seed_sd, 6) AS seed_sd FROM draws_points JOIN q USING (report, model, direction, cell) JOIN sd USING (report, model, direction, cell)")  # fmt: skip
def report_intervals(spark, sf):
    """Every cell of the reports with its hierarchical interval of 10,000 draws and the spread of its seeds, in one aggregation.

    Cells: each damage quintile (edges over all models), the clean items, each corruption at the
    least and the highest severity, all by model and direction.
    """
    rows = hits(spark, sf)
    binned = binning.assign_quintile(joined(spark, sf), ["direction"], "damage").where("quintile is not null")
    part = lambda df, report, cell: df.select(F.lit(report).alias("report"), "model", "direction", cell.alias("cell"), "seed", "item", "line", F.col("hit").alias("value"))
    cells = part(binned, "quintile", F.concat(F.lit("Q"), F.col("quintile").cast("string")))
    cells = cells.unionByName(part(rows.where("severity = 0"), "clean", F.lit("")))
    cells = cells.unionByName(part(rows.where("severity in (1, 5)"), "corruption", F.concat_ws(" ", "corruption", F.col("severity").cast("string"))))
    found = bootstrap.hierarchical_interval(cells, _CELL, key=("item", "line"), partitions=_parts(spark, sf))
    seeds = cells.groupBy(*_CELL, "seed").agg(F.avg("value").alias("s"), F.count("*").alias("k"))
    spread = seeds.groupBy(*_CELL).agg(F.sum("k").alias("n"), F.avg("s").alias("seed_mean"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("seed_sd"))
    return found.join(spread, _CELL).select(*_CELL, "n", r6("point", "mean"), r6("lo", "lo"), r6("hi", "hi"), r6("seed_mean", "seed_mean"), r6("seed_sd", "seed_sd"))


_METRICS = ("damage_image", "damage_text", "psnr")


@query(f"WITH {_MEASURED}, v AS (UNPIVOT (SELECT model, severity, pair_id, damage_image, damage_text, psnr FROM measured) ON damage_image, damage_text, psnr INTO NAME metric VALUE value), {bootstrap.draws_sql('v', ['model', 'severity', 'metric'], ['pair_id', 'severity'], 1000)} "
       f"SELECT model, severity, metric, any_value(n) AS n, round(any_value(point), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM draws JOIN draws_points USING (model, severity, metric) GROUP BY 1, 2, 3")  # fmt: skip
def cell_damage_interval(spark, sf):
    """Mean damage of every (model, severity) by each ruler with a flat interval of 1,000 draws; the rulers share the draws."""
    found = bootstrap.replicates(measured(spark, sf), ["model", "severity"], list(_METRICS), ["pair_id", "severity"])
    made = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("mean"), *bootstrap.bounds(F.col(f"{m}_draws"))) for m in _METRICS])
    return found.select("model", "severity", "n", F.explode(made).alias("x")).select("model", "severity", "n", "x.metric", r6("x.mean", "mean"), r6("x.lo", "lo"), r6("x.hi", "hi"))


_STATES = "st AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, list_transform(range(4), lambda i: CAST((vec_id * (i + 3) + label * i) % 5 AS INT)) AS t FROM embeddings)"


def states(spark, sf) -> DataFrame:
    """Four token states of sixteen numbers, and token ids with 0 as padding."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("vec_id") * (i + 3) + F.col("label") * i) % 5).cast("int"))
    return read(spark, sf, "embeddings").select("vec_id", parts.alias("states"), tokens.alias("tokens"))


_PLACE = {
    "argmax": "list_position(t, list_max(t))",
    "first": "1",
    "last": "greatest(1, coalesce(list_max(list_transform(range(1, 5), lambda i: CASE WHEN t[i] <> 0 THEN i ELSE 0 END)), 0))",
}
_POOLED = " UNION ALL ".join(f"SELECT vec_id, '{k}' AS pool, list_sum(e[16 * (p - 1) + 1 : 16 * p]) AS s, e[16 * p] AS final FROM (SELECT *, {p} AS p FROM st)" for k, p in _PLACE.items())
_USED = "list_filter(range(1, 5), lambda i: t[i] <> 0)"
_MEAN = f"SELECT vec_id, 'mean' AS pool, list_sum(list_transform(u, lambda i: list_sum(e[16 * (i - 1) + 1 : 16 * i]))) / len(u) AS s, list_sum(list_transform(u, lambda i: e[16 * i])) / len(u) AS final FROM (SELECT *, CASE WHEN len({_USED}) > 0 THEN {_USED} ELSE [1] END AS u FROM st)"


@query(f"WITH {_STATES}, a AS ({_POOLED} UNION ALL {_MEAN}) SELECT vec_id, pool, round(s, 5) AS total, round(final, 5) AS final FROM a")
def text_pooling(spark, sf):
    """One vector of the token states by each pooling; shown by its sum and last number."""
    rows = states(spark, sf)
    made = F.array(*[F.struct(F.lit(k).alias("pool"), F.transform(vectors.pooled(F.col("states"), F.col("tokens"), k), lambda x: x.cast("double")).alias("v")) for k in ("argmax", "first", "last", "mean")])
    rows = rows.select("vec_id", F.explode(made).alias("x")).select("vec_id", "x.*")
    return rows.select("vec_id", "pool", r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), "total", 5), r6(F.element_at("v", -1), "final", 5))


@query(f"WITH {_ROWS}, p AS (SELECT model, seed, pair_id, severity, avg(hit) FILTER (WHERE direction = 'i2t') AS native, avg(hit) FILTER (WHERE direction = 't2i') AS mean FROM hits WHERE severity IN (1, 5) GROUP BY ALL HAVING native IS NOT NULL AND mean IS NOT NULL) "
       "SELECT model, count(*) FILTER (WHERE severity = 5) AS n, round(avg(native) FILTER (WHERE severity = 1) - avg(native) FILTER (WHERE severity = 5), 6) AS native_drop, round(avg(mean) FILTER (WHERE severity = 1) - avg(mean) FILTER (WHERE severity = 5), 6) AS mean_drop, round(avg(mean - native) FILTER (WHERE severity = 5), 6) AS diff, count(*) FILTER (WHERE severity = 5 AND mean > native) AS better, count(*) FILTER (WHERE severity = 5 AND mean < native) AS worse FROM p GROUP BY 1")  # fmt: skip
def pooling_test(spark, sf):
    """Drop from severity 1 to 5 under two poolings of the same pairs, and their paired difference at severity 5."""
    of = lambda d: F.avg(F.when(F.col("direction") == d, F.col("hit")))
    pairs = hits(spark, sf).where("severity in (1, 5)").groupBy("model", "seed", "pair_id", "severity").agg(of("i2t").alias("native"), of("t2i").alias("mean")).where("native is not null and mean is not null")
    at = lambda c, s: F.avg(F.when(F.col("severity") == s, c))
    worst, change = F.col("severity") == 5, F.col("mean") - F.col("native")
    drop = lambda c: at(F.col(c), 1) - at(F.col(c), 5)
    return pairs.groupBy("model").agg(
        F.count_if(worst).alias("n"), r6(drop("native"), "native_drop"), r6(drop("mean"), "mean_drop"), r6(at(change, 5), "diff"), F.count_if(worst & (change > 0)).alias("better"), F.count_if(worst & (change < 0)).alias("worse")
    )


@query(f"WITH {_ROWS}, p AS (SELECT model, seed, pair_id, severity, avg(hit) FILTER (WHERE direction = 'i2t') AS native, avg(hit) FILTER (WHERE direction = 't2i') AS mean FROM hits WHERE severity = 5 GROUP BY ALL HAVING native IS NOT NULL AND mean IS NOT NULL), v AS (SELECT model, seed, pair_id, mean - native AS value FROM p), {bootstrap.draws_sql('v', ['model'], ['seed', 'pair_id'], 1000)}, q AS (SELECT model, {_LO_HI('mean')} FROM draws GROUP BY 1) "
       "SELECT model, n, round(point, 6) AS diff, round(CASE WHEN n > 1 THEN lo END, 6) AS lo, round(CASE WHEN n > 1 THEN hi END, 6) AS hi, coalesce(n > 1 AND lo > 0, false) AS supports, coalesce(n > 1 AND hi < 0, false) AS rejects FROM draws_points JOIN q USING (model)")  # fmt: skip
def pooling_test_interval(spark, sf):
    """Paired difference of two poolings at severity 5 with its interval, and whether it lies above or below zero."""
    of = lambda d: F.avg(F.when(F.col("direction") == d, F.col("hit")))
    pairs = hits(spark, sf).where("severity = 5").groupBy("model", "seed", "pair_id").agg(of("i2t").alias("native"), of("t2i").alias("mean"))
    found = bootstrap.flat_interval(pairs.withColumn("value", F.col("mean") - F.col("native")), ["model"], ["seed", "pair_id"])
    above, below = F.coalesce(F.col("lo") > 0, F.lit(False)), F.coalesce(F.col("hi") < 0, F.lit(False))
    return found.select("model", "n", r6("mean", "diff"), r6("lo", "lo"), r6("hi", "hi"), above.alias("supports"), below.alias("rejects"))


_POOL5 = "pool AS (SELECT i, avg(v) AS m FROM (SELECT unnest(embedding)::DOUBLE / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 7 = 0) GROUP BY 1), centroid AS (SELECT list(m ORDER BY i) AS m FROM pool)"
_GRID = "SELECT vec_id, si, st, list_transform(embedding, lambda x, i: CASE WHEN i % 6 < si THEN 0::DOUBLE ELSE x::DOUBLE END) AS a, list_transform(other, lambda x, i: CASE WHEN i % 7 < st THEN 0::DOUBLE ELSE x::DOUBLE END) AS b FROM (SELECT a.vec_id AS vec_id, a.embedding AS embedding, b.embedding AS other FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id WHERE a.vec_id % 7 <> 0), (SELECT unnest(range(1, 6)) AS si), (SELECT unnest(range(1, 6)) AS st)"


@query(f"WITH {_POOL5}, g AS ({_GRID}), s AS (SELECT si, st, list_cosine_similarity(a, b) AS m, list_inner_product(a, c.m) / greatest(sqrt(list_inner_product(a, a)), 1e-12) AS k FROM g, centroid c) SELECT si AS image_severity, st AS text_severity, count(*) AS n, round(avg(m), 6) AS sim_match, round(avg(k), 6) AS sim_mismatch, round(avg(m - k), 6) AS margin FROM s GROUP BY ALL")
def joint_grid_retention(spark, sf):
    """Both sides changed at five by five severities; the mismatch is against the clean pool of texts."""
    rows = read(spark, sf, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    pool = vectors.mean_vector(rows.where("vec_id % 7 = 0").select(vectors.normalise(F.col("embedding")).alias("p")), [], "p")
    versions = lambda v, n: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda s: F.transform(v, lambda x, i: F.when((i + 1) % n < s, F.lit(0.0)).otherwise(x.cast("double"))))
    pairs = rows.where("vec_id % 7 <> 0").join(other, "vec_id").select(versions("embedding", 6).alias("a"), versions("other", 7).alias("b"))
    found = vectors.grid_retention(pairs, pool, "a", "b", "p")
    return found.select(
        (F.col("i") + 1).alias("image_severity"), (F.col("j") + 1).alias("text_severity"), "n", r6("sim_match", "sim_match"), r6("sim_mismatch", "sim_mismatch"), r6(F.col("sim_match") - F.col("sim_mismatch"), "margin")
    )


@query("SELECT vec_id, round(list_inner_product(e, [1, -1, 0.5]::DOUBLE[]), 6) AS x, round(list_inner_product(e, [0, 2, 1]::DOUBLE[]), 6) AS y FROM (SELECT vec_id, embedding[1:3]::DOUBLE[] AS e FROM embeddings)")
def linear_projection(spark, sf):
    v = vectors.projected(F.slice("embedding", 1, 3), [[1, 0], [-1, 2], [0.5, 1]])
    return read(spark, sf, "embeddings").select("vec_id", v.alias("v")).select("vec_id", r6(F.get("v", F.lit(0)), "x"), r6(F.get("v", F.lit(1)), "y"))


@query(f"WITH {_ROWS} SELECT position, model, round(avg(hit), 6) AS hit FROM hits JOIN (SELECT unnest(['R', 'N', 'A']) AS model, unnest([0, 1, 2]) AS position) USING (model) GROUP BY ALL")
def models_in_order(spark, sf):
    """Models in the order of the reports."""
    rows = hits(spark, sf).groupBy("model").agg(r6(F.avg("hit"), "hit"))
    return views.in_order(rows, "model", ["R", "N", "A"]).select("position", "model", "hit")


@query("SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')[1:8], ' ') AS caption FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 24")
def first_captions(spark, sf):
    """The first 24 captions by id."""
    rows = read(spark, sf, "documents").where("text is not null").orderBy("doc_id").limit(24)
    words = F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")
    return rows.select("doc_id", F.array_join(F.slice(words, 1, 8), " ").alias("caption"))


@query("WITH a AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '7', doc_id)), doc_id) - 1 AS r FROM documents) WHERE r < 100), b AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '9', doc_id)), doc_id) - 1 AS r FROM documents) WHERE r < 100) SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b")
def shared_pairs(spark, sf):
    """Pairs that the slices of two seeds have in common; none where slices are disjoint."""
    docs = read(spark, sf, "documents").select("doc_id")
    one, two = (manifest.seeded_slice(docs, "doc_id", s, 100).select("doc_id") for s in (7, 9))
    return one.intersect(two)


@query(f"WITH {_ROWS}, {_CLEAN} SELECT model, direction, round(regr_slope(hit, severity), 6) AS slope, round(any_value(clean), 6) AS clean, round(avg(hit) FILTER (WHERE severity = 1) - avg(hit) FILTER (WHERE severity = 5), 6) AS fall FROM hits JOIN clean USING (model, direction) WHERE severity > 0 GROUP BY ALL")
def two_components(spark, sf):
    """Where a model starts (clean) and how fast it falls with severity."""
    at = lambda s: F.avg(F.when(F.col("severity") == s, F.col("hit")))
    cells = hits(spark, sf).where("severity > 0").groupBy("model", "direction").agg(F.regr_slope("hit", F.col("severity")).alias("slope"), (at(1) - at(5)).alias("fall"))
    return views.looked_up(cells, clean_means(spark, sf), ["model", "direction"], "clean").select("model", "direction", r6("slope", "slope"), r6("clean", "clean"), r6("fall", "fall"))


@query(f"WITH {_ROWS}, m AS (SELECT model, seed, avg(hit) AS v FROM hits GROUP BY ALL) SELECT model, printf('%.3f±%.3f', avg(v), coalesce(stddev_samp(v), 0)) AS text FROM m GROUP BY 1")
def mean_sd_format(spark, sf):
    seeds = hits(spark, sf).groupBy("model", "seed").agg(F.avg("hit").alias("v"))
    return seeds.groupBy("model").agg(F.format_string("%.3f±%.3f", F.avg("v"), F.coalesce(F.stddev_samp("v"), F.lit(0.0))).alias("text"))


@query("WITH d AS (SELECT sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents GROUP BY 1), old AS (SELECT sha256 FROM d WHERE doc_id % 3 = 0) SELECT sha256, doc_id FROM d WHERE sha256 NOT IN (SELECT sha256 FROM old) AND sha256 IS NOT NULL")
def manifest_append(spark, sf):
    """What a batch adds to a manifest: contents that it does not hold yet, each once."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    old = manifest.dedup_by_content(docs, F.col("text"), "doc_id").where("doc_id % 3 = 0")
    return manifest.new_items(old, docs, F.col("text"), "doc_id").select("sha256", "doc_id")

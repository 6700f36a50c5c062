"""Queries of the robustness analytics over the tables of a data folder, with the same rows in DuckDB SQL.

Stand-ins: ``orders`` are scores (priority = model, customer = seed, key = pair), ``lineitem``
the damage of (pair, severity), ``embeddings`` the encoded items, ``benchmark`` the captions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IMAGE, SEVERITY, TEXT
from ..functions import corrupt, damage, vectors
from ..operators import binning, bootstrap, statistics
from ..session import workers_find_package
from ..sources import manifest, pictures, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of a table of few files dealt to all tasks, before costly work on each of them."""
    return rows.repartition(views.parts_of(0, rows.sparkSession), *key)


def r6(c: Column | str, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


def scores(spark, sf) -> DataFrame:
    return read(spark, sf, "orders").selectExpr(
        "o_orderpriority as model", "cast(o_custkey % 3 as int) as seed", "o_orderkey as pair_id", "cast(1 + o_orderkey % 5 as int) as severity",
        "o_totalprice / 100000D as value", "case when o_custkey % 2 = 0 then 1D else 0D end as hit",
    )


def damages(spark, sf) -> DataFrame:
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("severity"))
    return rows.agg(F.max("l_discount").alias("damage_image"), F.max("l_tax").alias("damage_text"), F.max("l_quantity").alias("psnr"))


def measured(spark, sf) -> DataFrame:
    """Scores with the damage of their full key."""
    return scores(spark, sf).join(damages(spark, sf), ["pair_id", "severity"])


def arms(spark, sf, values=("value",)) -> DataFrame:
    """Both arms as rows (``arm``: the damage they are binned by), with the quintile within model and arm."""
    rows = measured(spark, sf).unpivot(["model", "seed", "pair_id", "severity", *values], ["damage_image", "damage_text"], "arm", "damage")
    return binning.assign_quintile(rows, ["model", "arm"], "damage")


_SCORES = """scores AS (SELECT o_orderpriority AS model, CAST(o_custkey % 3 AS INT) AS seed, o_orderkey AS pair_id, CAST(1 + o_orderkey % 5 AS INT) AS severity,
  o_totalprice / 100000::DOUBLE AS value, CASE WHEN o_custkey % 2 = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS hit FROM orders)"""
_MEASURED = f"""{_SCORES}, damages AS (SELECT l_orderkey AS pair_id, l_linenumber AS severity, max(l_discount) AS damage_image, max(l_tax) AS damage_text,
  max(l_quantity) AS psnr FROM lineitem GROUP BY 1, 2), measured AS (SELECT * FROM scores JOIN damages USING (pair_id, severity))"""


def _binned(source: str, column: str, name: str, group: str = "model") -> str:
    bins = "greatest(1, len(list_filter(list_distinct(e[1:5]), lambda x: x < s.{c})))".format(c=column)
    return (
        f"{name} AS (SELECT s.*, CASE WHEN e[1] < e[6] AND s.{column} IS NOT NULL THEN CAST({bins} AS INT) END AS quintile FROM {source} s JOIN "
        f"(SELECT {group}, quantile_cont({column}, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM {source} GROUP BY {group}) USING ({group}))"
    )


_ARMS = f"{_MEASURED}, {_binned('measured', 'damage_image', 'i')}, {_binned('measured', 'damage_text', 't')}"


@query(f"WITH {_ARMS}, a AS (SELECT model, quintile, avg(value) AS v, count(*) AS n FROM i GROUP BY 1, 2), b AS (SELECT model, quintile, avg(value) AS v, count(*) AS n FROM t GROUP BY 1, 2) "
       "SELECT model, quintile, round(a.v, 6) AS image_mean, a.n AS image_n, round(b.v, 6) AS text_mean, b.n AS text_n, round(a.v - b.v, 6) AS diff FROM a FULL JOIN b USING (model, quintile)")  # fmt: skip
def matched_quintile_diff(spark, sf):
    is_image = F.col("arm") == "damage_image"
    side = lambda c, x: [F.avg(F.when(c, F.col("value"))).alias(f"{x}_v"), F.nullif(F.count_if(c), F.lit(0)).alias(f"{x}_n")]
    both = arms(spark, sf).groupBy("model", "quintile").agg(*side(is_image, "image"), *side(~is_image, "text"))
    return both.select("model", "quintile", r6("image_v", "image_mean"), "image_n", r6("text_v", "text_mean"), "text_n", r6(F.col("image_v") - F.col("text_v"), "diff"))


@query(f"WITH {_ARMS} SELECT model, quintile, count(*) AS n, round(min(damage_image), 6) AS low, round(max(damage_image), 6) AS high FROM i GROUP BY 1, 2")
def quintile_bins(spark, sf):
    rows = binning.assign_quintile(measured(spark, sf), ["model"], "damage_image")
    return rows.groupBy("model", "quintile").agg(F.count("*").alias("n"), r6(F.min("damage_image"), "low"), r6(F.max("damage_image"), "high"))


_TIED = "tied AS (SELECT l_returnflag, greatest(l_discount - 0.05::DOUBLE, 0) AS x FROM lineitem)"


@query(f"WITH {_TIED}, {_binned('tied', 'x', 'b', 'l_returnflag')} SELECT l_returnflag, quintile, count(*) AS n FROM b GROUP BY 1, 2")
def quintile_collapsed_edges(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_returnflag", F.greatest(F.col("l_discount") - 0.05, F.lit(0.0)).alias("x"))
    return binning.assign_quintile(rows, ["l_returnflag"], "x").groupBy("l_returnflag", "quintile").agg(F.count("*").alias("n"))


_RANKS = f"""{_MEASURED}, ranks AS (SELECT *, (rank() OVER (PARTITION BY model ORDER BY damage_image) + (count(*) OVER (PARTITION BY model, damage_image) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY model) AS ri,
  (rank() OVER (PARTITION BY model ORDER BY damage_text) + (count(*) OVER (PARTITION BY model, damage_text) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY model) AS rt FROM measured)"""


def _ranks(spark, sf):
    return binning.percentile_rank(binning.percentile_rank(measured(spark, sf), ["model"], "damage_image", "ri"), ["model"], "damage_text", "rt")


@query(f"WITH {_RANKS} SELECT pair_id, severity, round(ri, 6) AS ri, round(rt, 6) AS rt FROM ranks")
def percentile_rank_ties(spark, sf):
    return _ranks(spark, sf).select("pair_id", "severity", r6("ri", "ri"), r6("rt", "rt"))


def _ols_sql(y, x):
    return f"round(regr_slope({y}, {x}), 6) AS slope, round(regr_intercept({y}, {x}), 6) AS intercept, round(CASE WHEN var_pop({y}) > 0 AND var_pop({x}) > 0 THEN regr_r2({y}, {x}) END, 6) AS r2"


def _ols(y, x):
    return [F.round(c, 6).alias(n) for c, n in zip(statistics.ols(y, x), ("slope", "intercept", "r2"), strict=True)]


@query(f"WITH {_RANKS}, p AS (SELECT model, value, greatest(ri, rt) AS worst, least(ri, rt) AS best, ri AS image, rt AS text FROM ranks), u AS (UNPIVOT p ON worst, best, image, text INTO NAME predictor VALUE x) "
       f"SELECT model, predictor, {_ols_sql('value', 'x')} FROM u GROUP BY 1, 2")  # fmt: skip
def dominance_regression(spark, sf):
    rows = _ranks(spark, sf).select("model", "value", F.greatest("ri", "rt").alias("worst"), F.least("ri", "rt").alias("best"), F.col("ri").alias("image"), F.col("rt").alias("text"))
    return rows.unpivot(["model", "value"], ["worst", "best", "image", "text"], "predictor", "x").groupBy("model", "predictor").agg(*_ols("value", "x"))


@query(f"WITH {_MEASURED} SELECT model, severity, round(avg(value), 9) AS value, round(avg(hit), 9) AS hit, round(avg(damage_image), 9) AS damage_image, round(avg(damage_text), 9) AS damage_text, count(*) AS n FROM measured GROUP BY 1, 2")
def damage_curve_by_condition(spark, sf):
    return measured(spark, sf).groupBy("model", "severity").agg(*[r6(F.avg(c), c, 9) for c in ("value", "hit", "damage_image", "damage_text")], F.count("*").alias("n"))


@query(f"WITH {_MEASURED} SELECT model, {_ols_sql('value', 'damage_image')} FROM measured GROUP BY 1")
def slope_per_group(spark, sf):
    return measured(spark, sf).groupBy("model").agg(*_ols("value", "damage_image"))


@query(f"WITH {_MEASURED}, u AS (UNPIVOT (SELECT model, severity, damage_image, damage_text, psnr FROM measured) ON damage_image, damage_text, psnr INTO NAME metric VALUE x) SELECT model, severity, metric, round(avg(x), 6) AS mean, count(*) AS n FROM u GROUP BY 1, 2, 3")
def cell_damage_table(spark, sf):
    rows = measured(spark, sf).select("model", "severity", "damage_image", "damage_text", "psnr").unpivot(["model", "severity"], ["damage_image", "damage_text", "psnr"], "metric", "x")
    return rows.groupBy("model", "severity", "metric").agg(r6(F.avg("x"), "mean"), F.count("*").alias("n"))


@query("SELECT event_type AS model, round(avg(value), 6) AS clean, count(*) AS n FROM events WHERE coalesce(try_cast(event_id % 6 AS INT), -1) = 0 AND coalesce(try_cast(user_id % 2 AS INT), -1) = 0 GROUP BY 1")
def clean_baseline(spark, sf):
    rows = read(spark, sf, "events").where("coalesce(try_cast(event_id % 6 as int), -1) = 0 and coalesce(try_cast(user_id % 2 as int), -1) = 0")
    return rows.groupBy(F.col("event_type").alias("model")).agg(r6(F.avg("value"), "clean"), F.count("*").alias("n"))


@query(f"WITH {_MEASURED} SELECT * FROM measured")
def score_damage_join(spark, sf):
    return measured(spark, sf)


@query(f"WITH {_SCORES} SELECT a.model AS model, a.pair_id AS pair_id, round(b.value - a.value, 6) AS diff FROM scores a JOIN scores b ON a.pair_id + 5 = b.pair_id AND a.model = b.model WHERE a.severity = 5")
def paired_align_diff(spark, sf):
    rows = scores(spark, sf)
    other = rows.select("model", (F.col("pair_id") - 5).alias("pair_id"), F.col("value").alias("other"))
    return rows.where("severity = 5").join(other, ["model", "pair_id"]).select("model", "pair_id", r6(F.col("other") - F.col("value"), "diff"))


@query(f"WITH {_SCORES} SELECT model, round(avg(value) FILTER (WHERE severity = 1) - avg(value) FILTER (WHERE severity = 5), 6) AS drop_1_5, round(avg(hit) FILTER (WHERE severity = 1) - avg(hit) FILTER (WHERE severity = 5), 6) AS hit_drop FROM scores GROUP BY 1")
def drop_severity_1_to_5(spark, sf):
    at = lambda c, s: F.avg(F.when(F.col("severity") == s, F.col(c)))
    return scores(spark, sf).groupBy("model").agg(r6(at("value", 1) - at("value", 5), "drop_1_5"), r6(at("hit", 1) - at("hit", 5), "hit_drop"))


@query(f"WITH {_SCORES}, d AS (SELECT model, avg(value) FILTER (WHERE severity = 1) - avg(value) FILTER (WHERE severity = 5) AS ds, avg(value) FILTER (WHERE severity = 2) - avg(value) FILTER (WHERE severity = 4) AS dm FROM scores GROUP BY 1) SELECT model, round(CASE WHEN ds > 0 THEN (1 - dm / ds) * 100 END, 4) AS shrinkage FROM d")
def shrinkage_pct(spark, sf):
    at = lambda s: F.avg(F.when(F.col("severity") == s, F.col("value")))
    rows = scores(spark, sf).groupBy("model").agg((at(1) - at(5)).alias("ds"), (at(2) - at(4)).alias("dm"))
    return rows.select("model", r6(F.when(F.col("ds") > 0, (1 - F.col("dm") / F.nullif("ds", F.lit(0.0))) * 100), "shrinkage", 4))


@query(f"WITH {_SCORES} SELECT model, {', '.join(f'round(avg(value) FILTER (WHERE severity = {s}), 6) AS s{s}' for s in range(1, 6))} FROM scores GROUP BY 1")
def pivot_model_severity(spark, sf):
    return scores(spark, sf).groupBy("model").pivot("severity", [1, 2, 3, 4, 5]).agg(F.avg("value")).select("model", *[r6(F.col(f"`{s}`"), f"s{s}") for s in range(1, 6)])


@query(f"WITH {_MEASURED}, u AS (UNPIVOT (SELECT pair_id, severity, model, value, hit, psnr FROM measured) ON value, hit, psnr INTO NAME metric VALUE x) SELECT pair_id, severity, model, metric, x FROM u")
def long_row_emit(spark, sf):
    return measured(spark, sf).unpivot(["pair_id", "severity", "model"], ["value", "hit", "psnr"], "metric", "x")


@query(f"WITH {_SCORES} SELECT seed, model, round(avg(value), 6) AS mean, count(*) AS n FROM scores GROUP BY 1, 2")
def union_seed_runs(spark, sf):
    rows = scores(spark, sf)
    parts = [rows.where(F.col("seed") == s).withColumn("seed", F.lit(s)) for s in (0, 1, 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("seed", "model").agg(r6(F.avg("value"), "mean"), F.count("*").alias("n"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, octet_length(encode(first(text))) AS size FROM documents GROUP BY 1")
def manifest_dedup(spark, sf):
    rows = manifest.dedup_by_content(read(spark, sf, "documents").select("doc_id", "text"), F.col("text"), "doc_id")
    return rows.select("sha256", "doc_id", F.octet_length("text").cast("long").alias("size"))


@query("SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '7', doc_id)), doc_id) - 1 AS rank FROM documents) WHERE rank >= 20 AND rank < 120")
def pair_slice(spark, sf):
    return manifest.seeded_slice(read(spark, sf, "documents").select("doc_id"), "doc_id", 7, 100, 20)


@query("WITH s AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '7', doc_id)), doc_id) - 1 AS rank FROM documents) WHERE rank < 100) "
       "SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '8', doc_id)), doc_id) - 1 AS rank FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)) WHERE rank < 64")  # fmt: skip
def disjoint_pool(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id")
    return manifest.disjoint_pool(docs, "doc_id", manifest.seeded_slice(docs, "doc_id", 7, 100), 8, 64)


@query("SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return manifest.duplicate_ids(read(spark, sf, "lineitem"), "l_orderkey")


_SEED_MEANS = f"{_SCORES}, m AS (SELECT model, seed, avg(value) AS v FROM scores GROUP BY 1, 2)"


@query(f"WITH {_SEED_MEANS} SELECT model, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, count(*) AS seeds FROM m GROUP BY 1")
def seed_mean_sd(spark, sf):
    means = scores(spark, sf).groupBy("model", "seed").agg(F.avg("value").alias("v"))
    return means.groupBy("model").agg(r6(F.avg("v"), "mean"), r6(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), "sd"), F.count("*").alias("seeds"))


@query(f"WITH {_SEED_MEANS} SELECT model, CASE WHEN count(v) = 0 THEN 'n/a' ELSE printf('%.3f [%.3f, %.3f]', avg(v), min(v), max(v)) END AS text FROM m GROUP BY 1")
def ci_format(spark, sf):
    means = scores(spark, sf).groupBy("model", "seed").agg(F.avg("value").alias("v"))
    return means.groupBy("model").agg(F.coalesce(F.format_string("%.3f [%.3f, %.3f]", F.avg("v"), F.min("v"), F.max("v")), F.lit("n/a")).alias("text"))


@query(f"WITH {_ARMS} SELECT severity, {', '.join(f'count(*) FILTER (WHERE quintile = {q}) AS q{q}' for q in range(1, 6))} FROM i GROUP BY 1")
def condition_quintile_contingency(spark, sf):
    rows = binning.assign_quintile(measured(spark, sf), ["model"], "damage_image").groupBy("severity").pivot("quintile", [1, 2, 3, 4, 5]).count().fillna(0)
    return rows.select("severity", *[F.col(f"`{q}`").alias(f"q{q}") for q in range(1, 6)])


@query(f"WITH {_ARMS}, c AS (SELECT quintile, severity, count(*) AS n FROM i WHERE quintile >= 4 GROUP BY 1, 2) SELECT quintile, severity, n, round(n / sum(n) OVER (PARTITION BY quintile), 6) AS share FROM c")
def tail_quintile_composition(spark, sf):
    from pyspark.sql.window import Window

    rows = binning.assign_quintile(measured(spark, sf), ["model"], "damage_image").where("quintile >= 4").groupBy("quintile", "severity").agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("quintile")), 6))


@query(f"WITH {_ARMS}, a AS (SELECT model, avg(value) AS v FROM i WHERE quintile = 5 GROUP BY 1), b AS (SELECT model, avg(value) AS v FROM t WHERE quintile = 1 GROUP BY 1) SELECT model, round(a.v, 6) AS image_worst, round(b.v, 6) AS text_best, a.v > b.v AS crosses FROM a JOIN b USING (model)")
def crossover_check(spark, sf):
    at = lambda arm, q: F.avg(F.when((F.col("arm") == arm) & (F.col("quintile") == q), F.col("value")))
    both = arms(spark, sf).groupBy("model").agg(at("damage_image", 5).alias("a"), at("damage_text", 1).alias("b"))
    return both.select("model", r6("a", "image_worst"), r6("b", "text_best"), (F.col("a") > F.col("b")).alias("crosses"))


@query(f"WITH {_ARMS}, a AS (SELECT model, quintile, avg(value) AS v FROM i GROUP BY 1, 2), b AS (SELECT model, quintile, avg(value) AS v FROM t GROUP BY 1, 2), d AS (SELECT a.v > b.v AS up FROM a JOIN b USING (model, quintile)) SELECT count(*) AS cells, count(*) FILTER (WHERE up) AS ups, coalesce(bool_and(up), true) AS every FROM d")
def matched_quintile_headline(spark, sf):
    at = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("value")))
    cells = arms(spark, sf).groupBy("model", "quintile").agg(at("damage_image").alias("a"), at("damage_text").alias("b")).where("quintile is not null and a is not null and b is not null")
    up = F.col("a") > F.col("b")
    return cells.agg(F.count("*").alias("cells"), F.count_if(up).alias("ups"), F.coalesce(F.bool_and(up), F.lit(True)).alias("every"))


_PAIRS = "q AS (SELECT vec_id // 2 AS id, embedding AS v FROM embeddings WHERE vec_id % 2 = 1), c AS (SELECT vec_id // 2 AS id, embedding AS v FROM embeddings WHERE vec_id % 2 = 0)"
_BETTER = f"{_PAIRS}, own AS (SELECT q.id AS id, q.v AS v, list_cosine_similarity(q.v::DOUBLE[], c.v::DOUBLE[]) AS s FROM q JOIN c USING (id)), ranks AS (SELECT own.id AS id, count(*) FILTER (WHERE list_cosine_similarity(own.v::DOUBLE[], c.v::DOUBLE[]) > own.s + 1e-12) AS better FROM own, c GROUP BY 1)"


def _better(spark, sf, limit=None):
    rows = read(spark, sf, "embeddings")
    side = lambda odd: rows.where(F.col("vec_id") % 2 == odd).select(F.expr("vec_id div 2").alias("id"), F.col("embedding").alias("vector"))
    candidates = side(0)
    return vectors.better_candidates(side(1).join(candidates.withColumnRenamed("vector", "own"), "id"), candidates, limit)


@query(f"WITH {_BETTER} SELECT id, better, better < 1 AS hit1, better < 5 AS hit5, better < 10 AS hit10 FROM ranks")
def recall_per_query(spark, sf):
    return _better(spark, sf).select("id", "better", *[(F.col("better") < k).alias(f"hit{k}") for k in (1, 5, 10)])


@query(f"WITH {_BETTER} SELECT count(*) AS n, {', '.join(f'round(avg(CASE WHEN better < {k} THEN 1.0 ELSE 0.0 END), 6) AS r{k}' for k in (1, 5, 10))} FROM ranks")
def recall_at_k(spark, sf):
    return _better(spark, sf, 10).agg(F.count("*").alias("n"), *[r6(F.avg((F.col("better") < k).cast("double")), f"r{k}") for k in (1, 5, 10)])


#: Queries: every tenth vector; positives: the next five vectors, none for every thirtieth; candidates: the other vectors.
_POSITIVE = """q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 = 0), c AS (SELECT vec_id AS cand, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 <> 0),
sims AS (SELECT id, cand, list_cosine_similarity(q.v, c.v) AS s, id % 30 <> 0 AND cand > id AND cand <= id + 5 AS pos FROM q, c),
best AS (SELECT id, max(s) FILTER (WHERE pos) AS top FROM sims GROUP BY 1),
ranks AS (SELECT sims.id AS id, CASE WHEN any_value(top) IS NULL THEN NULL ELSE count(*) FILTER (WHERE s > top + 1e-12) END AS better FROM sims JOIN best ON sims.id = best.id GROUP BY 1)"""


@query(f"WITH {_POSITIVE} SELECT id, coalesce(better, -1) AS better, coalesce(better < 1, false) AS hit1, coalesce(better < 5, false) AS hit5, coalesce(better < 10, false) AS hit10 FROM ranks")
def recall_multi_positive(spark, sf):
    """Hits of queries with several right answers; ``better`` is -1 for a query without any."""
    rows = read(spark, sf, "embeddings")
    queries = rows.where("vec_id % 10 = 0").selectExpr("vec_id as id", "embedding as vector")
    positives = queries.where("id % 30 <> 0").select("id", F.explode(F.sequence(F.col("id") + 1, F.col("id") + 5)).alias("candidate"))
    ranks = vectors.multi_positive_ranks(queries, positives, rows.where("vec_id % 10 <> 0").selectExpr("vec_id as candidate", "embedding as vector"))
    return ranks.select("id", F.coalesce("better", F.lit(-1)).alias("better"), *[F.coalesce(F.col("better") < k, F.lit(False)).alias(f"hit{k}") for k in (1, 5, 10)])


@query(
    "WITH p AS (SELECT a.label AS label, list_cosine_similarity(a.embedding[1 + 16 * i : 16 * i + 16]::DOUBLE[], b.embedding[1 + 16 * i : 16 * i + 16]::DOUBLE[]) AS c "
    "FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id, (SELECT unnest(range(4)) AS i)) SELECT label, round(avg(c), 6) AS fidelity, count(*) AS patches FROM p GROUP BY 1"
)
def patch_fidelity(spark, sf):
    """Vectors as four patches; the label stands for the depth, the next vector for the corrupted item."""
    patches = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    rows = read(spark, sf, "embeddings").select("vec_id", "label", patches.alias("clean"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("clean").alias("changed")), "vec_id")
    return vectors.patch_fidelity(pairs, ["label"], "clean", "changed").select("label", r6("fidelity", "fidelity"), "patches")


@query("SELECT a.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id")
def vector_cosine(spark, sf):
    rows = read(spark, sf, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id").select("vec_id", r6(vectors.cosine(F.col("embedding"), F.col("other")), "cosine"))


@query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i - 1 AS i, round(avg(v), 6) AS mean FROM x GROUP BY 1, 2")
def mean_pooling(spark, sf):
    rows = vectors.mean_vector(read(spark, sf, "embeddings"), ["label"], "embedding").select("label", F.posexplode("embedding").alias("i", "v"))
    return rows.select("label", F.col("i").cast("long").alias("i"), r6("v", "mean"))


_POOL = "pool AS (SELECT i, avg(v) AS m FROM (SELECT unnest(embedding)::DOUBLE / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 7 = 0) GROUP BY 1), centroid AS (SELECT list(m ORDER BY i) AS m FROM pool)"


@query(f"WITH {_POOL}, s AS (SELECT a.vec_id AS vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS m, list_inner_product(a.embedding::DOUBLE[], c.m) / greatest(sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 1e-12) AS k FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id, centroid c WHERE a.vec_id % 7 <> 0) SELECT vec_id, round(m, 6) AS sim_match, round(k, 6) AS sim_mismatch_mean, round(m - k, 6) AS margin FROM s")
def match_retention_margin(spark, sf):
    """The mean cosine with a pool is one dot product with the mean of its unit vectors."""
    rows = read(spark, sf, "embeddings")
    pool = rows.where("vec_id % 7 = 0").select(vectors.normalise(F.col("embedding")).alias("p"))
    centroid = F.broadcast(vectors.mean_vector(pool, [], "p"))  # one row
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    both = rows.where("vec_id % 7 <> 0").join(other, "vec_id").crossJoin(centroid)
    m = vectors.cosine(F.col("embedding"), F.col("other"))
    k = vectors.dot(vectors.normalise(F.col("embedding")), F.col("p"))
    return both.select("vec_id", r6(m, "sim_match"), r6(k, "sim_mismatch_mean"), r6(m - k, "margin"))


@query("SELECT vec_id, d AS depth, greatest(0, least(23, CAST(round_even(least(1, greatest(0, d)) * 24, 0) AS INT) - 1)) AS layer FROM embeddings, (SELECT unnest([0.1, 0.4, 0.5, 0.8, 1.0])::DOUBLE AS d)")
def layers_of_depths(spark, sf):
    rows = read(spark, sf, "embeddings").select("vec_id", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.4, 0.5, 0.8, 1.0)])).alias("depth"))
    return rows.withColumn("layer", vectors.proportional_layer(F.col("depth"), F.lit(24)))


#: Captions: all sentences of the conversations.
_BLANKS = r"[\s\x{85}\x{1c}-\x{1f}\p{Z}]+"
_TEXTS = f"SELECT (conv_id * 100 + turn) * 1000 + i AS id, text FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '[.!?\\n]+')) AS text, generate_subscripts(string_split_regex(text, '[.!?\\n]+'), 1) - 1 AS i FROM conversations) WHERE len(list_filter(string_split_regex(text, '{_BLANKS}'), lambda x: x <> '')) > 0"


def _words_sql(texts: str) -> str:
    return f"w AS (SELECT id, list_filter(string_split_regex(coalesce(text, ''), '{_BLANKS}'), lambda x: x <> '') AS w FROM ({texts})), lv AS (SELECT id, w, len(w) AS n, s AS level, CAST(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, least(len(w), round_even(([0.1, 0.2, 0.4, 0.6, 0.8])[s]::DOUBLE * len(w), 0))) END AS INT) AS k FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS s))"


_WORDS = _words_sql(_TEXTS)


def _captions(spark, sf):
    rows = spread(read(spark, sf, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", F.posexplode(F.split("text", r"[.!?\n]+")).alias("i", "text"))
    rows = rows.select(((F.col("conv_id") * 100 + F.col("turn")) * 1000 + F.col("i")).alias("id"), corrupt.words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    return rows.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(5))))


def _key():
    return F.concat_ws("|", F.col("id").cast("string"), F.col("level").cast("string"))


def _corrupted(spark, sf, kind):
    rows = _captions(spark, sf)
    return rows.withColumn("c", corrupt.corrupt_text(kind, F.col("w"), _key(), F.col("level")))


_SPOTS = "p AS (SELECT id, level, k, n, i, row_number() OVER (PARTITION BY id, level ORDER BY md5(concat_ws('|', '{salt}', id, level, i)), i) AS r FROM (SELECT id, level, k, n, unnest(range(n)) AS i FROM lv))"


@query(f"WITH {_WORDS} SELECT id, level, n, k FROM lv")
def tokenise_k_for_severity(spark, sf):
    share = F.get(F.array(*[F.lit(v) for v in SEVERITY["mask"]]), F.col("level") - 1)
    return _captions(spark, sf).select("id", "level", F.size("w").cast("long").alias("n"), corrupt.affected(F.size("w"), share).alias("k"))


_VOCABULARY = "[" + ", ".join(f"'{w}'" for w in corrupt.VOCABULARY) + "]"
_KINDS_SQL = {
    "mask": f"{_SPOTS.format(salt='mask')} SELECT lv.id AS id, lv.level AS level, coalesce((SELECT string_agg(lv.w[p.i + 1], ' ' ORDER BY p.i) FROM p WHERE p.id = lv.id AND p.level = lv.level AND p.r > p.k), '') AS text FROM lv",
    "shuffle": f"{_SPOTS.format(salt='shuffle')}, chosen AS (SELECT *, row_number() OVER (PARTITION BY id, level ORDER BY i) AS a, row_number() OVER (PARTITION BY id, level ORDER BY md5(concat_ws('|', 'permute', id, level, i)), i) AS b FROM p WHERE r <= greatest(k, 2) AND n >= 2), "
    "moved AS (SELECT x.id AS id, x.level AS level, x.i AS i, y.i AS source FROM chosen x JOIN chosen y ON x.id = y.id AND x.level = y.level AND x.a = y.b) "
    "SELECT lv.id AS id, lv.level AS level, coalesce((SELECT string_agg(lv.w[coalesce(m.source, p.i) + 1], ' ' ORDER BY p.i) FROM p LEFT JOIN moved m ON m.id = p.id AND m.level = p.level AND m.i = p.i WHERE p.id = lv.id AND p.level = lv.level), '') AS text FROM lv",
    "replace": f"{_SPOTS.format(salt='replace')} SELECT lv.id AS id, lv.level AS level, coalesce((SELECT string_agg(CASE WHEN p.r <= p.k THEN ({_VOCABULARY})[1 + ('0x' || substr(md5(concat_ws('|', 'word', p.id, p.level, p.i)), 1, 8))::BIGINT % {len(corrupt.VOCABULARY)}] ELSE lv.w[p.i + 1] END, ' ' ORDER BY p.i) FROM p WHERE p.id = lv.id AND p.level = lv.level), '') AS text FROM lv",
}


@query(f"WITH {_WORDS}, {_KINDS_SQL['mask']}")
def text_mask(spark, sf):
    return _corrupted(spark, sf, "mask").select("id", "level", F.array_join("c", " ").alias("text"))


@query(f"WITH {_WORDS}, {_KINDS_SQL['shuffle']}")
def text_shuffle(spark, sf):
    return _corrupted(spark, sf, "shuffle").select("id", "level", F.array_join("c", " ").alias("text"))


@query(f"WITH {_WORDS}, {_KINDS_SQL['replace']}")
def text_replace(spark, sf):
    return _corrupted(spark, sf, "replace").select("id", "level", F.array_join("c", " ").alias("text"))


def _corrupted_sql(kind: str, texts: str) -> str:
    """Rows ``id, level, kind, text`` of a corruption."""
    return f"SELECT id, level, '{kind}' AS kind, text FROM (WITH {_words_sql(texts)}, {_KINDS_SQL[kind]})"


def _grams_sql(words: str) -> str:
    return f"unnest(list_transform(range(1, greatest(len({words}) - n + 1, 0) + 1), lambda i: array_to_string({words}[i : i + n - 1], chr(1)))) AS g"


def _text_damage_sql(texts: str) -> str:
    return f"""WITH corrupted AS ({" UNION ALL ".join(_corrupted_sql(k, texts) for k in ("mask", "shuffle", "replace"))}),
own AS (SELECT id, list_filter(string_split_regex(coalesce(text, ''), '{_BLANKS}'), lambda x: x <> '') AS w FROM ({texts})),
both_ AS (SELECT id, level, kind, w, list_filter(string_split(text, ' '), lambda x: x <> '') AS c FROM corrupted JOIN own USING (id)),
known AS (SELECT *, list_distinct(list_concat(w, c)) AS k FROM both_),
coded AS (SELECT *, array_to_string(list_transform(w, lambda x: chr(list_position(k, x)::INT)), '') AS cw, array_to_string(list_transform(c, lambda x: chr(list_position(k, x)::INT)), '') AS cc FROM known),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS n), hyp AS (SELECT id, level, kind, n, g, count(*) AS x FROM (SELECT id, level, kind, n, {_grams_sql("c")} FROM both_, sizes) GROUP BY ALL), ref AS (SELECT id, n, g, count(*) AS y FROM (SELECT id, n, {_grams_sql("w")} FROM own, sizes) GROUP BY ALL),
common AS (SELECT id, level, kind, {", ".join(f"coalesce(sum(least(x, y)) FILTER (WHERE n = {n}), 0) AS m{n}" for n in range(1, 5))} FROM hyp JOIN ref USING (id, n, g) GROUP BY ALL),
matched AS (SELECT id, level, kind, len(c) AS h, len(w) AS r, levenshtein(cw, cc) AS e, {", ".join(f"coalesce(m{n}, 0) AS m{n}" for n in range(1, 5))} FROM coded LEFT JOIN common USING (id, level, kind)),
scored AS (SELECT id, level, kind, CASE WHEN greatest(h, r) = 0 THEN 0 ELSE e / greatest(h, r)::DOUBLE END AS edit, CASE WHEN h = 0 AND r = 0 THEN 1 WHEN h = 0 OR m1 = 0 THEN 0 ELSE
  CASE WHEN h > r THEN 1 ELSE exp(1 - r / h::DOUBLE) END * exp(({" + ".join(f"ln(CASE WHEN m{n} = 0 THEN 0.1::DOUBLE ELSE m{n}::DOUBLE END / greatest(1, h - {n - 1}))" for n in range(1, 5))}) / 4) END AS bleu FROM matched)
SELECT id, level, kind, round(edit, 6) AS edit, round(bleu, 6) AS bleu, round(1 - round(bleu, 6), 6) AS damage_bleu FROM scored"""


def ruled_captions(rows: DataFrame, *keep: str) -> DataFrame:
    """``kind, edit, bleu`` of every text corruption of captions (``id, level, w``), beside the columns to keep."""
    kinds = F.array(*[F.lit(k) for k in TEXT])
    made = rows.select(*keep, F.posexplode(damage.corrupted_rulers("w", _key(), "level")).alias("i", "r"))
    return made.select(*keep, F.get(kinds, F.col("i")).alias("kind"), r6("r.edit", "edit"), r6("r.bleu", "bleu"))


@query(_text_damage_sql(_TEXTS))
def text_damage(spark, sf):
    """Edit distance and BLEU of every corrupted caption."""
    rows = ruled_captions(_captions(spark, sf), "id", "level")
    return rows.withColumn("damage_bleu", F.round(1 - F.col("bleu"), 6))


#: Pictures: the bytes of the benchmark's texts as red, green and blue, in squares of 8 pixels a side at least; black behind the end.
_PICTURE_IDS = "SELECT item_id AS id, text FROM benchmark"


def picture_of(text: Column) -> list[Column]:
    """``px`` (interleaved red, green and blue) and ``side`` of a text's bytes as a square picture."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    side = F.greatest(F.lit(8), F.ceil(F.sqrt(F.octet_length(data) / 3.0)).cast("int"))
    numbers = F.transform(F.sequence(F.lit(0), side * side * 3 - 1), lambda i: F.when(i < F.octet_length(data), pictures.byte_at(data, i)).otherwise(0.0))
    return [numbers.alias("px"), side.alias("side")]


def _images(spark, sf):
    rows = spread(read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")).select("id", *picture_of(F.col("text")))
    return rows.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(5))))


def _kernel_sql() -> str:
    rows = []
    for level, radius in enumerate(SEVERITY["gaussian_blur"], 1):
        reach = max(1, math.ceil(3 * radius))
        weights = [math.exp(-0.5 * (d / radius) ** 2) for d in range(-reach, reach + 1)]
        rows += [f"({level}, {d}, {w / sum(weights)!r}::DOUBLE)" for d, w in zip(range(-reach, reach + 1), weights, strict=True)]
    return f"kernel AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t(level, d, w))"


def _pixels_sql(texts: str) -> str:
    """``px``: ``id, side, i, x, y, ch, p`` of every number of every picture, and ``lvl``."""
    return f"""pic AS (SELECT id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM ({texts})), sized AS (SELECT *, greatest(8, ceil(sqrt(n / 3.0::DOUBLE))::INT) AS side FROM pic),
px AS (SELECT id, side, i, (i // 3) % side AS x, i // 3 // side AS y, i % 3 AS ch, CASE WHEN i < n THEN ('0x' || substr(h, 2 * i + 1, 2))::BIGINT::DOUBLE ELSE 0 END AS p FROM (SELECT *, unnest(range((side * side * 3)::BIGINT)) AS i FROM sized)), lvl AS (SELECT unnest([1, 2, 3, 4, 5]) AS level)"""


def _list_sql(values) -> str:
    return "[" + ", ".join(map(repr, values)) + "]"


def _pictures_sql(texts: str) -> str:
    """Common tables up to ``seen``: ``id, level, kind, ssim, psnr``."""
    number = lambda k: f"('0x' || substr(m, {1 + 8 * k}, 8))::BIGINT"
    clamp = lambda c: f"greatest(0, least(t.side - 1, t.{c} + k.d))"
    return f"""{_pixels_sql(texts)}, {_kernel_sql()},
drawn AS (SELECT id, level, i, side, x, y, ch, p, md5(concat_ws('|', 'noise', id, level, i)) AS m FROM px, lvl),
noisy AS (SELECT id, level, 'gaussian_noise' AS kind, side, x, y, ch, p, floor(greatest(0, least(255, p + ({_list_sql(SEVERITY["gaussian_noise"])})[level]::DOUBLE * (sqrt(-2 * ln(({number(0)} + 1) / 4294967296::DOUBLE)) * cos(2 * pi() * ({number(1)} / 4294967296::DOUBLE)))))) AS c FROM drawn),
area AS (SELECT id, level, side, greatest(1, floor(({_list_sql(SEVERITY["cutout"])})[level]::DOUBLE * side * side)::INT) AS area, md5(concat_ws('|', 'cutout', id, level)) AS m FROM sized, lvl),
wide AS (SELECT *, least(side, floor(sqrt(area::DOUBLE))::INT) AS bw FROM area), box AS (SELECT *, least(side, area // greatest(bw, 1)) AS bh FROM wide),
hole AS (SELECT id, level, bw, bh, {number(0)} % (side - bw + 1) AS bx, {number(1)} % (side - bh + 1) AS top FROM box),
cut AS (SELECT px.id AS id, level, 'cutout' AS kind, side, x, y, ch, p, CASE WHEN x >= bx AND x < bx + bw AND y >= top AND y < top + bh THEN 0::DOUBLE ELSE p END AS c FROM px JOIN hole ON px.id = hole.id),
down AS (SELECT t.id AS id, k.level AS level, t.side AS side, t.x AS x, t.y AS y, t.ch AS ch, any_value(t.p) AS p, sum(k.w * s.p) AS v FROM px t, kernel k, px s WHERE s.id = t.id AND s.x = t.x AND s.ch = t.ch AND s.y = {clamp("y")} GROUP BY ALL),
across AS (SELECT t.id AS id, t.level AS level, 'gaussian_blur' AS kind, t.side AS side, t.x AS x, t.y AS y, t.ch AS ch, any_value(t.p) AS p, round_even(sum(k.w * s.v), 0) AS c FROM down t, kernel k, down s WHERE k.level = t.level AND s.id = t.id AND s.level = t.level AND s.y = t.y AND s.ch = t.ch AND s.x = {clamp("x")} GROUP BY ALL),
made AS (SELECT * FROM noisy UNION ALL BY NAME SELECT * FROM cut UNION ALL BY NAME SELECT * FROM across),
far AS (SELECT id, level, kind, avg((p - c) * (p - c)) AS mse FROM made GROUP BY ALL),
spread AS (SELECT *, unnest(range(greatest(0, y - 6), least(side - 7, y) + 1)) AS wy FROM (SELECT *, unnest(range(greatest(0, x - 6), least(side - 7, x) + 1)) AS wx FROM made)),
win AS (SELECT id, level, kind, ch, wx, wy, avg(p) AS ma, avg(c) AS mb, avg(p * p) AS aa, avg(c * c) AS bb, avg(p * c) AS ab FROM spread GROUP BY ALL),
alike AS (SELECT id, level, kind, avg((2 * ma * mb + 6.5025::DOUBLE) * (2 * 49 / 48::DOUBLE * (ab - ma * mb) + 58.5225::DOUBLE) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (49 / 48::DOUBLE * (aa - ma * ma) + 49 / 48::DOUBLE * (bb - mb * mb) + 58.5225::DOUBLE))) AS ssim FROM win GROUP BY ALL),
seen AS (SELECT id, level, kind, round(ssim, 6) AS ssim, round(CASE WHEN mse <= 1e-12 THEN 60 ELSE least(60, 20 * log10(255::DOUBLE) - 10 * log10(mse)) END, 4) AS psnr, mse FROM far JOIN alike USING (id, level, kind))"""


@query(f"WITH {_pictures_sql(_PICTURE_IDS)} SELECT id, level, round(mse, 4) AS mse, psnr FROM seen WHERE kind = 'gaussian_noise'")
def image_psnr(spark, sf):
    sigma = F.get(F.array(*[F.lit(v) for v in SEVERITY["gaussian_noise"]]), F.col("level") - 1)
    rows = _images(spark, sf).withColumn("mse", damage.mean_squared_error(F.col("px"), damage.noise(F.col("px"), _key(), sigma)))
    return rows.select("id", "level", r6("mse", "mse", 4), r6(damage.psnr(F.col("mse")), "psnr", 4))


def picture_damage(rows: DataFrame) -> DataFrame:
    """``id, level, kind, ssim, psnr`` of noisy, blurred and cut pictures (``id, px, side, level``)."""
    out = None
    for kind in IMAGE:
        made = rows.withColumn("c", damage.corrupt_image(kind, F.col("px"), _key(), F.col("level"), F.col("side"), 3))
        part = made.select("id", "level", F.lit(kind).alias("kind"), r6(damage.ssim_rgb("px", "c"), "ssim"), r6(damage.psnr(damage.mean_squared_error(F.col("px"), F.col("c"))), "psnr", 4))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_pictures_sql(_PICTURE_IDS)} SELECT id, level, kind, ssim, psnr, round(1 - ssim, 6) AS damage_ssim FROM seen")
def image_damage(spark, sf):
    """SSIM and PSNR of noisy, blurred and cut RGB pictures."""
    return picture_damage(_images(spark, sf)).withColumn("damage_ssim", F.round(1 - F.col("ssim"), 6))


_CELLS = "cells AS (SELECT l_returnflag || l_linestatus || CAST(year(l_shipdate) AS VARCHAR) AS cell, CAST(l_partkey % 3 AS INT) AS seed, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), both_ AS (SELECT a.cell AS cell, a.seed AS seed_a, b.seed AS seed_b, a.v AS x, b.v AS y FROM cells a JOIN cells b ON a.cell = b.cell AND a.seed < b.seed), rk AS (SELECT *, rank() OVER (PARTITION BY seed_a, seed_b ORDER BY x) + (count(*) OVER (PARTITION BY seed_a, seed_b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY seed_a, seed_b ORDER BY y) + (count(*) OVER (PARTITION BY seed_a, seed_b, y) - 1) / 2.0::DOUBLE AS ry FROM both_), rho AS (SELECT seed_a, seed_b, count(*) AS n, corr(rx, ry) AS rho FROM rk GROUP BY 1, 2)"


def _reliability(spark, sf):
    cell = F.concat("l_returnflag", "l_linestatus", F.year("l_shipdate").cast("string"))
    cells = read(spark, sf, "lineitem").groupBy(cell.alias("cell"), (F.col("l_partkey") % 3).cast("int").alias("seed")).agg(F.avg("l_extendedprice").alias("v"))
    other = cells.select("cell", F.col("seed").alias("seed_b"), F.col("v").alias("y"))
    both = cells.select("cell", F.col("seed").alias("seed_a"), F.col("v").alias("x")).join(other, "cell").where("seed_a < seed_b")
    return statistics.spearman(both, ["seed_a", "seed_b"], "x", "y")


@query(f"WITH {_CELLS} SELECT seed_a, seed_b, n, round(rho, 6) AS rho FROM rho")
def spearman_cell_mean(spark, sf):
    return _reliability(spark, sf).withColumn("rho", F.round("rho", 6))


@query(f"WITH {_CELLS} SELECT round(min(rho), 6) AS low, round(quantile_cont(rho, 0.5), 6) AS median, round(avg(rho), 6) AS mean FROM rho")
def reliability_summary(spark, sf):
    return _reliability(spark, sf).agg(r6(F.min("rho"), "low"), r6(F.percentile("rho", F.lit(0.5)), "median"), r6(F.avg("rho"), "mean"))


_DIFFS = f"{_MEASURED}, dd AS (SELECT model, damage_image - damage_text AS d, abs(damage_image - damage_text) AS a FROM measured WHERE damage_image <> damage_text), wr AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY a) + (count(*) OVER (PARTITION BY model, a) - 1) / 2.0::DOUBLE AS r FROM dd)"


@query(f"WITH {_DIFFS} SELECT model, count(*) AS n, round(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)), 2) AS w FROM wr GROUP BY 1")
def wilcoxon_w(spark, sf):
    return statistics.wilcoxon(measured(spark, sf), ["model"], "damage_image", "damage_text").select("model", "n", r6("w", "w", 2))


@query(f"WITH {_MEASURED} SELECT model, round(avg(damage_image - damage_text) / stddev_samp(damage_image - damage_text), 6) AS d_paired, round((avg(damage_image) - avg(damage_text)) / sqrt((var_samp(damage_image) + var_samp(damage_text)) / 2), 6) AS d_independent FROM measured GROUP BY 1")
def cohens_d(spark, sf):
    rows = measured(spark, sf).withColumn("d", F.col("damage_image") - F.col("damage_text"))
    independent = statistics.cohens_d_independent(F.avg("damage_image"), F.avg("damage_text"), F.var_samp("damage_image"), F.var_samp("damage_text"))
    return rows.groupBy("model").agg(r6(statistics.cohens_d_paired("d"), "d_paired"), r6(independent, "d_independent"))


#: Seed means of both arms; ranks of their differences; the exact p-value counts sign patterns (few seeds).
_TESTS = f"""{_ARMS}, ps AS (SELECT model, quintile, seed, avg(hit) AS p1, count(*) AS n1 FROM i GROUP BY 1, 2, 3), qs AS (SELECT model, quintile, seed, avg(hit) AS p2, count(*) AS n2 FROM t GROUP BY 1, 2, 3),
sd AS (SELECT model, CAST(quintile AS VARCHAR) AS quintile, seed, p1, p2, n1, n2 FROM ps JOIN qs USING (model, quintile, seed)), al AS (SELECT * FROM sd UNION ALL SELECT 'ALL', quintile, seed, p1, p2, n1, n2 FROM sd WHERE quintile = '5'),
nz AS (SELECT *, p1 - p2 AS d, rank() OVER (PARTITION BY model, quintile ORDER BY abs(p1 - p2)) + (count(*) OVER (PARTITION BY model, quintile, abs(p1 - p2)) - 1) / 2.0::DOUBLE AS r FROM al WHERE p1 <> p2),
ws AS (SELECT model, quintile, count(*) AS m, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM nz GROUP BY 1, 2),
ex AS (SELECT model, quintile, least(1, 2 * sum(CASE WHEN s <= floor(w) THEN 1 ELSE 0 END) / pow(2, any_value(m))) AS p FROM (SELECT model, quintile, m, w, list_sum(list_transform(range(m), lambda k: CASE WHEN (x >> k) & 1 = 1 THEN k + 1 ELSE 0 END)) AS s FROM (SELECT *, unnest(range((1 << m)::BIGINT)) AS x FROM ws)) GROUP BY 1, 2),
ti AS (SELECT model, quintile, sum(t * t * t - t) AS ties FROM (SELECT model, quintile, abs(d) AS a, count(*)::DOUBLE AS t FROM nz GROUP BY ALL) GROUP BY 1, 2),
zs AS (SELECT *, least(5, abs(w - m * (m + 1) / 4.0::DOUBLE) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0::DOUBLE - ties / 48) / sqrt(2::DOUBLE)) AS z FROM ws JOIN ti USING (model, quintile)),
pp AS (SELECT model, quintile, CASE WHEN m < 2 THEN 1 WHEN ties = 0 THEN p ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 100), lambda k: pow(-1, k) * pow(z, 2 * k + 1) / gamma(k + 1) / (2 * k + 1))) END AS p FROM zs JOIN ex USING (model, quintile)),
cell AS (SELECT model, quintile, count(*) AS n_seeds, avg(p1) AS p1, avg(p2) AS p2, sum(n1)::BIGINT AS n1, sum(n2)::BIGINT AS n2, avg(p1 - p2) / nullif(stddev_samp(p1 - p2), 0) AS d FROM al GROUP BY 1, 2)"""


@query(f"WITH {_TESTS} SELECT model, quintile, n1 AS image_pairs, n2 AS text_pairs, n_seeds, round(p1, 6) AS image, round(p2, 6) AS text, round(w, 2) AS w, round(p, 6) AS p, round(d, 4) AS d_paired, "
       "round((p1 - p2) / sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / 2), 6) AS d_binary FROM cell LEFT JOIN ws USING (model, quintile) LEFT JOIN pp USING (model, quintile)")  # fmt: skip
def paired_tests_table(spark, sf):
    """Each (model, quintile), and all models at the worst quintile: tests of seed means, effect sizes of seeds and pairs."""
    at = lambda arm: F.col("arm") == arm
    side = lambda arm, k: [F.avg(F.when(at(arm), F.col("hit"))).alias(f"p{k}"), F.count_if(at(arm)).alias(f"n{k}")]
    seeds = arms(spark, sf, ("hit",)).groupBy("model", F.col("quintile").cast("string").alias("quintile"), "seed").agg(*side("damage_image", 1), *side("damage_text", 2))
    seeds = seeds.where("quintile is not null and p1 is not null and p2 is not null")
    seeds = seeds.unionByName(seeds.where("quintile = '5'").withColumn("model", F.lit("ALL"))).withColumn("d", F.col("p1") - F.col("p2"))
    cell = ["model", "quintile"]
    means = seeds.groupBy(cell).agg(
        F.sum("n1").alias("image_pairs"), F.sum("n2").alias("text_pairs"), F.count("*").alias("n_seeds"), F.avg("p1").alias("p1"), F.avg("p2").alias("p2"), statistics.cohens_d_paired("d").alias("d_paired")
    )
    tests = statistics.wilcoxon(seeds, cell, "p1", "p2").drop("n")
    return means.join(tests, cell, "left").select(
        *cell, "image_pairs", "text_pairs", "n_seeds", r6("p1", "image"), r6("p2", "text"), r6("w", "w", 2), r6("p", "p"), r6("d_paired", "d_paired", 4),
        r6(statistics.cohens_d_binary(F.col("p1"), F.col("p2")), "d_binary"),
    )


_BOOT = "v AS (SELECT CAST(item_id % 2 AS INT) AS g, CAST(item_id % 3 AS INT) AS seed, item_id AS pair_id, length(text)::DOUBLE AS value FROM benchmark)"


@query(f"WITH {_BOOT}, {bootstrap.draws_sql('v', ['g'], ['seed', 'pair_id'], 1000, 'seed')} SELECT g, boot, round(mean, 6) AS mean FROM draws")
def hierarchical_bootstrap_draws(spark, sf):
    """Two-level resamples: 1,000 means of each group."""
    rows = read(spark, sf, "benchmark").selectExpr("cast(item_id % 2 as int) as g", "cast(item_id % 3 as int) as seed", "item_id as pair_id", "cast(char_length(text) as double) as value")
    return bootstrap.hierarchical_draws(rows, ["g"], 1000).select("g", F.col("boot").cast("long").alias("boot"), r6("mean", "mean"))


_TWO_ARMS = f"{_SCORES}, v AS (SELECT model, severity = 5 AS arm, seed, pair_id, value FROM scores WHERE severity IN (1, 5))"


@query(f"WITH {_TWO_ARMS}, {bootstrap.draws_sql('v', ['model', 'arm'], ['seed', 'pair_id'], 10_000, 'seed', 'CASE WHEN arm THEN 1 ELSE 2 END')}, g AS (SELECT a.model AS model, a.mean - b.mean AS d FROM draws a JOIN draws b ON a.model = b.model AND a.boot = b.boot AND a.arm AND NOT b.arm) "
       "SELECT g.model AS model, round(any_value(a.point - b.point), 6) AS point, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi FROM g JOIN draws_points a ON a.model = g.model AND a.arm JOIN draws_points b ON b.model = g.model AND NOT b.arm GROUP BY 1")  # fmt: skip
def unpaired_bootstrap_difference(spark, sf):
    """Values at the highest against the lowest severity, by model: different pairs on both sides, 10,000 draws."""
    rows = scores(spark, sf).where("severity in (1, 5)").withColumn("arm", F.col("severity") == 5)
    return bootstrap.unpaired_difference(rows, ["model"]).select("model", r6("point", "point"), r6("lo", "lo"), r6("hi", "hi"))


@query(f"WITH {_ARMS}, v AS (SELECT model, quintile, seed, pair_id, hit AS value FROM i WHERE quintile IS NOT NULL), {bootstrap.draws_sql('v', ['model', 'quintile'], ['seed', 'pair_id'], 10_000, 'seed')} "
       "SELECT model, quintile, round(any_value(point), 6) AS point, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM draws JOIN draws_points USING (model, quintile) GROUP BY 1, 2")  # fmt: skip
def hierarchical_bootstrap_interval(spark, sf):
    """Recall-like indicator by model and damage quintile, 10,000 draws."""
    rows = binning.assign_quintile(measured(spark, sf), ["model"], "damage_image").where("quintile is not null")
    found = bootstrap.hierarchical_interval(rows.select("model", "quintile", "seed", "pair_id", F.col("hit").alias("value")), ["model", "quintile"])
    return found.select("model", "quintile", r6("point", "point"), r6("lo", "lo"), r6("hi", "hi"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) > 30) AS truncated FROM benchmark")
def truncation_count(spark, sf):
    long = F.size(corrupt.words_of(F.col("text"))) > 30
    return read(spark, sf, "benchmark").agg(F.count("*").alias("n"), F.count_if(long).alias("truncated"))


@query(f"WITH {_SCORES}, l AS (SELECT seed, severity AS layer, severity / 5.0::DOUBLE AS fraction, avg(hit) AS cosine FROM scores GROUP BY 1, 2) SELECT seed, round(coalesce(arg_min(fraction, layer) FILTER (WHERE cosine < 0.5), 0.4), 6) AS depth FROM l GROUP BY 1")
def depth_threshold_recommend(spark, sf):
    layers = scores(spark, sf).groupBy("seed", F.col("severity").alias("layer")).agg(F.avg("hit").alias("cosine")).withColumn("fraction", F.col("layer") / 5.0)
    under = F.col("cosine") < 0.5
    return layers.groupBy("seed").agg(r6(F.coalesce(F.min_by(F.when(under, F.col("fraction")), F.when(under, F.col("layer"))), F.lit(0.4)), "depth"))

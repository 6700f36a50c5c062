"""The measurement runs as long rows: corrupt, score, and emit one row of the measurement table for each metric.

Embeddings are an input: a vector and its match are a pair; a corruption of a vector is zeroed
numbers, more of them at higher severities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IMAGE, PAIRS_MAIN, SEEDS, TEXT
from ..functions import corrupt, vectors
from ..operators import statistics
from ..schema import MEASUREMENTS
from ..sources import manifest
from .queries import _BLANKS, _PICTURE_IDS, _TEXTS, _captions, _images, _pictures_sql, _text_damage_sql, picture_damage, query, r6, read, ruled_captions, spread

DIRECTIONS = ("i2t", "t2i")


def experiment(items: DataFrame, key: str, seeds: tuple[int, ...] = SEEDS, n: int = PAIRS_MAIN, depths: tuple[float, ...] = (0.4, 0.8, 1.0)) -> DataFrame:
    """The pairs of every seed (``seed, rank`` and the item) with the three depths to be measured; other numbers of depths raise."""
    if len(depths) != 3:
        raise ValueError(f"three depths are needed, not {len(depths)}")
    out = None
    for seed in seeds:
        rows = manifest.seeded_slice(items, key, seed, n).withColumn("seed", F.lit(seed))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths])))


def base_rows(rows: DataFrame, **constants: object) -> DataFrame:
    """Rows of the measurement table: columns that ``rows`` has, constants, and null for the others."""
    out = []
    for f in MEASUREMENTS.fields:
        value = F.col(f.name) if f.name in rows.columns else F.lit(constants.get(f.name))
        out.append(value.cast(f.dataType).alias(f.name))
    return rows.select(out)


def metric_rows(rows: DataFrame, metrics: list[str], **constants: object) -> DataFrame:
    """One row for each metric column."""
    keys = [c for c in rows.columns if c not in metrics]
    return base_rows(rows.unpivot(keys, metrics, "metric", "value"), **constants)


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf, "embeddings")
    side = lambda odd: rows.where(F.col("vec_id") % 2 == odd).select(F.expr("vec_id div 2").alias("id"), F.col("embedding").alias("vector"))
    return side(1), side(0)


def retrieval(images: DataFrame, texts: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``direction, pair_id, metric, value``: hit of every item among the first k of the other side, both ways."""
    out = None
    for name, queries, candidates in (("i2t", images, texts), ("t2i", texts, images)):
        ranks = vectors.better_candidates(queries.join(candidates.withColumnRenamed("vector", "own"), "id"), candidates, max(ks))
        rows = ranks.select(F.lit(name).alias("match_retention_direction"), F.col("id").alias("pair_id"), *[(F.col("better") < k).cast("double").alias(f"recall_at_{k}") for k in ks])
        out = rows if out is None else out.unionByName(rows)
    return metric_rows(out, [f"recall_at_{k}" for k in ks], spoke="retrieval_per_pair", image_severity=0, text_severity=0)


def _cut(vector: str, level: str, every: int):
    return F.transform(vector, lambda x, i: F.when((i + 1) % every < F.col(level), F.lit(0.0)).otherwise(x.cast("double")))


_BOTH = """q AS (SELECT vec_id // 2 AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 1), c AS (SELECT vec_id // 2 AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 0),
p AS (SELECT q.id AS id, q.v AS a, c.v AS b, list_cosine_similarity(q.v, c.v) AS s FROM q JOIN c USING (id)),
r AS (SELECT 'i2t' AS direction, p.id AS pair_id, count(*) FILTER (WHERE list_cosine_similarity(p.a, c.v) > p.s + 1e-12) AS better FROM p, c GROUP BY ALL UNION ALL SELECT 't2i', p.id, count(*) FILTER (WHERE list_cosine_similarity(p.b, q.v) > p.s + 1e-12) FROM p, q GROUP BY ALL),
u AS (SELECT direction, pair_id, k, CASE WHEN better < k THEN 1::DOUBLE ELSE 0::DOUBLE END AS hit FROM r, (SELECT unnest([1, 5, 10]) AS k))"""


@query(f"WITH {_BOTH} SELECT direction, pair_id, 'recall_at_' || k AS metric, hit AS value FROM u")
def retrieval_per_pair(spark, sf):
    """Hits of every pair in both directions, as measurement rows."""
    return retrieval(*_sides(spark, sf)).select(F.col("match_retention_direction").alias("direction"), "pair_id", "metric", "value")


@query(f"WITH {_BOTH} SELECT direction, 'recall_at_' || k AS metric, count(*) AS n_eval, round(avg(hit), 6) AS value FROM u GROUP BY ALL")
def clean_retrieval_baseline(spark, sf):
    """Recall of the clean items in both directions, from the rows of the pairs."""
    rows = retrieval(*_sides(spark, sf)).where("image_severity = 0 and text_severity = 0")
    return rows.groupBy(F.col("match_retention_direction").alias("direction"), "metric").agg(F.count("*").alias("n_eval"), r6(F.avg("value"), "value"))


_CENTRE = "pool AS (SELECT i, avg(v) AS m FROM (SELECT unnest(embedding)::DOUBLE / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 7 = 0) GROUP BY 1), centroid AS (SELECT list(m ORDER BY i) AS m FROM pool)"
_SWEEP = "g AS (SELECT a.vec_id AS pair_id, s AS severity, list_transform(a.embedding, lambda x, i: CASE WHEN i % 6 < s THEN 0::DOUBLE ELSE x::DOUBLE END) AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id, (SELECT unnest(range(1, 6)) AS s) WHERE a.vec_id % 7 <> 0)"


@query(f"WITH {_CENTRE}, {_SWEEP}, s AS (SELECT pair_id, severity, list_cosine_similarity(a, b) AS sim_match, list_inner_product(a, c.m) / greatest(sqrt(list_inner_product(a, a)), 1e-12) AS sim_mismatch FROM g, centroid c), "
       "w AS (SELECT pair_id, severity, round(sim_match, 6) AS sim_match, round(sim_mismatch, 6) AS sim_mismatch, round(sim_match - sim_mismatch, 6) AS margin FROM s), u AS (UNPIVOT w ON sim_match, sim_mismatch, margin INTO NAME metric VALUE value) SELECT 'match_retention' AS spoke, pair_id, severity AS image_severity, 0 AS text_severity, metric, value FROM u")  # fmt: skip
def retention_rows(spark, sf):
    """Retention of every pair at five severities of one side, three measurement rows each."""
    rows = read(spark, sf, "embeddings")
    pool = vectors.mean_vector(rows.where("vec_id % 7 = 0").select(vectors.normalise(F.col("embedding")).alias("p")), [], "p")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("b"))
    grid = rows.where("vec_id % 7 <> 0").join(other, "vec_id").withColumn("image_severity", F.explode(F.sequence(F.lit(1), F.lit(5))))
    grid = grid.select(F.col("vec_id").alias("pair_id"), "image_severity", _cut("embedding", "image_severity", 6).alias("a"), "b")
    found = vectors.retention(grid, pool, "a", "b", "p").select("pair_id", "image_severity", *[r6(c, c) for c in ("sim_match", "sim_mismatch", "margin")])
    long = metric_rows(found, ["sim_match", "sim_mismatch", "margin"], spoke="match_retention", text_severity=0)
    return long.select("spoke", "pair_id", "image_severity", "text_severity", "metric", "value")


@query("WITH p AS (SELECT a.label AS layer, list_cosine_similarity(a.embedding[1 + 16 * i : 16 * i + 16]::DOUBLE[], b.embedding[1 + 16 * i : 16 * i + 16]::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id, (SELECT unnest(range(4)) AS i)) SELECT layer, round(layer / 9.0, 6) AS fraction, count(*) AS n, round(avg(c), 6) AS mean, round(min(c), 6) AS low, round(max(c), 6) AS high FROM p GROUP BY 1")
def layer_diagnostic(spark, sf):
    """Mean, least and largest cosine of clean and corrupted states at each depth."""
    patches = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    rows = read(spark, sf, "embeddings").select("vec_id", F.col("label").alias("layer"), patches.alias("a"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").select("layer", F.explode(F.arrays_zip("a", "b")).alias("z"))
    c = vectors.cosine(F.col("z.a"), F.col("z.b"))
    rows = pairs.select("layer", c.alias("c")).groupBy("layer").agg(F.count("*").alias("n"), r6(F.avg("c"), "mean"), r6(F.min("c"), "low"), r6(F.max("c"), "high"))
    return rows.withColumn("fraction", F.round(F.col("layer") / 9.0, 6))


_TOKENS = "CAST((vec_id * (i + 3) + label * i) % 5 AS INT)"
_STATE = f"st AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(range(4), lambda i: {_TOKENS}) AS t FROM embeddings), pk AS (SELECT vec_id, 'argmax' AS pool, e[16 * list_position(t, list_max(t)) - 15 : 16 * list_position(t, list_max(t))] AS v FROM st UNION ALL SELECT vec_id, 'first', e[1:16] FROM st)"


@query(f"WITH {_STATE} SELECT a.pool AS pool, count(*) AS n, round(avg(list_cosine_similarity(a.v, b.embedding[1:16]::DOUBLE[])), 6) AS sim_match FROM pk a JOIN embeddings b ON a.vec_id + 1 = b.vec_id GROUP BY 1")
def pooling_probe(spark, sf):
    """Cosine with the match under alternative poolings of the same states."""
    from .reports import states

    made = F.array(*[F.struct(F.lit(k).alias("pool"), vectors.pooled(F.col("states"), F.col("tokens"), k).alias("v")) for k in ("argmax", "first")])
    other = read(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.slice("embedding", 1, 16).alias("b"))
    rows = states(spark, sf).select("vec_id", F.explode(made).alias("x")).select("vec_id", "x.*").join(other, "vec_id")
    return rows.groupBy("pool").agg(F.count("*").alias("n"), r6(F.avg(vectors.cosine(F.col("v"), F.col("b"))), "sim_match"))


def input_damage(captions: DataFrame, pictures: DataFrame, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """The damage table: ``seed, id, modality, corruption_type, severity``, the rulers of that side, and 1 minus similarity beside them.

    ``captions`` (``id, level, w``) and ``pictures`` (``id, level, px, side``) are corrupted anew for every seed.
    """
    seeded = lambda df: df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumns({"own": F.col("id"), "id": F.concat_ws("|", "seed", "id")})
    none = F.lit(None).cast("double")
    rows = ruled_captions(seeded(captions), "seed", "own", "level")
    rows = rows.select("seed", F.col("own").alias("id"), F.lit("text").alias("modality"), F.col("kind").alias("corruption_type"), F.col("level").alias("severity"), none.alias("ssim"), none.alias("psnr"), F.col("edit").alias("norm_edit_distance"), "bleu")
    seen = picture_damage(seeded(pictures)).withColumn("at", F.split("id", r"\|"))
    images = seen.select(
        F.get("at", F.lit(0)).cast("int").alias("seed"), F.get("at", F.lit(1)).cast("long").alias("id"), F.lit("image").alias("modality"), F.col("kind").alias("corruption_type"), F.col("level").alias("severity"),
        "ssim", "psnr", none.alias("norm_edit_distance"), none.alias("bleu"),
    )
    return rows.unionByName(images).withColumns({"damage_ssim": F.round(1 - F.col("ssim"), 6), "damage_bleu": F.round(1 - F.col("bleu"), 6)})


_SEEDED = lambda texts: " UNION ALL ".join(f"SELECT '{s}|' || id AS id, text FROM ({texts})" for s in SEEDS)
_OWN = "split_part(id, '|', 1)::INT AS seed, split_part(id, '|', 2)::BIGINT AS id"


@query(f"SELECT {_OWN}, 'text' AS modality, kind AS corruption_type, level AS severity, NULL::DOUBLE AS ssim, NULL::DOUBLE AS psnr, edit AS norm_edit_distance, bleu, NULL::DOUBLE AS damage_ssim, damage_bleu FROM ({_text_damage_sql(_SEEDED(_TEXTS))}) "
       f"UNION ALL SELECT {_OWN}, 'image', kind, level, ssim, psnr, NULL, NULL, round(1 - ssim, 6), NULL FROM (WITH {_pictures_sql(_SEEDED(_PICTURE_IDS))} SELECT * FROM seen)")  # fmt: skip
def damage_builder(spark, sf):
    """All six corruptions of every caption and picture at five severities, for every seed."""
    return input_damage(_captions(spark, sf), _images(spark, sf))


_SLICES = " UNION ALL ".join(f"SELECT doc_id, {s} AS seed, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '{s}', doc_id)), doc_id) - 1 AS rank FROM documents) WHERE rank < 50" for s in SEEDS)


@query(f"SELECT doc_id, seed, rank, depth FROM ({_SLICES}), (SELECT unnest([0.4, 0.8, 1.0])::DOUBLE AS depth)")
def experiment_plan(spark, sf):
    """The pairs of all seeds and depths: one table instead of a run for each."""
    return experiment(read(spark, sf, "documents").select("doc_id"), "doc_id", n=50).select("doc_id", "seed", "rank", "depth")


@query(f"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '{_BLANKS}'), lambda x: x <> '')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def words_of_documents(spark, sf):
    """Words between blanks of any kind."""
    return read(spark, sf, "documents").where("text is not null").select("doc_id", F.size(corrupt.words_of(F.col("text"))).cast("long").alias("n"))


#: Both sides as queries under the three corruptions of their side at five severities, against the clean vectors of the other side.
_STACKED = f"""side AS (SELECT CASE WHEN vec_id % 2 = 1 THEN 'i2t' ELSE 't2i' END AS direction, vec_id // 2 AS id, embedding::DOUBLE[] AS v FROM embeddings),
pr AS (SELECT a.direction AS direction, a.id AS id, a.v AS v, b.v AS own FROM side a JOIN side b ON a.id = b.id AND a.direction <> b.direction),
el AS (SELECT direction, id, severity, i, v[i + 1] AS x, v, len(v) AS n FROM (SELECT *, unnest(range(len(v))) AS i FROM pr), (SELECT unnest(range(1, 6)) AS severity)),
noise AS (SELECT direction, id, severity, 'gaussian_noise' AS corruption, i, x + ([8, 16, 24, 40, 64])[severity]::DOUBLE / 64 * (sqrt(-2 * ln((('0x' || substr(m, 1, 8))::BIGINT + 1) / 4294967296::DOUBLE)) * cos(2 * pi() * (('0x' || substr(m, 9, 8))::BIGINT / 4294967296::DOUBLE))) AS x FROM (SELECT *, md5(concat_ws('|', 'noise', id, severity, i)) AS m FROM el) WHERE direction = 'i2t'),
blur AS (SELECT direction, id, severity, 'gaussian_blur' AS corruption, i, list_sum(list_transform(range(-r, r + 1), lambda d: v[greatest(0, least(n - 1, i + d)) + 1])) / (2 * r + 1) AS x FROM (SELECT *, ([1, 1, 2, 4, 5])[severity] AS r FROM el) WHERE direction = 'i2t'),
cut AS (SELECT direction, id, severity, 'cutout' AS corruption, i, CASE WHEN i >= spot AND i < spot + wide THEN 0::DOUBLE ELSE x END AS x FROM (SELECT *, ('0x' || substr(md5(concat_ws('|', 'cutout', id, severity)), 1, 8))::BIGINT % (n - wide + 1) AS spot FROM (SELECT *, greatest(1, floor(([0.05, 0.10, 0.20, 0.35, 0.50])[severity]::DOUBLE * n)::INT) AS wide FROM el)) WHERE direction = 'i2t'),
te AS (SELECT *, greatest(1, least(n, round_even(([0.1, 0.2, 0.4, 0.6, 0.8])[severity]::DOUBLE * n, 0))) AS k FROM el WHERE direction = 't2i'),
tr AS (SELECT *, {", ".join(f"row_number() OVER (PARTITION BY id, severity ORDER BY md5(concat_ws('|', '{s}', id, severity, i)), i) AS r_{s}" for s in ("mask", "shuffle", "replace"))} FROM te),
mask AS (SELECT direction, id, severity, 'mask' AS corruption, i, CASE WHEN r_mask <= k THEN 0::DOUBLE ELSE x END AS x FROM tr),
swapped AS (SELECT id, severity, i, x, row_number() OVER (PARTITION BY id, severity ORDER BY i) AS a, row_number() OVER (PARTITION BY id, severity ORDER BY md5(concat_ws('|', 'permute', id, severity, i)), i) AS b FROM tr WHERE r_shuffle <= greatest(k, 2)),
shuffled AS (SELECT t.direction AS direction, t.id AS id, t.severity AS severity, 'shuffle' AS corruption, t.i AS i, coalesce(m.x, t.x) AS x FROM tr t LEFT JOIN (SELECT a.id AS id, a.severity AS severity, a.i AS i, b.x AS x FROM swapped a JOIN swapped b ON a.id = b.id AND a.severity = b.severity AND a.a = b.b) m ON m.id = t.id AND m.severity = t.severity AND m.i = t.i),
replaced AS (SELECT direction, id, severity, 'replace' AS corruption, i, CASE WHEN r_replace <= k THEN ('0x' || substr(md5(concat_ws('|', 'word', id, severity, i)), 1, 8))::BIGINT / 2147483648::DOUBLE - 1 ELSE x END AS x FROM tr),
changed AS ({" UNION ALL ".join(f"SELECT * FROM {t}" for t in ("noise", "blur", "cut", "mask", "shuffled", "replaced"))}),
q AS (SELECT direction, id, severity, corruption, list(x ORDER BY i) AS v FROM changed GROUP BY ALL),
qq AS (SELECT q.*, pr.own AS own, list_cosine_similarity(q.v, pr.own) AS s FROM q JOIN pr USING (direction, id))"""


def _stacked(spark, sf) -> DataFrame:
    """``direction, id, severity, corruption, vector, own``: both sides as queries, all versions in one table."""
    images, texts = (x.withColumn("vector", F.transform("vector", lambda v: v.cast("double"))) for x in _sides(spark, sf))
    out = None
    for name, queries, other, kinds in (("i2t", images, texts, IMAGE), ("t2i", texts, images, TEXT)):
        rows = vectors.stacked(spread(queries, "id").join(other.withColumnRenamed("vector", "own"), "id"), kinds).withColumn("direction", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {_STACKED}, r AS (SELECT qq.direction AS direction, corruption, severity, qq.id AS id, count(*) FILTER (WHERE list_cosine_similarity(qq.v, c.v) > qq.s + 1e-12) AS better FROM qq JOIN side c ON c.direction <> qq.direction GROUP BY ALL) "
       "SELECT direction, corruption, severity, id AS pair_id, 'recall_at_' || k AS metric, CASE WHEN better < k THEN 1::DOUBLE ELSE 0::DOUBLE END AS value FROM r, (SELECT unnest([1, 5, 10]) AS k)")  # fmt: skip
def retrieval_conditions(spark, sf):
    """Hits of every pair under six corruptions at five severities, each side against the clean other one; all versions of a side in one pass."""
    images, texts = _sides(spark, sf)
    rows, out = _stacked(spark, sf), None
    for name, candidates in (("i2t", texts), ("t2i", images)):
        found = vectors.better_candidates(rows.where(F.col("direction") == name), candidates.select(F.transform("vector", lambda v: v.cast("double")).alias("vector")), 10, dealt=True)
        out = found if out is None else out.unionByName(found)
    hit = lambda k: (F.col("better") < k).cast("double").alias(f"recall_at_{k}")
    wide = out.select("direction", "corruption", "severity", F.col("id").alias("pair_id"), *[hit(k) for k in (1, 5, 10)])
    return wide.unpivot(["direction", "corruption", "severity", "pair_id"], [f"recall_at_{k}" for k in (1, 5, 10)], "metric", "value")


@query(f"WITH {_STACKED}, centre AS (SELECT direction, list(m ORDER BY i) AS m FROM (SELECT direction, i, avg(x) AS m FROM (SELECT direction, unnest(v) / greatest(sqrt(list_inner_product(v, v)), 1e-12) AS x, generate_subscripts(v, 1) AS i FROM side) GROUP BY ALL) GROUP BY 1), "
       "m AS (SELECT qq.direction AS direction, corruption, severity, id AS pair_id, s AS sim_match, list_inner_product(v, c.m) / greatest(sqrt(list_inner_product(v, v)), 1e-12) AS sim_mismatch FROM qq JOIN centre c ON c.direction <> qq.direction), "
       "w AS (SELECT direction, corruption, severity, pair_id, round(sim_match, 6) AS sim_match, round(sim_mismatch, 6) AS sim_mismatch, round(sim_match - sim_mismatch, 6) AS margin FROM m) UNPIVOT w ON sim_match, sim_mismatch, margin INTO NAME metric VALUE value")  # fmt: skip
def retention_conditions(spark, sf):
    """Match retention of every pair under the same conditions: cosine with the match, mean cosine with the other side, and the margin."""
    rows, out = _stacked(spark, sf), None
    images, texts = _sides(spark, sf)
    for name, other in (("i2t", texts), ("t2i", images)):
        pool = vectors.mean_vector(other.select(vectors.normalise(F.col("vector")).alias("p")), [], "p")
        found = vectors.retention(rows.where(F.col("direction") == name), pool, "vector", "own", "p")
        out = found if out is None else out.unionByName(found)
    metrics = ["sim_match", "sim_mismatch", "margin"]
    wide = out.select("direction", "corruption", "severity", F.col("id").alias("pair_id"), *[r6(c, c) for c in metrics])
    return wide.unpivot(["direction", "corruption", "severity", "pair_id"], metrics, "metric", "value")


_SCORED = "t AS (SELECT CAST(l_suppkey % 3 AS INT) AS seed, l_returnflag AS model, CAST(l_linenumber AS INT) AS severity, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL), j AS (SELECT a.seed AS seed_a, b.seed AS seed_b, a.v AS x, b.v AS y FROM t a JOIN t b ON a.model = b.model AND a.severity = b.severity AND a.seed < b.seed)"
_RANKED = "k AS (SELECT *, " + ", ".join(f"rank() OVER (PARTITION BY seed_a, seed_b ORDER BY {c}) + (count(*) OVER (PARTITION BY seed_a, seed_b, {c}) - 1) / 2.0::DOUBLE AS r{c}" for c in "xy") + " FROM j), r AS (SELECT seed_a, seed_b, count(*) AS n, corr(rx, ry) AS rho FROM k GROUP BY ALL)"
#: The p-value is the t distribution's tail: Simpson's rule over the angle, 2,000 steps.
_TAIL = "u AS (SELECT *, atan(abs(rho) * sqrt((n - 2) / nullif(1 - rho * rho, 0)) / sqrt((n - 2)::DOUBLE)) AS top FROM r), p AS (SELECT seed_a, seed_b, n, rho, 1 - (top / 2000 / 3) * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(top * i / 2000), n - 3))) / (0.5 * exp(lgamma(0.5) + lgamma((n - 2) / 2.0::DOUBLE) - lgamma((n - 1) / 2.0::DOUBLE))) AS p FROM u)"


@query(f"WITH {_SCORED}, {_RANKED}, {_TAIL} SELECT seed_a, seed_b, n AS n_cells, round(rho, 6) AS rho, round(CASE WHEN n < 3 THEN NULL ELSE p END, 6) AS p FROM p")
def reliability_with_p(spark, sf):
    """Rank correlation of the cell means of every two seeds, with its two-sided p-value."""
    cells = read(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 3).cast("int").alias("seed"), F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("severity")).agg(F.avg("l_extendedprice").alias("value"))
    rho = statistics.seed_pairs_spearman(cells, [], ["model", "severity"])
    return rho.select("seed_a", "seed_b", F.col("n").alias("n_cells"), r6("rho", "rho"), r6(statistics.p_of_rho(F.col("rho"), F.col("n")), "p"))

"""Planted effects, closed forms and limits of the robustness operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frayline import config
from frayline.functions import corrupt, damage, vectors
from frayline.operators import binning, bootstrap, statistics
from frayline.schema import MEASUREMENTS, require_columns, typed
from frayline.sources import manifest, sinks


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_schema_has_eighteen_columns_and_reads_leniently(spark):
    assert len(MEASUREMENTS.fields) == 18
    raw = spark.createDataFrame([("a", "", "x", "nan"), ("b", "3", "", "0.5")], "model string, seed string, pair_id string, value string")
    got = [(r.model, r.seed, r.pair_id, r.value, r.notes) for r in typed(raw).collect()]
    assert got == [("a", None, None, None, None), ("b", 3, None, 0.5, None)]
    with pytest.raises(KeyError):
        require_columns(raw, ["nothing"])


def test_severities_grow_and_reject():
    assert all(list(v) == sorted(v) for v in config.SEVERITY.values())
    with pytest.raises(ValueError):
        config.severity("mask", 0)
    with pytest.raises(KeyError):
        config.severity("none such", 1)


def test_bins_on_tied_edges(spark):
    x = np.concatenate([np.zeros(50), np.linspace(0.01, 1, 50)])
    got = {r.quintile: r["count"] for r in binning.assign_quintile(frame(spark, x=x), [], "x").groupBy("quintile").count().collect()}
    assert got == {1: 60, 2: 20, 3: 20}
    flat = binning.assign_quintile(frame(spark, x=[0.5] * 10), [], "x")
    assert flat.where("quintile is not null").count() == 0
    u = np.random.default_rng(0).random(1000)
    got = binning.assign_quintile(frame(spark, x=u), [], "x").groupBy("quintile").count().collect()
    assert len(got) == 5 and all(180 <= r["count"] <= 220 for r in got)


def test_percentile_rank_equals_pandas(spark):
    x = np.random.default_rng(1).integers(0, 20, 300).astype(float)
    pdf = pd.DataFrame({"i": range(300), "g": [i % 3 for i in range(300)], "x": x})
    got = binning.percentile_rank(spark.createDataFrame(pdf), ["g"], "x", "p").toPandas().sort_values("i")
    assert np.allclose(got["p"], pdf.groupby("g")["x"].rank(pct=True))


def test_wilcoxon(spark):
    a = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    got = statistics.wilcoxon(frame(spark, g=["g"] * 6, a=a, b=[0.5, 2.5, 1.0, 4.0, 2.0, 1.0]), ["g"], "a", "b").first()
    assert (got.n, got.w) == (5, 1.5)
    assert statistics.wilcoxon_p(0, 3) == 0.25
    assert statistics.wilcoxon_p(0, 15) == pytest.approx(6.103515625e-05)
    assert statistics.wilcoxon_p(0, 0) == 1.0


def test_effect_sizes_and_correlations(spark):
    d = lambda p, q: spark.range(1).select(statistics.cohens_d_binary(F.lit(p), F.lit(q)).alias("d")).first().d
    assert d(0.5, 0.5) == 0.0 and d(1.0, 0.0) is None
    assert d(0.8, 0.2) == pytest.approx(0.6 / 0.4)
    same = frame(spark, g=["a"] * 5, d=[0.25] * 5).groupBy("g").agg(statistics.cohens_d_paired("d").alias("d")).first()
    assert same.d is None
    x = np.arange(50.0)
    assert statistics.spearman(frame(spark, g=["a"] * 50, x=x, y=x**3), ["g"], "x", "y").first().rho == pytest.approx(1)
    assert statistics.spearman(frame(spark, g=["a"] * 2, x=[1.0, 2.0], y=[1.0, 2.0]), ["g"], "x", "y").first().rho is None
    assert statistics.spearman_p(0.5, 20) == pytest.approx(0.02483, abs=2e-4)
    assert statistics.spearman_p(1.0, 20) == 0 and math.isnan(statistics.spearman_p(0.2, 2))


def test_bootstrap(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": "a", "seed": np.repeat([0, 1, 2], 50), "pair_id": np.tile(range(50), 3), "value": rng.normal(0.5, 0.1, 150)})
    got = [bootstrap.hierarchical_interval(spark.createDataFrame(pdf), ["g"], 2000).first() for _ in range(2)]
    assert got[0] == got[1] and got[0].point == pytest.approx(pdf["value"].mean())
    assert got[0].lo < got[0].point < got[0].hi and got[0].hi - got[0].lo < 0.1
    draws = bootstrap.hierarchical_draws(spark.createDataFrame(pdf), ["g"], 200)
    ci = bootstrap.percentile_interval(draws, ["g"]).first()
    assert abs(ci.lo - got[0].lo) < 0.02 and abs(ci.hi - got[0].hi) < 0.02
    assert bootstrap.hierarchical_interval(spark.createDataFrame(pdf).limit(0), ["g"]).count() == 0


CAPTIONS = ["a man rides a red horse along the quiet sandy beach today", "two words", "one", ""]


def test_corruptions(spark):
    rows = frame(spark, id=range(4), text=CAPTIONS).withColumn("w", corrupt.words_of(F.col("text")))
    key = F.col("id").cast("string")
    for kind in config.TEXT:
        for level in (0, 1, 5):
            got = rows.select("w", corrupt.corrupt_text(kind, F.col("w"), key, level).alias("c")).collect()
            assert got == rows.select("w", corrupt.corrupt_text(kind, F.col("w"), key, level).alias("c")).collect()
            for r in got:
                k = 0 if not level or not r.w else max(1, min(len(r.w), round(config.severity(kind, level) * len(r.w))))
                if kind == "mask":
                    assert len(r.c) == len(r.w) - k
                elif kind == "shuffle":
                    assert sorted(r.c) == sorted(r.w)
                else:
                    assert len(r.c) == len(r.w) and sum(x != y for x, y in zip(r.w, r.c, strict=True)) == k
    with pytest.raises(KeyError):
        corrupt.corrupt_text("blank", F.col("w"), key, 1)


def test_rulers(spark):
    rng = np.random.default_rng(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    pairs = [([str(x) for x in rng.integers(0, 5, n)], [str(x) for x in rng.integers(0, 5, m)]) for n in range(7) for m in range(7)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in df.select("a", "b", damage.token_edit_distance(F.col("a"), F.col("b")).alias("d"), damage.bleu4(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.d == distance(r.a, r.b)
        assert 0 <= r.s <= 1 and (r.a != r.b or len(r.a) not in (0, 4, 5, 6) or r.s == pytest.approx(1))
        assert set(r.a) & set(r.b) or not (r.a or r.b) or r.s == 0
    image = rng.integers(0, 256, (16, 16)).astype(float)
    stack = image[None]
    assert damage.ssim_of(stack, stack)[0] == pytest.approx(1)
    assert -1 <= damage.ssim_of(stack, rng.integers(0, 256, (1, 16, 16)).astype(float))[0] < 0.3
    assert damage.ssim_of(stack, damage.blur_of(stack, 2.0))[0] < 0.9
    one = spark.range(1).select(damage.psnr(F.lit(0.0)).alias("same"), damage.psnr(F.lit(65025.0)).alias("far")).first()
    assert one.same == 60 and one.far == pytest.approx(0)
    with pytest.raises(ValueError):
        damage.ssim_of(stack, stack[:, :6, :6])


def test_vectors(spark):
    v = frame(spark, a=[[1.0, 0.0], [0.0, 0.0], [1.0, 1.0]], b=[[2.0, 0.0], [1.0, 1.0], [1.0, -1.0]])
    assert np.allclose([r.c for r in v.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()], [1, 0, 0])
    q = frame(spark, id=[0, 1], vector=[[1.0, 0.1], [0.0, 1.0]], own=[[1.0, 0.0], [1.0, 0.0]])
    c = frame(spark, vector=[[1.0, 0.0], [0.0, 2.0], [1.0, 1.0]])
    assert {r.id: r.better for r in vectors.better_candidates(q, c).collect()} == {0: 0, 1: 2}
    assert vectors.better_candidates(q, c.limit(0)).agg(F.sum("better")).first()[0] == 0


def test_sources(spark, tmp_path):
    items = frame(spark, id=range(30), caption=["same"] * 3 + [str(i) for i in range(27)])
    kept = manifest.dedup_by_content(items, F.col("caption"), "id")
    assert kept.count() == 28 and kept.where("caption = 'same'").first().id == 0
    one, again, other = (manifest.seeded_slice(items, "id", s, 10).orderBy("rank").collect() for s in (1, 1, 2))
    assert one == again and [r.id for r in one] != [r.id for r in other]
    pool = manifest.disjoint_pool(items, "id", manifest.seeded_slice(items, "id", 1, 10), 3, 8)
    assert pool.count() == 8 and not {r.id for r in pool.collect()} & {r.id for r in one}
    with pytest.raises(RuntimeError):
        manifest.require_rows(items, 31)
    manifest.assert_no_duplicate_ids(items, "id")
    with pytest.raises(ValueError):
        manifest.assert_no_duplicate_ids(items, "caption")
    assert manifest.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "m.json").write_text('[{"id": 1, "caption": "c", "bytes_hex": "6869", "sha256": "x"}]')
    assert bytes(manifest.read_manifest(spark, str(tmp_path / "m.json")).first().bytes) == b"hi"
    rows = typed(spark.createDataFrame([("s", "m", "0", "0.12345678")], "spoke string, model string, seed string, value string"))
    for _ in range(2):
        sinks.append_measurements(rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 2 and back.first().value == 0.123457
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert typed(manifest.read_csv(spark, [str(tmp_path / "csv")], MEASUREMENTS, [4])).first().seed == 4
    assert "0.123" in sinks.latex_rows(rows, ["model", "value"], ["model"])


def test_streamed_appends(spark, tmp_path):
    from frayline.streaming.append import append_stream

    rows = typed(spark.createDataFrame([("s", "m", "0", "0.5")], "spoke string, model string, seed string, value string"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(MEASUREMENTS).parquet(str(tmp_path / "in"))
    for _ in range(2):
        append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_multi_positive_recall_takes_best_positive_and_keeps_misses(spark):
    v = {0: [1.0, 0.0], 1: [0.0, 1.0], 2: [-1.0, 0.0], 3: [0.9, 0.1]}
    candidates = spark.createDataFrame(list(v.items()), "candidate long, vector array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.05]), (8, [0.0, 1.0]), (9, [1.0, 0.0])], "id long, vector array<double>")
    positives = spark.createDataFrame([(7, 2), (7, 3), (8, 1), (8, 1), (8, 99)], "id long, candidate long")
    got = {r.id: r.better for r in vectors.multi_positive_ranks(queries, positives, candidates).collect()}
    assert got == {7: 1, 8: 0, 9: None}


def test_patch_fidelity_by_place(spark):
    rows = [("a", [[1.0, 0.0], [0.0, 2.0]], [[3.0, 0.0], [1.0, 0.0]]), ("b", [[1.0, 1.0]], []), ("c", [[1.0], [1.0]], [[2.0]])]
    df = spark.createDataFrame(rows, "depth string, clean array<array<double>>, changed array<array<double>>")
    got = {r.depth: (r.fidelity, r.patches) for r in vectors.patch_fidelity(df, ["depth"], "clean", "changed").collect()}
    assert got == {"a": (0.5, 2), "b": (None, 0), "c": (1.0, 1)}


def test_unpaired_difference_recovers_planted_gap_of_unequal_arms(spark):
    rng = np.random.default_rng(1)
    make = lambda n, mean, arm: pd.DataFrame({"g": 0, "arm": arm, "seed": np.repeat([0, 1, 2], n), "value": rng.normal(mean, 0.1, 3 * n)})
    values = pd.concat([make(40, 0.5, False), make(60, 0.7, True), make(5, 0.2, True).assign(g=1)])
    got = {r.g: r for r in bootstrap.unpaired_difference(spark.createDataFrame(values), ["g"], n_boot=1000).collect()}
    assert got[0].lo < 0.2 < got[0].hi and got[0].hi - got[0].lo < 0.15
    assert (got[1].point, got[1].lo, got[1].hi) == (None, None, None)


def test_ranks_of_values_that_differ_when_worked_out_again(spark):
    """Means of doubles may end in other bits each time; ranks must not be lost to that."""
    import random

    from pyspark.sql import functions as F

    from frayline.operators import statistics

    jitter = F.udf(lambda x: x * (1 + random.SystemRandom().random() * 1e-12), "double").asNondeterministic()
    rows = spark.range(30).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    rows = rows.select("g", jitter("v").alias("x"), jitter(F.col("v") * 3 + 1).alias("y"))
    found = statistics.spearman(rows, ["g"], "x", "y").collect()
    assert [(r["n"], round(r["rho"], 9)) for r in found] == [(15, 1.0), (15, 1.0)]
    found = statistics.wilcoxon(rows, ["g"], "y", "x").collect()
    assert [(r["n"], r["w"]) for r in found] == [(15, 0.0), (15, 0.0)]

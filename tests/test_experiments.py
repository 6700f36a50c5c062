"""Checked inputs, exact rulers, tests and bootstraps of the experiments, against plain Python."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frayline.functions import corrupt, damage, vectors
from frayline.operators import binning, bootstrap, statistics
from frayline.plans import experiment, run
from frayline.schema import typed
from frayline.sources import manifest, sinks, views


def words(rng, n):
    return [rng.choice("abcdefg") for _ in range(n)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def bleu(h, r):
    if not h and not r:
        return 1.0
    logs = 0.0
    for n in range(1, 5):
        grams = lambda x: [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]  # noqa: B023, E731
        m = sum(min(grams(h).count(g), grams(r).count(g)) for g in set(grams(h)))
        if n == 1 and not m:
            return 0.0
        logs += math.log((m or 0.1) / max(1, len(h) - n + 1)) / 4
    return (1.0 if len(h) > len(r) else math.exp(1 - len(r) / len(h))) * math.exp(logs)


def test_text_rulers_equal_plain_python(spark):
    rng = random.Random(4)
    rows = [(words(rng, rng.randrange(0, 30)), words(rng, rng.randrange(0, 30))) for _ in range(120)]
    rows += [(x, list(x)) for x, _ in rows[:10]] + [(["a"], ["z"]), ([], ["a"]), (["a"], []), ([], [])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select("a", "b", damage.token_edit_distance(F.col("a"), F.col("b")).alias("e"), damage.bleu4(F.col("a"), F.col("b")).alias("s"), damage.text_rulers("b", "a").alias("r")).collect()
    for r in got:
        assert math.isclose(r.r.edit * max(1, len(r.a), len(r.b)), r.e, abs_tol=1e-9) and math.isclose(r.r.bleu, r.s, abs_tol=1e-9), r
        assert r.e == levenshtein(r.a, r.b) and math.isclose(r.s, bleu(r.a, r.b), abs_tol=1e-9), r


def ssim(a, b):
    out = []
    for y in range(len(a) - 6):
        for x in range(len(a) - 6):
            p, q = a[y : y + 7, x : x + 7].ravel(), b[y : y + 7, x : x + 7].ravel()
            c = np.cov(p, q)
            c1, c2 = 2.55**2, 7.65**2
            out.append((2 * p.mean() * q.mean() + c1) * (2 * c[0, 1] + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (c[0, 0] + c[1, 1] + c2)))
    return np.mean(out)


def test_image_rulers_equal_plain_loops(spark):
    rng = np.random.default_rng(2)
    images = rng.integers(0, 256, (6, 12, 12, 3)).astype(float)
    noisy = np.clip(images + rng.normal(0, 20, images.shape), 0, 255)
    rows = [(i, images[i].ravel().tolist(), noisy[i].ravel().tolist(), images[i, :, :, 0].ravel().tolist(), noisy[i, :, :, 0].ravel().tolist()) for i in range(6)]
    rows.append((6, rows[0][1][:300], rows[0][1][:300], rows[0][3][:64], rows[0][3][:64]))
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>, c array<double>, d array<double>")
    got = df.select("i", damage.ssim_rgb("a", "b").alias("rgb"), damage.ssim("c", "d").alias("grey"), damage.gaussian_blur("c", F.lit(1.5)).alias("blurred")).orderBy("i").collect()
    for r in got[:6]:
        assert math.isclose(r.rgb, np.mean([ssim(images[r.i, :, :, c], noisy[r.i, :, :, c]) for c in range(3)]), abs_tol=1e-9)
        assert math.isclose(r.grey, ssim(images[r.i, :, :, 0], noisy[r.i, :, :, 0]), abs_tol=1e-9)
    assert got[6].rgb == got[6].grey == 1.0
    image, kernel = images[0, :, :, 0], np.exp(-0.5 * (np.arange(-5, 6) / 1.5) ** 2)
    kernel /= kernel.sum()
    at = lambda m, y, x: m[min(max(y, 0), 11), min(max(x, 0), 11)]
    rows_done = np.array([[sum(kernel[k + 5] * at(image, y + k, x) for k in range(-5, 6)) for x in range(12)] for y in range(12)])
    both = [[sum(kernel[k + 5] * at(rows_done, y, x + k) for k in range(-5, 6)) for x in range(12)] for y in range(12)]
    assert np.abs(np.reshape(got[0].blurred, (12, 12)) - np.rint(both)).max() <= 1
    with pytest.raises(ValueError, match="one shape"):
        damage.ssim_of(np.zeros((1, 5, 5)), np.zeros((1, 5, 5)))


def test_cutout_blackens_one_rectangle_of_the_wanted_size(spark):
    rows = [(i, [9.0] * 256) for i in range(20)]
    for share in (0.05, 0.2, 0.5):
        made = spark.createDataFrame(rows, "i int, p array<double>").select(damage.cutout(F.col("p"), F.col("i").cast("string"), 16, F.lit(share)).alias("c")).collect()
        for r in made:
            gone = np.argwhere(np.reshape(r.c, (16, 16)) == 0)
            h, w = gone.max(axis=0) - gone.min(axis=0) + 1
            assert len(gone) == h * w and abs(h * w - share * 256) <= 16 and abs(h - w) <= max(3, share * 16)


def test_words_split_at_blanks_beyond_ascii(spark):
    (row,) = spark.createDataFrame([("a b c \x85d\x1ce",)], "t string").select(corrupt.words_of(F.col("t")).alias("w")).collect()
    assert row.w == "a b c \x85d\x1ce".split()


def test_wilcoxon_keeps_all_groups(spark):
    rows = [("exact", float(i), float(i) - d) for i, d in enumerate([1, -2, 3, 4, 5.5, -6, 7])]
    rows += [("zero", 1.0, 1.0)] * 5 + [("one", 1.0, 2.0)] + [("single", 2.0, 1.0), ("single", 2.0, 2.0)]
    rows += [("ties", float(k), 0.0) for k in (1, 1, 1, -1, 2, 2, -3)]
    got = {r.g: r for r in statistics.wilcoxon(spark.createDataFrame(rows, "g string, a double, b double"), ["g"], "a", "b").collect()}
    assert got.keys() == {"exact", "zero", "one", "single", "ties"}
    assert got["exact"].w == 8 and math.isclose(got["exact"].p, sum(sum(k + 1 for k in range(7) if x >> k & 1) <= 8 for x in range(128)) / 64)
    assert got["zero"].w is None and got["zero"].p == 1 and got["one"].p is None and got["single"].p == 1
    se = math.sqrt(7 * 8 * 15 / 24 - ((4**3 - 4) + (2**3 - 2)) / 48)
    assert math.isclose(got["ties"].p, math.erfc(abs(got["ties"].w - 14) / se / math.sqrt(2)))


def test_ranks_and_edges_of_groups_without_groups_and_with_heavy_tails(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.exponential(1, 300) ** 8, np.repeat(3.0, 50), [5.0]])
    df = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate(values)] + [(999, "flat", 2.0), (1000, "flat", 2.0), (1001, "g", None)], "i int, g string, v double")
    got = {r.i: r.rank for r in binning.percentile_rank(df, ["g"], "v", "rank").collect()}
    for i, v in enumerate(values):
        assert math.isclose(got[i], ((values < v).sum() + ((values == v).sum() + 1) / 2) / len(values))
    assert got[999] == got[1000] == 0.75 and got[1001] is None
    edges = {r.g: r.edges for r in binning.quintile_edges(df, ["g"], "v").collect()}
    assert np.allclose(edges["g"], np.quantile(values, binning.CUTS), rtol=1e-12) and edges["flat"] == [2.0] * 6
    (whole,) = binning.quintile_edges(df, [], "v").collect()
    assert np.allclose(whole.edges, np.quantile([*values, 2, 2], binning.CUTS), rtol=1e-12)
    with pytest.raises(ValueError, match="unique"):
        binning.require_distinct_edges(binning.quintile_edges(df, ["g"], "v"))


def test_paired_bootstrap_needs_equal_keys(spark):
    rows = [(s, p, float(p % 5)) for s in range(3) for p in range(10)]
    one = spark.createDataFrame(rows, "seed int, pair_id int, value double")
    (r,) = bootstrap.paired_difference(one, one.withColumn("value", F.col("value") - 0.25), [], 30).collect()
    assert math.isclose(r["diff"], 0.25) and math.isclose(r.lo, 0.25) and math.isclose(r.hi, 0.25)
    with pytest.raises(ValueError, match="same keys"):
        bootstrap.paired_difference(one, one.withColumn("pair_id", F.col("pair_id") + 100), [], 5)
    flat = {r.seed: r for r in bootstrap.flat_interval(one.where("seed = 0 or pair_id = 0"), ["seed"], ["pair_id"], 50).collect()}
    assert flat[0].lo <= flat[0].mean <= flat[0].hi and flat[1].lo is None


def test_checked_lookups(spark, tmp_path):
    scores = spark.createDataFrame([(0, 1, "mask", 1, 0.5), (0, 1, "mask", 2, 0.25)], "seed int, pair_id int, corruption string, severity int, value double")
    once = spark.createDataFrame([(0, 1, "mask", 1, 0.1), (0, 1, "blur", 1, 0.9)], "seed int, pair_id int, corruption string, severity int, damage double")
    assert [r.damage for r in views.with_damage(scores, once).collect()] == [0.1]
    with pytest.raises(Exception, match="damage keys repeat"):
        views.with_damage(scores, once.unionByName(once)).collect()
    long = spark.createDataFrame([("m", 0, 0, 0.9), ("m", 1, 0, 0.5), ("n", 5, 0, 0.1)], "model string, image_severity int, text_severity int, value double")
    assert views.require_clean(long, model="m") == 0.9
    with pytest.raises(ValueError, match="no clean baseline"):
        views.require_clean(long, model="n")
    table = spark.createDataFrame([("m", 1.0)], "model string, clean double")
    assert views.looked_up(long.where("model = 'm'"), table, ["model"], "clean").count() == 2
    with pytest.raises(Exception, match="no entry for n"):
        views.looked_up(long, table, ["model"], "clean").collect()
    with pytest.raises(Exception, match="repeated cell"):
        views.pivot_once(long.unionByName(long), "model", "image_severity", [0, 1, 5], "value").collect()
    views.save_json(table, f"{tmp_path}/j")
    assert json.loads("".join(r[0] for r in spark.read.text(f"{tmp_path}/j").collect())) == {"model": "m", "clean": 1.0}
    table.write.parquet(f"{tmp_path}/v1")
    assert views.read_first(spark, [f"{tmp_path}/v2", f"{tmp_path}/v1"]).count() == 1
    with pytest.raises(FileNotFoundError, match="v3"):
        views.require_inputs(spark, [f"{tmp_path}/v1", f"{tmp_path}/v3"])
    (tmp_path / "c.yaml").write_text("seeds: [0, 1]\npool: {k: 64}\n")
    assert views.read_config(spark, f"{tmp_path}/c.yaml") == {"seeds": [0, 1], "pool": {"k": 64}}


def test_pooling_kinds(spark):
    rows = [([[1.0], [2.0], [4.0], [8.0]], [3, 9, 9, 0]), ([[1.0], [2.0], [4.0], [8.0]], [0, 0, 0, 0])]
    df = spark.createDataFrame(rows, "s array<array<double>>, t array<int>")
    got = [df.select(vectors.pooled(F.col("s"), F.col("t"), k).alias("v")).collect() for k in ("argmax", "last", "first", "mean")]
    assert [[r.v[0] for r in x] for x in got] == [[2.0, 1.0], [4.0, 1.0], [1.0, 1.0], [7 / 3, 1.0]]
    (stopped,) = df.limit(1).select(vectors.pooled(F.col("s"), F.col("t"), "mean", end_id=9).alias("v")).collect()
    assert stopped.v == [1.5]
    with pytest.raises(ValueError, match="unknown pooling"):
        vectors.pooled(F.col("s"), F.col("t"), "max")


def test_strict_casts_and_report_text(spark):
    raw = spark.createDataFrame([("a", "x")], "model string, seed string")
    assert typed(raw).first().seed is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        typed(raw, strict=True).collect()
    table = spark.createDataFrame([("b", 0.5), ("a", 1.0)], "model string, value double")
    assert sinks.report_section("Means", table, ["model"]) == "Means\n-----\nmodel=a, value=1.0000\nmodel=b, value=0.5000"


def test_manifest_grows_to_its_target(spark):
    have = manifest.dedup_by_content(spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string"), F.col("text"), "id")
    batch = spark.createDataFrame([(3, "b"), (4, "c"), (5, "c"), (6, "d"), (7, None)], "id long, text string")
    assert sorted(r.id for r in manifest.new_items(have, batch, F.col("text"), "id").collect()) == [4, 6]
    assert [r.id for r in manifest.new_items(have, batch, F.col("text"), "id", target=3).collect()] == [4]


def test_image_corruptions_by_name(spark):
    df = spark.createDataFrame([(1, [float(i % 251) for i in range(256)])], "id int, px array<double>")
    for level, same in ((0, True), (3, False)):
        for kind in ("gaussian_noise", "gaussian_blur", "cutout"):
            (r,) = df.select("px", damage.corrupt_image(kind, F.col("px"), F.col("id").cast("string"), F.lit(level), 16).alias("c")).collect()
            assert (r.px == r.c) == same, kind
    with pytest.raises(KeyError):
        damage.corrupt_image("fog", F.col("px"), F.col("id"), F.lit(1), 16)


def test_experiments_need_three_depths_and_runs_report(spark, sf, tmp_path):
    docs = spark.range(100).withColumnRenamed("id", "doc_id")
    assert experiment.experiment(docs, "doc_id", (0, 1), 10).groupBy("seed", "depth").count().collect().__len__() == 6
    with pytest.raises(ValueError, match="three depths"):
        experiment.experiment(docs, "doc_id", depths=(0.5,))
    assert run.run(spark, sf, str(tmp_path), ["ci_format"], dry_run=True) == {"ci_format": "planned"}
    got = run.run(spark, sf, str(tmp_path), ["ci_format"])
    assert got == {"ci_format": "written"} and spark.read.parquet(f"{tmp_path}/ci_format").count() > 0
    assert run.run(spark, "/nowhere", str(tmp_path), ["ci_format"])["ci_format"].startswith("failed")
    with pytest.raises(KeyError):
        run.run(spark, sf, str(tmp_path), ["nothing"])

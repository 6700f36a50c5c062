"""Resampling, ranks, tiles, pictures, resumable cells and manifests: against plain loops, under skew, and when stopped half-way."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frayline.functions import damage, vectors
from frayline.operators import binning, bootstrap
from frayline.plans import cells, run
from frayline.sources import manifest, pictures
from frayline.streaming import manifest as growing


def resampled(spark, pdf, group, seed, n_boot):
    return bootstrap.replicates(spark.createDataFrame(pdf), group, ["value", "other"], ["seed", "pair_id"], seed, n_boot).toPandas()


def test_replicates_have_the_spread_of_a_bootstrap(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], 3000), "seed": np.tile([0, 1, 2], 2000), "pair_id": range(6000), "value": rng.normal(1, 2, 6000)})
    pdf["other"] = 10 * pdf["value"]
    for row in resampled(spark, pdf, ["g"], None, 4000).itertuples():
        own, draws = pdf[pdf.g == row.g].value, np.array(row.value_draws)
        assert row.n == 3000 and row.value == pytest.approx(own.mean()) and draws.mean() == pytest.approx(own.mean(), abs=0.005)
        assert draws.std() == pytest.approx(own.std() / 3000**0.5, rel=0.06)
        assert np.allclose(np.array(row.other_draws), 10 * draws)  # all values share the draws


def test_two_levels_carry_the_spread_of_the_seeds(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"seed": np.repeat(range(4), 500), "pair_id": range(2000)})
    pdf["value"] = pdf["seed"] + rng.normal(0, 1, 2000)
    pdf["other"] = 0.0
    (row,) = resampled(spark, pdf, [], "seed", 4000).itertuples()
    want = [pdf[pdf.seed == s].value.sample(500, replace=True, random_state=int(k)).mean() for k in range(300) for s in rng.integers(0, 4, 1)]
    assert np.std(row.value_draws) == pytest.approx(np.std(want) / 2, rel=0.15)


def test_replicates_do_not_depend_on_the_layout(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["hot"] * 9 + ["x", "y"], 3000), "seed": rng.integers(0, 3, 3000), "pair_id": range(3000), "value": rng.random(3000), "other": 1.0})
    one = resampled(spark, pdf, ["g"], "seed", 50).set_index("g")
    monkeypatch.setattr(bootstrap, "FEW", 10)
    monkeypatch.setattr(bootstrap, "FAN_IN", 2)
    two = resampled(spark, pdf.sample(frac=1, random_state=3), ["g"], "seed", 50).set_index("g")
    for g in ("hot", "x", "y"):
        assert np.allclose(one.loc[g, "value_draws"], two.loc[g, "value_draws"]) and one.loc[g, "n"] == two.loc[g, "n"]


def test_replicates_of_single_rows_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None, 0, 1, 2.0, 1.0), ("a", 0, 1, None, 1.0), ("b", 0, 1, 3.0, 1.0)], "g string, seed int, pair_id int, value double, other double")
    found = {r["g"]: r for r in bootstrap.replicates(rows, ["g"], ["value"], ["pair_id"], "seed", 20).collect()}
    assert set(found) == {None, "b"} and set(found["b"]["value_draws"]) == {3.0}
    assert bootstrap.replicates(rows.limit(0), ["g"], ["value"], ["pair_id"]).count() == 0
    assert bootstrap.flat_interval(rows.where("g = 'b'"), ["g"], ["pair_id"]).first()["lo"] is None


def test_matched_arms_find_a_planted_gap(spark):
    rng = np.random.default_rng(4)
    make = lambda arm, q, mean: pd.DataFrame({"arm": arm, "q": q, "i": range(400), "value": rng.normal(mean, 0.3, 400)})
    rows = pd.concat([make("x", 1, 0.7), make("y", 1, 0.5), make("x", 2, 0.5), make("y", 2, 0.5), make("x", 3, 1.0)])
    found = {r["q"]: r for r in bootstrap.matched_arms(spark.createDataFrame(rows), ["q"], "arm", "x", "y", ["i"]).collect()}
    assert set(found) == {1, 2} and found[1]["significant"] and not found[2]["significant"]
    assert found[1]["lo"] < 0.2 < found[1]["hi"] and found[2]["lo"] < 0 < found[2]["hi"]
    # arms that share keys are still resampled by themselves: the variances add up
    wide = (found[1]["hi"] - found[1]["lo"]) / 3.92
    assert wide == pytest.approx(0.3 * (2 / 400) ** 0.5, rel=0.2)


def test_stretches_are_even_however_values_lie(spark):
    values = [*np.random.default_rng(5).random(20_000), 1e12]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    sizes = [r["count"] for r in binning.placed(df, [], "v").groupBy("_stretch").count().collect()]
    assert max(sizes) <= 2 * len(values) / binning.STRETCHES and len(sizes) >= 200
    got = np.array([r["rank"] for r in binning.percentile_rank(df, [], "v", "rank").orderBy("v").collect()])
    assert np.allclose(got, np.arange(1, len(values) + 1) / len(values))
    assert np.allclose(binning.quintile_edges(df, [], "v").first()["edges"], np.quantile(values, binning.CUTS), rtol=1e-12)


@pytest.mark.parametrize("tile", [3, 8192])
def test_tiles_count_like_a_loop(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(6)
    q, own, c = (rng.normal(size=(n, 5)) for n in (23, 23, 40))
    c[7:20] = c[7]  # equal candidates
    rows = [("x" if i % 2 else None, i, q[i].tolist(), own[i].tolist()) for i in range(23)]
    queries = spark.createDataFrame(rows, "condition string, id int, vector array<double>, own array<double>")
    found = vectors.better_candidates(queries, spark.createDataFrame([(v.tolist(),) for v in c], "vector array<double>"))
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    want = {(("x" if i % 2 else None), i): sum(cos(q[i], v) > cos(q[i], own[i]) + 1e-12 for v in c) for i in range(23)}
    assert {(r["condition"], r["id"]): r["better"] for r in found.collect()} == want


def bitmap(height, width, rgb):
    rows = b"".join(b"".join(bytes(reversed(rgb[y][x])) for x in range(width)).ljust(-(-3 * width // 4) * 4, b"\0") for y in reversed(range(height)))
    head = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(rows), 0, 0, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + head + rows


def test_pictures_are_decoded_and_damaged_files_are_rows(spark, tmp_path):
    rng = np.random.default_rng(7)
    rgb = rng.integers(0, 256, (12, 20, 3))
    (tmp_path / "a.bmp").write_bytes(bitmap(12, 20, rgb.tolist()))
    (tmp_path / "b.bmp").write_bytes(b"BM nothing of the kind")
    found = {r["origin"].rsplit("/")[-1]: r for r in pictures.read_pictures(spark, str(tmp_path)).collect()}
    assert (found["a.bmp"]["height"], found["a.bmp"]["width"]) == (12, 20) and found["a.bmp"]["px"] == rgb.ravel().tolist()
    assert found["b.bmp"]["px"] is None and found["b.bmp"]["error"]
    square = pictures.centre_square(pictures.read_pictures(spark, str(tmp_path)))
    rows = square.withColumn("level", F.lit(5)).withColumn("c", damage.corrupt_image("gaussian_blur", F.col("px"), F.lit("k"), F.col("level"), F.col("side"), 3))
    (r,) = rows.select("side", "px", "c", damage.ssim_rgb("px", "c").alias("s")).collect()
    middle = rgb[:, 4:16].astype(float)
    assert r["side"] == 12 and np.allclose(r["px"], middle.ravel()) and np.allclose(r["c"], damage.blur_of(middle[None], 5.0).ravel()) and r["s"] < 0.5


def test_noise_is_normal_with_long_tails(spark):
    z = np.array([r[0] for r in spark.range(200_000).select(damage.normal(F.lit("t"), F.col("id"))).collect()])
    assert abs(z.mean()) < 0.01 and z.std() == pytest.approx(1, abs=0.01) and abs((z**3).mean()) < 0.03 and (z**4).mean() == pytest.approx(3, abs=0.1)
    assert np.abs(z).max() > 3.9 and (np.abs(z) > 3.4641).mean() == pytest.approx(5.3e-4, rel=0.3)


def test_edit_distances_bound_both_sides():
    rng = np.random.default_rng(8)
    a = [rng.integers(0, 5, n) for n in (0, 3, 900, 5, 40)]
    b = [rng.integers(0, 5, n) for n in (4, 0, 2, 700, 41)]
    codes, sizes = np.concatenate([*a, *b]), np.array([len(x) for x in (*a, *b)])
    starts = np.cumsum(sizes) - sizes

    def loop(x, y):
        row = list(range(len(y) + 1))
        for i, u in enumerate(x, 1):
            last, row = row, [i]
            for j, v in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (u != v)))
        return row[-1]

    for cells_ in (1, 1000, 1 << 20):
        assert damage.edit_distances(codes, (starts[:5], sizes[:5]), (starts[5:], sizes[5:]), cells_).tolist() == [loop(x, y) for x, y in zip(a, b, strict=True)]


def test_stopped_cells_go_on(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{i % 3}", i % 2, i, i / 7) for i in range(60)], "model string, seed int, pair_id long, value double")
    path, wanted = str(tmp_path / "run"), sorted(tuple(r) for r in rows.select("model", F.col("seed").cast("string"), "pair_id", "value").collect())

    def killed(part):
        if len(cells.done_cells(spark, path, ["model", "seed"])) >= 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        cells.run_cells(rows, path, at_once=2, after=killed)
    assert cells.cell_rows(spark, path).count() == 20  # the second job's rows are there, but not done
    assert len(cells.planned_cells(rows, path, ["model", "seed"])) == 4
    assert len(cells.run_cells(rows, path, at_once=3)) == 4 and cells.run_cells(rows, path) == []
    assert sorted(tuple(r) for r in cells.cell_rows(spark, path).select("model", "seed", "pair_id", "value").collect()) == wanted


def test_measurements_by_cells(spark, sf, tmp_path):
    rows = run.measurements(spark, sf)
    done = cells.run_cells(rows.where("seed = 1"), str(tmp_path / "m"))
    assert {s for _, s in done} == {"1"} and cells.cell_rows(spark, str(tmp_path / "m")).count() == rows.where("seed = 1").count()


def test_manifest_grows_by_batches_and_replays_add_nothing(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame(list(rows), "id long, caption string, bytes_hex string, sha256 string").drop("sha256")
    path, content = str(tmp_path / "m"), F.col("bytes_hex")
    one = batch((1, "a", "00", None), (2, "b", "00", None), (3, "c", "01", None), (4, "d", None, None))
    assert growing.append_batch(one, 0, path, content, "id") == 2 == growing.append_batch(one, 0, path, content, "id")
    assert growing.append_batch(batch((9, "x", "01", None), (8, "y", "02", None), (7, "z", "03", None)), 1, path, content, "id", target=3) == 3
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 3, 7]


def test_manifest_stream_stops_at_its_target_and_goes_on(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for f in range(6):
        (source / f"{f}.json").write_text("\n".join(f'{{"id": {10 * f + i}, "caption": "c", "bytes_hex": "{f:02d}{i:02d}"}}' for i in range(4)))
    stream = lambda: spark.readStream.schema(manifest.MANIFEST).option("maxFilesPerTrigger", 1).json(str(source)).drop("sha256")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    assert growing.build_manifest(stream(), out, check, F.col("bytes_hex"), "id", 10) == 10
    assert growing.build_manifest(stream(), out, check, F.col("bytes_hex"), "id", 10) == 10
    assert spark.read.parquet(out).select("sha256").distinct().count() == 10
    other = str(tmp_path / "all")
    assert growing.build_manifest(stream(), other, str(tmp_path / "check2"), F.col("bytes_hex"), "id") == 24


def test_partitions_of_the_full_key_join_grow_with_the_rows_and_bins_move_none(spark, sf, monkeypatch):
    from frayline.plans import reports
    from frayline.sources import views

    assert views.parts_of(10, spark) == 4 and views.parts_of(100 << 18, spark) == 100
    monkeypatch.setattr(views, "parts_of", lambda rows, session: 9)
    rows = reports.joined(spark, sf)
    assert rows.rdd.getNumPartitions() == 9
    plan = binning.assign_quintile(rows, ["direction"], "damage")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(direction#" not in plan.split("BroadcastHashJoin")[0]
    assert "BroadcastHashJoin [direction" in plan


def test_captions_and_vectors_of_one_file_are_dealt_to_all_tasks(spark, sf):
    from frayline.plans import experiment, queries

    assert queries._captions(spark, sf).rdd.getNumPartitions() == 4
    assert queries._images(spark, sf).rdd.getNumPartitions() == 4
    plan = experiment._stacked(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [id") == 2


def test_queries_are_not_copied_for_each_pass_of_candidates(spark, monkeypatch):
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(40, 6)), rng.normal(size=(70, 6))
    monkeypatch.setattr(vectors, "PASS", 10 * 8 * 6, raising=False)
    queries = spark.createDataFrame([(i, v.tolist(), c[i].tolist()) for i, v in enumerate(q)], "id int, vector array<double>, own array<double>")
    found = vectors.better_candidates(queries, spark.createDataFrame([(v.tolist(),) for v in c], "vector array<double>"))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit(q) @ unit(c).T
    assert {r.id: r.better for r in found.collect()} == {i: int((s[i] > s[i, i] + 1e-12).sum()) for i in range(40)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_hashes_of_a_batch_are_md5():
    import hashlib

    from frayline.functions import draws

    heads = [b"mask|7|3", b"", "café|漢".encode(), b"x" * 48, b"x" * 52, b"x" * 54, b"y" * 80]
    sizes = np.array([1200, 0, 12, 110, 1001, 5, 3])
    owner, spot = draws.places(sizes)
    want = [hashlib.md5(heads[o] + b"|%d" % i).digest() for o, i in zip(owner, spot, strict=True)]
    drawn = draws.hashes(heads, owner, spot)
    assert [b"".join(int(x).to_bytes(4) for x in c) for c in drawn.T] == want
    ranked = sorted(range(len(owner)), key=lambda i: (owner[i], want[i], i))
    assert draws.in_order(owner, drawn).tolist() == ranked
    drawn[0] = 5  # the front of the hash does not decide
    drawn[1] = 7
    assert draws.in_order(owner, drawn).tolist() == sorted(range(len(owner)), key=lambda i: (owner[i], want[i][8:], i))
    hit = draws.chosen(heads, sizes, np.minimum(sizes, 4))
    left = np.cumsum(sizes) - sizes
    first = {(o, i) for o in range(len(heads)) for i in sorted(range(sizes[o]), key=lambda i: want[left[o] + i])[:4]}
    assert {(int(o), int(i)) for o, i in zip(owner[hit], spot[hit], strict=True)} == first


def test_rulers_of_corruptions_made_as_numbers_equal_those_of_the_words(spark, monkeypatch):
    from frayline.functions import corrupt

    rng = np.random.default_rng(9)
    vocabulary = ["a", "b", "c", *corrupt.VOCABULARY[:5]]
    rows = [(i, 1 + i % 5 if i else 0, [str(w) for w in rng.choice(vocabulary, n)]) for i, n in enumerate([*range(40), 1, 2, 0, 90, 33])]
    df = spark.createDataFrame([*rows, (99, 2, None)], "id int, level int, w array<string>").repartition(2)
    key = F.concat_ws("|", "id", "level")
    one = [damage.text_rulers("w", corrupt.corrupt_text(k, F.col("w"), key, F.col("level"))).alias(k) for k in ("mask", "shuffle", "replace")]
    got = df.select("id", F.array(*one).alias("r")).collect()
    assert {r.id: r.r for r in got} == {r.id: r.r for r in df.select("id", damage.corrupted_rulers("w", key, "level").alias("r")).collect()}
    assert [x.edit for x in next(r for r in got if r.id == 0).r] == [0, 0, 0]


def test_corrupted_captions_are_made_in_batches_from_whole_rows_dealt_first(spark, sf):
    from frayline.plans import experiment, queries

    for rows in (queries.text_damage(spark, sf), experiment.damage_builder(spark, sf).where("modality = 'text'"), queries.text_mask(spark, sf)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "md5(" not in plan
        assert plan.index("Generate posexplode(split(") < plan.index("Exchange RoundRobinPartitioning")  # sentences are cut behind the exchange


@pytest.mark.parametrize("size", [7, 1 << 25])
def test_counts_with_a_limit_stop_and_are_exact_below_it(spark, monkeypatch, size):
    monkeypatch.setattr(vectors, "PASS", size * 8 * 6 if size < 100 else size)
    monkeypatch.setattr(vectors, "FIRST_TILE", 3)
    rng = np.random.default_rng(10)
    q, c = rng.normal(size=(60, 6)), rng.normal(size=(50, 6))
    c[5:12] = c[5]  # equal candidates
    q[:20] = c[:20] + 0.2 * rng.normal(size=(20, 6))
    queries = spark.createDataFrame([(i % 7, None if i % 2 else "x", v.tolist(), c[i % 50].tolist()) for i, v in enumerate(q)], "id int, kind string, vector array<double>, own array<double>")
    candidates = spark.createDataFrame([(v.tolist(),) for v in c], "vector array<double>")
    whole = vectors.better_candidates(queries, candidates).collect()
    found = vectors.better_candidates(queries, candidates, 4).collect()
    key = lambda r: (r.id, r.kind or "", min(r.better, 4))
    assert sorted(map(key, found)) == sorted(map(key, whole)) and len(found) == 60
    assert any(r.better < 4 for r in found) and sum(r.better for r in found) < sum(r.better for r in whole)
    assert {r.better for r in vectors.better_candidates(queries, candidates.limit(0), 4).collect()} == {0}


def test_versions_of_vectors_are_made_in_batches_of_the_dealt_vectors(spark, sf):
    from frayline.plans import experiment

    plan = experiment._stacked(spark, sf).where("direction = 'i2t'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "md5(" not in plan
    assert plan.index("MapInArrow") < plan.index("Join")  # the match is beside the vector before this has versions


def test_weights_of_few_values_are_counted_and_equal_the_weighted_sums(monkeypatch):
    rng = np.random.default_rng(11)
    one, two = (rng.integers(0, 1 << 32, 700, dtype=np.uint32) for _ in range(2))
    places = bootstrap._places(20_000, 2, 1, 3)
    hits = np.array([rng.random(700) < 0.3, rng.integers(0, 3, 700)], dtype=float)
    counted, sums = [], bootstrap._counts
    monkeypatch.setattr(bootstrap, "_counts", lambda *x: counted.append(len(x[0])) or sums(*x))
    fast = bootstrap._sums(one, two, hits, places)
    assert sum(counted) == 700 and len(counted) == 6
    monkeypatch.setattr(bootstrap, "KINDS", 0)
    assert np.array_equal(fast, bootstrap._sums(one, two, hits, places)) and len(counted) == 6
    with np.errstate(over="ignore"):
        x = one[:, None] + two[:, None] * places
        weights = np.searchsorted(bootstrap.STEPS, bootstrap._mixed(x) >> np.uint32(16), side="right")
    assert np.array_equal(fast[0], weights.sum(axis=0)) and np.array_equal(fast[2], (hits[1][:, None] * weights).sum(axis=0))
    with np.errstate(invalid="ignore"):
        assert np.isnan(bootstrap._sums(one, two, np.where(hits == 1, np.inf, hits), places)[1]).any()  # as the SQL, no weight times infinity


def test_points_do_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"g": "a", "seed": np.tile([0, 1, 2], 200), "pair_id": range(600), "value": rng.normal(0.5, 0.1, 600), "other": rng.normal(0, 1e6, 600)})
    found = [resampled(spark, pdf.sample(frac=1, random_state=i), ["g"], "seed", 40) for i in range(4)]
    for other in found[1:]:
        assert other["value"][0] == found[0]["value"][0] and other["other"][0] == found[0]["other"][0]
        assert list(other["other_draws"][0]) == list(found[0]["other_draws"][0])

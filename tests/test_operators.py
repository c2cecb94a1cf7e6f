"""Literal cases of the engine's operators."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from cohortgeo.functions import boxes as B, hashing, predicates as P, vectors as V
from cohortgeo.operators import components, evaluation, inference, linalg, motion, nested, phases, pooling, predict, relations, segments, splits, triplets, validation


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- vectors and nesting


def test_cosine(spark):
    f = frame(spark, [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    d = f.select(V.cosine_distance(F.col("a"), F.col("b"), V.norm(F.col("a")), V.norm(F.col("b"))).alias("d"))
    assert [r["d"] for r in d.collect()] == [0.0, 2.0]


def test_zero_norm_raises(spark):
    with pytest.raises(PySparkException, match="zero-norm"):
        frame(spark, [([0.0, 0.0],)], "v array<double>").select(V.checked_norm(F.col("v"))).collect()


def test_nested_mean_weighs_groups_not_rows(spark):
    rows = [("g", "t1", "a1", 1.0, 0.0)] * 100 + [("g", "t1", "a2", 0.0, 1.0), ("g", "t2", "a3", 0.0, 1.0)]
    f = frame(spark, rows, "dependency_group_id string, transition_id string, anchor_observation_id string, d_n double, d_s double")
    r = nested.nested_mean(f, {"sns": V.state_score(F.col("d_n"), F.col("d_s"))}).first()
    assert (r["sns"], r["transitions"], r["anchors"], r["rows"]) == (0.75, 2, 3, 102)
    again = nested.nested_mean(f.repartition(7), {"sns": V.state_score(F.col("d_n"), F.col("d_s"))}).first()
    assert again == r


def test_nested_mean_nulls(spark):
    rows = [(None, "t", "a", 1.0), (None, "t", "b", float("nan")), ("g", None, "c", 0.0), ("h", "t", "d", None)]
    f = frame(spark, rows, "dependency_group_id string, transition_id string, anchor_observation_id string, x double")
    r = nested.nested_mean(f, {"x": F.col("x")}).first()
    assert (r["x"], r["groups"], r["rows"]) == (0.5, 3, 4)
    with pytest.raises(ValueError, match="missing"):
        nested.nested_mean(f.drop("transition_id"), {"x": F.col("x")})
    with pytest.raises(ValueError, match="zero rows"):
        nested.require_rows(f.limit(0))


def test_nested_mean_against_pandas(spark):
    import pandas as pd

    r = random.Random(9)
    pick = lambda xs: r.choice([*xs, None])
    for _ in range(3):
        rows = [(pick("gh"), pick("tuv"), pick("abcd"), r.choice([None, float("nan"), r.random(), r.random(), r.random()])) for _ in range(r.randint(1, 120))]
        got = nested.nested_mean(frame(spark, rows, "dependency_group_id string, transition_id string, anchor_observation_id string, x double"), {"x": F.col("x")}).first()
        p = pd.DataFrame(rows, columns=["g", "t", "a", "x"])
        a = p.groupby(["g", "t", "a"], dropna=False)["x"].mean()
        t = a.groupby(level=["g", "t"], dropna=False).mean()
        g = t.groupby(level="g", dropna=False).mean()
        assert (got["groups"], got["transitions"], got["anchors"], got["rows"]) == (len(g), len(t), len(a), len(p))
        assert got["x"] == pytest.approx(g.mean()) if g.notna().any() else got["x"] is None


def test_scores(spark):
    cases = [(0.5, 0.5, 0.5), (0.0, 1.0, 1.0), (1.0, 0.0, 0.0), (float("nan"), 1.0, 0.0), (None, 1.0, 0.0)]
    f = frame(spark, [(a, b) for a, b, _ in cases], "d_n double, d_s double")
    for precision in ("double", "fp32"):
        assert [r[0] for r in f.select(V.state_score(F.col("d_n"), F.col("d_s"), precision=precision)).collect()] == [c for *_, c in cases]
    with pytest.raises(ValueError):
        V.state_score(F.col("d_n"), F.col("d_s"), -1)
    with pytest.raises(ValueError):
        V.hinge(F.col("d_n"), F.col("d_s"), 3)


def test_bootstrap_covers_and_repeats(spark):
    rows = [(f"g{i}", float(i % 2)) for i in range(200)]
    f = frame(spark, rows, "dependency_group_id string, x double")
    r = inference.group_bootstrap(f, "x", 300).first()
    assert r["estimate"] == 0.5 and r["low"] < 0.5 < r["high"] and 0.05 < r["high"] - r["low"] < 0.25
    again = inference.group_bootstrap(f.repartition(5), "x", 300).first()
    assert (again["low"], again["high"]) == (pytest.approx(r["low"]), pytest.approx(r["high"]))


@pytest.mark.parametrize("bucket", [7, 100_000])
def test_bootstrap_draws_whole_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(inference, "GROUPS_A_TASK", bucket)
    x = np.random.default_rng(3).gamma(1.0, 2.0, 90)
    f = frame(spark, [(f"g{i}", float(v)) for i, v in enumerate(x)] + [("null", None)], "dependency_group_id string, x double")
    r = inference.group_bootstrap(f, "x", 4000).first()
    means = np.random.default_rng(4).choice(x, (4000, 90)).mean(1)
    low, high = np.percentile(means, [2.5, 97.5])
    assert r["groups"] == 90 and r["low"] == pytest.approx(low, abs=0.06) and r["high"] == pytest.approx(high, abs=0.06)
    one = inference.group_bootstrap(frame(spark, [("a", 2.0)], "dependency_group_id string, x double"), "x", 10).first()
    assert (one["low"], one["high"]) == (2.0, 2.0)
    gate = inference.paired_gate(f, f.withColumn("x", F.col("x") + 1), "x", 0.5, replicates=50).first()
    assert gate["passes"] and gate["low"] == pytest.approx(1.0)


def test_permutation_test(spark):
    r = np.random.default_rng(8)
    rows = [(f"g{g}", y, round(float(r.normal(0.4 * y)), 1)) for g in range(12) for _ in range(3) for y in (0, 1)]
    got = inference.permutation_test(frame(spark, rows, "dependency_group_id string, label int, s double"), "s", replicates=49, seed=5).first()

    def auroc(labels):
        pos, neg = [x[2] for x, y in zip(rows, labels) if y], [x[2] for x, y in zip(rows, labels) if not y]
        return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))

    seen = auroc([y for _, y, _ in rows])
    null = [auroc([1 - y if hashlib.md5(f"5-{b}-{g}".encode()).hexdigest()[0] < "8" else y for g, y, _ in rows]) for b in range(1, 50)]
    assert got["auroc"] == pytest.approx(seen) and got["at_least"] == sum(a >= seen - 1e-12 for a in null)
    assert got["p_value"] == pytest.approx((got["at_least"] + 1) / 50)


def test_role_model_tells_roles_that_differ(spark):
    r = np.random.default_rng(9)
    rows = [([float(v) for v in a], [float(v) for v in a + r.normal(0, 0.1, 2) + 2 * y], y) for a in r.normal(size=(60, 2)) for y in (0, 1)]
    f = frame(spark, rows, "a array<double>, b array<double>, label int")
    assert motion.auroc(inference.role_model(f, f, "a", "b"), "probability", "label").first()["auroc"] > 0.99


def test_quantiles_and_positions(spark):
    r = np.random.default_rng(10)
    rows = [(k, float(v)) for k in ("a", "b", None) for v in r.integers(0, 9, 40)] + [("c", 4.0), ("a", None)]
    f = frame(spark, rows, "k string, x double").repartition(5)
    for q in motion.exact_quantiles(f, ["k"], "x", [0.0, 0.3, 0.5, 1.0]).collect():
        x = [v for k, v in rows if k == q["k"] and v is not None]
        assert q["q"] == pytest.approx(np.quantile(x, [0.0, 0.3, 0.5, 1.0]).tolist()) and (q["n"], q["least"], q["most"]) == (len(x), min(x), max(x))
    whole = motion.exact_quantiles(f, [], "x", [0.25]).first()
    assert whole["q"][0] == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.25))
    ids = frame(spark, [(k % 3, k) for k in range(50)], "g long, i long")
    got = {(x["g"], x["i"]): x["p"] for x in motion.positions(ids, ["g"], [-F.col("i")], "p").collect()}
    for g in range(3):
        assert [got[g, i] for i in sorted((i for i in range(50) if i % 3 == g), reverse=True)] == list(range(1, len([i for i in range(50) if i % 3 == g]) + 1))


def test_linear_ar_finds_a_linear_map(spark):
    r = np.random.default_rng(11)
    a, rows = np.array([[0.9, 0.2], [-0.3, 0.8]]), []
    for s in range(6):
        v, c = r.normal(size=2), r.normal(size=2)
        for t in range(12):
            rows.append((s, t, v.tolist()))
            v, c = v + c, a @ c + np.array([0.1, -0.2])
    f = frame(spark, rows, "s long, t long, v array<double>")
    m = predict.fit_linear_ar(f, "s", "t", "v", penalty=1e-12)
    assert np.allclose(m.matrix, a, atol=1e-6) and np.allclose(m.offset, [0.1, -0.2], atol=1e-6)
    got = {x["horizon"]: x["cosine"] for x in predict.linear_ar(f, "s", "t", "v", m).collect()}
    assert got[1] == pytest.approx(1.0) and set(got) == {1, 2, 4, 8}


def test_losses(spark):
    x = np.random.default_rng(12).normal(size=(30, 4)) + 100
    f = vectors(spark, x)
    c = np.cov(x.T, ddof=0)
    loss, d = predict.covariance_loss(linalg.moments(f, "v"))
    assert d == 4 and loss == pytest.approx((c**2).sum() / 4 - (np.diag(c) ** 2).sum() / 4)
    assert predict.variance_hinge(f, "v", 1.1).first()["loss"] == pytest.approx(np.maximum(0, 1.1 - x.std(0)).mean())
    z = frame(spark, [([0.25, 0.75], 1), ([0.5, 0.5], 0), ([0.1, 0.9], None)], "z array<double>, y int")
    assert predict.cross_entropy(z, "z", "y").first()["loss"] == pytest.approx(-(math.log(0.75) + math.log(0.5)) / 2)


def test_relations(spark):
    a, b = frame(spark, [(1, "x"), (2, "y"), (3, "z")], "k long, a string"), frame(spark, [(2, 5), (3, 6), (4, 7)], "k long, b int")
    assert sorted(tuple(r) for r in relations.one_to_one({"a": a, "b": b}, "k").collect()) == [(2, "y", 5), (3, "z", 6)]
    for bad in (a.unionByName(a), a.unionByName(frame(spark, [(None, "n")], a.schema))):
        with pytest.raises(validation.ManifestError, match="of left"):
            relations.one_to_one({"left": bad, "b": b}, "k")
    names = frame(spark, [("a/f10.jpg",), ("a/f2.jpg",), ("f10b.jpg",), ("none.jpg",), ("f007",)], "path string")
    assert {r["path"]: r["position"] for r in relations.numeric_positions(names).collect()} == {"a/f2.jpg": 0, "f007": 1, "a/f10.jpg": 2, "f10b.jpg": 2}
    train = frame(spark, [("s", "l", 1), ("s", "l", 0), ("s", "m", 1), ("t", "l", 0), ("t", "l", None)], "s string, l string, y int")
    rows = frame(spark, [("s", "l"), ("s", "q"), ("t", "q"), ("u", "l"), (None, "l")], "s string, l string")
    got = {(r["s"], r["l"]): r["predicted"] for r in relations.backoff_baseline(train, rows, [["s", "l"], ["s"]], "y").collect()}
    assert got == {("s", "l"): 0, ("s", "q"): 1, ("t", "q"): 0, ("u", "l"): 0, (None, "l"): 0}


def test_eligibility(spark):
    f = frame(spark, [(1, 0.1, True), (2, None, True), (3, 0.9, True), (4, 0.1, False)], "i long, d double, q boolean")
    got = {r["i"]: (r["eligible_base"], r["confirmatory_eligible"]) for r in triplets.eligibility(f, {"d": "d >= 0"}, {"near": "d < 0.5", "q": "q"}).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (True, False), 4: (True, False)}


# ---- linear algebra


def vectors(spark, x):
    return frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, v array<double>")


def test_moments_and_ranks(spark):
    x = np.random.default_rng(1).normal(3, 2, (50, 6))
    m = linalg.moments(vectors(spark, x).repartition(5), "v")
    assert m.n == 50 and np.allclose(m.covariance, np.cov(x.T, ddof=0)) and np.allclose(m.mean, x.mean(0))
    assert linalg.effective_rank(linalg.moments(vectors(spark, np.ones((4, 3))), "v")) == 0.0
    e = np.linalg.eigvalsh(np.cov(x.T, ddof=0))
    assert linalg.participation_ratio(m) == pytest.approx(e.sum() ** 2 / (e**2).sum())
    with pytest.raises(ValueError):
        linalg.effective_rank(linalg.moments(vectors(spark, np.ones((1, 3))), "v"))


def test_pca_keeps_centred_cosines(spark):
    x = np.random.default_rng(2).normal(size=(20, 8))
    y = linalg.PcaControl.fit(vectors(spark, x), "v", 8).apply(x)
    c = linalg.unit_rows(x - x.mean(0))
    assert np.allclose(y @ y.T, c @ c.T, atol=2e-6)
    with pytest.raises(ValueError):
        linalg.PcaControl.fit(vectors(spark, np.eye(4)), "v", 4)


def test_projection_is_orthonormal():
    p = linalg.random_projection(8, 3, 4)
    assert np.allclose(p @ p.T, np.eye(3), atol=1e-6)


def test_readouts(spark):
    assert linalg.Readout("residual_bottleneck").parameters == 395_777
    assert linalg.Readout("non_residual_mlp").parameters == 395_776
    assert linalg.Readout("linear_residual").parameters == 592_129
    x = np.random.default_rng(0).normal(size=(5, 12))
    for name in linalg.Readout.NAMES:
        y = linalg.Readout(name, 12, 4)(x)
        assert y.shape == x.shape and np.allclose(np.linalg.norm(y, axis=1), 1)
    out = linalg.readout(vectors(spark, x), "v", linalg.Readout("identity", 12)).orderBy("i").collect()
    assert np.allclose([r["v"] for r in out], linalg.unit_rows(x))
    with pytest.raises(ValueError):
        linalg.Readout("other")


# ---- motion


def test_scaler(spark):
    f = frame(spark, [([0.0, 1.0],), ([1e-9, 1.0],), ([2e-9, 1.0],)], "m array<double>")
    s = motion.fit_scaler(f, "m", 1e-3)
    assert s.active == [True, False] and min(s.denominator) >= 1e-3
    assert [len(r[0]) for r in f.select(s.transform(F.col("m"))).collect()] == [1, 1, 1]
    for bad in ([[1.0, None]] * 2, [[1.0, float("nan")]] * 2, [[1.0, 1.0]] * 3, [[1.0]]):
        with pytest.raises(ValueError):
            motion.fit_scaler(frame(spark, [(b,) for b in bad], "m array<double>"), "m")
    with pytest.raises(PySparkException):
        frame(spark, [([None, 1.0],)], "m array<double>").select(s.transform(F.col("m"))).collect()


def test_opposite_motion(spark):
    f = frame(spark, [([0.0, 0.0], [1.0, 0.0], [-1.0, 0.0])], "a array<double>, n array<double>, s array<double>")
    assert tuple(f.select(*motion.triplet_mismatch(F.col("a"), F.col("n"), F.col("s"))).first()) == (2.0, 0.0, 1.0)


def test_role_permutation_flips_whole_groups(spark):
    rows = [(p, g, y) for p, g in ((1, "a"), (2, "a"), (3, "b"), (4, "c")) for y in (0, 1)]
    f = frame(spark, rows, "pair_id long, dependency_group_id string, label int")
    assert motion.pair_violations(f).count() == 0
    seen = set()
    for seed in range(8):
        flips = motion.permute_roles(f, seed).groupBy("dependency_group_id").agg(F.avg((F.col("label") != F.col("permuted")).cast("int")).alias("f")).collect()
        assert all(r["f"] in (0.0, 1.0) for r in flips)
        seen |= {(r["dependency_group_id"], r["f"]) for r in flips}
    assert len(seen) == 6
    bad = f.unionByName(frame(spark, [(5, "a", 0), (5, "b", 1), (6, "a", 0)], f.schema))
    assert {r["pair_id"] for r in motion.pair_violations(bad).collect()} == {5, 6}


def test_auroc_with_ties(spark):
    rng = random.Random(4)
    rows = [(float(rng.randint(0, 5)), rng.randint(0, 1)) for _ in range(60)]
    r = motion.auroc(frame(spark, rows, "s double, y int"), "s", "y").first()
    pairs = [(a > b) + 0.5 * (a == b) for a, y in rows if y for b, z in rows if not z]
    assert r["auroc"] == pytest.approx(sum(pairs) / len(pairs))


def test_kinematics(spark):
    rows = [("o", k, 10.0, 10.0 * k, 0.0, 4.0, 2.0, 1.0) for k in range(5)]
    r = motion.kinematics(frame(spark, rows, "observation_id string, frame long, fps double, x double, y double, w double, h double, v double")).first()
    assert r["speed_mean"] == pytest.approx(100.0) and r["speed_q90"] == pytest.approx(100.0) and r["area_rate_mean"] == 0.0


# ---- segments


def test_runs_and_windows(spark):
    labels = ["a"] * 30 + ["b"] * 3 + ["a"] * 34
    f = frame(spark, [("s", i, x) for i, x in enumerate(labels)], "sequence_id string, frame long, label string")
    r = segments.label_runs(f).orderBy("run_index").collect()
    assert [(x["run_index"], x["start"], x["end"]) for x in r] == [(0, 0, 29), (1, 30, 32), (2, 33, 66)]
    w = segments.candidates(segments.centred_windows(segments.label_runs(f)), "rev").orderBy("start_frame").collect()
    assert [(x["start_frame"], x["end_frame"]) for x in w] == [(0, 29), (35, 64)]
    assert w[0]["sampled_frame_indices"] == [0, 2, 4, 6, 8, 10, 12, 14, 15, 17, 19, 21, 23, 25, 27, 29]
    with pytest.raises(ValueError):
        segments.sampled_frames(F.lit(0), 20)
    assert segments.label_runs(f.limit(0)).count() == 0


# ---- boxes and pooling


def test_geometry(spark):
    g = B.crop_geometry(F.lit(720), F.lit(1280))
    assert tuple(spark.range(1).select(g.resized_h, g.resized_w, g.top, g.left).first()) == (438.0, 778.0, 27.0, 197.0)
    with pytest.raises(PySparkException):
        spark.range(1).select(B.crop_geometry(F.lit(0), F.lit(5)).source_h).collect()


def test_box(spark):
    g = B.crop_geometry(F.lit(720), F.lit(1280))
    box = lambda *v: B.transform_box(*map(F.lit, map(float, v)), g)
    inside, mass, outside = spark.range(1).select(box(400, 100, 300, 200), B.token_mass(box(400, 100, 300, 200)), box(0, 0, 1, 1)).first()
    assert mass >= 1 and outside is None and 0 <= inside["x"] and inside["x"] + inside["w"] <= 384


def test_occupancy_sums_to_mass(spark):
    f = frame(spark, [("a", 0, (10.5, 20.0, 50.0, 33.3)), ("a", 1, (10.5, 20.0, 50.0, 33.3))], "observation_id string, frame int, box struct<x:double,y:double,w:double,h:double>")
    total = pooling.box_occupancy(f).agg(F.sum("occupancy")).first()[0]
    assert total == pytest.approx(f.select(B.token_mass(F.col("box"))).first()[0])


def test_pools(spark):
    rows = [("a", [float(i), 1.0], w) for i, w in enumerate((1.0, 1.0, 0.0, 2.0))] + [("b", [1.0, 1.0], 0.0)] * 3 + [("c", [2.0, 4.0], 1.0)] * 2
    p = {r["observation_id"]: r for r in pooling.region_pools(frame(spark, rows, "observation_id string, embedding array<double>, occupancy double")).collect()}
    assert p["a"]["box"] == pytest.approx([4 / 3, 1.0]) and p["a"]["context"] == pytest.approx([2.0, 1.0])
    assert p["b"]["box"] is None and p["b"]["reason"] == "region_below_minimum_mass"
    assert p["c"]["box"] == pytest.approx(p["c"]["full"]) and p["c"]["context"] is None and p["c"]["reason"] == "context_below_minimum_mass"
    masked = frame(spark, [(*r, 1.0 if r[0] == "a" else 0.0) for r in rows], "observation_id string, embedding array<double>, occupancy double, m double")
    q = {r["observation_id"]: r for r in pooling.region_pools(masked.repartition(5), mask="m").collect()}
    assert q["a"]["mask"] == pytest.approx([1.5, 1.0]) and q["c"]["mask"] is None and q["a"]["box"] == pytest.approx(p["a"]["box"])
    assert (pooling.erase(np.ones((2, 2, 3), np.float32), np.array([[1, 0], [0, 1]])) == np.array([[[0] * 3, [1] * 3], [[1] * 3, [0] * 3]])).all()
    with pytest.raises(PySparkException):
        pooling.region_pools(frame(spark, [("a", [1.0], float("nan"))], "observation_id string, embedding array<double>, occupancy double")).collect()


def test_polygons(spark):
    square = [2.0, 3.0, 8.0, 3.0, 8.0, 7.0, 2.0, 7.0]
    m = pooling.fill_polygons([square], 10, 12)
    assert m.sum() == 24 and m[3:7, 2:8].all()
    triangle = pooling.fill_polygons([[0.0, 0.0, 10.0, 0.0, 0.0, 10.0]], 10, 10)
    assert abs(triangle.sum() - 50) <= 6
    whole = [0.0, 0.0, 1280.0, 0.0, 1280.0, 720.0, 0.0, 720.0]
    rows = [("a", 0, [whole], 720, 1280), ("a", 1, [whole], 720, 1280), ("b", 0, [[0.0, 0.0, 5.0, 0.0, 5.0, 5.0]], 720, 1280), ("c", 0, None, 720, 1280)]
    f = frame(spark, rows, "observation_id string, frame long, polygons array<array<double>>, image_height int, image_width int")
    got = pooling.polygon_occupancy(f, empty="skip").groupBy("observation_id").agg(F.sum("occupancy").alias("m"), F.count("*").alias("n")).collect()
    assert [(r["observation_id"], r["m"], r["n"]) for r in got] == [("a", 576.0, 576)]
    reasons = {(r["observation_id"], r["frame"]): r["reason"] for r in pooling.polygon_reasons(f).collect()}
    assert reasons == {("a", 0): None, ("a", 1): None, ("b", 0): "mask_outside_encoder_crop", ("c", 0): "no_polygon"}
    with pytest.raises(PySparkException, match="outside the crop|no polygon"):
        pooling.polygon_occupancy(f).collect()


def test_token_positions(spark):
    r = spark.range(1).select(B.token_position(F.lit(576 + 25), 4608).alias("p")).first()["p"]
    assert (r["t"], r["i"], r["j"]) == (1, 1, 1)
    with pytest.raises(ValueError):
        B.token_position(F.lit(0), 100)


# ---- groups and splits


def groups(spark, rows, fields):
    f = frame(spark, rows, "observation_id string, " + ", ".join(f"{x} string" for x in fields))
    return {r[0]: r[1] for r in components.dependency_groups(f, fields).collect()}


def test_groups_null_and_blank_make_no_edge(spark):
    g = groups(spark, [("a", None, "v1"), ("b", None, "v2"), ("c", "  ", "v3"), ("d", "  ", "v4")], ["asset", "video"])
    assert len(set(g.values())) == 4


def test_groups_transitive(spark):
    g = groups(spark, [("a", None, "v1"), ("b", "x", "v1"), ("c", "x", "v2"), ("d", None, "v3")], ["asset", "video"])
    assert g["a"] == g["b"] == g["c"] == "dep_a" and g["d"] == "dep_d"
    with pytest.raises(ValueError):
        groups(spark, [("a", "x"), ("a", "y")], ["asset"])


@pytest.mark.parametrize("at_once", [0, 1_000_000])
def test_components_against_union_find(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(frame(spark, edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    named = components.connected_components(frame(spark, [("é", "z"), ("z", "a"), ("b", "c")], "u string, v string")).collect()
    assert {tuple(r) for r in named} == {("é", "a"), ("z", "a"), ("a", "a"), ("c", "b"), ("b", "b")}
    assert components.connected_components(frame(spark, [], "u long, v long")).count() == 0


def test_split_unit(spark):
    rows = [(f"o{i:02d}", f"g{i // 2}", "x" if i % 2 else "y") for i in range(12)]
    f = frame(spark, rows, "observation_id string, dependency_group_id string, kind string")
    s = splits.assign_splits(f, stratify=["kind"], seed=7)
    assert {r["split"]: r["observations"] for r in s.realized.collect()} == {"train": 8, "validation": 2, "test": 2}
    assert splits.split_violations(s.mapping).count() == 0
    with pytest.raises(ValueError):
        splits.assign_splits(f, ratios=(0.5, 0.4), names=("a", "b"))
    with pytest.raises(ValueError):
        splits.assign_splits(f.withColumn("dependency_group_id", F.lit(None).cast("string")))


def test_multilabel(spark):
    f = frame(spark, [("a; b;;a",), ('["y","x"]',), ("[oops;z",), (None,), (" ",)], "t string")
    assert [r[0] for r in f.select(P.multilabel(f, "t")).collect()] == [["a", "a", "b"], ["x", "y"], ["[oops", "z"], [], []]
    g = frame(spark, [(["b", "", None, "a"],)], "t array<string>")
    assert g.select(P.multilabel(g, "t")).first()[0] == ["a", "b"]


# ---- phases


def phase_rows(spark, rows):
    return frame(spark, rows, "observation_id string, phase string, sequence_id string, asset_proxy_id string, frame_id long, media_sha256 string, reason string")


def test_phases(spark):
    rows = [(f"p{i}", "pre_contact", "s", "a", i, f"h{i}", None) for i in range(3)] + [(f"c{i}", "contact", "s", "a", 10 + i, f"k{i}", None) for i in range(2)]
    rows += [("x1", "pre_contact", "s", "b", 1, "same", None), ("x2", "contact", "s", "b", 2, "same", None), ("y", "contact", "s", "b", 3, "z", None), ("w", "contact", "s", "a", 4, "q", "missing_media")]
    r = phases.build(phase_rows(spark, rows))
    t = {x["triplet_id"]: x for x in r.triplets.collect()}
    assert set(t) == {"proxy_s_a_pre_anchor", "proxy_s_a_contact_anchor"}
    x = t["proxy_s_a_contact_anchor"]
    assert (x["anchor_observation_id"], x["nuisance_observation_id"], x["state_observation_id"]) == ("c0", "c1", "p0")
    assert {(e["frame_id"], e["reason"]) for e in r.exclusions.collect()} == {(1, "cross_phase_exact_duplicate"), (2, "cross_phase_exact_duplicate"), (3, "insufficient_phase_support"), (4, "missing_media")}
    assert {(s["name"], s["n"]) for s in phases.summary(r).collect()} >= {("triplets", 2), ("eligible_keys", 1), ("conflict_hashes", 1), ("pre_contact", 3)}
    with pytest.raises(ValueError):
        phases.build(phase_rows(spark, rows), 1)


def test_phase_reasons(spark):
    rows = [("contact", False, True, 400.0, 100.0, 300.0, 200.0), ("contact", True, False, 400.0, 100.0, 300.0, 200.0), ("pre_contact", False, True, 0.0, 0.0, 1.0, 1.0), ("pre_contact", False, True, 400.0, 100.0, 5.0, 5.0), ("pre_contact", False, True, 400.0, 100.0, 300.0, 200.0)]
    f = frame(spark, [(*r, 1280, 720) for r in rows], "phase string, contacting boolean, media_present boolean, x double, y double, w double, h double, image_width int, image_height int")
    assert [r["reason"] for r in phases.reasons(f).collect()] == ["no_positive_contacting_hand", "missing_media", "box_outside_encoder_crop", "box_below_minimum_token_mass", None]


# ---- validation


VALID = dict(
    observation_id="o1", dataset_revision="r", source_video_id="v1", physical_object_id="p", object_category_manual="door", state_family="f", state_label="open", stable_segment_id="s",
    transition_id="t", media_relpath="data/v.mp4", media_type="video", start_frame=10, end_frame=39, sampled_frame_indices=list(range(10, 26)), fps=30.0, state_observable=True, identity_verified=True,
    box_annotation_relpath="b.json", mask_annotation_relpath=None, mask_available=False, coordinate_space="c", nuisance_tags=["n"], review_status="approved", media_sha256="b" * 64, perceptual_hash="h",
    duplicate_group_id="d", verified_asset_group_id=None,
)
SCHEMA = ", ".join(f"{k} " + {int: "long", float: "double", bool: "boolean", list: "array<string>"}.get(type(v), "string") for k, v in VALID.items()).replace("sampled_frame_indices array<string>", "sampled_frame_indices array<long>")


def manifest(spark, *changes):
    return frame(spark, [tuple((VALID | c).values()) for c in changes], SCHEMA)


def test_valid_manifest(spark):
    assert validation.validate_curated(manifest(spark, {})) == []
    assert validation.validate_curated(manifest(spark, {}).drop("fps")) == ["missing required column: fps"]


def test_broken_manifest(spark):
    errors = validation.validate_curated(manifest(spark, {"state_label": "before", "media_relpath": "C:\\data\\video.mp4"}, {"observation_id": "o2", "start_frame": None, "fps": float("nan")}, {"observation_id": "o2", "media_sha256": "B" * 63}))
    assert errors == [
        "2 rows have duplicate observation_id", "1 rows have generic/empty state labels", "1 rows have unsafe/non-POSIX media_relpath", "1 rows have invalid fps", "1 rows have invalid media_sha256", "1 rows have invalid 16-frame samples",
    ]
    with pytest.raises(validation.ManifestError):
        validation.raise_on_errors(errors, "x")


def test_generic_labels(spark):
    labels = ["", "unknown", "NA", "n/a", "state-3", "State_12", "post", "open", "before it", None]
    got = [r[0] for r in frame(spark, [(x,) for x in labels], "s string").select(P.is_generic_label(F.col("s"))).collect()]
    assert got == [True] * 7 + [False] * 3


def test_paths_and_predicates(spark):
    cases = {"a/b.mp4": True, "": False, "/a": False, "a\\b": False, "C:x": False, "a/../b": False, "..a/b": True, None: False}
    got = [r[0] for r in frame(spark, [(k,) for k in cases], "s string").select(P.safe_relative_path(F.col("s"))).collect()]
    assert got == list(cases.values())
    f = frame(spark, [(True,), (False,), (None,)], "mask_available boolean")
    assert P.subset_filter(f, " Mask_Available = TRUE ").count() == 1 and P.subset_filter(f, "mask_available=false").count() == 1
    with pytest.raises(ValueError):
        P.subset_filter(f, "1=1")


def test_feature_inputs(spark):
    f = frame(spark, [("a", 1, 2), ("a", 1, 2)], "observation_id string, state_label int, other int")
    assert validation.validate_feature_inputs(f, ["observation_id", "fps"], ["state_label"]) == [
        "forbidden feature-input column: state_label", "unexpected feature-input column: other", "unexpected feature-input column: state_label", "missing feature-input column: fps", "2 rows have duplicate observation_id",
    ]


# ---- evaluation


def test_retrieval_blocks(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 5)), rng.integers(0, 4, 60)
    f = frame(spark, [(i, [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, v array<double>, y int")
    old = evaluation.CELL_ROWS, evaluation.CELL_QUERIES
    evaluation.CELL_ROWS, evaluation.CELL_QUERIES = 17, 11
    try:
        got = {r["id"]: r["rank"] for r in evaluation.retrieval_ranks(f, f, "id", "v", "y").collect()}
    finally:
        evaluation.CELL_ROWS, evaluation.CELL_QUERIES = old
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-round(float(u[i] @ u[j]), 12), j))
        ranks = [k for k, j in enumerate(order, 1) if y[j] == y[i]]
        assert got.get(i) == (ranks[0] if ranks else None)


def test_shuffled_blocks_and_ipf(spark):
    rows = [(i, "ab"[i % 2], f"y{i % 3}") for i in range(30)] + [(99, "c", "y0")]
    f = frame(spark, rows, "id long, stratum string, y string")
    s = evaluation.shuffled_blocks(f, ["stratum"], "y", "id", 5).collect()
    assert len(s) == 30 and sorted(r["permuted"] for r in s) == sorted(r["y"] for r in s) and any(r["permuted"] != r["y"] for r in s)
    w = evaluation.ipf_weights(f.where("stratum <> 'c'"), "stratum", "y").collect()
    assert all(math.isfinite(r["weight"]) for r in w)


def test_spearman_and_gates(spark):
    f = frame(spark, [(float(i), float(i**3)) for i in range(20)], "a double, b double")
    assert evaluation.spearman(f, "a", "b").first()["spearman"] == pytest.approx(1.0)
    g = evaluation.gates({"a": (0.5, "<", 0.9), "b": (0.1, ">=", 0.5), "c": (1.0, ">", 0.0)}, spark).orderBy("position").collect()
    assert [(r["passes"], r["blocked"]) for r in g] == [(True, False), (False, False), (True, True)]


def test_candidate_triplets(spark):
    rows = [("a", "obj", "open", 0, 9), ("b", "obj", "open", 20, 29), ("c", "obj", "closed", 21, 30), ("d", "obj", "closed", 60, 69), ("e", "other", "open", 0, 9), ("f", "obj", "closed", -20, -11)]
    f = frame(spark, rows, "observation_id string, physical_object_id string, state_label string, start_frame long, end_frame long")
    got = {tuple(r)[1:4] for r in triplets.candidate_triplets(f).collect()}
    assert ("a", "b", "f") in got and not any(t[2] == "d" for t in got if t[0] == "a") and ("a", "b", "c") not in got


def test_candidate_triplets_of_whole_tracks(spark, monkeypatch):
    from cohortgeo.plans import catalogue

    runs = [(t, k, "abc"[(k * k + k // 3 + t) % 3], 7 * k + k % 4, 7 * k + k % 4 + 4) for t in (1, 2) for k in range(20)]
    monkeypatch.setattr(catalogue.X, "frames", lambda *_: None)
    monkeypatch.setattr(catalogue.segments, "label_runs", lambda _: frame(spark, runs, "sequence_id long, run_index long, label string, start long, end long"))
    apart = lambda a, b: a[4] < b[3] or b[4] < a[3]
    gap = lambda a, b: abs(a[3] + a[4] - b[3] - b[4]) / 2
    want = {
        tuple(f"{x[0]}_{x[1]}" for x in (a, n, s))
        for a in runs for n in runs for s in runs
        if a[0] == n[0] == s[0] and a != n and a[2] == n[2] != s[2] and apart(a, n) and apart(a, s) and apart(n, s) and abs(gap(a, n) - gap(a, s)) <= 2
    }
    got = [tuple(r)[1:4] for r in catalogue.queries()["candidate_triplets"](spark, "").collect()]
    assert set(got) == want and len(got) == len(want) and any(int(i.split("_")[1]) >= 12 for t in want for i in t)


def test_agreement_and_ranges(spark):
    f = frame(spark, [(u, v) for u, vs in (("a", "xx"), ("b", "xy"), ("c", "yy"), ("d", "x")) for v in vs], "u string, v string")
    # Observed disagreement 2/6, expected (36 - 18) / (6 * 5).
    assert segments.krippendorff(f, "u", "v").first()["alpha"] == pytest.approx(1 - (2 / 6) / (18 / 30))
    t = frame(spark, [(float(i),) for i in range(50)], "t double")
    c = frame(spark, [(10.5,), (49.0,)], "c double")
    got = segments.around(t, "t", c, "c", 3.0).groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in got} == {10.5: 6, 49.0: 4}


def test_hashing(tmp_path):
    assert hashing.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'.encode()
    hashing.write_json(tmp_path / "x.json", {"b": 1})
    assert (tmp_path / "x.json").read_text() == '{\n  "b": 1\n}\n'
    with pytest.raises(ValueError):
        hashing.inside(tmp_path, "../x")
    assert struct.calcsize(">I") == 4

"""Fused detectors, masks, registries, reference plans and reports on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.operators import bank, detectors, fused, maps, references, reports, scorers
from lattiq.sources import readers


def patches(spark, images=4, seed=0, dim=6):
    rng = np.random.default_rng(seed)
    data = [(i * 20 + r * 5 + c, i, r, c, rng.normal(size=dim).tolist()) for i in range(images) for r in range(4) for c in range(5)]
    return spark.createDataFrame(data, "id long, image_id long, row long, col long, features array<double>"), data


def test_mask_of_a_foreground_keeps_its_border(spark):
    """A mask that is dilated to the whole grid isn't eaten by the closing; the flip takes the negated component."""
    inner = [(0, r, c, [40.0 if 0 < r < 3 and 0 < c < 4 else -40.0, 0.0]) for r in range(4) for c in range(5)]
    corner = [(1, r, c, [-90.0 if (r, c) == (0, 0) else 5.0, 0.0]) for r in range(4) for c in range(5)]
    rows = spark.createDataFrame(inner + corner, "image_id long, row long, col long, features array<double>")
    got = {(r.image_id, r.row, r.col): r.keep for r in detectors.pca_mask(rows, 4, 5).collect()}
    assert all(got[0, r, c] for r in range(4) for c in range(5))
    # the component is 90 below its mean in a corner only; the centre is empty above 10, so the negated one counts
    assert [(r, c) for r in range(4) for c in range(5) if got[1, r, c]] == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_registry(spark):
    def of(mode, custom=None):
        return {(r.dataset, r.object): (r.masking, r.rotation, r.anomalies) for r in readers.registry(spark, mode, custom).collect()}

    informed = of("informed", {"own": {"bolt": ["bent"]}})
    assert {o for (d, o), v in informed.items() if d == "mvtec" and v[0]} == set(readers.MASKED)
    assert informed["mvtec", "screw"][1] and not informed["mvtec", "pill"][1] and informed["visa", "pcb1"] == (True, False, ["bad"])
    assert informed["own", "bolt"] == (False, True, ["bent"]) and informed["mvtec", "tile"][2][0] == "crack"
    assert all(v[1] for v in of("agnostic").values()) and not any(v[0] for v in of("agnostic_no_mask").values())
    assert not any(v[1] for v in of("masking_only").values()) and all(v[0] and v[1] for v in of("force_mask_rotation").values())
    assert not any(v[0] or v[1] for v in of("force_no_mask_no_rotation").values())
    with pytest.raises(ValueError):
        of("other")


def test_reduced_mahalanobis(spark):
    rows, data = patches(spark, 5)
    found = detectors.build("reduced_mahalanobis", components=3).fit(rows.filter("image_id < 4")).transform(rows.filter("image_id = 4"))
    x = np.array([d[4] for d in data]).reshape(5, 20, 6)
    flat = x[:4].reshape(-1, 6)
    axes = np.linalg.svd(flat - flat.mean(0), full_matrices=False)[2][:3].T
    z = (x - flat.mean(0)) @ axes
    want = np.sqrt((((z[4] - z[:4].mean(0)) ** 2) / (z[:4].var(0, ddof=1) + 1e-5)).sum(1))
    assert np.allclose([r.score for r in found.orderBy("id").collect()], want)


def test_whitened_components_and_layers(spark):
    rows, data = patches(spark)
    z = fused.Reduced(2, whiten=True).fit(rows).transform(rows).select("features").toPandas()["features"]
    assert np.allclose(np.std(np.stack(z), axis=0, ddof=1), 1)
    both = fused.joined_layers([rows, rows.withColumn("features", F.transform("features", lambda v: -v))]).orderBy("id").first()
    assert both.features == data[0][4] + [-v for v in data[0][4]]


def test_fused_detectors(spark):
    rows, _ = patches(spark)
    att = spark.createDataFrame([(i, layer, h, q, k, float((i + q * k + h + layer) % 5 + 1)) for i in range(4) for layer in range(2) for h in range(2) for q in range(21) for k in range(21)], "image_id long, layer int, head int, q long, k long, w double")
    ref, new = rows.filter("image_id < 3"), rows.filter("image_id = 3")
    for name, how in (("knn_rollout", {"coreset_ratio": 0.5}), ("forest_rollout", {"trees": 4})):
        found = detectors.build(name, attention=att, width=5, height=4, last_layers=1, neighbours=True, **how).fit(ref).transform(new)
        assert found.columns == ["id", "image_id", "row", "col", "score"] and found.count() == 20
    cls = rows.filter("row = 0 AND col = 0").select("image_id", F.col("features").alias("cls"))
    assert detectors.build("cls_cosine", tokens=cls).fit(None).transform(new).filter("row = 0 AND col = 0").first().score == pytest.approx(1, abs=1e-6)
    assert detectors.build("cls_cosine", tokens=cls, mode="prototype").fit(ref).transform(new).count() == 20
    assert detectors.build("ensemble", members=[("vector_norm", {}), ("sobel", {})]).fit(ref).transform(new).agg(F.abs(F.avg("score"))).first()[0] < 1e-6
    two = lambda df: df.withColumn("other", F.col("features")).withColumn("keep", F.col("col") > 0)
    got = detectors.build("branch_forest", components=2, trees=4).fit(two(ref)).transform(two(new)).collect()
    assert all((r.score == 0) == (r.col == 0) for r in got)
    with pytest.raises(ValueError):
        detectors.build("cls_cosine", tokens=cls, mode="prototype").fit(None)
    with pytest.raises(ValueError):
        detectors.build("ensemble", members=[])


def test_classes_in_one_search(spark):
    rows, data = patches(spark)
    own = rows.withColumn("class_id", (F.col("id") % 3).cast("int"))
    from lattiq.operators import knn

    found = {(r.query_id, r.class_id): r.dist for r in knn.class_scores(rows.filter("image_id = 0"), own.filter("image_id > 0")).collect()}
    x = np.array([d[4] for d in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(20):
        for c in range(3):
            assert found[q, c] == pytest.approx(min(1 - x[q] @ x[b] for b in range(20, 80) if b % 3 == c))
    assert knn.class_scores(rows, own.limit(0)).count() == 0
    assert {(r.query_id, r.class_id) for r in knn.class_scores(rows.filter("image_id = 0"), own.filter("image_id > 0"), limit_bytes=0).collect()} == set(found)


def test_calibration_report(spark):
    rng = np.random.default_rng(3)
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "score double")
    held, cross, scores = rng.random(200), rng.random(300), rng.random(400)
    truth = scores + rng.normal(0, 0.3, 400) > 0.7
    val = spark.createDataFrame([(float(s), bool(t)) for s, t in zip(scores, truth)], "score double, is_defect boolean")
    row = reports.calibration_row(frame(held), frame(cross), val)
    report = reports.calibration_report(row, "clean", "final", ["a"], metadata={"fold": 1})
    assert report["candidate_acceptance"]["threshold"] == pytest.approx(np.percentile(held, 99)) and report["candidate_acceptance"]["n_scores"] == 200
    tau = np.percentile(cross, 99.5)
    assert report["query_operating_point"]["threshold"] == pytest.approx(tau) and report["confusion"]["tp"] == int((truth & (scores >= tau)).sum())
    best = max((2 * (truth & (scores >= t)).sum() / (truth.sum() + (scores >= t).sum()), t) for t in scores)
    assert report["f1_max_operating_point"]["f1"] == pytest.approx(best[0]) and report["f1_max_operating_point"]["threshold"] == pytest.approx(best[1])
    assert report["score_quantiles"]["validation_positive"]["p50"] == pytest.approx(np.median(scores[truth]))
    assert reports.check_binding(report, "final", "a") == pytest.approx(tau)
    with pytest.raises(ValueError):
        reports.check_binding(report, "final", "b")
    with pytest.raises(ValueError):
        reports.check_binding({**report, "metadata": {}}, "final", "a")
    with pytest.raises(ValueError):
        reports.calibration_report(row, "clean", "final", exclusion="none")


def test_cross_fit_against_both_banks(spark):
    rows, data = patches(spark)
    a, b = reports.cross_fit_both(rows.filter("image_id < 2"), rows)
    x = np.array([d[4] for d in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    low = lambda q, of: min(1 - x[q] @ x[i] for i in range(80) if i // 20 in of and i // 20 != q // 20)
    assert {r.query_id: round(r.score, 9) for r in a.collect()} == {q: round(low(q, (0, 1)), 9) for q in range(40)}
    assert {r.query_id: round(r.score, 9) for r in b.collect()} == {q: round(low(q, (0, 1, 2, 3)), 9) for q in range(40)}
    with pytest.raises(ValueError):
        reports.cross_fit_both(rows, rows.filter("image_id > 0"))


def test_reference_plans(spark):
    train = spark.createDataFrame([(f"i{i:02d}", i % 3 != 0) for i in range(30)], "image_id string, has_defect boolean")
    members = spark.createDataFrame([(f"i{i:02d}", i % 4 + 1) for i in range(30) if i % 3], "image_id string, class_id int")
    val = spark.createDataFrame([("v1",)], "image_id string")
    plan = references.reference_plan(train, val, members, "contaminated_all", 42, 2, 8)
    got = {r.image_id: r for r in plan.collect()}
    assert sorted(r.part for r in got.values()) == ["additional"] * 8 + ["clean"] * 2
    assert all(r.has_defect == (r.part == "additional") and len(r.classes) == (r.part == "additional") for r in got.values())
    assert references.reference_plan(train, val, members, "clean", 1, 3).count() == 3
    assert references.reference_plan(train, val, members, "class_balanced_all", 1, 0).count() == 8
    first = references.additional_references(train, members, 8, 5)
    more = references.additional_references(train, members, 8, 5, exclude=first.limit(3))
    assert more.count() == 8 and more.join(first.limit(3), "image_id").count() == 0
    ids = sorted(r.image_id for r in train.collect())
    picked = [r.image_id for r in references.pool_pick(train, 7, 9).orderBy("place").collect()]
    assert picked == [ids[(9 * 7 % 30 + j) % 30] for j in range(7)]
    assert references.training_ids(train, members, None, 1).count() == 30 and references.training_ids(train, members, -1, 1).count() == 20
    with pytest.raises(ValueError):
        references.reference_plan(train, train, members, "clean", 1)


def test_masks_and_ratios(spark):
    rows, _ = patches(spark)
    with pytest.raises(ValueError):
        bank.keep_mask(rows, spark.createDataFrame([(999,)], "id long"))
    assert bank.coreset_by_ratio(rows, 0.25).count() == 20 and bank.coreset_by_ratio(rows, 1.5).count() == 80 and bank.coreset_by_ratio(rows, 0.5, total=7).count() == 7
    pixels = spark.createDataFrame([(1, y, x, float(y == 2 and x == 2)) for y in range(5) for x in range(5)], "image_id long, y long, x long, score double")
    assert 0 < maps.max_of_smoothed(pixels, 5, 5, 1.0).first().score < 1
    with pytest.raises(ValueError):
        scorers.score("nothing", {})
    with pytest.raises(ValueError):
        scorers.score("sobel_image", {"patches": rows})


def test_tuned_ensembles(spark):
    from lattiq.plans import studies

    rng = np.random.default_rng(5)
    n = 400
    truth = rng.random(n) < 0.3
    a, b = truth + rng.normal(0, 0.4, n), rng.normal(0, 1, n)
    frame = lambda v: spark.createDataFrame([(i, i // 20, float(x)) for i, x in enumerate(v)], "id long, image_id long, score double")
    labels = spark.createDataFrame([(i, i // 100, bool(t)) for i, t in enumerate(truth)], "id long, fold long, is_defect boolean")
    best, bench = studies.tune_ensemble(frame(a), frame(b), labels)
    best = best.first()
    z = lambda v: np.concatenate([(p - p.mean()) / (p.std() + 1e-8) for p in v.reshape(-1, 20)])
    mixed = best.weight * z(a) + (1 - best.weight) * z(b)
    assert best.weight >= 0.7 and best.recall >= 0.7 and best.recall == pytest.approx((truth & (mixed >= best.threshold))[:100].sum() / truth[:100].sum())
    for r in bench.collect():
        of = slice(100 * r.fold, 100 * r.fold + 100)
        assert r.fold > 0 and r.tp == (truth & (mixed >= best.threshold))[of].sum() and r.fp == (~truth & (mixed >= best.threshold))[of].sum()


def test_controls_and_traces(spark):
    from lattiq.plans import studies

    runs = spark.createDataFrame([("clean", 0, 42, 0.5, 0.4, 1.0, False), ("trim", 0, 42, 0.6, 0.5, 1.2, False), ("auto", 0, 42, 0.7, 0.3, 0.9, False), ("random", 0, 42, 0.9, 0.9, 1.0, True)], "name string, fold int, seed int, auprc double, fixed_f1 double, query_threshold double, is_random boolean")
    got = {r.name: r for r in studies.against_clean(runs).collect()}
    assert got["auto"].rank == 1 and got["trim"].rank == 2 and got["random"].rank is None and got["trim"].threshold_delta == pytest.approx(0.2)
    with pytest.raises(ValueError):
        studies.against_clean(runs.filter("name <> 'clean'"))
    rows, _ = patches(spark)
    made = bank.contaminate_by_replacement(rows.filter("image_id < 2"), rows.filter("image_id = 2").withColumn("id", F.col("id") + 1000), 0.25, 1)
    traces = studies.contamination_traces(rows.filter("image_id = 3"), made, 3).collect()
    assert sum(r.n for r in traces) == 60 and {r.source for r in traces} == {"clean", "anomalous"}
    assert [p["rollout_weight"] for p in studies.attention_plan()] == [0.0, 0.1, 0.2, 0.3, None]


def test_probe_history_and_class_head(spark, tmp_path):
    from lattiq.sources import writers

    rng = np.random.default_rng(6)
    data = [(i, 0, 0, 0, (rng.normal(size=3) + (3 if i % 3 else 0) * np.eye(3)[i % 3]).tolist(), i % 3, bool(i % 3)) for i in range(300)]
    rows = spark.createDataFrame(data, "id long, image_id long, row long, col long, features array<double>, class_id int, is_defect boolean")
    probe = detectors.build("class_probe", probe=detectors.build("focal_probe", gamma=0.0, alpha=0.5, epochs=10)).fit(rows)
    loss = [h["loss"] for h in probe.probe.history]
    assert len(loss) == 10 and loss[-1] < loss[0] and 0 <= probe.probe.threshold <= 1
    got = probe.transform(rows).join(rows.select("id", "class_id", "is_defect"), "id").collect()
    assert np.mean([r.pred_class == r.class_id for r in got if r.is_defect]) > 0.9 and np.mean([(r.score >= probe.probe.threshold) == r.is_defect for r in got]) > 0.8
    again = detectors.build("focal_probe").restore(probe.probe.state())
    assert again.transform(rows).orderBy("id").first().score == probe.probe.transform(rows).orderBy("id").first().score
    writers.write_history(spark, [{"epoch": 1, "loss": 0.123456789}, {"epoch": 2, "loss": float("nan"), "f1": 0.5}], str(tmp_path / "h"))
    assert [r.value for r in spark.read.text(str(tmp_path / "h/history.json")).collect()] == ['{"epoch": 1, "loss": 0.123456789}', '{"epoch": 2, "loss": null, "f1": 0.5}']
    table = spark.read.option("header", "true").csv(str(tmp_path / "h/history.csv"))
    assert table.columns == ["epoch", "loss", "f1"] and [tuple(r) for r in table.collect()] == [("1", "0.12345679", None), ("2", None, "0.5")]


def test_manifests(spark, tmp_path):
    from lattiq.operators import sampling

    m = sampling.manifest({"clean": ["a", "b"], "defect": ["c"], "validation": ["d"]}, fold=0, seed=42)
    sampling.save_manifest(spark, m, str(tmp_path / "m"))
    assert sampling.load_manifest(spark, str(tmp_path / "m")) == m
    assert sampling.manifest_inputs(m, "clean") == {"clean": ["a", "b"], "additional": []} and sampling.manifest_inputs(m, "auto_purified")["additional"] == ["c"]
    with pytest.raises(ValueError):
        sampling.manifest_inputs(m, "none")
    with pytest.raises(ValueError):
        sampling.save_manifest(spark, {**m, "fold": 1}, str(tmp_path / "n"))


def test_gradient_image(spark):
    rows = [(1, y, x, float(10 * (x > 2)), 0.0, 0.0) for y in range(5) for x in range(6)] + [(2, 0, x, 7.0, 7.0, 7.0) for x in range(3)]
    got = {(r.image_id, r.y, r.x): r.value for r in maps.gradient_image(spark.createDataFrame(rows, "image_id long, y long, x long, r double, g double, b double")).collect()}
    assert {x for (i, y, x), v in got.items() if i == 1 and v == 255} == {2, 3} and all(v == 0 for (i, _, x), v in got.items() if i == 2 or x not in (2, 3))


def test_coreset_by_plain_search(spark):
    rows, data = patches(spark, 4, seed=8)
    x = np.array([d[4] for d in data])
    picked = [0]
    while len(picked) < 12:
        picked.append(int(np.argmax([min(np.linalg.norm(v - x[p]) for p in picked) for v in x])))
    assert [r.id for r in bank.coreset(rows, 12).orderBy("pick").collect()] == picked


def test_colours_are_components(spark):
    rows, data = patches(spark, 2, seed=9)
    got = {(r.image_id, r.row, r.col): (r.r, r.g, r.b) for r in maps.pca_colours(rows).collect()}
    x = np.array([d[4] for d in data]).reshape(2, 20, 6)
    for i in range(2):
        z = (x[i] - x[i].mean(0)) @ np.linalg.svd(x[i] - x[i].mean(0), full_matrices=False)[2][:3].T
        z = (z - z.min(0)) / (z.max(0) - z.min(0))
        mine = np.array([got[i, r, c] for r in range(4) for c in range(5)])
        assert all(np.allclose(mine[:, j], z[:, j]) or np.allclose(mine[:, j], 1 - z[:, j]) for j in range(3))


def test_forest_paths(spark):
    rows, data = patches(spark, 4, seed=10)
    forest = detectors.build("isolation_forest", trees=5, sample=32).fit(rows)

    def depth(tree, v, at=0, steps=0):
        dim, cut, left, right, length = tree[int(at)]
        return length if dim < 0 else depth(tree, v, left if v[int(dim)] < cut else right, steps + 1)

    want = {d[0]: 2.0 ** (-np.mean([depth(t, d[4]) for t in forest.forest]) / forest.norm) for d in data}
    assert {r.id: pytest.approx(r.score) for r in forest.transform(rows).collect()} == want


def test_bootstrap_by_plain_draws(spark):
    from lattiq.operators import study

    values = [float(x) for x in np.random.default_rng(11).random(40)]
    rows = spark.createDataFrame([("m", f"c{i % 4}", v) for i, v in enumerate(values)], "metric string, condition string, value double")
    rng = np.random.default_rng(12)
    plain = np.percentile([rng.choice(values, 40).mean() for _ in range(4000)], [2.5, 97.5])
    got = study.bootstrap(rows, ["metric"], n_boot=4000).first()
    assert got.mean == pytest.approx(np.mean(values)) and np.allclose([got.ci_low, got.ci_high], plain, atol=0.02)
    parts = [np.array(values[i::4]) for i in range(4)]
    plain = np.percentile([np.concatenate([rng.choice(parts[i], 10) for i in rng.integers(0, 4, 4)]).mean() for _ in range(4000)], [2.5, 97.5])
    got = study.bootstrap(rows, ["metric"], n_boot=4000, group="condition").first()
    assert np.allclose([got.ci_low, got.ci_high], plain, atol=0.03)

"""Hand-checked values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.operators import bank, calibration, detectors, geometry, grid, knn, ranking, sampling, study
from lattiq.sources import readers, writers


def scores(spark, rows):
    return spark.createDataFrame(rows, "score double, is_defect boolean")


def one(df):
    return df.first().asDict()


def test_percentiles_are_linear(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "score double")
    assert calibration.threshold_at(rows, 75.0).first()[0] == 3.25
    rows = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.4,)], "score double")
    assert math.isclose(calibration.threshold_at(rows, 50.0).first()[0], 0.25)
    stored = calibration.summary(rows)
    assert math.isclose(calibration.threshold_at(rows, 50.0, stored).first()[0], 0.25)


def test_f1_max_takes_the_highest_of_equal_thresholds(spark):
    rows = scores(spark, [(0.1, False), (0.2, True), (0.3, False), (0.4, True)])
    got = one(ranking.ranking(rows))
    assert got["f1_threshold"] == 0.2 and got["n_pos"] == 2
    fixed = one(ranking.fixed_threshold(rows, 0.25))
    assert (fixed["precision"], fixed["recall"], fixed["n_gt_pos"], fixed["n_pred_pos"]) == (0.5, 0.5, 2, 2)


def test_confusion(spark):
    rows = spark.createDataFrame([(True, True), (False, False), (True, False), (True, True)], "t boolean, p boolean")
    got = one(ranking.with_prf(ranking.confusion(rows, F.col("t"), F.col("p"))))
    assert (got["tp"], got["fp"], got["fn"], got["precision"]) == (2, 0, 1, 1.0) and math.isclose(got["recall"], 2 / 3)


def test_zero_denominators(spark):
    rows = spark.createDataFrame([(False, False)], "t boolean, p boolean")
    counts = ranking.confusion(rows, F.col("t"), F.col("p"))
    assert one(ranking.with_prf(counts))["precision"] is None and one(ranking.with_prf(counts, zero=True))["f1"] == 0.0


@pytest.mark.parametrize("rule, n", [("any", 3), ("ratio_10", 2), ("ratio_50", 1)])
def test_overlap_rules(spark, rule, n):
    rows = spark.createDataFrame([(0.0,), (0.05,), (0.20,), (0.60,)], "o double")
    assert rows.filter(bank.overlap_rule(F.col("o"), rule)).count() == n


def test_rejection_quality(spark):
    rows = spark.createDataFrame([(0.0, True), (0.05, True), (0.20, False), (0.60, True)], "o double, auto boolean")
    got = one(bank.rejection_quality(rows, F.col("o") > 0, F.col("o") >= 0.1))
    assert [round(got[k], 6) for k in ("normal_retention", "anomaly_recall", "rejected_precision", "contamination")] == [1.0, 0.666667, 1.0, 0.5]
    got = one(bank.rejection_quality(rows, F.col("o") > 0, F.col("auto")))
    assert [round(got[k], 6) for k in ("normal_retention", "anomaly_recall", "rejected_precision", "contamination")] == [0.0, 0.666667, 0.666667, 1.0]


def test_leave_one_image_out(spark):
    rows = [(i, i // 3, [0.1 * (i % 3) + 5.0 * (i // 3), 5.0 * (i // 3)]) for i in range(6)]
    got = knn.left_out(spark.createDataFrame(rows, "id long, image_id long, features array<double>"), "image_id", "l2").collect()
    assert len(got) == 6 and all(r.score > 1 for r in got)


def test_strategies_agree(spark):
    rng = np.random.default_rng(0)
    make = lambda n: spark.createDataFrame([(i, i % 3, rng.normal(size=5).tolist()) for i in range(n)], "id long, grp long, features array<double>")
    q, b = make(20).cache(), make(50).cache()
    for metric in ("cosine", "l2"):
        found = [sorted((r.query_id, r.rank, r.bank_id, round(r.dist, 9)) for r in knn.nearest(q, b, 3, metric, strategy=s).collect()) for s in ("auto", "blocks", "sql")]
        assert found[0] == found[1] == found[2] and len(found[0]) == 60


def test_trim_and_random(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate((0.05, 1.0, 5.0, 0.0))], "id long, score double")
    kept = bank.trim(rows, 0.5, ["id"]).collect()
    assert sorted(r.id for r in kept) == [0, 3] and kept[0].accept_threshold == 0.05
    assert bank.random_keep(rows, 2, "x", 1).count() == 2 and bank.random_keep(rows, 9, "x", 1).count() == 4


def test_replacement_keeps_the_size(spark):
    clean = spark.range(100).withColumn("class_id", F.lit(0))
    pool = spark.range(1000, 1050).withColumn("class_id", F.lit(1))
    got = bank.contaminate_by_replacement(clean, pool, 0.1, 0)
    assert got.count() == 100 and got.filter("source = 'anomalous'").count() == 10 and got.filter("source = 'anomalous' AND class_id = 1 AND id >= 1000").count() == 10


def test_ground_truth_needs_a_flag(spark):
    rows = spark.createDataFrame([(1, 0, 0.5)], "id long, class_id int, overlap double")
    with pytest.raises(PermissionError):
        bank.oracle_keep(rows, 0.1)
    with pytest.raises(PermissionError):
        bank.select_anomalies(rows, "any")
    assert bank.oracle_keep(rows, 0.1, allow_oracle=True).first().keep is False


def test_geometry(spark):
    shape = spark.range(1).select(*[c.alias(n) for n, c in geometry.grid_shape(F.lit(256), F.lit(1600)).items()])
    assert one(shape) == {"proc_height": 448, "proc_width": 2800, "grid_rows": 32, "grid_cols": 200}
    rle = spark.createDataFrame([("a", 1, "3 2 10 1")], "image_id string, class_id int, rle string")
    assert sorted(r.px for r in geometry.rle_pixels(rle, 256).collect()) == [2, 3, 9]
    assert geometry.rle_encode(geometry.rle_pixels(rle, 256)).first().rle == "3 2 10 1"


def test_components_and_cleanup(spark):
    cells = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 3, 3)], "image_id long, row long, col long")
    assert geometry.components(cells, 8).select("component").distinct().count() == 2
    assert geometry.components(cells, 4).select("component").distinct().count() == 3
    grid_ = spark.createDataFrame([(0, r, c, (r, c) != (1, 1)) for r in range(3) for c in range(3)], "image_id long, row long, col long, keep boolean")
    assert geometry.spatial_cleanup(grid_, 2).filter("keep").count() == 9
    box = one(geometry.component_boxes(geometry.components(spark.createDataFrame([(0, r, c) for r in (1, 2) for c in (2, 3)], "image_id long, row long, col long")), 14, 256 / 56, 1600 / 56))
    assert (box["area"], round(box["x1"], 6), round(box["y2"], 6)) == (4, 800.0, 192.0)


def test_separability(spark):
    rows = scores(spark, [(0.0, False)] * 3 + [(1.0, True)] * 3)
    got = one(ranking.separability(rows))
    assert got["auroc"] == 1.0 and got["ks"] == 1.0 and got["wasserstein"] == 1.0 and got["cohens_d"] is None
    assert one(ranking.ranking(scores(spark, [(0.5, True)])))["auroc"] is None


def test_random_ranking_against_numpy(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 40, 500) / 40.0, rng.random(500) < 0.3
    got = one(ranking.ranking(scores(spark, [(float(a), bool(b)) for a, b in zip(s, y)])))
    pairs = (s[y][:, None] > s[~y][None, :]).mean() + 0.5 * (s[y][:, None] == s[~y][None, :]).mean()
    ap, r0 = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        r = (y & (s >= t)).sum() / y.sum()
        ap, r0 = ap + (r - r0) * (y & (s >= t)).sum() / (s >= t).sum(), r
    assert math.isclose(got["auroc"], pairs, abs_tol=1e-12) and math.isclose(got["average_precision"], ap, abs_tol=1e-12)


def test_circular_pick(spark):
    items = spark.createDataFrame([(x,) for x in "dbca"], "image_id string")
    assert [r.image_id for r in sampling.circular_pick(items, 2, 0).orderBy("pick").collect()] == ["a", "b"]
    assert [r.image_id for r in sampling.circular_pick(items, 3, 1).orderBy("pick").collect()] == ["d", "a", "b"]


def test_manifest():
    m = sampling.manifest({"clean": ["a"], "defect": ["b"]}, seed=1)
    sampling.check_manifest(m)
    with pytest.raises(ValueError):
        sampling.check_manifest({**m, "seed": 2})
    with pytest.raises(ValueError):
        sampling.check_manifest(sampling.manifest({"clean": ["a"], "defect": ["a"]}))


def test_study(spark):
    assert study.contamination_conditions(spark).count() == 37
    rows = [(c, s, 0, base + 0.01 * s) for c, base in (("a", 0.2), ("b", 0.1)) for s in range(5)]
    runs = spark.createDataFrame(rows, "condition string, seed int, fold int, auprc double")
    got = one(study.sign_counts(study.paired_deltas(runs, "a", "b", ["auprc"])))
    assert (got["positive"], got["negative"], got["zero"]) == (5, 0, 0)
    ci = one(study.bootstrap(study.long_metrics(runs, ["auprc"]).filter("condition = 'a'"), ["metric"], n_boot=200))
    assert ci["ci_low"] <= ci["mean"] <= ci["ci_high"]


def test_coreset_is_farthest_first(spark):
    rows = spark.createDataFrame([(i, [x, 0.0]) for i, x in enumerate((0.0, 1.0, 5.0, 9.0))], "id long, features array<double>")
    assert [r.id for r in bank.coreset(rows, 3).orderBy("pick").collect()] == [0, 3, 2]


@pytest.mark.parametrize("name, params", [("knn_bank", {}), ("mahalanobis", {}), ("isolation_forest", {"trees": 20}), ("prototype", {}), ("linear_probe", {}), ("focal_probe", {"epochs": 10})])
def test_polarity(spark, name, params):
    rng = np.random.default_rng(2)
    make = lambda at, n, d: [(at + i, i % 4, i % 2, i % 3, (rng.normal(0, 0.1, 6) + np.eye(6)[0] + d * np.eye(6)[1]).tolist(), d > 0) for i in range(n)]
    schema = "id long, image_id long, row long, col long, features array<double>, is_defect boolean"
    clean, bad = make(0, 60, 0.0), make(1000, 30, 5.0)
    fit = clean + (bad if "probe" in name else [])
    got = detectors.build(name, **params).fit(spark.createDataFrame(fit, schema)).transform(spark.createDataFrame(make(2000, 20, 0.0) + make(3000, 20, 5.0), schema)).collect()
    assert np.mean([r.score for r in got if r.id >= 3000]) > np.mean([r.score for r in got if r.id < 3000])
    with pytest.raises(ValueError):
        detectors.build("none")


def test_neighbour_mean_repeats_edges(spark):
    x = np.arange(6.0).reshape(2, 3)
    rows = spark.createDataFrame([(0, r, c, [float(x[r, c])]) for r in range(2) for c in range(3)], "image_id long, row long, col long, features array<double>")
    p = np.pad(x, 1, mode="edge")
    want = {(r, c): p[r : r + 3, c : c + 3].mean() for r in range(2) for c in range(3)}
    assert all(math.isclose(r.features[0], want[r.row, r.col]) for r in grid.neighbour_mean(rows, 2, 3).collect())


def test_readers_and_writers(spark, tmp_path):
    assert readers.load_annotations(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "img").mkdir()
    for n in ("b.jpg", "a.PNG", "c.txt"):
        (tmp_path / "img" / n).write_bytes(b"x")
    assert [r.image_id for r in readers.discover_images(spark, str(tmp_path / "img")).collect()] == ["a.PNG", "b.jpg"]
    (tmp_path / "folds.json").write_text('{"a": 0, "b": 1}')
    assert readers.load_folds(spark, str(tmp_path / "folds.json")).count() == 2
    with pytest.raises(ValueError):
        readers.load_folds(spark, str(tmp_path / "folds.json"), spark.createDataFrame([("z",)], "image_id string"))
    for run in ("f0_clean_s1", "f0_contam_s1"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "metrics.json").write_text('{"patch": {"auprc": 0.5}}')
    got = readers.load_metrics(spark, str(tmp_path / "runs"), {"auprc": "patch.auprc", "none": "patch.x.y"}, exclude="contam").collect()
    assert len(got) == 1 and got[0].auprc == "0.5" and got[0].none is None
    rows = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    writers.write_json(rows, str(tmp_path / "out.json"))
    assert spark.read.text(str(tmp_path / "out.json")).first()[0] == '{"a":1,"b":null}'
    writers.write_csv([rows, spark.createDataFrame([(2, [1, 2])], "a int, c array<int>")], str(tmp_path / "out.csv"))
    assert spark.read.csv(str(tmp_path / "out.csv"), header=True).columns == ["a", "b", "c"]
    prior = spark.createDataFrame([("x", 0, 1), ("y", 1, 2)], "name string, ord int, v int")
    new = spark.createDataFrame([("z", 0, 9), ("x", 1, 7)], "name string, ord int, v int")
    assert [(r.name, r.v) for r in writers.merge_rows(prior, new).orderBy("ord").collect()] == [("x", 7), ("y", 2), ("z", 9)]
    assert readers.layered({"a": {"b": 1, "c": 2}}, {"a": {"b": 3, "c": None}}) == {"a": {"b": 3, "c": 2}}


def test_maps(spark):
    from lattiq.operators import maps

    rng = np.random.default_rng(3)
    m = rng.random((7, 9))
    rows = spark.createDataFrame([(1, y, x, float(m[y, x])) for y in range(7) for x in range(9)], "image_id long, y long, x long, score double")
    w = np.array(geometry.gaussian(1.0))
    r = len(w) // 2
    p = np.pad(m, r, mode="symmetric")
    want = sum(w[i] * w[j] * p[i : i + 7, j : j + 9] for i in range(len(w)) for j in range(len(w)))
    assert all(math.isclose(x.score, want[x.y, x.x], abs_tol=1e-12) for x in maps.smooth(rows, 7, 9, 1.0).collect())
    z = np.pad(m, 1, mode="reflect")
    gx = sum(a * z[1 + dy : 8 + dy, 1 + dx : 10 + dx] for (dy, dx), (a, _) in grid.SOBEL.items())
    gy = sum(b * z[1 + dy : 8 + dy, 1 + dx : 10 + dx] for (dy, dx), (_, b) in grid.SOBEL.items())
    got = maps.image_sobel(rows.withColumnRenamed("score", "value"), 20, "max").first().score
    assert math.isclose(got, np.sqrt(gx**2 + gy**2).max())


def test_schemas(spark):
    from lattiq.sources import schema

    assert all(schema.empty(spark, n).count() == 0 for n in schema.SCHEMAS)
    with pytest.raises(ValueError):
        schema.conform(spark.range(1), "folds")
    assert schema.resolve_layers("last", 12) == [11] and schema.resolve_layers([-1, 3], 12) == [3, 11] and len(schema.resolve_layers("all", 4)) == 4


def test_folds_are_even(spark):
    items = spark.range(1000).withColumnRenamed("id", "image_id").withColumn("label", F.col("image_id") % 3)
    got = sampling.hash_folds(items, 5, 1, "label").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in got)[0] >= 198 and len(got) == 5


def test_stream(spark, tmp_path):
    from lattiq.streaming import scoring

    folder = "/root/testdata/sf0.001"
    rows = scoring.error_rates(scoring.thresholded(scoring.event_stream(spark, folder), 50.0))
    out = scoring.drain(rows, "rates", str(tmp_path / "ck"))
    assert out.selectExpr("sum(n)").first()[0] == spark.read.parquet(f"{folder}/events.parquet").count()

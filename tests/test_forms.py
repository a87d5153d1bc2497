"""Operators held against plain versions of the forms they must have: rollout with discard, mirrored gradients, two banks, score
modes, picks, and percentiles by digits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.operators import bank, calibration, grid, maps, order, ranking, reports, sampling
from lattiq.operators.dual_bank import MODES, DualBank


def plain_rollout(matrices, discard, residual):
    total = None
    for a in matrices:
        a = a + np.eye(len(a)) if residual else a
        a = a / (a.sum(1, keepdims=True) + 1e-8)
        if discard > 0:
            a = np.where(a < np.percentile(a, 100 * (1 - discard)), 0, a)
            a = a / (a.sum(1, keepdims=True) + 1e-8)
        total = a if total is None else total @ a
    return total


@pytest.mark.parametrize("discard, residual, density", [(0.0, True, 1.0), (0.3, True, 1.0), (0.3, False, 1.0), (0.6, True, 0.4)])
def test_rollout(spark, discard, residual, density):
    rng = np.random.default_rng(1)
    made = rng.random((2, 3, 6, 6)) * (rng.random((2, 3, 6, 6)) < density)
    made[:, :, 5, 5] = 0.5  # the last token is in every table
    rows = [(i, 7 + x, q, k, float(made[i, x, q, k])) for i in range(2) for x in range(3) for q in range(6) for k in range(6) if made[i, x, q, k]]
    df = spark.createDataFrame(rows, "image_id long, layer int, q int, k int, w double")
    for starts, wanted in ((None, [0]), (F.lit(True), range(6))):
        got = np.zeros((2, 6, 6))
        for r in grid.rollout(df, discard, residual, starts).collect():
            got[r.image_id, r.q, r.k] = r.w
        for i in range(2):
            assert np.allclose(got[i][list(wanted)], plain_rollout(made[i], discard, residual)[list(wanted)], atol=1e-12)
    assert grid.rollout(df.limit(0), discard).count() == 0


def test_image_gradient_mirrors(spark):
    flat = spark.createDataFrame([(0, y, x, 100.0) for y in range(8) for x in range(8)], "image_id int, y int, x int, value double")
    assert {r.score for r in maps.image_sobel(flat, 4).collect()} == {0.0}
    row = spark.createDataFrame([(0, 0, x, float(x * x)) for x in range(5)], "image_id int, y int, x int, value double")
    got = [r.score for r in maps.image_sobel(row, 1).orderBy("col").collect()]
    assert got == [0.0, 16.0, 32.0, 48.0, 0.0]  # 4 (v[x + 1] - v[x - 1]), and 0 where both sides mirror


def plain_dual(normal, defects, reference, queries, weight, level):
    def dist(q, b):
        q, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, b))
        return (1 - q @ b.T).min(1)

    def robust(v):
        a, m, b = np.percentile(v, [25, 50, 75])
        return m, b - a if b - a > 1e-12 else 1.0

    near, raw = dist(reference, normal), dist(queries, normal)
    m, s = robust(near)
    z, gate = (raw - m) / s, np.percentile(near, level)
    values = {}
    for c, b in defects.items():
        m, s = robust(-dist(reference, b))
        values[c] = (-dist(queries, b) - m) / s
    kinds = sorted(values)
    best = np.argmax([values[c] for c in kinds], axis=0)
    value = np.array([values[kinds[c]][i] for i, c in enumerate(best)])
    far = np.array([dist(queries, defects[kinds[c]])[i] for i, c in enumerate(best)])
    return {"normal": z, "anomaly_diagnostic": value, "margin": z + weight * value, "ratio": z / np.maximum(far, 1e-8), "gated_hybrid": np.where(raw >= gate, z + weight * value, z)}, [kinds[c] for c in best]


def test_dual_bank(spark):
    rng = np.random.default_rng(2)
    frame = lambda x, c=0, at=0: spark.createDataFrame([(at + i, c, v.tolist()) for i, v in enumerate(x)], "id long, class_id int, features array<double>")
    normal, reference, queries = (rng.normal(size=(n, 5)) for n in (20, 30, 25))
    defects = {1: rng.normal(size=(6, 5)) + 1, 3: rng.normal(size=(4, 5)) - 1}
    banks = frame(defects[1], 1).unionByName(frame(defects[3], 3, 100))
    want, classes = plain_dual(normal, defects, reference, queries, 0.6, 90.0)
    for k in (1,):
        model = DualBank(frame(normal), banks, 0.6, 90.0, k).fit(frame(reference))
        rows = model.transform(frame(queries)).orderBy("id").collect()
        assert [r.predicted_class for r in rows] == classes and set(rows[0].d_anomaly) == {1, 3}
        for m in MODES:
            assert np.allclose([r[m] for r in rows], want[m])
    alone = DualBank(frame(normal)).transform(frame(queries)).orderBy("id").collect()
    assert all(r.predicted_class == 0 and r.margin == r.normal == r.d_normal == r.gated_hybrid for r in alone)
    two = DualBank(frame(normal), banks, k=2).fit(frame(reference)).transform(frame(queries))
    assert two.count() == 25 and all(r.anomaly_diagnostic is not None for r in two.collect())


def test_modes_start_from_calibrated_scores(spark):
    v = np.random.default_rng(3).random(40)
    df = spark.createDataFrame([(i // 20, i, float(x)) for i, x in enumerate(v)], "image_id int, id int, score double")
    facts = spark.createDataFrame([(0.25, 0.5)], "mean double, std double")
    z = (v - 0.25) / (0.5 + 1e-8)
    got = {m: np.array([r.mode_score for r in calibration.score_mode(df, m, facts).orderBy("id").collect()]) for m in ("raw", "zscore", "iqr", "percentile")}
    assert np.allclose(got["raw"], z) and np.allclose(got["zscore"], z)
    for i in (0, 1):
        own = z[20 * i : 20 * i + 20]
        a, b, p = np.percentile(own, [25, 75, 95])
        assert np.allclose(got["iqr"][20 * i : 20 * i + 20], (own - b) / (b - a + 1e-8) / 1.5)
        over = np.maximum(own - p, 0)
        assert np.allclose(got["percentile"][20 * i : 20 * i + 20], over / over.max())
    with pytest.raises(ValueError):
        calibration.score_mode(df, "other")


def test_picks(spark):
    ids = spark.createDataFrame([(1,), (1,), (2,), (3,)], "image_id int")
    assert len({r[0] for r in sampling.stable_select(ids, 2, "x", 0).collect()}) == 2
    clean, pool = (spark.createDataFrame([(i, float(i)) for i in r], "id long, score double") for r in (range(5), range(10, 13)))
    grown = bank.contaminate_by_growth(clean, pool, 1.0, 0).collect()
    assert sorted(r.id for r in grown) == [10, 11, 12] and {r.source for r in grown} == {"anomalous"}


@pytest.mark.parametrize("full", [1 << 21, 5])
def test_digits(spark, monkeypatch, full):
    """Values that differ in the last digit only, both zeros, infinities and NaN; ranges of the first digit that are full."""
    monkeypatch.setattr(order, "RANGE_ROWS", full)
    rng = np.random.default_rng(4)
    v = np.r_[1 + rng.integers(0, 50, 300) * 2.0**-52, -rng.random(100), 0.0, -0.0, 1e300, -1e-300, 5e-324, np.inf, -np.inf, rng.random(50) * 1e-9]
    df = spark.createDataFrame([(int(i % 3), float(x)) for i, x in enumerate(v)], "k int, score double")
    back = df.select("score", order.value_of(order.ordered_bits(F.col("score"))).alias("v"), order.ordered_bits(F.col("score")).alias("b")).collect()
    assert all(r.score == r.v for r in back)
    assert [r.score for r in sorted(back, key=lambda r: r.b)] == sorted(v)
    levels = [0.1, 0.33, 0.5, 0.9]
    inside = df.filter(F.abs("score") < 1e299)
    for k in (0, 1, 2):
        own = np.array([x for i, x in enumerate(v) if i % 3 == k and abs(x) < 1e299])
        got = order.percentiles(inside, "score", levels, ["k"]).filter(F.col("k") == k).first().ps
        assert np.array_equal(got, np.percentile(own, [100 * q for q in levels])) or np.allclose(got, np.percentile(own, [100 * q for q in levels]), rtol=1e-15)
    groups = df.groupBy("score").agg(F.count("*").alias("n"))
    got = ranking.running(groups, "score", {"upto": "n"}, descending=False).collect()
    assert all(r.upto == int((v <= r.score).sum()) for r in got)


def test_percentiles_are_one_shuffle_of_values(spark):
    """Every scan but the histograms' reads the same shuffle, and nothing runs while the plan is made."""
    df = spark.range(1000).select((F.col("id") % 97 / 7.0).alias("score"))
    group = spark.sparkContext.statusTracker()
    before = len(group.getJobIdsForGroup())
    found = order.percentiles(df, "score", [0.5, 0.9])
    assert len(group.getJobIdsForGroup()) == before
    assert np.allclose(found.collect()[0].ps, np.percentile([i % 97 / 7.0 for i in range(1000)], [50, 90]))
    plan = found._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 2 and plan.count("Range (0, 1000") == 1, plan


def test_empty_validation_is_refused(spark):
    rows = spark.createDataFrame([(float(i), i % 2 == 0) for i in range(20)], "score double, is_defect boolean")
    row = reports.calibration_row(rows, rows, rows.limit(0))
    with pytest.raises(ValueError, match="validation"):
        reports.calibration_report(row, "a", "b")
    full = reports.calibration_report(reports.calibration_row(rows, rows, rows), "a", "b")
    assert full["counts"]["gt_positive_patches"] == 10


def test_area_needs_no_neighbour(spark):
    rng = np.random.default_rng(5)
    rows = [(float(rng.integers(0, 30)) / 30 + (r is not None) * 0.2, r) for r in rng.choice([None, None, None, 1, 2, 3], 400)]
    df = spark.createDataFrame([(s, None if r is None else int(r)) for s, r in rows], "score double, region int")
    a = ranking.pro_area(df, 0.3).first().area
    b = ranking.truncated_area(ranking.pro_curve(df), "fpr", "pro", 0.3).first().area
    assert np.isclose(a, b)

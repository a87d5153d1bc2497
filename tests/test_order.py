"""Ranks, running sums and percentiles over ranges, against plain versions; ranges are made small so that there are many."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.operators import bank, order, ranking, sampling


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(order, "RANGE_ROWS", 20)
    monkeypatch.setattr(order, "ONE_TASK", 10)


def rows(spark, n=600, seed=1):
    rng = random.Random(seed)
    data = [(i, rng.choice("xyz"), float(rng.choice([0, 0, 0, rng.random()])), rng.random() < 0.3) for i in range(n)]
    return spark.createDataFrame(data, "id long, k string, score double, is_defect boolean"), data


def test_ranked(spark):
    df, data = rows(spark)
    got = {r.id: r.rank for r in order.ranked(df, [F.col("score"), F.col("id")]).collect()}
    assert got == {d[0]: i for i, d in enumerate(sorted(data, key=lambda d: (d[2], d[0])))}
    names = df.select(F.format_string("img_%05d.png", "id").alias("id"))
    assert [r.rank for r in order.ranked(names, [F.col("id")]).orderBy("id").collect()] == list(range(600))


def test_first_n_and_trim(spark):
    df, data = rows(spark)
    want = [d[0] for d in sorted(data, key=lambda d: (d[2], d[0]))]
    assert {r.id for r in order.first_n(df, [F.col("score"), F.col("id")], 450).collect()} == set(want[:450])
    assert {r.id for r in bank.trim(df, 0.2, ["id"]).collect()} == set(want[:480])
    assert order.first_n(df.limit(0), [F.col("score")], 50).count() == 0


def test_percentiles(spark):
    df, data = rows(spark)
    levels = [0.0, 0.1, 0.5, 0.77, 0.995, 1.0]
    got = order.percentiles(df, "score", levels).first().ps
    assert np.allclose(got, np.percentile([d[2] for d in data], [100 * q for q in levels]))
    for r in order.percentiles(df, "score", levels, ["k"]).collect():
        assert np.allclose(r.ps, np.percentile([d[2] for d in data if d[1] == r.k], [100 * q for q in levels]))
    assert order.percentiles(df.limit(0), "score", levels).first().ps is None


def test_separability_and_area(spark):
    df, data = rows(spark)
    a, b = ([d[2] for d in data if d[3] == t] for t in (True, False))
    got = ranking.separability(df).first()
    grid = sorted({d[2] for d in data})
    gap = [abs(np.mean([x <= g for x in a]) - np.mean([x <= g for x in b])) for g in grid]
    assert np.isclose(got.ks, max(gap)) and np.isclose(got.wasserstein, sum(g * (y - x) for g, x, y in zip(gap, grid, grid[1:])))
    assert np.isclose(got.auroc, np.mean([(x > y) + 0.5 * (x == y) for x in a for y in b]))
    points = spark.createDataFrame([(i / 100, (i / 100) ** 0.5) for i in range(101)], "x double, y double")
    x = np.linspace(0, 1, 101)
    inside = x <= 0.3
    assert np.isclose(ranking.truncated_area(points, "x", "y", 0.3).first().area, np.trapezoid(np.sqrt(x[inside]), x[inside]) / 0.3, atol=1e-9)


def test_picks(spark):
    ids = spark.createDataFrame([(f"i{i:03d}",) for i in range(100)], "image_id string")
    assert [r[0] for r in sampling.few_shot_slice(ids, 7, 3).orderBy("image_id").collect()] == [f"i{i:03d}" for i in range(21, 28)]
    got = [r.image_id for r in sampling.circular_pick(ids, 30, 3).orderBy("pick").collect()]
    assert got == [f"i{i % 100:03d}" for i in range(90, 120)]

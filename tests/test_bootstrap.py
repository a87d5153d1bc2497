"""Bootstrap draws that are split down a tree."""

import numpy as np
import pytest

from lattiq.operators import bootstrap


def test_shares_of_leaves_make_up_each_draw():
    for places, size in ((1, 4), (10, 4), (1000, 7), (64, 1)):
        total = np.full(300, places)
        got = [bootstrap.share(total, places, i, size, (1, 2)) for i in range(-(-places // size))]
        assert np.array_equal(sum(got), total) and min(x.min() for x in got) >= 0
        mean = [min(size, places - i * size) for i in range(len(got))]
        assert np.allclose([x.mean() for x in got], mean, atol=5 * np.sqrt(np.max(mean) / 300) + 1e-9)


def rows_of(spark, values, groups):
    return spark.createDataFrame([("m", g, float(v)) for v, g in zip(values, groups)] + [("m", "a", float("nan")), ("m", "a", None), (None, "a", 1.5)], "metric string, g string, value double")


@pytest.mark.parametrize("group", [None, "g"])
def test_intervals_over_many_leaves(spark, group):
    rng = np.random.default_rng(5)
    groups = rng.choice(["a", "b", "b", "c", "c", "c"], 300)
    values = np.round(rng.random(300) + (groups == "c") * 0.5, 2)  # equal values, too
    rows = rows_of(spark, values, groups)
    got = bootstrap.bootstrap(rows, ["metric"], n_boot=3000, group=group, leaf=16)
    first = {r.metric: tuple(r) for r in got.collect()}
    again = {r.metric: tuple(r) for r in bootstrap.bootstrap(rows.repartition(3, "value"), ["metric"], n_boot=3000, group=group, leaf=16).collect()}
    assert first.keys() == again.keys() and all(np.allclose(first[k][1:], again[k][1:]) for k in first)
    assert first[None] == (None, 1, 1.5, 1.5, 1.5)
    if group:
        parts = [values[groups == g] for g in "abc"]
        means = [np.concatenate([parts[i][rng.integers(0, len(parts[i]), len(parts[i]))] for i in rng.integers(0, 3, 3)]).mean() for _ in range(3000)]
    else:
        means = [values[rng.integers(0, 300, 300)].mean() for _ in range(3000)]
    want = np.percentile(means, [2.5, 97.5])
    spread = want[1] - want[0]
    assert first["m"][1] == 300 and np.isclose(first["m"][2], values.mean())
    assert np.allclose(first["m"][3:], want, atol=0.12 * spread)
    assert bootstrap.bootstrap(rows.limit(0), ["metric"]).count() == 0


def test_condition_table(spark):
    runs = spark.createDataFrame([("a", 0.1, None), ("a", 0.3, None), ("b", 0.5, 1.0)], "condition string, x double, y double")
    got = {(r.condition, r.metric): r for r in bootstrap.condition_table(runs, ["x", "y"], n_boot=200).collect()}
    assert len(got) == 4 and got["a", "x"].n_rows == 2 and got["a", "x"].n == 2 and got["a", "y"].n == 0 and got["a", "y"].mean is None
    assert got["b", "x"].ci_low == got["b", "x"].ci_high == 0.5 and 0.1 <= got["a", "x"].ci_low <= got["a", "x"].mean <= got["a", "x"].ci_high <= 0.3
    assert got["a", "x"].mean == pytest.approx(0.2)

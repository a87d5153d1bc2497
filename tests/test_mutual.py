import math

import numpy as np
import pytest

from lattiq.operators import knn


@pytest.mark.parametrize("metric, q, held", [("cosine", 0.1, 4_000_000), ("l2", 0.3, 1_300_000), ("cosine", 0.001, 1 << 20), ("l2", 1.0, 1 << 20)])
def test_tables_over_the_broadcast_size_are_scored_in_blocks(spark, monkeypatch, metric, q, held):
    rng = np.random.default_rng(3)
    x, grp = rng.normal(size=(300, 6)), rng.integers(0, 25, 300)
    grp[:60] = 7  # images of different sizes
    rows = spark.createDataFrame([(i, int(g), v.tolist()) for i, (g, v) in enumerate(zip(grp, x))], "id long, grp long, features array<double>")
    small = {r.id: r.score for r in knn.mutual_scores(rows, q, metric).collect()}
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(knn, "HELD_BYTES", held, raising=False)
    got = {r.id: (r.grp, r.score) for r in knn.mutual_scores(rows, q, metric).collect()}
    d = knn.distances(x, x, metric)
    for i in range(300):
        other = np.sort(d[i][grp != grp[i]])
        n = int(q * len(other))
        low = other[other < other[n - 1]] if n else other[:0]
        want = low.mean() if len(low) else None
        assert got[i][0] == grp[i]
        for score in (got[i][1], small[i]):
            assert score is None if want is None else math.isclose(score, want, rel_tol=1e-9)
    assert len(got) == 300


def test_equal_distances_and_several_brackets(spark):
    """Rows on a grid: most distances are equal to many others, some are 0."""
    from lattiq.operators import mutual

    rng = np.random.default_rng(4)
    x, grp = rng.integers(0, 3, (200, 2)).astype(float), rng.integers(0, 9, 200)
    rows = spark.createDataFrame([(i, int(g), v.tolist()) for i, (g, v) in enumerate(zip(grp, x))], "id long, grp long, features array<double>")
    d = knn.distances(x, x, "l2")
    for q in (0.2, 0.7):
        got = {r.id: r.score for r in mutual.in_passes(rows, q, "l2", 60 * 4 * mutual.BINS).collect()}
        for i in range(200):
            other = np.sort(d[i][grp != grp[i]])
            n = int(q * len(other))
            low = other[other < other[n - 1]]
            assert got[i] is None if not len(low) else math.isclose(got[i], low.mean(), rel_tol=1e-9, abs_tol=1e-12)
    assert mutual.in_passes(rows.limit(0), 0.5, "l2").count() == 0

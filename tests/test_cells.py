"""Pruned neighbour search, against the search of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.operators import cells, knn


def frame(spark, x, groups=None):
    rows = [(i, None if groups is None else int(groups[i]), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, grp long, features array<double>")
    return df if groups is not None else df.drop("grp")


def clustered(rng, n, centres):
    return centres[rng.integers(0, len(centres), n)] + rng.normal(0, 0.05, (n, centres.shape[1]))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_equal_to_all_pairs(spark, metric, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_BYTES", 40 * 8 * 6)  # cells are several blocks
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6)) * 3
    bank, queries = clustered(rng, 600, centres), np.r_[clustered(rng, 80, centres), rng.normal(size=(15, 6)) * 5, np.zeros((1, 6))]
    bank[5] = 0.0
    b, q = frame(spark, bank, rng.integers(0, 4, 600)), frame(spark, queries, rng.integers(0, 4, 96))
    for k in (1, 7):
        want = {(r.query_id, r.rank): r for r in knn.nearest(q, b, k, metric).collect()}
        got = {(r.query_id, r.rank): r for r in knn.nearest(q, b, k, metric, strategy="cells").collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[x].dist, want[x].dist, atol=1e-9) for x in want)
        ties = sum(got[x].bank_id != want[x].bank_id for x in want if x[0] != 95)  # the last query has no length: all are alike
        assert ties == 0
        share = np.mean([r.compared for x, r in got.items() if x[1] == 1]) / 600
        assert share < 0.6, share


def test_few_candidates_and_empty_tables(spark):
    x = np.eye(4)
    rows = frame(spark, x, [0, 0, 0, 1])
    got = knn.nearest(rows, rows, 3, "l2", strategy="cells")
    assert sorted((r.query_id, r.rank) for r in got.collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (3, 2), (3, 3)]
    assert knn.nearest(rows, rows.limit(0), strategy="cells").count() == 0 and knn.nearest(rows.limit(0), rows, strategy="cells").count() == 0
    scores = knn.knn_scores(rows, rows, 1, "l2", strategy="cells")
    assert all(np.isclose(r.score, 2**0.5) for r in scores.collect())
    assert frame(spark, np.zeros((3, 2))).select(F.count("*")).first()[0] == 3

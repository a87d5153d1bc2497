"""What a worker of a search holds doesn't grow with the bank, and results are those of all pairs at once."""

import tracemalloc

import numpy as np
import pytest

from lattiq.operators import knn, mutual

MB = 1 << 20


def held(f):
    """The result, and the most bytes that were held beside what was there before."""
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def bank():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((50_000, 6))
    x[30_000:30_020] = x[5]  # equal rows in pieces of their own
    ids = rng.permutation(len(x)).astype(np.int64)
    return ids, (ids % 7).astype(np.int64), x


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("k", [1, 3])
def test_nearest(bank, k, metric):
    """F2, F5 to F20: the search of the registered queries."""
    ids, groups, x = bank
    q, own = x[:600] + 0.01, groups[:600]
    got, peak = held(lambda: knn._nearest(ids[:600], own, q, ids, groups, x, k, metric))
    assert peak < 64 * MB
    d = knn.distances(q, x, metric)
    d[own[:, None] == groups[None, :]] = np.inf
    assert got.num_rows == 600 * k and (got.column("query_id").to_numpy() == np.repeat(ids[:600], k)).all()
    assert np.allclose(got.column("dist").to_numpy().reshape(600, k), np.sort(d, axis=1)[:, :k], atol=1e-9)
    place = np.argsort(ids)
    near = got.column("bank_id").to_numpy().reshape(600, k)
    assert np.allclose(np.take_along_axis(d, place[near], 1), got.column("dist").to_numpy().reshape(600, k), atol=1e-9)


def test_few_rows_and_none(bank):
    ids, groups, x = bank
    assert knn._nearest(ids[:2], groups[:2], x[:2], ids[:1], groups[:1], x[:1], 3, "cosine").num_rows == 1
    assert knn._nearest(ids[:0], groups[:0], x[:0], ids, groups, x, 3, "cosine").num_rows == 0
    same = np.ones((5000, 2))
    got = knn._nearest(np.array([1]), np.array([-1]), same[:1], np.arange(5000)[::-1].copy(), np.full(5000, -2), same, 3, "l2")
    assert got.column("bank_id").to_pylist() == [0, 1, 2]
    gap = np.ones((4, 2))
    gap[1] = np.nan
    got = knn._nearest(np.array([1]), np.array([-1]), gap[:1], np.arange(4)[::-1].copy(), np.full(4, -2), gap, 1, "l2")
    assert got.column("bank_id").to_pylist() == [0] and got.column("dist").to_pylist() == [0.0]


def test_nearest_of_classes(bank):
    """banks of classes in one search."""
    ids, classes, x = bank
    got, peak = held(lambda: knn._nearest_of_classes(ids[:600], classes[:600], x[:600] + 0.01, ids, classes, x, 1, "cosine"))
    assert peak < 64 * MB
    d = knn.distances(x[:600] + 0.01, x, "cosine")
    want = np.stack([d[:, classes == c].min(1) for c in range(7)], axis=1)
    assert got.column("bank_id").to_pylist() == [*range(7)] * 600 and np.allclose(got.column("dist").to_numpy().reshape(600, 7), want, atol=1e-12)


def test_mutual_scores_of_a_broadcast_table(bank):
    """all patches broadcast."""
    ids, groups, x = bank
    all_of_them = knn._ready(x, "cosine")
    got, peak = held(lambda: knn._low_means(groups[:40], x[:40], groups, all_of_them, 0.02, "cosine"))
    assert peak < 32 * MB
    d = knn.distances(x[:40], x, "cosine")
    for i in range(40):
        other = np.sort(d[i][groups != groups[i]])
        assert np.isclose(got[i], other[other < other[int(0.02 * len(other)) - 1]].mean(), atol=1e-12)


def test_mutual_scores_in_passes():
    """running counts are made of few patches at a time."""
    first = mutual.First({"id": np.arange(1000), "need": np.full(1000, 5)})
    first.counts[:, 100] = 3
    first.counts[:, 900] = 4
    (_, lo, hi, below, _), peak = held(first.ended)
    assert peak < first.counts.nbytes / 2
    assert (below == 3).all() and (lo == mutual.edge(np.array([900]))).all() and (hi == mutual.edge(np.array([901]))).all()


def test_equal_rows():
    """F6 to F19: a bank of copies, all of which tie, is held no longer than others."""
    peaks = []
    for n in (4_096, 40_000):
        ids, x = np.arange(n)[::-1].copy(), np.ones((n, 6))
        got, peak = held(lambda: knn._nearest(np.arange(600), np.full(600, -1), x[:600], ids, np.full(n, -2), x, 3, "l2"))
        assert got.column("bank_id").to_pylist() == [0, 1, 2] * 600
        peaks.append(peak)
    assert peaks[1] < min(1.2 * peaks[0], 128 * MB)


def test_blocks_as_broadcast(spark, bank, monkeypatch):
    """F6 to F19: a bank past ``limit_bytes`` goes in blocks and gives the rows of a broadcast one, groups and ties included."""
    ids, groups, x = bank
    rows = spark.createDataFrame([(int(i), int(g), v.tolist()) for i, g, v in zip(ids[29_000:31_000], groups[29_000:31_000], x[29_000:31_000])], "id long, grp long, features array<double>")
    monkeypatch.setattr(knn, "BLOCK_BYTES", 24 << 10)  # four blocks
    for k, metric in ((1, "cosine"), (3, "l2")):
        one, other = ({(r.query_id, r.rank): r for r in knn.nearest(rows, rows, k, metric, limit_bytes=n).collect()} for n in (1 << 20, 0))
        assert len(one) == 2_000 * k and one.keys() == other.keys()
        assert all(other[i].bank_id == r.bank_id and np.isclose(other[i].dist, r.dist, atol=1e-7) for i, r in one.items())
    kinds = rows.withColumnRenamed("grp", "class_id")
    one, other = ({(r.query_id, r.class_id): r.dist for r in knn.class_scores(rows, kinds, "l2", n).collect()} for n in (1 << 20, 0))
    assert len(one) == 14_000 and one.keys() == other.keys() and all(np.isclose(other[i], d, atol=1e-7) for i, d in one.items())

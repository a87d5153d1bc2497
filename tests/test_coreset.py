"""Coresets in rounds over blocks, against the plain greedy choice."""

import numpy as np
import pytest

from lattiq.operators import bank, coreset


def plain(ids, x, k, start=0):
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    least, out, at = np.full(len(ids), np.inf), [], start % len(ids)
    for _ in range(min(k, len(ids))):
        out.append(int(ids[at]))
        least = np.minimum(least, ((x - x[at]) ** 2).sum(1))
        least[at] = -1
        at = int(least.argmax())
    return out


def frame(spark, ids, x, parts=3):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, features array<double>").repartition(parts)


@pytest.mark.parametrize("seed, n, values, keep, offers, reach", [(0, 500, None, 7, 4, 10), (1, 400, 3, 5, 2, 3), (2, 300, 2, 1000, 300, 1000), (3, 60, 1, 9, 1, 1)])
def test_picks_are_those_of_one_task(spark, monkeypatch, seed, n, values, keep, offers, reach):
    """With few ``values`` many rows are equal, so ties and distances of 0 decide."""
    rng = np.random.default_rng(seed)
    ids = rng.permutation(n * 3)[:n]
    x = rng.normal(size=(n, 4)) if values is None else rng.integers(0, values, (n, 3)).astype(float)
    monkeypatch.setattr(coreset, "BLOCK_BYTES", 50 * 8 * x.shape[1])
    k = 40
    got, rounds = coreset.greedy(frame(spark, ids, x), k, int(ids.min()), keep, offers, reach)
    assert got == plain(ids, x, k) and rounds <= k


def test_bounds_are_exact_in_lazy_order():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5000, 6))
    block = coreset.Block(np.arange(5000), x)
    picks = x[[7, 19, 300]]
    known, rest = block.offers(np.array([7, 19, 300]), picks, 20)
    true = np.min([((x - p) ** 2).sum(1) for p in picks], axis=0)
    true[[7, 19, 300]] = -1
    assert known.tolist() == np.lexsort((np.arange(5000), -true))[:20].tolist()
    more, rest = block.offers(np.array([7, 19, 300, 11]), x[[7, 19, 300, 11]], 20)
    true = np.minimum(true, ((x - x[11]) ** 2).sum(1))
    true[11] = -1
    assert more.tolist() == np.lexsort((np.arange(5000), -true))[:20].tolist() and rest >= np.sort(true)[-21]
    assert (block.seen == 4).sum() < 5000  # rows that can't win keep older bounds


def test_coreset(spark):
    rng = np.random.default_rng(6)
    ids, x = np.arange(200), rng.normal(size=(200, 5))
    df = frame(spark, ids, x)
    got = [r.id for r in bank.coreset(df, 30, 13).orderBy("pick").collect()]
    assert got == plain(ids, x, 30, 13)
    chosen = {r.id for r in bank.coreset_by_ratio(df, 0.1, 5).collect()}
    assert chosen == set(plain(ids, x, 20, 5))
    assert bank.coreset(df.limit(0), 5).count() == 0 and bank.coreset(df, 500).count() == 200


def test_coreset_of_groups(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    ids, x = np.arange(150), rng.normal(size=(150, 3))
    df = frame(spark, ids, x).withColumn("g", F.when(F.col("id") < 100, "a").when(F.col("id") < 140, "b"))
    for one_task in (1000, 60):
        found = bank.coreset(df, 12, 3, ("g",), one_task).orderBy("g", "pick").collect()
        for g, own in (("a", ids[:100]), ("b", ids[100:140]), (None, ids[140:])):
            assert [r.id for r in found if r.g == g] == plain(own, x[own], 12, 3)


def test_anomaly_memory_with_caps_and_coreset(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 3))
    rows = [(i, i // 30, 1 + i % 2, 0.6, float(x[i, 0]), x[i].tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, image_id int, class_id int, overlap double, score double, features array<double>")
    capped = bank.select_anomalies(df, "any", per_image=20, cap=6, allow_oracle=True).collect()
    for image in range(4):
        for c in (1, 2):
            top = sorted(range(30 * image, 30 * image + 30), key=lambda i: (-x[i, 0], i))[:20]
            want = [i for i in top if 1 + i % 2 == c][:6]
            assert sorted(r.id for r in capped if r.image_id == image and r.class_id == c) == sorted(want)
    chosen = bank.select_anomalies(df, "any", coreset_size=9, seed=4, allow_oracle=True).collect()
    for c in (1, 2):
        own = np.array([i for i in range(120) if 1 + i % 2 == c])
        assert sorted(r.id for r in chosen if r.class_id == c) == sorted(plain(own, x[own], 9, 4))


def test_conditions_of_controls_and_budgets(spark):
    from lattiq.operators import study

    names = [r.name for r in study.control_conditions(spark).collect()]
    assert len(names) == 11 and {"auto_p97_5", "random_matched_p99", "trim_5pct"} <= set(names)
    rows = {r.name: r for r in study.budget_conditions(spark).collect()}
    assert len(rows) == 13 and rows["expanded_full_2plus8"].budget is None and rows["purified_budget_4plus8"].budget == 51_200
    assert study.budget_conditions(spark, optional=False).count() == 12

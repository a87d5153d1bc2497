"""The joint probe: slopes, resumed runs, best epochs."""

import numpy as np
import pytest

from lattiq.operators.trainer import JointProbe


def rows_of(spark, seed, n=240):
    rng = np.random.default_rng(seed)
    c = rng.choice([0, 0, 1, 2, 3], n)
    centres = np.array([[0, 0, 0], [3, 0, 0], [0, 3, 0], [0, 0, 3]])
    x = centres[c] + rng.normal(0, 0.5, (n, 3))
    rows = [(i, i // 20, (i % 20) // 5, i % 5, v.tolist(), bool(k), int(k)) for i, (v, k) in enumerate(zip(x, c))]
    return spark.createDataFrame(rows, "id long, image_id long, row int, col int, features array<double>, is_defect boolean, class_id int")


@pytest.mark.parametrize("loss", ["bce", "focal"])
def test_slopes(loss):
    rng = np.random.default_rng(1)
    probe = JointProbe(classes=3, loss=loss)
    x, y, c, w = rng.normal(size=(30, 4)), rng.random(30) < 0.5, rng.integers(0, 4, 30), rng.normal(size=(5, 4))
    base = probe.sums(x, y, c, w)
    for i in range(w.size):
        d = np.zeros(w.size)
        d[i] = 1e-6
        up, down = (probe.sums(x, y, c, w + s * d.reshape(w.shape)) for s in (1, -1))
        at = w.size if i % 4 == 0 else w.size + 1  # binary loss, class loss
        assert np.isclose(base[i], (up[at] - down[at]) / 2e-6, atol=1e-4)


def test_resumed_run_equals_the_unbroken_one(spark, tmp_path):
    train, val = rows_of(spark, 2), rows_of(spark, 3, 100)
    how = {"classes": 3, "batches": 3, "rate": 0.1, "seed": 5}
    whole = JointProbe(epochs=4, **how).fit(train, val)
    folder = f"file://{tmp_path}/probe"
    JointProbe(epochs=2, folder=folder, **how).fit(train, val)
    resumed = JointProbe(epochs=4, folder=folder, **how).fit(train.repartition(3), val)
    assert np.allclose(whole.w, resumed.w, atol=1e-9) and len(resumed.history) == 4 and whole.best_epoch == resumed.best_epoch
    assert np.isclose(whole.history[3]["val_loss"], resumed.history[3]["val_loss"]) and whole.history[3]["val_loss"] < whole.history[0]["val_loss"]
    assert whole.threshold == resumed.threshold
    with pytest.raises(ValueError, match="other settings"):
        JointProbe(epochs=4, folder=folder, **{**how, "seed": 6}).fit(train, val)
    found = resumed.transform(val).join(val.select("id", "is_defect", "class_id"), "id").collect()
    assert np.mean([(r.score >= resumed.threshold) == r.is_defect for r in found]) > 0.8
    assert np.mean([r.pred_class == r.class_id for r in found if r.is_defect]) > 0.9


def test_early_end_keeps_the_best_epoch(spark):
    train, val = rows_of(spark, 4, 60), rows_of(spark, 5, 40)
    wild = JointProbe(classes=3, epochs=12, batches=1, rate=30.0, patience=2, loss="focal").fit(train, val)
    losses = [h["val_loss"] for h in wild.history]
    assert wild.best_epoch == 1 + int(np.argmin(losses)) and len(losses) <= wild.best_epoch + 2
    with pytest.raises(ValueError):
        JointProbe().fit(train.limit(0))
    with pytest.raises(ValueError):
        JointProbe(loss="other")

"""labels of patches from runs, without their pixels."""

import numpy as np
import pytest

from lattiq.operators import geometry


@pytest.mark.parametrize("rule", ["any_overlap", "overlap_ratio_threshold", "majority_vote", "center_point"])
def test_runs_that_overlap_against_pixels(spark, rule):
    rng = np.random.default_rng(5)
    masks = {(i, c): [(int(s), int(n)) for s, n in zip(rng.integers(0, 13 * 17, 12), rng.integers(1, 60, 12))] for i in range(4) for c in (1, 3)}
    masks[0, 3] += [(13 * 17 - 3, 50), (0, 13)]  # over the end of the image, and a whole column
    text = [(i, c, " ".join(f"{s + 1} {n}" for s, n in m)) for (i, c), m in masks.items()]
    text += [(2, 1, "5 9 5 9"), (9, 1, "1 4"), (3, 4, "  ")]  # a second row of one mask, an unknown image, no runs
    masks[2, 1] += [(4, 9)]
    rows = spark.createDataFrame(text, "image_id long, class_id int, rle string")
    got = geometry.patch_labels(rows, spark.range(6).withColumnRenamed("id", "image_id"), 13, 17, 4, rule, 0.25).collect()
    assert len(got) == len({(r.image_id, r.class_id, r.row, r.col) for r in got}) == 6 * 3 * 3 * 4
    for r in got:
        px = np.zeros(13 * 17 + 100, bool)
        for (i, c), m in masks.items():
            if i == r.image_id and r.class_id in (0, c):
                for s, n in m:
                    px[s : s + n] = True
        own = px[: 13 * 17].reshape(17, 13).T[4 * r.row : 4 * r.row + 4, 4 * r.col : 4 * r.col + 4]
        want = {"any_overlap": own.mean() > 0, "overlap_ratio_threshold": own.mean() >= 0.25, "majority_vote": own.mean() > 0.5, "center_point": own[2, 2]}
        assert r.overlap == own.mean() and r.label == want[rule]


def test_a_run_of_more_pixels_than_a_list_can_hold(spark):
    rows = spark.createDataFrame([(1, 1, f"1 {3_000 * 1_000_000}")], "image_id long, class_id int, rle string")
    got = geometry.patch_labels(rows, rows.select("image_id"), 1_000_000, 4_000, 1_000, "any_overlap").filter("class_id = 1").groupBy("label", "overlap").count().collect()
    assert sorted((r.label, r.overlap, r["count"]) for r in got) == [(False, 0.0, 1000), (True, 1.0, 3000)]

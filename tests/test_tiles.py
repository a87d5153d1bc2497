"""Maps in tiles, against plain resizing and smoothing."""

import numpy as np
import pytest

from lattiq.operators import geometry, tiles


def plain(s, height, width, sigma):
    def line(v, size):
        at = np.clip((np.arange(size) + 0.5) * len(v) / size - 0.5, 0, len(v) - 1)
        return np.interp(at, np.arange(len(v)), v)

    m = np.array([line(c, height) for c in s.T]).T
    m = np.array([line(r, width) for r in m])
    if sigma:
        w = np.array(geometry.gaussian(sigma))
        r = len(w) // 2
        p = np.pad(m, r, mode="symmetric")
        p = sum(w[i] * p[i : i + height] for i in range(len(w)))
        m = sum(w[i] * p[:, i : i + width] for i in range(len(w)))
    return m


@pytest.mark.parametrize("shape, size, sigma, tile", [((4, 5), (40, 50), 1.0, 512), ((4, 5), (40, 50), 4.0, 7), ((6, 3), (9, 31), 2.0, 4), ((1, 4), (33, 20), 1.5, 10), ((12, 9), (6, 5), 0.0, 2), ((3, 3), (20, 20), 4.0, 6)])
def test_one_tile_and_many(spark, shape, size, sigma, tile):
    rng = np.random.default_rng(1)
    grids = {i: rng.random(shape) for i in (3, 8)}
    df = spark.createDataFrame([(i, y, x, float(g[y, x])) for i, g in grids.items() for y in range(shape[0]) for x in range(shape[1])], "image_id long, row int, col int, score double")
    got = {i: np.full(size, np.nan) for i in grids}
    for r in tiles.distance_map(df, *shape, *size, sigma, tile).collect():
        assert np.isnan(got[r.image_id][r.y, r.x])
        got[r.image_id][r.y, r.x] = r.score
    want = {i: plain(g, *size, sigma) for i, g in grids.items()}
    assert all(np.allclose(got[i], want[i], atol=1e-12) for i in grids)
    most = {r.image_id: r.score for r in tiles.max_of_map(df, *shape, *size, sigma, tile).collect()}
    assert all(np.isclose(most[i], want[i].max()) for i in grids)


def test_missing_patches_and_wide_gaps(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0)], "image_id string, row int, col int, score double")
    got = {(r.y, r.x): r.score for r in tiles.distance_map(df, 20, 1, 200, 10, 1.0, 16).collect()}
    s = np.zeros((20, 1))
    s[0, 0] = 1.0
    want = plain(s, 200, 10, 1.0)
    assert len(got) == 2000 and all(np.isclose(got[y, x], want[y, x], atol=1e-12) for y in range(200) for x in range(10))
    assert tiles.distance_map(df.limit(0), 2, 2, 4, 4).count() == 0


def test_registered_map_of_a_grid_with_gaps(spark, tmp_path):
    """The last image has one patch, so its map has the pixels which that patch reaches, as in the SQL."""
    import duckdb

    from lattiq.plans import all_oracles, all_queries

    rows = [(i, [float(i % 7) - 3.0, 1.0], i % 10) for i in [*range(20), 27]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT image_id, y, x, score FROM ({all_oracles()['distance_map']})").fetchall()
    got = [tuple(r) for r in all_queries()["distance_map"](spark, str(tmp_path)).select("image_id", "y", "x", "score").collect()]
    assert sorted(got) == sorted(want) and 2000 < len(got) < 4000

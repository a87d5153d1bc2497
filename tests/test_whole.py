"""Queries over whole tables, at sizes where a cut by id would show."""

import math

import duckdb
import numpy as np
from test_queries import ordered

from lattiq.operators import geometry, maps
from lattiq.plans import all_oracles, all_queries

DATA = "/root/testdata"


def whole(spark, name, sf, table, cut, data=DATA):
    """The query's rows, and those of its SQL without ``cut``."""
    df = all_queries()[name](spark, f"{data}/{sf}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{sf}/{table}.parquet'")
    cur = con.execute(all_oracles()[name].replace(cut, ""))
    names = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    return ordered(tuple(r[c] for c in cols) for r in df.collect()), ordered(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())


def test_image_sobel_has_every_image(spark):
    got, want = whole(spark, "image_sobel", "sf0.01", "events", " WHERE image_id < 20")
    assert got == want


def mirrored(i, n):
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def test_smooth_map_has_every_event(spark):
    rows = duckdb.sql(f"SELECT user_id, value FROM '{DATA}/sf0.01/events.parquet' ORDER BY user_id, event_id").fetchall()
    values = {}
    for user, value in rows:
        values.setdefault(user, []).append(value)
    got = {}
    for r in all_queries()["smooth_map"](spark, f"{DATA}/sf0.01").collect():
        got.setdefault(r.image_id, {})[r.y, r.x] = r.score
    assert {i: len(g) for i, g in got.items()} == {i: 8 * math.ceil(len(v) / 8) for i, v in values.items()}
    w = geometry.gaussian(1.0)
    r = len(w) // 2
    for i in (min(values), max(values)):
        m = np.zeros((math.ceil(len(values[i]) / 8), 8))
        m.reshape(-1)[: len(values[i])] = values[i]
        for (y, x), score in got[i].items():
            want = sum(w[a + r] * w[b + r] * m[mirrored(y + a, len(m)), mirrored(x + b, 8)] for a in range(-r, r + 1) for b in range(-r, r + 1))
            assert math.isclose(score, want, abs_tol=2e-6)


def test_smooth_takes_images_of_any_height(spark):
    rows = spark.createDataFrame([(1, 0, 0, 1.0), (2, 11, 7, 1.0)], "image_id long, y long, x long, score double")
    sizes = {r.image_id: r["count"] for r in maps.smooth(rows, None, 8, 1.0).groupBy("image_id").count().collect()}
    assert sizes == {1: 8, 2: 96}


def test_paired_ids_reads_every_line(spark):
    got, want = whole(spark, "paired_ids", "sf0.01", "lineitem", " WHERE l_orderkey < 50")
    assert got == want


def test_neighbour_mean_has_every_image(spark):
    got, want = whole(spark, "neighbour_mean", "sf0.1", "embeddings", " WHERE q.image_id < 25")
    assert len(got) == 2000 and got == want


def test_neighbour_mean_of_an_image_with_missing_cells(spark, tmp_path):
    (tmp_path / "part").mkdir()
    duckdb.sql(f"COPY (SELECT * FROM '{DATA}/sf0.001/embeddings.parquet' WHERE vec_id < 42) TO '{tmp_path}/part/embeddings.parquet' (FORMAT parquet)")
    got, want = whole(spark, "neighbour_mean", "part", "embeddings", " WHERE q.image_id < 25", tmp_path)
    assert len(got) == 42 and got == want

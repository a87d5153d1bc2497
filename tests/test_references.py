"""Reference plans: rows against a plain version, and how often their inputs are read."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lattiq.operators import references, sampling
from lattiq.plans import all_queries
from lattiq.sources import tables

DATA = "/root/testdata"


def turned(ids, start, count, but=()):
    """``count`` ids in order from place ``start`` on, around the end, without those of ``but``."""
    return [i for i in ids[start:] + ids[:start] if i not in but][:count]


def plain_class_balanced(members, shots, classes, seed):
    taken = []
    for c in classes:
        ids = sorted({i for i, k in members if k == c})
        taken += turned(ids, (seed + c) * (shots // len(classes)) % len(ids), shots // len(classes), taken) if ids else []
    return taken


def plain_pool(ids, count, seed, but=()):
    ids = sorted(set(ids) - set(but))
    return turned(ids, 0 if count >= len(ids) else seed * count % len(ids), count)


def counted(df, column, reads):
    """``df`` as it is, counting how often one of its rows is made."""
    kind = df.schema[column].dataType
    return df.withColumn(column, F.udf(lambda v: (reads.add(1), v)[1], kind).asNondeterministic()(column))


def test_plan_of_the_query(spark):
    con, d = duckdb.connect(), f"{DATA}/sf0.01"
    images = dict(con.execute(f"SELECT l_orderkey, bool_or(l_returnflag = 'R') FROM '{d}/lineitem.parquet' GROUP BY 1").fetchall())
    members = set(con.execute(f"SELECT vec_id // 20, label - 5 FROM '{d}/embeddings.parquet' WHERE label > 5").fetchall())
    order = sorted(images, key=lambda i: (hashlib.sha256(f"fold\0{42}\0{i}".encode()).hexdigest(), i))
    train = {i for rank, i in enumerate(order) if rank % 5}
    healthy = sorted(i for i in train if not images[i])
    clean = turned(healthy, 84 % len(healthy), 2)
    first = [i for i in plain_class_balanced({m for m in members if m[0] in train}, 4, (1, 2, 3, 4), 43) if i not in clean]
    more = first + (plain_pool([i for i in train if images[i]], 4 - len(first), 60, first + clean) if len(first) < 4 else [])
    want = {(i, part, images[i], tuple(sorted(c for m, c in members if m == i))) for part, ids in (("clean", clean), ("additional", more)) for i in ids}
    assert {(r.image_id, r.part, r.has_defect, tuple(r.classes)) for r in all_queries()["reference_plan"](spark, d).collect()} == want


def test_query_reads_lineitem_once(spark, monkeypatch):
    reads, real = spark.sparkContext.accumulator(0), tables.table
    monkeypatch.setattr(tables, "table", lambda s, d, name: counted(real(s, d, name), "l_returnflag", reads) if name == "lineitem" else real(s, d, name))
    assert all_queries()["reference_plan"](spark, f"{DATA}/sf0.001").count() == 6
    assert reads.value == real(spark, f"{DATA}/sf0.001", "lineitem").count()


@pytest.mark.parametrize("mode, sampled", [("contaminated_all", "class_balanced"), ("class_balanced_all", "class_balanced"), ("clean", "class_balanced")])
def test_plan_reads_the_training_fold_once(spark, mode, sampled):
    reads = spark.sparkContext.accumulator(0)
    train = spark.createDataFrame([(f"i{i:02d}", i % 3 != 0) for i in range(30)], "image_id string, has_defect boolean")
    members = spark.createDataFrame([(f"i{i:02d}", i % 4 + 1) for i in range(30) if i % 3], "image_id string, class_id int")
    val = spark.createDataFrame([("v1",)], "image_id string")
    assert references.reference_plan(counted(train, "has_defect", reads), val, members, mode, 42, 2, 8, sampled).count() == (2 if mode == "clean" else 10)
    assert reads.value == 30


def test_classes_share_one_reading_of_the_members(spark):
    reads = spark.sparkContext.accumulator(0)
    data = [(i // 2, i % 5) for i in range(200)]
    members = counted(spark.createDataFrame(data, "image_id long, class_id long"), "image_id", reads)
    picks = [r.image_id for r in sampling.class_balanced_pick(members, 12, (1, 2, 3, 4), 7).collect()]
    assert sorted(picks) == sorted(plain_class_balanced(data, 12, (1, 2, 3, 4), 7)) and len(set(picks)) == 12
    assert reads.value == 200


@pytest.mark.parametrize("one_task", [0, 100_000])
def test_picks_with_a_top_n_and_with_ranks(spark, monkeypatch, one_task):
    monkeypatch.setattr(sampling, "ONE_TASK", one_task)
    monkeypatch.setattr("lattiq.operators.order.ONE_TASK", one_task)
    ids = [f"i{i:03d}" for i in range(0, 101)]
    df = spark.createDataFrame([(i,) for i in ids + ids[:50]], "image_id string")  # some twice
    but = spark.createDataFrame([(i,) for i in ids[20:90:3]], "image_id string")
    skipped = set(ids[20:90:3])
    for count, seed in ((1, 0), (7, 9), (60, 3), (101, 2), (200, 5)):
        got = [(r.pick, r.image_id) for r in sampling.circular_pick(df, count, seed, exclude=but).collect()]
        assert [i for _, i in sorted(got)] == turned(ids, seed * count % 101, count, skipped) and sorted(p for p, _ in got) == list(range(len(got)))
        got = [(r.place, r.image_id) for r in sampling.pool_pick(df, count, seed, but).collect()]
        assert [i for _, i in sorted(got)] == plain_pool(ids, count, seed, skipped) and sorted(p for p, _ in got) == list(range(len(got)))
    assert [r.image_id for r in sampling.circular_pick(df, -1, 4).orderBy("pick").collect()] == turned(ids, 4 * 101 % 101, 101)
    assert sampling.pool_pick(df, 0, 1).collect() == [] and sampling.pool_pick(df, 5, 1, df).collect() == [] and sampling.circular_pick(df.limit(0), 5, 1).collect() == []


def test_an_image_of_both_kinds_is_drawn_once(spark):
    train = spark.createDataFrame([(i, bool(k)) for i in range(6) for k in (0, 1)], "image_id long, has_defect boolean")
    members = spark.createDataFrame([(i, 1) for i in range(6)], "image_id long, class_id int")
    val = spark.createDataFrame([(9,)], "image_id long")
    plan = references.reference_plan(train, val, members, "contaminated_all", 1, 2, 4, "random_train").collect()
    assert sorted({r.image_id for r in plan}) == list(range(6)) and sum(r.part == "additional" for r in plan) == 8

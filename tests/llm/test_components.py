import random

import pytest
from pyspark.sql import functions as F

from lattiq.llm import components as module
from lattiq.llm import jaccard_join
from lattiq.llm.components import components


def shuffled(n, seed):
    ids = list(range(n))
    random.Random(seed).shuffle(ids)
    return ids


def chain(ids):
    return list(zip(ids, ids[1:]))


def least(links):
    low = {x: x for p in links for x in p}
    changed = True
    while changed:
        changed = False
        for x, y in [*links, *reversed(links)]:
            m = min(low[x], low[y])
            changed |= low[x] != m or low[y] != m
            low[x] = low[y] = m
    return low


rng = random.Random(7)
CASES = {
    "shuffled chain": chain(shuffled(1000, 1)),
    "rising chain": chain(list(range(1000))),
    "star": [(300, i) for i in range(300)],
    "several": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    links = [p for p in CASES[name] if p[0] != p[1]]
    got = components(spark.createDataFrame(links, "x long, y long"))
    assert {r.node: r.comp for r in got.collect()} == least(links) and got.count() == len(least(links))


def test_components_of_keys(spark):
    ids = shuffled(200, 3)
    key = lambda c: F.struct((F.col(c) % 7).alias("d"), F.col(c).alias("h"))
    got = components(spark.createDataFrame(chain(ids), "x long, y long").select(key("x").alias("x"), key("y").alias("y"))).collect()
    assert len(got) == 200 and {tuple(r.comp) for r in got} == {(0, 0)}


def test_no_links(spark):
    assert components(spark.createDataFrame([(1, 1)], "x long, y long").filter("x > 1")).count() == 0


def test_few_tables(spark, monkeypatch):
    """Findings of round 3, pipeline: every table that is written, and every query beside, adds to the driver's memory."""
    names, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: (names.append(name), write(df, name))[1])
    monkeypatch.setattr(type(spark.range(1)), "count", lambda df: pytest.fail("a query of its own for a count"))
    got = components(spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "x long, y long"))
    assert {r.node: r.comp for r in got.collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert names == ["edges", "labels", "components", "edges"]


def test_drift_chain(spark):
    """Each revision links with the next ones only."""
    ids, words = shuffled(300, 5), [f"w{i}" for i in range(2000)]
    docs = [(ids[i], " ".join(words[4 * i : 4 * i + 60])) for i in range(300)]
    got = jaccard_join.linked_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == 300 and {r.component_id for r in got} == {0}

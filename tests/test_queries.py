"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lattiq.plans import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    df = all_queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = ordered(tuple(r[c] for c in cols) for r in df.collect())
    if name not in all_oracles():
        assert got
        return
    cur = con.execute(all_oracles()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert ordered(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()) == got


def test_entry_without_training_data_part(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert "flagship" in entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    sys.modules.pop("__spark_entry__", None)

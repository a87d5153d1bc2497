"""The stages, each against a plain version on its own input."""

import os

import duckdb
import pytest
from brute import contamination, groups, kept_bytes
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = pipeline.written(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == columns
        if name == "language_id":
            assert set(before) - set(after) == {i for i, r in before.items() if not any(c.isalpha() for c in r.text or "")}
        elif name == "near_copies":
            want = groups([(i, r.text) for i, r in before.items()], 5, 80)
            assert set(after) == {i for i, _, c in want if i == c}
        elif name == "repeated_strings":
            assert set(after) == set(before)
            for i, kept in kept_bytes([(i, r.text) for i, r in before.items()], 200).items():
                assert after[i].text == kept.decode("utf-8", "ignore")
            assert all(after[i].n_chars == len(after[i].text) for i in after)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = {i for i, r in before.items() for n, k, _ in [contamination(r.text, items, 13)] if k and 20 * k >= n}
            assert set(after) == set(before) - bad
        else:
            assert set(after) == set(before)
            assert all(r.size == len((before[i].text or "").encode().split()) and 0 <= r.taken <= 3 * r.size for i, r in after.items())
            assert sum(r.taken for r in after.values()) == sum(r.size for r in after.values())
            most = max(r.size for r in after.values())
            for source in {r.source for r in after.values()}:
                own = [r for r in after.values() if r.source == source]
                assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * most
    assert len(pipeline.STAGES) == 5


def test_stages_with_odd_rows(spark):
    """Null ids, texts and sources, repeated rows, and columns whose names the operators use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = docs.collect()
    extra = [r.asDict() for r in rows[:3]] + [rows[4].asDict() | {"doc_id": None}, rows[5].asDict() | {"doc_id": None}, rows[6].asDict() | {"text": None}, rows[7].asDict() | {"source": None, "lang": None}]
    odd = docs.unionByName(spark.createDataFrame([tuple(e[c] for c in docs.columns) for e in extra], docs.schema))
    for name in ("d", "h", "spans", "rest", "comp", "size", "hit", "__hit", "score", "taken", "c", "k"):
        odd = odd.withColumn(name, F.lit(7))
    for name, stage in pipeline.STAGES[:-1]:
        before, columns = odd.count(), odd.columns
        odd = pipeline.written(stage(spark, odd, SF), name)
        assert odd.columns == columns and 0 < odd.count() <= before and odd.filter("taken != 7 or h != 7 or __hit != 7").count() == 0
        if name == "near_copies":
            assert odd.count() == odd.distinct().count()
    assert pipeline.STAGES[-1][1](spark, odd, SF).count() == odd.count()


def test_stages_with_empty_tables(spark):
    none = pipeline.written(spark.read.parquet(f"{SF}/documents.parquet").limit(0), "none")
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_run(spark):
    rows = pipeline.run(spark, SF)
    assert {"doc_id", "taken"} <= set(rows.columns) and rows.count() > 0


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=key)


def test_tables_of_steps_have_no_marker(spark):
    """The driver starts two processes for each ``_SUCCESS`` file, in whose first moment its memory counts twice."""
    import os

    from lattiq.llm.common import written
    from lattiq.operators import shared

    for table in (written(spark.range(3), "a"), shared.written(spark.range(3), "b"), written(spark.range(0), "c")):
        files = os.listdir(table.written_to.removeprefix("file:"))
        assert any(f.endswith(".parquet") for f in files) and not any("_SUCCESS" in f for f in files)
        assert table.count() in (0, 3)

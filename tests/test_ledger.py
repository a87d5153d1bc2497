"""Resumable studies and bundles with checked columns."""

import pytest
from pyspark.sql import functions as F

from lattiq.plans.ledger import Ledger, held_out_study
from lattiq.sources import readers, writers


def test_interrupted_matrix_continues(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/study", []

    def one(fold, seed, condition):
        calls.append((fold, seed, condition))
        if len(calls) == 4:
            raise RuntimeError("lost")
        return spark.createDataFrame([(fold + seed / 100, None)], "auprc double, auroc double")

    args = (folder, [0, 1], [42, 43], ["auto", "clean"], {"k": 1, "metric": "cosine"}, one, ["auprc", "auroc"])
    with pytest.raises(RuntimeError):
        held_out_study(spark, *args, n_boot=50)
    assert len(calls) == 4
    assert held_out_study(spark, *args, limit=2, n_boot=50) is None and calls[4] == calls[3]  # the lost job first
    table = held_out_study(spark, *args, n_boot=50).collect()
    assert len(calls) == 9 and len(set(calls)) == 8
    assert {(r.condition, r.metric, r.n_rows, r.n) for r in table} == {(c, m, 4, 4 if m == "auprc" else 0) for c in ("auto", "clean") for m in ("auprc", "auroc")}
    held_out_study(spark, *args, n_boot=50)
    assert len(calls) == 9  # nothing is run twice
    with pytest.raises(ValueError, match="other settings"):
        held_out_study(spark, *args[:4], {"k": 2, "metric": "cosine"}, one, ["auprc"], n_boot=50)


def test_half_written_results_do_not_count(spark, tmp_path):
    jobs = spark.createDataFrame([(1,), (2,)], "job int")
    ledger = Ledger(spark, f"file://{tmp_path}/s", jobs, {})
    with pytest.raises(ValueError):
        ledger.results()
    with pytest.raises(Exception):
        ledger.run(lambda job: spark.range(3).select(F.raise_error(F.lit("gone")).alias("x")))
    assert ledger.open() == [(1,), (2,)]
    with pytest.raises(ValueError, match="columns of jobs"):
        ledger.run(lambda job: spark.range(1).select(F.col("id").alias("job")))
    assert ledger.run(lambda job: spark.range(job).select(F.col("id").alias("x")), limit=1) == 1 and ledger.open() == [(2,)]
    with pytest.raises(ValueError, match="1 jobs are open"):
        ledger.finished()
    ledger.run(lambda job: spark.range(job).select(F.col("id").alias("x")))
    assert sorted(tuple(r) for r in ledger.finished().collect()) == [(1, 0), (2, 0), (2, 1)]
    with pytest.raises(ValueError, match="twice"):
        Ledger(spark, f"file://{tmp_path}/t", jobs.union(jobs), {})


def test_bundles_have_checked_columns(spark, tmp_path):
    good = spark.createDataFrame([("a", 0, 1, 0.5, True, "more")], "image_id string, row long, col int, score float, valid boolean, more string")
    good.write.parquet(f"{tmp_path}/good")
    got = readers.bundle(spark, [f"{tmp_path}/good"], "scores")
    assert got.columns == ["image_id", "row", "col", "score", "valid", "path"] and dict(got.dtypes)["row"] == "int" and got.first().score == 0.5
    for name, change in (("lacks", good.drop("valid")), ("kinds", good.withColumn("score", F.lit("x"))), ("place", good.withColumn("row", F.lit(None).cast("long")))):
        change.write.parquet(f"{tmp_path}/{name}")
        with pytest.raises(ValueError, match="lacks|kinds|place"):
            readers.bundle(spark, [f"{tmp_path}/{name}"], "scores")
    with pytest.raises(ValueError, match="unknown"):
        readers.bundle(spark, [f"{tmp_path}/good"], "other")
    with pytest.raises(ValueError, match="more, valid"):
        readers.strict_runs(good, {"more": "x", "image_id": "a", "valid": False})
    assert readers.strict_runs(good, {"more": "more"}).count() == 1


def test_gap_csv(spark, tmp_path):
    runs = spark.createDataFrame([("oracle", 0, 1, 0.9), ("auto", 0, 1, 0.7), ("auto", 1, 1, 0.2)], "condition string, fold int, seed int, auprc double")
    writers.gap_csv(runs, "oracle", "auto", ["auprc"], f"{tmp_path}/gap")
    rows = spark.read.csv(f"{tmp_path}/gap", header=True, inferSchema=True).collect()
    assert len(rows) == 1 and rows[0].metric == "auprc" and abs(rows[0].gap - 0.2) < 1e-12

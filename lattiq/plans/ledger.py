"""Studies that continue where they were interrupted.

A study is a bounded list of jobs under fixed settings, in one folder that all machines share. The settings' fingerprint is
written first, and a folder of other settings is refused. A job's result is written aside and then moved to its place, so
what is in place is whole; only jobs without a result in place are run.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bootstrap import condition_table
from ..operators.shared import placed, present
from ..operators.study import held_out_matrix


def fingerprint(settings: Mapping) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


class Ledger:
    """Jobs (a table whose rows are distinct) and their results in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, jobs: DataFrame, settings: Mapping):
        self.spark, self.folder, self.keys, self.kinds = spark, folder.rstrip("/"), jobs.columns, dict(jobs.dtypes)
        self.jobs = sorted(tuple(r) for r in jobs.collect())  # as many as a study has runs
        if len(set(self.jobs)) < len(self.jobs):
            raise ValueError("a job is listed twice")
        self.mark = fingerprint({"settings": settings, "jobs": self.keys})
        known = self._path("settings")
        if present(self.spark, known):
            found = spark.read.text(known).first()[0]
            if found != self.mark:
                raise ValueError("the folder holds a study of other settings")
        else:
            placed(self.spark, spark.createDataFrame([(self.mark,)], "value string").coalesce(1).write.format("text"), known)

    def _path(self, *parts: str) -> str:
        return "/".join([self.folder, *parts])

    def name(self, job: Sequence) -> str:
        return fingerprint({"job": list(job)})[:32]

    def open(self) -> list[tuple]:
        """Jobs without a result, in order."""
        return [j for j in self.jobs if not present(self.spark, self._path("results", self.name(j)))]

    def run(self, one: Callable[..., DataFrame], limit: int | None = None) -> int:
        """Runs open jobs (at most ``limit``); ``one`` takes a job's columns by name and gives its result table, whose columns must
        not clash with them. How many were run."""
        todo = self.open()[:limit]
        for job in todo:
            made = one(**dict(zip(self.keys, job)))
            if clash := set(made.columns) & set(self.keys):
                raise ValueError(f"results have columns of jobs: {', '.join(sorted(clash))}")
            for k, v in zip(self.keys, job):
                made = made.withColumn(k, F.lit(v).cast(self.kinds[k]))
            placed(self.spark, made.write.format("parquet"), self._path("results", self.name(job)))
        return len(todo)

    def results(self) -> DataFrame:
        """All results in place, with their jobs' columns first; an error while there is none."""
        done = [self._path("results", self.name(j)) for j in self.jobs if present(self.spark, self._path("results", self.name(j)))]
        if not done:
            raise ValueError("no job has a result yet")
        rows = self.spark.read.parquet(*done)
        return rows.select(*self.keys, *[c for c in rows.columns if c not in self.keys])

    def finished(self) -> DataFrame:
        """``results``, once no job is open."""
        if left := len(self.open()):
            raise ValueError(f"{left} jobs are open")
        return self.results()


def held_out_study(spark: SparkSession, folder: str, folds: Sequence[int], seeds: Sequence[int], conditions: Sequence[str], settings: Mapping, one: Callable[..., DataFrame], metrics: Sequence[str], limit: int | None = None, n_boot: int = 2000) -> DataFrame | None:
    """The held-out matrix: every condition, fold and seed is a job. The table of conditions with intervals once all have results,
    None before."""
    ledger = Ledger(spark, folder, held_out_matrix(spark, folds, seeds, conditions), settings)
    ledger.run(one, limit)
    return None if ledger.open() else condition_table(ledger.finished(), metrics, n_boot=n_boot)

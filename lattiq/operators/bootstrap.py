"""Bootstrap intervals of means over any number of rows.

A draw of n rows with replacement is a multinomial count of each row. The counts of a draw are split down a tree over the rows
in order of value: each node gives its left half a binomial share of what it has, by a generator that its place in the tree
seeds. So the task of a leaf finds its own share of every draw by going down from the root, without a word from any other,
and draws come out alike however rows are partitioned. With groups, a tree over the groups says first how often each is
drawn, and every time it is, as many rows are drawn of it as it has.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from .order import cumulated, with_ranges

#: Rows of a leaf, and counts that a leaf holds at once.
LEAF, HELD = 1 << 14, 1 << 20
GROUPS, ROWS, PICKS = range(3)


def _generator(*place: int) -> np.random.Generator:
    return np.random.default_rng([int(p) & 0xFFFFFFFFFFFFFFFF for p in place])


def share(total: np.ndarray, places: int, leaf: int, size: int, seeds: tuple) -> np.ndarray:
    """How many of each draw's ``total`` picks of ``places`` fall to a leaf, the ``leaf``-th of ``size`` places."""
    low, high = 0, -(-places // size)
    while high - low > 1:
        middle = (low + high) // 2
        left, whole = (middle - low) * size, min(high * size, places) - low * size
        to_left = _generator(*seeds, low, high).binomial(total, left / whole)
        low, high, total = (low, middle, to_left) if leaf < middle else (middle, high, total - to_left)
    return total


def leaf_sums(values: np.ndarray, picks: np.ndarray, leaf: int, seeds: tuple) -> np.ndarray:
    """The sum of each draw's ``picks`` of the values of a leaf."""
    rng, out = _generator(*seeds, leaf), np.empty(len(picks))
    even, step = np.full(len(values), 1.0 / len(values)), max(1, HELD // len(values))
    for i in range(0, len(picks), step):
        out[i : i + step] = rng.multinomial(picks[i : i + step], even) @ values
    return out


def bootstrap(rows: DataFrame, keys: Sequence[str], value: str = "value", n_boot: int = 2000, seed: int = 42, group: str | None = None, alpha: float = 0.05, leaf: int = LEAF) -> DataFrame:
    """(keys, ``n``, ``mean``, ``ci_low``, ``ci_high``): the mean of the finite values of each key with its percentile interval over
    ``n_boot`` draws; with ``group``, groups are drawn first, then rows of each. Keys without a value have no row."""
    sub = [*keys, *([group] if group and group not in keys else [])]
    rows = rows.select(*sub, F.col(value).cast("double").alias("__x")).filter(finite(F.col("__x")).isNotNull())
    sizes = rows.groupBy(*sub).agg(F.count("*").alias("__n"))
    of_key = Window.partitionBy(*keys)  # a row for each group
    sizes = sizes.withColumn("__groups", F.count("*").over(of_key)).withColumn("__group", F.row_number().over(of_key.orderBy(*sub)) - 1)
    placed = cumulated(with_ranges(rows, F.col("__x")), "__part", [F.col("__x")], {"__i": F.lit(1).cast("long")}, sub).drop("__part")
    placed = placed.withColumn("__leaf", F.floor((F.col("__i") - 1) / leaf).cast("long")).alias("p")
    match = F.lit(True)
    for c in sub:
        match = match & F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}"))
    joined = placed.join(sizes.alias("s"), match).select(*[f"p.{c}" for c in sub], "__x", "__leaf", "__n", "__groups", "__group", F.xxhash64(F.lit("key"), *[F.col(f"p.{c}").cast("string") for c in keys]).alias("__key"))
    grouped = group is not None

    def one(t: pa.Table) -> pa.Table:
        first = {c: t.column(c)[0].as_py() for c in ("__leaf", "__n", "__groups", "__group", "__key")}
        x = np.sort(t.column("__x").to_numpy())
        n, at, own = first["__n"], first["__leaf"], (seed, first["__key"])
        total = np.full(n_boot, n)
        if grouped:
            total = share(np.full(n_boot, first["__groups"]), first["__groups"], first["__group"], 1, (*own, GROUPS)) * n
        picks = share(total, n, at, leaf, (*own, ROWS, first["__group"]))
        sums = leaf_sums(x, picks, at, (*own, PICKS, first["__group"]))
        same = [pa.repeat(t.column(c)[0], n_boot) for c in keys]
        return pa.table([*same, pa.array(np.arange(n_boot), pa.int32()), pa.array(sums), pa.array(picks, pa.int64())], names=[*keys, "__draw", "__sum", "__picks"])

    kinds = [f"`{c}` {t}" for c, t in rows.select(*keys).dtypes]
    drawn = joined.groupBy(*sub, "__leaf").applyInArrow(one, ", ".join([*kinds, "__draw int", "__sum double", "__picks long"]))
    means = drawn.groupBy(*keys, "__draw").agg((F.sum("__sum") / F.sum("__picks")).alias("__mean"))
    ends = means.groupBy(*keys).agg(F.percentile("__mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("__ends")).alias("e")
    facts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("__x").alias("mean")).alias("f")
    match = F.lit(True)
    for c in keys:
        match = match & F.col(f"f.{c}").eqNullSafe(F.col(f"e.{c}"))
    return facts.join(ends, match).select(*[f"f.{c}" for c in keys], "n", "mean", F.col("__ends")[0].alias("ci_low"), F.col("__ends")[1].alias("ci_high"))


def condition_table(runs: DataFrame, metrics: Sequence[str], condition: str = "condition", n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """(condition, ``n_rows``, metric, n, mean, ci_low, ci_high): all runs of each condition, and of each metric the known values with
    the interval of their mean; a metric that no run of a condition knows has nulls and n = 0."""
    long = runs.unpivot([condition], list(metrics), "metric", "value")
    all_ = runs.groupBy(condition).agg(F.count("*").alias("n_rows")).withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
    found = bootstrap(long, [condition, "metric"], n_boot=n_boot, seed=seed)
    a, b = all_.alias("a"), found.alias("b")
    match = F.col(f"a.{condition}").eqNullSafe(F.col(f"b.{condition}")) & (F.col("a.metric") == F.col("b.metric"))
    return a.join(b, match, "left").select(f"a.{condition}", "n_rows", "a.metric", F.coalesce("n", F.lit(0)).alias("n"), "mean", "ci_low", "ci_high")

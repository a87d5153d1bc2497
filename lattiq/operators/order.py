"""Ranks, running sums and exact percentiles over tables of any size, by the digits of values.

A double's 64 bits, turned so that they order as the values do, are cut in digits of 22, 21 and 21 bits. Percentiles are found
digit by digit: a histogram of the first one tells which digit holds each wanted rank, of the rows there a histogram of the
second, and so on. Running sums go over ranges of equal leading digits, a range with too many rows being cut by the second
digit too. Nothing is sampled, and no task sorts more than ``RANGE_ROWS`` or the values of two equal digits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import code
from .shared import written

#: Rows from which on a range of equal first digits is cut by the second digit too.
RANGE_ROWS = 1 << 21
#: Low bits after the first and after the second digit.
AFTER_FIRST, AFTER_SECOND = 42, 21
#: Rows up to which a top-n ends in one task.
ONE_TASK = 100_000
_ALL_BUT_SIGN = np.int64(0x7FFFFFFFFFFFFFFF)


def _turned(b: np.ndarray) -> np.ndarray:
    """Bits of doubles as longs of the same order, and back."""
    return np.where(b < 0, b ^ _ALL_BUT_SIGN, b)


def ordered_bits(x: Column) -> Column:
    """A long that orders as the double does; zeros are alike, NaN comes last, null stays null."""

    @F.arrow_udf(T.LongType())
    def bits(v: pa.Array) -> pa.Array:
        known = v.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        known[np.isnan(known)] = np.nan
        return pa.array(_turned(known.view(np.int64)), mask=v.is_null().to_numpy(zero_copy_only=False))

    return bits(x.cast("double"))


def value_of(bits: Column) -> Column:
    """The double of ``ordered_bits``."""

    @F.arrow_udf(T.DoubleType())
    def value(b: pa.Array) -> pa.Array:
        found = _turned(b.fill_null(0).to_numpy(zero_copy_only=False)).view(np.float64)
        return pa.array(found, mask=b.is_null().to_numpy(zero_copy_only=False), from_pandas=False)

    return value(bits)


def _joined(rows: DataFrame, small: DataFrame, keys: Sequence[str], on: Sequence[str], bounded: bool) -> DataFrame:
    """An inner join in which nulls are equal, so that no filter for nulls goes down below the shuffle that the scans share;
    ``small`` is broadcast only where its size is bounded."""
    names = [*keys, *on]
    other = small.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(names)], *[c for c in small.columns if c not in names])
    match = F.lit(True)
    for i, k in enumerate(names):
        match = match & F.col(k).eqNullSafe(F.col(f"__j{i}"))
    return rows.join(F.broadcast(other) if bounded else other, match).drop(*[f"__j{i}" for i in range(len(names))])


def percentiles(df: DataFrame, score: str, levels: Sequence[float], keys: Sequence[str] = (), times: str | None = None) -> DataFrame:
    """(keys, ``ps``): exact percentiles at ``levels`` (0 to 1) with linear interpolation, as an array; a null array where a key
    has no value. ``times`` is a column that says how often a row counts.

    All levels and keys go together: values are collapsed in one shuffle, and of them come three histograms, each of the next
    digit of the values that the one before has left for a wanted rank. No task holds more than the digits of a key.
    """
    bit = F.col("__b")
    rows = df.select(*keys, ordered_bits(F.col(score)).alias("__b"), F.lit(1).cast("long").alias("__c") if times is None else F.col(times).alias("__c"))
    rows = rows.groupBy(*keys, "__b").agg(F.coalesce(F.sum(F.when(bit.isNotNull(), F.col("__c"))), F.lit(0)).alias("__c"))
    low = (1 << AFTER_SECOND) - 1
    rows = rows.select(*keys, "__c", F.shiftright(bit, AFTER_FIRST).alias("__1"), F.shiftright(bit, AFTER_SECOND).bitwiseAND(F.lit(low)).alias("__2"), bit.bitwiseAND(F.lit(low)).alias("__3"))
    wanted = None
    for digit in (1, 2, 3):
        before = [f"__{i}" for i in range(1, digit)]
        left = rows if wanted is None else _joined(rows, wanted, keys, before, not keys)
        extra = [] if wanted is None else [F.first("__want").alias("__want")]
        hist = left.groupBy(*keys, *before, f"__{digit}").agg(F.sum("__c").alias("__c"), *extra)
        w = Window.partitionBy(*keys, *before)
        hist = hist.withColumn("__upto", F.sum("__c").over(w.orderBy(f"__{digit}").rowsBetween(Window.unboundedPreceding, 0)))
        if wanted is None:
            first = hist.withColumn("__n", F.sum("__c").over(w))
            at = [F.lit(float(q)) * (F.col("__n") - 1) for q in levels]
            ranks = [F.struct(F.lit(2 * i + j).alias("i"), f(a).cast("long").alias("rank"), a.alias("at")) for i, a in enumerate(at) for j, f in enumerate((F.floor, F.ceil))]
            hist = first.withColumn("__want", F.array(*ranks)).drop("__n")
        start = F.col("__upto") - F.col("__c")
        here = F.transform(
            F.filter("__want", lambda r: (r["rank"] >= start) & (r["rank"] < F.col("__upto"))),
            lambda r: F.struct(r["i"].alias("i"), (r["rank"] - start).alias("rank"), r["at"].alias("at")),
        )
        wanted = hist.select(*keys, *before, f"__{digit}", here.alias("__want")).filter(F.size("__want") > 0)
    bits = F.shiftleft("__1", AFTER_FIRST).bitwiseOR(F.shiftleft("__2", AFTER_SECOND)).bitwiseOR(F.col("__3"))
    found = wanted.select(*keys, value_of(bits).alias("__v"), F.explode("__want").alias("__r"))
    parts = [F.max(F.when(F.col("__r.i") == i, F.col("__v"))).alias(f"__p{i}") for i in range(2 * len(levels))]
    parts += [F.max(F.when(F.col("__r.i") == 2 * i, F.col("__r.at"))).alias(f"__a{i}") for i in range(len(levels))]
    found = found.groupBy(*keys).agg(*parts)

    def between(i: int) -> Column:
        lower, upper, place = F.col(f"__p{2 * i}"), F.col(f"__p{2 * i + 1}"), F.col(f"__a{i}")
        return F.when(lower == upper, lower).otherwise((F.ceil(place) - place) * lower + (place - F.floor(place)) * upper)

    found = found.select(*keys, F.array(*[between(i) for i in range(len(levels))]).alias("ps"))
    if not keys:  # one row even of no values
        return found.select(F.when(F.get("ps", F.lit(0)).isNotNull(), F.col("ps")).alias("ps"))
    left, right = rows.select(*keys).distinct().alias("l"), found.alias("r")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, match, "left").select("l.*", "r.ps")


def with_ranges(rows: DataFrame, order: Column, name: str = "__part") -> DataFrame:
    """Adds each row's range (a long) in ascending order of a numeric column, whose equal values share one. Ranges are of equal
    first digits, those of more than ``RANGE_ROWS`` rows of equal first and second digits."""
    # never null, so that no filter for nulls goes down below a shuffle that all readers of ``rows`` share
    first = F.coalesce(F.shiftright("__b", AFTER_FIRST), F.lit(-(1 << 22)).cast("long"))
    rows = rows.withColumn("__b", ordered_bits(order)).withColumn("__first", first)
    crowded = rows.groupBy(F.col("__first").alias("__full")).count().filter(F.col("count") > RANGE_ROWS).select("__full")  # at most a row per RANGE_ROWS
    rows = rows.join(F.broadcast(crowded), F.col("__first") == F.col("__full"), "left")
    finer = F.when(F.col("__full").isNotNull(), F.shiftright("__b", AFTER_SECOND)).otherwise(F.shiftleft("__first", AFTER_FIRST - AFTER_SECOND))
    return rows.withColumn(name, F.coalesce(finer, F.lit(-(1 << 43)).cast("long"))).drop("__b", "__first", "__full")


def in_ranges(rows: DataFrame, leads: Sequence[Column], name: str = "__part") -> DataFrame:
    """The same for any columns: the table is written in ranges of ``leads``, as many as the session has shuffle partitions."""
    return written(rows.repartitionByRange(*leads).withColumn(name, F.spark_partition_id()), "ranges")


def cumulated(rows: DataFrame, part: str, order: Sequence[Column], sums: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Adds running sums (name -> what is summed) in ``order`` within ``keys``; ``part`` has each row's range."""
    heads = rows.groupBy(*keys, part).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    ahead = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # over the ranges of a key
    heads = heads.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], F.col(part).alias("__h"), *[F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    match = F.col(part) == F.col("__h")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__h{i}"))
    rows = rows.join(heads, match).drop("__h", *[f"__h{i}" for i in range(len(keys))])
    return rows.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop(*[f"__{n}" for n in sums])


def ranked(df: DataFrame, leads: Sequence[Column], rows: int | None = None, name: str = "rank") -> DataFrame:
    """Adds the rank from 0 in ascending order of ``leads``."""
    cut = in_ranges(df, leads)
    return cumulated(cut, "__part", leads, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1).drop("__part")


def hash_rank(items: DataFrame, namespace: str, seed: int, ident: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank`` from 0 by sha256 code, ties by id, within ``keys``. Codes are even, so their first digits cut the rows into
    4,096 parts: counts of parts are cumulated, then rows are ranked inside each part."""
    rows = items.withColumn("__c", code(namespace, seed, F.col(ident))).withColumn("__b", F.substring("__c", 1, 3))
    heads = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__h"), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    match = F.col("__b") == F.col("__h")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__c", ident)) - 1
    return rows.withColumn("rank", inside).join(heads, match).withColumn("rank", F.col("rank") + F.col("__before")).drop("__c", "__b", "__h", "__before", *[f"__k{i}" for i in range(len(keys))])


def first_n(df: DataFrame, leads: Sequence[Column], n: int) -> DataFrame:
    """The n first rows in ascending order of ``leads``: by a top-n, whose last task holds n rows, only where n is small."""
    if n <= ONE_TASK:
        return df.orderBy(*leads).limit(n)
    return ranked(df, leads, name="__rank").filter(F.col("__rank") < n).drop("__rank")


def with_previous(df: DataFrame, leads: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """Adds columns (new name -> column) of the row before, in ascending order of ``leads``; null for the first."""
    cut = in_ranges(df, [F.col(c) for c in leads])
    last = cut.groupBy("__part").agg(F.max(F.struct(*leads, *[F.col(c).alias(f"__{n}") for n, c in names.items()])).alias("__l"))
    over = Window.orderBy("__part")  # one row a range
    heads = last.select(F.col("__part").alias("__h"), F.lag("__l").over(over).alias("__l"))
    inside = Window.partitionBy("__part").orderBy(*leads)
    rows = cut.withColumns({n: F.lag(c).over(inside) for n, c in names.items()}).withColumn("__first", F.row_number().over(inside) == 1)
    rows = rows.join(F.broadcast(heads), F.col("__part") == F.col("__h"), "left")
    return rows.withColumns({n: F.when(F.col("__first"), F.col(f"__l.__{n}")).otherwise(F.col(n)) for n in names}).drop("__part", "__h", "__l", "__first")

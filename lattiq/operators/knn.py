"""Exact nearest neighbours of query vectors in a memory bank.

A bank whose size is known to fit is broadcast as one matrix and queries stream past it in one map stage. A larger bank is
cut into blocks; every block meets the query blocks in a keyed join, and the k best of each block are merged. Both score
all pairs by products of pieces, so that a worker holds as many distances for a large bank as for a small one. ``strategy="sql"`` writes the same as plain expressions over pairs, for small inputs, and
``strategy="cells"`` prunes by the triangle inequality, for banks that have clusters (module ``cells``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dot, norm, squared_distance
from .shared import small_batches

#: Bytes of a bank (8 a component) up to which it is broadcast.
BROADCAST_BYTES = 128 << 20
#: Bytes of vectors that a block of either side holds, so that both sides of a larger search are copied about equally.
BLOCK_BYTES = 16 << 20
#: Queries and bank rows whose distances a worker holds at once (8 MiB of them), whatever the bank's size.
QUERIES, BANK_ROWS = 512, 2048
#: Bytes of counts that a task of ``mutual_scores`` holds, and of distances where its patches are broadcast.
HELD_BYTES, ROW_BYTES = 128 << 20, 8 << 20
FOUND = "query_id long, bank_id long, dist double"
MUTUAL = "id long, grp long, score double"


def _ready(m: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as ``_between`` takes them: of length 1 for ``cosine``."""
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if metric == "cosine" else m


def _between(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    d = q @ b.T
    if metric == "cosine":
        return np.subtract(1.0, d, out=d)
    d *= -2.0
    d += (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :]
    return np.sqrt(np.maximum(d, 0.0, out=d), out=d)


def distances(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """``cosine``: 1 - cos with lengths of at least 1e-12; ``l2``: Euclidean."""
    return _between(_ready(q, metric), _ready(b, metric), metric)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


class _Best:
    """The k nearest bank rows so far of a few queries, by distance and then by bank id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.row, self.dist, self.bank = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.limit, self.limit_id = np.full(n, np.finfo(float).max), np.full(n, np.iinfo(np.int64).max)

    def take(self, d: np.ndarray, bank_ids: np.ndarray) -> None:
        if self.k == 1:
            cut = np.fmin.reduce(d, axis=1)
        else:
            at = min(self.k, d.shape[1]) - 1
            cut = np.partition(d, at, axis=1)[:, at]
        row, col = np.nonzero(d <= np.fmin(cut, self.limit)[:, None])
        dist, bank = d[row, col], bank_ids[col]
        new = (dist < self.limit[row]) | (bank < self.limit_id[row])
        if not new.any():
            return
        row, dist, bank = (np.r_[x, y[new]] for x, y in ((self.row, row), (self.dist, dist), (self.bank, bank)))
        order = np.lexsort((bank, dist, row))
        row, dist, bank = row[order], dist[order], bank[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        self.row, self.dist, self.bank = (x[rank < self.k] for x in (row, dist, bank))
        last = rank == self.k - 1
        self.limit[row[last]], self.limit_id[row[last]] = dist[last], bank[last]


def _nearest(ids, groups, vectors, bank_ids, bank_groups, bank, k: int, metric: str):
    """The k nearest bank rows of each query, ties to smaller bank ids; rows of the query's own group don't count."""
    starts = range(0, len(ids), QUERIES)
    q = [_ready(vectors[i : i + QUERIES], metric) for i in starts]
    best = [_Best(len(x), k) for x in q]
    for j in range(0, len(bank_ids), BANK_ROWS):
        b, b_ids, b_groups = _ready(bank[j : j + BANK_ROWS], metric), bank_ids[j : j + BANK_ROWS], bank_groups[j : j + BANK_ROWS]
        kinds = np.unique(b_groups)
        for i, x, found in zip(starts, q, best):
            own = groups[i : i + QUERIES]
            d = _between(x, b, metric)
            if np.isin(own, kinds).any():
                d[own[:, None] == b_groups[None, :]] = np.inf
            found.take(d, b_ids)
    out = [(ids[i + f.row], f.bank, f.dist) for i, f in zip(starts, best)]
    cols = [np.concatenate(x) if len(x) else np.array([], t) for x, t in zip(zip(*out) if out else [()] * 3, (np.int64, np.int64, float))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "bank_id", "dist"])


def nearest(queries: DataFrame, bank: DataFrame, k: int = 1, metric: str = "cosine", strategy: str = "auto", limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``query_id, bank_id, dist, rank`` for (id, features[, grp]) tables. A query's candidates are all bank rows whose ``grp``
    differs from its own (no column: all). Fewer candidates give fewer rows. ``strategy`` is ``auto``, ``blocks``, ``sql`` or
    ``cells``, which meets only the cells of the bank that can hold a neighbour (query ids must be distinct) and adds
    ``compared``, the bank rows that the query was held against."""
    have = "grp" in queries.columns and "grp" in bank.columns
    q = queries.select("id", (F.col("grp") if have else F.lit(-1)).cast("long").alias("grp"), "features").filter("features IS NOT NULL")
    b = bank.select("id", (F.col("grp") if have else F.lit(-2)).cast("long").alias("grp"), "features").filter("features IS NOT NULL")
    if strategy == "sql":
        return _by_expressions(q, b, k, metric)
    if strategy == "cells":
        from .cells import pruned

        found, compared = pruned(q, b, k, metric)
        w = Window.partitionBy("query_id").orderBy("dist", "bank_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).join(compared, "query_id")
    size = b.agg(F.coalesce(F.sum(F.size("features")), F.lit(0))).first()[0] * 8
    found = _broadcast(q, b, k, metric) if size <= limit_bytes and strategy != "blocks" else _blocks(q, b, k, metric)
    w = Window.partitionBy("query_id").orderBy("dist", "bank_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _broadcast(q: DataFrame, b: DataFrame, k: int, metric: str, search=_nearest) -> DataFrame:
    rows = b.toArrow().combine_chunks()
    n = rows.num_rows
    ids, grp = (rows.column(c).to_numpy() for c in ("id", "grp"))
    shared = q.sparkSession.sparkContext.broadcast((ids, grp, _matrix(rows.column("features").combine_chunks()) if n else None))

    def score(batches):
        bank_ids, bank_groups, matrix = shared.value
        for x in batches:
            if x.num_rows and len(bank_ids):
                yield search(x.column(0).to_numpy(), x.column(1).to_numpy(), _matrix(x.column(2)), bank_ids, bank_groups, matrix, k, metric)

    return q.mapInArrow(score, FOUND)


def _blocks(q: DataFrame, b: DataFrame, k: int, metric: str, search=_nearest) -> DataFrame:
    def packed(rows: DataFrame, name: str, count: int) -> DataFrame:
        return rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).groupBy("blk").agg(F.collect_list(F.struct("id", "grp", "features")).alias(name))

    small_batches(q.sparkSession)
    n_q, n_b = (max(1, -(-8 * (x.agg(F.sum(F.size("features"))).first()[0] or 0) // BLOCK_BYTES)) for x in (q, b))
    spread = min(n_b, 256)
    left = packed(q, "q", n_q).select("q", F.col("blk").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("s"))
    right = packed(b, "b", n_b).select("b", F.pmod("blk", F.lit(spread)).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("i"))

    def score(batches):
        for x in batches:
            for i in range(x.num_rows):
                u, v = x.column(0)[i].values, x.column(1)[i].values
                yield search(u.field(0).to_numpy(), u.field(1).to_numpy(), _matrix(u.field(2)), v.field(0).to_numpy(), v.field(1).to_numpy(), _matrix(v.field(2)), k, metric)

    return left.join(right, ["i", "s"]).select("q", "b").mapInArrow(score, FOUND)


def _by_expressions(q: DataFrame, b: DataFrame, k: int, metric: str) -> DataFrame:
    pairs = q.select(F.col("id").alias("query_id"), F.col("grp").alias("g"), F.col("features").alias("x")).join(
        b.select(F.col("id").alias("bank_id"), F.col("grp").alias("h"), F.col("features").alias("y")), F.col("g") != F.col("h")
    )
    if metric == "cosine":
        dist = 1.0 - dot(F.col("x"), F.col("y")) / (F.greatest(norm(F.col("x")), F.lit(1e-12)) * F.greatest(norm(F.col("y")), F.lit(1e-12)))
    else:
        dist = F.sqrt(squared_distance(F.col("x"), F.col("y")))
    w = Window.partitionBy("query_id").orderBy("dist", "bank_id")
    return pairs.select("query_id", "bank_id", dist.alias("dist")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_scores(queries: DataFrame, bank: DataFrame, k: int = 1, metric: str = "cosine", **how) -> DataFrame:
    """``query_id, score``: the mean of the k distances for ``cosine``; the root of the mean square for ``l2``."""
    d = F.col("dist")
    value = F.avg(d) if metric == "cosine" else F.sqrt(F.avg(d * d))
    return nearest(queries, bank, k, metric, **how).groupBy("query_id").agg(value.alias("score"))


def left_out(rows: DataFrame, by: str, metric: str = "cosine", **how) -> DataFrame:
    """``query_id, score``: distance of each row to the nearest of another group (``by`` = image or id); 0 with nothing else."""
    own = rows.withColumn("grp", F.col(by))
    found = knn_scores(own, own, 1, metric, **how)
    return rows.select(F.col("id").alias("query_id")).join(found, "query_id", "left").fillna(0.0, ["score"])


def with_provenance(found: DataFrame, bank: DataFrame) -> DataFrame:
    """Neighbours with what the bank knows of them (all its columns but the vector)."""
    facts = bank.drop("features").withColumnRenamed("id", "bank_id")
    return found.join(facts, "bank_id")


def _nearest_of_classes(ids, groups, vectors, bank_ids, classes, bank, k: int, metric: str):
    """For each query and class, the least distance; the class stands in the place of the bank id."""
    kinds = np.unique(classes)
    starts = range(0, len(ids), QUERIES)
    q = [_ready(vectors[i : i + QUERIES], metric) for i in starts]
    least = np.full((len(ids), len(kinds)), np.inf)
    for j in range(0, len(bank_ids), BANK_ROWS):
        own = classes[j : j + BANK_ROWS]
        order = np.argsort(own, kind="stable")
        there, first = np.unique(own[order], return_index=True)
        b, at = _ready(bank[j : j + BANK_ROWS][order], metric), np.searchsorted(kinds, there)
        for i, x in zip(starts, q):
            found = np.minimum.reduceat(_between(x, b, metric), first, axis=1)
            least[i : i + QUERIES, at] = np.minimum(least[i : i + QUERIES, at], found)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(kinds))), pa.array(np.tile(kinds, len(ids)).astype(np.int64)), pa.array(least.reshape(-1))], ["query_id", "bank_id", "dist"])


def class_scores(queries: DataFrame, bank: DataFrame, metric: str = "cosine", limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``query_id, class_id, dist``: distance to the nearest bank row of each class, all classes in one pass; no rows for an
    empty bank."""
    q = queries.select("id", F.lit(-1).cast("long").alias("grp"), "features").filter("features IS NOT NULL")
    b = bank.select("id", F.col("class_id").cast("long").alias("grp"), "features").filter("features IS NOT NULL AND class_id IS NOT NULL")
    size = b.agg(F.coalesce(F.sum(F.size("features")), F.lit(0))).first()[0] * 8
    found = (_broadcast if size <= limit_bytes else _blocks)(q, b, 1, metric, _nearest_of_classes)
    kind = dict(bank.dtypes)["class_id"]
    return found.groupBy("query_id", F.col("bank_id").cast(kind).alias("class_id")).agg(F.min("dist").alias("dist"))


def best_class(scores: DataFrame) -> DataFrame:
    """The nearest class of each query, ties to the smaller class."""
    return scores.groupBy("query_id").agg(F.min_by("class_id", F.struct("dist", "class_id")).alias("class_id"), F.min("dist").alias("dist"))


def _low_mean(other: np.ndarray, n: int) -> float | None:
    """The mean of values strictly below the n-th smallest."""
    low = other[other < np.partition(other, n - 1)[n - 1]] if n >= 1 else other[:0]
    return float(low.mean()) if len(low) else None


def _low_means(own, vectors, groups, matrix, q: float, metric: str) -> list[float | None]:
    """Scores of ``mutual_scores`` against a matrix of all patches (``_ready``), few at a time."""
    out, vectors = [], _ready(vectors, metric)
    step = min(256, max(1, ROW_BYTES // (8 * max(1, len(groups)))))
    for i in range(0, len(own), step):
        for mine, row in zip(own[i : i + step], _between(vectors[i : i + step], matrix, metric)):
            other = row[groups != mine]
            out.append(_low_mean(other, int(q * len(other))))
    return out


def mutual_scores(rows: DataFrame, q: float, metric: str = "cosine") -> DataFrame:
    """Zero-shot scores: each patch against all patches of other images; the mean of distances strictly below the int(q n)-th
    smallest. Null where that is none. Up to ``BROADCAST_BYTES`` all patches are broadcast; more go in passes over blocks
    (module ``mutual``)."""
    shared = rows.select("id", F.col("grp").cast("long").alias("grp"), "features")
    size = shared.agg(F.coalesce(F.sum(F.size("features")), F.lit(0))).first()[0] * 8
    if size > BROADCAST_BYTES:
        from .mutual import in_passes

        return in_passes(shared, q, metric, HELD_BYTES)
    table = shared.toArrow().combine_chunks()
    held = rows.sparkSession.sparkContext.broadcast((table.column("grp").to_numpy(), _ready(_matrix(table.column("features").combine_chunks()), metric)))

    def score(batches):
        groups, matrix = held.value
        for x in batches:
            out = _low_means(x.column(1).to_numpy(), _matrix(x.column(2)), groups, matrix, q, metric)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(out, pa.float64())], ["id", "grp", "score"])

    return shared.mapInArrow(score, MUTUAL)

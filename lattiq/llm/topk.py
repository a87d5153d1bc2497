"""Exact top-k search by exhaustive term-at-a-time accumulation.

Queries and candidates are cut into blocks of bounded size. For a pair of blocks, each term's postings (candidate, weight)
are scattered, times the queries' weights, into a dense array of scores; a partition selection keeps each query's k best of
the block, and a ranked window merges the blocks. All pairs of a query and a candidate are scored, nothing is pruned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_id long, query long, vec_id long, score long, own boolean"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, terms): floor(scale * x) of each component x as double. Vectors that are null, or hold a null or non-finite
    component, are left out; rows with a null id too."""
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists(F.col("v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), doubles.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
    return rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("terms"))


def _postings(terms: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term, the rows that have it and their weights."""
    sizes = np.diff(terms.offsets.to_numpy())
    flat = terms.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = flat != 0
    row, term, flat = row[some], term[some], flat[some]
    order = np.argsort(term, kind="stable")
    cuts = np.searchsorted(term[order], np.arange(int(sizes.max(initial=0)) + 1))
    return [(row[o], flat[o]) for o in np.split(order, cuts[1:-1])] if len(cuts) > 1 else []


def score_blocks(q_ids: np.ndarray, q_terms: pa.ListArray, c_ids: np.ndarray, c_terms: pa.ListArray, k: int, at_once: int = 64):
    """Each query's k + 1 best candidates of the block, the query's own row among them: (query id, place of the query,
    candidate id, score, whether the row equals the query), ties to smaller ids."""
    queries, postings = q_terms.to_pylist(), _postings(c_terms)
    most = max((abs(w) for t in queries for w in t), default=0) * max((int(np.abs(w).max(initial=0)) for _, w in postings), default=0) * max(len(postings), 1)
    kind = np.int64 if most < 2**62 else object  # exact beyond 64 bits too; the score then ends at the range of long
    order = np.argsort(c_ids, kind="stable")
    ids = c_ids[order]
    out = []
    for i in range(0, len(queries), at_once):
        part = queries[i : i + at_once]
        scores = np.zeros((len(part), len(c_ids)), kind)
        for t, (rows, weights) in enumerate(postings):
            w = np.array([q[t] if t < len(q) else 0 for q in part], kind)
            if not w.any():
                continue
            add = w[:, None] * weights.astype(kind)[None, :]
            if len(rows) == len(c_ids):
                scores += add
            else:
                scores[:, rows] += add
        scores = scores[:, order]
        if kind is object:
            scores = np.clip(scores, -(2**63), 2**63 - 1).astype(np.int64)
        for j, row in enumerate(scores):
            n = min(len(row), k + 1)
            cut = np.partition(row, len(row) - n)[len(row) - n]
            over, ties = np.flatnonzero(row > cut), np.flatnonzero(row == cut)
            best = np.r_[over, ties[: n - len(over)]]
            # the own row may stand beyond: one that equals the query is listed in any case
            same = np.arange(np.searchsorted(ids, q_ids[i + j]), np.searchsorted(ids, q_ids[i + j], "right"))
            equal = [x for x in same.tolist() if c_terms[int(order[x])].as_py() == part[j]][:1]
            best = np.union1d(best, np.array(equal, np.int64)).astype(np.int64)
            own = np.array([ids[x] == q_ids[i + j] and c_terms[int(order[x])].as_py() == part[j] for x in best.tolist()], bool)
            out.append((np.full(len(best), q_ids[i + j]), np.full(len(best), i + j), ids[best], row[best], own))
    return out


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 10, scale: int = 1024, query_block: int = 512, candidate_block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the k candidate rows that score highest (all, if fewer), ties to
    smaller ids; one candidate row that equals the query in id and vector is the query itself and left out.

    Repeated rows are rows of their own: a query row that occurs twice has its list twice, other rows of its id can be hits,
    and different vectors of one id each have a list. Null vectors, vectors with null or non-finite components and rows with
    a null id take no part. Empty tables give no rows; vectors may differ in length (missing terms are 0) and be very long.
    Other columns, whatever their names, are dropped.
    """
    # equal query rows are scored once
    q = quantised(queries, id_col, vector_col, scale).groupBy("id", "terms").agg(F.count("*").alias("copies")).withColumn("at", F.xxhash64("id", "terms"))
    c = quantised(candidates, id_col, vector_col, scale)
    n_q, n_c = q.count(), c.count()
    q_blocks, c_blocks = max(1, -(-n_q // query_block)), max(1, -(-n_c // candidate_block))
    spread = max(1, min(c_blocks, 2 * queries.sparkSession.sparkContext.defaultParallelism, 256))
    # rows of either side are dealt evenly by value and place; a candidate row goes to every query block, a query to every spread
    place = F.monotonically_increasing_id()
    c = c.withColumn("cb", F.pmod(F.xxhash64("id", place), F.lit(c_blocks)).cast("int"))
    c = c.groupBy("cb").agg(F.collect_list(F.struct("id", "terms")).alias("c"))
    q = q.withColumn("qb", F.pmod("at", F.lit(q_blocks)).cast("int"))
    several = q.select(F.col("id").alias("query_id"), F.col("at").alias("query"), "copies").filter("copies > 1")
    q = q.groupBy("qb").agg(F.collect_list(F.struct("id", "terms", "at")).alias("q"))
    q = q.select("qb", "q", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("s"))
    c = c.select("c", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), F.pmod("cb", F.lit(spread)).alias("s"))

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column(0)[i].values, batch.column(1)[i].values
                found = score_blocks(a.field(0).to_numpy(), a.field(1), b.field(0).to_numpy(), b.field(1), k)
                if not found:
                    continue
                ids, places, hits, scores, own = (np.concatenate([f[j] for f in found]) for j in range(5))
                cols = [pa.array(ids, pa.int64()), a.field(2).take(pa.array(places)), pa.array(hits, pa.int64()), pa.array(scores, pa.int64()), pa.array(own, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "query", "vec_id", "score", "own"])

    found = q.join(c, ["qb", "s"]).select("q", "c").mapInArrow(score, FOUND)
    # the first row that equals the query is the query; rank counts the others
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    before = F.coalesce(F.max(F.col("own").cast("int")).over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumns({"before": before, "n": F.row_number().over(best)}).filter((F.col("before") == 1) | ~F.col("own"))
    found = found.withColumn("rank", (F.col("n") - F.col("before")).cast("int")).filter(F.col("rank") <= k)
    found = found.join(several, ["query_id", "query"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))))
    return found.select("query_id", "rank", "vec_id", "score")

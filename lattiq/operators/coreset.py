"""Exact greedy farthest-point coresets of banks of any size.

The bank is a written table of blocks: a block's vectors, each row's least squared distance to the picks (an upper bound until
it is refreshed) and to how many picks that was taken. A round is one job. Each block offers its farthest rows, and for that
refreshes bounds only in order of size and only while they could still be among them; the offers of all blocks are ranked, and
the best of them, with the largest bound of any row that isn't among them, reach the driver. It picks greedily as long as the
next pick is certain, that is farther than every row that it doesn't know, and sends all picks of the round out together.
Every ``KEEP`` picks the bounds are written anew, which bounds what is sent; a lost executor's blocks are read again from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, spent, written

#: Bytes of vectors of a block, rows that a block offers, and rows that reach the driver in a round.
BLOCK_BYTES, OFFERS, REACH = 4 << 20, 256, 2048
#: Picks after which bounds are written.
KEEP = 512
#: Rows whose bounds are refreshed together.
CHUNK = 1024
STATE = "ids binary, features binary, least binary, seen binary"
OFFER = "id long, dist double, features array<double>"


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one point. Each row is summed by itself, so that the blocks of a bank don't matter."""
    d = x - y
    return np.multiply(d, d, out=d).sum(1)


class Block:
    """Rows of a block with their bounds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, least: np.ndarray | None = None, seen: np.ndarray | None = None):
        self.ids, self.x = ids, x
        self.least = np.full(len(ids), np.inf) if least is None else least
        self.seen = np.zeros(len(ids), np.int32) if seen is None else seen

    def refresh(self, rows: np.ndarray, picked: np.ndarray, picks: np.ndarray) -> None:
        """Bounds of ``rows`` become their least distances to all picks; picked rows get -1."""
        for n in np.unique(self.seen[rows]):
            some = rows[self.seen[rows] == n]
            own, least = self.x[some], self.least[some]
            for y in picks[n:]:
                np.minimum(least, squares(own, y), out=least)
            self.least[some] = least
        self.seen[rows] = len(picks)
        self.least[rows[np.isin(self.ids[rows], picked)]] = -1.0

    def offers(self, picked: np.ndarray, picks: np.ndarray, most: int) -> tuple[np.ndarray, float]:
        """The farthest rows (all that are as far as the last of ``most``), exactly, and the largest bound of the others."""
        order = np.lexsort((self.ids, -self.least))
        bounds, done, cut = self.least[order], 0, -1.0
        while done < len(order) and (done < most or bounds[done] >= cut):
            stop = min(len(order), done + CHUNK)
            self.refresh(order[done:stop], picked, picks)
            done = stop
            exact = self.least[order[:done]]
            if done >= most:
                cut = max(0.0, np.partition(exact, done - most)[done - most])
        exact = self.least[order[:done]]
        known = order[:done][exact >= max(cut, 0.0)]
        known = known[np.lexsort((self.ids[known], -self.least[known]))][:most]
        rest = np.ones(len(self.ids), bool)
        rest[known] = False
        return known, float(self.least[rest].max()) if rest.any() else -1.0


def _blocks(bank: DataFrame, rows: int) -> DataFrame:
    """The bank as a written table of blocks."""
    kept = bank.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features")).filter("id IS NOT NULL AND features IS NOT NULL")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, width = batch.column(0).to_numpy(), len(batch.column(1)[0]) if batch.num_rows else 0
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)
            for at in range(0, len(ids), rows):
                yield packed(Block(ids[at : at + rows], x[at : at + rows]))

    return written(kept.mapInArrow(build, STATE), "coreset")


def packed(block: Block) -> pa.RecordBatch:
    cols = [block.ids.astype("<i8"), block.x.astype("<f8"), block.least.astype("<f8"), block.seen.astype("<i4")]
    data = [pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cols]
    return pa.RecordBatch.from_arrays(data, ["ids", "features", "least", "seen"])


def unpacked(batch: pa.RecordBatch) -> Iterator[Block]:
    for i in range(batch.num_rows):
        ids, x, least, seen = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in enumerate(("<i8", "<f8", "<f8", "<i4")))
        yield Block(ids, x.reshape(len(ids), -1), least.copy(), seen.copy())


def greedy(bank: DataFrame, k: int, first: int, keep: int = KEEP, offers: int = OFFERS, reach: int = REACH) -> tuple[list[int], int]:
    """The ids of k picks in order, from the row with id ``first``, and the number of rounds. Ids are distinct longs; ties go to
    smaller ids. The driver holds the picks and ``reach`` vectors at most; if a bank has fewer rows, all are picked."""
    spark = bank.sparkSession
    small_batches(spark)
    start = bank.filter(F.col("id") == first).select(F.col("features").cast("array<double>")).first()[0]
    state = _blocks(bank, max(1, BLOCK_BYTES // (8 * max(1, len(start)))))
    picked, rounds = [first], 0
    fresh, points = [first], [np.array(start)]  # picks that the written bounds don't know

    def offer(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, picks = shared.value
            for batch in batches:
                for block in unpacked(batch):
                    known, rest = block.offers(ids, picks, offers)
                    known = known[block.least[known] >= 0]
                    found = [*block.ids[known].tolist(), None], [*block.least[known].tolist(), rest], [*block.x[known].tolist(), None]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.float64(), pa.list_(pa.float64())))], ["id", "dist", "features"])

        return run

    def apply(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, picks = shared.value
            for batch in batches:
                for block in unpacked(batch):
                    block.refresh(np.arange(len(block.ids)), ids, picks)
                    block.seen[:] = 0
                    yield packed(block)

        return run

    while len(picked) < k:
        shared = spark.sparkContext.broadcast((np.array(fresh, np.int64), np.array(points).reshape(len(fresh), len(start))))
        if len(fresh) >= keep:
            new = written(state.mapInArrow(apply(shared), STATE), "coreset")
            spent(state)
            state, fresh, points = new, [], []
            shared.unpersist()
            continue
        rows = state.mapInArrow(offer(shared), OFFER).orderBy(F.desc("dist"), F.col("id").asc_nulls_last()).limit(reach + 1).collect()
        shared.unpersist()
        rounds += 1
        ceiling = max([r.dist for r in rows if r.id is None] + ([rows[-1].dist] if len(rows) > reach else []), default=-1.0)
        rows = [r for r in rows if r.id is not None and r.dist >= max(ceiling, 0.0)]
        more = _certain(rows, ceiling, k - len(picked))
        if not more:
            break
        fresh += [rows[i].id for i in more]
        points += [np.array(rows[i].features) for i in more]
        picked += fresh[len(fresh) - len(more) :]
    spent(state)
    return picked, rounds


def _certain(rows: list, ceiling: float, most: int) -> list[int]:
    """The picks among known rows that no other row comes before, all of which are at ``ceiling`` or nearer. A block knows its
    smaller ids first, so the first pick is certain even at the ceiling."""
    if not rows:
        return []
    ids, x, least = np.array([r.id for r in rows]), np.array([r.features for r in rows]), np.array([r.dist for r in rows])
    out: list[int] = []
    while len(out) < most:
        far = least.max()
        if far < 0 or out and far <= ceiling:
            break
        at = np.flatnonzero(least == far)
        at = int(at[ids[at].argmin()])
        out.append(at)
        np.minimum(least, squares(x, x[at]), out=least)
        least[out] = -1.0
    return out

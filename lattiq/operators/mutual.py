"""The mean of a patch's smallest distances to all patches of other images, for tables that no machine holds.

Patches are asked in blocks; to the task of a block all patches come in a row, once in each of three passes, and of their
distances it keeps counts only. The first pass counts by exponent and first eight bits, which brackets each patch's n-th
distance; the second counts inside the bracket; the third adds up what is below it and lists the distances of the last
bracket, equal ones once. So a block is as large as its counts allow, whatever share of the table a patch asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spent, written

#: Bytes of counts that a task holds, distances that are computed together, and bins of either pass.
HELD_BYTES, CHUNK = 128 << 20, 1024
LOW_EXPONENT, HIGH_EXPONENT, SUBBINS = -20, 20, 2048
SHIFT = 44
BASE = (1023 + LOW_EXPONENT) << 8
BINS = (HIGH_EXPONENT - LOW_EXPONENT) << 8
#: What a pass knows of a patch: how many distances it asks for, its bracket, what is below that, and the bracket's bin.
KNOWN = ("need", "lo", "hi", "below", "bin")
PASS = "id long, grp long, need long, lo double, hi double, below long, bin int"
SCORE = "id long, grp long, score double"


def edge(digit: np.ndarray) -> np.ndarray:
    """The least distance of a bin of the first pass; the first and the last bin are open."""
    out = ((digit.astype(np.int64) + BASE) << SHIFT).view(np.float64)
    return np.where(digit <= 0, -np.inf, np.where(digit >= BINS, np.inf, out))


def subbin(d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The bin of distances inside their bracket; an open bracket is one bin."""
    closed = np.isfinite(lo) & np.isfinite(hi)
    low, width = np.where(closed, lo, 0.0), np.where(closed, hi - lo, np.inf)
    return np.clip(np.floor((d - low) / width * SUBBINS), 0, SUBBINS - 1).astype(np.int64)


def reached(counts: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin (the last, if none does) in which running counts reach ``need``, and what is below it. Few rows at a time, as running
    counts take twice the bytes of counts."""
    at, below = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    for i in range(0, len(counts), 64):
        own = counts[i : i + 64]
        upto = np.cumsum(own, axis=1, dtype=np.int64)
        found = np.minimum((upto < need[i : i + 64, None]).sum(1), own.shape[1] - 1)
        r = np.arange(len(own))
        at[i : i + 64], below[i : i + 64] = found, upto[r, found] - own[r, found]
    return at, below


class First:
    """Counts by leading bits."""

    schema = PASS

    def __init__(self, asked: dict[str, np.ndarray]):
        self.asked, self.counts = asked, np.zeros((len(asked["id"]), BINS), np.int32)

    def take(self, rows: slice, d: np.ndarray, other: np.ndarray) -> None:
        digit = np.clip((d.view(np.int64) >> SHIFT) - BASE, 0, BINS - 1)
        row, _ = np.nonzero(other)
        own = self.counts[rows]
        own += np.bincount(row * BINS + digit[other], minlength=own.size).reshape(own.shape).astype(np.int32)

    def ended(self) -> list[np.ndarray]:
        need = self.asked["need"]
        at, below = reached(self.counts, need)
        return [need, edge(at), np.where(at == BINS - 1, np.inf, edge(at + 1)), below, np.zeros(len(at), np.int32)]


class Second:
    """Counts inside the bracket."""

    schema = PASS

    def __init__(self, asked: dict[str, np.ndarray]):
        self.asked, self.counts = asked, np.zeros((len(asked["id"]), SUBBINS), np.int32)

    def take(self, rows: slice, d: np.ndarray, other: np.ndarray) -> None:
        lo, hi = self.asked["lo"][rows, None], self.asked["hi"][rows, None]
        row, col = np.nonzero(other & (d >= lo) & (d < hi))
        own = self.counts[rows]
        own += np.bincount(row * SUBBINS + subbin(d[row, col], lo[row, 0], hi[row, 0]), minlength=own.size).reshape(own.shape).astype(np.int32)

    def ended(self) -> list[np.ndarray]:
        a = self.asked
        at, below = reached(self.counts, a["need"] - a["below"])
        return [a["need"], a["lo"], a["hi"], a["below"] + below, at.astype(np.int32)]


class Third:
    """Sums below the last bracket, and what is in it."""

    schema = SCORE

    def __init__(self, asked: dict[str, np.ndarray]):
        self.asked, n = asked, len(asked["id"])
        self.total, self.inside = np.zeros(n), [(np.zeros(0), np.zeros(0, np.int64))] * n

    def take(self, rows: slice, d: np.ndarray, other: np.ndarray) -> None:
        lo, hi, bin_ = (self.asked[c][rows, None] for c in ("lo", "hi", "bin"))
        bracket = (d >= lo) & (d < hi)
        sub = subbin(d, lo, hi)
        self.total[rows] += np.where(other & ((d < lo) | bracket & (sub < bin_)), d, 0.0).sum(1)
        row, col = np.nonzero(other & bracket & (sub == bin_))
        for i in np.unique(row):
            own = np.sort(d[i, col[row == i]])
            v, k = self.inside[rows.start + i]
            both = np.r_[v, own]
            value, place = np.unique(both, return_inverse=True)
            self.inside[rows.start + i] = value, np.bincount(place, np.r_[k, np.ones(len(own), np.int64)], len(value)).astype(np.int64)

    def ended(self) -> list[np.ndarray]:
        score = np.full(len(self.total), np.nan)
        for i, (value, count) in enumerate(self.inside):
            left = self.asked["need"][i] - self.asked["below"][i]
            at = int(np.searchsorted(np.cumsum(count), left)) if len(count) else 0
            n = self.asked["below"][i] + count[:at].sum()
            if n:
                score[i] = (self.total[i] + (value[:at] * count[:at]).sum()) / n
        return [score]


def _pass(asked: DataFrame, rows: DataFrame, blocks: int, kind: type, metric: str) -> DataFrame:
    """A pass: ``asked`` has blk, id, grp, features and ``KNOWN``."""
    from .knn import _matrix, distances

    none = [F.lit(None).cast(t).alias(c) for c, t in zip(KNOWN, ("long", "double", "double", "long", "int"))]
    every = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"), F.lit(1).alias("kind"), "id", "grp", "features", *none)
    sent = asked.select("blk", F.lit(0).alias("kind"), "id", "grp", "features", *KNOWN).unionByName(every)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks, 4096))
    # in a fixed order, and in chunks of fixed size, so that each pass computes the same distances
    sent = sent.repartition(parts, "blk").sortWithinPartitions("blk", "kind", "grp", "id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, mine, held, n_held = None, None, [], [], 0

        def started():
            t = pa.Table.from_batches(mine).combine_chunks()
            known = {c: t.column(c).to_numpy() for c in ("id", "grp", *KNOWN)}
            return kind(known), known["grp"], _matrix(t.column("features").combine_chunks())

        def met(whole: bool):
            """Chunks of the patches at hand; the last one may be smaller."""
            nonlocal held, n_held
            t = pa.Table.from_batches(held).combine_chunks() if held else None
            at = 0
            while t is not None and (t.num_rows - at >= CHUNK or whole and at < t.num_rows):
                part = t.slice(at, CHUNK)
                there, bank = part.column("grp").to_numpy(), _matrix(part.column("features").combine_chunks())
                folder, own, vec = state
                for i in range(0, len(own), 256):
                    folder.take(slice(i, min(i + 256, len(own))), distances(vec[i : i + 256], bank, metric), own[i : i + 256, None] != there[None, :])
                at += part.num_rows
            held = t.slice(at).to_batches() if t is not None else []
            n_held = t.num_rows - at if t is not None else 0

        def ended():
            folder, own, _ = state
            cols = [pa.array(folder.asked["id"]), pa.array(own), *[pa.array(c, from_pandas=True) for c in folder.ended()]]
            names = [f.split()[0] for f in kind.schema.split(", ")]
            return pa.RecordBatch.from_arrays(cols, names)

        for x in batches:
            blk, side = x.column(0).to_numpy(), x.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((blk[1:] != blk[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), x.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if blk[a] != now:
                    if state is not None:
                        met(True)
                        yield ended()
                    now, state, mine, held, n_held = blk[a], None, [], [], 0
                if side[a] == 0:
                    mine.append(x.slice(a, b - a))
                elif mine:
                    state = state or started()
                    held.append(x.slice(a, b - a).select(["grp", "features"]))
                    n_held += b - a
                    if n_held >= 8 * CHUNK:
                        met(False)
        if state is not None:
            met(True)
            yield ended()

    return sent.mapInArrow(fold, kind.schema)


def in_passes(rows: DataFrame, q: float, metric: str, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``id, grp, score`` of (id, grp, features), ids being distinct within an image: the mean of each patch's distances to patches of
    other images that are strictly below the int(q n)-th smallest; null where there are none. Passes are written to the
    shared folder, where a lost task starts again."""
    counts = rows.groupBy("grp").agg(F.count("*").alias("own"))
    total = counts.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // max(1, held_bytes // (4 * BINS))))
    need = F.floor(F.lit(float(q)) * (F.lit(total) - F.col("own"))).cast("long")
    blk = F.pmod(F.xxhash64("id", "grp"), F.lit(blocks)).cast("int").alias("blk")
    left = rows.select("id", "grp", "features", blk)
    asked = left.join(counts, "grp").withColumn("need", need).filter("need >= 1").drop("own")
    asked = asked.select("*", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(0).cast("long").alias("below"), F.lit(0).alias("bin"))
    for kind in (First, Second):
        known = written(_pass(asked, rows, blocks, kind, metric), "bracket")
        if kind is Second:
            spent(before)
        before = known
        asked = left.join(known, ["id", "grp"])
    scores = written(_pass(asked, rows, blocks, Third, metric), "mutual")
    spent(before)
    return rows.select("id", "grp").join(scores, ["id", "grp"], "left")

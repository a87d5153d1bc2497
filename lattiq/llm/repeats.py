"""Spans of a fixed length that occur more than once, found through anchors.

Texts are sequences of units (bytes or words). Every run of ``length`` units holds an anchor, a short gram chosen by the
run's content alone, so equal runs share an anchor at the same place. The context of an anchor is all the units that a run
holding it can cover. Equal contexts are counted as one before anything is dealt; anchors with several contexts have those
brought together, in ranges of the anchors' leading units with sampled splitters, and compared by the caller's method.

Rows are keyed by ``d`` (the id) and ``h`` (a hash of the text where ids repeat or are null, else 0).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, spent, written
from .ragged import Rolling, U, anchors, byte_tokens, chunks, mix, pieces, release, text_bytes, word_hashes, word_spans

#: Contexts of one anchor that are compared in one task. Those of more common anchors have their runs counted by all tasks.
MAX_GROUP = 50_000
#: at = position << 20 | units before it in the context << 10 | units from it on
AT = 20
#: Ranges of places in which contexts of very common anchors must share all that their runs have in common.
RANGES = 8


@dataclass(frozen=True)
class Plan:
    words: bool  #: units are words, else bytes
    length: int  #: at most 1023
    gram: int
    first_wins: bool  #: a run counts as repeated only where a smaller ``d`` has it, else wherever it occurs again

    @property
    def reach(self) -> int:
        return self.length - self.gram

    @property
    def step(self) -> int:
        """Bytes of a token."""
        return 8 if not self.words and self.gram >= 8 else 1

    def codes(self, roll: Rolling, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return roll.spans(start, stop - (self.step - 1))


def row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, bool]:
    """(d, h) and whether ids are unique and not null, so that ``h`` can be 0. Repeated rows have equal keys."""
    ids = docs.select(F.col(id_col).alias("i"))
    n, some = ids.agg(F.count("*"), F.count("i")).first()
    plain = n == some and not ids.groupBy("i").count().filter("count > 1").limit(1).count()
    key = F.col(id_col).cast("long")
    own = F.lit(0).cast("long") if plain else F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), key.isNull())
    return F.coalesce(key, F.lit(0)), own, plain


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """(d, h, doc_id, text), and with ``carry`` a struct ``rest`` of all other columns. Equal rows get equal results."""
    small_batches(docs.sparkSession)
    d, h, _ = row_key(docs, id_col, text_col)
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (text_col,)]).alias("rest")] if carry else []
    return docs.select(d.alias("d"), h.alias("h"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *rest)


def _occurrences(plan: Plan):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(2), plan.words, 2 * plan.length, plan.step):
                off, roll = piece.first, piece.roll()
                p = anchors(roll.grams(plan.gram - plan.step + 1), off, plan.length, plan.gram)
                p = p[(p >= piece.lo) & (p < piece.hi)]
                if not len(p):
                    continue
                who = np.searchsorted(off, p, "right") - 1
                lo, hi = np.maximum(off[who], p - plan.reach), np.minimum(off[who + 1], p + plan.length)
                # leading units first, so that ranges of anchors are ranges of leading units
                code = (piece.head[p].astype(U) >> U(32) << U(32) | plan.codes(roll, p, p + plan.gram) >> U(32)) ^ U(1 << 63)
                context = plan.codes(piece.roll(1), lo, hi) ^ mix((p - lo).astype(U))
                at = ((p - off[who] + piece.base) << AT) | ((p - lo) << 10) | (hi - p)
                d, h = (batch.column(i).take(pa.array(who + piece.row)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([d, h, pa.array(at, pa.int64()), pa.array(code.view(np.int64)), pa.array(context.view(np.int64))], ["d", "h", "at", "anchor", "ctx"])
        release()

    return rows


def _fetch(plan: Plan, splitters: np.ndarray, at_once: int = 4096):
    """Contexts of the asked anchors of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for a, b in chunks(col["text"]):
                data, off = text_bytes(col["text"].slice(a, b - a))
                start, stop = None, None
                if plan.words:
                    start, stop, off = word_spans(data, off)
                asked = col["asked"].slice(a, b - a)
                flat = asked.flatten()
                owner = np.repeat(np.arange(b - a), np.diff(asked.offsets.to_numpy()))
                for i in range(0, len(owner), at_once):
                    who, (at, anchor, ctx) = owner[i : i + at_once], (flat.field(j).to_numpy()[i : i + at_once] for j in range(3))
                    p = off[who] + (at >> AT)
                    first, last = p - ((at >> 10) & 1023), p + (at & 1023)
                    if plan.words:
                        first, last = start[first], stop[last - 1]
                    texts = pa.array([data[x:y].tobytes() for x, y in zip(first.tolist(), last.tolist())], pa.binary())
                    d, h = (col[n].take(pa.array(who + a)) for n in ("d", "h"))
                    part = np.searchsorted(splitters, anchor).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(anchor), pa.array(ctx), d, h, pa.array(at), texts], ["part", "anchor", "ctx", "d", "h", "at", "context"])
        release()

    return rows


FETCHED = "part int, anchor long, ctx long, d long, h long, at long, context binary"
#: Of a context, the first and last repeated run, as units before the anchor; runs between them cover no other units.
ENDS = "anchor long, ctx long, d long, h long, at long, far long, near long"
ENDS_NAMES = ["anchor", "ctx", "d", "h", "at", "far", "near"]


@dataclass
class Contexts:
    """Different contexts of whole groups: ``group`` (ascending), ``d`` (least id with this context), units before the anchor
    and from it on, bytes and each context's first."""

    group: np.ndarray
    d: np.ndarray
    back: np.ndarray
    fore: np.ndarray
    data: np.ndarray
    first: np.ndarray

    def texts(self) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.first.tolist(), [*self.first[1:].tolist(), len(self.data)])]


def _text(contexts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(contexts.cast(pa.large_binary()).view(pa.large_string()))


def _compare(plan: Plan, method: Callable[[Plan, Contexts], tuple[np.ndarray, np.ndarray, np.ndarray]], rows_at_once: int = 8000):
    """Whole groups of contexts, some thousand rows at a time; ``method`` gives arrays (row, far, near)."""

    def judge(table: pa.Table) -> pa.RecordBatch:
        col = {n: table.column(n).combine_chunks() for n in table.column_names}
        data, off = _text(col["context"])
        anchor, at = col["anchor"].to_numpy(), col["at"].to_numpy()
        group = np.cumsum(np.r_[False, anchor[1:] != anchor[:-1]])
        row, far, near = method(plan, Contexts(group, col["d"].to_numpy(), (at >> 10) & 1023, at & 1023, data, off[:-1]))
        take = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([*(col[n].take(take) for n in ENDS_NAMES[:5]), pa.array(far, pa.int64()), pa.array(near, pa.int64())], ENDS_NAMES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            cuts = np.r_[0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor)]
            begin = 0
            for cut in cuts[:-1].tolist():  # where a group starts
                if n + cut - begin >= rows_at_once and (cut or anchor[0] != last):
                    if cut > begin:
                        held.append(batch.slice(begin, cut - begin))
                    yield judge(pa.Table.from_batches(held))
                    held, n, begin = [], 0, cut
            held.append(batch.slice(begin))
            n += batch.num_rows - begin
            last = anchor[-1]
        if n:
            yield judge(pa.Table.from_batches(held))
        release()

    return rows


def repeated_spans(spark: SparkSession, docs: DataFrame, plan: Plan, method, max_group: int = MAX_GROUP) -> DataFrame:
    """(d, h, spans): for each text with repeated runs, start << 32 | stop in units of each maximal one."""
    occ = written(docs.select("d", "h", "text").mapInArrow(_occurrences(plan), "d long, h long, at long, anchor long, ctx long"), "anchors")
    again = F.col("d0") < F.col("d1") if plan.first_wins else F.col("n") > 1
    by_anchor = occ.groupBy("anchor").agg(F.count("*").alias("n"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1"), F.min("d").alias("d0"), F.max("d").alias("d1")).filter(again)
    # a table of its own, so that the join can split an anchor that very many texts hold
    by_anchor = written(by_anchor.select("anchor", (F.col("c0") != F.col("c1")).alias("multi"), "d0"), "repeated")
    hits = written(occ.join(by_anchor, "anchor"), "hits")
    spent(occ, by_anchor)
    start = F.shiftright("at", AT) - F.shiftright("at", 10).bitwiseAND(F.lit(1023))
    whole = (F.shiftleft(start, 32) + F.shiftright("at", AT) + F.col("at").bitwiseAND(F.lit(1023))).alias("span")
    # an anchor with a single context: copies of one passage
    single = hits.filter(~F.col("multi"))
    spans = single.filter(F.col("d") > F.col("d0")) if plan.first_wins else single
    spans = spans.select("d", "h", whole)
    multi = hits.filter("multi").select("d", "h", "at", "anchor", "ctx")
    by_ctx = multi.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("d", "h", "at")).alias("r"))
    by_ctx = written(by_ctx.select("anchor", "ctx", "n", "r.d", "r.h", "r.at"), "contexts")
    # copies of a whole context are repeated in full; of the first-come rule, all but the first text's
    lone = by_ctx.select("anchor", "ctx", F.col("n").alias("m"), F.col("d").alias("d0"))
    more = multi.join(lone.filter("m > 1"), ["anchor", "ctx"])
    spans = spans.unionByName((more.filter(F.col("d") > F.col("d0")) if plan.first_wins else more).select("d", "h", whole))
    sizes = by_ctx.groupBy("anchor").agg(F.count("*").alias("k"))
    top = sizes.agg(F.max("k")).first()[0] or 0
    asked, hot = by_ctx, None
    if top > max_group:
        large = sizes.filter(F.col("k") > max_group).select("anchor")
        asked, hot = by_ctx.join(large, "anchor", "left_anti"), by_ctx.join(large, "anchor", "left_semi")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters = np.array(asked.agg(F.percentile_approx("anchor", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or [], np.int64)

    def fetched(requests: DataFrame) -> DataFrame:
        by_doc = requests.groupBy("d", "h").agg(F.collect_list(F.struct("at", "anchor", "ctx")).alias("asked"))
        # all columns, so that the shuffle of the texts is used again when the spans are cut out of them
        return docs.join(by_doc.hint("shuffle_hash"), ["d", "h"]).select(*docs.columns, "asked").mapInArrow(_fetch(plan, splitters), FETCHED)

    ends = fetched(asked).repartitionById(parts, "part").sortWithinPartitions("anchor").drop("part").mapInArrow(_compare(plan, method), ENDS)
    if hot is not None:
        ends = ends.unionByName(_counted(fetched(hot), plan))
    if plan.first_wins:  # the first text may hold a context several times
        ends = ends.select("anchor", "ctx", "d", "far", "near").join(multi, ["anchor", "ctx", "d"])
    p = F.shiftright("at", AT)
    spans = spans.unionByName(ends.select("d", "h", (F.shiftleft(p - F.col("far"), 32) + p - F.col("near") + plan.length).alias("span")))
    return merged(spans).groupBy("d", "h").agg(F.collect_list("span").alias("spans"))


def merged(spans: DataFrame) -> DataFrame:
    """(d, h, span): the maximal runs that a text's spans cover, so that a text is left with fewer than it has units by the length
    of a run, however often it repeats itself. A text's spans are sorted, not held."""
    text = Window.partitionBy("d", "h").orderBy("span")
    start, stop = F.shiftright("span", 32), F.col("span").bitwiseAND(F.lit(0xFFFFFFFF))
    so_far = F.max(stop).over(text.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.distinct().withColumn("new", F.when(so_far.isNull() | (start > so_far), F.col("span")))
    rows = rows.withColumn("run", F.last(F.shiftright("new", 32), ignorenulls=True).over(text.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("d", "h", "run").agg(F.max(stop).alias("stop"))
    return runs.select("d", "h", (F.shiftleft("run", 32) + F.col("stop")).alias("span"))


def _counted(contexts: DataFrame, plan: Plan) -> DataFrame:
    """For anchors with very many contexts: equal runs counted by aggregation, so that no task holds a group. All runs that
    start within a range of places have a core in common; only where a core occurs in several contexts are its runs
    listed and counted, by two 64-bit codes."""
    width = -(-(plan.reach + 1) // RANGES)

    def parts(batches: Iterator[pa.RecordBatch], at_once: int = 500):
        """Contexts, hashes over them, first units, units before and from the anchor on."""
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                part = batch.slice(i, at_once)
                data, first = _text(part.column("context"))
                if plan.words:
                    start, stop, first = word_spans(data, first)
                    tokens = word_hashes(data, start, stop)
                else:
                    tokens = byte_tokens(data, plan.step)
                at = part.column("at").to_numpy()
                yield part, [Rolling(tokens, w) for w in (0, 1)], first[:-1] + ((at >> 10) & 1023), (at >> 10) & 1023, at & 1023

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rolls, mid, back, fore in parts(batches):
            lo = np.arange(0, plan.reach + 1, width)
            hi = np.minimum(lo + width - 1, plan.reach)
            row, r = np.nonzero(np.maximum(lo[None, :], plan.length - fore[:, None]) <= np.minimum(hi[None, :], back[:, None]))
            a, b = mid[row] - lo[r], mid[row] - hi[r] + plan.length
            x, y = (plan.codes(roll, a, b).view(np.int64) for roll in rolls)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(part.column(n).take(take) for n in ("anchor", "ctx")), pa.array(lo[r]), pa.array(x), pa.array(y)], ["anchor", "ctx", "o", "x", "y"])
        release()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rolls, mid, back, fore in parts(batches):
            live = np.zeros((part.num_rows, plan.reach + width + 1), bool)
            lists = part.column("live")
            owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            for i in range(width):
                live[owner, lists.flatten().to_numpy() + i] = True
            o = np.arange(plan.reach + 1)
            row, place = np.nonzero(live[:, : plan.reach + 1] & (o[None, :] <= back[:, None]) & (plan.length - o[None, :] <= fore[:, None]))
            s = mid[row] - place
            codes = [plan.codes(roll, s, s + plan.length).view(np.int64) for roll in rolls]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(part.column(n).take(take) for n in ENDS_NAMES[:5]), pa.array(place, pa.int64()), *map(pa.array, codes)], [*ENDS_NAMES[:5], "o", "x", "y"])
        release()

    contexts = written(contexts.drop("part"), "common")
    key = ["anchor", "o", "x", "y"]
    held = written(contexts.select("anchor", "ctx", "at", "context").mapInArrow(cores, "anchor long, ctx long, o long, x long, y long"), "cores")
    again = held.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    live = held.join(again, key).groupBy("anchor", "ctx").agg(F.collect_set("o").alias("live"))
    rows = contexts.join(live, ["anchor", "ctx"]).select(*ENDS_NAMES[:5], "context", "live")
    rows = written(rows.mapInArrow(runs, "anchor long, ctx long, d long, h long, at long, o long, x long, y long"), "runs")
    spent(contexts, held)
    same = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("d").alias("d0")).filter("n > 1")
    hit = rows.join(same, key)
    if plan.first_wins:
        hit = hit.filter(F.col("d") > F.col("d0"))
    return hit.groupBy(ENDS_NAMES[:5]).agg(F.max("o").alias("far"), F.min("o").alias("near"))


def covered(spans: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of units that the spans cover."""
    out: list[tuple[int, int]] = []
    for x in sorted(spans):
        a, b = x >> 32, x & 0xFFFFFFFF
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out

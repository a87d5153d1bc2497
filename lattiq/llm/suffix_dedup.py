"""Suffix-array dedup: bytes of strings of a given length that occur again anywhere.

Sampled suffixes, those at anchors (see ``repeats``), are dealt to ranges of their leading bytes between sampled splitters.
Each bucket sorts its suffixes by multikey partitioning of their real bytes, some bytes at a time, leaving out what is
already alone, and notes how long a prefix neighbours share; what stands before the anchors is sorted alike, backwards.
A string that starts ``o`` bytes before an anchor occurs again where ``o`` bytes before it and the rest after it are both
shared. Equal leading units never straddle a boundary between buckets, so neighbours across one share no anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import U, eights, release
from .repeats import Contexts, Plan, covered, keyed, repeated_spans

OUT = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,kept:string>"


def multikey(group: np.ndarray, depth: int, word) -> tuple[np.ndarray, np.ndarray]:
    """Sorts rows of each group (ascending numbers) by ``depth`` bytes: (rows in order, bytes that each shares with the row
    before it, -1 at a group's first). ``word(rows, at)`` gives five bytes of each row from ``at`` on as a number."""
    n = len(group)
    order, share = np.arange(n), np.full(n, depth)
    new = np.r_[True, group[1:] != group[:-1]]
    share[new] = -1
    live = np.arange(n)  # places of rows that are not alone
    for at in range(0, depth, 5):
        number = np.cumsum(new[live])
        alone = np.r_[new[live], True]
        keep = ~(alone[:-1] & alone[1:])
        live, number = live[keep], number[keep]
        if not len(live):
            break
        rows = order[live]
        key = (number.astype(U) << U(40)) | word(rows, at)
        by = np.argsort(key)
        key, order[live] = key[by], rows[by]
        apart = np.r_[U(0), key[1:] ^ key[:-1]]
        split = np.flatnonzero((apart > 0) & (apart < U(1 << 40)) & ~new[live])
        new[live[split]] = True
        share[live[split]] = at + sum((apart[split] < U(1 << (8 * i))).astype(np.int64) for i in range(1, 5))
    return order, share


def sorted_runs(plan: Plan, c: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each context that shares a run with another of its group: the run that starts furthest before the anchor, and the
    nearest."""
    n, mid = len(c.group), c.first + c.back
    ahead, behind = eights(c.data), eights(c.data[::-1])
    end = len(c.data)

    def word(text: np.ndarray, start: np.ndarray, size: np.ndarray, most: int):
        def five(rows: np.ndarray, at: int) -> np.ndarray:
            left = np.clip(np.minimum(size[rows], most) - at, 0, 5).astype(U)
            value = text[np.minimum(start[rows] + at, end - 1)].astype(U) >> U(24)
            return value & ((U(1) << U(40)) - (U(1) << (U(8) * (U(5) - left))))

        return five

    sides = []
    for text, start, size, most in ((ahead, mid, c.fore, plan.length), (behind, end - mid, c.back, plan.reach)):
        order, share = multikey(c.group, most, word(text, start, size, most))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        longest = np.maximum(share, np.r_[share[1:], -1])[place]  # with any other row
        sides.append((share, place, np.minimum(longest, size)))
    (fshare, fplace, fmost), (bshare, bplace, bmost) = sides
    least, most = np.maximum(plan.length - fmost, 0), np.minimum(bmost, plan.reach)
    far, near = np.full(n, -1), np.full(n, plan.length)
    for o in range(plan.reach + 1):
        rows = np.flatnonzero((least <= o) & (o <= most))
        if not len(rows):
            continue
        # rows that share length - o bytes from the anchor on have one number, and so have those that share o before it
        key = np.cumsum(fshare < plan.length - o)[fplace[rows]] * (n + 1) + np.cumsum(bshare < o)[bplace[rows]]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        hit = rows[by[np.r_[same, False] | np.r_[False, same]]]
        far[hit] = o
        near[hit] = np.minimum(near[hit], o)
    hit = np.flatnonzero(far >= 0)
    return hit, far[hit], near[hit]


def _cut(with_text: bool):
    @F.arrow_udf(OUT)
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            runs, kept, at = covered(own or []), [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None))
        cols = list(zip(*out)) if out else [()] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        release()
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return cut


def _judged(docs: DataFrame, length: int, id_col: str, text_col: str, with_text: bool, carry: bool) -> DataFrame:
    plan = Plan(words=False, length=length, gram=min(24, length), first_wins=False)
    rows = keyed(docs, id_col, text_col, carry)
    spans = repeated_spans(docs.sparkSession, rows, plan, sorted_runs)
    return rows.join(spans.hint("shuffle_hash"), ["d", "h"], "left").withColumn("c", _cut(with_text)("text", "spans"))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    Every byte covered by a ``length``-byte string (UTF-8) that also starts anywhere else goes, in the same text too; all
    copies go, and strings are judged on the input. Null counts as empty; texts shorter than ``length`` stay whole. Repeated
    rows and ids are separate texts. ``kept`` leaves out characters that a cut has split; other columns are dropped.
    """
    return _judged(docs, length, id_col, text_col, with_text, False).select("doc_id", "c.*")


def strip_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what ``remove_repeats`` keeps as the text (null texts become empty); other columns are as they were."""
    found = _judged(docs, length, id_col, text_col, True, True)
    return found.select(*[F.col("c.kept").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])

"""Substring dedup by suffix automata: words of windows that a document with a smaller id has too.

The reference of a self-dedup is the corpus itself. Passages that can repeat are those around anchors that several documents
hold (see ``repeats``); the passages of an anchor, one copy of each, are dealt together in order of id. A shard of them
makes a suffix automaton over words, and every later passage is streamed through it for its matching statistics, the
longest match that ends at each word; runs at or above the threshold are removed. Further shards follow until each passage
has met all with smaller ids. A passage that matches from end to end adds nothing to an automaton. Shards so meet the
passages that share an anchor with them rather than all documents, which would cost the square of the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import release
from .repeats import Contexts, Plan, covered, keyed, repeated_spans

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


class SuffixAutomaton:
    """Over a growing list of token sequences; matches never run across two of them."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, tokens: list) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for t in tokens:
            if (q := nxt[last].get(t)) is not None and length[q] == length[last] + 1:
                last = q
                continue
            split = q is not None
            if not split:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and t not in nxt[p]:
                    nxt[p][t] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
                q = nxt[p][t]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                    last = cur
                    continue
            else:
                p, cur = last, -1
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            while p >= 0 and nxt[p].get(t) == q:
                nxt[p][t] = clone
                p = link[p]
            link[q] = clone
            if cur >= 0:
                link[cur] = clone
                last = cur
            else:
                last = clone

    def matching(self, tokens: list) -> list[int]:
        """For each token, the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        out = []
        for t in tokens:
            while (to := nxt[state].get(t)) is None and state:
                state = link[state]
                n = length[state]
            if to is not None:
                state = to
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def _stream(passages: list[tuple[int, tuple]], length: int, shard: int) -> list[list[int]]:
    """For each passage (least id, words), in order of id: the places where matches of ``length`` or more words with those
    of smaller ids end."""
    ends: list[set[int] | list[int]] = [set() for _ in passages]
    left = range(len(passages))
    while left:
        machine, rest = SuffixAutomaton(), []
        pending: list[tuple] = []  # of the id at hand: they don't match each other
        current = None
        for i in left:
            least, words = passages[i]
            if least != current:
                for w in pending:
                    machine.add(w)
                pending, current = [], least
            ends[i].update(j for j, n in enumerate(machine.matching(words)) if n >= length)
            if len(ends[i]) < len(words) - length + 1:
                if len(machine.next) < shard:
                    pending.append(words)
                else:
                    rest.append(i)
        left = rest
    return [sorted(e) for e in ends]


def streamed(plan: Plan, c: Contexts, shard: int = 300_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each passage that a smaller id has in part: the first and the last window to go, as words before the anchor.
    ``shard`` bounds the states of an automaton."""
    texts, rows = c.texts(), []
    cuts = np.r_[0, np.flatnonzero(np.diff(c.group)) + 1, len(c.group)].tolist()
    for a, b in zip(cuts, cuts[1:]):
        ids: dict[bytes, int] = {}
        owners: dict[tuple, list[int]] = {}
        for i in (a + np.argsort(c.d[a:b], kind="stable")).tolist():
            owners.setdefault(tuple(ids.setdefault(w, len(ids)) for w in texts[i].split()), []).append(i)
        passages = [(int(c.d[own[0]]), words) for words, own in owners.items()]
        for (least, words), own, ends in zip(passages, owners.values(), _stream(passages, plan.length, shard)):
            for i in own:
                got = ends if c.d[i] == least else range(plan.length - 1, len(words))
                if len(got):  # all windows hold the anchor, so what they cover is one run
                    rows.append((i, c.back[i] - (got[0] - plan.length + 1), c.back[i] - (got[-1] - plan.length + 1)))
    return tuple(np.array(rows, np.int64).reshape(-1, 3).T)


def _cut(with_text: bool):
    def rows(batches):
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = text.encode("utf-8", "surrogatepass").split()
                runs, kept, at = covered(spans or []), [], 0
                for a, b in runs:
                    kept += words[at:a]
                    at = b
                rest = b" ".join(kept + words[at:])
                out.append((doc_id, len(words), sum(b - a for a, b in runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "surrogatepass") if with_text else None))
            cols = list(zip(*out)) if out else [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
        release()

    return rows


def remove_substrings(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256, kept`` (kept words joined by one space).

    Every word covered by a window of ``min_words`` consecutive words that also starts in a document with a smaller id goes;
    windows are judged on the input. Words are parted by the six ASCII white-space characters. Null counts as empty; shorter
    texts stay whole. Rows with equal ids don't count against each other, and rows with a null id neither lose words nor
    make others lose any. Other columns are dropped.
    """
    plan = Plan(words=True, length=min_words, gram=min(16, min_words), first_wins=True)
    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(docs.sparkSession, rows.filter(F.col("doc_id").isNotNull()), plan, streamed)
    joined = rows.withColumn("k", F.when(F.col("doc_id").isNotNull(), F.col("d")))
    joined = joined.join(spans.withColumnRenamed("d", "k").hint("shuffle_hash"), ["k", "h"], "left")
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(_cut(with_text), OUT)

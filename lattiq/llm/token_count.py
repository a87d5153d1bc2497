"""Token counts by rank-synchronous array merging.

White space starts a new pre-token, since no piece has a blank after another character; equal pre-tokens are encoded once.
A batch of pre-tokens is one ragged numpy array of symbols. Each round looks up the adjacent pairs, takes the pair of
lowest rank of every sequence and merges it in all sequences at once, until no sequence has a pair left; the surviving
symbols are counted. Within a sequence the lowest pair is merged wherever it occurs, from the left, up to the first merge
that makes a pair of still lower rank, which is due before the others.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .ragged import release

#: The character that stands for a blank in pieces.
BLANK = "▁"
NONE = np.iinfo(np.int64).max
#: Pre-tokens whose counts a worker remembers.
KNOWN = 1 << 18


class PairTable:
    """Open addressing over pairs of symbols, looked up by whole arrays."""

    BITS = 21

    def __init__(self, pairs: np.ndarray):
        size = 1 << self.BITS
        self.key, self.rank, self.into = np.full(size, -1, np.int64), np.full(size, NONE), np.zeros(size, np.int64)
        key, rows = (pairs[:, 0] << 32) | pairs[:, 1], np.arange(len(pairs))
        at = self._slot(key)
        while len(rows):
            free = self.key[at] == -1
            slots, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[slots >= 0]
            put, row = at[first], rows[first]
            self.key[put], self.rank[put], self.into[put] = key[row], pairs[row, 2], pairs[row, 3]
            left = np.ones(len(rows), bool)
            left[first] = False
            rows, at = rows[left], (at[left] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank NONE if it isn't one."""
        rank, into, at, rest = np.full(len(key), NONE), np.zeros(len(key), np.int64), self._slot(key), np.arange(len(key))
        while len(rest):
            there = self.key[at]
            hit = there == key[rest]
            rank[rest[hit]], into[rest[hit]] = self.rank[at[hit]], self.into[at[hit]]
            on = ~hit & (there != -1)
            rest, at = rest[on], (at[on] + 1) & (len(self.key) - 1)
        return rank, into


class PieceBpe:
    """The vocabulary of a sentencepiece BPE model with byte fallback and no text normalisation."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        levels = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("pieces with a blank after another character aren't supported")
        self.ids = {p: i for i, p in enumerate(dict.fromkeys([*pieces, *(c for p in pieces for c in p)]))}
        names = list(self.ids)
        self.cost = np.array([1 if p in pieces else len(p.encode()) for p in names], np.int64)
        pairs = [(self.ids[p[:i]], self.ids[p[i:]], levels[pieces[p]], self.ids[p]) for p in pieces for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids]
        self.pairs = PairTable(np.array(pairs, np.int64).reshape(-1, 4))
        self.chars = np.full(0x110000, -1, np.int64)
        for c, i in self.ids.items():
            if len(c) == 1:
                self.chars[ord(c)] = i
        self.known: dict[str, int] = {}

    def count_batch(self, seqs: list[str]) -> list[int]:
        """Tokens of each sequence of at least one character."""
        code = np.frombuffer("".join(seqs).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, seqs), np.int64, len(seqs))
        sym, owner = self.chars[code], np.repeat(np.arange(len(seqs)), sizes)
        strange = sym < 0
        total = np.bincount(owner[strange], 1 + (code[strange] > 0x7F) + (code[strange] > 0x7FF) + (code[strange] > 0xFFFF), len(seqs)).astype(np.int64)
        rank, into = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)

        def look(at: np.ndarray) -> None:
            """Pairs of the symbols at ``at`` with the next ones."""
            rank[at] = NONE
            at = at[at < len(sym) - 1]
            at = at[(owner[at] == owner[at + 1]) & (sym[at] >= 0) & (sym[at + 1] >= 0)]
            rank[at], into[at] = self.pairs.find((sym[at] << 32) | sym[at + 1])

        look(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(sym)])
            lowest = np.minimum.reduceat(rank, starts)
            ended = np.repeat(lowest == NONE, lengths)
            if ended.any():
                done = ended & (sym >= 0)
                total += np.bincount(owner[done], self.cost[sym[done]], len(seqs)).astype(np.int64)
            hit = np.flatnonzero((rank == np.repeat(lowest, lengths)) & ~ended)
            # every second of the hits in a row, from the left
            begins = np.r_[True, hit[1:] != hit[:-1] + 1][: len(hit)]
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
            first = hit[nth % 2 == 0]
            again = np.r_[False, owner[first[1:]] == owner[first[:-1]]][: len(first)]
            many = again | np.r_[again[1:], False][: len(first)]  # of sequences with several
            if many.any():
                keep = ~many
                keep[many] = self._before_lower(sym, owner, rank, into, first[many], again[many])
                first = first[keep]
            sym[first] = into[first]
            keep = ~ended
            keep[first + 1] = False
            place = (np.cumsum(keep) - 1)[first]
            sym, owner, rank, into = sym[keep], owner[keep], rank[keep], into[keep]
            look(place)
            look(place[place > 0] - 1)
        return total.tolist()

    def _before_lower(self, sym, owner, rank, into, first, again) -> np.ndarray:
        """Which of a round's merges at ``first`` come no later than the first in their sequence that makes a pair of lower rank;
        ``again`` marks those that are not the first of their sequence."""
        z, lower = into[first], np.zeros(len(first), bool)
        left = sym[first - 1]
        joined = np.r_[False, first[1:] == first[:-1] + 2][: len(first)]  # the left neighbour has just been merged
        left[joined] = z[np.flatnonzero(joined) - 1]
        on = (first > 0) & (owner[first - 1] == owner[first]) & (left >= 0)
        lower[on] = self.pairs.find((left[on] << 32) | z[on])[0] < rank[first[on]]
        after = np.minimum(first + 2, len(sym) - 1)
        on = (first + 2 < len(sym)) & (owner[after] == owner[first]) & (sym[after] >= 0)
        lower[on] |= self.pairs.find((z[on] << 32) | sym[after[on]])[0] < rank[first[on]]
        so_far = np.cumsum(lower) - lower
        return so_far == so_far[~again][np.cumsum(~again) - 1]

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; None counts as empty."""
        rows, new = [], set()
        if len(self.known) > KNOWN:
            self.known.clear()
        known = self.known
        for text in texts:
            words = pretokens(text) if text else []
            rows.append(words)
            new.update(words)
            if len(new) > KNOWN:
                new = {w for w in new if w not in known}
        fresh = [w for w in new if w not in known]
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            known.update(zip(part, self.count_batch([BLANK + w.replace(" ", BLANK) for w in part])))
        return [sum(map(known.__getitem__, words)) for words in rows]


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first blank: blanks, then the characters up to the next blank."""
    words = text.replace(BLANK, " ").split(" ")
    if "" not in words:
        return words
    out, blanks = [], 0
    for w in words:
        if w:
            out.append(" " * blanks + w)
            blanks = 0
        else:
            blanks += 1
    if blanks:
        out.append(" " * (blanks - 1))
    return out


@lru_cache(maxsize=4)
def model(path: str) -> PieceBpe:
    return PieceBpe(path)


def token_count(text: Column, path: str, texts_at_once: int = 256) -> Column:
    """Tokens of the whole text (null and empty: 0), without begin, end or special tokens. Very long texts and pre-tokens are
    merged whole, by the same rounds; repeated rows are counted alike; an empty table gives no rows, and other columns
    play no part. ``path`` must be readable on every executor, as a vocabulary installed with the tokenizer's package is."""

    small_batches(SparkSession.active())

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        m, out = model(path), []
        for i in range(0, len(texts), texts_at_once):
            out += m.count(texts.slice(i, texts_at_once).to_pylist())
        release()
        return pa.array(out, pa.int64())

    return count(text)

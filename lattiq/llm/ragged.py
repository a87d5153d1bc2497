"""Whole-batch numpy work on texts: words as arrays, rolling hashes, and anchors that equal passages choose alike."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are worked on at once; longer texts are cut into overlapping parts.
PIECE = 1 << 18
#: Low bits of an anchor's hash that give way to its place, alike in every piece: a tie of the others goes to the first.
PLACE_BITS = 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def release() -> None:
    """Gives freed memory back to the system; a Python worker is used again by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts together, and where each starts (one more for the end). Null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count or not pa.types.is_large_string(texts.type) else texts
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.array([], np.uint8)
    return data[off[0] : off[-1]] if len(off) else data[:0], off - (off[0] if len(off) else 0)


def chunks(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of runs of at most ``most`` bytes, or a single longer text."""
    off = text_bytes(texts)[1]
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(off, off[start] + most, "right")) - 1)
        yield start, stop
        start = stop


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number in the order of the bytes; zeros beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data), ">u8", padded, 0, (1,))


class Rolling:
    """Polynomial hashes of any span of a sequence of 64-bit tokens, from running sums modulo 2**64. Tokens are hashes of
    several bytes or of whole words: on plain bytes such sums collide for words as regular as Thue and Morse's."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, tokens: np.ndarray, which: int = 0):
        n, base = len(tokens), BASES[which]
        power, inverse = self._powers.get(which, (np.array([], U),) * 2)
        if len(power) <= n:
            size = max(1 << 16, 1 << int(n).bit_length())
            power, inverse = (np.concatenate([np.ones(1, U), np.cumprod(np.full(size, b, U))]) for b in (base, pow(base, -1, 1 << 64)))
            if size <= 2 * PIECE:  # larger ones aren't kept
                self._powers[which] = power, inverse
        self.inverse = inverse
        self.sums = np.zeros(n + 1, U)
        np.cumsum(tokens * power[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(U))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.array([], U)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each text (one more for the end)."""
    if len(off) == 2 and len(data) > 4 * PIECE:  # one long text, in parts
        starts, stops = [], []
        for a in range(0, len(data), PIECE):
            b = min(a + PIECE, len(data))
            gap = np.ones(b - a + 2, bool)  # with a byte on either side
            x, y = max(a - 1, 0), min(b + 1, len(data))
            gap[x - a + 1 : y - a + 1] = SPACE[data[x:y]]
            starts.append(np.flatnonzero(~gap[1:-1] & gap[:-2]) + a)
            stops.append(np.flatnonzero(~gap[1:-1] & gap[2:]) + a + 1)
        start, stop = np.concatenate(starts), np.concatenate(stops)
        return start, stop, np.array([0, len(start)])
    gap = SPACE[data]
    first, last = ~gap, ~gap
    if len(data):
        begins = np.zeros(len(data) + 1, bool)
        begins[off] = True
        first[1:] &= gap[:-1] | begins[1:-1]
        last[:-1] &= gap[1:] | begins[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of words by their bytes: a sum over their eights, each mixed with its place."""
    if not len(start):
        return np.array([], U)
    size = stop - start
    blocks = (size + 7) >> 3
    first = np.cumsum(blocks) - blocks
    nth = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    rest = np.repeat(size, blocks) - 8 * nth
    value = eights(data)[np.repeat(start, blocks) + 8 * nth].astype(U)
    value &= U(2**64 - 1) << (U(8) * (U(8) - np.minimum(rest, 8).astype(U)))
    return mix(np.add.reduceat(mix(value ^ mix(nth.astype(U) + U(1))), first) + size.astype(U))


def owner_of(off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


@dataclass
class Piece:
    """Whole texts, or a part of one longer text."""

    row: int  #: the first text's
    rows: int
    tokens: np.ndarray
    first: np.ndarray  #: each text's first token, one more for the end
    base: int  #: units of the text before a part
    lo: int  #: anchors are to be chosen from here
    hi: int  #: to here, not included
    head: np.ndarray  #: a unit's leading bytes (of a word, its hash) as a number

    def roll(self, which: int = 0) -> Rolling:
        return Rolling(self.tokens, which)


def byte_tokens(data: np.ndarray, step: int) -> np.ndarray:
    """For each place, a hash of the ``step`` (8 or 1) bytes from it on."""
    return mix(eights(data).astype(U) if step == 8 else data.astype(U) + U(1))


def pieces(texts: pa.Array, words: bool, margin: int, step: int = 8) -> Iterator[Piece]:
    """Texts as tokens, about ``PIECE`` bytes at once. A part of a longer text has ``margin`` units more on either side."""
    texts = texts.cast(pa.large_string()).fill_null("")
    for a, b in chunks(texts):
        data, off = text_bytes(texts.slice(a, b - a))
        if len(data) <= 2 * PIECE:
            if words:
                start, stop, off = word_spans(data, off)
                tokens = word_hashes(data, start, stop)
            else:
                tokens = byte_tokens(data, step)
            yield Piece(a, b - a, tokens, off, 0, 0, len(tokens), tokens if words else eights(data))
            continue
        spans = word_spans(data, off)[:2] if words else None
        n, width = (len(spans[0]), PIECE // 4) if words else (len(data), PIECE)
        for lo in range(0, n, width):
            x, y = max(0, lo - margin), min(n, lo + width + margin)
            tokens = word_hashes(data, spans[0][x:y], spans[1][x:y]) if words else byte_tokens(data[x : y + 8], step)[: y - x]
            yield Piece(a, 1, tokens, np.array([0, y - x]), x, lo - x, min(lo + width, n) - x, tokens if words else eights(data[x : y + 8]))


def anchors(grams: np.ndarray, off: np.ndarray, length: int, k: int) -> np.ndarray:
    """Sorted positions of k-grams such that every run of ``length`` tokens of a text holds one, chosen by the run's content
    alone: the leftmost k-gram of least hash. Equal runs so have equal anchors at equal places. ``grams`` has the hash
    of the k-gram at each place, ``off`` each text's first token and the end."""
    n, w = int(off[-1]), length - k + 1
    if n < length:
        return np.array([], np.int64)
    bits = U(max(PLACE_BITS, n.bit_length()))
    value = np.full(n, U(2**64 - 1))
    value[: n - k + 1] = (grams[: n - k + 1] >> bits << bits) | np.arange(n - k + 1, dtype=U)
    low, width = value, 1
    while width < w:  # minima of ever wider windows
        step = min(width, w - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    room = np.zeros(n + 1, np.int64)
    long = np.diff(off) >= length
    np.add.at(room, off[:-1][long], 1)
    np.add.at(room, off[1:][long] - length + 1, -1)
    inside = np.cumsum(room)[: len(low)] > 0  # runs that start here and end in the same text
    return np.unique((low[inside] & ((U(1) << bits) - U(1))).astype(np.int64))

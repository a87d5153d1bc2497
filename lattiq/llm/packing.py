"""Packing of documents into token windows by the sum-of-squares rule, online.

Each task streams its documents once: a document's tokens fill whole windows first, and what is left is placed at the fill
level that makes the sum of squares of the numbers of open (partly filled) windows per level least, an array of levels being
all that the choice needs. A window's pieces go out as soon as it is full, so a task holds open windows only. Nothing is
shuffled, and a lost task is run again from its input.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .ragged import release, text_bytes

PIECE = "doc_id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Texts encoded together.
AT_ONCE = 256
#: Chunks of text whose ids a worker remembers, and new ones that are encoded together.
KNOWN, NEW = 1 << 20, 1 << 14
#: Sequence ids are the task's number times this, and on.
SPREAD = 1 << 40
LETTER, STOP, BLANK = (np.zeros(256, bool) for _ in range(3))
LETTER[[*range(65, 91), *range(97, 123)]] = True
STOP[[ord(c) for c in ".,;:!?"]] = True
BLANK[[9, 10, 11, 12, 13, 32]] = True


class Encoder:
    """Ids of texts, without added special tokens, by a file of the tokenizers library whose pre-tokens never span white space
    and which tells no cases apart. Chunks between ASCII blanks are encoded by the library once and remembered; a single stop
    after a letter is a chunk of its own, as it is a pre-token of its own there."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallel work
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; null counts as empty."""
        data, off = text_bytes(texts)
        if len(data) > 2:
            at = np.flatnonzero(STOP[data])
            at = at[(at > 0) & LETTER[data[at - 1]]]
            last = np.isin(at + 1, off)  # of a text
            follows = data[np.minimum(at + 1, len(data) - 1)]
            at = at[(last | BLANK[follows]) & ~np.isin(at, off)]
            data = np.insert(data, at, 32)
            off = off + np.searchsorted(at, off)
        raw, ends = data.tobytes(), off.tolist()
        rows = []
        for i in range(len(texts)):
            text = raw[ends[i] : ends[i + 1]]
            # special tokens are case-sensitive, and letters may join with combining marks before case is dropped
            keep = b"<|" in text or b"\xcc" in text or b"\xcd" in text
            rows.append((text if keep else text.lower()).split())
        if len(self.known) > KNOWN:
            self.known.clear()
        known, out = self.known, []
        for chunks in rows:
            try:
                out.append(b"".join(map(known.__getitem__, chunks)))
            except KeyError:
                self._learn([c for c in dict.fromkeys(c for more in rows[len(out) :] for c in more) if c not in known])
                out.append(b"".join(map(known.__getitem__, chunks)))
        return out

    def _learn(self, chunks: list[bytes]) -> None:
        for i in range(0, len(chunks), NEW):
            part = chunks[i : i + NEW]
            found = self.library.encode_batch_fast([c.decode("utf-8", "replace") for c in part], add_special_tokens=False)
            self.known.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(part, found))


class Window:
    """An open window: pieces (document, start, ids as bytes, tokens of the document) in order."""

    __slots__ = ("pieces", "level")

    def __init__(self):
        self.pieces: list[tuple] = []
        self.level = 0

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.level += len(piece[2]) // 4


class Packer:
    """Sum-of-squares packing of one stream into windows of ``size`` tokens; ``most_open`` bounds the open ones."""

    def __init__(self, size: int, first_id: int, most_open: int):
        self.size, self.next_id, self.most_open, self.n_open = size, first_id, most_open, 0
        self.count = np.zeros(size + 1, np.int64)  # open windows of each level
        self.at: list[list[Window]] = [[] for _ in range(size + 1)]
        self.done: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        """All tokens of a document: whole windows, then the rest where it costs least."""
        n, whole = len(ids) // 4, len(ids) // (4 * self.size) * self.size
        for start in range(0, whole, self.size):
            window = Window()
            window.add((doc, start, ids[4 * start : 4 * (start + self.size)], n))
            self._out(window)
        if whole < n:
            self._place((doc, whole, ids[4 * whole :], n))

    def level_for(self, n: int) -> int:
        """The level at which ``n`` tokens leave the least sum of squares; 0 is a new window, ties go to the fullest."""
        count, size = self.count, self.size
        levels = np.flatnonzero(count[1 : size - n + 1]) + 1
        if not len(levels):
            return 0
        after = levels + n
        change = np.where(after < size, 2 * count[after] + 1, 0) + 1 - 2 * count[levels]
        i = len(levels) - 1 - int(change[::-1].argmin())
        return 0 if 2 * count[n] + 1 < change[i] else int(levels[i])

    def _place(self, piece: tuple) -> None:
        level = self.level_for(len(piece[2]) // 4)
        while level == 0 and self.n_open >= self.most_open:  # no further window: the fullest takes what it has room for
            window = self._take(int(np.flatnonzero(self.count)[-1]))
            piece = self._fill(window, piece)
            if piece is None:
                return
            level = self.level_for(len(piece[2]) // 4)
        window = self._take(level) if level else Window()
        window.add(piece)
        self._put(window)

    def _fill(self, window: Window, piece: tuple) -> tuple | None:
        """Puts as much of the piece into the window as it has room for; the rest of the piece."""
        doc, start, ids, n = piece
        room = self.size - window.level
        window.add((doc, start, ids[: 4 * room], n))
        self._put(window)
        return (doc, start + room, ids[4 * room :], n) if len(ids) > 4 * room else None

    def _take(self, level: int) -> Window:
        self.count[level] -= 1
        self.n_open -= 1
        return self.at[level].pop()

    def _put(self, window: Window) -> None:
        if window.level == self.size:
            self._out(window)
        else:
            self.at[window.level].append(window)
            self.count[window.level] += 1
            self.n_open += 1

    def _out(self, window: Window) -> None:
        offset = 0
        for doc, start, ids, n in window.pieces:
            self.done.append((doc, start, len(ids) // 4, n, self.next_id, offset, ids))
            offset += len(ids) // 4
        self.next_id += 1

    def close(self) -> None:
        """The end of the stream. Windows at a power of two need no padding; of the others the emptiest are poured into the
        fullest, pieces being cut at their ends, until one is left, which is dealt out to powers of two."""
        rest = []
        for level in range(self.size - 1, 0, -1):
            for window in self.at[level]:
                self._out(window) if level & (level - 1) == 0 else rest.append(window)
        self.at, self.n_open = [[] for _ in range(self.size + 1)], 0
        self.count[:] = 0
        top = 0
        while len(rest) - top > 1:
            pieces, left = rest.pop().pieces, Window()
            for piece in pieces:
                while piece is not None and top < len(rest):
                    window = rest[top]
                    room = 4 * (self.size - window.level)
                    doc, start, ids, n = piece
                    window.add((doc, start, ids[:room], n))
                    piece = (doc, start + room // 4, ids[room:], n) if len(ids) > room else None
                    if window.level == self.size:
                        self._out(window)
                        top += 1
                if piece is not None:
                    left.add(piece)
            if left.level:
                rest.append(left)
        for window in rest[top:]:
            self._halve(window)

    def _halve(self, window: Window) -> None:
        pieces, left = list(reversed(window.pieces)), window.level
        while left:
            part, room = Window(), 1 << (left.bit_length() - 1)
            left -= room
            while room:
                doc, start, ids, n = pieces.pop()
                part.add((doc, start, ids[: 4 * room], n))
                if len(ids) > 4 * room:
                    pieces.append((doc, start + room, ids[4 * room :], n))
                room -= len(part.pieces[-1][2]) // 4
            self._out(part)

    def rows(self, kind: pa.DataType) -> pa.RecordBatch | None:
        """The pieces of windows closed since the last call."""
        if not self.done:
            return None
        cols, self.done = list(zip(*self.done)), []
        names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind, *[pa.int64()] * 5, pa.binary()])], list(names))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, most_open: int = 1024) -> DataFrame:
    """One row per piece of a document: ``doc_id``, ``start`` (tokens of the document before it), ``length``, ``doc_tokens``
    (with the end), ``sequence_id``, ``offset`` (in the sequence, gapless from 0) and ``ids`` (little-endian unsigned 32-bit).

    A document is the ids of its whole text, then ``end_id``; null and empty texts are that id alone. Every id is in exactly one
    piece. A document is cut where it is longer than a window; where a task has ``most_open`` open windows (their ids are what
    it holds) and only a further one would do, so the fullest takes a part; and at the end of a task's stream, in the windows
    still open. Each sequence then has ``size`` tokens or a power of two, so none is padded. Repeated rows and null ids are
    documents of their own, an empty table gives no rows, and other columns play no part.

    Each partition of the input is packed by itself and in its order; ``sequence_id`` is unique over all. For the same ids in
    each run ``docs`` should be read from files, not come from a shuffle. ``path`` must be readable on every executor.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    arrow = pa.int32() if kind.simpleString() == "int" else pa.int64() if kind.simpleString() == "bigint" else pa.string()
    rows = docs.select((F.col(id_col) if arrow != pa.string() else F.col(id_col).cast("string")).alias("doc_id"), F.col(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = Packer(size, TaskContext.get().partitionId() * SPREAD, most_open), encoder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1))):
                    packer.add(doc, ids + end)
                if (found := packer.rows(arrow)) is not None:
                    yield found
            release()
        packer.close()
        if (found := packer.rows(arrow)) is not None:
            yield found

    return rows.mapInArrow(stream, PIECE.format(id={pa.int32(): "int", pa.int64(): "long", pa.string(): "string"}[arrow]))

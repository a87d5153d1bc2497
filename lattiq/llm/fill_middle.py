"""Fill-in-the-middle examples: texts are cut in three at code points and written with the middle last.

The places where code points start in the UTF-8 bytes of a whole batch are one packed bit vector with a directory of
popcounts: absolute ones of blocks of 512 bits, relative ones of the words in a block. The popcounts up to a text's two ends
give its number of code points n, and selecting two ranks gives the bytes to cut at, so no text is ever decoded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .ragged import U, release, text_bytes

#: The marks before prefix, suffix and middle. No mark overlaps another or itself, so each is found once.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"
_FIM = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
#: Words of 64 bits in a block of the directory.
BLOCK = 8


class Boundaries:
    """Rank and select over the bytes at which code points start, that is all but continuation bytes."""

    def __init__(self, data: np.ndarray):
        self.length = len(data)
        packed = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        blocks = self.length // (64 * BLOCK) + 1
        room = np.zeros(blocks * BLOCK * 8, np.uint8)
        room[: len(packed)] = packed
        self.words = room.view(U)
        counts = np.bitwise_count(self.words).astype(np.int64).reshape(blocks, BLOCK)
        self.inside = (np.cumsum(counts, 1) - counts).astype(np.uint16)  # starts in a block before each of its words
        self.before = np.r_[0, np.cumsum(counts.sum(1))]  # starts before each block, and all of them

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that start before byte ``at``."""
        word = at >> 6
        low = self.words[word] & ((U(1) << (at & 63).astype(U)) - U(1))
        return self.before[word // BLOCK] + self.inside.reshape(-1)[word] + np.bitwise_count(low)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The byte at which the code point of that rank, from 0, starts; the end of all for a rank beyond the last."""
        out = np.full(len(rank), self.length, np.int64)
        real = rank < self.total
        block = np.searchsorted(self.before, rank[real], "right") - 1
        left = rank[real] - self.before[block]
        nth = (self.inside[block] <= left[:, None]).sum(1) - 1
        left = left - self.inside[block, nth]
        word = self.words[block * BLOCK + nth]
        bit = np.zeros(len(word), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & U((1 << half) - 1))
            up = left >= low
            left, bit = np.where(up, left - low, left), bit + half * up
            word = np.where(up, word >> U(half), word)
        out[real] = (block * BLOCK + nth) * 64 + bit
        return out


def transform(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray, h4: np.ndarray, plain_percent: int, spm_percent: int) -> pa.Array:
    """The examples of a batch of texts."""
    data, off = text_bytes(texts)
    starts = Boundaries(data)
    base = starts.rank(off)
    n = base[1:] - base[:-1]
    base = base[:-1]
    c1, c2 = h1 % (n + 1), h2 % (n + 1)
    first, last = np.minimum(c1, c2), np.maximum(c1, c2)
    cut1, cut2 = np.minimum(starts.select(base + first), off[1:]).tolist(), np.minimum(starts.select(base + last), off[1:]).tolist()
    raw, ends = data.tobytes(), off.tolist()
    plain, spm = ((n == 0) | (h3 % 100 >= 100 - plain_percent)).tolist(), (h4 % 100 < spm_percent).tolist()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    forms, outputs = [], []
    for i in range(len(n)):
        text = raw[ends[i] : ends[i + 1]]
        a, b = cut1[i] - ends[i], cut2[i] - ends[i]
        if plain[i] or p in text or s in text or m in text:
            forms.append("plain")
            outputs.append(text)
        elif spm[i]:
            forms.append("spm")
            outputs.append(b"".join((s, text[b:], p, text[:a], m, text[a:b])))
        else:
            forms.append("psm")
            outputs.append(b"".join((p, text[:a], s, text[b:], m, text[a:b])))
    whole = np.array([f == "plain" for f in forms], bool)
    found = {
        "n": pa.array(n, pa.int64()),
        "form": pa.array(forms, pa.string()),
        "prefix_chars": pa.array(first, pa.int64(), mask=whole),
        "middle_chars": pa.array(last - first, pa.int64(), mask=whole),
        "output": pa.array(outputs, pa.binary()).view(pa.string()),
    }
    return pa.StructArray.from_arrays([found[f.name] for f in _FIM], fields=list(_FIM))


def fill_in_middle(docs: DataFrame, out: str = "fim", id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``docs`` with a struct column ``out`` (a column of that name is replaced): ``n`` (code points), ``form`` (plain, psm or
    spm), ``prefix_chars``, ``middle_chars`` (code points; null if plain) and ``output``.

    The four first 32-bit numbers of the sha256 of ``seed:id`` decide on a document: two on its cuts, one on whether it stays
    plain (``plain_percent``), one on whether the suffix comes first (``spm_percent`` of the others). Empty texts, null ones
    (taken as empty) and those that contain a mark stay plain; texts of any length are cut whole; a null id counts as an empty
    one. Rows of one id and text come out alike, other columns are carried along, and an empty table gives no rows. The work
    is by rows: nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]

    @F.arrow_udf(FIM)
    def cut(texts: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        found = transform(texts, *[x.to_numpy(zero_copy_only=False) for x in (a, b, c, d)], plain_percent, spm_percent)
        release()
        return found

    return docs.withColumn(out, cut(F.col(text_col), *numbers))


def restored(output: Column, form: Column) -> Column:
    """The original text, from an example and its form."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
        .otherwise(output)
    )

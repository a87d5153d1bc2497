"""Phrase collocations by vertical positional inverted lists.

Texts are laid out in blocks of numbered positions with a gap after each piece, and a block's row of the index has, for each
word of one language, the list of its positions. Frequent phrases are extended a word at a time inside each block: the
positions of a phrase are merged with the postings of the words next to them, and the lengths of the lists so made, summed
over the blocks, are the exact frequencies. Lists are never gathered by word, so a word that is a third of a corpus is in as
many lists as there are blocks.

What is frequent so far reaches the blocks as a bit array of bounded size. Phrases that it lets through by chance only cost a
list: every frequency is counted in full before it is judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, spent, written
from .ragged import U, mix, release

#: Bytes A-Z in lower case, tabs as spaces, and what parts pieces as a full stop, which no word has.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in b".,;:!?\n\v\f\r" else b for b in range(256))
#: Positions of a block at most, and bytes of a text that are split into words at once.
BLOCK, SLICE = 1 << 18, 1 << 20
#: Bytes of a row group of the index.
ROW_GROUP = 16 << 20
#: Bits for each frequent phrase in the array that is broadcast, and bounds of its size (32 MiB at most).
BITS_EACH, FEWEST, MOST = 16, 1 << 20, 1 << 28
#: Parts into which each language's candidates go before the last ranking.
PARTS = 64
INDEX = "lang string, own int, words array<string>, counts array<int>, ends binary, places binary"
COUNTS = "lang string, phrase string, n long"


class Numbers(dict):
    """Numbers words as they come; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text after ``TABLE``, ``.`` where a piece ends, some bytes at a time."""
    start = 0
    while start < len(text):
        stop = start + size
        if stop < len(text):  # go on to the end of a word
            ends = [at for at in (text.find(b" ", stop), text.find(b".", stop)) if at >= 0]
            stop = min(ends) if ends else len(text)
        yield text[start:stop].replace(b".", b" . ").split()
        start = stop


class Block:
    """The words of one language at numbered positions."""

    def __init__(self, lang: str, overlap: int, most: int):
        self.lang, self.overlap, self.most = lang, overlap, most
        self.numbers, self.line = Numbers({b".": 0}), []

    def add(self, text: bytes) -> Iterator[dict]:
        """Lays out a text. A block that is full on the way goes out, and its last words start the next one too."""
        for words in tokens(text.translate(TABLE)):
            self.line += map(self.numbers.__getitem__, words)
            if len(self.line) >= self.most:
                names = list(self.numbers)
                last = [names[i] for i in self.line[-self.overlap :]] if self.overlap else []
                yield self.row(len(self.line) - len(last))
                self.numbers, self.line = Numbers({b".": 0}), []
                self.line += map(self.numbers.__getitem__, last)
        self.line.append(0)

    def row(self, own: int) -> dict:
        """The index row; phrases that start at position ``own`` or later are the next block's."""
        line = np.array(self.line, np.int32)
        order = np.argsort(line, kind="stable").astype(np.int32)
        ends = np.cumsum(np.bincount(line, minlength=len(self.numbers)))
        words = list(self.numbers)[1:]
        return {
            "lang": self.lang, "own": own, "words": [w.decode("utf-8", "replace") for w in words], "counts": np.bincount(line[:own], minlength=len(self.numbers))[1:],
            "ends": (ends[1:] - ends[0]).astype("<i4").tobytes(), "places": order[ends[0] :].astype("<i4").tobytes(),
        }


def index(docs: DataFrame, overlap: int, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> DataFrame:
    """The inverted lists, a row per block and language: ``words``, ``counts`` (their occurrences that are the block's own),
    ``places`` (the positions of each word, list after list, 32 bits each), ``ends`` (where the lists end) and ``own``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text is not null")

    def batch_of(row: dict) -> pa.RecordBatch:
        kinds = {"lang": pa.string(), "own": pa.int32(), "words": pa.list_(pa.string()), "counts": pa.list_(pa.int32()), "ends": pa.binary(), "places": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in kinds.items()], list(kinds))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            open_blocks: dict[str, Block] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = open_blocks.setdefault(lang, Block(lang, overlap, block))
                yield from map(batch_of, own.add(text.as_buffer().to_pybytes()))
            for own in open_blocks.values():
                if len(own.numbers) > 1:
                    yield batch_of(own.row(len(own.line)))
            release()

    return rows.mapInArrow(build, INDEX)


def codes(lang: str, words: list[str]) -> np.ndarray:
    start = lang.encode() + b"\n"
    return np.fromiter((xxhash.xxh3_64_intdigest(start + w.encode()) for w in words), U, len(words))


def joined(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The code of a phrase, from those of all its words but the last and of its last."""
    return mix(first * U(0x9E3779B97F4A7C15) + last)


class Bits:
    """Which codes are of frequent phrases; some others are let through."""

    def __init__(self, power: int):
        self.power, self.array = power, np.zeros(1 << (power - 3), np.uint8)

    def __contains__(self, _):
        raise TypeError("look up arrays by has()")

    def has(self, code: np.ndarray) -> np.ndarray:
        at = code >> U(64 - self.power)
        return (self.array[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


def bits_of(frequent: DataFrame) -> Bits:
    """The bit array of a table of phrases; its segments are put together by aggregation and have a bounded size in all."""
    power = int(np.clip(BITS_EACH * frequent.count(), FEWEST, MOST)).bit_length() - 1
    found = Bits(power)

    @F.arrow_udf("bigint")
    def places(langs: pa.Array, phrases: pa.Array) -> pa.Array:
        out = np.zeros(len(phrases), U)
        names = np.array(langs.to_pylist(), object)
        texts = phrases.to_pylist()
        for lang in set(names):
            own = np.flatnonzero(names == lang)
            lists = [texts[i].split(" ") for i in own]
            width = len(lists[0])
            code = codes(lang, [w[0] for w in lists])
            for k in range(1, width):
                code = joined(code, codes(lang, [w[k] for w in lists]))
            out[own] = code
        return pa.array((out >> U(64 - power)).astype(np.int64), pa.int64())

    at = frequent.select(places("lang", "phrase").alias("at"))
    segments = at.groupBy(F.floor(F.col("at") / 32768).alias("s")).agg(F.bitmap_construct_agg((F.col("at") % 32768).cast("long")).alias("b"))
    for r in segments.collect():  # 4 KiB each, at most MOST bits in all
        own = np.frombuffer(r.b, np.uint8)
        found.array[r.s * 4096 : r.s * 4096 + len(own)][: len(found.array) - r.s * 4096] = own[: len(found.array) - r.s * 4096]
    return found


def phrases(lists: DataFrame, width: int, frequent: list) -> DataFrame:
    """The phrases of ``width`` words of which all shorter parts may be frequent, with their occurrences in each block;
    ``frequent`` has a broadcast bit array for each shorter width."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lang, own = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                words = batch.column(2)[row].values
                ends, places = (np.frombuffer(batch.column(c)[row].as_buffer(), "<i4") for c in (4, 5))
                code = codes(lang, words.to_pylist())
                word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(np.r_[0, ends]))
                keep = frequent[0].value.has(code)[word]
                order = np.argsort(places[keep], kind="stable")
                at, word = places[keep][order], word[keep][order]  # postings in order of position
                # a list of occurrences: where they start, which phrase, and each phrase's words
                start, phrase, spelled, known = at, word, np.arange(len(words), dtype=np.int32)[:, None], code
                for k in range(2, width + 1):
                    # the occurrences go on where a list of the same width starts one position later
                    next_to = np.searchsorted(at, start + k - 1)
                    hit = next_to < len(at)
                    hit[hit] = at[next_to[hit]] == start[hit] + k - 1
                    start, follow = start[hit], word[next_to[hit]]
                    key, phrase = np.unique(phrase[hit].astype(np.int64) * len(words) + follow, return_inverse=True)
                    spelled = np.c_[spelled[key // len(words)], (key % len(words)).astype(np.int32)]
                    known = joined(known[key // len(words)], code[key % len(words)])
                    if k == width:
                        break
                    # lists of phrases that can't be frequent end here
                    good = frequent[k - 1].value.has(known)[phrase]
                    start, phrase = start[good], phrase[good]
                counts = np.bincount(phrase[start < own], minlength=len(spelled)) if len(spelled) else np.zeros(0, np.int64)
                made = np.flatnonzero(counts)
                if width > 2 and len(made):  # the end of a phrase is one of width - 1 too
                    end = code[spelled[made, 1]]
                    for k in range(2, width):
                        end = joined(end, code[spelled[made, k]])
                    made = made[frequent[width - 2].value.has(end)]
                for i in range(0, len(made), 1 << 16):
                    part = made[i : i + (1 << 16)]
                    text = pc.binary_join_element_wise(*[words.take(pa.array(spelled[part, k])) for k in range(width)], " ")
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(part)), text, pa.array(counts[part], pa.int64())], ["lang", "phrase", "n"])
            release()

    return lists.mapInArrow(extend, COUNTS)


def best_cut(candidates: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(lang, phrase, a, m) with ``k``, ``l``, ``r`` and ``score`` of the cut after k words that scores lowest."""
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - m)")})
    side = lambda c, n: frequencies.select("lang", F.col("phrase").alias(c), F.col("a").alias(n))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.withColumns({"up": (wide("a") * wide("a")).cast("decimal(30,0)") * F.lit(1_000_000).cast("decimal(7,0)"), "down": wide("l") * wide("r")})
    scored = scored.withColumn("score", F.expr("up div down"))
    return scored.groupBy("lang", "phrase", "a", "m").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "m", "b.*")


def contained(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, longest): phrases of two words or more inside longer candidates, with the highest frequency of those."""
    words = F.split("phrase", " ")
    inner = F.expr("flatten(transform(sequence(2, m - 1), n -> transform(sequence(1, m - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    rows = candidates.filter("m > 2").withColumn("w", words).select("lang", F.explode(inner).alias("phrase"), "a")
    return rows.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))


def collocations(
    docs: DataFrame, max_words: int = 3, min_count: int = 10, top: int = 2000, percent: int = 50, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK
) -> DataFrame:
    """The ``top`` phrases of 2 to ``max_words`` words of each language: ``lang``, ``rank`` (from 1), ``phrase`` (joined by
    spaces), ``a`` (its occurrences), ``l`` and ``r`` (those of its parts at the cut that scores lowest), ``n`` (words of the
    language) and ``score``, which is floor(1000000 a a / (l r)), in exact arithmetic.

    Texts are lower-cased (A-Z) and parted into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces and tabs;
    phrases don't cross pieces. Candidates occur ``min_count`` times or more; those inside a longer candidate that has
    ``percent`` % of their occurrences or more are dropped. Ranks go by score, then frequency, both descending, then phrase in
    the order of its bytes. A null language is ``und``; null and empty texts have no words; repeated rows count again; texts
    of any length count whole, in several blocks. An empty table, or one without frequent phrases, gives no rows, and other
    columns play no part.
    """
    # rows are large, and a reader holds a row group at once
    lists = written(index(docs, max_words - 1, text_col, lang_col, block), "postings", **{"parquet.block.size": str(ROW_GROUP)})
    words = lists.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("phrase"), F.col("w.counts").cast("long").alias("n"))
    levels, shared = [], []
    for width in range(1, max_words + 1):
        counted = phrases(lists, width, shared) if width > 1 else words
        level = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= min_count).withColumn("m", F.lit(width))
        levels.append(written(level, f"phrases{width}"))
        if width < max_words:
            shared.append(docs.sparkSession.sparkContext.broadcast(bits_of(levels[-1])))
    totals = written(lists.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")), "totals")
    spent(lists)
    frequencies = candidates = levels[0]
    for i, level in enumerate(levels[1:]):
        frequencies = frequencies.unionByName(level)
        candidates = candidates.unionByName(level) if i else level
    kept = best_cut(candidates, frequencies).join(contained(candidates), ["lang", "phrase"], "left")
    kept = kept.filter(F.col("longest").isNull() | (100 * F.col("longest") < percent * F.col("a")))
    order: list[Column] = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

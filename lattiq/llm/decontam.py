"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items, run once over each
text, with hits mapped back to character offsets of the original text. Words are written in three letters each, so that the
automaton is small and each of its nodes has few ways on."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches, written
from .ragged import release

#: Words of the contract, after A-Z are lower-cased: runs of 0-9, a-z and everything beyond ASCII.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b <= 122 or b >= 128 else 32 for b in range(256))
ORIGINAL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORIGINAL_WORD = re.compile(ORIGINAL)
HIT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,runs:array<struct<start:int,stop:int>>,spans:array<struct<start:int,stop:int>>>"
_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_HIT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("runs", _RUNS), ("spans", _RUNS)])


#: Letters of each of the three places of a word; a letter tells its place.
BASE = 70
OTHER = "\0\0\0"


def spelled(n: int) -> str:
    return chr(1 + n % BASE) + chr(1 + BASE + n // BASE % BASE) + chr(1 + 2 * BASE + n // BASE**2)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class Windows:
    """The windows of some items, and how their words (``BASE`` ** 3 at most) are spelled. An item of fewer words is one window,
    one without words has none."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        self.letters: dict[bytes, str] = {}
        self.found: dict[str, set] = {}
        for key, text in items:
            line = [self.letters.setdefault(w, spelled(len(self.letters))) for w in words_of(text)]
            for i in range(max(1, len(line) - width + 1) if line else 0):
                self.found.setdefault("".join(line[i : i + width]), set()).add(key)

    def machine(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for window, keys in self.found.items():
            machine.add_word(window, (len(window) // 3, sorted(k for k in keys if k is not None)))
        if self.found:
            machine.make_automaton()
        return machine


class Hits:
    """What has been found in a text so far."""

    __slots__ = ("n_words", "keys", "spans")

    def __init__(self, earlier: dict | None = None):
        self.n_words = 0
        self.keys = set(earlier["items"]) if earlier else set()
        self.spans = [[r["start"], r["stop"]] for r in earlier["runs"]] if earlier else []

    def scan(self, windows: Windows, machine, text: str | None) -> None:
        words = words_of(text)
        self.n_words = len(words)
        if words and len(machine):
            letter = windows.letters.get
            for end, (n, items) in machine.iter("".join([letter(w, OTHER) for w in words])):
                last = end // 3 + 1
                if self.spans and self.spans[-1][1] >= last - n >= self.spans[-1][0]:
                    self.spans[-1][1] = max(last, self.spans[-1][1])
                else:
                    self.spans.append([last - n, last])
                self.keys.update(items)

    def found(self, text: str | None, places: bool) -> dict:
        merged: list[list[int]] = []
        for a, b in sorted(self.spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        where = [m.span() for m in ORIGINAL_WORD.finditer(text)] if merged and places else []
        spans = [{"start": where[a][0], "stop": where[b - 1][1]} for a, b in merged] if where else []
        return {"n_words": self.n_words, "n_hit": sum(b - a for a, b in merged), "items": sorted(self.keys), "runs": [{"start": a, "stop": b} for a, b in merged], "spans": spans}


@lru_cache(maxsize=1)
def _only_machine(shared):
    windows = Windows(*shared.value[0])
    return windows, windows.machine()


def _scans(shared, spans: bool, at_once: int):
    """One pass over the texts. A single automaton stays with the worker; of several, each is made in turn and all texts at hand
    (about ``at_once`` bytes) go through it."""

    def judged(held: list[tuple]) -> Iterator[pa.Array]:
        texts = [part[0].to_pylist() for part in held]
        hits = [[Hits(e) for e in (part[1].to_pylist() if len(part) > 1 else [None] * len(part[0]))] for part in held]
        several = len(shared.value) > 1
        for shard in shared.value:
            if several:
                windows = Windows(*shard)
                machine = windows.machine()
            else:
                windows, machine = _only_machine(shared)
            for part, own in zip(texts, hits):
                for text, hit in zip(part, own):
                    hit.scan(windows, machine, text)
        for part, own in zip(texts, hits):
            yield pa.array([hit.found(text, spans) for text, hit in zip(part, own)], _HIT)
        release()

    def streamed(batches: Iterator[tuple]) -> Iterator[pa.Array]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch[0].nbytes
            if len(shared.value) == 1 or size >= at_once:
                yield from judged(held)
                held, size = [], 0
        if held:
            yield from judged(held)

    @F.arrow_udf(HIT)
    def first(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from streamed((t,) for t in texts)

    @F.arrow_udf(HIT)
    def further(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from streamed(batches)

    return first, further


def contamination(
    docs: DataFrame, benchmark: DataFrame, out: str = "hit", text_col: str = "text", width: int = 13, with_spans: bool = True, max_words: int = 50_000, item_id: str = "item_id", item_text: str = "text", at_once: int = 64 << 20, max_sent: int = 400
) -> DataFrame:
    """``docs`` with a struct column ``out`` (a column of that name is replaced): ``n_words``, ``n_hit`` (words inside any
    occurrence of a window), ``items`` (ids, as strings, sorted, of items with occurring windows), ``runs`` (maximal hit
    runs of words) and ``spans`` (the same as character offsets of the text).

    The texts of the benchmark are broadcast, and documents are read once. The windows of at most ``max_words`` benchmark words
    are one automaton; a larger benchmark is dealt to several by the hash of its items, and each goes over the texts at hand,
    about ``at_once`` bytes, before the next is made. Only of a benchmark of over ``max_sent`` automata (about 64 MB of text) is
    a part broadcast at a time, with the documents and their hits so far written in between. Null and empty texts have no words; texts are scanned whole, however
    long. Null item texts and items without words have no windows; the windows of items with a null id hit words but are
    listed under no id; repeated items hit together. An empty benchmark hits nothing, an empty table of documents gives no
    rows, and repeated rows are judged alike.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("k"), F.col(item_text).alias("t")).filter("t is not null")
    words = items.agg(F.coalesce(F.sum(F.regexp_count("t", F.lit(ORIGINAL))), F.lit(0))).first()[0]
    shards = max(1, -(-2 * words // max_words)) if words > max_words else 1  # half full on average, as items are dealt by hash
    items = items.withColumn("s", F.pmod(F.xxhash64("k", "t"), F.lit(shards)))
    rows = docs
    for at in range(0, shards, max_sent):
        dealt: list[list] = [[] for _ in range(min(max_sent, shards - at))]
        for r in items.filter((F.col("s") >= at) & (F.col("s") < at + max_sent)).collect():
            dealt[r.s - at].append((r.k, r.t))
        shared = spark.sparkContext.broadcast([(part, width) for part in dealt])
        first, further = _scans(shared, with_spans, at_once)
        rows = rows.withColumn(out, further(F.col(text_col), F.col(out)) if at else first(F.col(text_col)))
        if at + max_sent < shards:
            rows = written(rows, "hits")
    return rows


def is_contaminated(hit: Column) -> Column:
    """At least 5 % of the words are hit."""
    return (hit["n_hit"] > 0) & (20 * hit["n_hit"] >= hit["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns; null and empty texts stay."""
    hit = free_name(docs, "__hit")
    return contamination(docs, benchmark, hit, text_col, with_spans=False).filter(~is_contaminated(F.col(hit))).drop(hit)

"""URL rules by Bloom filter cascades.

A cascade answers membership exactly for every key of a known universe. Level 1 encodes the listed keys; level 2 the
universe's other keys that level 1 lets through; level 3 the listed keys that level 2 lets through, and so on until a
level lets nothing through. A key of the universe is listed if the first level that rejects it is even. The universe
here is every (host or parent domain, path prefix) that any url of the corpus has, so each url is judged by lookups
in a few bit arrays, without a join. Bits are set by aggregation in the cluster; no keys come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, ensure_checkpoint_dir, free_name

SEED_A, SEED_B = 11, 13
#: 64-bit words of a bit array that come to the driver as one row.
SEGMENT = 1 << 13


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key a rule could have that fits: the host and its parent domains, each with the path's prefixes of the given
    lengths; the longest first."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(parents, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    sized = F.array_sort(F.transform(F.array_distinct(keys), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    return F.transform(sized, lambda s: s["k"])


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(SEED_A)), F.xxhash64(key, F.lit(SEED_B))


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray = field(repr=False)

    def passes(self, a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        out = np.ones(len(a), bool)
        for i in range(self.hashes):
            at = slot(a, b, salt, i) % np.uint64(self.bits)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def slot(a: np.ndarray, b: np.ndarray, salt: int, i: int) -> np.ndarray:
    x = (a.view(np.uint64) + np.uint64(i) * (b.view(np.uint64) | np.uint64(1))) ^ np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@dataclass
class Cascade:
    levels: list[Level]

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe."""
        answer = np.zeros(len(a), bool)
        live = np.arange(len(a))
        for salt, level in enumerate(self.levels):
            through = level.passes(a[live], b[live], salt)
            answer[live[~through]] = salt % 2 == 1
            live = live[through]
        answer[live] = len(self.levels) % 2 == 1
        return answer


def _level(keys: DataFrame, n: int, rate: float, salt: int, max_bits: int) -> Level:
    """Encodes the keys' hashes (columns a, b). Bits are united by aggregation; the array's segments come to the driver as bytes."""
    hashes = max(1, round(-np.log2(rate)))
    bits = min(max_bits, max(64, int(np.ceil(n * hashes / np.log(2)))))

    def spread(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = np.concatenate([slot(a, b, salt, i) % np.uint64(bits) for i in range(hashes)]).astype(np.int64) if len(a) else np.array([], np.int64)
            at = np.unique(at)
            word, first = np.unique(at >> 6, return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.array([], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(mask.view(np.int64), pa.int64())], ["w", "m"])

    def pack(part: pa.Table) -> pa.Table:
        own = np.zeros(SEGMENT, np.uint64)
        own[part.column("w").to_numpy() % SEGMENT] = part.column("m").to_numpy().view(np.uint64)
        return pa.table({"s": part.column("s").slice(0, 1), "b": pa.array([own.tobytes()], pa.binary())})

    set_words = keys.select("a", "b").mapInArrow(spread, "w bigint, m bigint").groupBy("w").agg(F.bit_or("m").alias("m"))
    segments = set_words.withColumn("s", F.floor(F.col("w") / SEGMENT)).groupBy("s").applyInArrow(pack, "s bigint, b binary")
    words = np.zeros(-(-bits // (64 * SEGMENT)) * SEGMENT, np.uint64)
    for r in segments.collect():  # at most max_bits in all, as bytes
        words[r.s * SEGMENT : (r.s + 1) * SEGMENT] = np.frombuffer(r.b, np.uint64)
    return Level(bits, hashes, words)


def _through(keys: DataFrame, level: Level, salt: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def sift(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield batch.filter(pa.array(shared.value.passes(a, b, salt)))

    return keys.select("a", "b").mapInArrow(sift, "a bigint, b bigint")


def build_cascade(listed: DataFrame, others: DataFrame, first_rate: float = 2**-12, rate: float = 2**-4, max_bits: int = 1 << 31, max_levels: int = 40) -> Cascade:
    """From the hashes (columns a, b) of listed keys and of the universe's other keys. A level's size follows the number of
    keys it encodes; ``max_bits`` bounds what is broadcast, and a smaller array only means more levels. Empty lists give
    a cascade that lists nothing."""
    ensure_checkpoint_dir(listed.sparkSession)
    inside, outside, levels = listed.select("a", "b").distinct().checkpoint(), others.select("a", "b"), []
    while len(levels) < max_levels:
        n = inside.count()
        if not n:
            break
        level = _level(inside, n, rate if levels else first_rate, len(levels), max_bits)
        inside, outside = _through(outside, level, len(levels)).distinct().checkpoint(), inside
        levels.append(level)
    else:
        raise ValueError("two keys of the universe have the same hashes")
    return Cascade(levels)


def judge_urls(pages: DataFrame, block: list[str], allow: list[str], url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` added (same-named columns are replaced).

    A rule is ``host/path``. It fits its host and all subdomains if the url's path starts with the rule's path; the longest
    wins, and a url that no rule fits is allowed. A rule listed both ways blocks. Null urls and urls without ``://``
    have empty host and path and fit no rule. Hosts with long chains of labels and very long paths are judged whole;
    repeated rows are judged alike, and an empty table gives no rows.
    """
    spark = pages.sparkSession
    split = lambda rule: (rule.partition("/")[0], "/" + rule.partition("/")[2])
    lengths = sorted({len(split(r)[1]) for r in [*block, *allow]})
    url = F.col(url_col)
    rows = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    if not lengths:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    keys, hit = free_name(rows, "__keys"), free_name(rows, "__hit")
    rows = rows.withColumn(keys, rule_keys(F.col("host"), F.col("path"), lengths))
    universe = rows.select(F.explode(keys).alias("k")).distinct()
    cascades = []

    def hashed(keys: DataFrame) -> DataFrame:
        a, b = _hashes(F.col("k"))
        return keys.select(a.alias("a"), b.alias("b"))

    for rules in (block, allow):
        listed = spark.createDataFrame(pa.table({"k": pa.array(list(dict.fromkeys(rules)), pa.string())}))
        others = universe.join(listed, "k", "left_anti")
        cascades.append(build_cascade(hashed(listed), hashed(others)))
    shared = spark.sparkContext.broadcast(cascades)

    @F.arrow_udf("struct<at:int,blocked:boolean>")
    def first_rule(a: pa.Array, b: pa.Array) -> pa.Array:
        sizes = np.diff(a.offsets.to_numpy())
        x, y = (z.flatten().to_numpy(zero_copy_only=False) for z in (a, b))
        blocked, allowed = (c.listed(x, y) for c in shared.value)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        hit = np.flatnonzero(blocked | allowed)
        who, first = np.unique(owner[hit], return_index=True)
        start = np.cumsum(sizes) - sizes
        at, bad = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), bool)
        at[who] = hit[first] - start[who] + 1
        bad[who] = blocked[hit[first]]
        return pa.StructArray.from_arrays([pa.array(at), pa.array(bad)], ["at", "blocked"])

    a, b = F.transform(keys, lambda k: _hashes(k)[0]), F.transform(keys, lambda k: _hashes(k)[1])
    judged = rows.withColumn(hit, first_rule(a, b))
    at = F.col(hit)["at"]
    return judged.withColumns(
        {
            "rule": F.when(at > 0, F.element_at(keys, F.greatest(at, F.lit(1)))),
            "verdict": F.when(F.col(hit)["blocked"], "block").otherwise("allow"),
        }
    ).drop(hit, keys)

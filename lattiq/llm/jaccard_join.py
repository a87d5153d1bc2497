"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and the groups they link into.

Equal sets are one class and go on as one. Each class's shingles are put in global order, rare first; two classes can only
link if their prefixes share a shingle, and if they pass the length, positional and suffix filters. Candidates are verified
once per pair on their whole sets, in three steps that spare the pairs within large groups: 1. of the classes that share a
prefix shingle and are of like size, each with one centre; 2. of those still apart, each with a second centre; 3. all
pairs of classes of different components. Links inside a component would not change the result, so they aren't listed.

Frequencies are counted over all documents in a fixed number of slots; any order gives the same links, this one keeps
common shingles out of prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, spent, written
from .components import components
from .ragged import BASES, LOWER, PIECE, Rolling, U, chunks, mix, release, text_bytes, word_hashes, word_spans
from .repeats import keyed, row_key
from .url_filter import _level

SLOTS = 1 << 16
BINS = 96
#: Rows of one shingle that meet in one task; those of more common ones meet block by block.
BLOCK = 4096
#: Shingles before a shared one that a row carries along, to tell that a pair was listed before.
BEFORE = 6
FEATURES = "kind int, d long, h long, n int, s1 long, s2 long, bins binary"


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle codes of every text, one text after the other, and where each text's start (one more for the end).
    A text of fewer words has its whole sequence as one; one without words has none."""
    data, off = text_bytes(texts)
    data = LOWER[data]
    start, stop, first = word_spans(data, off)
    roll = Rolling(word_hashes(data, start, stop))
    size = np.diff(first)
    count = np.where(size >= width, size - width + 1, (size > 0).astype(size.dtype))
    owner = np.repeat(np.arange(len(size)), count)
    at = np.repeat(first[:-1], count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    code = roll.spans(at, np.minimum(at + width, first[1:][owner]))
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    code, owner = code[new], owner[new]
    return code, np.searchsorted(owner, np.arange(len(size) + 1))


def _sum(value: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U), np.cumsum(value)])
    return total[off[1:]] - total[off[:-1]]


def _features(width: int):
    """Kind 0: a text's set size, set hashes and bins (how many shingles fall in each of ``BINS`` hash ranges, for the suffix
    filter). Kind 1: how many shingles fell in slot ``d``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        names = ["kind", "d", "h", "n", "s1", "s2", "bins"]
        for batch in batches:
            for a, b in chunks(batch.column(2)):
                code, off = shingles(batch.column(2).slice(a, b - a), width)
                seen += np.bincount((code & U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
                n = np.diff(off)
                s1, s2 = _sum(mix(code + U(1)), off), _sum(mix(code ^ U(BASES[1])), off)
                place = np.repeat(np.arange(b - a), n) * BINS + (mix(code) % U(BINS)).astype(np.int64)
                bins = np.minimum(np.bincount(place, minlength=(b - a) * BINS), 255).astype(np.uint8).reshape(b - a, BINS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(b - a), pa.int32()), batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int32()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array([x.tobytes() for x in bins], pa.binary())], names
                )
        slot = np.flatnonzero(seen)
        if len(slot):
            zero = pa.array(np.zeros(len(slot), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(slot)), pa.int32()), pa.array(slot), zero, zero.cast(pa.int32()), pa.array(seen[slot]), zero, pa.nulls(len(slot), pa.binary())], names)
        release()

    return rows


def _prefixes(width: int, percent: int, rank: np.ndarray):
    """The prefix of each set in global order: (shingle, key, size, place)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(2)):
                code, off = shingles(batch.column(2).slice(a, b - a), width)
                n = np.diff(off)
                owner = np.repeat(np.arange(b - a), n)
                order = np.lexsort((code, rank[(code & U(SLOTS - 1)).astype(np.int64)], owner))
                place = np.arange(len(code)) - off[:-1][owner]
                kept = n - -(-percent * n // 100) + 1
                keep = place < kept[owner]
                code, owner, place = code[order][keep], owner[keep], place[keep]
                who = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code.view(np.int64)), *(batch.column(i).slice(a, b - a).take(who) for i in range(2)), pa.array(n[owner], pa.int32()), pa.array(place, pa.int32())], ["token", "d", "h", "n", "place"]
                )
        release()

    return rows


def needed(a, b, percent: int):
    """The least intersection with which sets of these sizes link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _table(bins: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(bins.to_pylist()), np.uint8).reshape(-1, BINS)


def _close(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """The suffix filter: sets differ in at least the sum of the differences of their bins."""
    apart = np.abs(p.astype(np.int16) - q).sum(1, dtype=np.int64)
    return (a + b - apart) // 2 >= needed(a, b, percent)


def _candidates(percent: int, rows_at_once: int = 20_000, cells: int = 1 << 18):
    """Pairs of one shingle's rows that are of different components and pass the length, positional and suffix filters.

    Rows come sorted by shingle, block pair and size; rows of different blocks are paired in the pair of their blocks, those of
    one block in the pair of it with itself. A pair is left out where the shared shingles just before this one have one in
    common, as it is then listed at an earlier one; the first shingle that two prefixes share has none before it in common.
    """

    def pairs(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        col = {n: t.column(n).combine_chunks() for n in t.column_names}
        token, low, high, block, d, h, comp, n, place = (col[c].to_numpy() for c in ("token", "low", "high", "block", "d", "h", "comp", "n", "place"))
        bins, lists = _table(col["bins"]), col["before"]
        size = np.diff(lists.offsets.to_numpy())
        before, owner = np.zeros((len(token), BEFORE), np.int64), np.repeat(np.arange(len(token)), size)
        before[owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy(zero_copy_only=False)
        some = np.arange(BEFORE)[None, :] < size[:, None]

        def later(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            """Whether a pair has a shared shingle just before this one."""
            out = np.zeros(len(u), bool)
            for i in range(BEFORE):
                for j in range(BEFORE):
                    out |= (before[u, i] == before[v, j]) & some[u, i] & some[v, j]
            return out

        new = (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        cuts = np.r_[0, np.flatnonzero(new) + 1, len(token)]
        n64, at = n.astype(np.int64), np.arange(len(token))
        end, out = np.repeat(cuts[1:], np.diff(cuts)), []
        # partners of row i are rows i + 1 .. end of at most n / percent units
        step = np.maximum(end - at - 1, 0)
        total = np.cumsum(step)
        begin = 0
        while begin < len(token):
            stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + cells, "right")))
            k = step[begin:stop]
            x = np.repeat(at[begin:stop], k)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
            good = (comp[x] != comp[y]) & (100 * n64[x] >= percent * n64[y]) & ((low[x] == high[x]) | (block[x] != block[y]))
            x, y = x[good], y[good]
            good = np.minimum(n64[x] - place[x], n64[y] - place[y]) >= needed(n64[x], n64[y], percent)
            x, y = x[good], y[good]
            good = ~later(x, y)
            x, y = x[good], y[good]
            good = np.concatenate([_close(n64[u], bins[u], n64[v], bins[v], percent) for u, v in zip(np.array_split(x, len(x) // 50_000 + 1), np.array_split(y, len(x) // 50_000 + 1))])
            out.append((x[good], y[good]))
            begin = stop
        x, y = (np.concatenate([o[i] for o in out]) if out else np.array([], np.int64) for i in (0, 1))
        both = np.unique(np.stack([d[x], h[x], d[y], h[y]], 1), axis=0) if len(x) else np.zeros((0, 4), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, i]) for i in range(4)], ["xd", "xh", "yd", "yh"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= rows_at_once:
                t = pa.concat_tables(held).combine_chunks()
                key = [t.column(c).to_numpy() for c in ("token", "low", "high")]
                cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
                if len(cuts):
                    yield pairs(t.slice(0, int(cuts[-1])))
                    t = t.slice(int(cuts[-1]))
                held, n = [t], t.num_rows
        if n:
            yield pairs(pa.concat_tables(held))
        release()

    return rows


def _suffix_filter(percent: int):
    @F.arrow_udf("boolean")
    def passes(xn: pa.Array, xb: pa.Array, yn: pa.Array, yb: pa.Array) -> pa.Array:
        a, b = (z.to_numpy(zero_copy_only=False).astype(np.int64) for z in (xn, yn))
        return pa.array(_close(a, _table(xb), b, _table(yb), percent))

    return passes


def _links(width: int, percent: int):
    """Whether two whole texts link. Some pairs are judged at once, of ``PIECE`` bytes in all or a single one; a text that stands
    in several of them is cut into shingles once."""

    def sets(texts: pa.Array):
        known = texts.dictionary_encode()
        code, off = shingles(known.dictionary, width)
        at = known.indices.to_numpy()
        return code, off[at], off[at + 1]

    @F.arrow_udf("boolean")
    def judge(xs: pa.Array, ys: pa.Array) -> pa.Array:
        size = np.cumsum(sum(np.diff(text_bytes(z)[1]) for z in (xs, ys)))
        out, i = [], 0
        while i < len(xs):
            n = max(1, int(np.searchsorted(size, (size[i - 1] if i else 0) + PIECE, "right")) - i)
            (a, p, p2), (b, q, q2) = (sets(z.slice(i, n)) for z in (xs, ys))
            for j in range(n):
                u, v = a[p[j] : p2[j]], b[q[j] : q2[j]]
                same = len(np.intersect1d(u, v, assume_unique=True))
                out.append(bool(same and 100 * same >= percent * (len(u) + len(v) - same)))
            i += n
        release()
        return pa.array(out, pa.bool_())

    return judge


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` that may have one of ``keys`` (d, h): a Bloom filter of bounded size spares the others a shuffle."""
    hashed = keys.distinct().select(F.xxhash64("d", "h", F.lit(1)).alias("a"), F.xxhash64("d", "h", F.lit(2)).alias("b"))
    level = _level(hashed, max(1, keys.count()), 2**-6, 0, 1 << 28)
    shared = docs.sparkSession.sparkContext.broadcast(level)

    @F.arrow_udf("boolean")
    def may(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(shared.value.passes(*(z.to_numpy(zero_copy_only=False) for z in (a, b)), 0))

    return docs.filter(may(F.xxhash64("d", "h", F.lit(1)), F.xxhash64("d", "h", F.lit(2))))


def _verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Distinct pairs (xd, xh, yd, yh) of a written table, which is then deleted, with ``linked``: each is judged once, on whole
    texts."""

    def side(rows: DataFrame, s: str, *cols: str) -> DataFrame:
        return rows.select(F.col("d").alias(f"{s}d"), F.col("h").alias(f"{s}h"), *[F.col(c).alias(f"{s}{c}") for c in cols])

    ends = pairs.select(F.col("xd").alias("d"), F.col("xh").alias("h")).union(pairs.select("yd", "yh")).distinct()
    texts = written(_only(docs, ends).select("d", "h", "text").join(ends, ["d", "h"], "left_semi").dropDuplicates(["d", "h"]), "texts")
    both = pairs.join(side(texts, "x", "text"), ["xd", "xh"]).join(side(texts, "y", "text"), ["yd", "yh"])
    judged = written(both.select("xd", "xh", "yd", "yh", _links(width, percent)("xtext", "ytext").alias("linked")), "judged")
    spent(texts, pairs)
    return judged


def _sized(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs that pass the suffix filter; ``sizes`` has d, h, n, bins."""

    def side(s: str) -> DataFrame:
        return sizes.select(F.col("d").alias(f"{s}d"), F.col("h").alias(f"{s}h"), F.col("n").alias(f"{s}n"), F.col("bins").alias(f"{s}bins"))

    both = pairs.join(side("x"), ["xd", "xh"]).join(side("y"), ["yd", "yh"])
    return both.filter(_suffix_filter(percent)("xn", "xbins", "yn", "ybins")).select("xd", "xh", "yd", "yh")


def _key(d: str = "d", h: str = "h") -> Column:
    return F.struct(F.col(d).alias("d"), F.col(h).alias("h"))


def _pairs(both: DataFrame) -> DataFrame:
    """Distinct unordered pairs of keys a and b."""
    rows = both.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    return rows.select(F.col("x.d").alias("xd"), F.col("x.h").alias("xh"), F.col("y.d").alias("yd"), F.col("y.h").alias("yh"))


def _centred(shared: DataFrame, percent: int, best: Column) -> DataFrame:
    """Pairs of each row with the centre of its shingle, of rows of like and next size (``best``: the least is the centre),
    that pass the length and positional filters; with a column ``comp``, only of different components."""
    apart = "comp" in shared.columns
    # sizes of one band are within the ratio that links allow
    rows = shared.withColumns({"band": F.floor(F.log(F.col("n")) / float(np.log(100 / percent)) if percent < 100 else F.col("n")).cast("int"), "best": best})
    first = rows.groupBy("token", "band").agg(F.min("best").alias("best"))
    centre = rows.join(first, ["token", "band", "best"])
    near = F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band")
    centre = centre.select("token", near, *[F.col(c).alias(f"c{c}") for c in ("d", "h", "n", "place", *(["comp"] if apart else []))])
    both = rows.join(centre, ["token", "band"])
    least, most = F.least("n", "cn"), F.greatest("n", "cn")
    fits = (100 * least >= percent * most) & ((100 + percent) * F.least(F.col("n") - F.col("place"), F.col("cn") - F.col("cplace")) >= percent * (F.col("n") + F.col("cn")))
    fits &= F.col("comp") != F.col("ccomp") if apart else (F.col("d") != F.col("cd")) | (F.col("h") != F.col("ch"))
    return _pairs(both.filter(fits).select(_key("cd", "ch").alias("a"), _key().alias("b")))


def _linked(judged: DataFrame) -> DataFrame:
    return judged.filter("linked").select(_key("xd", "xh").alias("x"), _key("yd", "yh").alias("y"))


def _with_comps(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of shingles that classes of several components share; ``comp`` is a component as one number."""
    key = F.when(F.col("comp.h") == 0, F.col("comp.d")).otherwise(F.xxhash64("comp"))  # ids alone where those are unique
    comps = comps.select(F.col("node.d").alias("d"), F.col("node.h").alias("h"), key.alias("comp"))
    own = F.when(F.col("h") == 0, F.col("d")).otherwise(F.xxhash64(_key()))
    rows = shared.join(comps, ["d", "h"], "left").withColumn("comp", F.coalesce("comp", own))
    several = rows.groupBy("token").agg(F.count("*").alias("k"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 != c1").select("token", "k")
    return written(rows.drop("k").join(several, "token"), "apart")


def linked_groups(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``, ``d, h`` that tell rows of equal ids apart, and
    ``component``, the least (d, h) of the group, which tells groups of equal ids apart.

    A-Z are lower-cased and words parted by the six ASCII white-space characters. A set is the distinct ``width``-word
    shingles of the whole text, however long; with fewer words the whole sequence is one; null, empty and word-less texts
    have an empty set and link with nothing. Two rows link if 100 * intersection >= percent * union; ``component_id`` is
    the least id reachable by links, itself included. Equal rows and copies link as any others; a null id counts as 0 in
    ``component_id``. An empty table gives no rows; other columns, whatever their names, are dropped.
    """
    docs = keyed(docs, id_col, text_col)
    features = written(docs.select("d", "h", "text").mapInArrow(_features(width), FEATURES), "features")
    sets = features.filter("kind = 0")
    same = ["n", "s1", "s2"]
    classes = written(sets.filter("n > 0").groupBy(same).agg(F.min(_key()).alias("r")), "classes")
    slots = features.filter("kind = 1").groupBy("d").agg(F.sum("s1").alias("k")).collect()  # at most SLOTS rows
    rank = np.zeros(SLOTS, np.int64)
    for r in slots:
        rank[r.d] = r.k
    sizes = sets.select("d", "h", "n", "bins").dropDuplicates(["d", "h"])
    reps = classes.select(F.col("r.d").alias("d"), F.col("r.h").alias("h"))
    mine = docs.select("d", "h", "text").dropDuplicates(["d", "h"]) if docs.select("h").filter("h != 0").limit(1).count() else docs.select("d", "h", "text")
    mine = mine.join(reps.hint("shuffle_hash"), ["d", "h"], "left_semi").mapInArrow(_prefixes(width, percent, rank), "token long, d long, h long, n int, place int")
    mine = written(mine, "prefixes")
    several = mine.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1")
    shared = written(mine.join(several, "token"), "shared")
    spent(mine)
    # 1. the row with the fewest rarer shingles is the centre: most likely the text that others were made from
    tie = F.shiftrightunsigned(F.xxhash64("d", "h"), 32)
    judged = _verified(docs, written(_sized(_centred(shared, percent, F.shiftleft(F.col("place").cast("long"), 32) + tie), sizes, percent), "pairs"), width, percent)
    comps = components(_linked(judged))
    # 2. another centre for rows of other components
    apart = _with_comps(shared, comps)
    pair = ["xd", "xh", "yd", "yh"]
    more = _sized(_centred(apart, percent, F.xxhash64("token", "d", "h")).join(judged, pair, "left_anti"), sizes, percent)
    first, second = judged, _verified(docs, written(more, "pairs"), width, percent)
    judged = written(first.unionByName(second), "judged")
    spent(comps, first, second)
    comps = components(_linked(judged))
    # 3. all pairs of different components that the filters leave
    spent(shared)
    shared = _with_comps(apart.drop("comp"), comps)
    ahead = Window.partitionBy("d", "h").orderBy("place").rowsBetween(-BEFORE, -1)  # a text's own prefix
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    rows = shared.withColumn("before", F.collect_list("token").over(ahead)).join(sizes.drop("n"), ["d", "h"])
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("d", "h"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    rows = rows.select("token", "low", "high", "block", "d", "h", "comp", "n", "place", "bins", "before")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "token", "low", "high").sortWithinPartitions("token", "low", "high", "n")
    pairs = rows.mapInArrow(_candidates(percent), "xd long, xh long, yd long, yh long")
    pairs = _pairs(pairs.select(_key("xd", "xh").alias("a"), _key("yd", "yh").alias("b"))).join(judged, pair, "left_anti")
    rest = _verified(docs, written(pairs, "pairs"), width, percent)
    spent(comps, apart, shared)
    comps = components(_linked(judged.unionByName(rest))).select(F.col("node").alias("r"), F.col("comp"))
    spent(judged, rest)
    groups = classes.join(comps, "r", "left").select(*same, F.coalesce("comp", "r").alias("component"))
    member = sets.join(groups, same, "left").select("d", "h", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", _key()).alias("component"))
    member = member.withColumn("component_id", F.col("component.d"))
    return docs.select("d", "h", "doc_id").join(member.dropDuplicates(["d", "h"]), ["d", "h"])


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their group (by id, then text hash; one of equal
    rows). Rows whose text is null, empty or without words are no copies of anything and all stay."""
    groups = linked_groups(docs, width, percent, id_col, text_col)
    best = groups.filter("n_shingles > 0").groupBy("component").agg(F.min(_key()).alias("best"))
    own, other = free_name(docs, "__d"), free_name(docs, "__h")
    chosen = best.select(F.col("best.d").alias(own), F.col("best.h").alias(other))
    d, h, plain = row_key(docs, id_col, text_col)
    rows = docs.withColumns({own: d, other: h})
    kept = rows.join(chosen, [own, other], "left_semi")
    if not plain:
        kept = kept.dropDuplicates([own, other])
    blank = rows.filter(~F.coalesce(F.col(text_col).rlike(WORD), F.lit(False)))
    return kept.unionByName(blank).drop(own, other).select(*[f"`{c}`" for c in docs.columns])

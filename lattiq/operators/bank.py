"""Memory banks: purification, trimming, budgets, contamination and selection. Choices that were random are ranks of a
sha256 of namespace, seed and id, so they are the same everywhere."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import code, finite, ratio0
from .coreset import greedy, squares
from .order import first_n, hash_rank, percentiles, ranked
from .shared import written

#: Composition modes.
MODES = ("clean", "contaminated_all", "class_balanced_all", "oracle_purified", "auto_purified", "random_filtered", "fixed_ratio_trim")


def first_by(df: DataFrame, leads: list[Column], n: int | Column, keys: list[str] | None = None) -> DataFrame:
    """The first n rows in ascending order of ``leads``, of each key if given. Of all rows, by ranks that no task holds alone; of
    keys, by a window, whose tasks pass on n rows of a key at most."""
    if not keys:
        return first_n(df, leads, n)
    w = Window.partitionBy(*keys).orderBy(*leads)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def active(df: DataFrame) -> DataFrame:
    """Patches whose keep mask is null or true."""
    return df.filter(F.coalesce("keep", F.lit(True)))


def purify(scored: DataFrame, threshold: float | Column, score: str = "score") -> DataFrame:
    """Adds ``keep``: score <= threshold."""
    return scored.withColumn("keep", F.col(score) <= (threshold if isinstance(threshold, Column) else F.lit(threshold)))


def kept_fraction(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("keep").alias("kept"), ratio0(F.count_if("keep"), F.count("*")).alias("fraction"))


def oracle_keep(overlaps: DataFrame, threshold: float, allow_oracle: bool = False) -> DataFrame:
    """Adds ``keep``: union overlap (class 0) below the threshold. Fails closed: ground truth needs an explicit flag."""
    if not allow_oracle:
        raise PermissionError("oracle purification uses ground truth; pass allow_oracle=True")
    return overlaps.filter("class_id = 0").withColumn("keep", ~(F.col("overlap") >= threshold))


def mine_suspects(scored: DataFrame, level: float, image: str = "image_id", score: str = "score") -> DataFrame:
    """Adds ``suspected``: strictly above the image's own percentile."""
    limit = scored.groupBy(image).agg(F.percentile(score, F.lit(level / 100)).alias("__p"))
    return scored.join(limit, image).withColumn("suspected", F.col(score) > F.col("__p")).drop("__p")


def trim(scored: DataFrame, fraction: float, order: list[str], score: str = "score") -> DataFrame:
    """The round((1 - fraction) n) smallest (halves to even), ties by ``order``; ``accept_threshold`` is the last kept score."""
    n = scored.count()
    kept = first_by(scored, [F.col(c) for c in (score, *order)], int(round((1 - fraction) * n)))
    return kept.crossJoin(F.broadcast(kept.agg(F.max(score).alias("accept_threshold"))))


def random_keep(rows: DataFrame, n: int, namespace: str, seed: int, ident: str = "id") -> DataFrame:
    """n rows by hash rank (all, if fewer)."""
    return first_by(rows, [code(namespace, seed, F.col(ident)), F.col(ident)], n)


def top_distance(df: DataFrame, per_image: int, total: int | None, ident: str, image: str = "image_id", score: str = "score") -> DataFrame:
    """The most distant patches of each image, then of all."""
    rows = first_by(df, [-F.col(score), F.col(ident)], per_image, [image])
    return rows if total is None else first_by(rows, [-F.col(score), F.col(ident)], total)


def compose(clean: DataFrame, candidates: DataFrame, mode: str, *, threshold: float | None = None, fraction: float = 0.2, matched: int | None = None, seed: int = 42, per_class: int | None = None, allow_oracle: bool = False) -> DataFrame:
    """The bank of a mode: all clean rows (source ``clean``) and the kept candidates (``additional``). Both tables have ``id``,
    ``class_id``, ``score`` (distance to clean) and ``is_defect``; other columns come along."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "oracle_purified" and not allow_oracle:
        raise PermissionError("oracle purification uses ground truth; pass allow_oracle=True")
    if mode == "clean":
        more = candidates.limit(0)
    elif mode == "contaminated_all":
        more = candidates
    elif mode == "class_balanced_all":
        n = per_class if per_class is not None else min((r["count"] for r in candidates.groupBy("class_id").count().collect()), default=0)
        more = first_by(candidates, [code("balance", seed, F.col("id")), F.col("id")], n, ["class_id"])
    elif mode == "oracle_purified":
        more = candidates.filter(~F.col("is_defect"))
    elif mode == "auto_purified":
        more = candidates.filter(F.col("score") <= threshold)
    elif mode == "random_filtered":
        more = random_keep(candidates, matched if matched is not None else candidates.filter(F.col("score") <= threshold).count(), "matched", seed)
    else:
        more = trim(candidates, fraction, ["id"]).drop("accept_threshold")
    return clean.withColumn("source", F.lit("clean")).unionByName(more.withColumn("source", F.lit("additional")))


def bank_stats(clean: DataFrame, candidates: DataFrame, bank: DataFrame) -> DataFrame:
    a, b = clean.agg(F.count("*").alias("n_clean")), candidates.agg(F.count("*").alias("n_candidates"))
    c = bank.agg(F.count("*").alias("bank_size"), F.count_if(F.col("source") == "additional").alias("accepted"))
    rows = a.crossJoin(b).crossJoin(c)
    return rows.withColumn("rejected", F.col("n_candidates") - F.col("accepted")).withColumn("acceptance", ratio0(F.col("accepted"), F.col("n_candidates")))


def class_counts(bank: DataFrame) -> DataFrame:
    """Per class of a bank: rows, defect patches and images."""
    return bank.groupBy("class_id").agg(F.count("*").alias("n"), F.count_if(F.col("is_defect")).alias("defects"), F.count_distinct("image_id").alias("images"))


def contaminate_by_growth(clean: DataFrame, pool: DataFrame, rate: float, seed: int) -> DataFrame:
    """Adds max(1, min(round(rate / (1 - rate) n), available)) pool rows by hash rank (none for a rate of 0). A rate of 1 is the
    whole pool alone."""
    if rate >= 1:
        return pool.select(*clean.columns).withColumn("source", F.lit("anomalous"))
    n, have = clean.count(), pool.count()
    add = max(1, min(round(rate / (1 - rate) * n), have)) if rate > 0 and have else 0
    return clean.withColumn("source", F.lit("clean")).unionByName(random_keep(pool, add, "growth", seed).withColumn("source", F.lit("anomalous")))


def contaminate_by_replacement(clean: DataFrame, pool: DataFrame, rate: float, seed: int) -> DataFrame:
    """A bank of constant size: round(rate n) slots (by hash rank) take the vector and provenance of donors (by hash rank). There
    are no more slots than rows in the pool."""
    n, have = clean.count(), pool.count()
    slots = min(round(rate * n), have)
    first = lambda ns, rows: hash_rank(rows, ns, seed, "id").withColumnRenamed("rank", "__rank").filter(F.col("__rank") < slots)
    chosen = first("slot", clean.select("id"))
    donors = first("donor", pool).select("__rank", *[F.col(c).alias(f"__d_{c}") for c in pool.columns])
    put = clean.join(chosen.join(donors, "__rank").drop("__rank"), "id", "left")
    hit = F.col("__d_id").isNotNull()
    cols = [F.when(hit, F.col(f"__d_{c}")).otherwise(F.col(c)).alias(c) for c in clean.columns if c != "id"]
    return put.select(F.col("id").alias("slot_id"), F.coalesce("__d_id", "id").alias("id"), F.when(hit, "anomalous").otherwise("clean").alias("source"), *cols)


def dual_margin(df: DataFrame, alpha: float, normal: str = "d_n", defect: str = "d_d") -> DataFrame:
    """d_n - alpha d_d; d_n alone where there is no defect distance."""
    return df.withColumn("margin", F.coalesce(F.col(normal) - alpha * F.col(defect), F.col(normal)))


def select_anomalies(df: DataFrame, rule: str, *, level: float | None = None, per_image: int | None = None, cap: int | None = None, total: int | None = None, coreset_size: int | None = None, held_out: int | None = None, ident: str = "id", seed: int = 42, allow_oracle: bool = False) -> DataFrame:
    """Patches for an anomaly memory, from (id, image_id, class_id, overlap, score): an overlap rule (any, ratio_10, ratio_50),
    without a held-out class, above a percentile of all distances, the most distant of each image (``per_image``, then ``cap``
    of each image and class), and last either a coreset of ``coreset_size`` patches of each class (by ``features``) or a cap
    of ``total`` by hash."""
    if not allow_oracle:
        raise PermissionError("anomaly memories use ground truth; pass allow_oracle=True")
    rows = df if held_out is None else df.withColumn("overlap", F.when(F.col("class_id") == held_out, 0.0).otherwise(F.col("overlap")))
    rows = rows.filter(overlap_rule(F.col("overlap"), rule))
    if level is not None:
        gate = percentiles(df, "score", [level / 100]).select(F.get("ps", F.lit(0)).alias("__g"))
        rows = rows.crossJoin(F.broadcast(gate)).filter(F.col("score") >= F.col("__g")).drop("__g")
    if per_image is not None:
        rows = top_distance(rows, per_image, None, ident)
    if cap is not None:
        rows = first_by(rows, [-F.col("score"), F.col(ident)], cap, ["image_id", "class_id"])
    if coreset_size is not None:
        rows = written(rows, "anomalies")  # the choice reads them in rounds
        chosen = coreset(rows.withColumnRenamed(ident, "id") if ident != "id" else rows, coreset_size, seed, ("class_id",))
        return rows.join(chosen.select(F.col("id").alias(ident)), ident, "left_semi")
    return rows if total is None else random_keep(rows, total, "cap", seed, ident)


def overlap_rule(overlap: Column, rule: str) -> Column:
    return {"any": overlap > 0, "ratio_10": overlap >= 0.10, "ratio_50": overlap >= 0.50}[rule]


def overlap_counts(df: DataFrame, threshold: float, keys: tuple[str, ...] = (), overlap: str = "overlap") -> DataFrame:
    """How many known overlaps are above the threshold (``above``) and at or above it (``reached``), of how many (``n``)."""
    o = F.col(overlap)
    return df.groupBy(*keys).agg(F.count(o).alias("n"), F.count_if(o > threshold).alias("above"), F.count_if(o >= threshold).alias("reached"))


def rejection_quality(df: DataFrame, truth: Column, rejected: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Normal retention, anomaly rejection recall, rejected precision and final contamination, 0 on zero denominators."""
    t, r = truth, rejected
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(t).alias("n_anomalous"), F.count_if(~t).alias("n_normal"), F.count_if(r).alias("n_rejected"), F.count_if(~r).alias("n_kept"),
        F.count_if(t & r).alias("anomalous_rejected"), F.count_if(t & ~r).alias("anomalous_kept"), F.count_if(~t & r).alias("normal_rejected"), F.count_if(~t & ~r).alias("normal_kept"),
    )
    c = F.col
    return counts.withColumns(
        {
            "normal_retention": ratio0(c("normal_kept"), c("n_normal")), "anomaly_recall": ratio0(c("anomalous_rejected"), c("n_anomalous")),
            "rejected_precision": ratio0(c("anomalous_rejected"), c("n_rejected")), "contamination": ratio0(c("anomalous_kept"), c("n_kept")),
        }
    )


def overlap_distribution(df: DataFrame, bins: int = 10, overlap: str = "overlap") -> DataFrame:
    """Histogram of positive overlaps in equal bins of 0 to 1, the last one closed."""
    rows = df.filter(F.col(overlap) > 0)
    return rows.groupBy(F.least(F.floor(F.col(overlap) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


#: Percentiles of positive overlaps in a report.
OVERLAP_LEVELS = (0.0, 1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 90.0, 95.0, 99.0, 100.0)


def overlap_quantiles(df: DataFrame, levels: Sequence[float] = OVERLAP_LEVELS, overlap: str = "overlap") -> DataFrame:
    """One row: how many overlaps are positive, and their percentiles as a map (null without any)."""
    rows = df.filter((F.col(overlap) > 0) & finite(F.col(overlap)).isNotNull())
    names = F.array(*[F.lit(f"p{q:g}") for q in levels])
    ps = percentiles(rows, overlap, [q / 100 for q in levels]).select(F.map_from_arrays(names, "ps").alias("quantiles"))
    return rows.agg(F.count("*").alias("n_positive")).crossJoin(F.broadcast(ps))


def keep_mask(rows: DataFrame, chosen: DataFrame, ident: str = "id") -> DataFrame:
    """``rows`` with ``keep``: whether the id is among the chosen; chosen ids that no row has are an error."""
    picked = chosen.select(ident).distinct()
    if not picked.join(rows.select(ident), ident, "left_anti").isEmpty():
        raise ValueError("chosen ids are out of bounds")
    return rows.join(picked.withColumn("keep", F.lit(True)), ident, "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def coreset_by_ratio(bank: DataFrame, ratio: float, seed: int = 42, total: int | None = None) -> DataFrame:
    """The rows of a coreset of max(1, int(ratio n)) rows, and of ``total`` at most; the start is drawn by the seed. A ratio of 0
    or less, or of 1 or more, keeps all (up to the cap)."""
    n = bank.count()
    k = n if not 0 < ratio < 1 else max(1, int(n * ratio))
    k = k if total is None else min(k, total)
    if not n or k >= n:
        return bank
    return bank.join(coreset(bank, k, seed % n).select("id"), "id", "left_semi")


def coreset(bank: DataFrame, k: int, start: int = 0, keys: tuple[str, ...] = (), one_task: int = 100_000) -> DataFrame:
    """``id`` and ``pick``: greedy farthest points, in order, from the row of rank ``start`` by id (distinct longs), ties to smaller
    ids; of each group of ``keys`` if given. Rows without a vector don't take part; fewer rows than ``k`` are all picked.

    A bank of any size goes in rounds over blocks (``coreset.greedy``), and so does each group of over ``one_task`` rows, one
    group after the other; smaller groups are a task each."""
    spark = bank.sparkSession
    rows = bank.filter("id IS NOT NULL AND features IS NOT NULL").select(*keys, "id", "features")
    kinds = [f"{c} {dict(bank.dtypes)[c]}" for c in keys]

    def whole(part: DataFrame, of: tuple = ()) -> DataFrame:
        ids = part.select("id")
        n = ids.count() if start else 1
        if not start:
            first = ids.agg(F.min("id")).first()[0]
        else:
            first = ranked(ids, [F.col("id")]).filter(F.col("rank") == start % max(n, 1)).select("id").first()
            first = first[0] if first else None
        picked = greedy(part.select("id", "features"), k, first)[0] if first is not None and k > 0 else []
        return spark.createDataFrame([(*of, i, n) for n, i in enumerate(picked)], ", ".join([*kinds, "id long", "pick int"]))

    if not keys:
        return whole(rows)
    sizes = rows.groupBy(*keys).count()
    large = [tuple(r)[:-1] for r in sizes.filter(F.col("count") > one_task).collect()]  # one at most for each one_task rows

    def pick(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        ids = table.column("id").to_numpy()
        x = table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
        least, out, at = np.full(len(ids), np.inf), [], start % len(ids)
        for _ in range(min(k, len(ids))):
            out.append(at)
            np.minimum(least, squares(x, x[at]), out=least)
            least[at] = -1.0
            at = int(least.argmax())
        return pa.table({"id": ids[out], "pick": np.arange(len(out), dtype=np.int32), **{c: table.column(c).take(pa.array(out)) for c in keys}})

    same = lambda values: [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(keys, values)]
    others = rows
    for values in large:
        others = others.filter(~np.logical_and.reduce(same(values)))
    found = others.groupBy(*keys).applyInArrow(pick, ", ".join(["id long", "pick int", *kinds]))
    for values in large:
        found = found.unionByName(whole(rows.filter(np.logical_and.reduce(same(values))), values))
    return found

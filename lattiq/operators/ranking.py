"""Ranking and confusion metrics. Scores are collapsed to distinct values first; running sums over them go in two steps, by
ranges of scores and inside each range, so that no task holds all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import f1_of, finite, ratio, ratio0
from .order import cumulated, percentiles, with_previous, with_ranges


def usable(df: DataFrame, score: str = "score", valid: str | None = None) -> DataFrame:
    """Rows with a finite score, of the valid mask if there is one."""
    rows = df.filter(finite(F.col(score)).isNotNull())
    return rows.filter(F.col(valid)) if valid else rows


def confusion(df: DataFrame, truth: Column, pred: Column, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(truth & pred).alias("tp"), F.count_if(~truth & pred).alias("fp"), F.count_if(truth & ~pred).alias("fn"), F.count_if(~truth & ~pred).alias("tn")
    )


def with_prf(counts: DataFrame, zero: bool = False) -> DataFrame:
    """Precision, recall and F1; on a zero denominator null, or 0 with ``zero``."""
    r = ratio0 if zero else ratio
    rows = counts.withColumn("precision", r(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", r(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = f1_of(F.col("precision"), F.col("recall"))
    return rows.withColumn("f1", F.coalesce(f1, F.lit(0.0)) if zero else f1)


def grouped_prf(df: DataFrame, truth: Column, pred: Column, group: str, overall: int) -> DataFrame:
    """Metrics of all rows (``group`` = ``overall``) and of each group, in one pass."""
    rows = df.select(F.explode(F.array(F.lit(overall), F.col(group).cast("int"))).alias(group), truth.alias("__t"), pred.alias("__p"))
    return with_prf(confusion(rows, F.col("__t"), F.col("__p"), [group]))


def macro(per_image: DataFrame, metrics: Sequence[str] = ("precision", "recall", "f1")) -> DataFrame:
    """Means over images of the known values."""
    return per_image.agg(*[F.avg(finite(F.col(m))).alias(m) for m in metrics])


def score_groups(df: DataFrame, score: str = "score", label: str = "is_defect", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, score, pos, neg) with one row per distinct score."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))


def running(df: DataFrame, order: str, sums: dict[str, str], keys: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """Adds running sums (name -> column) in order of ``order``, whose values are distinct within ``keys``."""
    lead = -F.col(order) if descending else F.col(order)
    return cumulated(with_ranges(df, lead), "__part", [lead], {n: F.col(c) for n, c in sums.items()}, keys).drop("__part")


def with_totals(rows: DataFrame, groups: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds the totals of each key (tot_p, tot_n)."""
    totals = groups.groupBy(*keys).agg(F.sum("pos").alias("tot_p"), F.sum("neg").alias("tot_n"))
    return rows.join(totals, list(keys)) if keys else rows.crossJoin(F.broadcast(totals))


def curve_of(groups: DataFrame, keys: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """``curve`` from ``score_groups``."""
    return with_totals(running(groups, "score", {"tp": "pos", "fp": "neg"}, keys, descending), groups, keys)


def curve(df: DataFrame, score: str = "score", label: str = "is_defect", keys: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """One row per distinct score: counts at or above it (or below, if not ``descending``) as tp and fp, and totals."""
    return curve_of(score_groups(df, score, label, keys), keys, descending)


def ranking_of(groups: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``ranking`` from ``score_groups``."""
    c = curve_of(groups, keys)
    tp, fp, p, n = (F.col(x).cast("double") for x in ("tp", "fp", "tot_p", "tot_n"))
    f1 = F.coalesce(2 * tp / F.nullif(2 * tp + fp + p - tp, F.lit(0.0)), F.lit(0.0))
    return c.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("neg") * (tp - F.col("pos") + F.col("pos") / 2.0)), F.max(p * n)).alias("auroc"),
        F.try_divide(F.sum(F.col("pos") * tp / (tp + fp)), F.max(p)).alias("average_precision"),
        F.max(f1).alias("f1_max"),
        F.max_by("score", F.struct(f1.alias("f"), F.col("score"))).alias("f1_threshold"),
        F.max("tot_p").alias("n_pos"),
        F.max("tot_n").alias("n_neg"),
    )


def ranking(df: DataFrame, score: str = "score", label: str = "is_defect", keys: Sequence[str] = ()) -> DataFrame:
    """AUROC (ties count half; null with one class), average precision (ties grouped), exact F1-max with its threshold (the
    highest of equals) and counts, in one pass over the curve."""
    return ranking_of(score_groups(df, score, label, keys), keys)


def threshold_grid(df: DataFrame, score: str = "score", n: int = 80) -> DataFrame:
    """Distinct default thresholds: exact percentiles at max(n / 2, 20) even steps and n even steps from least to largest.
    Constant scores give one threshold, no scores the even steps of 0 to 1."""
    q = max(n // 2, 20)
    facts = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).crossJoin(F.broadcast(percentiles(df, score, [i / (q - 1) for i in range(q)])))
    even = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.col("lo"), F.lit(0.0)) + (F.coalesce(F.col("hi"), F.lit(1.0)) - F.coalesce(F.col("lo"), F.lit(0.0))) * i / float(n - 1))
    grid = F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array_union(F.coalesce("ps", F.array().cast("array<double>")), even))
    return facts.select(F.explode(grid).alias("threshold")).distinct()


def sweep(df: DataFrame, thresholds: DataFrame, score: str = "score", label: str = "is_defect") -> DataFrame:
    """Confusion counts and P, R, F1 with predictions ``score >= threshold`` for each threshold (a bounded list).

    Each distinct score falls into the range below its next threshold; ranges are summed once and then cumulated.
    """
    limits = sorted(r[0] for r in thresholds.select("threshold").distinct().collect())
    cuts = F.array(*[F.lit(float(t)) for t in limits])
    part = F.size(F.filter(cuts, lambda t: t <= F.col("score")))  # thresholds at or below the score
    sums = score_groups(df, score, label).groupBy(part.alias("i")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    spark = df.sparkSession
    frame = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(limits)], "i int, threshold double")
    joined = frame.unionByName(spark.createDataFrame([(0, None)], "i int, threshold double")).join(sums, "i", "left").fillna(0, ["pos", "neg"])
    up = Window.orderBy(F.desc("i"))
    every = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = joined.select("threshold", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.sum("pos").over(every).alias("P"), F.sum("neg").over(every).alias("N"))
    counts = rows.filter("threshold IS NOT NULL").select("threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"))
    return with_prf(counts)


def grid_f1(rows: DataFrame) -> DataFrame:
    """The lowest threshold of the highest known F1."""
    return rows.filter("f1 IS NOT NULL").agg(F.min_by("threshold", F.struct(-F.col("f1"), F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def recall_at(rows: DataFrame, target: float) -> DataFrame:
    """The lowest threshold with enough recall (as practised), and the highest such one (as documented); the threshold of
    largest recall if none has enough."""
    best = F.min_by("threshold", F.struct(-F.coalesce("recall", F.lit(-1.0)), F.col("threshold")))
    ok = F.when(F.col("recall") >= target, F.col("threshold"))
    return rows.agg(F.coalesce(F.min(ok), best).alias("threshold"), F.coalesce(F.max(ok), best).alias("max_threshold"))


def probability_sweep(df: DataFrame, score: str = "score", label: str = "is_defect", steps: int = 101, start: float = 0.5) -> DataFrame:
    """The best of even thresholds in 0 to 1; ``start`` stays unless one is strictly better, the first of equals."""
    spark = df.sparkSession
    grid = spark.range(steps).select((F.col("id") / float(steps - 1)).alias("threshold")).union(spark.createDataFrame([(start,)], "threshold double"))
    rows = sweep(df, grid, score, label).withColumn("f1", F.coalesce("f1", F.lit(0.0)))
    return rows.agg(F.min_by("threshold", F.struct(-F.col("f1"), (F.col("threshold") != start).cast("int"), F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def fixed_threshold(df: DataFrame, threshold: float | Column, score: str = "score", label: str = "is_defect") -> DataFrame:
    """P, R, F1 at a given threshold, 0 on zero denominators, with positives and predicted positives."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    rows = with_prf(confusion(df, F.col(label), F.col(score) >= limit), zero=True)
    return rows.withColumn("n_gt_pos", F.col("tp") + F.col("fn")).withColumn("n_pred_pos", F.col("tp") + F.col("fp"))


def cohens_d(df: DataFrame, score: str = "score", label: str = "is_defect", keys: Sequence[str] = ()) -> DataFrame:
    """Cohen's d by the pooled sample variance; null below two values a side."""
    v, d = F.col(score), F.col(label)
    a, b = F.when(d, v), F.when(~d, v)
    pooled = ((F.count(a) - 1) * F.var_samp(a) + (F.count(b) - 1) * F.var_samp(b)) / (F.count(a) + F.count(b) - 2)
    return df.groupBy(*keys).agg(F.when((F.count(a) >= 2) & (F.count(b) >= 2) & (pooled > 0), (F.avg(a) - F.avg(b)) / F.sqrt(pooled)).alias("cohens_d"))


def gaps(df: DataFrame, score: str = "score", label: str = "is_defect", keys: Sequence[str] = ()) -> DataFrame:
    """KS statistic, 1-D Wasserstein distance and AUROC, from one curve."""
    rows = curve(df, score, label, keys, descending=False)
    gap = lambda p, n: F.abs(ratio(p, F.col("tot_p")) - ratio(n, F.col("tot_n")))
    rows = rows.withColumns({"gap": gap(F.col("tp"), F.col("fp")), "before": gap(F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg"))})
    # the integral of the gap by parts: each value's share of it needs no neighbour
    pairs = F.col("pos") * (F.col("fp") - F.col("neg") + F.col("neg") / 2.0)  # negatives below, ties half
    return rows.groupBy(*keys).agg(
        F.max("gap").alias("ks"),
        F.sum(F.col("score") * (F.col("before") - F.col("gap"))).alias("wasserstein"),
        F.try_divide(F.sum(pairs), F.max(F.col("tot_p").cast("double") * F.col("tot_n"))).alias("auroc"),
    )


def separability(df: DataFrame, score: str = "score", label: str = "is_defect", keys: Sequence[str] = ()) -> DataFrame:
    """Cohen's d, KS statistic, Wasserstein distance and AUROC of the two labels."""
    facts, dist = cohens_d(df, score, label, keys), gaps(df, score, label, keys)
    return facts.join(dist, list(keys)) if keys else facts.crossJoin(dist)


def distribution(df: DataFrame, score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, population std, median, range and exact 5th and 95th percentiles; null when empty."""
    s = F.col(score)
    facts = df.groupBy(*keys).agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"))
    cuts = percentiles(df, score, [0.5, 0.05, 0.95], keys).select(*keys, *[F.get("ps", F.lit(i)).alias(n) for i, n in enumerate(("median", "p5", "p95"))])
    rows = facts.join(cuts, list(keys)) if keys else facts.crossJoin(F.broadcast(cuts))
    return rows.select(*keys, "n", "mean", "std", "median", "min", "max", "p5", "p95")


#: Levels of the quantile map of a calibration report.
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.995)


def quantile_map(df: DataFrame, score: str = "score", levels: Sequence[float] = QUANTILES) -> DataFrame:
    names = F.array(*[F.lit(f"p{100 * q:g}") for q in levels])
    return percentiles(df, score, levels).select(F.map_from_arrays(names, "ps").alias("quantiles"))


def _area(steps: DataFrame, x_max: float) -> DataFrame:
    """Trapezoids of steps from (x0, y0) to (x1, y1) up to ``x_max``, the last one interpolated, over ``x_max``."""
    inside = F.least(F.col("x1"), F.lit(x_max))
    y_in = F.when(F.col("x1") <= x_max, F.col("y1")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (x_max - F.col("x0")) / (F.col("x1") - F.col("x0")))
    rows = steps.filter(F.col("x0").isNotNull() & (F.col("x0") < x_max))
    return rows.agg((F.sum((inside - F.col("x0")) * (F.col("y0") + y_in) / 2) / x_max).alias("area"))


def truncated_area(points: DataFrame, x: str, y: str, x_max: float) -> DataFrame:
    """Trapezoid area under a curve up to ``x_max``, with the last segment interpolated, over ``x_max``."""
    rows = points.select(F.col(x).alias("x1"), F.col(y).alias("y1"))
    return _area(with_previous(rows, ["x1", "y1"], {"x0": "x1", "y0": "y1"}), x_max)


def _pro_steps(pixels: DataFrame, score: str, region: str) -> DataFrame:
    """The steps of ``pro_curve``, a row per distinct score: the point after it (``fpr``, ``pro``) and the one before (``x0``, ``y0``)."""
    sizes = pixels.filter(F.col(region).isNotNull()).groupBy(region).agg(F.count("*").alias("__size"))
    rows = pixels.join(sizes, region, "left")
    groups = rows.groupBy(F.col(score).alias("score")).agg(F.coalesce(F.sum(1.0 / F.col("__size")), F.lit(0.0)).alias("gain"), F.count_if(F.col(region).isNull()).alias("ok"))
    totals = sizes.agg(F.count("*").alias("regions")).crossJoin(pixels.agg(F.count_if(F.col(region).isNull()).alias("oks")))
    cum = running(groups, "score", {"cum_gain": "gain", "cum_ok": "ok"}).crossJoin(F.broadcast(totals))
    part = lambda a, b: F.least(ratio0(a, F.col(b)), F.lit(1.0))
    gain, ok = F.col("cum_gain"), F.col("cum_ok")
    return cum.select(part(ok, "oks").alias("fpr"), part(gain, "regions").alias("pro"), part(ok - F.col("ok"), "oks").alias("x0"), part(gain - F.col("gain"), "regions").alias("y0"))


def pro_curve(pixels: DataFrame, score: str = "score", region: str = "region") -> DataFrame:
    """False-positive rate against mean region overlap: a pixel of a region counts 1 / its size, one without counts as ok.
    One point per distinct score, clipped at 1, with (0, 0) and (1, 1)."""
    steps = _pro_steps(pixels, score, region).select("fpr", "pro")
    return steps.union(pixels.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "fpr double, pro double"))


def pro_area(pixels: DataFrame, x_max: float = 0.3, score: str = "score", region: str = "region") -> DataFrame:
    """``truncated_area`` of ``pro_curve``: each distinct score knows its own step, so no row needs its neighbour."""
    steps = _pro_steps(pixels, score, region)
    last = steps.agg(F.max("fpr").alias("x0"), F.max("pro").alias("y0")).select(F.lit(1.0).alias("fpr"), F.lit(1.0).alias("pro"), F.coalesce("x0", F.lit(0.0)).alias("x0"), F.coalesce("y0", F.lit(0.0)).alias("y0"))
    steps = steps.union(last).select(F.col("fpr").alias("x1"), F.col("pro").alias("y1"), "x0", "y0")
    return _area(steps, x_max)


def image_scores(df: DataFrame, image: str = "image_id", score: str = "score", label: str = "is_defect", share: float = 0.01) -> DataFrame:
    """Per image: mean of the top ``share`` of patches (the largest alone if that is none), largest, and any(label)."""
    size = F.count("*").over(Window.partitionBy(image))
    rank = F.row_number().over(Window.partitionBy(image).orderBy(F.desc(score)))
    top = F.greatest(F.floor(size * share), F.lit(1))
    rows = df.withColumn("__top", rank <= top)
    return rows.groupBy(image).agg(F.avg(F.when(F.col("__top"), F.col(score))).alias("top_mean"), F.max(score).alias("top"), F.bool_or(label).alias(label))


def polarity(df: DataFrame, score: str = "score", label: str = "is_defect") -> DataFrame:
    """One row: the mean scores of either label, and whether defects score at least as high; null without one of them."""
    a, b = F.avg(F.when(F.col(label), F.col(score))), F.avg(F.when(~F.col(label), F.col(score)))
    return df.agg(a.alias("positive"), b.alias("negative"), (a >= b).alias("ok"))


def overlap_metrics(counts: DataFrame) -> DataFrame:
    """IoU and Dice from tp, fp, fn; null where both masks are empty."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("iou", ratio(tp, tp + fp + fn)).withColumn("dice", ratio(2 * tp, 2 * tp + fp + fn))

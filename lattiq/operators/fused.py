"""Detectors of several branches, and those that use class tokens or attention. Attention comes as a table (image_id, layer, head,
q, k, w) whose first token is the class token, class tokens as a table (image_id, cls)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cosine, doubles
from . import grid
from .calibration import score_mode, stats
from .detectors import KEYS, Detector, IsolationForest, KnnBank, ensemble, fuse


def cls_rollout(attention: DataFrame, width: int, heads: str = "mean", last_layers: int | None = None, discard: float = 0.0, residual: bool = True) -> DataFrame:
    """(image_id, row, col, score): the class token's weights after rollout over the last layers (all, if None)."""
    rows = attention
    if last_layers is not None:
        top = rows.groupBy("image_id").agg(F.max("layer").alias("__top"))
        rows = rows.join(top, "image_id").filter(F.col("layer") > F.col("__top") - last_layers).drop("__top")
    if "head" in rows.columns:
        rows = grid.reduce_heads(rows, heads)
    return grid.cls_row(grid.rollout(rows, discard, residual), width)


class Calibrated(Detector):
    """Scores of ``_raw``, as z-scores of the reference's where there is one."""

    facts: DataFrame | None = None

    def _raw(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit(self, reference: DataFrame | None) -> Detector:
        self.facts = None if reference is None or reference.isEmpty() else stats(self._raw(reference))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rows = score_mode(self._raw(df), "zscore" if self.facts is not None else "raw", self.facts)
        return rows.select(*KEYS, F.col("mode_score").alias("score"))


class AttentionRollout(Calibrated):
    """The class token's attention; zero-shot without a reference."""

    def __init__(self, attention: DataFrame, width: int, **how):
        self.maps = cls_rollout(attention, width, **how)

    def _raw(self, df: DataFrame) -> DataFrame:
        return df.select(*KEYS).join(self.maps, ["image_id", "row", "col"]).select(*KEYS, "score")


class ClsCosine(Calibrated):
    """``per_image``: cosine of each patch with its image's class token. ``prototype``: 1 - cosine with the mean class token of
    the reference, which it needs."""

    def __init__(self, tokens: DataFrame, mode: str = "per_image"):
        if mode not in ("per_image", "prototype"):
            raise ValueError(f"unknown mode {mode}")
        self.tokens, self.mode = tokens.select("image_id", doubles(F.col("cls")).alias("cls")), mode

    def fit(self, reference: DataFrame | None) -> Detector:
        if self.mode == "prototype":
            if reference is None or reference.isEmpty():
                raise ValueError("a prototype needs reference images")
            own = self.tokens.join(reference.select("image_id").distinct(), "image_id", "left_semi")
            self.proto = grid.mean_vector(own.withColumnRenamed("cls", "features"))
        return super().fit(reference)

    def _raw(self, df: DataFrame) -> DataFrame:
        if self.mode == "prototype":
            return df.crossJoin(F.broadcast(self.proto)).select(*KEYS, (1.0 - cosine(F.col("features"), F.col("prototype"))).alias("score"))
        return df.join(self.tokens, "image_id").select(*KEYS, cosine(F.col("features"), F.col("cls")).alias("score"))


class WithRollout(Detector):
    """A detector of vectors fused with how far the class token's attention is from the reference's in the same cell. With
    ``neighbours``, vectors are first means over windows of 3 x 3."""

    def __init__(self, branch: Detector, attention: DataFrame, width: int, height: int, how: str = "weighted_sum", weights: tuple[float, float] = (0.5, 0.5), neighbours: bool = False, **rollout):
        if sum(weights) <= 0:
            raise ValueError("weights must have a positive sum")
        self.branch, self.width, self.height, self.how, self.neighbours = branch, width, height, how, neighbours
        self.weight, self.maps = weights[0] / sum(weights), cls_rollout(attention, width, **rollout)

    def _rows(self, df: DataFrame) -> DataFrame:
        if not self.neighbours:
            return df
        means = grid.neighbour_mean(df, self.height, self.width)
        return df.drop("features").join(means, ["image_id", "row", "col"])

    def fit(self, reference: DataFrame) -> Detector:
        if reference.isEmpty():
            raise ValueError("the fused detector needs reference images")
        self.branch.fit(self._rows(reference))
        self.cells = grid.cell_stats(self.maps.join(reference.select("image_id").distinct(), "image_id", "left_semi"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        away = grid.cell_deviation(df.select(*KEYS).join(self.maps, ["image_id", "row", "col"]), self.cells).select("id", "image_id", F.col("deviation").alias("score"))
        fused = fuse(self.branch.transform(self._rows(df)), away, self.how, self.weight)
        return df.select(*KEYS).join(fused.select("id", "score"), "id")


def knn_rollout(attention: DataFrame, width: int, height: int, k: int = 1, metric: str = "cosine", coreset_ratio: float | None = None, **how) -> WithRollout:
    return WithRollout(KnnBank(k, metric, ratio=coreset_ratio), attention, width, height, **how)


def forest_rollout(attention: DataFrame, width: int, height: int, trees: int = 200, sample: int = 256, seed: int = 42, **how) -> WithRollout:
    return WithRollout(IsolationForest(trees, sample, seed), attention, width, height, **how)


class Ensemble(Detector):
    """Weighted sum of the members' per-image z-scores, weights over their sum (equal, if not given)."""

    def __init__(self, members: Sequence[Detector], weights: Sequence[float] | None = None):
        if not members:
            raise ValueError("an ensemble needs members")
        if weights is not None and len(weights) != len(members):
            raise ValueError("as many weights as members")
        self.members, self.weights = list(members), list(weights or [1.0] * len(members))

    def fit(self, reference: DataFrame) -> Detector:
        for m in self.members:
            m.fit(reference)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        total = ensemble([(m.transform(df), w) for m, w in zip(self.members, self.weights)])
        return df.select(*KEYS).join(total.select("id", "score"), "id")


def joined_layers(layers: Sequence[DataFrame]) -> DataFrame:
    """Tables of several layers as one, with the vectors of a patch one after the other."""
    out = layers[0]
    for i, more in enumerate(layers[1:]):
        out = out.join(more.select("id", F.col("features").alias(f"__f{i}")), "id").withColumn("features", F.concat("features", f"__f{i}")).drop(f"__f{i}")
    return out


class Reduced:
    """Principal components of a reference, by the covariance that Spark sums over all rows; ``whiten`` scales them to unit
    variance, ``standardise`` takes off their mean and divides by their deviation."""

    def __init__(self, components: int, whiten: bool = False):
        self.components, self.whiten = components, whiten

    def fit(self, reference: DataFrame) -> Reduced:
        from pyspark.ml.feature import PCA
        from pyspark.ml.functions import array_to_vector

        rows = reference.select(array_to_vector(doubles(F.col("features"))).alias("x"))
        size, n = reference.select(F.size("features")).first()[0], rows.count()
        model = PCA(k=min(self.components, size, n), inputCol="x", outputCol="y").fit(rows)
        self.axes = model.pc.toArray().T
        mean = grid.mean_vector(reference.select("features")).first().prototype
        self.shift = [float(sum(a * m for a, m in zip(axis, mean))) for axis in self.axes]
        self.scale = [1.0] * len(self.axes)
        if self.whiten:
            z = self.transform(reference)
            spread = z.select(*[F.stddev_samp(F.get("features", F.lit(i))).alias(f"s{i}") for i in range(len(self.axes))]).first()
            self.scale = [s if s else 1.0 for s in spread]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        def value(axis, shift, scale):
            weights = F.array(*[F.lit(float(a)) for a in axis])
            return (F.aggregate(F.zip_with("features", weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) - F.lit(shift)) / F.lit(scale)

        return df.withColumn("features", F.array(*[value(*p) for p in zip(self.axes, self.shift, self.scale)]))


class ReducedMahalanobis(Detector):
    """Diagonal Mahalanobis distance per grid cell, on principal components of the reference's vectors (their own space, if they
    have no more than ``components`` dimensions)."""

    def __init__(self, components: int | None = 50, neighbours: tuple[int, int] | None = None):
        self.components, self.neighbours = components, neighbours

    def _rows(self, df: DataFrame) -> DataFrame:
        if self.neighbours:
            df = df.drop("features").join(grid.neighbour_mean(df, *self.neighbours), ["image_id", "row", "col"])
        return self.reduced.transform(df) if self.reduced else df

    def fit(self, reference: DataFrame) -> Detector:
        first = reference.select(F.size("features").alias("n")).first()
        if first is None:
            raise ValueError("the distance needs reference images")
        self.reduced = None
        rows = self._rows(reference)
        if self.components is not None and self.components < first.n:
            self.reduced = Reduced(self.components).fit(rows)
        self.reference = self._rows(reference)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return grid.mahalanobis(self._rows(df), self.reference, KEYS)


class BranchForest(Detector):
    """An isolation forest over the principal components of two branches, such as vectors of images and of their gradients
    (columns ``features`` and ``other``); patches whose ``keep`` is false score 0."""

    def __init__(self, components: int = 16, whiten: bool = False, standardise: bool = True, other: str = "other", **forest):
        self.first, self.second = Reduced(components, whiten), Reduced(components, whiten)
        self.other, self.forest = other, IsolationForest(standardise=standardise, **forest)

    def _second(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", F.col(self.other))

    def _rows(self, df: DataFrame) -> DataFrame:
        own = self.first.transform(df).withColumn("__own", F.col("features"))
        return self.second.transform(self._second(own)).withColumn("features", F.concat("features", "__own")).drop("__own")

    def fit(self, reference: DataFrame) -> Detector:
        rows = reference.filter(F.coalesce("keep", F.lit(True))) if "keep" in reference.columns else reference
        self.first.fit(rows)
        self.second.fit(self._second(rows))
        self.forest.fit(self._rows(rows))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        found = self.forest.transform(self._rows(df))
        if "keep" not in df.columns:
            return found
        return found.join(df.select("id", "keep"), "id").withColumn("score", F.when(F.coalesce("keep", F.lit(True)), F.col("score")).otherwise(0.0)).drop("keep")

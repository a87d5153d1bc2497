"""Detectors: ``fit(reference) -> model``, ``transform(df) -> scores``. Tables have (id, image_id, row, col, features); scores add
``score``, higher for more anomalous. A registry names them."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cosine, doubles, norm
from . import bank as banks
from . import grid
from .calibration import score_mode, stats, z_score
from .knn import knn_scores
from .ranking import probability_sweep

KEYS = ("id", "image_id", "row", "col")


class Detector(ABC):
    """A fitted detector scores tables; ``supports_class`` says if scores are per defect class."""

    supports_class = False

    @abstractmethod
    def fit(self, reference: DataFrame) -> Detector: ...

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...

    def _joined(self, df: DataFrame, found: DataFrame) -> DataFrame:
        return df.select(*KEYS).join(found, "id")


class KnnBank(Detector):
    """Distance to a memory bank; masked-out patches (keep = false) score 0. A budget is by farthest points or by hash."""

    def __init__(self, k: int = 1, metric: str = "cosine", budget: int | None = None, coreset: bool = False, seed: int = 42, ratio: float | None = None):
        self.k, self.metric, self.budget, self.coreset, self.seed, self.ratio = k, metric, budget, coreset, seed, ratio

    def fit(self, reference: DataFrame) -> KnnBank:
        rows = banks.active(reference) if "keep" in reference.columns else reference
        if self.budget is not None:
            chosen = banks.coreset(rows, self.budget).select("id") if self.coreset else banks.random_keep(rows, self.budget, "budget", self.seed).select("id")
            rows = rows.join(chosen, "id", "left_semi")
        if self.ratio is not None:
            rows = banks.coreset_by_ratio(rows, self.ratio, self.seed)
        self.bank = rows.select("id", "features")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rows = banks.active(df) if "keep" in df.columns else df
        found = knn_scores(rows.select("id", "features"), self.bank, self.k, self.metric).withColumnRenamed("query_id", "id")
        return df.select(*KEYS).join(found, "id", "left").fillna(0.0, ["score"])


class Prototype(Detector):
    """1 - cosine to the mean reference vector, optionally calibrated on the reference."""

    def __init__(self, mode: str = "raw"):
        self.mode = mode

    def _raw(self, df: DataFrame) -> DataFrame:
        return df.crossJoin(F.broadcast(self.proto)).select(*KEYS, (1.0 - cosine(F.col("features"), F.col("prototype"))).alias("score"))

    def fit(self, reference: DataFrame) -> Prototype:
        self.proto = grid.mean_vector(reference)
        self.facts = stats(self._raw(reference))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rows = score_mode(self._raw(df), self.mode, self.facts if self.mode == "zscore" else None)
        return rows.select(*KEYS, F.col("mode_score").alias("score"))


class VectorNorm(Detector):
    def fit(self, reference: DataFrame) -> VectorNorm:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*KEYS, norm(F.col("features")).alias("score"))


class Mahalanobis(Detector):
    """Diagonal, per grid cell."""

    def fit(self, reference: DataFrame) -> Mahalanobis:
        self.reference = reference
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return grid.mahalanobis(df, self.reference, KEYS)


class Sobel(Detector):
    """Gradient of the feature grid under a score mode, calibrated on the reference."""

    def __init__(self, reduce: str = "l2", mode: str = "raw"):
        self.reduce, self.mode = reduce, mode

    def fit(self, reference: DataFrame) -> Sobel:
        self.facts = stats(grid.sobel_norm(reference, self.reduce))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rows = score_mode(grid.sobel_norm(df, self.reduce), self.mode, self.facts)
        return df.select(*KEYS).join(rows.select("image_id", "row", "col", F.col("mode_score").alias("score")), ["image_id", "row", "col"]).select(*KEYS, "score")


class IsolationForest(Detector):
    """Trees over hash-drawn samples, 2^(-mean depth / c); trees are small and broadcast."""

    def __init__(self, trees: int = 64, sample: int = 256, seed: int = 42, components: int | None = None, standardise: bool = False):
        self.trees, self.sample, self.seed, self.components, self.standardise = trees, sample, seed, components, standardise

    def fit(self, reference: DataFrame) -> IsolationForest:
        drawn = banks.random_keep(reference, self.trees * self.sample, "forest", self.seed).orderBy("id").select("features").toArrow().combine_chunks()
        x = drawn.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(drawn.num_rows, -1)
        self.center, self.axes = np.zeros(x.shape[1]), None
        if self.components:
            self.center = x.mean(0)
            self.axes = np.linalg.svd(x - self.center, full_matrices=False)[2][: self.components].T
            x = (x - self.center) @ self.axes
        self.mean, self.std = (x.mean(0), x.std(0) + 1e-8) if self.standardise else (0.0, 1.0)
        x = (x - self.mean) / self.std
        if not len(x):
            raise ValueError("an empty reference grows no forest")
        rng, size = np.random.default_rng(self.seed), min(self.sample, len(x))
        self.levels = int(np.ceil(np.log2(max(size, 2))))
        self.forest = [self._grow(x[rng.choice(len(x), size, replace=False)], self.levels, rng) for _ in range(self.trees)]
        self.norm = self._c(size)
        return self

    @staticmethod
    def _c(n: int) -> float:
        return 0.0 if n <= 1 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n

    def _grow(self, x: np.ndarray, depth: int, rng) -> np.ndarray:
        """A tree as rows (dimension or -1 for a leaf, cut, left child, right child, path length that a leaf stands for)."""
        nodes: list[list[float]] = []

        def add(rows: np.ndarray, left: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0, at, at, depth - left + self._c(len(rows))])
            if left and len(rows) > 1 and (rows.max(0) > rows.min(0)).any():
                dim = rng.choice(np.flatnonzero(rows.max(0) > rows.min(0)))
                cut = rng.uniform(rows[:, dim].min(), rows[:, dim].max())
                low = rows[:, dim] < cut
                nodes[at][:2] = dim, cut
                nodes[at][2], nodes[at][3] = add(rows[low], left - 1), add(rows[~low], left - 1)
            return at

        add(x, depth)
        return np.array(nodes)

    @staticmethod
    def _depth(tree: np.ndarray, x: np.ndarray, levels: int) -> np.ndarray:
        """The path length of each row: all rows go down one level at a time; leaves are their own children."""
        at, every = np.zeros(len(x), np.int64), np.arange(len(x))
        dim, cut, left, right = tree[:, 0].astype(np.int64), tree[:, 1], tree[:, 2].astype(np.int64), tree[:, 3].astype(np.int64)
        for _ in range(levels):
            at = np.where(x[every, dim[at]] < cut[at], left[at], right[at])
        return tree[at, 4]

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.forest, self.levels, self.center, self.axes, self.mean, self.std, self.norm))

        @F.arrow_udf("double")
        def score(v: pa.Array) -> pa.Array:
            forest, levels, center, axes, mean, std, c = shared.value
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
            x = ((x - center) @ axes if axes is not None else x) - mean
            x = x / std
            total = sum(IsolationForest._depth(tree, x, levels) for tree in forest)
            return pa.array(2.0 ** (-total / len(forest) / max(c, 1e-12)))

        return df.select(*KEYS, score("features").alias("score"))


class LinearProbe(Detector):
    """Logistic regression on labelled vectors (``is_defect``), trained by Spark ML."""

    supports_class = True

    def __init__(self, steps: int = 50, reg: float = 1e-4):
        self.steps, self.reg = steps, reg

    def fit(self, reference: DataFrame) -> LinearProbe:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector

        rows = reference.select(array_to_vector(doubles(F.col("features"))).alias("x"), F.col("is_defect").cast("double").alias("y"))
        self.model = LogisticRegression(featuresCol="x", labelCol="y", maxIter=self.steps, regParam=self.reg).fit(rows)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        rows = self.model.transform(df.withColumn("x", array_to_vector(doubles(F.col("features")))))
        return rows.select(*KEYS, vector_to_array("probability")[1].alias("score"))


class FocalProbe(Detector):
    """Linear probe by gradient steps on the focal loss (gamma 0: cross-entropy); each step is one aggregation over the data.
    ``history`` has the loss of each step, ``threshold`` the best of even probabilities on the reference."""

    supports_class = True

    def __init__(self, gamma: float = 2.0, alpha: float = 0.25, epochs: int = 20, rate: float = 0.5, decay: float = 1e-4):
        self.gamma, self.alpha, self.epochs, self.rate, self.decay = gamma, alpha, epochs, rate, decay

    def _step(self, rows: DataFrame, dim: int, w: np.ndarray, b: float) -> np.ndarray:
        """Mean slopes of weights and offset, and the mean loss."""
        gamma, alpha = self.gamma, self.alpha

        def gradient(batches):
            total = np.zeros(dim + 3)
            for x in batches:
                f = x.column(0).flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, -1)
                y = np.asarray(x.column(1).to_pylist(), float)
                s = np.clip(1 / (1 + np.exp(-(f @ w + b))), 1e-7, 1 - 1e-7)
                pt, at = np.where(y == 1, s, 1 - s), np.where(y == 1, alpha, 1 - alpha)
                g = at * (1 - pt) ** gamma * (gamma * pt * np.log(pt) - (1 - pt)) * np.where(y == 1, 1, -1)
                total += np.r_[f.T @ g, g.sum(), (-at * (1 - pt) ** gamma * np.log(pt)).sum(), len(y)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 3)), pa.array(total)], ["i", "g"])

        sums = {r.i: r.g for r in rows.mapInArrow(gradient, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()}
        return np.array([sums[i] for i in range(dim + 2)]) / max(sums[dim + 2], 1)

    def fit(self, reference: DataFrame) -> FocalProbe:
        first = reference.select(F.size("features").alias("n")).first()
        if first is None:
            raise ValueError("a probe needs labelled patches")
        dim, w, b = first.n, np.zeros(first.n), 0.0
        m, v, self.history = np.zeros(dim + 1), np.zeros(dim + 1), []
        rows = reference.select("features", "is_defect").persist()  # read once for all steps
        for epoch in range(1, self.epochs + 1):
            found = self._step(rows, dim, w, b)
            g = found[:-1]
            self.history.append({"epoch": epoch, "loss": float(found[-1])})
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = self.rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
            w, b = w * (1 - self.rate * self.decay) - step[:-1], b - step[-1]
        self.w, self.b = w.tolist(), float(b)
        self.threshold = probability_sweep(rows.withColumn("score", self._probability())).first().threshold
        rows.unpersist()
        return self

    def state(self) -> dict:
        """What a checkpoint keeps."""
        return {"w": self.w, "b": self.b, "threshold": self.threshold, "history": self.history}

    def restore(self, state: dict) -> FocalProbe:
        self.w, self.b, self.threshold, self.history = (state[k] for k in ("w", "b", "threshold", "history"))
        return self

    def _probability(self):
        z = F.aggregate(F.zip_with("features", F.array(*[F.lit(x) for x in self.w]), lambda a, c: a * c), F.lit(self.b), lambda s, x: s + x)
        return 1 / (1 + F.exp(-z))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*KEYS, self._probability().alias("score"))


class ClassProbe(Detector):
    """A probe with a class head: the probability of a defect, and among defect patches of the reference a multinomial regression
    of their class (``pred_class``)."""

    supports_class = True

    def __init__(self, probe: Detector | None = None, steps: int = 50, reg: float = 1e-4):
        self.probe, self.steps, self.reg = probe or FocalProbe(), steps, reg

    def fit(self, reference: DataFrame) -> ClassProbe:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector

        self.probe.fit(reference)
        rows = reference.filter("is_defect").select(array_to_vector(doubles(F.col("features"))).alias("x"), F.col("class_id").cast("double").alias("y"))
        self.head = LogisticRegression(featuresCol="x", labelCol="y", predictionCol="pred_class", maxIter=self.steps, regParam=self.reg, family="multinomial").fit(rows)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        classes = self.head.transform(df.select("id", array_to_vector(doubles(F.col("features"))).alias("x"))).select("id", F.col("pred_class").cast("int").alias("pred_class"))
        return self.probe.transform(df).join(classes, "id")


def fuse(a: DataFrame, b: DataFrame, how: str = "weighted_sum", weight: float = 0.5) -> DataFrame:
    """Fusion of two branches' per-image z-scores: weighted_sum, product or max."""
    za, zb = z_score(a).select("id", "image_id", F.col("z").alias("za")), z_score(b).select("id", F.col("z").alias("zb"))
    x, y = F.col("za"), F.col("zb")
    value = {"weighted_sum": weight * x + (1 - weight) * y, "product": x * y, "max": F.greatest(x, y)}[how]
    return za.join(zb, "id").select("id", "image_id", value.alias("score"))


def ensemble(members: list[tuple[DataFrame, float]]) -> DataFrame:
    """Sum of weighted per-image z-scores, weights over their sum."""
    total = sum(w for _, w in members)
    parts = None
    for scores, w in members:
        part = z_score(scores).select("id", "image_id", (F.col("z") * (w / total)).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("id", "image_id").agg(F.sum("part").alias("score"))


def gated_class_scores(df: DataFrame, threshold: float, classes: list[int]) -> DataFrame:
    """Adds ``class_scores``: the predicted class has the binary score where that reaches the threshold, others 0."""
    cells = [x for c in classes for x in (F.lit(c), F.when((F.col("pred_class") == c) & (F.col("score") >= threshold), F.col("score")).otherwise(0.0))]
    return df.withColumn("class_scores", F.create_map(*cells))


def pca_mask(df: DataFrame, rows: int, cols: int, limit: float = 10.0, border: float = 0.2, centre_share: float = 0.35) -> DataFrame:
    """(image_id, row, col, keep): the first principal component above ``limit`` is foreground; where the centre (without
    ``border`` on each side) keeps ``centre_share`` or less, the negated component above it is. Then the mask is dilated and
    closed (3 x 3, the outside has no say). The sign of the component makes its largest weight positive. An image is one
    task's group."""

    def near(m: np.ndarray, outside: bool, how) -> np.ndarray:
        p = np.pad(m, 1, constant_values=outside)
        return how([p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(3) for j in range(3)], axis=0)

    def one(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        r, c = t.column("row").to_numpy(), t.column("col").to_numpy()
        x = t.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(r), -1).astype(float)
        axis = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][0]
        first = np.full((rows, cols), -np.inf)
        first[r, c] = (x - x.mean(0)) @ (axis * (1 if axis[np.abs(axis).argmax()] > 0 else -1))
        mask = first > limit
        mid = mask[int(rows * border) : int(rows * (1 - border)), int(cols * border) : int(cols * (1 - border))]
        if mid.sum() <= mid.size * centre_share:
            mask = np.where(np.isfinite(first), -first > limit, False)
        for _ in range(2):
            mask = near(mask, False, np.any)
        mask = near(mask, True, np.all)
        return pa.table({"image_id": t.column("image_id"), "row": t.column("row"), "col": t.column("col"), "keep": pa.array(mask[r, c])})

    kinds = ", ".join(f"{n} {k}" for n, k in df.select("image_id", "row", "col").dtypes)
    return df.select("image_id", "row", "col", "features").groupBy("image_id").applyInArrow(one, f"{kinds}, keep boolean")


#: Names of detectors.
REGISTRY = {
    "knn_bank": KnnBank, "prototype": Prototype, "vector_norm": VectorNorm, "mahalanobis": Mahalanobis, "sobel": Sobel,
    "isolation_forest": IsolationForest, "linear_probe": LinearProbe, "focal_probe": FocalProbe, "class_probe": ClassProbe,
}


def build(name: str, **params) -> Detector:
    """A detector by name. ``ensemble`` takes ``members``: detectors, or pairs of a name and its parameters."""
    from . import fused  # its detectors build on these

    known = REGISTRY | {
        "attention_rollout": fused.AttentionRollout, "cls_cosine": fused.ClsCosine, "knn_rollout": fused.knn_rollout, "forest_rollout": fused.forest_rollout,
        "reduced_mahalanobis": fused.ReducedMahalanobis, "branch_forest": fused.BranchForest, "ensemble": fused.Ensemble,
    }
    if name not in known:
        raise ValueError(f"unknown detector {name}; known: {', '.join(sorted(known))}")
    if name == "ensemble":
        params["members"] = [m if isinstance(m, Detector) else build(m[0], **m[1]) for m in params["members"]]
    return known[name](**params)

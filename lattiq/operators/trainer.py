"""A linear probe with a class head, trained jointly by mini-batches and resumable after any epoch.

Rows are written once in hashed buckets. A mini-batch is some buckets of the epoch's seeded order, so a step reads its own
rows only; its gradient is summed in the tasks and then over them. Weights and moments stay with the driver: they are as
large as a vector for each class. After each epoch the state goes to a shared folder, and a run that finds states there goes
on from the last.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detectors import KEYS, Detector
from .ranking import probability_sweep
from .shared import placed, present, shared_folder, small_batches, spent, written

BUCKETS = 64


class JointProbe(Detector):
    """Trains on the mean binary loss (``bce`` or ``focal``) plus ``class_weight`` times the mean cross-entropy of the class among
    defect patches with a class of 1 to ``classes``, by AdamW with ``batches`` steps an epoch.

    ``fit`` takes reference rows (id, features, is_defect, class_id) and validation rows, which ``history`` is given for after
    each epoch. The weights kept are those of the epoch of least validation loss (of the last, without validation rows);
    training ends early after ``patience`` epochs without a better one. ``threshold`` is the best of even probabilities on
    the validation rows (reference rows without them). With a ``folder``, states are written there.
    """

    supports_class = True

    def __init__(self, classes: int = 4, loss: str = "bce", gamma: float = 2.0, alpha: float = 0.25, class_weight: float = 1.0, epochs: int = 20, batches: int = 8, rate: float = 0.05, decay: float = 1e-4, seed: int = 42, patience: int | None = None, folder: str | None = None):
        if loss not in ("bce", "focal"):
            raise ValueError(f"unknown loss {loss}")
        self.classes, self.loss, self.gamma, self.alpha, self.class_weight = classes, loss, gamma, alpha, class_weight
        self.epochs, self.batches, self.rate, self.decay, self.seed, self.patience, self.folder = epochs, min(batches, BUCKETS), rate, decay, seed, patience, folder

    def settings(self) -> dict:
        """What states of one run must share; a run may be made longer."""
        return {k: v for k, v in self.__dict__.items() if k in ("classes", "loss", "gamma", "alpha", "class_weight", "batches", "rate", "decay", "seed")}

    def sums(self, x: np.ndarray, y: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of some rows: slopes of both losses by the weights (vectors and an offset by binary head and classes), the losses, and the
        rows that each counts; ``c`` is the class from 1, 0 for none."""
        x = np.c_[x, np.ones(len(x))]
        z = x @ w
        s = np.clip(1 / (1 + np.exp(-np.clip(z[:, 0], -500, 500))), 1e-7, 1 - 1e-7)
        pt, sign = np.where(y, s, 1 - s), np.where(y, 1.0, -1.0)
        if self.loss == "focal":
            at = np.where(y, self.alpha, 1 - self.alpha)
            value = -at * (1 - pt) ** self.gamma * np.log(pt)
            slope = at * (1 - pt) ** self.gamma * (self.gamma * pt * np.log(pt) - (1 - pt)) * sign
        else:
            value, slope = -np.log(pt), -(1 - pt) * sign
        grads = np.zeros_like(w)
        grads[:, 0] = x.T @ slope
        own = np.flatnonzero(y & (c > 0))
        class_loss = 0.0
        if len(own):
            logits = z[own, 1:] - z[own, 1:].max(1, keepdims=True)
            share = np.exp(logits)
            share /= share.sum(1, keepdims=True)
            class_loss = -np.log(np.maximum(share[np.arange(len(own)), c[own] - 1], 1e-300)).sum()
            share[np.arange(len(own)), c[own] - 1] -= 1
            grads[:, 1:] = x[own].T @ share
        hit, said = s >= 0.5, y
        right = int((z[own, 1:].argmax(1) == c[own] - 1).sum()) if len(own) else 0
        return np.r_[grads.reshape(-1), value.sum(), class_loss, len(y), len(own), (hit & said).sum(), (hit & ~said).sum(), (~hit & said).sum(), right]

    def _total(self, rows: DataFrame, w: np.ndarray) -> dict:
        """``sums`` over a table."""
        size, shape, sums = w.size + 8, w.shape, self.sums

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                if b.num_rows:
                    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    y, c = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                    total += sums(x, y.astype(bool), c.astype(np.int64), w)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "g"])

        found = rows.select("features", "is_defect", "class_id").mapInArrow(partial, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
        t = np.zeros(size)
        t[[r.i for r in found]] = [r.g for r in found]
        loss, class_loss, n, n_class, tp, fp, fn, right = t[w.size :]
        slopes = t[: w.size].reshape(shape)
        slopes[:, 0] /= max(n, 1)
        slopes[:, 1:] *= self.class_weight / max(n_class, 1)
        parts = {"binary_loss": loss / max(n, 1), "class_loss": class_loss / max(n_class, 1), "n": n}
        precision, recall = tp / max(tp + fp, 1), tp / max(tp + fn, 1)
        parts |= {"precision": precision, "recall": recall, "f1": 2 * precision * recall / max(precision + recall, 1e-12), "class_accuracy": right / n_class if n_class else None}
        return {"slopes": slopes, "loss": parts["binary_loss"] + self.class_weight * parts["class_loss"], **parts}

    def fit(self, reference: DataFrame, validation: DataFrame | None = None) -> JointProbe:
        spark = reference.sparkSession
        small_batches(spark)
        first = reference.select(F.size("features").alias("n")).first()
        if first is None:
            raise ValueError("a probe needs labelled patches")
        c = F.col("class_id").cast("int")
        ready = lambda df: df.select(F.col("features").cast("array<double>").alias("features"), F.coalesce("is_defect", F.lit(False)).alias("is_defect"), F.when(c.between(1, self.classes), c).otherwise(0).alias("class_id"), F.pmod(F.xxhash64(F.lit(self.seed), "id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        rows = self._bucketed(ready(reference.filter("features IS NOT NULL")))
        held = None if validation is None or validation.isEmpty() else written(ready(validation.filter("features IS NOT NULL")), "validation")
        state = self._found(spark) or {"epoch": 0, "w": np.zeros((first.n + 1, 1 + self.classes)).tolist(), "step": 0, "history": [], "best": None}
        w = np.array(state["w"])
        m, v = (np.array(state.get(k, np.zeros_like(w))) for k in ("m", "v"))
        history, best, step = state["history"], state["best"], state["step"]
        for epoch in range(state["epoch"] + 1, self.epochs + 1):
            if self.patience is not None and best is not None and epoch - 1 - best["epoch"] >= self.patience:
                break
            order = np.random.default_rng([self.seed, epoch]).permutation(BUCKETS)
            losses = []
            for part in np.array_split(order, self.batches):
                total = self._total(rows.filter(F.col("bucket").isin(*part.tolist())), w)
                if not total["n"]:
                    continue
                step += 1
                g = total["slopes"]
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w = w * (1 - self.rate * self.decay) - self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                losses.append(total["loss"])
            row = {"epoch": epoch, "train_loss": float(np.mean(losses)) if losses else None}
            if held is not None:
                found = self._total(held, w)
                row |= {f"val_{k}": None if found[k] is None else float(found[k]) for k in ("loss", "binary_loss", "class_loss", "precision", "recall", "f1", "class_accuracy")}
            history.append(row)
            if held is None or best is None or row["val_loss"] < best["loss"]:
                best = {"epoch": epoch, "loss": row.get("val_loss"), "w": w.tolist()}
            self._keep(spark, {"epoch": epoch, "w": w.tolist(), "m": m.tolist(), "v": v.tolist(), "step": step, "history": history, "best": best})
        self.history, self.best_epoch = history, best["epoch"] if best else 0
        self.w = np.array(best["w"]) if best else w
        scored = (held if held is not None else rows).withColumn("score", self._scores()["score"])
        self.threshold = probability_sweep(scored).first().threshold
        spent(rows, *([held] if held is not None else []))
        return self

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        """A written table whose buckets are folders, so that a step reads its own only."""
        path = f"{shared_folder(rows.sparkSession)}/probe-{np.random.default_rng().integers(1 << 60):x}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(path)
        table = rows.sparkSession.read.schema(rows.schema).parquet(path)
        table.written_to = path
        return table

    def _place(self, epoch: int) -> str:
        return f"{self.folder.rstrip('/')}/epoch-{epoch:05d}"

    def _found(self, spark) -> dict | None:
        """The last state in the folder; one of other settings is an error."""
        if self.folder is None:
            return None
        last = 0
        while present(spark, self._place(last + 1)):
            last += 1
        last = min(last, self.epochs)
        if not last:
            return None
        state = json.loads(spark.read.text(self._place(last), wholetext=True).first()[0])
        if state.pop("settings") != self.settings():
            raise ValueError("the folder holds a run of other settings")
        return state

    def _keep(self, spark, state: dict) -> None:
        if self.folder is not None:
            text = json.dumps({"settings": self.settings(), **state})
            placed(spark, spark.createDataFrame([(text,)], "value string").coalesce(1).write.format("text"), self._place(state["epoch"]))

    def _scores(self) -> dict:
        """Columns ``score`` and ``pred_class`` of ``features``."""
        weights = self.w

        @F.arrow_udf("struct<score:double,pred_class:int>")
        def judge(features: pa.Array) -> pa.Array:
            if not len(features):
                return pa.array([], pa.struct([("score", pa.float64()), ("pred_class", pa.int32())]))
            z = np.c_[features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1), np.ones(len(features))] @ weights
            score = 1 / (1 + np.exp(-np.clip(z[:, 0], -500, 500)))
            return pa.StructArray.from_arrays([pa.array(score), pa.array(z[:, 1:].argmax(1) + 1, pa.int32())], ["score", "pred_class"])

        found = judge(F.col("features").cast("array<double>"))
        return {"score": found["score"], "pred_class": found["pred_class"]}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.filter("features IS NOT NULL").select(*KEYS, *[c.alias(n) for n, c in self._scores().items()])

"""Scores from two kinds of banks: one of normal patches, one of defects for each class, each distance calibrated by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite
from .calibration import robust
from .knn import class_scores, knn_scores
from .order import percentiles

#: Score modes.
MODES = ("normal", "anomaly_diagnostic", "margin", "ratio", "gated_hybrid")


class DualBank:
    """A normal bank (id, features) and defect banks by class (id, class_id, features).

    ``fit`` takes reference patches: the robust z of their normal distances, for each class the robust z of their negated
    distances to its bank (nearer is more anomalous), and the gate, a percentile of the raw normal distances. Unfitted,
    distances are used as they are, and no patch passes the gate.
    """

    def __init__(self, normal: DataFrame, defects: DataFrame | None = None, weight: float = 1.0, gate_level: float = 95.0, k: int = 1, metric: str = "cosine"):
        self.normal, self.defects, self.weight, self.gate_level, self.k, self.metric = normal, defects, weight, gate_level, k, metric
        self.facts = self.class_facts = None

    def distances(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(id, d_n) and (id, class_id, d_a) of patches; the second is None without defect banks."""
        near = knn_scores(df, self.normal, self.k, self.metric).select(F.col("query_id").alias("id"), F.col("score").alias("d_n"))
        if self.defects is None:
            return near, None
        if self.k == 1:
            found = class_scores(df, self.defects, self.metric).select(F.col("query_id").alias("id"), "class_id", F.col("dist").alias("d_a"))
        else:  # classes are a short list
            found = None
            for (c,) in sorted(self.defects.select("class_id").distinct().collect()):
                one = knn_scores(df, self.defects.filter(F.col("class_id") == c), self.k, self.metric)
                one = one.select(F.col("query_id").alias("id"), F.lit(c).alias("class_id"), F.col("score").alias("d_a"))
                found = one if found is None else found.unionByName(one)
        return near, found

    def fit(self, reference: DataFrame) -> DualBank:
        near, far = self.distances(reference)
        near = near.filter(finite(F.col("d_n")).isNotNull())
        gate = percentiles(near, "d_n", [self.gate_level / 100]).select(F.get("ps", F.lit(0)).alias("gate"))
        facts = robust(near, "d_n").select(F.coalesce("median", F.lit(0.0)).alias("n_median"), F.coalesce("iqr", F.lit(1.0)).alias("n_iqr"))
        self.facts = facts.crossJoin(F.broadcast(gate))
        if far is not None:
            far = far.filter(finite(F.col("d_a")).isNotNull()).withColumn("negated", -F.col("d_a"))
            self.class_facts = robust(far, "negated", ["class_id"]).select("class_id", F.col("median").alias("a_median"), F.col("iqr").alias("a_iqr"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """``id``, ``d_normal``, ``d_anomaly`` (map of class to distance), ``predicted_class`` (the class whose calibrated negated
        distance is highest, ties to the smaller; 0 without defect banks) and a column for each of ``MODES``, all of which
        are higher for more anomalous patches but ``ratio``, which is the calibrated normal distance over the raw distance of
        that class (1e-8 at least)."""
        near, far = self.distances(df)
        rows = near.withColumnRenamed("d_n", "d_normal")
        if self.facts is None:
            rows = rows.withColumns({"z": F.col("d_normal"), "gate": F.lit(float("inf"))})
        else:
            rows = rows.crossJoin(F.broadcast(self.facts)).withColumn("z", (F.col("d_normal") - F.col("n_median")) / F.col("n_iqr"))
        if far is None:
            rows = rows.withColumns({"d_anomaly": F.create_map().cast("map<int,double>"), "predicted_class": F.lit(0), "best": F.lit(0.0), "raw": F.lit(0.0)})
        else:
            value = -F.col("d_a")
            if self.class_facts is not None:
                far = far.join(F.broadcast(self.class_facts), "class_id", "left")
                value = F.coalesce((value - F.col("a_median")) / F.col("a_iqr"), value)
            far = far.withColumn("value", value)
            best = far.groupBy("id").agg(
                F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_id", "d_a")))).alias("d_anomaly"),
                F.min(F.struct((-F.col("value")).alias("lead"), F.col("class_id").alias("predicted_class"), F.col("value").alias("best"), F.col("d_a").alias("raw"))).alias("b"),
            )
            rows = rows.join(best.select("id", "d_anomaly", "b.predicted_class", "b.best", "b.raw"), "id", "left").fillna(0, ["predicted_class"]).fillna(0.0, ["best", "raw"])
        z, best = F.col("z"), F.col("best")
        hybrid = z + self.weight * best
        scores = {
            "normal": z, "anomaly_diagnostic": best, "margin": hybrid, "ratio": z / F.greatest("raw", F.lit(1e-8)),
            "gated_hybrid": F.when(F.col("d_normal") >= F.coalesce("gate", F.lit(float("inf"))), hybrid).otherwise(z),
        }
        return rows.select("id", "d_normal", "d_anomaly", "predicted_class", *[scores[m].alias(m) for m in MODES])

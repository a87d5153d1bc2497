"""Runners of studies: tuned ensembles, anomaly memories, auxiliary attention, synthetic banks, controls against a clean run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bankers, code, shown
from ..operators import bank, knn, ranking, study
from ..operators.calibration import z_score
from ..sources.tables import patch_features, patch_scores
from .registry import PF, PS, query, rank_sql
from .score_queries import show

#: Weights of the auxiliary attention branch, and settings of the anomaly-memory stages.
BETAS = (0.1, 0.2, 0.3)
RULES = ("any", "ratio_10", "ratio_50")


def keyed_sweep(df: DataFrame, thresholds: Sequence[float], keys: Sequence[str], score: str = "score", label: str = "is_defect") -> DataFrame:
    """Confusion counts and metrics of every key at every threshold: each score falls into the range below its next threshold, and
    ranges are cumulated."""
    limits = sorted(set(map(float, thresholds)))
    part = F.size(F.filter(F.array(*[F.lit(t) for t in limits]), lambda t: t <= F.col(score)))
    sums = df.groupBy(*keys, part.alias("i")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    spark = df.sparkSession
    places = spark.createDataFrame([(i, t) for i, t in enumerate([None, *limits])], "i int, threshold double")
    rows = sums.select(*keys).distinct().crossJoin(F.broadcast(places)).join(sums, [*keys, "i"], "left").fillna(0, ["pos", "neg"])
    up = Window.partitionBy(*keys).orderBy(F.desc("i"))  # as many rows as thresholds
    every = Window.partitionBy(*keys)
    rows = rows.select(*keys, "threshold", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.sum("pos").over(every).alias("P"), F.sum("neg").over(every).alias("N"))
    counts = rows.filter("threshold IS NOT NULL").select(*keys, "threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"))
    return ranking.with_prf(counts)


def tune_ensemble(a: DataFrame, b: DataFrame, truth: DataFrame, tune_fold: int = 0, steps: int = 11, target_recall: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(best, benchmark): the weight of two members' per-image z-scores whose threshold for enough recall has the highest F1 on
    one fold, and metrics with both on every other fold. ``a`` and ``b`` have (id, image_id, score), ``truth`` (id, fold,
    is_defect). Members are scored once, and all weights are swept in one job."""
    za, zb = (z_score(m).select("id", F.col("z").alias(n)) for m, n in ((a, "z1"), (b, "z2")))
    rows = za.join(zb, "id").join(truth.select("id", "fold", "is_defect"), "id")
    tune = rows.filter(F.col("fold") == tune_fold)
    middle = tune.withColumn("score", (F.col("z1") + F.col("z2")) / 2)
    limits = [r.threshold for r in ranking.threshold_grid(middle).collect()]  # a bounded grid
    swept = keyed_sweep(study.ensemble_grid(tune, steps), limits, ["weight"])
    enough = F.coalesce(F.col("recall"), F.lit(-1.0)) >= target_recall
    # of each weight the lowest threshold with enough recall, else that of the largest recall
    order = F.struct(F.when(enough, 0).otherwise(1).alias("a"), F.when(enough, F.lit(0.0)).otherwise(-F.coalesce("recall", F.lit(-1.0))).alias("b"), F.col("threshold"))
    each = swept.groupBy("weight").agg(F.min_by(F.struct("threshold", "precision", "recall", "f1"), order).alias("r")).select("weight", "r.*")
    best = each.orderBy(F.desc(F.coalesce("f1", F.lit(-1.0))), "weight").limit(1)
    rest = rows.filter(F.col("fold") != tune_fold).crossJoin(F.broadcast(best.select("weight", "threshold")))
    score = F.col("weight") * F.col("z1") + (1 - F.col("weight")) * F.col("z2")
    counts = ranking.confusion(rest, F.col("is_defect"), score >= F.col("threshold"), ["fold"])
    return best, ranking.with_prf(counts)


def memory_study(pool: DataFrame, rules: Sequence[str] = RULES, gates: Sequence[float | None] = (None, 75.0), caps: Sequence[int | None] = (None,), classes: Sequence[int] = (1, 2, 3, 4), held_out: int | None = None, seed: int = 42) -> DataFrame:
    """One row per overlap rule, distance gate, cap of an image and class: how many patches an anomaly memory would have, and of how
    many images. ``pool`` has (id, image_id, class_id, overlap, score) of training images; conditions are a short list."""
    out = None
    for rule in rules:
        for gate in gates:
            for cap in caps:
                chosen = bank.select_anomalies(pool, rule, level=gate, per_image=cap, held_out=held_out, seed=seed, allow_oracle=True)
                counts = chosen.filter(F.col("class_id").isin(*classes)).groupBy("class_id").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images"))
                part = counts.select(F.lit(rule).alias("rule"), F.lit(gate).cast("double").alias("gate"), F.lit(cap).cast("int").alias("cap"), "class_id", "n", "images")
                out = part if out is None else out.unionByName(part)
    return out


def attention_plan(betas: Sequence[float] = BETAS, three_signals: bool = False) -> list[dict]:
    """The comparisons of the auxiliary attention study: neighbours alone, with rollout at each weight, and the gated bank. The
    model of three signals is run only where both others are better by themselves."""
    rows = [{"name": "normal_knn", "detector": "knn_bank", "rollout_weight": 0.0}]
    rows += [{"name": f"knn_rollout_beta_{b:g}", "detector": "knn_rollout", "rollout_weight": float(b)} for b in betas]
    rows.append({"name": "normal_only_vs_gated_hybrid", "detector": "gated_hybrid", "rollout_weight": None})
    if three_signals:
        rows.append({"name": "three_signals", "detector": "gated_hybrid+knn_rollout", "rollout_weight": None})
    return rows


def thin_defects(df: DataFrame, threshold: float, low: float = 0.0, high: float = 0.10) -> DataFrame:
    """One row: patches with an overlap between ``low`` and ``high``, and the share of them that is found."""
    thin = df.filter((F.col("overlap") > low) & (F.col("overlap") < high))
    return thin.agg(F.count("*").alias("n"), F.count_if(F.col("score") >= threshold).alias("found")).withColumn("recall", F.try_divide(F.col("found"), F.col("n")))


def edge_false_positives(df: DataFrame, threshold: float, rows: int, cols: int, border: int = 1) -> DataFrame:
    """One row: false positives within ``border`` cells of the image's edge, all false positives, and precision with and without
    those at the edge."""
    edge = (F.col("row") < border) | (F.col("col") < border) | (F.col("row") >= rows - border) | (F.col("col") >= cols - border)
    hit = F.col("score") >= threshold
    counts = df.agg(F.count_if(hit & F.col("is_defect")).alias("tp"), F.count_if(hit & ~F.col("is_defect")).alias("fp"), F.count_if(hit & ~F.col("is_defect") & edge).alias("edge_fp"))
    tp, fp, own = F.col("tp"), F.col("fp"), F.col("edge_fp")
    return counts.select("edge_fp", "fp", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fp - own).alias("precision_without"))


def synthetic_rejections(patches: DataFrame, rule: str = "ratio_50", fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """(bank, id, image_id, rejected) for four banks, decided image by image: ``naive`` rejects nothing, ``oracle`` by an overlap
    rule, ``distance_trim_20`` the most distant share (the overlap stands in for a missing ``score``), and
    ``random_size_matched`` as many by hash rank."""
    rows = patches if "score" in patches.columns else patches.withColumn("score", F.col("overlap"))
    keep = bankers((1 - fraction) * F.count("*").over(Window.partitionBy("image_id")).cast("double"))
    near = F.row_number().over(Window.partitionBy("image_id").orderBy("score", "id"))
    drawn = F.row_number().over(Window.partitionBy("image_id").orderBy(code("matched", seed, F.col("id")), "id"))
    rows = rows.select("id", "image_id", "overlap", keep.alias("keep"), near.alias("near"), drawn.alias("drawn"))  # windows over one image's patches
    banks: dict[str, Column] = {"naive": F.lit(False), "oracle": bank.overlap_rule(F.col("overlap"), rule), "distance_trim_20": F.col("near") > F.col("keep"), "random_size_matched": F.col("drawn") > F.col("keep")}
    cells = F.array(*[F.struct(F.lit(n).alias("bank"), c.alias("rejected")) for n, c in banks.items()])
    return rows.select("id", "image_id", F.explode(cells).alias("b")).select("b.bank", "id", "image_id", "b.rejected")


def contamination_traces(queries: DataFrame, contaminated: DataFrame, k: int = 1) -> DataFrame:
    """For each query and source of its k nearest bank rows (``contaminated`` has slot_id, source, features): how many there are and
    the least distance."""
    rows = contaminated.select(F.col("slot_id").alias("id"), "source", "features")
    found = knn.with_provenance(knn.nearest(queries, rows, k), rows)
    return found.groupBy("query_id", "source").agg(F.count("*").alias("n"), F.min("dist").alias("dist"))


def against_clean(runs: DataFrame, clean: str = "clean", metrics: Sequence[str] = ("auprc", "fixed_f1"), threshold: str = "query_threshold") -> DataFrame:
    """Controls with their differences from the clean run of the same fold and seed (absolute for the threshold), and their rank
    among those that aren't random. Fails where a run has no clean one."""
    base = runs.filter(F.col("name") == clean).select("fold", "seed", *[F.col(m).alias(f"__{m}") for m in (*metrics, threshold)])
    others = runs.filter(F.col("name") != clean)
    if not others.join(base, ["fold", "seed"], "left_anti").isEmpty():
        raise ValueError("a run has no clean run of its fold and seed")
    rows = others.join(base, ["fold", "seed"]).withColumns({f"{m}_delta": F.col(m) - F.col(f"__{m}") for m in metrics})
    rows = rows.withColumn("threshold_delta", F.abs(F.col(threshold) - F.col(f"__{threshold}"))).drop(*[f"__{m}" for m in (*metrics, threshold)])
    fair = study.control_rank(rows.filter("NOT is_random"), ["fold", "seed"])
    return fair.unionByName(rows.filter("is_random").withColumn("rank", F.lit(None).cast("int")))


OVER = "o AS (SELECT vec_id AS id, image_id, class_id, row, col, is_defect, round((vec_id * 7 % 20) / 20.0, 6) AS overlap, round(abs(features[1]), 6) AS score FROM pf)"


def overlaps(spark, d):
    rows = patch_features(spark, d)
    overlap, score = F.round((F.col("vec_id") * 7 % 20) / 20.0, 6), shown(F.abs(F.get("features", F.lit(0))))
    return rows.select(F.col("vec_id").alias("id"), "image_id", "class_id", "row", "col", "is_defect", overlap.alias("overlap"), score.alias("score"))


@query(f"""WITH {PF}, {OVER}, x AS (SELECT r.rule, g.gate, o.* FROM o, (VALUES ('any'), ('ratio_10'), ('ratio_50')) r(rule), (VALUES (NULL::DOUBLE), (75.0::DOUBLE)) g(gate)
WHERE (CASE rule WHEN 'any' THEN overlap > 0 WHEN 'ratio_10' THEN overlap >= 0.1 ELSE overlap >= 0.5 END) AND (gate IS NULL OR score >= (SELECT quantile_cont(score, 0.75) FROM o)))
SELECT rule, gate, NULL::INTEGER AS cap, class_id, count(*) AS n, count(DISTINCT image_id) AS images FROM x WHERE class_id > 0 GROUP BY ALL""", "memory_study")
def _memory_study(spark, d):
    return memory_study(overlaps(spark, d))


@query(f"WITH {PF}, {OVER} SELECT count(*) AS n, count(*) FILTER (score >= 0.1) AS found, round(count(*) FILTER (score >= 0.1) / nullif(count(*), 0)::DOUBLE, 6) AS recall FROM o WHERE overlap > 0 AND overlap < 0.1", "thin_defects")
def _thin(spark, d):
    return show(thin_defects(overlaps(spark, d), 0.1), "recall")


@query(f"""WITH {PF}, {OVER}, c AS (SELECT count(*) FILTER (is_defect) AS tp, count(*) FILTER (NOT is_defect) AS fp, count(*) FILTER (NOT is_defect AND (row IN (0, 3) OR col IN (0, 4))) AS edge_fp FROM o WHERE score >= 0.1)
SELECT edge_fp, fp, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fp - edge_fp, 0)::DOUBLE, 6) AS precision_without FROM c""", "edge_false_positives")
def _edge(spark, d):
    return show(edge_false_positives(overlaps(spark, d), 0.1, 4, 5), "precision", "precision_without")


@query(f"""WITH {PF}, {OVER}, r AS (SELECT *, round_even(0.8 * count(*) OVER (PARTITION BY image_id), 0) AS keep, row_number() OVER (PARTITION BY image_id ORDER BY score, id) AS near,
 row_number() OVER (PARTITION BY image_id ORDER BY {rank_sql('matched', 42, 'id')}, id) AS drawn FROM o)
SELECT bank, id, image_id, CASE bank WHEN 'naive' THEN false WHEN 'oracle' THEN overlap >= 0.5 WHEN 'distance_trim_20' THEN near > keep ELSE drawn > keep END AS rejected
FROM r, (VALUES ('naive'), ('oracle'), ('distance_trim_20'), ('random_size_matched')) b(bank)""", "synthetic_rejections")
def _rejections(spark, d):
    return synthetic_rejections(overlaps(spark, d))


@query(f"""WITH {PS}, k AS (SELECT image_id % 3 AS grp, threshold, count(*) FILTER (is_defect AND score >= threshold) AS tp, count(*) FILTER (NOT is_defect AND score >= threshold) AS fp, count(*) FILTER (is_defect AND score < threshold) AS fn,
 count(*) FILTER (NOT is_defect AND score < threshold) AS tn FROM ps, (SELECT unnest([0.2, 0.5, 0.8, 1.1]) AS threshold) GROUP BY ALL) SELECT grp, threshold::DOUBLE AS threshold, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision,
round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM k""", "keyed_sweep")
def _keyed_sweep(spark, d):
    rows = patch_scores(spark, d).withColumn("grp", F.col("image_id") % 3)
    return show(keyed_sweep(rows, [0.2, 0.5, 0.8, 1.1], ["grp"]), "precision", "recall", "f1")


@query(None, "ensemble_tuning")
def _tuning(spark, d):
    rows = overlaps(spark, d)
    members = [rows.select("id", "image_id", F.col(c).alias("score")) for c in ("score", "overlap")]
    best, bench = tune_ensemble(*members, rows.select("id", (F.col("image_id") % 5).alias("fold"), "is_defect"))
    return bench.crossJoin(F.broadcast(best.select("weight", "threshold")))

"""Queries of fused detectors, scorers, reference plans and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import norm, shown
from ..operators import bank, detectors, references, reports, sampling, scorers
from ..operators.shared import spent, written
from ..sources.tables import patch_features, patch_scores
from .design_queries import image_meta
from .registry import DIST, PF, PS, query
from .score_queries import PRO, RANK, curve_sql, regions, show
from .vector_queries import ATT, MEAN, attention, part, rollout_sql, rounded_score

def class_tokens(spark, d):
    return patch_features(spark, d).filter("row = 0 AND col = 0").select("image_id", F.col("features").alias("cls"))


@query(f"""WITH {PF}, {ATT}, {rollout_sql(0.3)}, m AS (SELECT vec_id AS id, role, coalesce(score, 0) AS v FROM pf JOIN roll USING (image_id, row, col)),
f AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM m WHERE role = 'clean') SELECT id, round((v - f.m) / (s + 1e-8), 5) + 0.0 AS score FROM m, f WHERE role = 'query'""")
def attention_rollout(spark, d):
    found = detectors.build("attention_rollout", attention=attention(spark, d), width=5, discard=0.3).fit(part(spark, d, "clean"))
    return rounded_score(found.transform(part(spark, d, "query")).select("id", "score"), digits=5)


@query(f"""WITH {PF}, c AS (SELECT image_id, features AS cls FROM pf WHERE row = 0 AND col = 0),
s AS (SELECT vec_id AS id, role, list_inner_product(features, cls) / ((sqrt(list_inner_product(features, features)) + 1e-8) * (sqrt(list_inner_product(cls, cls)) + 1e-8)) AS v FROM pf JOIN c USING (image_id)),
f AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM s WHERE role = 'clean') SELECT id, round((v - m) / (sd + 1e-8), 6) + 0.0 AS score FROM s, f WHERE role = 'query'""")
def cls_cosine_image(spark, d):
    found = detectors.build("cls_cosine", tokens=class_tokens(spark, d)).fit(part(spark, d, "clean"))
    return rounded_score(found.transform(part(spark, d, "query")).select("id", "score"))


@query(f"""WITH {PF}, {ATT}, {rollout_sql(0)}, st AS (SELECT row, col, avg(score) AS m, coalesce(stddev_samp(score), 0) + 1e-5 AS s FROM roll WHERE image_id IN (SELECT image_id FROM pf WHERE role = 'clean') GROUP BY ALL),
b AS (SELECT q.vec_id AS id, q.image_id, q.row, q.col, min({DIST}) AS a FROM pf q, pf b WHERE q.role = 'query' AND b.role = 'clean' GROUP BY ALL),
x AS (SELECT b.*, abs(score - m) / s AS v FROM b JOIN roll USING (image_id, row, col) JOIN st USING (row, col)),
z AS (SELECT id, (a - avg(a) OVER w) / (stddev_pop(a) OVER w + 1e-8) AS za, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-8) AS zv FROM x WINDOW w AS (PARTITION BY image_id)) SELECT id, round(0.75 * za + 0.25 * zv, 5) + 0.0 AS score FROM z""")
def knn_rollout(spark, d):
    found = detectors.build("knn_rollout", attention=attention(spark, d), width=5, height=4, weights=(3.0, 1.0)).fit(part(spark, d, "clean"))
    return found.transform(part(spark, d, "query")).select("id", shown(F.col("score"), 5).alias("score"))


@query()
def forest_rollout(spark, d):
    found = detectors.build("forest_rollout", attention=attention(spark, d), width=5, height=4, trees=16, neighbours=True).fit(part(spark, d, "clean"))
    return found.transform(part(spark, d, "query"))


@query(f"""WITH {PF}, {MEAN}, s AS (SELECT vec_id AS id, image_id, sqrt(list_inner_product(features, features)) AS a,
1 - list_inner_product(features, p) / ((sqrt(list_inner_product(features, features)) + 1e-8) * (sqrt(list_inner_product(p, p)) + 1e-8)) AS b FROM pf, m WHERE role = 'query')
SELECT id, round(0.25 * (a - avg(a) OVER w) / (stddev_pop(a) OVER w + 1e-8) + 0.75 * (b - avg(b) OVER w) / (stddev_pop(b) OVER w + 1e-8), 5) + 0.0 AS score FROM s WINDOW w AS (PARTITION BY image_id)""")
def ensemble_detector(spark, d):
    found = detectors.build("ensemble", members=[("vector_norm", {}), ("prototype", {})], weights=[1.0, 3.0]).fit(part(spark, d, "clean"))
    return found.transform(part(spark, d, "query")).select("id", shown(F.col("score"), 5).alias("score"))


@query()
def reduced_mahalanobis(spark, d):
    return detectors.build("reduced_mahalanobis", components=8).fit(part(spark, d, "clean")).transform(part(spark, d, "query"))


@query()
def branch_forest(spark, d):
    both = lambda rows: rows.withColumn("other", F.transform("features", lambda x: x * x))
    return detectors.build("branch_forest", components=4, trees=16).fit(both(part(spark, d, "clean"))).transform(both(part(spark, d, "query")))


@query(f"""WITH {PF}, s AS (SELECT image_id, class_id, is_defect, round(sqrt(list_inner_product(features, features)), 6) >= 1 AS pred FROM pf),
y AS (SELECT k AS class_id, image_id, CASE WHEN k = 0 THEN is_defect ELSE class_id = k END AS t, pred FROM s, (VALUES (0), (1), (2), (3), (4)) c(k)),
i AS (SELECT class_id, image_id, count(*) FILTER (t AND pred) AS tp, count(*) FILTER (NOT t AND pred) AS fp, count(*) FILTER (t AND NOT pred) AS fn, count(*) FILTER (NOT t AND NOT pred) AS tn FROM y GROUP BY ALL),
m AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall FROM i),
g AS (SELECT class_id, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, count(*) AS images, avg(precision) AS mean_precision, avg(recall) AS mean_recall,
 avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END) AS mean_f1 FROM m GROUP BY 1)
SELECT class_id, tp, fp, fn, tn, images, round(mean_precision, 6) AS mean_precision, round(mean_recall, 6) AS mean_recall, round(mean_f1, 6) AS mean_f1, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision,
round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM g""")
def patch_evaluation(spark, d):
    rows = patch_features(spark, d)
    labels = rows.select("image_id", "row", "col", "is_defect", F.col("class_id").alias("own"), F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("class_id"))
    labels = labels.select("image_id", "row", "col", "class_id", F.when(F.col("class_id") == 0, F.col("is_defect")).otherwise(F.col("own") == F.col("class_id")).alias("positive"))
    scores = rows.select("image_id", "row", "col", shown(norm(F.col("features"))).alias("score"))
    return show(reports.evaluate_patches(scores, labels, 1.0), "precision", "recall", "f1", "mean_precision", "mean_recall", "mean_f1")


@query(f"""WITH {PS}, {curve_sql('ps')}, grid AS (SELECT DISTINCT unnest(list_concat(quantile_cont(score, [i / 39.0 for i in range(40)]), [min(score) + (max(score) - min(score)) * i / 79.0 for i in range(80)])) AS threshold FROM ps),
s AS (SELECT threshold, count(*) FILTER (is_defect AND score >= threshold) AS tp, count(*) FILTER (NOT is_defect AND score >= threshold) AS fp, count(*) FILTER (is_defect AND score < threshold) AS fn FROM ps, grid GROUP BY 1),
f AS (SELECT threshold, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS r, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM s WHERE tp > 0 ORDER BY round(f1, 12) DESC, threshold LIMIT 1),
k AS (SELECT {RANK} FROM c) SELECT auroc, average_precision AS auprc, n_pos, n_neg, round(p, 6) AS grid_precision, round(r, 6) AS grid_recall, round(f1, 6) AS grid_f1, round(p, 6) AS fixed_precision, round(r, 6) AS fixed_recall, round(f1, 6) AS fixed_f1 FROM k, f""")
def ranking_report(spark, d):
    names = ("auroc", "auprc", "grid_precision", "grid_recall", "grid_f1", "fixed_precision", "fixed_recall", "fixed_f1")
    return show(reports.ranking_report(patch_scores(spark, d)), *names).select("n_pos", "n_neg", *names)


@query(f"""WITH {PRO}, s AS (SELECT lag(fpr) OVER w AS x0, lag(pro) OVER w AS y0, fpr AS x1, pro AS y1 FROM p WINDOW w AS (ORDER BY fpr, pro)),
a AS (SELECT round(sum((least(x1, 0.3) - x0) * (y0 + CASE WHEN x1 <= 0.3 THEN y1 ELSE y0 + (y1 - y0) * (0.3 - x0) / (x1 - x0) END) / 2) / 0.3, 6) AS au_pro FROM s WHERE x0 IS NOT NULL AND x0 < 0.3),
y AS (SELECT score, region IS NOT NULL AS is_defect FROM z), {curve_sql('y').replace('g AS', 'gg AS', 1).replace('FROM g', 'FROM gg')}, k AS (SELECT {RANK} FROM c) SELECT au_pro, auroc AS pixel_auroc, f1_max AS pixel_f1 FROM a, k""")
def region_report(spark, d):
    return show(reports.region_report(regions(spark, d)), "au_pro", "pixel_auroc", "pixel_f1")


LEVEL_SQL = "[0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1]"


@query(f"WITH {PS}, o AS (SELECT least(score - 0.3, 1) AS o FROM ps WHERE score - 0.3 > 0), q AS (SELECT count(*) AS n_positive, quantile_cont(o, {LEVEL_SQL}) AS v FROM o) SELECT n_positive, unnest(['p0', 'p1', 'p5', 'p10', 'p25', 'p50', 'p75', 'p90', 'p95', 'p99', 'p100']) AS level, round(unnest(v), 6) + 0.0 AS value FROM q")
def overlap_quantiles(spark, d):
    rows = patch_scores(spark, d).withColumn("overlap", F.least(F.col("score") - 0.3, F.lit(1.0)))
    return bank.overlap_quantiles(rows).select("n_positive", F.explode("quantiles").alias("level", "value")).withColumn("value", shown(F.col("value")))


def calibration_parts(spark, d):
    """Held-out scores, cross-fitted scores and validation rows, as parts of the patches."""
    rows = patch_scores(spark, d)
    clean = rows.filter("NOT is_defect")
    return clean.filter("image_id % 2 = 0"), clean.filter("image_id % 2 = 1"), rows


CAL = f"""{PS}, t AS (SELECT quantile_cont(score, 0.99) FILTER (image_id % 2 = 0) AS tau_accept, count(*) FILTER (image_id % 2 = 0) AS n_accept, quantile_cont(score, 0.75) FILTER (image_id % 2 = 1) AS tau_query, count(*) FILTER (image_id % 2 = 1) AS n_query FROM ps WHERE NOT is_defect),
x AS (SELECT count(*) FILTER (is_defect AND score >= tau_query) AS tp, count(*) FILTER (NOT is_defect AND score >= tau_query) AS fp, count(*) FILTER (is_defect AND score < tau_query) AS fn, count(*) FILTER (NOT is_defect AND score < tau_query) AS tn FROM ps, t)"""


@query(f"""WITH {CAL}, {curve_sql('ps')}, k AS (SELECT {RANK} FROM c) SELECT round(tau_accept, 6) AS tau_accept, n_accept, round(tau_query, 6) AS tau_query, n_query, tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision,
round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, tp + fn AS n_gt_pos, tp + fp AS n_pred_pos, f1_threshold AS f1_max_threshold, f1_max FROM x, t, k""")
def calibration_report(spark, d):
    row = reports.calibration_row(*calibration_parts(spark, d), query_level=75.0)
    names = ["tau_accept", "n_accept", "tau_query", "n_query", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "n_gt_pos", "n_pred_pos", "f1_max_threshold", "f1_max"]
    return show(row.select(*names), "tau_accept", "tau_query", "precision", "recall", "f1", "f1_max")


@query(f"""WITH {PS}, x AS (SELECT 'held_out' AS part, score FROM ps WHERE NOT is_defect AND image_id % 2 = 0 UNION ALL SELECT 'clean_calibration', score FROM ps WHERE NOT is_defect AND image_id % 2 = 1 UNION ALL SELECT 'validation_all', score FROM ps
 UNION ALL SELECT 'validation_positive', score FROM ps WHERE is_defect UNION ALL SELECT 'validation_negative', score FROM ps WHERE NOT is_defect),
q AS (SELECT part, quantile_cont(score, [0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.995, 1]) AS v FROM x GROUP BY 1)
SELECT part, unnest(['p0', 'p1', 'p5', 'p25', 'p50', 'p75', 'p95', 'p99', 'p99.5', 'p100']) AS level, round(unnest(v), 6) + 0.0 AS value FROM q""")
def calibration_quantiles(spark, d):
    row = reports.calibration_row(*calibration_parts(spark, d), query_level=75.0)
    names = [c for c in row.columns if c.startswith("quantiles_")]
    long = row.select(F.explode(F.create_map(*[x for c in names for x in (F.lit(c.removeprefix("quantiles_")), F.col(c))])).alias("part", "m"))
    return long.select("part", F.explode("m").alias("level", "value")).withColumn("value", shown(F.col("value")))


@query(f"""WITH {PF}, tk AS (SELECT image_id, features AS cls FROM pf WHERE row = 0 AND col = 0),
s AS (SELECT 'patch_l2' AS scorer, round(sqrt(list_inner_product(features, features)), 6) AS score, is_defect FROM pf UNION ALL
 SELECT 'cls_patch_cosine', round(list_inner_product(features, cls) / ((sqrt(list_inner_product(features, features)) + 1e-8) * (sqrt(list_inner_product(cls, cls)) + 1e-8)), 6), is_defect FROM pf JOIN tk USING (image_id)),
{curve_sql('s', 'scorer')}, k AS (SELECT scorer, {RANK} FROM c GROUP BY scorer), m AS (SELECT scorer, count(*) AS n, round(avg(score), 6) AS healthy_mean FROM s WHERE NOT is_defect GROUP BY 1) SELECT scorer, 0 AS layer, auroc, n, healthy_mean FROM k JOIN m USING (scorer)""")
def scorer_analysis(spark, d):
    rows = patch_features(spark, d)
    inputs = {"patches": rows, "cls": class_tokens(spark, d)}
    scores = scorers.score_layers({0: inputs}, ["patch_l2", "cls_patch_cosine"]).withColumn("score", shown(F.col("score")))
    spread, apart = scorers.analysis(scores, rows.select("image_id", "row", "col", "is_defect"))
    healthy = spread.filter("NOT is_defect").select("scorer", "layer", "n", shown(F.col("mean")).alias("healthy_mean"))
    return apart.select("scorer", "layer", shown(F.col("auroc")).alias("auroc")).join(healthy, ["scorer", "layer"])


@query()
def reference_plan(spark, d):
    images = written(image_meta(spark, d).select("image_id", "has_defect"), "images")
    members = patch_features(spark, d).filter("class_id > 0").select("image_id", "class_id").distinct()
    folds = written(sampling.hash_folds(images, 5, 42, keep=["has_defect"]), "folds")
    spent(images)
    return references.reference_plan(folds.filter("fold <> 0").drop("fold"), folds.filter("fold = 0"), members, "contaminated_all", 42, 2, 4)


@query(f"WITH {PF} SELECT vec_id AS id, vec_id % 7 = 0 AS keep FROM pf")
def keep_mask(spark, d):
    rows = patch_features(spark, d).select(F.col("vec_id").alias("id"))
    return bank.keep_mask(rows, rows.filter("id % 7 = 0"))

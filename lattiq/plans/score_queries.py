"""Queries over patch scores: confusion, ranking, thresholds, separability, image and region metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import ratio0, shown
from ..operators import bank, calibration, ranking
from ..sources.tables import event_scores, patch_scores
from .registry import EV, PS, query, rounded

CONF = "count(*) FILTER (is_defect AND score >= 0.7) AS tp, count(*) FILTER (NOT is_defect AND score >= 0.7) AS fp, count(*) FILTER (is_defect AND score < 0.7) AS fn, count(*) FILTER (NOT is_defect AND score < 0.7) AS tn"
PRF = "round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1"
CURVE = """g AS (SELECT {k} score, count(*) FILTER (is_defect) AS pos, count(*) FILTER (NOT is_defect) AS neg FROM {t} GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER ({p} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)::DOUBLE AS tp, sum(neg) OVER ({p} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)::DOUBLE AS fp,
 sum(pos) OVER ({p2})::DOUBLE AS p, sum(neg) OVER ({p2})::DOUBLE AS n FROM g)"""


def curve_sql(table: str = "ps", key: str = "") -> str:
    return CURVE.format(t=table, k=f"{key}," if key else "", p=f"PARTITION BY {key}" if key else "", p2=f"PARTITION BY {key}" if key else "")


RANK = """round(sum(neg * (tp - pos + pos / 2.0)) / nullif(max(p) * max(n), 0), 6) AS auroc, round(sum(pos * tp / (tp + fp)) / nullif(max(p), 0), 6) AS average_precision,
round(max(coalesce(2 * tp / nullif(2 * tp + fp + p - tp, 0), 0)), 6) AS f1_max, arg_max(score, (coalesce(2 * tp / nullif(2 * tp + fp + p - tp, 0), 0), score)) AS f1_threshold, max(p)::BIGINT AS n_pos, max(n)::BIGINT AS n_neg"""


def positive():
    return F.col("score") >= 0.7


def show(df, *names):
    return df.withColumns({n: shown(F.col(n)) for n in names})


@query(f"WITH {PS} SELECT {CONF} FROM ps WHERE valid")
def confusion(spark, d):
    return ranking.confusion(ranking.usable(patch_scores(spark, d), valid="valid"), F.col("is_defect"), positive())


@query(f"WITH {PS} SELECT tp, fp, fn, tn, {PRF} FROM (SELECT {CONF} FROM ps)")
def prf_global(spark, d):
    return show(ranking.with_prf(ranking.confusion(patch_scores(spark, d), F.col("is_defect"), positive())), "precision", "recall", "f1")


@query(f"WITH {PS} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM (SELECT tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM (SELECT image_id, {CONF} FROM ps GROUP BY image_id))")
def prf_image_mean(spark, d):
    per = ranking.with_prf(ranking.confusion(patch_scores(spark, d), F.col("is_defect"), positive(), ["image_id"]))
    return show(ranking.macro(per), "precision", "recall", "f1")


@query(f"WITH {PS}, x AS (SELECT class_id, * EXCLUDE class_id FROM ps UNION ALL SELECT -1, * EXCLUDE class_id FROM ps) SELECT class_id, tp, fp, fn, tn, {PRF} FROM (SELECT class_id, {CONF} FROM x GROUP BY class_id)")
def prf_class(spark, d):
    rows = ranking.grouped_prf(patch_scores(spark, d), F.col("is_defect"), positive(), "class_id", overall=-1)
    return show(rows, "precision", "recall", "f1")


@query(f"WITH {PS}, {curve_sql()} SELECT round(sum(neg * (tp - pos + pos / 2.0)) / (max(p) * max(n)), 6) AS auroc FROM c")
def auroc(spark, d):
    return show(ranking.ranking(patch_scores(spark, d)).select("auroc"), "auroc")


@query(f"WITH {PS}, {curve_sql()} SELECT round(sum(pos * tp / (tp + fp)) / max(p), 6) AS average_precision FROM c")
def average_precision(spark, d):
    return show(ranking.ranking(patch_scores(spark, d)).select("average_precision"), "average_precision")


@query(f"WITH {PS}, {curve_sql()} SELECT {RANK} FROM c")
def ranking_bundle(spark, d):
    return show(ranking.ranking(patch_scores(spark, d)), "auroc", "average_precision", "f1_max")


@query(f"WITH {PS}, y AS (SELECT k.class_id, score, is_defect AND ps.class_id = k.class_id AS is_defect FROM ps, (VALUES (1), (2), (3), (4)) k(class_id)), {curve_sql('y', 'class_id')} SELECT class_id, {RANK} FROM c GROUP BY class_id")
def ranking_per_class(spark, d):
    rows = patch_scores(spark, d).select(F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("k"), "score", "class_id")
    rows = rows.select(F.col("k").alias("class_id"), "score", (F.col("class_id") == F.col("k")).alias("is_defect"))
    return show(ranking.ranking(rows, keys=["class_id"]), "auroc", "average_precision", "f1_max")


@query(f"WITH {PS} SELECT DISTINCT round(unnest(list_concat(quantile_cont(score, [i / 39.0 for i in range(40)]), [min(score) + (max(score) - min(score)) * i / 79.0 for i in range(80)])), 6) AS threshold FROM ps")
def threshold_grid(spark, d):
    return ranking.threshold_grid(patch_scores(spark, d)).select(shown(F.col("threshold")).alias("threshold")).distinct()


GRID = "grid AS (SELECT unnest([i / 20.0 for i in range(27)]) AS threshold)"
SWEEP = f"s AS (SELECT threshold, count(*) FILTER (is_defect AND score >= threshold) AS tp, count(*) FILTER (NOT is_defect AND score >= threshold) AS fp, count(*) FILTER (is_defect AND score < threshold) AS fn, count(*) FILTER (NOT is_defect AND score < threshold) AS tn FROM ps, grid GROUP BY threshold)"


def even_grid(spark):
    return spark.range(27).select((F.col("id") / 20.0).alias("threshold"))


@query(f"WITH {PS}, {GRID}, {SWEEP} SELECT threshold, tp, fp, fn, tn, {PRF} FROM s")
def threshold_sweep(spark, d):
    return show(ranking.sweep(patch_scores(spark, d), even_grid(spark)), "precision", "recall", "f1")


@query(f"WITH {PS}, {GRID}, {SWEEP}, f AS (SELECT threshold, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM s WHERE tp > 0) SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def f1_grid(spark, d):
    return show(ranking.grid_f1(ranking.sweep(patch_scores(spark, d), even_grid(spark))), "f1")


@query(f"WITH {PS}, {GRID}, {SWEEP} SELECT min(threshold) AS threshold, max(threshold) AS max_threshold FROM s WHERE tp / (tp + fn)::DOUBLE >= 0.9")
def recall_at(spark, d):
    return ranking.recall_at(ranking.sweep(patch_scores(spark, d), even_grid(spark)), 0.9)


@query(f"WITH {PS}, {curve_sql()} SELECT round(max(2 * tp / (2 * tp + fp + p - tp)), 6) AS f1, arg_max(score, (2 * tp / (2 * tp + fp + p - tp), score)) AS threshold FROM c")
def f1_exact(spark, d):
    return show(ranking.ranking(patch_scores(spark, d)).select(F.col("f1_max").alias("f1"), F.col("f1_threshold").alias("threshold")), "f1")


@query(f"WITH {PS}, grid AS (SELECT unnest([i / 100.0 for i in range(101)]) AS threshold), {SWEEP}, f AS (SELECT threshold, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM s) SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, threshold <> 0.5, threshold LIMIT 1")
def probability_sweep(spark, d):
    return show(ranking.probability_sweep(patch_scores(spark, d)), "f1")


@query(f"WITH {PS}, t AS (SELECT quantile_cont(score, 0.99) AS thr FROM ps WHERE NOT is_defect) SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, tp + fn AS n_gt_pos, tp + fp AS n_pred_pos FROM (SELECT count(*) FILTER (is_defect AND score >= thr) AS tp, count(*) FILTER (NOT is_defect AND score >= thr) AS fp, count(*) FILTER (is_defect AND score < thr) AS fn, count(*) FILTER (NOT is_defect AND score < thr) AS tn FROM ps, t)")
def fixed_threshold(spark, d):
    rows = patch_scores(spark, d)
    limit = calibration.threshold_at(rows.filter(~F.col("is_defect")), 99.0)
    return show(ranking.fixed_threshold(rows.crossJoin(F.broadcast(limit)), F.col("threshold")), "precision", "recall", "f1")


SEP = f"""{PS}, g AS (SELECT score, count(*) FILTER (is_defect) AS pos, count(*) FILTER (NOT is_defect) AS neg FROM ps GROUP BY score),
c AS (SELECT score, sum(pos) OVER w / (sum(pos) OVER ())::DOUBLE AS cp, sum(neg) OVER w / (sum(neg) OVER ())::DOUBLE AS cn, lead(score) OVER (ORDER BY score) - score AS step FROM g WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {PS} SELECT round((avg(score) FILTER (is_defect) - avg(score) FILTER (NOT is_defect)) / sqrt(((count(*) FILTER (is_defect) - 1) * var_samp(score) FILTER (is_defect) + (count(*) FILTER (NOT is_defect) - 1) * var_samp(score) FILTER (NOT is_defect)) / (count(*) - 2)), 6) AS cohens_d FROM ps")
def cohens_d(spark, d):
    return show(ranking.cohens_d(patch_scores(spark, d)), "cohens_d")


@query(f"WITH {SEP} SELECT round(max(abs(cp - cn)), 6) AS ks FROM c")
def ks_statistic(spark, d):
    return show(ranking.gaps(patch_scores(spark, d)).select("ks"), "ks")


@query(f"WITH {SEP} SELECT round(sum(abs(cp - cn) * step), 6) AS wasserstein FROM c")
def wasserstein(spark, d):
    return show(ranking.gaps(patch_scores(spark, d)).select("wasserstein"), "wasserstein")


@query(f"WITH {EV} SELECT is_defect, count(*) AS n, {rounded('mean', 'std', 'median', 'min', 'max', 'p5', 'p95')} FROM (SELECT is_defect, score, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS std, median(score) OVER w AS median, min(score) OVER w AS min, max(score) OVER w AS max, quantile_cont(score, 0.05) OVER w AS p5, quantile_cont(score, 0.95) OVER w AS p95 FROM ev WINDOW w AS (PARTITION BY is_defect)) GROUP BY ALL")
def distribution_summary(spark, d):
    return show(ranking.distribution(event_scores(spark, d), keys=["is_defect"]), "mean", "std", "median", "min", "max", "p5", "p95")


@query(f"WITH {PS} SELECT unnest(['p1', 'p5', 'p10', 'p25', 'p50', 'p75', 'p90', 'p95', 'p99', 'p99.5']) AS level, round(unnest(quantile_cont(score, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.995])), 6) AS value FROM ps")
def score_quantiles(spark, d):
    return ranking.quantile_map(patch_scores(spark, d)).select(F.explode("quantiles").alias("level", "value")).withColumn("value", shown(F.col("value")))


QUAL = "count(*) AS n, count(*) FILTER (t) AS n_anomalous, count(*) FILTER (NOT t) AS n_normal, count(*) FILTER (r) AS n_rejected, count(*) FILTER (NOT r) AS n_kept, count(*) FILTER (t AND r) AS anomalous_rejected, count(*) FILTER (t AND NOT r) AS anomalous_kept, count(*) FILTER (NOT t AND r) AS normal_rejected, count(*) FILTER (NOT t AND NOT r) AS normal_kept"
QUAL2 = "round(coalesce(normal_kept / nullif(n_normal, 0)::DOUBLE, 0), 6) AS normal_retention, round(coalesce(anomalous_rejected / nullif(n_anomalous, 0)::DOUBLE, 0), 6) AS anomaly_recall, round(coalesce(anomalous_rejected / nullif(n_rejected, 0)::DOUBLE, 0), 6) AS rejected_precision, round(coalesce(anomalous_kept / nullif(n_kept, 0)::DOUBLE, 0), 6) AS contamination"
RATES = ("normal_retention", "anomaly_recall", "rejected_precision", "contamination")


@query(f"WITH {PS}, x AS (SELECT class_id, is_defect AS t, score > 0.8 AS r FROM ps), y AS (SELECT k, t AND (k = 0 OR class_id = k) AS t, r FROM x, (VALUES (0), (1), (2), (3), (4)) c(k) WHERE NOT t OR k = 0 OR class_id = k) SELECT *, {QUAL2} FROM (SELECT k, {QUAL} FROM y GROUP BY k)")
def purification_quality(spark, d):
    rows = patch_scores(spark, d).select("is_defect", "class_id", "score", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("k"))
    rows = rows.filter(~F.col("is_defect") | (F.col("k") == 0) | (F.col("class_id") == F.col("k")))  # normals are normal for every class
    return show(bank.rejection_quality(rows, F.col("is_defect"), F.col("score") > 0.8, ("k",)), *RATES)


@query(f"WITH {PS} SELECT least(floor(least(score, 1) * 10), 9)::INTEGER AS bin, count(*) AS n FROM ps WHERE score > 0 GROUP BY 1")
def overlap_histogram(spark, d):
    return bank.overlap_distribution(patch_scores(spark, d).withColumn("overlap", F.least("score", F.lit(1.0))))


@query(f"WITH {PS}, x AS (SELECT unnest(['any', 'ratio_10', 'ratio_50']) AS rule, least(score - 0.3, 1) AS o FROM ps) SELECT rule, count(*) AS n, count(*) FILTER (CASE rule WHEN 'any' THEN o > 0 WHEN 'ratio_10' THEN o >= 0.1 ELSE o >= 0.5 END) AS removed, round(count(*) FILTER (CASE rule WHEN 'any' THEN o > 0 WHEN 'ratio_10' THEN o >= 0.1 ELSE o >= 0.5 END) / count(*)::DOUBLE, 6) AS rate FROM x GROUP BY rule")
def oracle_rules(spark, d):
    rows = patch_scores(spark, d).withColumn("o", F.least(F.col("score") - 0.3, F.lit(1.0)))
    facts = rows.agg(F.count("*").alias("n"), *[F.count_if(bank.overlap_rule(F.col("o"), r)).alias(r) for r in ("any", "ratio_10", "ratio_50")])
    long = facts.unpivot(["n"], ["any", "ratio_10", "ratio_50"], "rule", "removed")
    return long.select("rule", "n", "removed", shown(ratio0(F.col("removed"), F.col("n"))).alias("rate"))


@query(f"WITH {PS}, x AS (SELECT b.level, truth.rule, CASE truth.rule WHEN 'any' THEN score - 0.3 > 0 WHEN 'ratio_10' THEN score - 0.3 >= 0.1 ELSE score - 0.3 >= 0.5 END AS t, score > b.level AS r FROM ps, (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) b(level), (VALUES ('any'), ('ratio_10'), ('ratio_50')) truth(rule)) SELECT *, {QUAL2} FROM (SELECT level, rule, {QUAL} FROM x GROUP BY ALL)")
def multi_bank(spark, d):
    rows = patch_scores(spark, d).select("score", F.explode(F.array(F.lit(0.5), F.lit(0.9))).alias("level"))
    rows = rows.select("*", F.explode(F.array(*[F.lit(r) for r in ("any", "ratio_10", "ratio_50")])).alias("rule"))
    o = F.col("score") - 0.3
    truth = F.when(F.col("rule") == "any", o > 0).when(F.col("rule") == "ratio_10", o >= 0.1).otherwise(o >= 0.5)
    return show(bank.rejection_quality(rows, truth, F.col("score") > F.col("level"), ("level", "rule")), *RATES)


@query(f"WITH {PS}, i AS (SELECT image_id, count(*) FILTER (is_defect AND score >= 0.7) AS tp, count(*) FILTER (NOT is_defect AND score >= 0.7) AS fp, count(*) FILTER (is_defect AND score < 0.7) AS fn FROM ps GROUP BY 1) SELECT round(avg(tp / nullif(tp + fp + fn, 0)::DOUBLE), 6) AS iou, round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE), 6) AS dice, round(sum(tp) / sum(tp + fp + fn)::DOUBLE, 6) AS pooled_iou FROM i")
def iou_dice(spark, d):
    per = ranking.overlap_metrics(ranking.confusion(patch_scores(spark, d), F.col("is_defect"), positive(), ["image_id"]))
    out = per.agg(F.avg("iou").alias("iou"), F.avg("dice").alias("dice"), F.try_divide(F.sum("tp"), F.sum(F.col("tp") + F.col("fp") + F.col("fn"))).alias("pooled_iou"))
    return show(out, "iou", "dice", "pooled_iou")


PRO = f"""{PS}, z AS (SELECT score, CASE WHEN is_defect THEN image_id * 10 + class_id END AS region FROM ps), sz AS (SELECT region, count(*) AS size FROM z WHERE region IS NOT NULL GROUP BY 1),
g AS (SELECT score, coalesce(sum(1.0::DOUBLE / size), 0) AS gain, count(*) FILTER (z.region IS NULL) AS ok FROM z LEFT JOIN sz USING (region) GROUP BY score),
p AS (SELECT least(sum(ok) OVER w / (SELECT count(*) FROM z WHERE region IS NULL)::DOUBLE, 1) AS fpr, least(sum(gain) OVER w / (SELECT count(*) FROM sz), 1) AS pro FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
 UNION ALL SELECT 0, 0 UNION ALL SELECT 1, 1)"""


def regions(spark, d):
    return patch_scores(spark, d).select("score", F.when(F.col("is_defect"), F.col("image_id") * 10 + F.col("class_id")).alias("region"))


@query(f"WITH {PRO} SELECT round(fpr, 6) AS fpr, round(pro, 6) AS pro FROM p")
def pro_curve(spark, d):
    return show(ranking.pro_curve(regions(spark, d)), "fpr", "pro")


@query(f"WITH {PRO}, s AS (SELECT lag(fpr) OVER w AS x0, lag(pro) OVER w AS y0, fpr AS x1, pro AS y1 FROM p WINDOW w AS (ORDER BY fpr, pro)) SELECT round(sum((least(x1, 0.3) - x0) * (y0 + CASE WHEN x1 <= 0.3 THEN y1 ELSE y0 + (y1 - y0) * (0.3 - x0) / (x1 - x0) END) / 2) / 0.3, 6) AS area FROM s WHERE x0 IS NOT NULL AND x0 < 0.3")
def au_pro(spark, d):
    return show(ranking.pro_area(regions(spark, d), 0.3), "area")


def top_sql(share: float) -> str:
    return f"{EV}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC) AS n, count(*) OVER (PARTITION BY image_id) AS m FROM ev), im AS (SELECT image_id, avg(score) FILTER (n <= greatest(floor(m * {share}), 1)) AS top_mean, max(score) AS top, bool_or(is_defect) AS is_defect FROM r GROUP BY 1)"


@query(f"WITH {top_sql(0.01)} SELECT image_id, round(top_mean, 6) AS top_mean, top, is_defect FROM im")
def top1p_score(spark, d):
    return show(ranking.image_scores(event_scores(spark, d)), "top_mean")


@query(f"WITH {top_sql(0.05)}, f AS (SELECT round(top_mean, 6) AS score, top >= 95 AS is_defect FROM im), {curve_sql('f')} SELECT {RANK} FROM c")
def image_classification(spark, d):
    per = ranking.image_scores(event_scores(spark, d), share=0.05).select(F.round("top_mean", 6).alias("score"), (F.col("top") >= 95).alias("is_defect"))
    return show(ranking.ranking(per), "auroc", "average_precision", "f1_max")


@query(f"WITH {EV}, m AS (SELECT image_id, avg(score) AS a, stddev_pop(score) AS s FROM ev GROUP BY 1) SELECT event_id, round((score - a) / (s + 1e-8), 6) + 0.0 AS z FROM ev JOIN m USING (image_id)")
def zscore_image(spark, d):
    return show(calibration.z_score(event_scores(spark, d)).select("event_id", "z"), "z")


@query(f"WITH {EV}, m AS (SELECT image_id, quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.75) AS b FROM ev GROUP BY 1) SELECT event_id, round((score - b) / (b - a + 1e-8) / 1.5, 6) + 0.0 AS iqr_score FROM ev JOIN m USING (image_id)")
def iqr_image(spark, d):
    return show(calibration.iqr_score(event_scores(spark, d)).select("event_id", "iqr_score"), "iqr_score")


@query(f"WITH {EV}, m AS (SELECT image_id, quantile_cont(score, 0.95) AS p, max(score) AS t FROM ev GROUP BY 1) SELECT event_id, round(coalesce(greatest(score - p, 0) / nullif(greatest(t - p, 0), 0), 0), 6) + 0.0 AS percentile_score FROM ev JOIN m USING (image_id)")
def percentile_image(spark, d):
    return show(calibration.percentile_score(event_scores(spark, d)).select("event_id", "percentile_score"), "percentile_score")


@query(f"""WITH {EV}, m AS (SELECT avg(score) AS a, stddev_pop(score) AS s FROM ev WHERE NOT is_defect), v AS (SELECT event_id, image_id, (score - a) / (s + 1e-8) AS v FROM ev, m),
p AS (SELECT image_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.95) AS t, max(v) AS top FROM v GROUP BY 1),
r AS (SELECT event_id, unnest(['raw', 'zscore', 'iqr', 'percentile']) AS mode,
 unnest([v, v, (v - q3) / (q3 - q1 + 1e-8) / 1.5, coalesce(greatest(v - t, 0) / nullif(greatest(top - t, 0), 0), 0)]) AS x FROM v JOIN p USING (image_id)) SELECT event_id, mode, round(x, 6) + 0.0 AS mode_score FROM r""")
def calibrated(spark, d):
    """All modes on scores calibrated by the normal events."""
    rows = event_scores(spark, d)
    facts = calibration.stats(rows.filter(~F.col("is_defect")))
    out = None
    for mode in ("raw", "zscore", "iqr", "percentile"):
        one = calibration.score_mode(rows, mode, facts).select("event_id", F.lit(mode).alias("mode"), "mode_score")
        out = one if out is None else out.unionByName(one)
    return show(out, "mode_score")


@query(f"WITH {EV} SELECT round(avg(score) FILTER (is_defect), 6) AS positive, round(avg(score) FILTER (NOT is_defect), 6) AS negative, avg(score) FILTER (is_defect) >= avg(score) FILTER (NOT is_defect) AS ok FROM ev")
def polarity_check(spark, d):
    return show(ranking.polarity(event_scores(spark, d)), "positive", "negative")

"""Reports that bring several metrics together: patch evaluation, ranking, region overlap, calibration."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import knn_scores
from .order import percentiles
from .ranking import confusion, fixed_threshold, grid_f1, pro_area, ranking, ranking_of, sweep, threshold_grid, usable, with_prf
from .shared import written

CELL = ("image_id", "row", "col")
#: Percentiles of a calibration report, its methods and its exclusion modes.
LEVELS = (0.0, 1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0, 99.5, 100.0)
EXCLUSION = ("leave_one_image_out", "leave_one_patch_out", "spatial_block_exclusion")


def labelled(scores: DataFrame, labels: DataFrame, valid: str | None = None) -> DataFrame:
    """Scores of grid cells with the ground truth of the same cells: ``labels`` has (image_id, row, col, class_id, positive), class 0
    being any defect. Cells that ``valid`` marks false are left out."""
    rows = scores.filter(F.coalesce(F.col(valid), F.lit(True))) if valid else scores
    return rows.join(labels, list(CELL))


def evaluate_patches(scores: DataFrame, labels: DataFrame, threshold: float, valid: str | None = None, class_scores: str | None = None) -> DataFrame:
    """One row per class (0: any defect): counts over all images with their precision, recall and F1, and the means over images
    of the known values. A patch is predicted where its score reaches the threshold, or, with a map column
    ``class_scores``, its score for the class; without one, classes are held against the common score."""
    rows = labelled(scores, labels, valid)
    own = F.col("score")
    if class_scores:
        own = F.when(F.col("class_id") > 0, F.try_element_at(class_scores, F.col("class_id"))).otherwise(own)
    per = with_prf(confusion(rows, F.col("positive"), F.coalesce(own >= threshold, F.lit(False)), ["class_id", "image_id"]))
    sums = per.groupBy("class_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], F.count("*").alias("images"), *[F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall", "f1")])
    return with_prf(sums)


def ranking_report(df: DataFrame, threshold: float | None = None, score: str = "score", label: str = "is_defect", grid: int = 80) -> DataFrame:
    """One row: AUROC, average precision, the best F1 of the threshold grid with its threshold, precision and recall, and metrics
    at a fixed threshold (the grid's, if none is given) with zeros on empty denominators."""
    rows = usable(df, score)
    swept = sweep(rows, threshold_grid(rows, score, grid), score, label)
    best = grid_f1(swept).select(F.col("threshold").alias("grid_threshold"))
    at = swept.join(F.broadcast(best), F.col("threshold") == F.col("grid_threshold")).select("grid_threshold", *[F.col(c).alias(f"grid_{c}") for c in ("precision", "recall", "f1")])
    one = ranking(rows, score, label).select("auroc", F.col("average_precision").alias("auprc"), "n_pos", "n_neg")
    one = one.join(F.broadcast(at), F.lit(True), "left")
    limit = F.col("__t")
    fixed_rows = rows.crossJoin(F.broadcast(best.select((F.lit(threshold) if threshold is not None else F.col("grid_threshold")).alias("__t"))))
    fixed = fixed_threshold(fixed_rows, limit, score, label).select(*[F.col(c).alias(f"fixed_{c}") for c in ("precision", "recall", "f1")])
    value = F.lit(threshold) if threshold is not None else F.col("grid_threshold")
    return one.crossJoin(fixed).withColumn("fixed_threshold", value)


def region_report(pixels: DataFrame, limit: float = 0.3, score: str = "score", region: str = "region") -> DataFrame:
    """One row: area under the region-overlap curve up to ``limit``, and AUROC and best F1 of pixels."""
    area = pro_area(pixels, limit, score, region).select(F.col("area").alias("au_pro"))
    one = ranking(pixels.withColumn("__p", F.col(region).isNotNull()), score, "__p")
    return area.crossJoin(one.select(F.col("auroc").alias("pixel_auroc"), F.col("f1_max").alias("pixel_f1")))


def cross_fit_both(clean: DataFrame, final: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Scores of each clean patch against the clean bank and the final bank, both without the patch's own image. The final bank
    must hold every clean image, and there must be two."""
    if clean.select("image_id").distinct().limit(2).count() < 2:
        raise ValueError("cross-fitting needs two clean images")
    if not clean.select("image_id").distinct().join(final.select("image_id"), "image_id", "left_anti").isEmpty():
        raise ValueError("every clean image must be in the final bank")
    own = lambda rows: rows.withColumn("grp", F.col("image_id"))
    return knn_scores(own(clean), own(clean), **how), knn_scores(own(clean), own(final), **how)


#: The score tables of a report of which percentile maps are given.
PARTS = ("held_out", "clean_calibration", "validation_all", "validation_positive", "validation_negative")


def calibration_row(held_out: DataFrame, cross_fitted: DataFrame, validation: DataFrame, accept_level: float = 99.0, query_level: float = 99.5, valid: str | None = None, levels: Sequence[float] = LEVELS) -> DataFrame:
    """One row: the acceptance threshold (a percentile of ``held_out`` scores), the query threshold (of ``cross_fitted`` scores),
    confusion and metrics of ``validation`` (score, is_defect) at the latter, its exact best F1 with threshold (the highest of
    equals), and percentile maps. Validation labels have no part in either threshold. ``calibration_report`` refuses the row of
    an empty validation.

    The scores behind it are computed once: all tables are collapsed to (part, score, pos, neg) in one shuffle and written to
    the shared folder; thresholds and maps are one keyed search for percentiles, and the curve is read from the same table.
    """
    tables = zip(PARTS[:3], (usable(held_out), usable(cross_fitted), usable(validation, valid=valid)))
    label = {"validation_all": F.col("is_defect")}
    rows = None
    for name, table in tables:
        one = table.select(F.lit(name).alias("part"), F.col("score").cast("double").alias("score"), label.get(name, F.lit(None).cast("boolean")).alias("is_defect"))
        rows = one if rows is None else rows.unionByName(one)
    groups = rows.groupBy("part", "score").agg(F.count("*").alias("all"), F.count_if("is_defect").alias("pos"), F.count_if(~F.col("is_defect")).alias("neg"))
    groups = written(groups, "calibration")
    share = lambda name, times: F.struct(F.lit(name).alias("map"), F.col(times).alias("times"))
    of_part = F.when(F.col("part") == PARTS[2], F.array(share(PARTS[2], "all"), share(PARTS[3], "pos"), share(PARTS[4], "neg")))
    of_part = of_part.otherwise(F.array(F.struct(F.col("part").alias("map"), F.col("all").alias("times"))))
    spread = groups.select("score", F.inline(of_part)).filter("times > 0")
    ps = percentiles(spread, "score", [accept_level / 100, query_level / 100, *(q / 100 for q in levels)], ["map"], times="times")
    of = lambda m, c: F.first(F.when(F.col("map") == m, c), ignorenulls=True)
    maps = ps.agg(
        of(PARTS[0], F.get("ps", F.lit(0))).alias("tau_accept"),
        of(PARTS[1], F.get("ps", F.lit(1))).alias("tau_query"),
        *[of(m, F.slice("ps", 3, len(levels))).alias(m) for m in PARTS],
    )
    names = F.array(*[F.lit(f"p{q:g}") for q in levels])
    maps = maps.select("tau_accept", "tau_query", *[F.map_from_arrays(names, F.col(m)).alias(f"quantiles_{m}") for m in PARTS])
    sizes = groups.agg(*[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("all"))), F.lit(0)).alias(n) for p, n in zip(PARTS[:2], ("n_accept", "n_query"))])
    val = groups.filter(F.col("part") == PARTS[2]).select("score", "pos", "neg")
    best = ranking_of(val).select(F.col("f1_threshold").alias("f1_max_threshold"), "f1_max")
    row = sizes.crossJoin(F.broadcast(maps)).crossJoin(F.broadcast(best))
    for prefix, at in (("", "tau_query"), ("f1_max_", "f1_max_threshold")):
        over = F.col("score") >= F.col(at)
        one = val.crossJoin(F.broadcast(row.select(at))).agg(
            F.coalesce(F.sum(F.when(over, F.col("pos"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(over, F.col("neg"))), F.lit(0)).alias("fp"),
            F.coalesce(F.sum(F.when(over, 0).otherwise(F.col("pos"))), F.lit(0)).alias("fn"), F.coalesce(F.sum(F.when(over, 0).otherwise(F.col("neg"))), F.lit(0)).alias("tn"),
        )
        one = with_prf(one, zero=True)
        if not prefix:
            one = one.withColumn("n_gt_pos", F.col("tp") + F.col("fn")).withColumn("n_pred_pos", F.col("tp") + F.col("fp"))
        else:
            one = one.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("precision", "recall", "tp", "fp", "fn", "tn")])
        row = row.crossJoin(F.broadcast(one))
    return row


def bank_hash(bank_id: str, *parts: str) -> str:
    """sha256 of a bank's identity, to which a threshold is bound."""
    return hashlib.sha256("\n".join([str(bank_id), *map(str, parts)]).encode()).hexdigest()


def calibration_report(row: DataFrame, clean_bank: str, final_bank: str, parts: Sequence[str] = (), exclusion: str = "leave_one_image_out", accept_level: float = 99.0, query_level: float = 99.5, metadata: dict | None = None) -> dict:
    """The report of one final bank: ``calibration_row`` with provenance, the hash that its query threshold is bound to, and an id
    that is the hash of all of it."""
    if not clean_bank or not final_bank:
        raise ValueError("both banks need an id")
    if exclusion not in EXCLUSION:
        raise ValueError(f"unknown exclusion mode {exclusion}")
    if not (0 <= accept_level <= 100 and 0 <= query_level <= 100):
        raise ValueError("percentiles are between 0 and 100")
    r = row.first().asDict(recursive=True)
    if not r["n_accept"] or not r["n_query"]:
        raise ValueError("calibration needs scores")
    if not r["tp"] + r["fp"] + r["fn"] + r["tn"]:
        raise ValueError("calibration needs validation scores")
    bound = bank_hash(final_bank, *parts)
    report = {
        "final_bank_hash": bound,
        "exclusion_mode": exclusion,
        "candidate_acceptance": {"percentile": accept_level, "threshold": r["tau_accept"], "clean_bank_id": clean_bank, "n_scores": r["n_accept"]},
        "query_operating_point": {"percentile": query_level, "threshold": r["tau_query"], "final_bank_id": final_bank, "final_bank_hash": bound, "bank_stage": "final", "n_scores": r["n_query"]},
        "f1_max_operating_point": {"threshold": r["f1_max_threshold"], "f1": r["f1_max"], **{c: r[f"f1_max_{c}"] for c in ("precision", "recall", "tp", "fp", "fn", "tn")}},
        "counts": {"gt_positive_patches": r["n_gt_pos"], "predicted_positive_patches": r["n_pred_pos"]},
        "fixed_metrics": {c: r[c] for c in ("precision", "recall", "f1")},
        "confusion": {c: r[c] for c in ("tp", "fp", "fn", "tn")},
        "score_quantiles": {k.removeprefix("quantiles_"): v or {} for k, v in r.items() if k.startswith("quantiles_")},
        "safeguards": {"query_threshold_uses_validation_labels": False, "f1_max_is_deployable": False, "candidate_self_exclusion": True, "query_self_exclusion": True},
        "metadata": dict(metadata or {}),
    }
    text = json.dumps(report, sort_keys=True, separators=(",", ":"))
    return {**report, "report_id": hashlib.sha256(text.encode()).hexdigest()}


def check_binding(report: dict, final_bank: str, *parts: str) -> float:
    """The query threshold of a report, if it belongs to this bank and the report is unchanged."""
    body = {k: v for k, v in report.items() if k != "report_id"}
    if hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest() != report.get("report_id"):
        raise ValueError("the report was changed")
    if report["query_operating_point"]["final_bank_hash"] != bank_hash(final_bank, *parts):
        raise ValueError("the threshold belongs to another bank")
    return report["query_operating_point"]["threshold"]

"""Schemas of the data model, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame

SCHEMAS = {
    "images": "image_id string, path string, has_defect boolean, height int, width int",
    "annotations": "image_id string, class_id int, rle string",
    "patch_features": "image_id string, row int, col int, features array<float>, keep boolean",
    "bank": "bank_index long, image_id string, row int, col int, source string, class_id int, features array<float>",
    "patch_scores": "image_id string, row int, col int, score double, valid boolean, class_scores map<int,double>",
    "neighbor_traces": "query_id string, query_rc struct<row:int,col:int>, neighbor_id string, neighbor_rc struct<row:int,col:int>, source string, class_id int, distance double",
    "patch_overlaps": "image_id string, row int, col int, class_id int, overlap double",
    "calibration": "n long, mean double, std double, median double, iqr double, percentiles map<double,double>",
    "layer_features": "image_id string, layer int, row int, col int, features array<float>",
    "cls_tokens": "image_id string, layer int, features array<float>",
    "attention": "image_id string, layer int, head int, q int, k int, w double",
    "sweep": "threshold double, tp long, fp long, fn long, tn long, precision double, recall double, f1 double",
    "folds": "image_id string, fold int",
    "prompts": "image_id string, x1 double, y1 double, x2 double, y2 double",
    "pixel_scores": "image_id string, y int, x int, score double",
    "targets": "image_id string, row int, col int, binary double, multiclass int",
}

#: String enumerations of columns.
SOURCES = ("clean", "additional", "anomalous")
LABEL_RULES = ("center_point", "any_overlap", "overlap_ratio_threshold", "majority_vote")


def empty(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a schema, in order and cast; a missing one is an error."""
    want = empty(df.sparkSession, name).schema
    missing = [f.name for f in want if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in want])


def resolve_layers(spec: str | int | list[int], depth: int) -> list[int]:
    """``last``, ``all``, one layer or a list (negative ones count from the end) as sorted layer numbers."""
    layers = range(depth) if spec == "all" else [depth - 1] if spec == "last" else [spec] if isinstance(spec, int) else spec
    out = sorted({n + depth if n < 0 else n for n in layers})
    if not out or out[0] < 0 or out[-1] >= depth:
        raise ValueError(f"layers {spec} don't fit a depth of {depth}")
    return out

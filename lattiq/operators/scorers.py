"""Analysis scorers by name, and how they separate healthy from defect patches per scorer and layer."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cosine, doubles, norm
from . import grid, maps, ranking
from .fused import cls_rollout

KEYS = ("image_id", "row", "col")
Inputs = Mapping[str, DataFrame]


def _cls_cosine(x: Inputs, how: Mapping) -> DataFrame:
    tokens = x["cls"].select("image_id", doubles(F.col("cls")).alias("cls"))
    return x["patches"].join(tokens, "image_id").select(*KEYS, cosine(F.col("features"), F.col("cls")).alias("score"))


def _patch_l2(x: Inputs, how: Mapping) -> DataFrame:
    return x["patches"].select(*KEYS, norm(F.col("features")).alias("score"))


def _sobel_feature(x: Inputs, how: Mapping) -> DataFrame:
    return grid.sobel_norm(x["patches"], how.get("reduction", "l2")).select(*KEYS, "score")


def _sobel_image(x: Inputs, how: Mapping) -> DataFrame:
    return maps.image_sobel(x["pixels"], how["patch"], how.get("pool", "mean")).select(*KEYS, "score")


def _rollout(x: Inputs, how: Mapping) -> DataFrame:
    return cls_rollout(x["attention"], **{"width": how["width"], **{k: how[k] for k in ("heads", "last_layers", "discard", "residual") if k in how}})


#: Scorers by name: what each reads (``patches``, ``cls``, ``pixels``, ``attention``) and its function.
SCORERS: dict[str, tuple[str, Callable[[Inputs, Mapping], DataFrame]]] = {
    "cls_patch_cosine": ("cls", _cls_cosine), "patch_l2": ("patches", _patch_l2), "sobel_feature": ("patches", _sobel_feature),
    "sobel_image": ("pixels", _sobel_image), "attention_rollout": ("attention", _rollout),
}


def score(name: str, inputs: Inputs, **how) -> DataFrame:
    """(image_id, row, col, score) of a scorer."""
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name}; known: {', '.join(sorted(SCORERS))}")
    needs, f = SCORERS[name]
    if needs not in inputs:
        raise ValueError(f"{name} needs {needs}")
    return f(inputs, how)


def score_layers(layers: Mapping[int, Inputs], names: Sequence[str], settings: Mapping[str, Mapping] | None = None) -> DataFrame:
    """(scorer, layer, image_id, row, col, score) of all scorers and layers; both are short lists."""
    out = None
    for layer, inputs in layers.items():
        for name in names:
            part = score(name, inputs, **(settings or {}).get(name, {})).select(F.lit(name).alias("scorer"), F.lit(layer).alias("layer"), *KEYS, F.col("score").cast("double").alias("score"))
            out = part if out is None else out.unionByName(part)
    return out


def analysis(scores: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per scorer and layer: the distributions of healthy and defect patches, and their separability. ``labels`` has (image_id,
    row, col, is_defect)."""
    rows = scores.join(labels, list(KEYS))
    keys = ["scorer", "layer"]
    return ranking.distribution(rows, keys=[*keys, "is_defect"]), ranking.separability(rows, keys=keys)

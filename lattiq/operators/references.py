"""Reference images of a study: clean ones, additional ones and how a mode puts them together. Tables of images have (image_id,
has_defect), tables of members (image_id, class_id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bank import MODES
from .sampling import circular_pick, class_balanced_pick, id_ranges, pool_pick
from .shared import written

SAMPLING = ("class_balanced", "random_train", "mixed")


def additional_references(train: DataFrame, members: DataFrame, n: int, seed: int, sampling: str = "class_balanced", exclude: DataFrame | None = None, classes: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """``n`` more images of a training fold that are not excluded. ``class_balanced``: the same number of each class, less the
    excluded, topped up from all defect images (seed + 17); ``random_train`` and ``mixed``: of all images."""
    if sampling not in SAMPLING:
        raise ValueError(f"unknown sampling {sampling}; known: {', '.join(SAMPLING)}")
    if n <= 0:
        return train.select("image_id").limit(0)
    if sampling != "class_balanced":
        return pool_pick(train.select("image_id"), n, seed, exclude).select("image_id")
    members = members.join(train.select("image_id"), "image_id", "left_semi")
    first = class_balanced_pick(members, n, classes, seed).select("image_id")
    if exclude is not None:
        first = first.join(exclude.select("image_id"), "image_id", "left_anti")
    missing = n - first.count()
    if missing <= 0:
        return first
    out = first if exclude is None else first.unionByName(exclude.select("image_id"))
    return first.unionByName(pool_pick(train.filter("has_defect"), missing, seed + 17, out).select("image_id"))


def reference_plan(train: DataFrame, validation: DataFrame, members: DataFrame, mode: str, seed: int, clean_shots: int = 2, additional_shots: int = 0, sampling: str = "class_balanced", classes: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """(image_id, part, has_defect, classes): the clean and additional images of a mode, an image of both parts as clean. Fails if
    one of them is in the validation fold, or not in the training fold. ``class_balanced_all`` takes 8 additional ones if
    none are asked for; ``clean`` takes none. The training fold is read once, to be written in ranges of ids, and the picks
    are written."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    train = id_ranges(train, ["has_defect"])
    clean = written(circular_pick(train.filter("NOT has_defect"), clean_shots, seed).select("image_id"), "clean") if clean_shots else train.select("image_id").limit(0)
    if mode == "class_balanced_all":
        more = additional_references(train, members, additional_shots or 8, seed + 1, "class_balanced", clean, classes)
    elif mode == "clean":
        more = clean.limit(0)
    else:
        more = additional_references(train, members, additional_shots, seed + 1, sampling, clean, classes)
    both = clean.withColumn("part", F.lit("clean")).unionByName(more.withColumn("part", F.lit("additional")))
    both = written(both.groupBy("image_id").agg(F.max("part").alias("part")), "references")  # clean comes after additional
    # large tables meet the few references, and never the other way round
    if not validation.join(both, "image_id", "left_semi").isEmpty():
        raise ValueError("reference images are in the validation fold")
    found = written(train.select("image_id", "has_defect").join(both, "image_id").select("image_id", "part", "has_defect"), "references")
    if not both.join(found, "image_id", "left_anti").isEmpty():
        raise ValueError("reference images are not in the training fold")
    known = members.join(both, "image_id", "left_semi").groupBy("image_id").agg(F.sort_array(F.collect_set("class_id")).alias("classes"))
    return found.join(known, "image_id", "left").withColumn("classes", F.coalesce("classes", F.array().cast(known.schema["classes"].dataType)))


def training_ids(train: DataFrame, members: DataFrame, shots: int | None, seed: int, sampling: str = "class_balanced", classes: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Images for supervised training: the whole fold for None; else the same picks as for references (-1: all that can be)."""
    if shots is None:
        return train.select("image_id")
    members = members.join(train.select("image_id"), "image_id", "left_semi")
    if sampling == "defect_free":
        return circular_pick(train.filter("NOT has_defect"), shots, seed).select("image_id")
    if sampling != "class_balanced":
        raise ValueError(f"unknown sampling {sampling}")
    if shots == -1:
        return members.filter(F.col("class_id").isin(*classes)).select("image_id").distinct()
    return class_balanced_pick(members, shots, classes, seed).select("image_id")


def anomalous_pool(members: DataFrame, cap: int | None, seed: int) -> DataFrame:
    """Defect images for an anomaly memory, at most ``cap`` of them (32 or 64 in the surveyed studies)."""
    ids = members.select("image_id").distinct()
    return ids if cap is None else pool_pick(ids, cap, seed).select("image_id")

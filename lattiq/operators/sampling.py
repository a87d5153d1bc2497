"""Deterministic folds, reference picks and manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import code
from .bank import MODES, first_by
from .order import ONE_TASK, first_n, hash_rank, in_ranges, ranked
from .shared import written


def hash_folds(items: DataFrame, k: int, seed: int, label: str | None = None, ident: str = "image_id", keep: Sequence[str] = ()) -> DataFrame:
    """(id, fold) and the columns to keep: folds by hash rank, in each label if given."""
    wanted = dict.fromkeys([ident, *([label] if label else []), *keep])
    ranked = hash_rank(items.select(*wanted), "fold", seed, ident, [label] if label else [])
    return ranked.select(ident, *keep, (F.col("rank") % k).cast("int").alias("fold"))


def id_ranges(items: DataFrame, keep: Sequence[str] = (), ident: str = "image_id") -> DataFrame:
    """Distinct ids (with the columns to keep) as a written table in ranges of ids, ``__part``. Picks take any part of it as it is,
    so several picks of a table sort it once."""
    return in_ranges(items.select(ident, *keep).distinct(), [F.col(ident)])


def _ranges(items: DataFrame, ident: str) -> DataFrame:
    return items.select(ident, "__part") if "__part" in items.columns else id_ranges(items, (), ident)


def _sizes(ids: DataFrame) -> list[tuple[int, int]]:
    """(range, ids) in order, as many as there are ranges."""
    return sorted(tuple(r) for r in ids.groupBy("__part").agg(F.count("*").alias("n")).collect())


def _id_at(ids: DataFrame, sizes: Sequence[tuple[int, int]], place: int, ident: str):
    """The id at a place in order of id; only its range is sorted."""
    for part, n in sizes:
        if place < n:
            inside = F.row_number().over(Window.partitionBy("__part").orderBy(ident))
            return ids.filter(F.col("__part") == part).withColumn("__at", inside).filter(F.col("__at") == place + 1).first()[ident]
        place -= n
    raise IndexError(place)


def _first_from(ids: DataFrame, pivot, count: int, ident: str, name: str) -> DataFrame:
    """``count`` ids in order of id from ``pivot`` on, around the end, numbered from 0: by a top-n where they are few."""
    leads = [(F.col(ident) < F.lit(pivot)).cast("int"), F.col(ident)]
    ids = ids.select(ident)
    if count > ONE_TASK:
        return ranked(ids, leads, name=name).filter(F.col(name) < count)
    return first_n(ids, leads, count).withColumn(name, F.row_number().over(Window.orderBy(*leads)).cast("long") - 1)


def circular_pick(items: DataFrame, count: int, seed: int, ident: str = "image_id", exclude: DataFrame | None = None) -> DataFrame:
    """``count`` ids (all for -1) in order of id from place (seed * count) mod n on, around the end; excluded ids are passed over.
    ``pick`` numbers them from 0."""
    ids = _ranges(items, ident)
    sizes = _sizes(ids)
    n = sum(m for _, m in sizes)
    count = n if count == -1 else count
    if not n or not count:
        return ids.select(ident).limit(0).withColumn("pick", F.lit(0))
    pivot = _id_at(ids, sizes, (seed * count) % n, ident)
    open_ = ids if exclude is None else ids.join(exclude.select(ident), ident, "left_anti")
    return _first_from(open_, pivot, count, ident, "pick").withColumn("pick", F.col("pick").cast("int"))


def pool_pick(pool: DataFrame, count: int, seed: int, exclude: DataFrame | None = None, ident: str = "image_id") -> DataFrame:
    """``count`` ids of what is left of a pool, in order of id from place (seed * count) mod size on, around the end; all, if there
    are no more. ``place`` numbers them."""
    ids = _ranges(pool, ident)
    if exclude is not None:
        ids = ids.join(exclude.select(ident), ident, "left_anti")
    sizes = _sizes(ids) if count > 0 else []
    n = sum(m for _, m in sizes)
    if not n:
        return ids.select(ident).limit(0).withColumn("place", F.lit(0).cast("long"))
    pivot = _id_at(ids, sizes, 0 if count >= n else (seed * count) % n, ident)
    return _first_from(ids, pivot, min(count, n), ident, "place")


def class_balanced_pick(members: DataFrame, shots: int, classes: Sequence[int], seed: int, ident: str = "image_id") -> DataFrame:
    """shots / classes ids per class (seed + class), none twice: classes take turns, and earlier picks are excluded. The classes
    share one table in ranges, and each one's picks are written, as all later ones read them."""
    if shots % len(classes):
        raise ValueError("shots must be a multiple of the number of classes")
    cut = id_ranges(members.filter(F.col("class_id").isin(*classes)), ["class_id"], ident)
    taken = None
    for c in classes:
        picks = circular_pick(cut.filter(F.col("class_id") == c), shots // len(classes), seed + c, ident, taken).select(ident, F.lit(c).alias("class_id"))
        picks = written(picks, "picks")
        taken = picks if taken is None else taken.unionByName(picks)
    return taken


def stable_select(items: DataFrame, n: int, namespace: str, seed: int, ident: str = "image_id") -> DataFrame:
    """n distinct ids by hash rank, ties by id."""
    return first_by(items.select(ident).distinct(), [code(namespace, seed, F.col(ident)), F.col(ident)], n)


def ordered_union(first: DataFrame, second: DataFrame, ident: str = "image_id") -> DataFrame:
    """Ids of both with their least place: the first table's come first."""
    both = first.select(ident, F.lit(0).alias("part")).unionByName(second.select(ident, F.lit(1).alias("part")))
    return both.groupBy(ident).agg(F.min("part").alias("part"))


def few_shot_slice(items: DataFrame, n: int, seed: int, ident: str = "image_id") -> DataFrame:
    """Places seed * n to (seed + 1) * n - 1 in order of id; all for -1; may be empty."""
    if n == -1:
        return items
    return ranked(items, [F.col(ident)], name="__rank").filter((F.col("__rank") >= seed * n) & (F.col("__rank") < (seed + 1) * n)).drop("__rank")


def equalise(items: DataFrame, label: str, seed: int, ident: str = "id") -> DataFrame:
    """As many of each label as the rarest has, by hash rank."""
    least = items.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return first_by(items, [code("equal", seed, F.col(ident)), F.col(ident)], least, [label])


def leakage(parts: Mapping[str, DataFrame], disjoint: Sequence[tuple[str, str]], within: Sequence[tuple[str, str]] = (), ident: str = "image_id") -> DataFrame:
    """One row per rule with the number of ids that break it."""
    out = None
    for kind, rules, how in (("disjoint", disjoint, "left_semi"), ("subset", within, "left_anti")):
        for a, b in rules:
            row = parts[a].select(ident).distinct().join(parts[b].select(ident), ident, how).agg(F.count("*").alias("n")).select(F.lit(f"{a} {kind} {b}").alias("rule"), "n")
            out = row if out is None else out.unionByName(row)
    return out


def same_ids(a: DataFrame, b: DataFrame, ident: str = "image_id") -> DataFrame:
    """Ids that only one of two tables has, with which."""
    left, right = a.select(ident).distinct(), b.select(ident).distinct()
    return left.exceptAll(right).withColumn("only", F.lit("first")).unionByName(right.exceptAll(left).withColumn("only", F.lit("second")))


def manifest(ids: Mapping[str, Sequence[str]], **facts) -> dict:
    """A paired manifest: id lists and facts with a fingerprint of their canonical JSON."""
    body = {"ids": {k: list(v) for k, v in ids.items()}, **facts}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"))
    return {**body, "fingerprint": hashlib.sha256(text.encode()).hexdigest()}


def check_manifest(m: Mapping) -> None:
    """Raises if the manifest was changed, or if its lists leak into each other."""
    body = {k: v for k, v in m.items() if k != "fingerprint"}
    if manifest(body["ids"], **{k: v for k, v in body.items() if k != "ids"})["fingerprint"] != m.get("fingerprint"):
        raise ValueError("the manifest's fingerprint doesn't match")
    ids = {k: set(v) for k, v in m["ids"].items()}
    for a, b in (("clean", "defect"), ("clean", "validation"), ("defect", "validation")):
        if ids.get(a, set()) & ids.get(b, set()):
            raise ValueError(f"{a} and {b} share ids")


def save_manifest(spark: SparkSession, m: Mapping, path: str) -> None:
    """Writes a checked manifest as one line of JSON."""
    check_manifest(m)
    spark.createDataFrame([(json.dumps(m, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_manifest(spark: SparkSession, path: str) -> dict:
    """Reads a manifest; one that was changed or leaks is an error."""
    m = json.loads(spark.read.text(path, wholetext=True).first().value)
    check_manifest(m)
    return m


def manifest_inputs(m: Mapping, mode: str) -> dict[str, list[str]]:
    """The clean and additional ids of a mode: every mode has the same clean ids, only ``clean`` has no others."""
    check_manifest(m)
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; known: {', '.join(MODES)}")
    return {"clean": list(m["ids"].get("clean", [])), "additional": [] if mode == "clean" else list(m["ids"].get("defect", []))}


def bound_hash(ids: DataFrame, ident: str = "image_id", keys: Sequence[str] = ()) -> DataFrame:
    """sha256 of sorted ids joined by newlines, of each key's ids. A bank's ids are few; they are sorted in one place."""
    return ids.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_set(F.col(ident).cast("string"))), "\n").cast("binary"), 256).alias("sha256"))

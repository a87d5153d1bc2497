"""Readers of images, annotations, folds, runs and score bundles. All reading is by Spark, so any file system works."""

from __future__ import annotations

import fnmatch
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import ANNOTATION

#: File endings of images.
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png")
#: Objects of the two public benchmarks with their kinds of anomalies.
ANOMALIES = {
    "mvtec": {
        "bottle": ["broken_large", "broken_small", "contamination"],
        "cable": ["bent_wire", "cable_swap", "combined", "cut_inner_insulation", "cut_outer_insulation", "missing_wire", "missing_cable", "poke_insulation"],
        "capsule": ["crack", "faulty_imprint", "poke", "scratch", "squeeze"],
        "carpet": ["color", "cut", "hole", "metal_contamination", "thread"],
        "grid": ["bent", "broken", "glue", "metal_contamination", "thread"],
        "hazelnut": ["crack", "cut", "hole", "print"],
        "leather": ["color", "cut", "fold", "glue", "poke"],
        "metal_nut": ["bent", "color", "flip", "scratch"],
        "pill": ["color", "combined", "contamination", "crack", "faulty_imprint", "pill_type", "scratch"],
        "screw": ["manipulated_front", "scratch_head", "scratch_neck", "thread_side", "thread_top"],
        "tile": ["crack", "glue_strip", "gray_stroke", "oil", "rough"],
        "toothbrush": ["defective"],
        "transistor": ["bent_lead", "cut_lead", "damaged_case", "misplaced"],
        "wood": ["color", "combined", "hole", "liquid", "scratch"],
        "zipper": ["broken_teeth", "combined", "fabric_border", "fabric_interior", "rough", "split_teeth", "squeezed_teeth"],
    },
    "visa": {o: ["bad"] for o in ("candle", "capsules", "cashew", "chewinggum", "fryum", "macaroni1", "macaroni2", "pcb1", "pcb2", "pcb3", "pcb4", "pipe_fryum")},
}
#: Objects of the first benchmark that are masked, and that are rotated by the informed modes.
MASKED = ("capsule", "hazelnut", "pill", "screw", "toothbrush")
ROTATED = ("hazelnut", "screw")
#: Preprocess modes.
PREPROCESS = (
    "informed", "agnostic", "masking_only", "informed_no_mask", "agnostic_no_mask",
    "force_no_mask_no_rotation", "force_mask_no_rotation", "force_no_mask_rotation", "force_mask_rotation",
)


def discover_images(spark: SparkSession, folder: str) -> DataFrame:
    """``image_id`` (file name) and ``path`` of the images in a folder, by name. Contents aren't read."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return files.select(name.alias("image_id"), "path").filter(ending.isin(*IMAGE_ENDINGS)).orderBy("image_id")


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation CSV (ImageId, ClassId, EncodedPixels); a missing file is an empty table."""
    try:
        return spark.read.csv(path, header=True, schema=ANNOTATION)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ANNOTATION)


def has_rle(rle: Column) -> Column:
    text = F.lower(F.trim(rle))
    return F.coalesce((text != "") & (text != "nan"), F.lit(False))


def class_index(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Sorted classes of every known image (``classes``, empty if none); annotations of other images are ignored."""
    found = annotations.filter(has_rle(F.col("rle"))).groupBy("image_id").agg(F.sort_array(F.collect_set("class_id")).alias("classes"))
    return images.select("image_id").distinct().join(found, "image_id", "left").select("image_id", F.coalesce("classes", F.array().cast("array<int>")).alias("classes"))


def with_defects(images: DataFrame, annotations: DataFrame, class_id: int | None = None) -> DataFrame:
    """Known images with their sorted ``classes`` and ``has_defect``; only those that have ``class_id``, if it is given."""
    rows = class_index(annotations, images).withColumn("has_defect", F.size("classes") > 0)
    return rows if class_id is None else rows.filter(F.array_contains("classes", class_id))


def load_folds(spark: SparkSession, path: str, images: DataFrame | None = None) -> DataFrame:
    """Fold map (JSON object image -> fold) as rows; ids without a fold are an error if ``images`` is given."""
    text = spark.read.text(path, wholetext=True)
    folds = text.select(F.explode(F.from_json("value", "map<string,int>")).alias("image_id", "fold"))
    if images is not None and (n := images.select("image_id").join(folds, "image_id", "left_anti").count()):
        raise ValueError(f"{n} images have no fold")
    return folds


def load_metrics(spark: SparkSession, root: str, fields: Mapping[str, str], exclude: str | None = None) -> DataFrame:
    """One row per ``metrics.json`` below ``root``, with the values at nested paths (``a.b.c``); null where a path is missing.
    Files whose path holds ``exclude`` are skipped."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "metrics.json").text(root, wholetext=True).withColumn("path", F.input_file_name())
    if exclude:
        files = files.filter(~F.contains("path", F.lit(exclude)))
    return files.select("path", *[F.get_json_object("value", f"$.{p}").alias(n) for n, p in fields.items()])


def strict_runs(runs: DataFrame, expected: Mapping[str, object]) -> DataFrame:
    """``runs`` if every row has the expected provenance, else an error; all fields are checked in one pass."""
    if not expected:
        return runs
    counts = runs.agg(*[F.count_if(~F.col(n).eqNullSafe(F.lit(v))).alias(n) for n, v in expected.items()]).first().asDict()
    bad = [n for n in expected if counts[n]]
    if bad:
        raise ValueError(f"runs differ from what is expected in {', '.join(bad)}")
    return runs


def bundles(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    """Score bundles (Parquet) of all glob patterns, each file once, with its path."""
    return spark.read.parquet(*dict.fromkeys(patterns)).withColumn("path", F.input_file_name())


#: Columns of the four kinds of bundles.
BUNDLES = {
    "scores": "image_id string, row int, col int, score double, valid boolean",
    "rejections": "bank string, image_id string, row int, col int, overlap double, score double, rejected boolean",
    "distances": "image_id string, row int, col int, distance double",
    "selection": "bank_index long, image_id string, row int, col int, class_id int, source string",
}


def bundle(spark: SparkSession, patterns: Sequence[str], kind: str) -> DataFrame:
    """Bundles of one kind, with exactly its columns and ``path``. A missing column, one that can't be cast without loss of kind
    (text for a number), or a null in a key (``image_id``, ``row``, ``col``) is an error."""
    if kind not in BUNDLES:
        raise ValueError(f"unknown bundle {kind}; known: {', '.join(BUNDLES)}")
    rows = bundles(spark, patterns)
    want = spark.createDataFrame([], BUNDLES[kind]).schema
    have = {f.name: f.dataType for f in rows.schema}
    missing = [f.name for f in want if f.name not in have]
    if missing:
        raise ValueError(f"a bundle of {kind} lacks {', '.join(missing)}")
    family = lambda t: "text" if isinstance(t, T.StringType) else "flag" if isinstance(t, T.BooleanType) else "number" if isinstance(t, T.NumericType) else t.simpleString()
    wrong = [f.name for f in want if family(have[f.name]) != family(f.dataType)]
    if wrong:
        raise ValueError(f"a bundle of {kind} has other kinds of values in {', '.join(wrong)}")
    keys = [c for c in ("image_id", "row", "col") if c in want.names]
    if not rows.filter(" OR ".join(f"{c} IS NULL" for c in keys)).isEmpty():
        raise ValueError(f"a bundle of {kind} has rows without a place")
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want], "path")


def match_legacy(spark: SparkSession, root: str) -> DataFrame:
    """Test images, their ground-truth masks (null for good ones) and score maps, matched by object, kind and stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = files.select("path", F.regexp_extract("path", r"/([^/]+)/(test|ground_truth|maps)/([^/]+)/([^/]+?)(?:_mask)?\.[^./]+$", 0).alias("all"),
                         *[F.regexp_extract("path", r"/([^/]+)/(test|ground_truth|maps)/([^/]+)/([^/]+?)(?:_mask)?\.[^./]+$", i).alias(n) for i, n in enumerate(("object", "part", "kind", "stem"), 1)])
    parts = parts.filter("all != ''").drop("all")
    key = ["object", "kind", "stem"]
    side = lambda p, n: parts.filter(F.col("part") == p).select(*key, F.col("path").alias(n))
    return side("test", "image").join(side("ground_truth", "mask"), key, "left").join(side("maps", "map"), key, "left")


def registry(spark: SparkSession, preprocess: str = "informed", custom: Mapping[str, Mapping[str, Sequence[str]]] | None = None) -> DataFrame:
    """Objects of each dataset with kinds of anomalies, masking and rotation under a preprocess mode. ``custom`` has other
    datasets (object -> kinds of anomalies), which aren't masked but rotated; the ``force`` modes hold for all."""
    if preprocess not in PREPROCESS:
        raise ValueError(f"unknown preprocess mode {preprocess}")

    def masking(dataset: str, item: str) -> bool:
        if preprocess.startswith("force"):
            return "force_mask" in preprocess
        return not preprocess.endswith("no_mask") and (dataset == "visa" or dataset == "mvtec" and item in MASKED)

    def rotation(dataset: str, item: str) -> bool:
        if preprocess.startswith("force"):
            return not preprocess.endswith("no_rotation")
        if dataset not in ANOMALIES or preprocess.startswith("agnostic"):
            return True
        return preprocess.startswith("informed") and dataset == "mvtec" and item in ROTATED

    rows = [(d, o, list(kinds), masking(d, o), rotation(d, o)) for d, objects in {**ANOMALIES, **(custom or {})}.items() for o, kinds in objects.items()]
    return spark.createDataFrame(rows, "dataset string, object string, anomalies array<string>, masking boolean, rotation boolean")


def custom_objects(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Objects below a folder and the kinds of anomalies of each, from paths ``object/test/kind/image`` (``good`` is none)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = files.select(F.regexp_extract("path", r"/([^/]+)/test/([^/]+)/[^/]+$", 1).alias("object"), F.regexp_extract("path", r"/([^/]+)/test/([^/]+)/[^/]+$", 2).alias("kind"))
    kinds = parts.filter("object != ''").groupBy("object").agg(F.array_sort(F.collect_set(F.when(F.col("kind") != "good", F.col("kind")))).alias("kinds"))
    return {r.object: r.kinds for r in kinds.orderBy("object").collect()}  # folder names


def first_images(images: DataFrame, max_images: int | None) -> DataFrame:
    """The analysis sample: the first images by id."""
    rows = images.orderBy("image_id")
    return rows if max_images is None else rows.limit(max_images)


def layered(base: Mapping, *overrides: Mapping) -> dict:
    """Configuration with later layers on top; None keeps what is below, nested mappings merge."""
    out = dict(base)
    for layer in overrides:
        for k, v in layer.items():
            if isinstance(v, Mapping) and isinstance(out.get(k), Mapping):
                out[k] = layered(out[k], v)
            elif v is not None:
                out[k] = v
    return out


def named(rows: DataFrame, names: Sequence[str], column: str = "name") -> DataFrame:
    """Rows of the given names in the given order; an unknown name is an error."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{column} string, __i int")
    missing = [r[0] for r in wanted.join(rows, column, "left_anti").select(column).collect()]
    if missing:
        raise ValueError(f"unknown: {sorted(missing)}")
    return rows.join(F.broadcast(wanted), column).orderBy("__i").drop("__i")


def matches(name: str, patterns: Sequence[str]) -> bool:
    return any(fnmatch.fnmatch(name, p) for p in patterns)

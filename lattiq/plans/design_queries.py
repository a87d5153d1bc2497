"""Queries over masks, sampling design and study reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import shown
from ..operators import bank, geometry, maps, sampling, study
from ..sources import readers
from ..sources.tables import MASK_SIDE, annotations, event_scores, patch_features, patch_scores, runs, table
from .registry import CAND, EV, PF, PS, RUNS, query, rank_sql
from .score_queries import show

#: Masks of images of 64 by 64 pixels, as text and as pixels.
ANN = """ev0 AS (SELECT user_id AS image_id, (event_id % 4 + 1)::INTEGER AS class_id, floor(abs(value) * 40)::BIGINT % 4000 AS s, event_id % 37 + 1 AS n FROM events),
ann AS (SELECT image_id, class_id, string_agg((s + 1) || ' ' || n, ' ' ORDER BY s, n) AS rle FROM ev0 GROUP BY ALL
 UNION ALL SELECT DISTINCT user_id, 5, CASE user_id % 3 WHEN 1 THEN '' WHEN 2 THEN ' NaN ' END FROM events WHERE user_id % 7 = 0)"""
PX = f"""{ANN}, nums AS (SELECT image_id, class_id, list_transform(string_split(rle, ' '), lambda x: x::BIGINT) AS v FROM ann WHERE class_id < 5),
px AS (SELECT DISTINCT image_id, class_id, unnest(range(a - 1, a - 1 + n)) AS px FROM (SELECT image_id, class_id, v[2 * i + 1] AS a, v[2 * i + 2] AS n FROM (SELECT *, unnest(range(len(v) // 2)) AS i FROM nums)))"""


def masks(spark, d):
    return annotations(spark, d).filter(readers.has_rle(F.col("rle")))


def mask_pixels(spark, d):
    return geometry.rle_pixels(masks(spark, d), MASK_SIDE)


@query(f"WITH {PX} SELECT image_id, class_id, px, px % 64 AS y, px // 64 AS x FROM px")
def rle_decode(spark, d):
    return mask_pixels(spark, d)


@query(f"""WITH {PX}, i AS (SELECT image_id, class_id, px, px - row_number() OVER (PARTITION BY image_id, class_id ORDER BY px) AS island FROM px),
r AS (SELECT image_id, class_id, min(px) + 1 AS s, count(*) AS n FROM i GROUP BY image_id, class_id, island) SELECT image_id, class_id, string_agg(s || ' ' || n, ' ' ORDER BY s) AS rle FROM r GROUP BY ALL""")
def rle_encode(spark, d):
    """Overlapping and touching runs become one."""
    return geometry.rle_encode(mask_pixels(spark, d))


OV = f"""{PX}, n AS (SELECT image_id, class_id, (px % 64) // 8 AS row, (px // 64) // 8 AS col, count(*) / 64.0::DOUBLE AS o FROM px GROUP BY ALL), keys AS (SELECT DISTINCT image_id, class_id FROM px),
ov AS (SELECT image_id, class_id, row, col, coalesce(o, 0) AS overlap FROM keys CROSS JOIN range(8) r(row) CROSS JOIN range(8) c(col) LEFT JOIN n USING (image_id, class_id, row, col))"""


def overlaps(spark, d):
    px = mask_pixels(spark, d)
    return geometry.patch_overlap(px, px, 8, 8, 8)


@query(f"WITH {OV} SELECT image_id, class_id, row, col, round(overlap, 6) AS overlap FROM ov")
def rle_overlap(spark, d):
    return show(overlaps(spark, d), "overlap")


for _rule, _sql in (("any_overlap", "overlap > 0"), ("overlap_ratio_threshold", "overlap >= 0.25"), ("majority_vote", "overlap > 0.5")):
    query(f"WITH {OV} SELECT image_id, class_id, row, col, {_sql} AS label FROM ov", f"patch_label_{_rule}")(
        lambda spark, d, rule=_rule: overlaps(spark, d).select("image_id", "class_id", "row", "col", geometry.patch_label(F.col("overlap"), rule, 0.25).alias("label"))
    )


@query(f"WITH {OV} SELECT ov.image_id, ov.class_id, ov.row, ov.col, c.image_id IS NOT NULL AS label FROM ov LEFT JOIN (SELECT DISTINCT image_id, class_id, (px % 64) // 8 AS row, (px // 64) // 8 AS col FROM px WHERE (px % 64) % 8 = 4 AND (px // 64) % 8 = 4) c USING (image_id, class_id, row, col)")
def patch_label_center(spark, d):
    hits = geometry.center_hits(mask_pixels(spark, d), 8)
    rows = overlaps(spark, d).join(hits, ["image_id", "class_id", "row", "col"], "left")
    return rows.select("image_id", "class_id", "row", "col", geometry.patch_label(F.col("overlap"), "center_point", center=F.col("center")).alias("label"))


@query(f"""WITH {OV}, u AS (SELECT image_id, 0 AS class_id, row, col, least(sum(overlap), 1) AS overlap FROM ov GROUP BY ALL), a AS (SELECT * FROM ov UNION ALL SELECT * FROM u)
SELECT image_id, row, col, max(CASE WHEN class_id = 0 AND overlap >= 0.2 THEN 1.0 ELSE 0.0 END)::DOUBLE AS binary,
 coalesce(arg_max(class_id - 1, (overlap, -class_id)) FILTER (class_id > 0 AND overlap >= 0.2), -1)::INTEGER AS multiclass FROM a GROUP BY ALL""")
def multiclass_target(spark, d):
    rows = overlaps(spark, d)
    union = rows.groupBy("image_id", "row", "col").agg(F.least(F.sum("overlap"), F.lit(1.0)).alias("overlap")).withColumn("class_id", F.lit(0))
    return geometry.multiclass_target(rows.unionByName(union), 0.2)


@query(f"""WITH {PX}, ys AS (SELECT t, floor(t * 64 / 96)::BIGINT AS s FROM range(90) r(t)), xs AS (SELECT t, floor(t * 64 / 80)::BIGINT AS s FROM range(75) r(t))
SELECT image_id, class_id, ys.t AS y, xs.t AS x FROM px JOIN ys ON ys.s = px % 64 JOIN xs ON xs.s = px // 64""")
def mask_resize(spark, d):
    """To 96 rows and 80 columns, of which 90 and 75 stay."""
    return geometry.resized(mask_pixels(spark, d), MASK_SIDE, MASK_SIDE, 96, 80, 90, 75)


SIZE = "sz AS (SELECT p_partkey, (200 + p_size * 20)::BIGINT AS h, 100 + p_partkey * 7 % 1500 AS w FROM part)"


@query(f"""WITH {SIZE}, p AS (SELECT *, CASE WHEN h < w THEN 448 ELSE round_even(h * 448 / w, 0)::BIGINT END AS ph, CASE WHEN h < w THEN round_even(w * 448 / h, 0)::BIGINT ELSE 448 END AS pw FROM sz)
SELECT p_partkey, h AS height, w AS width, ph - ph % 14 AS proc_height, pw - pw % 14 AS proc_width, (ph - ph % 14) // 14 AS grid_rows, (pw - pw % 14) // 14 AS grid_cols FROM p""")
def grid_shape(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (200 + F.col("p_size") * 20).cast("long").alias("height"), (100 + F.col("p_partkey") * 7 % 1500).alias("width"))
    return rows.withColumns(geometry.grid_shape(F.col("height"), F.col("width")))


@query(f"""WITH {ANN}, f AS (SELECT image_id, list_sort(list(DISTINCT class_id)) AS classes FROM ann WHERE lower(trim(rle)) NOT IN ('', 'nan') GROUP BY 1)
SELECT c_custkey AS image_id, coalesce(classes, []) AS classes FROM customer LEFT JOIN f ON image_id = c_custkey""")
def class_index(spark, d):
    """Customers are the known images; users who are none are left out."""
    return readers.class_index(annotations(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("image_id")))


@query(f"""WITH {PX}, im AS (SELECT c_custkey AS image_id FROM customer), cl AS (SELECT DISTINCT class_id FROM px UNION SELECT 0), a AS (SELECT image_id, class_id, px FROM px UNION SELECT image_id, 0, px FROM px),
n AS (SELECT image_id, class_id, (px % 64) // 16 AS row, (px // 64) // 16 AS col, count(*) / 256.0::DOUBLE AS o FROM a GROUP BY ALL)
SELECT im.image_id, cl.class_id, r.row, c.col, round(coalesce(o, 0), 6) AS overlap, coalesce(o, 0) >= 0.1 AS label FROM im CROSS JOIN cl CROSS JOIN range(4) r(row) CROSS JOIN range(4) c(col) LEFT JOIN n ON n.image_id = im.image_id AND n.class_id = cl.class_id AND n.row = r.row AND n.col = c.col""")
def patch_labels(spark, d):
    """From run-length text to the labels of every patch of every known image."""
    images = table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"))
    return show(geometry.patch_labels(masks(spark, d), images, MASK_SIDE, MASK_SIDE, 16, "overlap_ratio_threshold", 0.1), "overlap")


@query(f"WITH {ANN}, f AS (SELECT image_id, list_sort(list(DISTINCT class_id)) AS classes FROM ann WHERE lower(trim(rle)) NOT IN ('', 'nan') GROUP BY 1) SELECT c_custkey AS image_id, classes, true AS has_defect FROM customer JOIN f ON image_id = c_custkey WHERE list_contains(classes, 2)")
def images_with_class(spark, d):
    return readers.with_defects(table(spark, d, "customer").select(F.col("c_custkey").alias("image_id")), annotations(spark, d), 2)


@query(f"WITH {OV} SELECT class_id, count(*) AS n, count(*) FILTER (overlap > 0.25) AS above, count(*) FILTER (overlap >= 0.25) AS reached FROM ov GROUP BY 1")
def overlap_counts(spark, d):
    return bank.overlap_counts(overlaps(spark, d), 0.25, ("class_id",))


@query(f"WITH {PF} SELECT vec_id, [row, col, row * 14, col * 14, (row + 1) * 14, (col + 1) * 14] AS box FROM pf")
def patch_boxes(spark, d):
    return patch_features(spark, d).select("vec_id", geometry.patch_box(F.col("row"), F.col("col"), 14).alias("box"))


def part_counts(spark, d):
    """Clean patches, and defects of the candidates."""
    rows = patch_features(spark, d)
    return {"clean": rows.filter("role = 'clean'"), "defects": rows.filter("role = 'candidate' AND is_defect")}


META = "im AS (SELECT l_orderkey AS image_id, bool_or(l_returnflag = 'R') AS has_defect FROM lineitem GROUP BY 1)"


def image_meta(spark, d):
    return patch_scores(spark, d).groupBy("image_id").agg(F.bool_or("is_defect").alias("has_defect"), F.max("class_id").alias("class_id"))


@query(f"WITH {META} SELECT image_id, ((row_number() OVER (PARTITION BY has_defect ORDER BY {rank_sql('fold', 42, 'image_id')}, image_id) - 1) % 5)::INTEGER AS fold FROM im")
def folds_hash(spark, d):
    return sampling.hash_folds(image_meta(spark, d), 5, 42, "has_defect")


@query(f"WITH {META}, r AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS n, count(*) OVER () AS m FROM im WHERE NOT has_defect), p AS (SELECT image_id, ((n - (42 * 10) % m + m) % m)::INTEGER AS pick FROM r) SELECT * FROM p ORDER BY pick LIMIT 10")
def pick_circular(spark, d):
    return sampling.circular_pick(image_meta(spark, d).filter("NOT has_defect"), 10, 42)


def balanced_sql(shots: int, classes: list[int], seed: int) -> str:
    """Each class's ids in a circle from its pivot, without those that classes before it took."""
    steps, taken = [], "SELECT NULL::BIGINT AS image_id WHERE false"
    for c in classes:
        steps.append(f"a{c} AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS n, count(*) OVER () AS m FROM (SELECT DISTINCT image_id FROM ps WHERE is_defect AND class_id = {c}))")
        steps.append(f"p{c} AS (SELECT image_id AS head FROM a{c} WHERE n = ({seed + c} * {shots}) % m)")
        steps.append(f"t{c} AS (SELECT image_id, {c} AS class_id FROM a{c}, p{c} WHERE image_id NOT IN ({taken}) ORDER BY image_id < head, image_id LIMIT {shots})")
        taken = " UNION ALL ".join(f"SELECT image_id FROM t{x}" for x in classes[: classes.index(c) + 1])
    return f"WITH {PS}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT * FROM t{c}" for c in classes)


@query(balanced_sql(2, [1, 2, 3, 4], 42))
def class_balanced_pick(spark, d):
    return sampling.class_balanced_pick(patch_scores(spark, d).filter("is_defect").select("image_id", "class_id"), 8, [1, 2, 3, 4], 42)


@query(f"WITH {META} SELECT image_id FROM im ORDER BY {rank_sql('shots', 1, 'image_id')}, image_id LIMIT 20")
def stable_select(spark, d):
    return sampling.stable_select(image_meta(spark, d), 20, "shots", 1)


@query(f"WITH {META} SELECT image_id FROM (SELECT image_id, row_number() OVER (ORDER BY image_id) AS n FROM im) WHERE n > 8 AND n <= 12")
def few_shot_slice(spark, d):
    return sampling.few_shot_slice(image_meta(spark, d).select("image_id"), 4, 2)


@query(f"WITH {PF} SELECT id FROM (SELECT vec_id AS id, row_number() OVER (PARTITION BY class_id ORDER BY {rank_sql('equal', 5, 'vec_id')}, vec_id) AS n FROM pf) WHERE n <= (SELECT min(k) FROM (SELECT count(*) AS k FROM pf GROUP BY class_id))")
def equalise_classes(spark, d):
    return sampling.equalise(patch_features(spark, d).withColumnRenamed("vec_id", "id"), "class_id", 5).select("id")


@query("WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A'), c AS (SELECT DISTINCT o_orderkey AS k FROM orders) SELECT 'defect disjoint clean' AS rule, count(*) AS n FROM a WHERE k IN (SELECT k FROM b) UNION ALL SELECT 'defect subset all', count(*) FROM a WHERE k NOT IN (SELECT k FROM c)")
def leakage_check(spark, d):
    items = table(spark, d, "lineitem")
    parts = {
        "defect": items.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("image_id")), "clean": items.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("image_id")),
        "all": table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id")),
    }
    return sampling.leakage(parts, [("defect", "clean")], [("defect", "all")])


@query("WITH a AS (SELECT DISTINCT l_orderkey AS image_id FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS image_id FROM lineitem WHERE l_returnflag = 'A') SELECT image_id, 'first' AS only FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT image_id, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def mask_coverage(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), "l_returnflag")
    return sampling.same_ids(items.filter("l_returnflag = 'R'"), items.filter("l_returnflag = 'A'"))


@query("WITH a AS (SELECT image_id, min(part)::INTEGER AS part FROM (SELECT l_orderkey AS image_id, 0 AS part FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, 1 FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1) SELECT * FROM a")
def reference_union(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), "l_returnflag")
    return sampling.ordered_union(items.filter("l_returnflag = 'R'"), items.filter("l_returnflag = 'A'"))


@query("SELECT n_nationkey % 3 AS grp, sha256(string_agg(n_name, chr(10) ORDER BY encode(n_name))) AS sha256 FROM (SELECT DISTINCT n_nationkey, n_name FROM nation) GROUP BY 1")
def bank_hash(spark, d):
    rows = table(spark, d, "nation").select((F.col("n_nationkey") % 3).alias("grp"), "n_name")
    return sampling.bound_hash(rows, "n_name", ["grp"])


DELTA = f"WITH {RUNS}, l AS (UNPIVOT runs ON auprc, auroc INTO NAME metric VALUE value), d AS (SELECT a.seed, a.fold, a.metric, a.value AS a, b.value AS b, a.value - b.value AS delta FROM l a JOIN l b ON a.seed = b.seed AND a.fold = b.fold AND a.metric = b.metric AND a.condition = 'R' AND b.condition = 'N')"
METRICS = ("auprc", "auroc")


@query(f"{DELTA} SELECT seed, fold, metric, a, b, round(delta, 6) + 0.0 AS delta FROM d")
def paired_deltas(spark, d):
    return show(study.paired_deltas(runs(spark, d), "R", "N", METRICS), "delta")


@query(f"{DELTA} SELECT metric, round(avg(delta), 6) + 0.0 AS mean, count(*) FILTER (delta > 1e-12) AS positive, count(*) FILTER (delta < -1e-12) AS negative, count(*) FILTER (abs(delta) <= 1e-12) AS zero FROM d GROUP BY 1")
def sign_counts(spark, d):
    return show(study.sign_counts(study.paired_deltas(runs(spark, d), "R", "N", METRICS)), "mean")


@query(f"WITH {RUNS}, l AS (UNPIVOT runs ON auprc, auroc INTO NAME metric VALUE value) SELECT condition, metric, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(median(value), 6) AS median FROM l GROUP BY ALL")
def seed_summary(spark, d):
    return show(study.seed_summary(runs(spark, d), METRICS), "mean", "std", "median")


@query(f"WITH {RUNS} SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM (UNPIVOT (SELECT seed AS fold, auprc, auroc FROM runs WHERE condition = 'R') ON auprc, auroc INTO NAME metric VALUE value) GROUP BY 1")
def fold_summary(spark, d):
    rows = runs(spark, d).filter("condition = 'R'").select(F.col("seed").alias("fold"), *METRICS)
    return show(study.fold_summary(rows, METRICS), "mean", "std")


@query(f"WITH {RUNS} SELECT a.fold, a.seed, a.auprc AS oracle, b.auprc AS auto, round(a.auprc - b.auprc, 6) + 0.0 AS gap FROM runs a JOIN runs b ON a.fold = b.fold AND a.seed = b.seed AND a.condition = 'R' AND b.condition = 'A'")
def oracle_gap(spark, d):
    return show(study.oracle_gap(runs(spark, d), "R", "A", "auprc"), "gap")


@query(f"WITH {RUNS} SELECT condition, seed, row_number() OVER (PARTITION BY condition ORDER BY auprc DESC, abs(auroc - 0.04), auroc DESC, seed)::INTEGER AS rank FROM runs")
def control_rank(spark, d):
    rows = runs(spark, d).withColumn("threshold_delta", F.col("auroc") - 0.04).withColumn("fixed_f1", F.col("auroc")).withColumn("name", F.col("seed"))
    return study.control_rank(rows, ["condition"]).select("condition", "seed", "rank")


@query(f"WITH {RUNS}, c AS (SELECT seed AS class_id, auprc FROM runs WHERE condition = 'R') SELECT class_id, auprc, round(auprc - (sum(auprc) OVER () - auprc) / (count(*) OVER () - 1), 6) + 0.0 AS delta FROM c")
def class_delta(spark, d):
    rows = runs(spark, d).filter("condition = 'R'").select(F.col("seed").alias("class_id"), "auprc")
    return show(study.class_delta(rows), "delta")


@query()
def bootstrap_ci(spark, d):
    return study.bootstrap(study.long_metrics(runs(spark, d), METRICS), ["condition", "metric"], n_boot=500)


@query()
def hierarchical_bootstrap(spark, d):
    return study.bootstrap(study.long_metrics(runs(spark, d), METRICS), ["metric"], n_boot=500, group="condition")


@query()
def condition_table(spark, d):
    """Every image is a run, its largest class the condition: mean and largest score."""
    rows = patch_scores(spark, d).groupBy("image_id").agg(F.max("class_id").alias("condition"), F.avg("score").alias("mean_score"), F.max("score").alias("top_score"))
    return show(study.condition_table(rows, ["mean_score", "top_score"], n_boot=500), "mean", "ci_low", "ci_high")


@query(f"""WITH {PF}, n AS (SELECT count(*) AS n FROM pf WHERE role = 'clean'), p AS (SELECT class_id FROM pf WHERE role = 'candidate' AND is_defect),
have AS (SELECT 'class_' || c AS composition, (SELECT count(*) FROM p WHERE class_id = c) AS have FROM range(1, 5) r(c) UNION ALL SELECT 'random', count(*) FROM p
 UNION ALL SELECT 'class_balanced', coalesce(min(k), 0) * count(*) FROM (SELECT count(*) AS k FROM p GROUP BY class_id)),
m AS (SELECT rate, composition, have FROM (VALUES (1), (2), (5), (10), (20), (30)) r(rate), have UNION ALL SELECT 0, 'none', 0)
SELECT rate, composition, have AS available, CASE WHEN rate = 0 OR have = 0 THEN 0 ELSE greatest(1, least(round_even(rate / (100.0 - rate) * n, 0)::BIGINT, have)) END AS added FROM m, n""")
def condition_matrix(spark, d):
    rows = part_counts(spark, d)
    return study.contamination_plan(spark, rows["clean"], rows["defects"])


@query(f"""WITH {RUNS} SELECT f::INTEGER AS fold, s::INTEGER AS seed, c AS condition FROM range(2) a(f), range(1, 10) b(s), (VALUES ('A'), ('N'), ('R'), ('X')) t(c)
WHERE NOT EXISTS (SELECT 1 FROM runs WHERE fold = f AND seed = s AND condition = c)""")
def open_jobs(spark, d):
    """Of two folds, nine seeds and four conditions, those that no line of an order is a run of."""
    jobs = study.held_out_matrix(spark, range(2), range(1, 10), ["A", "N", "R", "X"])
    return study.open_jobs(jobs, runs(spark, d).select("fold", "seed", "condition")).select("fold", "seed", "condition")


@query(f"WITH {EV}, z AS (SELECT event_id, (score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-8) AS z1, (row - avg(row) OVER w) / (stddev_pop(row) OVER w + 1e-8) AS z2, is_defect FROM ev WINDOW w AS (PARTITION BY image_id)), g AS (SELECT i / 10.0::DOUBLE AS weight, i / 10.0::DOUBLE * z1 + (1 - i / 10.0::DOUBLE) * z2 AS s, is_defect FROM z, range(11) t(i)) SELECT weight, round(avg(s) FILTER (is_defect) - avg(s) FILTER (NOT is_defect), 6) + 0.0 AS gap FROM g GROUP BY 1")
def ensemble_weight_grid(spark, d):
    from ..operators.calibration import z_score

    rows = event_scores(spark, d)
    one = z_score(rows).withColumnRenamed("z", "z1").withColumn("rowd", F.col("row").cast("double"))
    two = z_score(one, "rowd").withColumnRenamed("z", "z2").select("event_id", "is_defect", "z1", "z2")
    s, t = F.col("score"), F.col("is_defect")
    return study.ensemble_grid(two).groupBy("weight").agg(shown(F.avg(F.when(t, s)) - F.avg(F.when(~t, s))).alias("gap"))


@query(f"WITH {PS}, n AS (SELECT image_id, count(*) AS n FROM ps GROUP BY 1) SELECT min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean FROM n")
def patches_per_image(spark, d):
    return show(maps.per_image_sizes(patch_scores(spark, d)), "mean")


@query(f"WITH {PF} SELECT class_id, count(*) AS n, count(*) FILTER (is_defect) AS defects, count(DISTINCT image_id) AS images FROM pf GROUP BY 1")
def bank_classes(spark, d):
    return bank.class_counts(patch_features(spark, d))


@query(f"""WITH {PF}, {CAND}, c AS (SELECT count(*) AS n_clean FROM pf WHERE role = 'clean'), k AS (SELECT count(*) AS n_candidates, count(*) FILTER (score <= 0.6) AS accepted FROM cand)
SELECT n_clean, n_candidates, n_clean + accepted AS bank_size, accepted, n_candidates - accepted AS rejected, round(accepted / n_candidates::DOUBLE, 6) AS acceptance FROM c, k""")
def bank_statistics(spark, d):
    """Of the bank that takes candidates up to a distance of 0.6."""
    from .vector_queries import candidates

    clean, more = part_counts(spark, d)["clean"].withColumnRenamed("vec_id", "id").withColumn("score", F.lit(0.0)), candidates(spark, d)
    cols = ["id", "class_id", "is_defect", "score"]
    return show(bank.bank_stats(clean, more, bank.compose(clean.select(*cols), more.select(*cols), "auto_purified", threshold=0.6)), "acceptance")


@query(f"WITH {EV} SELECT image_id, max(score) AS vmax FROM ev WHERE NOT is_defect GROUP BY 1")
def object_vmax(spark, d):
    return maps.colour_limits(event_scores(spark, d), "image_id")


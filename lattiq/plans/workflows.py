"""Whole studies as single jobs: conditions are rows or a bounded list of banks, results are one row per condition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import shown
from ..operators import bank, calibration, knn, ranking, sampling, study
from ..operators.shared import written
from ..operators.study import COMPOSITIONS
from .registry import CAND, DIST, PF, query, rank_sql
from .score_queries import RANK, curve_sql, show
from .vector_queries import MODES, candidates, part

SHOWN = ("auroc", "average_precision", "f1_max")


def scored(queries: DataFrame, bank_: DataFrame) -> DataFrame:
    """Query patches with rounded distance to a bank and their label."""
    found = knn.knn_scores(queries, bank_).select("query_id", shown(F.col("score")).alias("score"))
    return queries.select(F.col("id").alias("query_id"), "image_id", "is_defect").join(found, "query_id")


def ranked_banks(queries: DataFrame, banks: DataFrame, key: str) -> DataFrame:
    """One row per bank: ranking metrics and ``bank_size``, all banks (``key``, features) in one search. Banks are a short list."""
    names = {r[0]: i for i, r in enumerate(sorted(banks.select(key).distinct().collect()))}
    number = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = banks.withColumn("class_id", number[F.col(key)])
    found = knn.class_scores(queries, rows.select("id", "class_id", "features")).select("query_id", F.col("class_id").alias("bank_no"), shown(F.col("dist")).alias("score"))
    labelled = queries.select(F.col("id").alias("query_id"), "is_defect").join(found, "query_id")
    metrics = ranking.ranking(labelled, keys=["bank_no"])
    sizes = rows.groupBy(key, F.col("class_id").alias("bank_no")).agg(F.count("*").alias("bank_size"))
    return metrics.join(F.broadcast(sizes), "bank_no").drop("bank_no")


def composition_study(queries: DataFrame, clean: DataFrame, pool: DataFrame, modes: Sequence[str], **how) -> DataFrame:
    """One row per mode: bank size and ranking metrics on the queries. ``pool`` has each candidate's distance as ``score``. The banks are
    written to the shared folder."""
    banks, base = None, clean.withColumn("score", F.lit(0.0))
    for mode in modes:
        made = bank.compose(base, pool.select(*base.columns), mode, **how).select(F.lit(mode).alias("mode"), "id", "features")
        banks = made if banks is None else banks.unionByName(made)
    return ranked_banks(queries, written(banks, "banks"), "mode")


def composed_pool(defects: DataFrame, composition: str, seed: int) -> DataFrame:
    """Defect patches of a composition: ``class_N`` alone, all (``random``), or as many of each class as the rarest has, by hash rank
    (``class_balanced``)."""
    if composition.startswith("class_") and composition != "class_balanced":
        return defects.filter(F.col("class_id") == int(composition.removeprefix("class_")))
    if composition == "random":
        return defects
    if composition != "class_balanced":
        raise ValueError(f"unknown composition {composition}")
    least = defects.groupBy("class_id").count().agg(F.min("count").alias("__least"))
    rows = sampling.hash_rank(defects, "balance", seed, "id", ["class_id"]).crossJoin(F.broadcast(least))
    return rows.filter(F.col("rank") < F.col("__least")).drop("rank", "__least")


def contamination_study(queries: DataFrame, clean: DataFrame, defects: DataFrame, rates: Sequence[float], compositions: Sequence[str], seed: int) -> DataFrame:
    """One row per composition and rate, with a clean bank of rate 0: ranking metrics with banks contaminated by replacement, how many
    of their rows are anomalous, and for how many queries the nearest row is one (``traced``). All banks go in one search."""
    cols = ["id", "class_id", "features"]
    banks = clean.select(F.lit("none:0").alias("bank"), "id", F.lit("clean").alias("source"), "features")
    for name in compositions:
        pool = composed_pool(defects.select(*cols), name, seed)
        for rate in rates:
            made = bank.contaminate_by_replacement(clean.select(*cols), pool, rate, seed)
            banks = banks.unionByName(made.select(F.lit(f"{name}:{rate:g}").alias("bank"), "id", "source", "features"))
    banks = written(banks, "banks")
    metrics = ranked_banks(queries, banks, "bank")
    both = banks.withColumn("half", F.concat_ws("|", "bank", "source"))
    names = {r[0]: i for i, r in enumerate(sorted(both.select("half").distinct().collect()))}
    number = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    near = knn.class_scores(queries, both.select("id", number[F.col("half")].alias("class_id"), "features"))
    back = F.create_map(*[F.lit(x) for n, i in names.items() for x in (i, n)])
    near = near.withColumn("half", F.split(back[F.col("class_id")], r"\|")).select("query_id", F.col("half")[0].alias("bank"), F.col("half")[1].alias("source"), "dist")
    wins = near.groupBy("bank", "query_id").agg(F.min(F.when(F.col("source") == "anomalous", F.col("dist"))).alias("a"), F.min(F.when(F.col("source") == "clean", F.col("dist"))).alias("c"))
    traced = wins.groupBy("bank").agg(F.count_if(F.col("a").isNotNull() & (F.col("c").isNull() | (F.col("a") < F.col("c")))).alias("traced"))
    counts = banks.groupBy("bank").agg(F.count_if(F.col("source") == "anomalous").alias("anomalous"))
    rows = metrics.join(F.broadcast(counts), "bank").join(F.broadcast(traced), "bank")
    return rows.withColumn("composition", F.substring_index("bank", ":", 1)).withColumn("rate", F.substring_index("bank", ":", -1).cast("double")).drop("bank")


def zero_shot(patches: DataFrame, q: float, share: float = 0.01) -> DataFrame:
    """Without references: each patch against all other images (``mutual_scores``), image scores as the mean of the top share of
    patches, and their ranking against any(label). One row."""
    scores = knn.mutual_scores(patches.withColumn("grp", F.col("image_id")), q).select("id", "score")
    rows = patches.select("id", "image_id", "is_defect").join(scores, "id")
    per = ranking.image_scores(rows, share=share)
    return ranking.ranking(per.select(shown(F.col("top_mean")).alias("score"), "is_defect"))


def contamination_curve(queries: DataFrame, clean: DataFrame, pool: DataFrame, rates: Sequence[float], seed: int) -> DataFrame:
    """One row per rate: ranking metrics with a bank contaminated by replacement at constant size."""
    out = None
    for rate in rates:
        made = bank.contaminate_by_replacement(clean, pool, rate, seed)
        row = ranking.ranking(scored(queries, made.select(F.col("slot_id").alias("id"), "features"))).withColumn("rate", F.lit(float(rate)))
        out = row if out is None else out.unionByName(row)
    return out


def cross_fit(clean: DataFrame, **how) -> DataFrame:
    """Scores of clean patches against all other clean images; needs two images."""
    if clean.select("image_id").distinct().limit(2).count() < 2:
        raise ValueError("cross-fitting needs two clean images")
    return knn.left_out(clean, "image_id", **how)


def cross_validation(patches: DataFrame, folds: DataFrame) -> DataFrame:
    """Per fold: patches of a fold's images against the normal patches of all other folds, in one job: the fold is the group
    that is left out."""
    rows = patches.join(folds, "image_id").withColumn("grp", F.col("fold").cast("long"))
    found = knn.knn_scores(rows, rows.filter(~F.col("is_defect"))).select("query_id", shown(F.col("score")).alias("score"))
    labelled = rows.select(F.col("id").alias("query_id"), "fold", "is_defect").join(found, "query_id")
    return ranking.ranking(labelled, keys=["fold"])


def grid_search(queries: DataFrame, clean: DataFrame, shots: Sequence[int], ks: Sequence[int], seed: int = 0) -> DataFrame:
    """Ranking for numbers of reference images and of neighbours. The nearest neighbours are found once per bank, for the largest
    k; smaller ones are prefixes."""
    out = None
    for n in shots:
        ids = sampling.stable_select(clean.select("image_id").distinct(), n, "shots", seed)
        near = knn.nearest(queries, clean.join(ids, "image_id", "left_semi"), max(ks)).select("query_id", "dist", "rank", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
        mean = near.filter("rank <= k").groupBy("query_id", "k").agg(shown(F.avg("dist")).alias("score"))
        rows = mean.join(queries.select(F.col("id").alias("query_id"), "is_defect"), "query_id")
        part_ = ranking.ranking(rows, keys=["k"]).withColumn("shots", F.lit(n))
        out = part_ if out is None else out.unionByName(part_)
    return out


def few_shot_images(queries: DataFrame, reference: DataFrame, share: float = 0.01) -> DataFrame:
    """Image classification from patch distances: top-share means against any(label)."""
    per = ranking.image_scores(scored(queries, reference), share=share)
    return ranking.ranking(per.select(shown(F.col("top_mean")).alias("score"), "is_defect"))


def held_out_classes(classes: Sequence[int]) -> list[dict]:
    """Leave-one-class-out plan: the class that is held out, and those in use."""
    return [{"held_out": c, "classes": [x for x in classes if x != c]} for c in classes]


MODE_ROWS = {m: f"SELECT id FROM clean UNION ALL SELECT id FROM ({sql})" for m, (sql, _) in MODES.items()}
STUDY = f"WITH {PF}, {CAND}, clean AS (SELECT vec_id AS id FROM pf WHERE role = 'clean'), bk AS (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, id FROM ({s})" for m, s in MODE_ROWS.items()) + f"""),
s AS (SELECT mode, q.vec_id, q.is_defect, round(min({DIST}), 6) AS score FROM pf q, pf b, bk WHERE q.role = 'query' AND b.vec_id = bk.id GROUP BY ALL), {curve_sql('s', 'mode')}
SELECT mode, (SELECT count(*) FROM bk WHERE bk.mode = c.mode) AS bank_size, {RANK} FROM c GROUP BY mode"""


@query(STUDY, "composition_study")
def _composition(spark, d):
    cols = ["id", "image_id", "row", "col", "class_id", "is_defect", "features"]
    pool = candidates(spark, d).select("id", "score").join(part(spark, d, "candidate").select(*cols), "id")
    rows = composition_study(part(spark, d, "query"), part(spark, d, "clean").select(*cols), pool, list(MODE_ROWS), threshold=0.6, fraction=0.2, allow_oracle=True)
    return show(rows, *SHOWN)


CURVE = f"""WITH {PF}, rt AS (SELECT unnest([0.0, 0.1, 0.3])::DOUBLE AS rate), s0 AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {rank_sql('slot', 3, 'vec_id')}, vec_id) AS r, count(*) OVER () AS n FROM pf WHERE role = 'clean'),
o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {rank_sql('donor', 3, 'vec_id')}, vec_id) AS r, count(*) OVER () AS m FROM pf WHERE role = 'candidate' AND is_defect),
bk AS (SELECT rate, coalesce(o.id, s0.id) AS id FROM rt CROSS JOIN s0 LEFT JOIN o ON o.r = s0.r AND s0.r <= least(round_even(rate * n, 0), m)),
s AS (SELECT rate, q.vec_id, q.is_defect, round(min({DIST}), 6) AS score FROM pf q, pf b, bk WHERE q.role = 'query' AND b.vec_id = bk.id GROUP BY ALL), {curve_sql('s', 'rate')} SELECT rate, {RANK} FROM c GROUP BY rate"""


@query(CURVE, "contamination_curve")
def _contamination(spark, d):
    pool = part(spark, d, "candidate").filter("is_defect")
    return show(contamination_curve(part(spark, d, "query"), part(spark, d, "clean"), pool, [0.0, 0.1, 0.3], 3), *SHOWN)


CONTAMINATION = f"""WITH {PF}, od AS (SELECT vec_id AS id, class_id FROM pf WHERE role = 'candidate' AND is_defect),
bal AS (SELECT id, row_number() OVER (PARTITION BY class_id ORDER BY {rank_sql('balance', 3, 'id')}, id) AS b FROM od), least AS (SELECT min(k) AS k FROM (SELECT count(*) AS k FROM od GROUP BY class_id)),
pl AS (SELECT 'class_' || c AS composition, id FROM od, range(1, 5) r(c) WHERE class_id = c UNION ALL SELECT 'random', id FROM od UNION ALL SELECT 'class_balanced', id FROM bal, least WHERE b <= k),
o AS (SELECT composition, id, row_number() OVER (PARTITION BY composition ORDER BY {rank_sql('donor', 3, 'id')}, id) AS r, count(*) OVER (PARTITION BY composition) AS m FROM pl),
s0 AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {rank_sql('slot', 3, 'vec_id')}, vec_id) AS r, count(*) OVER () AS n FROM pf WHERE role = 'clean'),
cr AS (SELECT composition, rate FROM (SELECT DISTINCT composition FROM pl), (VALUES (0.1::DOUBLE), (0.3)) t(rate)),
bk AS (SELECT cr.composition, rate, coalesce(o.id, s0.id) AS id, o.id IS NOT NULL AS bad FROM cr CROSS JOIN s0 LEFT JOIN o ON o.composition = cr.composition AND o.r = s0.r AND s0.r <= least(round_even(rate * n, 0), m)
 UNION ALL SELECT 'none', 0, id, false FROM s0),
s1 AS (SELECT composition, rate, q.vec_id, q.is_defect, min({DIST}) AS d, min({DIST}) FILTER (bad) AS da, min({DIST}) FILTER (NOT bad) AS dc FROM pf q, pf b, bk WHERE q.role = 'query' AND b.vec_id = bk.id GROUP BY ALL),
s AS (SELECT composition || ':' || rate AS key, round(d, 6) AS score, is_defect FROM s1), {curve_sql('s', 'key')}, k AS (SELECT key, {RANK} FROM c GROUP BY key),
x AS (SELECT composition, rate, composition || ':' || rate AS key, count(*) FILTER (da < coalesce(dc, 9)) AS traced FROM s1 GROUP BY ALL), z AS (SELECT composition || ':' || rate AS key, count(*) AS bank_size, count(*) FILTER (bad) AS anomalous FROM bk GROUP BY ALL)
SELECT composition, rate::DOUBLE AS rate, bank_size, anomalous, traced, * EXCLUDE (composition, rate, bank_size, anomalous, traced, key) FROM k JOIN x USING (key) JOIN z USING (key)"""


@query(CONTAMINATION, "contamination_study")
def _contamination_study(spark, d):
    """All compositions that have patches, at two rates."""
    defects = part(spark, d, "candidate").filter("is_defect")
    rows = contamination_study(part(spark, d, "query"), part(spark, d, "clean"), defects, [0.1, 0.3], COMPOSITIONS, 3)
    return show(rows, *SHOWN)


@query(f"""WITH {PF}, n AS (SELECT count(*) AS n FROM pf), own AS (SELECT image_id, count(*) AS own FROM pf GROUP BY 1),
d AS (SELECT q.vec_id, q.image_id, {DIST} AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DIST}) AS r, floor(0.1 * (n - own))::BIGINT AS need FROM pf q JOIN own USING (image_id), pf b, n WHERE q.image_id <> b.image_id),
cut AS (SELECT vec_id, dist AS c FROM d WHERE r = need), m AS (SELECT d.vec_id, d.image_id, avg(dist) AS score FROM d JOIN cut USING (vec_id) WHERE dist < c GROUP BY ALL),
r AS (SELECT m.image_id, m.score, is_defect AND class_id = 4 AS is_defect, row_number() OVER (PARTITION BY m.image_id ORDER BY m.score DESC) AS i, count(*) OVER (PARTITION BY m.image_id) AS k FROM m JOIN pf USING (vec_id)),
s AS (SELECT image_id, round(avg(score) FILTER (i <= greatest(floor(k * 0.1), 1)), 6) AS score, bool_or(is_defect) AS is_defect FROM r GROUP BY 1), {curve_sql('s')} SELECT {RANK} FROM c""", "zero_shot_images")
def _zero_shot(spark, d):
    rows = part(spark, d, "query", "clean", "candidate", "unused").withColumn("is_defect", F.col("is_defect") & (F.col("class_id") == 4))
    return show(zero_shot(rows, 0.1, 0.1), *SHOWN)


@query(f"WITH {PF}, s AS (SELECT q.vec_id, round(min({DIST}), 6) + 0.0 AS score FROM pf q, pf b WHERE q.role = 'clean' AND b.role = 'clean' AND q.image_id <> b.image_id GROUP BY 1) SELECT vec_id AS query_id, score FROM s", "cross_fit_scores")
def _cross_fit(spark, d):
    return show(cross_fit(part(spark, d, "clean")), "score")


@query(f"""WITH {PF}, f AS (SELECT image_id, ((row_number() OVER (ORDER BY {rank_sql('fold', 42, 'image_id')}, image_id) - 1) % 3)::INTEGER AS fold FROM (SELECT DISTINCT image_id FROM pf)),
x AS (SELECT pf.*, fold FROM pf JOIN f USING (image_id)), s AS (SELECT q.fold, q.vec_id, q.is_defect, round(min({DIST}), 6) AS score FROM x q, x b WHERE q.fold <> b.fold AND NOT b.is_defect GROUP BY ALL),
{curve_sql('s', 'fold')} SELECT fold, {RANK} FROM c GROUP BY fold""", "cross_validation")
def _cross_validation(spark, d):
    rows = part(spark, d, "query", "clean", "candidate", "unused")
    folds = sampling.hash_folds(rows.select("image_id").distinct(), 3, 42)
    return show(cross_validation(rows, folds), *SHOWN)


@query(f"""WITH {PF}, im AS (SELECT image_id, row_number() OVER (ORDER BY {rank_sql('shots', 0, 'image_id')}, image_id) AS n FROM (SELECT DISTINCT image_id FROM pf WHERE role = 'clean')), sh AS (SELECT unnest([2, 4]) AS shots), kk AS (SELECT unnest([1, 3]) AS k),
d AS (SELECT shots, q.vec_id, q.is_defect, {DIST} AS dist, row_number() OVER (PARTITION BY shots, q.vec_id ORDER BY {DIST}, b.vec_id) AS r FROM sh JOIN im ON n <= shots JOIN pf b ON b.image_id = im.image_id AND b.role = 'clean', pf q WHERE q.role = 'query'),
s AS (SELECT shots * 10 + k AS sk, vec_id, is_defect, round(avg(dist), 6) AS score FROM d JOIN kk ON r <= k GROUP BY ALL), {curve_sql('s', 'sk')} SELECT (sk // 10)::INTEGER AS shots, (sk % 10)::INTEGER AS k, {RANK} FROM c GROUP BY sk""", "grid_search")
def _grid_search(spark, d):
    return show(grid_search(part(spark, d, "query"), part(spark, d, "clean"), [2, 4], [1, 3]), *SHOWN)


@query(f"""WITH {PF}, p AS (SELECT q.image_id, q.is_defect AND q.class_id = 4 AS is_defect, round(min({DIST}), 6) AS score FROM pf q, pf b WHERE q.role = 'query' AND b.role = 'clean' GROUP BY q.vec_id, q.image_id, q.is_defect, q.class_id),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC) AS n, count(*) OVER (PARTITION BY image_id) AS m FROM p), s AS (SELECT image_id, round(avg(score) FILTER (n <= greatest(floor(m * 0.1), 1)), 6) AS score, bool_or(is_defect) AS is_defect FROM r GROUP BY 1),
{curve_sql('s')} SELECT {RANK} FROM c""", "few_shot_images")
def _few_shot(spark, d):
    q = part(spark, d, "query").withColumn("is_defect", F.col("is_defect") & (F.col("class_id") == 4))
    return show(few_shot_images(q, part(spark, d, "clean"), 0.1), *SHOWN)


@query(f"WITH {PF} SELECT vec_id AS id, class_id, row_number() OVER (PARTITION BY class_id ORDER BY {rank_sql('order', 1, 'vec_id')}, vec_id) - 1 AS rank FROM pf", "hash_rank")
def _hash_rank(spark, d):
    rows = part(spark, d, "query", "clean", "candidate", "unused").select("id", "class_id")
    return sampling.hash_rank(rows, "order", 1, "id", ["class_id"])


@query(f"WITH {PF}, {CAND}, l AS (SELECT round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 6) AS iqr FROM cand) SELECT * FROM l", "robust_calibration")
def _robust(spark, d):
    return show(calibration.robust(candidates(spark, d)), "median", "iqr")


@query(f"""WITH {PF}, {CAND}, lo AS (SELECT q.vec_id, round(min({DIST}), 6) + 0.0 AS score FROM pf q, pf b WHERE q.role = 'clean' AND b.role = 'clean' AND q.image_id <> b.image_id GROUP BY 1),
t AS (SELECT unnest([95.0, 97.5, 99.0, 99.5])::DOUBLE AS q, unnest(quantile_cont(score, [0.95, 0.975, 0.99, 0.995])) AS tau FROM lo),
r AS (SELECT *, row_number() OVER (ORDER BY score, id) AS near, row_number() OVER (ORDER BY {rank_sql('matched', 42, 'id')}, id) AS drawn, count(*) OVER () AS n FROM cand),
a AS (SELECT q, count(*) FILTER (score <= tau) AS k, count(*) FILTER (score <= tau AND is_defect) AS d FROM r, t GROUP BY q),
m AS (SELECT q, count(*) AS k, count(*) FILTER (is_defect) AS d FROM r JOIN a ON drawn <= a.k GROUP BY q),
f AS (SELECT f, count(*) AS k, count(*) FILTER (is_defect) AS d FROM r, (VALUES (5), (10), (20)) v(f) WHERE near <= round_even((100 - f) / 100.0 * n, 0) GROUP BY f)
SELECT 'auto_p' || replace(printf('%g', q), '.', '_') AS name, 'auto_purified' AS condition, k AS accepted, d AS defects FROM a
UNION ALL SELECT 'random_matched_p' || replace(printf('%g', t.q), '.', '_'), 'random_filtered', coalesce(k, 0), coalesce(d, 0) FROM t LEFT JOIN m ON m.q = t.q
UNION ALL SELECT 'trim_' || f || 'pct', 'fixed_ratio_trim', k, d FROM f""", "control_outcomes")
def _controls(spark, d):
    clean = show(cross_fit(part(spark, d, "clean")), "score")
    return study.control_outcomes(clean, candidates(spark, d))

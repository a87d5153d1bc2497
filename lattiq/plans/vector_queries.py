"""Queries over vectors: neighbours, calibration, banks, detectors, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import cosine, dot, norm, shown
from ..operators import bank, calibration, detectors, geometry, grid, knn, ranking
from ..operators.dual_bank import MODES as DUAL_MODES
from ..operators.dual_bank import DualBank
from ..operators.fused import cls_rollout
from ..sources.tables import event_scores, patch_features
from .registry import CAND, DIST, EV, L2, PF, query, rank_sql
from .score_queries import RANK, curve_sql, show


def part(spark, d, *roles):
    return patch_features(spark, d).filter(F.col("role").isin(*roles)).withColumnRenamed("vec_id", "id")


def rounded_score(df, name="score", digits=6):
    return df.withColumn(name, shown(F.col(name), digits))


def candidates(spark, d):
    """Candidates with their rounded distance to the clean bank."""
    rows = part(spark, d, "candidate")
    found = knn.knn_scores(rows, part(spark, d, "clean")).withColumnRenamed("query_id", "id")
    return rows.drop("features", "role").join(rounded_score(found), "id")


PAIRS = f"d AS (SELECT q.vec_id AS query_id, b.vec_id AS bank_id, {DIST} AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DIST}, b.vec_id) AS rank FROM pf q, pf b WHERE q.role = 'query' AND b.role = 'clean')"


FLAG = f"WITH {PF}, s AS (SELECT q.vec_id, q.is_defect, round(min({DIST}), 6) AS score FROM pf q, pf b WHERE q.role = 'query' AND b.role = 'clean' GROUP BY ALL), {curve_sql('s')} SELECT {RANK} FROM c"


@query(FLAG)
def flagship(spark, d):
    """Score every query vector against the normal bank, label it, and rank."""
    q = part(spark, d, "query")
    scores = rounded_score(knn.knn_scores(q, part(spark, d, "clean")))
    rows = scores.join(q.select(F.col("id").alias("query_id"), "is_defect"), "query_id")
    return show(ranking.ranking(rows), "auroc", "average_precision", "f1_max")


@query(f"WITH {PF} SELECT q.vec_id AS query_id, round(min({DIST}), 6) + 0.0 AS score FROM pf q, pf b WHERE q.role = 'query' AND b.role = 'clean' GROUP BY 1")
def knn_min_cosine(spark, d):
    return rounded_score(knn.knn_scores(part(spark, d, "query"), part(spark, d, "clean")))


@query(f"WITH {PF}, {PAIRS} SELECT query_id, round(avg(dist), 6) + 0.0 AS score FROM d WHERE rank <= 3 GROUP BY 1")
def knn_topk_mean(spark, d):
    return rounded_score(knn.knn_scores(part(spark, d, "query"), part(spark, d, "clean"), 3, strategy="blocks"))


@query(f"WITH {PF}, d AS (SELECT q.vec_id AS query_id, {L2} AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY {L2}, b.vec_id) AS rank FROM pf q, pf b WHERE q.role = 'query' AND b.role = 'clean') SELECT query_id, round(sqrt(avg(dist * dist)), 6) + 0.0 AS score FROM d WHERE rank <= 3 GROUP BY 1")
def knn_l2_rms(spark, d):
    return rounded_score(knn.knn_scores(part(spark, d, "query"), part(spark, d, "clean"), 3, "l2"))


@query(f"WITH {PF}, {PAIRS} SELECT query_id, bank_id, b.image_id, b.row, b.col, b.class_id, round(dist, 6) + 0.0 AS dist FROM d JOIN pf b ON b.vec_id = bank_id WHERE rank = 1")
def knn_provenance(spark, d):
    bank_ = part(spark, d, "clean")
    found = knn.nearest(part(spark, d, "query"), bank_)
    rows = knn.with_provenance(found, bank_.select("id", "image_id", "row", "col", "class_id", "features"))
    return rounded_score(rows.drop("rank"), "dist")


def loo_sql(by: str) -> str:
    return f"WITH {PF}, s AS (SELECT q.vec_id, min({DIST}) AS score FROM pf q, pf b WHERE q.role = 'clean' AND b.role = 'clean' AND q.{by} <> b.{by} GROUP BY 1) SELECT count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(median(score), 6) AS median, round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 6) AS iqr, round(quantile_cont(score, 0.99), 6) AS p99 FROM s"


def loo(spark, d, by):
    s = calibration.summary(knn.left_out(part(spark, d, "clean"), by))
    rows = s.select("n", "mean", "std", "median", "iqr", F.try_element_at("percentiles", F.lit(99.0)).alias("p99"))
    return show(rows, "mean", "std", "median", "iqr", "p99")


@query(loo_sql("image_id"))
def loo_image_calibration(spark, d):
    return loo(spark, d, "image_id")


@query(loo_sql("vec_id"))
def loo_patch_calibration(spark, d):
    return loo(spark, d, "id")


@query(f"WITH {PF}, d AS (SELECT q.vec_id AS id, {DIST} AS dist FROM pf q, pf b WHERE q.image_id <> b.image_id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist) AS rn, count(*) OVER (PARTITION BY id) AS n FROM d), c AS (SELECT id, max(dist) FILTER (rn = floor(0.02 * n)) AS cut FROM r GROUP BY 1) SELECT id, round(avg(dist) FILTER (dist < cut), 6) + 0.0 AS score FROM r JOIN c USING (id) GROUP BY 1")
def batched_mutual_scoring(spark, d):
    rows = patch_features(spark, d).select(F.col("vec_id").alias("id"), F.col("image_id").alias("grp"), "features")
    return rounded_score(knn.mutual_scores(rows, 0.02)).select("id", "score")


@query(f"WITH {PF}, l AS (SELECT q.vec_id, min({DIST}) AS s FROM pf q, pf b WHERE q.role = 'clean' AND b.role = 'clean' AND q.image_id <> b.image_id GROUP BY 1), t AS (SELECT round(quantile_cont(s, 0.75), 6) AS thr FROM l), {CAND} SELECT count(*) AS n, count(*) FILTER (score <= thr) AS kept, round(count(*) FILTER (score <= thr) / count(*)::DOUBLE, 6) AS fraction FROM cand, t")
def purify_auto(spark, d):
    limit = calibration.threshold_at(knn.left_out(part(spark, d, "clean"), "image_id"), 75.0).select(shown(F.col("threshold")).alias("threshold"))
    rows = bank.purify(candidates(spark, d).crossJoin(F.broadcast(limit)), F.col("threshold"))
    return show(bank.kept_fraction(rows), "fraction")


@query(f"WITH {PF}, {CAND}, p AS (SELECT image_id, quantile_cont(score, 0.8) AS p FROM cand GROUP BY 1) SELECT id, score > p AS suspected FROM cand JOIN p USING (image_id)")
def mine_suspected(spark, d):
    return bank.mine_suspects(candidates(spark, d), 80.0).select("id", "suspected")


@query(f"WITH {PF}, {CAND}, k AS (SELECT *, row_number() OVER (ORDER BY score, id) AS rn, count(*) OVER () AS n FROM cand), t AS (SELECT * FROM k WHERE rn <= round_even(0.8 * n, 0)) SELECT id, (SELECT max(score) FROM t) AS accept_threshold FROM t")
def trim_fixed_ratio(spark, d):
    return bank.trim(candidates(spark, d), 0.2, ["id"]).select("id", "accept_threshold")


def ranked(ns: str, seed: int, table: str, n: str, ident: str = "id") -> str:
    return f"SELECT {ident} FROM {table} ORDER BY {rank_sql(ns, seed, ident)}, {ident} LIMIT {n}"


@query(f"WITH {PF}, {CAND} {ranked('matched', 42, 'cand', '(SELECT count(*) FROM cand WHERE score <= 0.6)')}")
def random_matched(spark, d):
    rows = candidates(spark, d)
    return bank.random_keep(rows, rows.filter("score <= 0.6").count(), "matched", 42).select("id")


@query(f"WITH {PF} {ranked('budget', 7, 'pf', '50', 'vec_id')}")
def budget_random(spark, d):
    return bank.random_keep(patch_features(spark, d), 50, "budget", 7, "vec_id").select("vec_id")


CLEAN = "clean AS (SELECT vec_id AS id FROM pf WHERE role = 'clean')"
SUM = "SELECT count(*) AS bank_size, count(*) FILTER (source = 'additional') AS accepted, sum(id)::BIGINT AS ids FROM ({c} UNION ALL {m})"


def mode_sql(more: str) -> str:
    return f"WITH {PF}, {CAND}, {CLEAN} " + SUM.format(c="SELECT id, 'clean' AS source FROM clean", m=f"SELECT id, 'additional' AS source FROM ({more})")


def composed(mode, **how):
    def run(spark, d):
        rows = candidates(spark, d)
        clean = part(spark, d, "clean").select("id", "image_id", "row", "col", "class_id", "is_defect").withColumn("score", F.lit(0.0))
        out = bank.compose(clean, rows.select(*clean.columns), mode, **how)
        return out.agg(F.count("*").alias("bank_size"), F.count_if(F.col("source") == "additional").alias("accepted"), F.sum("id").alias("ids"))

    return run


MODES = {
    "clean": ("SELECT id FROM cand LIMIT 0", {}),
    "contaminated_all": ("SELECT id FROM cand", {}),
    "class_balanced_all": (f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY class_id ORDER BY {rank_sql('balance', 42, 'id')}, id) AS rn FROM cand) WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM cand GROUP BY class_id))", {}),
    "oracle_purified": ("SELECT id FROM cand WHERE NOT is_defect", {"allow_oracle": True}),
    "auto_purified": ("SELECT id FROM cand WHERE score <= 0.6", {"threshold": 0.6}),
    "random_filtered": (ranked("matched", 42, "cand", "(SELECT count(*) FROM cand WHERE score <= 0.6)"), {"threshold": 0.6}),
    "fixed_ratio_trim": ("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY score, id) AS rn, count(*) OVER () AS n FROM cand) WHERE rn <= round_even(0.8 * n, 0)", {"fraction": 0.2}),
}
for _mode, (_sql, _how) in MODES.items():
    query(mode_sql(_sql), f"composition_{_mode}")(composed(_mode, **_how))


@query(f"WITH {PF}, pool AS (SELECT vec_id AS id FROM pf WHERE role = 'candidate' AND is_defect), {CLEAN}, n AS (SELECT greatest(1, least(round_even(0.1 / 0.9 * (SELECT count(*) FROM clean), 0)::BIGINT, (SELECT count(*) FROM pool))) AS n) SELECT id, 'clean' AS source FROM clean UNION ALL SELECT id, 'anomalous' FROM ({ranked('growth', 3, 'pool', '(SELECT n FROM n)')})")
def contamination_growth(spark, d):
    pool = part(spark, d, "candidate").filter("is_defect")
    return bank.contaminate_by_growth(part(spark, d, "clean"), pool, 0.1, 3).select("id", "source")


@query(f"""WITH {PF}, pool AS (SELECT vec_id AS id, class_id FROM pf WHERE role = 'candidate' AND is_defect), clean AS (SELECT vec_id AS id, class_id FROM pf WHERE role = 'clean'),
n AS (SELECT least(round_even(0.1 * (SELECT count(*) FROM clean), 0)::BIGINT, (SELECT count(*) FROM pool)) AS n),
s AS (SELECT id, row_number() OVER (ORDER BY {rank_sql('slot', 3, 'id')}, id) AS r FROM clean), o AS (SELECT *, row_number() OVER (ORDER BY {rank_sql('donor', 3, 'id')}, id) AS r FROM pool)
SELECT s.id AS slot_id, coalesce(o.id, s.id) AS id, CASE WHEN o.id IS NULL THEN 'clean' ELSE 'anomalous' END AS source, coalesce(o.class_id, c.class_id) AS class_id FROM s JOIN clean c USING (id) LEFT JOIN o ON o.r = s.r AND s.r <= (SELECT n FROM n)""")
def contamination_replacement(spark, d):
    pool = part(spark, d, "candidate").filter("is_defect").select("id", "class_id")
    return bank.contaminate_by_replacement(part(spark, d, "clean").select("id", "class_id"), pool, 0.1, 3)


@query(f"WITH {PF}, {PAIRS} SELECT query_id, bank_id, rank, round(dist, 6) + 0.0 AS dist FROM d WHERE rank <= 3")
def knn_cells(spark, d):
    """Three neighbours, by cells of the bank."""
    return show(knn.nearest(part(spark, d, "query"), part(spark, d, "clean"), 3, strategy="cells").select("query_id", "bank_id", "rank", "dist"), "dist")


def dist_to(where: str, alias: str) -> str:
    return f"(SELECT q.vec_id AS id, min({DIST}) AS {alias} FROM pf q, pf b WHERE q.role = 'query' AND {where} GROUP BY 1)"


DUAL = f"{PF}, dn AS {dist_to("b.role = 'clean'", 'd_n')}, dd AS {dist_to("b.role = 'candidate' AND b.is_defect", 'd_d')}, two AS (SELECT id, d_n, d_d FROM dn JOIN dd USING (id))"


def dual(spark, d):
    q = part(spark, d, "query")
    a = knn.knn_scores(q, part(spark, d, "clean")).select(F.col("query_id").alias("id"), F.col("score").alias("d_n"))
    b = knn.knn_scores(q, part(spark, d, "candidate").filter("is_defect")).select(F.col("query_id").alias("id"), F.col("score").alias("d_d"))
    return a.join(b, "id")


@query(f"WITH {DUAL} SELECT id, round(d_n - 0.5 * d_d, 6) + 0.0 AS margin FROM two")
def dual_bank_margin(spark, d):
    return show(bank.dual_margin(dual(spark, d), 0.5).select("id", "margin"), "margin")


#: Reference patches are normal candidates, defect banks the candidates' defects by class, the gate is at 80 %.
DUAL_CLASSES = f"""WITH {PF}, x AS (SELECT * FROM pf WHERE role = 'query' OR role = 'candidate' AND NOT is_defect),
n AS (SELECT q.vec_id AS id, q.role, min({DIST}) AS d_n FROM x q, pf b WHERE b.role = 'clean' GROUP BY ALL),
a AS (SELECT q.vec_id AS id, q.role, b.class_id AS c, min({DIST}) AS d_a FROM x q, pf b WHERE b.role = 'candidate' AND b.is_defect GROUP BY ALL),
nf AS (SELECT median(d_n) AS m, quantile_cont(d_n, 0.75) - quantile_cont(d_n, 0.25) AS i, quantile_cont(d_n, 0.8) AS gate FROM n WHERE role = 'candidate'),
af AS (SELECT c, median(-d_a) AS m, quantile_cont(-d_a, 0.75) - quantile_cont(-d_a, 0.25) AS i FROM a WHERE role = 'candidate' GROUP BY c),
z AS (SELECT id, d_n, gate, (d_n - m) / CASE WHEN i <= 1e-12 THEN 1 ELSE i END AS zn FROM n, nf WHERE role = 'query'),
v AS (SELECT id, c, d_a, (-d_a - m) / CASE WHEN i <= 1e-12 THEN 1 ELSE i END AS za FROM a JOIN af USING (c) WHERE role = 'query'),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY za DESC, c) = 1)
SELECT id, c AS predicted_class, round(zn, 6) + 0.0 AS normal, round(za, 6) + 0.0 AS anomaly_diagnostic, round(zn + 0.7 * za, 6) + 0.0 AS margin, round(zn / greatest(d_a, 1e-8), 6) + 0.0 AS ratio,
 round(CASE WHEN d_n >= gate THEN zn + 0.7 * za ELSE zn END, 6) + 0.0 AS gated_hybrid FROM z JOIN b USING (id)"""


@query(DUAL_CLASSES)
def dual_bank_modes(spark, d):
    candidates = part(spark, d, "candidate")
    found = DualBank(part(spark, d, "clean"), candidates.filter("is_defect"), weight=0.7, gate_level=80.0).fit(candidates.filter("NOT is_defect"))
    return show(found.transform(part(spark, d, "query")).select("id", "predicted_class", *DUAL_MODES), *DUAL_MODES)


@query(f"WITH {PF}, s AS (SELECT q.vec_id AS query_id, b.class_id, round(min({DIST}), 6) AS dist FROM pf q, pf b WHERE q.role = 'query' AND b.role = 'candidate' AND b.class_id > 0 GROUP BY ALL) SELECT query_id, arg_min(class_id, (dist, class_id)) AS class_id, min(dist) AS dist FROM s GROUP BY 1")
def class_wise_banks(spark, d):
    scores = knn.class_scores(part(spark, d, "query"), part(spark, d, "candidate").filter("class_id > 0"))
    return knn.best_class(rounded_score(scores, "dist"))


ANOM = f"{PF}, {CAND}, an AS (SELECT id, image_id, class_id, CASE WHEN is_defect THEN (id % 10) / 10.0 + 0.05 ELSE 0 END AS overlap, score FROM cand)"


def anomalies(spark, d):
    overlap = F.when(F.col("is_defect"), (F.col("id") % 10) / 10.0 + 0.05).otherwise(0.0)
    return candidates(spark, d).select("id", "image_id", "class_id", overlap.alias("overlap"), "score")


@query(f"WITH {ANOM} SELECT id FROM an WHERE overlap > 0")
def anomaly_selection_8a(spark, d):
    return bank.select_anomalies(anomalies(spark, d), "any", allow_oracle=True).select("id")


@query(f"WITH {ANOM} SELECT id FROM an WHERE overlap >= 0.5 AND class_id <> 2 AND score >= (SELECT quantile_cont(score, 0.5) FROM an)")
def anomaly_selection_8b(spark, d):
    return bank.select_anomalies(anomalies(spark, d), "ratio_50", level=50.0, held_out=2, allow_oracle=True).select("id")


@query(f"WITH {ANOM}, t AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, id) AS rn FROM an WHERE overlap >= 0.1) WHERE rn <= 3) {ranked('cap', 42, 't', '20')}")
def anomaly_selection_8c(spark, d):
    return bank.select_anomalies(anomalies(spark, d), "ratio_10", per_image=3, total=20, allow_oracle=True).select("id")


#: Each step keeps every row with its least squared distance to the picks (-1 for a pick); the first of a step is its pick.
GREEDY = f"""WITH RECURSIVE {PF}, w(pick, id, f, near) AS (SELECT 0, vec_id, features, 'infinity'::DOUBLE FROM pf UNION ALL
 SELECT pick + 1, id, f, CASE WHEN id = far THEN -1 ELSE least(near, list_sum(list_transform(list_zip(f, far_f), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) END
 FROM (SELECT *, first_value(id) OVER o AS far, first_value(f) OVER o AS far_f FROM w WINDOW o AS (ORDER BY near DESC, id)) WHERE pick < 24)
SELECT id, pick::INTEGER AS pick FROM w QUALIFY row_number() OVER (PARTITION BY pick ORDER BY near DESC, id) = 1"""


@query(GREEDY)
def coreset_greedy(spark, d):
    return bank.coreset(patch_features(spark, d).select(F.col("vec_id").alias("id"), "features"), 25)


@query(f"WITH {PF}, c AS (SELECT image_id, features AS cls FROM pf WHERE row = 0 AND col = 0) SELECT q.vec_id AS id, round(list_inner_product(q.features, cls) / ((sqrt(list_inner_product(q.features, q.features)) + 1e-8) * (sqrt(list_inner_product(cls, cls)) + 1e-8)), 6) + 0.0 AS score FROM pf q JOIN c USING (image_id)")
def cls_cosine(spark, d):
    rows = patch_features(spark, d)
    cls = rows.filter("row = 0 AND col = 0").select("image_id", F.col("features").alias("cls"))
    return rows.join(cls, "image_id").select(F.col("vec_id").alias("id"), shown(cosine(F.col("features"), F.col("cls"))).alias("score"))


MEAN = "m AS (SELECT list(x ORDER BY i) AS p FROM (SELECT i, avg(features[i]) AS x FROM pf, range(1, 65) t(i) WHERE role = 'clean' GROUP BY i))"


@query(f"WITH {PF}, {MEAN} SELECT q.vec_id AS id, round(1 - list_inner_product(q.features, p) / ((sqrt(list_inner_product(q.features, q.features)) + 1e-8) * (sqrt(list_inner_product(p, p)) + 1e-8)), 6) + 0.0 AS score FROM pf q, m WHERE q.role = 'query'")
def cls_prototype(spark, d):
    return rounded_score(detectors.build("prototype").fit(part(spark, d, "clean")).transform(part(spark, d, "query")).select("id", "score"))


@query(f"WITH {PF} SELECT vec_id AS id, round(sqrt(list_inner_product(features, features)), 6) + 0.0 AS score FROM pf")
def patch_l2(spark, d):
    return patch_features(spark, d).select(F.col("vec_id").alias("id"), shown(norm(F.col("features"))).alias("score"))


@query(f"WITH {PF}, s AS (SELECT row, col, i, avg(features[i]) AS m, coalesce(var_samp(features[i]), 0) + 1e-5 AS v FROM pf, range(1, 65) t(i) WHERE role = 'clean' GROUP BY ALL) SELECT q.vec_id AS id, round(sqrt(sum((q.features[i] - m) * (q.features[i] - m) / v)), 6) + 0.0 AS score FROM pf q JOIN s USING (row, col) WHERE q.role = 'query' GROUP BY 1")
def mahalanobis_diag(spark, d):
    return rounded_score(detectors.build("mahalanobis").fit(part(spark, d, "clean")).transform(part(spark, d, "query")).select("id", "score"))


#: Attention between the vectors of an image: a class token (its mean vector) and its 20 patches; layer and head l and h look at
#: the four components from 8 l + 4 h on, by softmax of their products over sqrt(4).
TOKENS = """tok AS (SELECT image_id, 1 + row * 5 + col AS t, features AS f FROM pf UNION ALL
 SELECT image_id, 0, list(m ORDER BY i) FROM (SELECT image_id, i, avg(features[i]) AS m FROM pf, range(1, 65) r(i) GROUP BY ALL) GROUP BY image_id)"""
ATT = f"""{TOKENS}, raw AS (SELECT a.image_id, l AS layer, h AS head, a.t AS q, b.t AS k, list_inner_product(a.f[8 * l + 4 * h + 1 : 8 * l + 4 * h + 4], b.f[8 * l + 4 * h + 1 : 8 * l + 4 * h + 4]) / 2.0 AS z
 FROM tok a JOIN tok b ON a.image_id = b.image_id, range(4) x(l), range(2) y(h)),
sm AS (SELECT image_id, layer, head, q, k, exp(z - max(z) OVER w) AS e FROM raw WINDOW w AS (PARTITION BY image_id, layer, head, q)),
att AS (SELECT image_id, layer, q, k, avg(w) AS w FROM (SELECT *, e / sum(e) OVER (PARTITION BY image_id, layer, head, q) AS w FROM sm) GROUP BY ALL)"""


def rollout_sql(discard: float, last: int = 4) -> str:
    """Row weights ``nrm`` of the last layers, with the discard of the smallest, and the class token's way ``roll`` through them."""
    ids = range(4 - last, 4)
    chain = f"v{ids[0]} AS (SELECT image_id, k, w FROM nrm WHERE layer = {ids[0]} AND q = 0)"
    for i in ids[1:]:
        chain += f", v{i} AS (SELECT v.image_id, n.k, sum(v.w * n.w) AS w FROM v{i - 1} v JOIN nrm n ON n.image_id = v.image_id AND n.layer = {i} AND n.q = v.k GROUP BY ALL)"
    return f"""one AS (SELECT image_id, layer, q, k, (w + CASE WHEN q = k THEN 1 ELSE 0 END) / (sum(w) OVER (PARTITION BY image_id, layer, q) + 1 + 1e-8) AS w FROM att),
lim AS (SELECT image_id, layer, quantile_cont(w, {1 - discard}) AS t FROM one GROUP BY ALL), cut AS (SELECT one.* FROM one JOIN lim USING (image_id, layer) WHERE {discard} = 0 OR w >= t),
nrm AS (SELECT image_id, layer, q, k, CASE WHEN {discard} = 0 THEN w ELSE w / (sum(w) OVER (PARTITION BY image_id, layer, q) + 1e-8) END AS w FROM cut), {chain},
roll AS (SELECT image_id, (k - 1) // 5 AS row, (k - 1) % 5 AS col, w AS score FROM v3 WHERE k > 0)"""


def attention(spark, d):
    """(image_id, layer, head, q, k, w) of the vectors, as in ``ATT``."""
    patches = patch_features(spark, d)
    mean = grid.mean_vector(patches, ("image_id",)).select("image_id", F.lit(0).cast("long").alias("t"), F.col("prototype").alias("f"))
    tokens = patches.select("image_id", (1 + F.col("row") * 5 + F.col("col")).cast("long").alias("t"), F.col("features").alias("f")).unionByName(mean)
    layers = F.array(*[F.struct(F.lit(i).alias("layer"), F.lit(h).alias("head")) for i in range(4) for h in range(2)])
    sides = lambda n: tokens.select("image_id", F.col("t").alias(n), F.inline(layers), F.col("f").alias(f"f{n}")).withColumn(f"f{n}", F.expr(f"slice(f{n}, 8 * layer + 4 * head + 1, 4)"))
    pairs = sides("q").join(sides("k"), ["image_id", "layer", "head"])
    return grid.softmax_attention(pairs.select("image_id", "layer", "head", "q", "k", dot(F.col("fq"), F.col("fk")).alias("score")), 4)


@query(f"WITH {PF}, {ATT}, {rollout_sql(0)} SELECT a.image_id, a.q, b.k, round(sum(a.w * b.w), 6) + 0.0 AS w FROM nrm a JOIN nrm b ON a.image_id = b.image_id AND a.layer = 0 AND b.layer = 1 AND a.k = b.q GROUP BY ALL")
def rollout_product(spark, d):
    two = grid.reduce_heads(attention(spark, d).filter("layer < 2"))
    return rounded_score(grid.rollout(two, starts=F.lit(True)), "w")


@query(f"WITH {PF}, {ATT}, {rollout_sql(0.3, 3)} SELECT image_id, row, col, round(score, 6) + 0.0 AS score FROM roll")
def rollout_discard(spark, d):
    """The last three layers, of which the smallest 70 % of weights go."""
    return rounded_score(cls_rollout(attention(spark, d), 5, last_layers=3, discard=0.3).select("image_id", "row", "col", "score"))


@query(f"WITH {EV}, s AS (SELECT row, col, avg(score) AS m, coalesce(stddev_samp(score), 0) + 1e-5 AS s FROM ev WHERE image_id % 2 = 0 GROUP BY ALL) SELECT event_id, round(abs(score - m) / s, 6) + 0.0 AS deviation FROM ev JOIN s USING (row, col) WHERE image_id % 2 = 1")
def rollout_deviation(spark, d):
    rows = event_scores(spark, d)
    out = grid.cell_deviation(rows.filter("image_id % 2 = 1"), grid.cell_stats(rows.filter("image_id % 2 = 0")))
    return show(out.select("event_id", "deviation"), "deviation")


ZS = f"{EV}, z AS (SELECT event_id AS id, (score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-8) AS za, (row - avg(row) OVER w) / (stddev_pop(row) OVER w + 1e-8) AS zb FROM ev WINDOW w AS (PARTITION BY image_id))"


def branches(spark, d):
    rows = event_scores(spark, d).withColumnRenamed("event_id", "id")
    return rows.select("id", "image_id", "score"), rows.select("id", "image_id", F.col("row").cast("double").alias("score"))


def fused(how):
    return lambda spark, d: rounded_score(detectors.fuse(*branches(spark, d), how=how, weight=0.3).select("id", "score"))


for _how, _sql in (("weighted_sum", "0.3 * za + 0.7 * zb"), ("product", "za * zb"), ("max", "greatest(za, zb)")):
    query(f"WITH {ZS} SELECT id, round({_sql}, 6) + 0.0 AS score FROM z", f"fuse_{_how}")(fused(_how))


@query(f"WITH {ZS} SELECT id, round(za * 0.25 + zb * 0.75, 6) + 0.0 AS score FROM z")
def ensemble_z(spark, d):
    a, b = branches(spark, d)
    return rounded_score(detectors.ensemble([(a, 1.0), (b, 3.0)]).select("id", "score"))


OFFS = "o AS (SELECT a, b FROM range(-1, 2) x(a), range(-1, 2) y(b))"


@query(f"WITH {PF}, {OFFS}, n AS (SELECT q.image_id, q.row, q.col, i, avg(p.features[i]) AS x FROM pf q CROSS JOIN o JOIN pf p ON p.image_id = q.image_id AND p.row = greatest(0, least(3, q.row + a)) AND p.col = greatest(0, least(4, q.col + b)), range(1, 65) t(i) GROUP BY ALL) SELECT image_id, row, col, round(sum(x * i), 6) + 0.0 AS score FROM n GROUP BY ALL")
def neighbour_mean(spark, d):
    rows = grid.neighbour_mean(patch_features(spark, d), 4, 5)
    total = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("image_id", "row", "col", shown(total).alias("score"))


SOB = f"{PF}, k AS (SELECT * FROM (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1), (0, 0, 0, 0)) t(a, b, wx, wy)), g AS (SELECT q.image_id, q.row, q.col, i, sum(p.features[i] * wx) AS gx, sum(p.features[i] * wy) AS gy FROM pf q CROSS JOIN k JOIN pf p ON p.image_id = q.image_id AND p.row = q.row + a AND p.col = q.col + b, range(1, 65) t(i) GROUP BY ALL), n AS (SELECT *, sqrt(gx * gx + gy * gy + 1e-8) AS m FROM g)"
for _how, _sql in (("l2", "sqrt(sum(m * m))"), ("mean", "avg(m)"), ("max", "max(m)")):
    query(f"WITH {SOB} SELECT image_id, row, col, round({_sql}, 6) + 0.0 AS score FROM n GROUP BY ALL", f"sobel_norm_{_how}")(
        lambda spark, d, how=_how: rounded_score(grid.sobel_norm(patch_features(spark, d), how))
    )


@query()
def isolation_forest(spark, d):
    return detectors.build("isolation_forest", trees=16).fit(part(spark, d, "clean")).transform(part(spark, d, "query"))


@query()
def raw_pca_forest(spark, d):
    return detectors.build("isolation_forest", trees=16, components=8, standardise=True).fit(part(spark, d, "clean")).transform(part(spark, d, "query"))


@query()
def linear_probe(spark, d):
    return detectors.build("linear_probe").fit(part(spark, d, "candidate")).transform(part(spark, d, "query"))


@query()
def focal_probe(spark, d):
    return detectors.build("focal_probe", epochs=5).fit(part(spark, d, "candidate")).transform(part(spark, d, "query"))


@query()
def pca_mask(spark, d):
    return detectors.pca_mask(patch_features(spark, d), 4, 5, limit=0.0)


@query(f"WITH {PF}, r AS (SELECT vec_id, image_id, row, col, NOT is_defect AS keep FROM pf) SELECT image_id, row, col, vec_id, keep OR NOT EXISTS (SELECT 1 FROM r b WHERE b.image_id = a.image_id AND NOT b.keep AND abs(a.row - b.row) + abs(a.col - b.col) = 1) AS keep FROM r a")
def spatial_cleanup(spark, d):
    rows = patch_features(spark, d).select("vec_id", "image_id", "row", "col", (~F.col("is_defect")).alias("keep"))
    return geometry.spatial_cleanup(rows, 2)


BOXES = f"""WITH RECURSIVE {PF}, cells AS (SELECT image_id, row * 5 + col AS k, row, col FROM pf WHERE is_defect),
reach AS (SELECT image_id, k AS a, k AS b FROM cells UNION SELECT r.image_id, r.a, y.k FROM reach r JOIN cells x ON x.image_id = r.image_id AND x.k = r.b JOIN cells y ON y.image_id = x.image_id AND abs(x.row - y.row) <= 1 AND abs(x.col - y.col) <= 1),
root AS (SELECT image_id, b AS k, min(a) AS root FROM reach GROUP BY ALL), num AS (SELECT image_id, k, (dense_rank() OVER (PARTITION BY image_id ORDER BY root) - 1)::INTEGER AS component FROM root),
box AS (SELECT image_id, component, count(*) AS area, min(row) * 14.0::DOUBLE AS y1, min(col) * 28.0::DOUBLE AS x1, (max(row) + 1) * 14.0::DOUBLE AS y2, (max(col) + 1) * 28.0::DOUBLE AS x2 FROM num JOIN cells USING (image_id, k) GROUP BY ALL)
SELECT image_id, component, area, x1, y1, x2, y2, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM box WHERE area >= 2"""


@query(BOXES)
def component_boxes(spark, d):
    parts = geometry.components(patch_features(spark, d).filter("is_defect"), 8)
    return geometry.component_boxes(parts, 14, 1.0, 2.0, 2)


@query(f"WITH {PF} SELECT vec_id AS id, CASE WHEN class_id > 0 AND vec_id % 10 >= 5 THEN class_id ELSE 0 END AS best, CASE WHEN class_id > 0 AND vec_id % 10 >= 5 THEN (vec_id % 10) / 10.0 ELSE 0 END AS best_score FROM pf")
def gated_class_scores(spark, d):
    rows = patch_features(spark, d).select(F.col("vec_id").alias("id"), F.col("class_id").alias("pred_class"), ((F.col("vec_id") % 10) / 10.0).alias("score"))
    out = detectors.gated_class_scores(rows, 0.5, [1, 2, 3, 4])
    best = F.array_max(F.map_values("class_scores"))
    return out.select("id", F.when(best > 0, F.col("pred_class")).otherwise(0).alias("best"), best.alias("best_score"))


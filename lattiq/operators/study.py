"""Reports over runs: paired contrasts, seed summaries, conditions; bootstrap intervals come from ``bootstrap``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import bankers
from .bootstrap import bootstrap, condition_table  # noqa: F401
from .order import hash_rank, percentiles, ranked
from .shared import written

#: Contamination rates in percent, and compositions of the contamination study.
RATES = (1, 2, 5, 10, 20, 30)
COMPOSITIONS = ("class_1", "class_2", "class_3", "class_4", "random", "class_balanced")


def long_metrics(runs: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("condition", "seed", "fold")) -> DataFrame:
    return runs.unpivot(list(keys), list(metrics), "metric", "value")


def paired_deltas(runs: DataFrame, a: str, b: str, metrics: Sequence[str], keys: Sequence[str] = ("seed", "fold")) -> DataFrame:
    """Metric of condition a minus b, for keys and metrics that both have."""
    rows = long_metrics(runs, metrics, ["condition", *keys]).filter("value IS NOT NULL")
    x, y = (rows.filter(F.col("condition") == c).select(*keys, "metric", F.col("value").alias(n)) for c, n in ((a, "a"), (b, "b")))
    return x.join(y, [*keys, "metric"]).withColumn("delta", F.col("a") - F.col("b"))


def sign_counts(deltas: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    d = F.col("delta")
    return deltas.groupBy("metric").agg(F.avg(d).alias("mean"), F.count_if(d > tolerance).alias("positive"), F.count_if(d < -tolerance).alias("negative"), F.count_if(F.abs(d) <= tolerance).alias("zero"))


def seed_summary(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """n, mean, sample std (0 for one run) and median per condition and metric."""
    rows = long_metrics(runs, metrics).filter("value IS NOT NULL")
    return rows.groupBy("condition", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.median("value").alias("median"))


def fold_summary(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population std over folds of the known values."""
    long = rows.unpivot(["fold"], list(metrics), "metric", "value").filter("value IS NOT NULL AND NOT isnan(value)")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def oracle_gap(runs: DataFrame, oracle: str, auto: str, metric: str, keys: Sequence[str] = ("fold", "seed")) -> DataFrame:
    o, a = (runs.filter(F.col("condition") == c).select(*keys, F.col(metric).alias(n)) for c, n in ((oracle, "oracle"), (auto, "auto")))
    return o.join(a, list(keys)).withColumn("gap", F.col("oracle") - F.col("auto"))


def control_rank(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Rank of controls: highest AUPRC, then least threshold shift, then highest fixed F1, then name."""
    w = Window.partitionBy(*group).orderBy(F.desc("auprc"), F.abs("threshold_delta"), F.desc("fixed_f1"), "name")
    return rows.withColumn("rank", F.row_number().over(w))


def contamination_conditions(spark: SparkSession) -> DataFrame:
    """Rates by compositions, and one shared condition of rate 0."""
    rows = spark.createDataFrame([(r,) for r in RATES], "rate int").join(spark.createDataFrame([(c,) for c in COMPOSITIONS], "composition string"), F.lit(True))
    return rows.unionByName(spark.createDataFrame([(0, "none")], "rate int, composition string"))


def contamination_plan(spark: SparkSession, clean: DataFrame, defects: DataFrame) -> DataFrame:
    """The contamination conditions with what a pool of defect patches (class_id) has for each (``available``: a class's patches,
    all for ``random``, and as many of each class as the rarest has for ``class_balanced``) and how many a bank of the clean
    patches gets (``added``: the rate's share of the grown bank, halves to even, at least one of what there is)."""
    per = defects.groupBy("class_id").agg(F.count("*").alias("n"))
    have = per.select(F.concat(F.lit("class_"), F.col("class_id").cast("string")).alias("composition"), F.col("n").alias("available"))
    have = have.unionByName(per.agg(F.sum("n").alias("available")).select(F.lit("random").alias("composition"), "available"))
    have = have.unionByName(per.agg((F.min("n") * F.count("*")).alias("available")).select(F.lit("class_balanced").alias("composition"), "available"))
    rows = contamination_conditions(spark).join(F.broadcast(have), "composition", "left").crossJoin(F.broadcast(clean.agg(F.count("*").alias("n"))))
    rows = rows.withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))
    share = F.bround(F.col("rate") / (100.0 - F.col("rate")) * F.col("n"), 0).cast("long")
    added = F.when((F.col("rate") == 0) | (F.col("available") == 0), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.least(share, F.col("available"))))
    return rows.select("rate", "composition", "available", added.alias("added"))


#: Acceptance percentiles and trimmed shares of the purification controls, patches of a bank of a fixed budget.
CONTROL_LEVELS, CONTROL_TRIMS, FINAL_BUDGET = (95.0, 97.5, 99.0, 99.5), (0.05, 0.10, 0.20), 51_200


def control_conditions(spark: SparkSession) -> DataFrame:
    """(name, condition, percentile, trim_fraction) of the purification controls: acceptance at each percentile, as many candidates by
    chance, and trims of a fixed share."""
    tag = lambda q: f"{q:g}".replace(".", "_")
    rows = [(f"{n}_p{tag(q)}", c, q, None) for q in CONTROL_LEVELS for n, c in (("auto", "auto_purified"), ("random_matched", "random_filtered"))]
    rows += [(f"trim_{round(100 * f)}pct", "fixed_ratio_trim", None, f) for f in CONTROL_TRIMS]
    return spark.createDataFrame(rows, "name string, condition string, percentile double, trim_fraction double")


def budget_conditions(spark: SparkSession, purification: str = "auto_purified", oracle: str = "oracle_purified", optional: bool = True) -> DataFrame:
    """(name, condition, clean_shots, additional_shots, budget_policy, budget, filter) of the studies of a fixed budget: clean banks of 1
    to 8 images, the expanded bank in full and by chance, purified expansions of 1, 2 and 4 clean images, and the expansions
    that a purified one is held against at the same budget."""
    greedy, none = "greedy_coreset", "none"
    rows = [(f"clean_{n}", "clean", n, 0, greedy, FINAL_BUDGET, none) for n in (1, 2, 4, 8)]
    rows += [("expanded_full_2plus8", "contaminated_all", 2, 8, None, None, none), ("expanded_random_budget_2plus8", "contaminated_all", 2, 8, "random", FINAL_BUDGET, none)]
    rows += [(f"purified_budget_{n}plus8", purification, n, 8, greedy, FINAL_BUDGET, "selected_purification") for n in (1, 2, 4)]
    rows += [("naive_greedy_budget_2plus8", "contaminated_all", 2, 8, greedy, FINAL_BUDGET, none), ("random20_greedy_budget_2plus8", "random_filtered", 2, 8, greedy, FINAL_BUDGET, "random_reject_20")]
    rows += [("oracle_greedy_budget_2plus8", oracle, 2, 8, greedy, FINAL_BUDGET, "oracle_overlap")]
    rows += [("naive_greedy_budget_4plus8", "contaminated_all", 4, 8, greedy, FINAL_BUDGET, none)] if optional else []
    return spark.createDataFrame(rows, "name string, condition string, clean_shots int, additional_shots int, budget_policy string, budget int, filter string")


def control_outcomes(clean: DataFrame, candidates: DataFrame, seed: int = 42) -> DataFrame:
    """(name, condition, accepted, defects): what each purification control takes of the candidates (id, score, is_defect). Percentiles are
    of ``clean`` scores, candidates by chance go by hash rank, trims by score, then id."""
    spark = clean.sparkSession
    ps = percentiles(clean, "score", [q / 100 for q in CONTROL_LEVELS])
    rows = written(hash_rank(ranked(candidates.select("id", "score", "is_defect"), [F.col("score"), F.col("id")], name="near"), "matched", seed, "id"), "controls")
    limits = [F.get("ps", F.lit(i)) for i in range(len(CONTROL_LEVELS))]
    counts = rows.crossJoin(F.broadcast(ps)).agg(F.first("ps").alias("ps"), F.count("*").alias("n"), F.array(*[F.count_if(F.col("score") <= t) for t in limits]).alias("taken"))
    cells = []
    for i, q in enumerate(CONTROL_LEVELS):
        cells += [(q, "auto_purified", F.col("score") <= limits[i]), (q, "random_filtered", F.col("rank") < F.get("taken", F.lit(i)))]
    cells += [(f, "fixed_ratio_trim", F.col("near") < bankers((1 - f) * F.col("n"))) for f in CONTROL_TRIMS]
    key = F.coalesce("percentile", "trim_fraction")
    kept = F.filter(F.array(*[F.struct(F.lit(float(k)).alias("k"), F.lit(c).alias("condition"), t.alias("taken")) for k, c, t in cells]), lambda s: s["taken"])
    taken = rows.crossJoin(F.broadcast(counts)).select("is_defect", F.explode(kept).alias("s")).groupBy("s.k", "s.condition").agg(F.count("*").alias("accepted"), F.count_if("is_defect").alias("defects"))
    names = control_conditions(spark).withColumn("k", key)
    return names.join(taken, ["k", "condition"], "left").select("name", "condition", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("defects", F.lit(0)).alias("defects"))


def held_out_matrix(spark: SparkSession, folds: Sequence[int], seeds: Sequence[int], conditions: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(f, s, c) for f in folds for s in seeds for c in conditions], "fold int, seed int, condition string")


def open_jobs(jobs: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Jobs without results, in order, up to a report limit."""
    rows = jobs.join(done, list(done.columns), "left_anti").orderBy(*jobs.columns)
    return rows if limit is None else rows.limit(limit)


def paired_ids(runs: DataFrame, ids: str = "ids") -> DataFrame:
    """(fold, seed, variants): how many different id lists the conditions of a pair have (1 is right)."""
    return runs.groupBy("fold", "seed").agg(F.count_distinct(F.sort_array(ids)).alias("variants"))


def class_delta(rows: DataFrame, metric: str = "auprc") -> DataFrame:
    """A class's metric minus the mean of the other classes'."""
    total = rows.agg(F.sum(metric).alias("__s"), F.count(metric).alias("__n"))
    return rows.crossJoin(F.broadcast(total)).withColumn("delta", F.col(metric) - F.try_divide(F.col("__s") - F.col(metric), F.col("__n") - 1)).drop("__s", "__n")


def ensemble_grid(scores: DataFrame, steps: int = 11) -> DataFrame:
    """(weight, score) for weights 0 to 1 of two members' z-scores ``z1`` and ``z2``, scored once."""
    w = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i / float(steps - 1))).alias("weight")
    return scores.select("*", w).withColumn("score", F.col("weight") * F.col("z1") + (1 - F.col("weight")) * F.col("z2"))


def assert_frozen(settings: dict, expected: dict) -> None:
    """Raises if a setting differs from its frozen value."""
    wrong = {k: settings.get(k) for k, v in expected.items() if settings.get(k) != v}
    if wrong:
        raise ValueError(f"settings differ from the frozen ones: {wrong}")

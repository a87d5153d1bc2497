"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of shuffled documents that may be replayed (``max_epochs`` times). Serving a document ends at virtual
time ``(words of the source served up to and with it) / target of the source``. All servings of all queues are sorted by
that time, which interleaves the sources in proportion to their targets, and the schedule is truncated where its words
reach the total budget: what is served before is taken, the serving in which the budget ends in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Parts into which each source's shuffled order is cut, so that running sums need no task with a whole source.
BUCKETS = 4096
#: Ranges of virtual time, per unit of it, that the schedule is sorted in; every source's words spread evenly over them.
RANGES = 2048
#: The last range, which has all later times.
LAST = 32 * RANGES


def source_targets(sizes: DataFrame, source: str, size: str, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per source: ``source_size``, ``weight`` and ``target`` (double).

    Sources by code point, null last, get ``weights`` in turn and share 100 % of all words. A target stops at
    ``max_epochs`` times its source's size; the excess is shared again by weight until none is above. In closed form
    with sources in order of cap / weight: those below the water level get their cap, the others level * weight.
    No words at all give targets of 0.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("__i", F.row_number().over(by_name) - 1)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", turn).withColumn("__cap", max_epochs * F.col("source_size"))
    ranked = ranked.withColumn("__ratio", F.col("__cap") / F.col("weight"))
    order = Window.orderBy("__ratio", "__i")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.select(
        "*",
        F.coalesce(F.sum("__cap").over(below), F.lit(0)).alias("__used"),
        F.sum("weight").over(onward).alias("__open"),
        F.sum("source_size").over(everything).alias("__total"),
    )
    level = F.when(
        F.col("__ratio") * F.col("__open") >= F.col("__total") - F.col("__used"),
        (F.col("__total") - F.col("__used")) / F.col("__open"),
    )
    ranked = ranked.withColumn("__level", F.first(level, ignorenulls=True).over(everything))
    target = F.least(F.col("__cap").cast("double"), F.col("__level") * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _queues(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, max_epochs: int) -> DataFrame:
    """Each document's place in its source: the words before it in shuffled order (``start``), with the source's figures."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"),
    ).withColumn("__bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    rows = written(rows, "sizes")
    targets = source_targets(rows, "source", "size", weights, max_epochs)
    # running words of a source in two steps: over its buckets, then inside each bucket
    parts = rows.groupBy("source", "__bucket").agg(F.sum("size").alias("__words"))
    ahead = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "__bucket", F.coalesce(F.sum("__words").over(ahead), F.lit(0)).alias("__before"))
    heads = parts.join(targets, parts["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    inside = Window.partitionBy("source", "__bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    r, h = rows.alias("r"), heads.alias("h")
    joined = r.join(h, F.col("r.source").eqNullSafe(F.col("h.source")) & (F.col("r.__bucket") == F.col("h.__bucket")))
    return joined.select("r.doc_id", "r.source", "r.size", "r.key", "h.source_size", "h.target", (F.col("h.__before") + F.col("r.__inside")).alias("start"))


def _finish(epoch: Column) -> Column:
    return (epoch * F.col("source_size") + F.col("start") + F.col("size")) / F.col("target")


def schedule(queues: DataFrame, max_epochs: int = 3) -> DataFrame:
    """The servings that the mix takes, one row each: the columns of ``queues``, ``epoch``, ``finish`` (virtual time),
    ``before`` (words served earlier) and ``words`` (taken in this serving). ``finish``, then ``key``, ``start``,
    ``epoch`` and ``source`` give the order. Its end is the total of all sizes.

    The sort goes by ranges of virtual time, of which those that begin beyond the budget are left out before it.
    """
    budget = queues.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    served = queues.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    served = served.withColumn("finish", _finish(F.col("epoch"))).withColumn("range", F.least(F.floor(F.col("finish") * RANGES), F.lit(LAST)).cast("int"))
    totals = served.groupBy("range").agg(F.sum("size").alias("all"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over at most LAST + 1 rows
    heads = totals.select("range", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("head")).filter(F.col("head") < budget)
    inside = Window.partitionBy("range").orderBy("finish", "key", "start", "epoch", "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = served.join(F.broadcast(heads), "range")
    rows = rows.withColumn("before", F.col("head") + F.coalesce(F.sum("size").over(inside), F.lit(0))).filter(F.col("before") < budget)
    return rows.withColumn("words", F.least(F.col("size"), budget - F.col("before"))).drop("range", "head")


def fair_queue(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), max_epochs: int = 3
) -> DataFrame:
    """The mix, one row per row of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``,
    ``virtual_start`` and ``virtual_finish`` (of the first serving; null where the target is 0).

    ``taken`` counts the words of the schedule (above), repeats too; a source's differ from its target by less than the
    largest documents. Null, empty and word-less texts have size 0 and take nothing; a null source is a source of its own.
    Repeated rows are separate documents, and texts of any length count whole. The shuffle is by md5 of the id, and ties
    go by words before, so a rerun gives the same mix. An empty table gives no rows; other columns are dropped.
    """
    queues = written(_queues(docs, id_col, text_col, source_col, weights, max_epochs), "queues")
    # a document with words is known by its place in its source
    taken = schedule(queues, max_epochs).groupBy(F.col("source").alias("s"), F.col("start").alias("at")).agg(F.sum("words").alias("words"))
    place = F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") > 0)
    mix = queues.join(taken, place, "left")
    time = lambda words: F.when(F.col("target") > 0, words / F.col("target"))
    return mix.select(
        "doc_id", "source", "size", "source_size", "target",
        F.coalesce("words", F.lit(0)).cast("long").alias("taken"),
        time(F.col("start")).alias("virtual_start"),
        time(F.col("start") + F.col("size")).alias("virtual_finish"),
    )

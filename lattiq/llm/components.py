"""Connected components of a link table by contraction: roots hook on to lower ones, trees are flattened by pointer
jumping, and links go on between roots. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import spent, written

#: Rows of links or labels that a file is meant to hold: few rows in as many files as shuffles have partitions cost more than they hold.
FILE_ROWS = 200_000


def _roots(table: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    """(node, comp) with every ``comp`` at the root of its tree, and the table that it is in; the depth goes to a third at each
    step, and a tree of depth two is done in one."""
    parent = table
    while True:
        up = lambda old, new: parent.select(F.col("node").alias(old), F.col("comp").alias(new))
        step = parent.join(up("comp", "second"), "comp").join(up("second", "third"), "second")
        step, seen = _counted(step.select("node", "second", "third").coalesce(files), "components", F.count_if(F.col("third") < F.col("second")))
        spent(table)
        table, parent = step, step.select("node", F.col("third").alias("comp"))
        if not seen:
            return parent, table


def _counted(rows: DataFrame, name: str, count: Column) -> tuple[DataFrame, int]:
    """``written``, with a count that is taken while the rows are written: each query more costs the driver memory."""
    seen = Observation()
    table = written(rows.observe(seen, count.alias("n")), name)
    return table, seen.get["n"]


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (x, y), comp being the least node it is linked with. No links, no rows.

    Each node hooks on to its lowest neighbour if that is lower, so no tree's root is higher than a member. A root that
    no round merges with another has only neighbours below other roots, and hooks in the next: roots with links at least
    halve in two rounds.
    """
    both = links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    edges, n = _counted(both.filter("x != y").distinct(), "edges", F.count("*"))
    files = 1 + n // FILE_ROWS
    label = None
    while True:
        parent = written(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("comp")).coalesce(files), "labels")
        roots, table = _roots(parent, files)
        if label is None:
            new = roots
            new.written_to = table.written_to
        else:  # roots without links to others stay as they are
            up = roots.select(F.col("node").alias("comp"), F.col("comp").alias("new"))
            new = written(label.join(up, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")).coalesce(files), "components")
            spent(label)
        first, label, old = label is None, new, edges
        low = lambda c: roots.select(F.col("node").alias(c), F.col("comp").alias(f"r{c}"))
        edges = edges.join(low("x"), "x").join(low("y"), "y").filter("rx != ry").select(F.col("rx").alias("x"), F.col("ry").alias("y")).distinct()
        edges, n = _counted(edges.coalesce(files), "edges", F.count("*"))
        spent(*([old] if first else [table, old]))
        if not n:
            spent(edges)
            return label

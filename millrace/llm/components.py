"""Connected components of a graph given as edges, by rounds of contraction.

In a round each node points to the least of itself and its neighbours; pointers are followed to their ends by doubling; then edges are those
between different ends, and the nodes of the next round are the ends that still have edges. So edges within a set that hangs together are gone
after a round, and each round leaves half of the nodes at most.

Every step is written to the shared folder, so lineage stays short and a lost executor costs one step. Joins are between tables read from there,
so both sides are shuffled and AQE can split a hot end; nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage, unstage


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the edges ``(a, b)``: root is the least node that it reaches.

    Loops and repeated edges are allowed; edges with a null end are ignored; no edges give no rows.
    """
    left = stage(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while True:
        both = left.union(left.select("b", "a"))
        ends = _followed(stage(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")), "pointers"))
        at = lambda end: ends.select(F.col("node").alias(end), F.col("root").alias(f"at_{end}"))
        moved = left.join(at("a"), "a").join(at("b"), "b").where("at_a != at_b")
        new = stage(moved.select(F.least("at_a", "at_b").alias("a"), F.greatest("at_a", "at_b").alias("b")).distinct(), "edges")
        if roots is None:
            roots = ends
        else:
            last = ends.select(F.col("node").alias("root"), F.col("root").alias("end"))
            old, roots = roots, stage(roots.join(last, "root", "left").select("node", F.coalesce("end", "root").alias("root")), "roots")
            unstage(old, ends)
        unstage(left)
        left = new
        if left.isEmpty():
            unstage(left)
            return roots


def _followed(pointers: DataFrame) -> DataFrame:
    """Pointers ``(node, root)`` with every root at the end of its chain."""
    while True:
        on = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
        longer = stage(pointers.join(on, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "pointers")
        unstage(pointers)
        pointers = longer.select("node", "root")
        if longer.where("moved").isEmpty():
            return pointers

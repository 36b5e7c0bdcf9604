"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeway.session import discard, materialise


def contract(edges: DataFrame) -> DataFrame:
    """Component of each node of ``edges`` (a, b: long): node, root.

    In each round every node takes the least label among itself and its neighbours, and
    labels become the nodes of the next, smaller graph. Labels must be as good as random
    (hashes), so that a fixed share of the nodes goes in each round whatever the shape.
    Rounds are written to the shared folder, which cuts their lineage.
    """
    left = materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")
    roots = known = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialise(
            both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).select(F.col("a").alias("node"), "to"),
            "labels")
        if roots is None:
            roots = step.select("node", F.col("to").alias("root"))
        else:
            moved = step.select(F.col("node").alias("root"), "to")
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        before, roots = known, materialise(roots, "roots")
        known = roots
        discard(before)
        label_a = step.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        label_b = step.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        after = materialise(
            left.join(label_a, "a").join(label_b, "b").where("_a <> _b")
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
        discard(left, step)
        left = after
    discard(left)
    return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0) if roots is None else roots

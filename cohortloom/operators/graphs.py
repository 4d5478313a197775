"""Connected components and minimum spanning trees of edge tables, by rounds of joins and combined aggregations.

Every round writes its edges, contracts what is linked and goes on with what is left, so no round sees more than the
one before, and the number of rounds goes with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialise


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, up) with up <= node: every node looks one, two, four ... steps up."""
    parents = materialise(parents, "parents")
    while True:
        above = parents.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        jumped = materialise(parents.join(above, F.col("up") == F.col("_n"), "left").select(
            "node", "up", F.coalesce("_u", "up").alias("far")), "parents")
        if jumped.where("far <> up").isEmpty():
            return jumped.select("node", F.col("up").alias("root"))
        parents = jumped.select("node", F.col("far").alias("up"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node that it is linked with. Loops are links too."""
    labels = materialise(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select(
        "node", F.col("node").alias("root")), "labels")
    left = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not left.isEmpty():
        roots = _roots(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        top = lambda df, c: df.join(roots.toDF("_n", "_r"), F.col(c) == F.col("_n"), "left").withColumn(
            c, F.coalesce("_r", c)).drop("_n", "_r")
        labels = materialise(top(labels, "root"), "labels")
        moved = top(top(left, "a"), "b").where("a <> b")
        left = materialise(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b, w) of the lightest forest that links what all edges link; equal weights by a, then b.

    In every round each component takes its lightest edge to another one, so components at least halve.
    """
    own = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    left = materialise(own.groupBy("a", "b").agg(F.min("w").alias("w")).select(
        "a", "b", "w", F.col("a").alias("ra"), F.col("b").alias("rb")), "edges")
    taken = None
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("ra", "rb")).alias("r"), F.struct("w", "a", "b", "ra", "rb").alias("e"))
        light = materialise(ends.groupBy("r").agg(F.min("e").alias("e")).select("e.*").distinct(), "lightest")
        taken = light.select("a", "b", "w") if taken is None else taken.union(light.select("a", "b", "w"))
        roots = components(light.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        top = lambda df, c: df.join(roots.toDF("_n", "_r"), F.col(c) == F.col("_n"), "left").withColumn(
            c, F.coalesce("_r", c)).drop("_n", "_r")
        left = materialise(top(top(left, "ra"), "rb").where("ra <> rb"), "edges")
    return (left.select("a", "b", "w") if taken is None else taken).distinct()

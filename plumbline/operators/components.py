"""Connected components by contraction, for edge tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def _priority(node: str | Column) -> Column:
    """An order of nodes that has nothing to do with how they are numbered."""
    return F.struct(F.xxhash64(F.lit(0x5EED), node), node)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root of every node of edges (a, b): equal roots within a component, and only there.

    Every round each node takes as its parent the first of itself and its neighbours in an order by hash, and edges move
    to the parents; edges inside a parent vanish. Because the order is random, a share of the nodes goes every round
    whatever the shape and the numbering (a path of ascending numbers as well), so rounds grow with the logarithm of the
    number of nodes; a star is done in two. Rounds are written to scratch. Parents are followed by doubling: each round's
    table is joined once with what comes after it. Loops, repeated and reversed edges change nothing; nodes must not be
    null.
    """
    edges = scratch.written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    parents = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", _priority("b")).alias("m"))
        parent = F.when(_priority("m") < _priority("node"), F.col("m")).otherwise(F.col("node")).alias("parent")
        parents.append(scratch.written(first.select("node", parent), "parents"))
        left, right = (parents[-1].select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in ("a", "b"))
        moved = edges.join(left, "a").join(right, "b").where("pa <> pb")
        edges = scratch.written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not parents:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while len(parents) > 1:
        parents = [scratch.written(_after(*parents[k : k + 2]), "parents") if k + 1 < len(parents) else parents[k] for k in range(0, len(parents), 2)]
    return parents[0].select("node", F.col("parent").alias("root"))


def _after(first: DataFrame, second: DataFrame) -> DataFrame:
    """Parents after two rounds; what the second round no longer knows is finished."""
    step = second.select(F.col("node").alias("__at"), F.col("parent").alias("__to"))
    return first.join(step, F.col("parent") == F.col("__at"), "left").select("node", F.coalesce("__to", "parent").alias("parent"))

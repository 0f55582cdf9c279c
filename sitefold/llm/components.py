"""Connected components of an edge table by contraction.

Each round hooks every root to its smallest neighbour, follows the hooks to their ends by pointer doubling, and replaces
the edges by the distinct edges between the new roots. Edges and roots shrink; only tables move, nothing is collected.
A label is always a vertex of its component and never larger than what it replaces, so at the end it is the smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm.common import landed


def _hooks(edges: DataFrame) -> DataFrame:
    """(vertex, parent): the smallest neighbour of each vertex that has a smaller one."""
    return edges.groupBy(F.col("high").alias("vertex")).agg(F.min("low").alias("parent"))


def _followed(hooks: DataFrame) -> DataFrame:
    """Hooks that end in a root: parents are replaced by their own parents until none has one."""
    while True:
        up = hooks.select(F.col("vertex").alias("parent"), F.col("parent").alias("grand"))
        joined = hooks.join(up, "parent", "left")
        moved = landed(joined.select("vertex", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moves")))
        hooks = moved.select("vertex", "parent")
        if moved.where("moves").isEmpty():
            return hooks


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(vertex, component) of every vertex that has an edge; component is the smallest vertex reachable.

    Self loops, repeated edges and edges with a null end are ignored.
    """
    low, high = F.least(left, right), F.greatest(left, right)
    known = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    rest = landed(known.select(low.alias("low"), high.alias("high")).distinct())
    labels = None
    while not rest.isEmpty():
        hooks = _followed(_hooks(rest))
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("vertex").alias("parent"), F.col("parent").alias("top"))
            moved = labels.join(up, "parent", "left").select("vertex", F.coalesce("top", "parent").alias("parent"))
            fresh = hooks.join(moved, "vertex", "left_anti")
            labels = landed(moved.unionByName(fresh))
        lows = hooks.select(F.col("vertex").alias("low"), F.col("parent").alias("low_top"))
        highs = hooks.select(F.col("vertex").alias("high"), F.col("parent").alias("high_top"))
        lifted = rest.join(lows, "low", "left").join(highs, "high", "left").select(
            F.coalesce("low_top", "low").alias("a"), F.coalesce("high_top", "high").alias("b")
        )
        rest = landed(lifted.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct())
    if labels is None:
        return rest.select(F.col("low").alias("vertex"), F.col("high").alias("component"))
    roots = labels.select(F.col("parent").alias("vertex"), F.col("parent").alias("component")).distinct()
    return labels.select("vertex", F.col("parent").alias("component")).unionByName(roots)

"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastrat.session import cut

#: Edges a task at least: rounds over few edges should not write hundreds of small files.
TASK_ROWS = 250_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of *edges*; component is the smallest node reached.

    In a round every node points to the first of its neighbours and itself (in the order of nodes, then
    in a new seeded order each round), by a map-side combined minimum, so a hub with millions of edges
    sends one row a task. Pointers are followed to their ends, doubling their reach each time, and
    edges are rewritten between the ends: expected to be a constant share fewer nodes every round, so
    rounds grow with the logarithm of the largest component. Every step is a written table. Edges with
    a null end are ignored; a self loop yields a component of one; an empty input gives an empty result.
    Raises if *max_rounds* do not suffice rather than return unfinished labels.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    tasks = -(-both.count() // TASK_ROWS) or 1
    keep = lambda df: cut(df.coalesce(tasks))
    names = keep(both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("end")))
    left = both.filter("a <> b")
    for number in range(max_rounds):
        if left.isEmpty():
            least = names.groupBy("end").agg(F.min("node").alias("component"))
            return names.join(least, "end").select("node", "component")
        place = lambda c: F.struct((F.xxhash64(F.lit(number), c) if number else F.lit(0)).alias("h"), F.col(c).alias("n"))
        first = F.min(place("b")).alias("first")
        ends = keep(left.groupBy("a").agg(first).select("a", F.least(F.col("first"), place("a"))["n"].alias("end")))
        ends = followed(ends, max_rounds, keep)
        other = ends.select(F.col("a").alias("b"), F.col("end").alias("b_end"))
        left = left.join(ends, "a").join(other, "b").filter("end <> b_end")
        left = keep(left.select(F.col("end").alias("a"), F.col("b_end").alias("b")).distinct())
        moved = ends.select(F.col("a").alias("end"), F.col("end").alias("new"))
        names = keep(names.join(moved, "end", "left").select("node", F.coalesce("new", "end").alias("end")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def followed(ends: DataFrame, max_rounds: int, keep=cut) -> DataFrame:
    """``(a, end)`` with every pointer followed to the node that points to itself."""
    for _ in range(max_rounds):
        hop = ends.select(F.col("a").alias("end"), F.col("end").alias("next"))
        jumped = keep(ends.join(hop, "end").select("a", F.col("next").alias("end"), (F.col("next") != F.col("end")).alias("moved")))
        ends = jumped.select("a", "end")
        if jumped.filter("moved").isEmpty():
            return ends
    raise RuntimeError(f"pointers did not end in {max_rounds} rounds")

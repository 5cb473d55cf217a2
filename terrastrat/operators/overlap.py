"""Overlap of supports: Jaccard, containment, novelty, halos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastrat.operators.graph import connected_components
from terrastrat.operators.kernels import disc, spread, square


def occupied(artifacts: DataFrame, size: int) -> DataFrame:
    """Blocks that hold a cell of each artifact."""
    return artifacts.select("a", F.expr(f"row div {size}").alias("row"), F.expr(f"col div {size}").alias("col")).distinct()


def pairs(artifacts: DataFrame) -> DataFrame:
    """``(a, b, shared, jaccard, containment)`` of every pair of artifacts a < b of ``(a, row, col)``.

    A cell's artifacts are gathered in one list and its pairs counted, so the join is one shuffle on the
    cell; a cell holds at most as many entries as there are artifacts.
    """
    lists = artifacts.groupBy("row", "col").agg(F.sort_array(F.collect_set("a")).alias("s"))
    both = lists.withColumn("a", F.explode("s")).select("a", F.explode("s").alias("b")).filter("a < b")
    shared = both.groupBy("a", "b").agg(F.count("*").alias("shared"))
    n = artifacts.groupBy("a").agg(F.count("*").alias("n"))
    m = n.select(F.col("a").alias("b"), F.col("n").alias("m"))
    rows = n.join(m, F.col("a") < F.col("b")).join(shared, ["a", "b"], "left")
    s = F.coalesce("shared", F.lit(0)).cast("long")
    return rows.select("a", "b", s.alias("shared"), F.round(s / (F.col("n") + F.col("m") - s), 6).alias("jaccard"), F.round(s / F.col("n"), 6).alias("containment"))


def halo(cells: DataFrame, radius: float) -> DataFrame:
    """Cells within *radius* of the given ones."""
    return spread(cells, disc(radius, keep_zero=True), []).select("row", "col").distinct()


def novelty(new: DataFrame, old: DataFrame, radius: float) -> DataFrame:
    """How many new cells lie farther than *radius* from all old ones."""
    near = halo(old, radius).withColumn("near", F.lit(1))
    return new.join(near, ["row", "col"], "left").agg(
        F.count("*").alias("n"), F.count_if(F.col("near").isNull()).alias("novel"), F.round(F.count_if(F.col("near").isNull()) / F.count("*"), 6).alias("share")
    )


def excess(artifacts: DataFrame, new: int) -> DataFrame:
    """Containment of artifact *new* in each other one, beyond the share of the area that one covers."""
    area = artifacts.select("row", "col").distinct().agg(F.count("*").alias("k"))
    own = artifacts.filter(F.col("a") == new).select("row", "col", F.lit(1).alias("own"))
    others = artifacts.filter(F.col("a") < new).join(own, ["row", "col"], "left").groupBy("a").agg(F.count("*").alias("n"), F.count("own").alias("shared"))
    size = own.agg(F.count("*").alias("m"))
    rows = others.join(F.broadcast(area)).join(F.broadcast(size))
    got, chance = F.col("shared") / F.col("m"), F.col("n") / F.col("k")
    return rows.select("a", "shared", F.round(got, 6).alias("containment"), F.round(chance, 6).alias("chance"), F.round(got - chance, 6).alias("excess"))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intersection over union of two sets of cells; two empty sets count 1."""
    x, y = a.select("row", "col", F.lit(1).alias("x")), b.select("row", "col", F.lit(1).alias("y"))
    rows = x.join(y, ["row", "col"], "full")
    both = F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull())
    return rows.agg(both.alias("shared"), F.count("*").alias("either"), F.round(F.coalesce(F.try_divide(both, F.count("*")), F.lit(1.0)), 6).alias("jaccard"))


def small_patches(mask: DataFrame, size: int) -> DataFrame:
    """Cells of the mask in patches (touching by sides or corners) of fewer than *size* cells."""
    name = F.struct("row", "col")
    cells = mask.select("row", "col", name.alias("node"))
    pairs = spread(mask.select("row", "col", name.alias("a")), square(1), ["a"]).join(mask.select("row", "col"), ["row", "col"])
    parts = connected_components(pairs.select("a", name.alias("b")), "a", "b")
    small = parts.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") < size).select("component")
    return parts.join(small, "component", "left_semi").join(cells, "node").select("row", "col")

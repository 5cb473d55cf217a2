"""Choosing cells under budgets, spacing and strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrastrat.functions.expressions import unit_hash
from terrastrat.operators.kernels import Offsets, spread
from terrastrat.session import cut


def top_n(cells: DataFrame, score: str, n: int) -> DataFrame:
    """The n best positive cells, ties by place: a partial top-k in each task, then one merge of n rows."""
    return cells.filter(F.col(score) > 0).orderBy(F.desc(score), "row", "col").limit(n)


def largest_remainder(groups: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``(key, share)``: *total* dealt over a few groups in proportion to weight, remainders to the largest fractions."""
    w = groups.select(key, F.col(weight).cast("double").alias("_w"))
    quota = w.join(F.broadcast(w.agg(F.sum("_w").alias("_s")))).withColumn("_q", F.col("_w") / F.col("_s") * total)
    quota = quota.withColumn("_f", F.floor("_q").cast("long"))
    left = quota.agg((F.lit(total) - F.sum("_f")).alias("_left"))
    place = F.row_number().over(W.orderBy(F.desc(F.round(F.col("_q") - F.col("_f"), 9)), key))
    return quota.join(F.broadcast(left)).withColumn("_p", place).select(key, (F.col("_f") + (F.col("_p") <= F.col("_left")).cast("long")).alias("share"))


def round_robin(cells: DataFrame, score: str, block: int, n: int) -> DataFrame:
    """Round by round the next best cell of every block, until n are taken."""
    rank = F.row_number().over(W.partitionBy(F.expr(f"row div {block}"), F.expr(f"col div {block}")).orderBy(F.desc(score), "row", "col"))
    return cells.withColumn("round", rank.cast("long")).orderBy("round", F.desc(score), "row", "col").limit(n)


def block_best(cells: DataFrame, score: str, block: int) -> DataFrame:
    """The best cell of every block, as one map-side combined minimum."""
    best = F.min(F.struct((-F.col(score)).alias("s"), "row", "col")).alias("b")
    return cells.groupBy(F.expr(f"row div {block}").alias("_r"), F.expr(f"col div {block}").alias("_c")).agg(best).select("b.row", "b.col", (-F.col("b.s")).alias(score))


def spaced(cells: DataFrame, score: str, offsets: Offsets, n: int | None = None, max_rounds: int = 500, period: int | None = None) -> DataFrame:
    """Greedy choice by score (then row, col) in which no two chosen cells lie within *offsets*.

    The sequential rule's result is found in rounds: every undecided cell that precedes all undecided
    cells in conflict with it is chosen, and those in conflict go. n: the first n in order. period: rows
    0..period-1 go round, so the last one lies beside the first. Raises if *max_rounds* do not suffice.
    """
    around = lambda df: df if period is None else df.withColumn("row", F.pmod("row", F.lit(period)))
    order = F.struct((-F.col(score)).alias("s"), "row", "col")
    left = cut(cells.select("row", "col", score).dropna().withColumn("_key", order))
    ring = [(i, j, w) for i, j, w in offsets if (i, j) != (0, 0)]
    chosen = None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        # a cell sees the best claim among itself and all undecided cells around it
        best = around(spread(left, [*ring, (0, 0, 1.0)], ["_key"])).groupBy("row", "col").agg(F.min("_key").alias("_m"))
        picked = cut(left.join(best, ["row", "col"]).filter("_key = _m").select("row", "col", score))
        chosen = picked if chosen is None else chosen.unionByName(picked)
        gone = around(spread(picked, [*ring, (0, 0, 1.0)], [])).select("row", "col").distinct()
        left = cut(left.join(gone, ["row", "col"], "left_anti"))
    else:
        raise RuntimeError(f"undecided cells are left after {max_rounds} rounds")
    out = cells.select("row", "col", score).limit(0) if chosen is None else chosen
    return out if n is None else out.orderBy(F.desc(score), "row", "col").limit(n)


def race(cells: DataFrame, weight: Column, n: int, seed: int) -> DataFrame:
    """Weighted sample without replacement: the n least of -log(u) / weight, u hashed from the place."""
    arrival = -F.log(unit_hash(F.col("row"), F.col("col"), seed=seed)) / weight
    return cells.filter(weight > 0).withColumn("arrival", arrival).orderBy("arrival", "row", "col").limit(n)


def snap(dots: DataFrame, field: DataFrame, value: str, offsets: Offsets) -> DataFrame:
    """Each dot moved to the largest positive field cell within *offsets* (the first of equals); duplicates merge."""
    reach = spread(dots.select("row", "col", F.struct("row", "col").alias("dot")), offsets, ["dot"])
    best = F.min(F.struct((-F.col(value)).alias("v"), "row", "col")).alias("b")
    moved = reach.join(field.select("row", "col", value).filter(F.col(value) > 0), ["row", "col"]).groupBy("dot").agg(best)
    return moved.groupBy("b.row", "b.col").agg(F.count("*").alias("dots"))


def largest_mass(steps: DataFrame, bar: float) -> DataFrame:
    """Of ``(mass, credit)`` by rising mass, the steps whose credit a further cell exceeds *bar*, marked, with the choice."""
    order = W.orderBy("mass")  # one row a candidate mass
    marginal = (F.col("credit") - F.coalesce(F.lag("credit").over(order), F.lit(0.0))) / (F.col("mass") - F.coalesce(F.lag("mass").over(order), F.lit(0)))
    rows = steps.withColumn("marginal", marginal).withColumn("worth", F.col("marginal") > bar)
    return rows.withColumn("chosen", F.coalesce(F.col("mass") == F.max(F.when(F.col("worth"), F.col("mass"))).over(W.partitionBy()), F.lit(False)))

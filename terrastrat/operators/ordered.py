"""Selections made in one order of score: a bar that depends on all taken before, and spacing under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrastrat.functions.expressions import ALPHA, unit_hash
from terrastrat.operators.kernels import Offsets, disc, gather, gauss, separable, spread
from terrastrat.operators.ranking import numbered
from terrastrat.operators.select import spaced
from terrastrat.session import cut, small_join

#: Rows a block of running totals.
BLOCK = 1 << 16


def totals_before(rows: DataFrame, value: str, out: str) -> DataFrame:
    """*out*: the sum of *value* over rows of smaller ``rn`` (1, 2, 3...), 0 for the first.

    Blocks of rows are summed inside themselves and start from the sums of earlier blocks, of which there is one row
    for each 65,536 rows.
    """
    rows = cut(rows.withColumn("_block", F.expr(f"(rn - 1) div {BLOCK}")))
    sums = cut(rows.groupBy("_block").agg(F.sum(value).alias("_sum")))
    earlier = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_start"))
    inside = W.partitionBy("_block").orderBy("rn").rowsBetween(W.unboundedPreceding, -1)
    placed = small_join(rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0.0))), cut(sums), "_block")
    return placed.withColumn(out, F.col("_start") + F.col("_in")).drop("_block", "_start", "_in")


def steps_of_cover(belief: DataFrame, dots: DataFrame, radius: float = 3.0) -> DataFrame:
    """``(rn, gain)``: what each dot ``(row, col, rn)`` adds to the credit of those before it.

    A cell takes its dots by rn and counts what each raises the best kernel so far, so no cell holds more rows than the
    kernel has places.
    """
    reached = spread(dots.select("row", "col", "rn"), disc(radius), ["rn"]).join(belief.filter("pi > 0").select("row", "col", "pi"), ["row", "col"])
    before = F.max("k").over(W.partitionBy("row", "col").orderBy("rn").rowsBetween(W.unboundedPreceding, -1))
    raised = reached.select("rn", (F.col("pi") * F.greatest(F.col("k") - F.coalesce(before, F.lit(0.0)), F.lit(0.0))).alias("add"))
    return raised.groupBy("rn").agg(F.sum("add").alias("gain"))


def emit_in_order(belief: DataFrame, most: int, mass: float, start: float = 0.25, least: float = 1e-6, domain: DataFrame | None = None) -> DataFrame:
    """``(rn, row, col, gain, total)`` of cells ``(row, col, pi)`` taken by falling belief, ties by place, up to *most*.

    The sequential rule asks at each cell whether ``gain > alpha * bar * (gain + 1 - best)``, where best is the largest
    kernel that the dot raises and bar is *start* at first, then ``total / (alpha * (2 n + 1) + (1 - alpha) * mass)`` of
    the n dots and the credit so far. A dot raises its own cell to 1, as no other dot can, so best is 1 and the gain
    positive: the test is ``alpha * bar < 1``, and once it fails nothing changes any more. Hence all candidates are taken
    on trial, their credits summed in order, and those before the first violation kept: one pass whatever the number
    of dots. Cells of *least* belief or less, of null belief and outside *domain* are no candidates; those outside of it
    still give credit. total is the credit with the dot. No candidates: no rows.
    """
    belief = cut(belief.select("row", "col", F.col("pi").cast("double").alias("pi")).dropna())
    ready = belief.filter(F.col("pi") > least)
    ready = ready if domain is None else ready.join(domain.select("row", "col").distinct(), ["row", "col"], "left_semi")
    trial = cut(numbered(ready, F.desc("pi"), F.asc("row"), F.asc("col")).filter(F.col("rn") <= most))
    steps = trial.select("rn", "row", "col").join(steps_of_cover(belief, trial), "rn")
    rows = totals_before(steps, "gain", "_before")
    bar = F.when(F.col("rn") == 1, start).otherwise(F.col("_before") / (ALPHA * (2 * (F.col("rn") - 1) + 1) + (1 - ALPHA) * mass))
    rows = cut(rows.withColumn("_fails", ALPHA * bar >= 1))
    first = rows.agg(F.min(F.when(F.col("_fails"), F.col("rn"))).alias("_first"))
    kept = rows.join(F.broadcast(first)).filter(F.col("_first").isNull() | (F.col("rn") < F.col("_first")))  # one row
    return kept.select("rn", "row", "col", "gain", (F.col("_before") + F.col("gain")).alias("total"))


def _best(cells: DataFrame, score: str, offsets: Offsets, budget: int) -> DataFrame:
    """The first *budget* cells of the spaced choice.

    A chosen cell rules out no more others than there are offsets, so candidates beyond that many times the budget
    are never reached and needn't be looked at.
    """
    enough = budget * max(len(offsets), 1)
    first = numbered(cells.select("row", "col", score).dropna(), F.desc(score), F.asc("row"), F.asc("col"))
    return spaced(first.filter(F.col("rn") <= enough).drop("rn"), score, offsets, budget)


def pack(credit: DataFrame, score: str, budget: int, suppression: int = 2, least: float = 0.0) -> DataFrame:
    """``(row, col, score)``: up to *budget* cells by falling credit, none within *suppression* of a better one taken.

    Only the ``max(10 * budget, budget + 1000)`` best cells take part, and of these those above *least*, as the
    sequential rule has it; so fewer than *budget* may be found. Equal credits are taken by row and col.
    """
    part = numbered(credit.select("row", "col", score).dropna(), F.desc(score), F.asc("row"), F.asc("col"))
    part = part.filter((F.col("rn") <= max(10 * budget, budget + 1000)) & (F.col(score) > least)).drop("rn")
    return _best(part, score, disc(float(suppression), weight=lambda d, r: 1.0) if suppression else [(0, 0, 1.0)], budget)


def at_mass(probability: DataFrame, value: str, mask: Column, allowed: Column, mass: int, suppression: float) -> DataFrame:
    """``(row, col, credit)``: the *mass* best cells by kernel credit of what lies inside *mask*, spaced by *suppression*.

    probability: ``(row, col, value)`` and the columns of the two conditions. Cells outside of the mask give no credit;
    cells must be inside, allowed and have a credit above zero to be taken. Ties are by row and col.
    """
    rows = cut(probability.withColumn("_in", F.coalesce(mask, F.lit(False))).withColumn("_ok", F.coalesce(allowed, F.lit(False))))
    given = rows.filter("_in").select("row", "col", F.col(value).alias("_v"))
    near = gather(given, disc(3.0), [F.sum(F.col("_v") * F.col("k")).alias("credit")], ["_v"], within=rows.filter("_in and _ok"))
    ring = disc(suppression, weight=lambda d, r: 1.0) if suppression >= 1 else [(0, 0, 1.0)]
    return _best(near.withColumn("credit", F.round("credit", 9)).filter("credit > 0"), "credit", ring, mass)


def temporal_holdout(events: DataFrame, cutoff: Column, least: int = 2, sigmas: tuple[float, ...] = (1.0, 2.0), seed: int = 0) -> DataFrame:
    """``(way, mass, truth, tpw, credit_per_cell, covered)``: supports drawn from events before *cutoff*, scored on cells first hit after it.

    events: ``(row, col)`` and the columns of *cutoff*, true for the earlier ones; null times are left out. Ways: cells of
    *least* earlier events or more, and at the same mass the cells of highest smoothed earlier density for each sigma and a
    hashed draw, all among cells that hold any event. tpw: the best kernel summed over truth cells. Equal densities
    are taken by row and col. Nothing of the later events enters a support but the outline. Without truth the share covered is null; if no cell repeats, there are no rows.
    """
    rows = events.select("row", "col", cutoff.alias("_early")).dropna()
    cells = cut(rows.groupBy("row", "col").agg(F.count_if("_early").cast("double").alias("n")))
    truth = cells.filter("n = 0").select("row", "col")
    repeated = cells.filter(F.col("n") >= least).select("row", "col")
    mass = repeated.count()
    best = lambda df, *order: numbered(df, *order, F.asc("row"), F.asc("col")).filter(F.col("rn") <= mass).select("row", "col")
    ways = {"repeated": repeated}
    for s in sigmas:
        wide = separable(cells.filter("n > 0"), "n", gauss(s), gauss(s), "v")
        ways[f"density {s:g}"] = best(cells.join(wide, ["row", "col"], "left").select("row", "col", F.round(F.coalesce("v", F.lit(0.0)), 9).alias("v")), F.desc("v"))
    ways["random"] = best(cells.withColumn("v", unit_hash(F.col("row"), F.col("col"), seed=seed)), F.asc("v"))
    sent = None
    for name, support in ways.items():
        one = support.withColumn("way", F.lit(name))
        sent = one if sent is None else sent.unionByName(one)
    sent = cut(sent)
    cover = spread(sent, disc(3.0), ["way"]).groupBy("way", "row", "col").agg(F.max("k").alias("k"))
    credit = cover.join(truth, ["row", "col"]).groupBy("way").agg(F.sum("k").alias("tpw"))
    sizes = sent.groupBy("way").agg(F.count("*").alias("mass")).join(F.broadcast(truth.agg(F.count("*").alias("truth"))))  # one row
    out = sizes.join(credit, "way", "left").fillna(0.0, ["tpw"])
    return out.select("way", "mass", "truth", "tpw", F.try_divide("tpw", "mass").alias("credit_per_cell"), F.try_divide("tpw", "truth").alias("covered"))

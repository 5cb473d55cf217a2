"""Ends of thinned lines: bridges between ends whose strikes agree, and continuations along the local strike."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastrat.operators import select
from terrastrat.operators.distance import distances
from terrastrat.operators.kernels import disc, gather, gauss, spread, square
from terrastrat.operators.sequential import thin
from terrastrat.operators.spatial import radius_join
from terrastrat.session import cut


def ends(lines: DataFrame, radius: float = 5.0) -> DataFrame:
    """``(row, col, n, strike, away_row, away_col)`` of the cells of *lines* with exactly one neighbour.

    strike: degrees from the columns' axis towards rising rows, of the principal axis of line cells within *radius*;
    null below three cells. away: unit vector from those cells' centre to the end; null where they are one place.
    """
    lines = cut(lines.select("row", "col").distinct())
    tips = gather(lines, square(1), [F.count("*").alias("_c")], [], within=lines).filter("_c = 2").select("row", "col")
    near = radius_join(tips.select("row", "col"), lines, radius, "col", "row")
    a, b = F.col("n_row") - F.col("row"), F.col("n_col") - F.col("col")
    sums = near.groupBy("row", "col").agg(F.count("*").alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab"))
    # n times the covariances are whole numbers, so isotropic sums are told from others without rounding
    theta = F.degrees(0.5 * F.atan2((2 * (F.col("n") * F.col("ab") - F.col("a") * F.col("b"))).cast("double"), (F.col("n") * F.col("bb") - F.col("b") * F.col("b") - F.col("n") * F.col("aa") + F.col("a") * F.col("a")).cast("double")))
    size = F.sqrt((F.col("a") * F.col("a") + F.col("b") * F.col("b")).cast("double"))
    away = lambda c: F.when(size > 1e-6 * F.col("n"), -F.col(c) / size)
    return sums.select("row", "col", "n", F.when(F.col("n") >= 3, F.pmod(theta, F.lit(180.0))).alias("strike"), away("a").alias("away_row"), away("b").alias("away_col"))


def _turn(angle: Column, strike: Column) -> Column:
    """Degrees between two axes, 0 to 90."""
    return F.abs(F.pmod(angle - strike + 90, F.lit(180.0)) - 90)


def pairs(tips: DataFrame, gap: float = 30.0, tolerance: float = 60.0) -> DataFrame:
    """``(row, col, n_row, n_col, d, agrees)``: ends within *gap* of each other, the earlier by place first.

    agrees: both have a strike within *tolerance* of the line between them, and they are two cells apart or more.
    """
    near = radius_join(tips.select("row", "col", "strike"), tips.select("row", "col", "strike"), gap, "col", "row")
    near = near.filter((F.col("row") < F.col("n_row")) | ((F.col("row") == F.col("n_row")) & (F.col("col") < F.col("n_col"))))
    angle = F.pmod(F.degrees(F.atan2((F.col("n_row") - F.col("row")).cast("double"), (F.col("n_col") - F.col("col")).cast("double"))), F.lit(180.0))
    agrees = (F.col("d") >= 2) & (_turn(angle, F.col("strike")) <= tolerance) & (_turn(angle, F.col("n_strike")) <= tolerance)
    return near.select("row", "col", "n_row", "n_col", "d", F.coalesce(agrees, F.lit(False)).alias("agrees"))


def drawn(segments: DataFrame, rows: int, cols: int) -> DataFrame:
    """Distinct cells ``(row, col)`` of segments ``(r0, c0, r1, c1, steps)`` at evenly spaced places, moved into the grid."""
    at = segments.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("steps")))).withColumn("_t", F.col("_i") / F.col("steps"))
    place = lambda a, b, n: F.least(F.greatest(F.rint(F.round(F.col(a) + F.col("_t") * (F.col(b) - F.col(a)), 9)).cast("long"), F.lit(0)), F.lit(n - 1))
    return at.select(place("r0", "r1", rows).cast("long").alias("row"), place("c0", "c1", cols).cast("long").alias("col")).distinct()


def tip_bridges(mask: DataFrame, ridge: DataFrame, value: str, rows: int, cols: int, gap: float = 30.0, tolerance: float = 60.0, extend: float = 15.0, project: float = 10.0, shift: int = 5) -> tuple[DataFrame, DataFrame]:
    """Cells ``(row, col, dots)`` that bridge and prolong a mask's lines, and one row of counts.

    The mask is thinned; ends within *gap* whose strikes agree with the line between them are joined by a line that goes
    on by *extend* at both ends. Ends near no other end, whatever its strike, are prolonged by *project* away from
    their line. All cells of *mask*, which also bounds nothing else, may be bridged; *ridge* ``(row, col, value)`` holds
    the valid cells, and bridges move to its largest positive value within *shift*, so those without one go. Every
    step is an equi-join over buckets; an end meets the cells within a fixed distance only.
    """
    lines = thin(mask)
    tips = cut(ends(lines))
    met = cut(pairs(tips, gap, tolerance))
    u = lambda c: (F.col(f"n_{c}") - F.col(c)) / F.col("d")
    joined = met.filter("agrees").select((F.col("row") - u("row") * extend).alias("r0"), (F.col("col") - u("col") * extend).alias("c0"), (F.col("n_row") + u("row") * extend).alias("r1"), (F.col("n_col") + u("col") * extend).alias("c1"), F.greatest(F.floor(F.round(F.col("d") + 2 * extend, 9)), F.lit(1)).cast("int").alias("steps"))
    taken = met.select("row", "col").unionByName(met.select(F.col("n_row").alias("row"), F.col("n_col").alias("col")))
    alone = cut(tips.filter("strike is not null and away_row is not null").join(taken, ["row", "col"], "left_anti"))
    single = alone.select(F.col("row").cast("double").alias("r0"), F.col("col").cast("double").alias("c0"), (F.col("row") + F.col("away_row") * project).alias("r1"), (F.col("col") + F.col("away_col") * project).alias("c1"), F.lit(max(int(project), 1)).alias("steps"))
    raw = cut(drawn(joined.unionByName(single), rows, cols))
    valid = raw.join(ridge.filter(F.col(value).isNotNull()).select("row", "col"), ["row", "col"], "left_semi")
    snapped = cut(select.snap(valid, ridge, value, disc(float(shift), keep_zero=True)))
    counts = [lines.agg(F.count("*").alias("skeleton")), tips.agg(F.count("*").alias("ends")), met.agg(F.count("*").alias("pairs"), F.count_if("agrees").alias("agreeing")), alone.agg(F.count("*").alias("alone")), raw.agg(F.count("*").alias("drawn")), snapped.agg(F.count("*").alias("snapped"))]
    report = counts[0]
    for one in counts[1:]:
        report = report.join(F.broadcast(one))  # a row each
    return snapped, report


def mirrored(cells: DataFrame, rows: int, cols: int, pad: int) -> DataFrame:
    """Cells and their mirror images over the grid's borders, out to *pad* cells (up to the grid's size)."""
    out = cells
    for name, size in (("row", rows), ("col", cols)):
        at = F.col(name)
        images = F.array(at, F.when(at < pad, -1 - at), F.when(at >= size - pad, 2 * size - 1 - at))
        out = out.withColumn(name, F.explode(F.array_compact(images)))
    return out


def strikes(mask: DataFrame, rows: int, cols: int, sigma: float = 6.0) -> DataFrame:
    """``(row, col, theta)``: the angle of the smoothed gradients' main axis at each mask cell, columns first.

    The mask is smoothed, its slopes multiplied and smoothed again by the same *sigma*; the grid is mirrored at its borders.
    """
    w, pad = gauss(sigma), int(4 * sigma + 0.5)
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    up, across = [(i, 0, v) for i, v in w], [(0, i, v) for i, v in w]
    blur = lambda t, names, within=None: gather(gather(mirrored(t, rows, cols, pad), up, [F.sum(F.col(n) * F.col("k")).alias(n) for n in names], names), across, [F.sum(F.col(n) * F.col("k")).alias(n) for n in names], names, within=within)
    dots = cut(mask.select("row", "col").distinct().withColumn("v", F.lit(1.0)))
    field = cut(blur(dots, ["v"]).filter(inside))
    side = [F.sum(F.when(F.col("k") == n, F.col("v")).otherwise(0.0)).alias(f"_{n}") for n in range(5)]
    near = gather(field, [(0, 0, 0.0), (1, 0, 1.0), (-1, 0, 2.0), (0, 1, 3.0), (0, -1, 4.0)], side, ["v"]).filter(inside)
    slope = lambda name, size, a, b: F.when(F.col(name) == 0, F.col(a) - F.col("_0")).when(F.col(name) == size - 1, F.col("_0") - F.col(b)).otherwise((F.col(a) - F.col(b)) / 2)
    g = near.select("row", "col", slope("row", rows, "_1", "_2").alias("gy"), slope("col", cols, "_3", "_4").alias("gx"))
    products = g.select("row", "col", (F.col("gx") * F.col("gx")).alias("xx"), (F.col("gy") * F.col("gy")).alias("yy"), (F.col("gx") * F.col("gy")).alias("xy"))
    t = blur(products, ["xx", "yy", "xy"], within=dots)
    return t.select("row", "col", (0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))).alias("theta"))


def continued(mask: DataFrame, rows: int, cols: int, sigma: float = 6.0, steps: range = range(3, 31, 3), fade: float = 40.0, near: float = 2.0, far: float = 30.0) -> DataFrame:
    """``(row, col, value)`` above 0: mask cells carried on along their strike to both sides, fading by distance.

    A cell's value at a step is ``1 - step / fade``, the largest of those that reach a place, moved into the grid. Cells
    on the mask or beside it have none; the others are multiplied by ``1 - (d - near) / far``, d the exact distance to the mask.
    """
    mask = cut(mask.select("row", "col").distinct())
    table = F.array(*[F.struct(F.lit(s * sign).alias("s"), F.lit(1 - s / fade).alias("v")) for s in steps for sign in (1, -1)])
    sent = strikes(mask, rows, cols, sigma).withColumn("_s", F.explode(table))
    # signs are put on after rounding, so the two sides mirror each other
    go = lambda name, f, size: F.least(F.greatest(F.col(name) + F.signum("_s.s") * F.rint(F.abs(F.col("_s.s")) * f("theta")), F.lit(0)), F.lit(size - 1)).cast("long")
    reached = sent.select(go("row", F.sin, rows).alias("row"), go("col", F.cos, cols).alias("col"), F.col("_s.v").alias("v")).groupBy("row", "col").agg(F.max("v").alias("v"))
    beside = spread(mask, square(1), []).select("row", "col").distinct()
    left = cut(reached.join(beside, ["row", "col"], "left_anti"))
    rows_ = left.join(distances(left, mask, "d"), ["row", "col"])
    value = F.col("v") * F.least(F.greatest(1 - (F.col("d") - near) / far, F.lit(0.0)), F.lit(1.0))
    return rows_.select("row", "col", value.alias("value")).filter("value > 0")

"""Shapes of point neighbourhoods: axes, inertia, line votes, corridors and their cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrastrat.functions.expressions import azimuth, eigen2, unit_hash
from terrastrat.operators.ranking import grouped_percentiles, numbered
from terrastrat.operators.spatial import knn, radius_join
from terrastrat.operators.tiles import disc_sums, whole
from terrastrat.session import cut


def triangle_area(x: str, y: str, rank: str = "rank") -> Column:
    """Area of (point, first neighbour, second neighbour) over rows of :func:`terrastrat.operators.spatial.knn`."""
    at = lambda c, r: F.max(F.when(F.col(rank) == r, F.col(c)))
    ax, ay = at(f"n_{x}", 1) - F.first(x), at(f"n_{y}", 1) - F.first(y)
    bx, by = at(f"n_{x}", 2) - F.first(x), at(f"n_{y}", 2) - F.first(y)
    return 0.5 * F.abs(ax * by - ay * bx)


def axis(rows: DataFrame, keys: list[str], x: str, y: str, weight: Column | None = None, more: list = (), divisor: str = "n") -> DataFrame:
    """Weighted principal axis a key from sums: ``n, cx, cy, l1, l2, ux, uy, strike`` and *more* aggregates.

    Covariance divides by the weights' sum (divisor "n") or, for unit weights, by n - 1. Coordinates
    should be local (a few thousand) so that sums of squares keep their digits.
    """
    w = F.lit(1.0) if weight is None else weight
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(w).alias("_w"), F.sum(w * a).alias("_x"), F.sum(w * b).alias("_y"),
        F.sum(w * a * a).alias("_xx"), F.sum(w * b * b).alias("_yy"), F.sum(w * a * b).alias("_xy"), *more,
    )
    return of_sums(sums, divisor)


def of_sums(sums: DataFrame, divisor: str = "n") -> DataFrame:
    """The axes of :func:`axis` from a row of sums a key: ``_w``, ``_x``, ``_y``, ``_xx``, ``_yy`` and ``_xy``."""
    cx, cy = F.col("_x") / F.col("_w"), F.col("_y") / F.col("_w")
    scale = F.lit(1.0) if divisor == "n" else F.col("_w") / F.greatest(F.col("_w") - 1, F.lit(1.0))
    xx, yy, xy = ((F.col("_xx") / F.col("_w") - cx * cx) * scale, (F.col("_yy") / F.col("_w") - cy * cy) * scale, (F.col("_xy") / F.col("_w") - cx * cy) * scale)
    l1, l2, theta = eigen2(xx, xy, yy)
    out = sums.withColumns({"cx": cx, "cy": cy, "l1": l1, "l2": F.greatest(l2, F.lit(0.0)), "ux": F.cos(theta), "uy": F.sin(theta)})
    return out.withColumn("strike", azimuth(F.col("ux"), F.col("uy"))).drop("_w", "_x", "_y", "_xx", "_yy", "_xy")


def disc_axes(points: DataFrame, radius: float, weight: Column | None = None, divisor: str = "n") -> DataFrame:
    """``(id, n, cx, cy, l1, l2, ux, uy, strike)`` of the points ``(id, x, y)`` within *radius* of each, itself included, relative to it.

    Whole-numbered places go by running sums over tiles (see :func:`terrastrat.operators.tiles.disc_sums`), others by
    pairs. *weight* is an expression of a point's own columns.
    """
    w = F.lit(1.0) if weight is None else weight
    p = cut(points.select("id", "x", "y", w.cast("double").alias("w")).dropna(subset=["x", "y"]))
    if not whole(p):
        near = radius_join(p.select("id", "x", "y"), p, radius).withColumns({"dx": F.col("n_x") - F.col("x"), "dy": F.col("n_y") - F.col("y")})
        return axis(near, ["id"], "dx", "dy", F.col("n_w"), divisor=divisor)
    places = p.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))
    moments = {"_w": "w", "_x": "sx", "_y": "sy", "_xx": "sxx", "_yy": "syy", "_xy": "sxy"}
    sums = disc_sums(places, radius, ["n", "w"]).select("x", "y", F.col("n").cast("long").alias("n"), *[F.col(c).alias(name) for name, c in moments.items()])
    return p.select("id", "x", "y").join(of_sums(sums, divisor), ["x", "y"]).drop("x", "y")


def hough(points: DataFrame, thetas: int, width: float, weight: Column | None = None) -> DataFrame:
    """``(theta, rho, votes)``: each point votes in every direction for its bin of distance to the origin."""
    angle = F.col("theta") * (math.pi / thetas)
    rows = points.withColumn("theta", F.explode(F.sequence(F.lit(0), F.lit(thetas - 1))))
    rho = F.floor((F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle)) / width).cast("long")
    return rows.groupBy(F.col("theta").cast("long").alias("theta"), rho.alias("rho")).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("votes"))


def hough_peaks(votes: DataFrame, least: float) -> DataFrame:
    """Bins above their left and not below their right neighbour bin; absent bins hold none."""
    bins = votes.select("theta", "rho", "votes")
    left = bins.select("theta", (F.col("rho") + 1).alias("rho"), F.col("votes").alias("l"))
    right = bins.select("theta", (F.col("rho") - 1).alias("rho"), F.col("votes").alias("r"))
    rows = bins.join(left, ["theta", "rho"], "left").join(right, ["theta", "rho"], "left").fillna(0.0, ["l", "r"])
    return rows.filter((F.col("votes") >= least) & (F.col("votes") > F.col("l")) & (F.col("votes") >= F.col("r"))).select("theta", "rho", "votes")


def spans(rows: DataFrame, line: list[str], at: str, gap: float) -> DataFrame:
    """Runs of positions along lines whose gaps are at most *gap*: ``(line, run, first, last, n)``."""
    order = W.partitionBy(*line).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(order) > gap).cast("int"), F.lit(1))
    runs = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*line, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def corridors(axes: DataFrame, depth: Column, half_width: Column, dip: float = 60.0) -> DataFrame:
    """Each lineation as three corridors: above the events (kind 0) and up dip to either side (1, 2)."""
    shift = depth / math.tan(math.radians(dip))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("kind"), F.lit(s).alias("s")) for k, s in ((0, 0.0), (1, 1.0), (2, -1.0))]))
    rows = axes.withColumn("_shift", shift).withColumn("half_width", half_width).withColumn("_k", kinds)
    off = F.col("_k.s") * F.col("_shift")
    return rows.withColumns({"kind": F.col("_k.kind"), "offset": off, "cx": F.col("cx") - F.col("uy") * off, "cy": F.col("cy") + F.col("ux") * off}).drop("_k", "_shift")


def along(segments: DataFrame, half: str, step: float) -> DataFrame:
    """Sample points ``px, py, s`` of centre lines at whole steps from -half to half."""
    n = F.floor(F.col(half) / step).cast("int")
    rows = segments.withColumn("_i", F.explode(F.sequence(-n, n)))
    s = F.col("_i") * step
    return rows.withColumns({"s": s, "px": F.col("cx") + F.col("ux") * s, "py": F.col("cy") + F.col("uy") * s}).drop("_i")


def rectangles(segments: DataFrame, half_length: str, half_width: str) -> DataFrame:
    """Whole cells inside rotated rectangles, ``(row, col)`` with the segment's columns: bounding box, then test."""
    reach_x = F.abs("ux") * F.col(half_length) + F.abs("uy") * F.col(half_width)
    reach_y = F.abs("uy") * F.col(half_length) + F.abs("ux") * F.col(half_width)
    rows = segments.withColumn("row", F.explode(F.sequence(F.ceil(F.col("cy") - reach_y).cast("long"), F.floor(F.col("cy") + reach_y).cast("long"), F.lit(1).cast("long"))))
    rows = rows.withColumn("col", F.explode(F.sequence(F.ceil(F.col("cx") - reach_x).cast("long"), F.floor(F.col("cx") + reach_x).cast("long"), F.lit(1).cast("long"))))
    dx, dy = F.col("col") - F.col("cx"), F.col("row") - F.col("cy")
    inside = (F.abs(dx * F.col("ux") + dy * F.col("uy")) <= F.col(half_length)) & (F.abs(dy * F.col("ux") - dx * F.col("uy")) <= F.col(half_width))
    return rows.filter(inside)


def volumes(points: DataFrame, z: str) -> DataFrame:
    """``(id, volume)`` of the body of each point and its three nearest others in space."""
    near = knn(points, 3, z=z)
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(f"n_{c}"))) - F.first(c)
    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = ([at(c, r) for c in ("x", "y", z)] for r in (1, 2, 3))
    body = F.abs(ax * (by * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by * cx)) / 6.0
    return near.groupBy("id").agg(body.alias("volume"))


def volume_test(points: DataFrame, z: str, seeds: list[int], most: float) -> DataFrame:
    """``(id, volume, p, kept)``: p is the share of catalogues, z dealt anew by hash order, in which the point's volume is smaller.

    One catalogue a seed; each is a sort and a search for neighbours, and only (id, volume) of it is kept.
    """
    p = cut(points.select("id", "x", "y", z))
    places = numbered(p.select("id", "x", "y"), "id").select("rn", "id", "x", "y")
    null = None
    for seed in seeds:
        dealt = numbered(p.select(z, "id", unit_hash(F.col("id"), seed=seed).alias("u")), "u", "id").select("rn", z)
        one = cut(volumes(places.join(dealt, "rn").drop("rn"), z).select("id", F.col("volume").alias("v")))
        null = one if null is None else null.unionByName(one)
    rows = null.join(volumes(p, z), "id").groupBy("id").agg(F.first("volume").alias("volume"), (F.count_if(F.col("v") < F.col("volume")) / float(len(seeds))).alias("p"))
    return rows.withColumn("kept", F.col("p") <= most)


def spines(points: DataFrame, label: str, bins: int = 24, least: int = 3, least_points: int = 15) -> DataFrame:
    """``(label, bin, x, y)``: the median offset from each cluster's axis in *bins* equal steps along it.

    Steps with fewer than *least* points are left out, and clusters with fewer than *least_points*.
    """
    a = axis(points, [label], "x", "y").filter(F.col("n") >= least_points).select(F.col(label).alias("_l"), "cx", "cy", "ux", "uy")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    rows = points.join(a, points[label] == F.col("_l")).withColumns({"_s": dx * F.col("ux") + dy * F.col("uy"), "_w": dy * F.col("ux") - dx * F.col("uy")})
    ends = rows.groupBy(F.col("_l").alias("_e")).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    rows = rows.join(ends, F.col("_l") == F.col("_e"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    # a point on the border of two steps is in the upper one, whatever the last digit of its place
    at = F.least(F.floor((F.col("_s") - F.col("_lo")) / step + 1e-9), F.lit(bins - 1)).cast("long")
    mid = F.first("_lo") + (F.col("bin") + 0.5) * F.first(step)
    rows = rows.filter(step > 0).withColumn("bin", at)
    got = rows.groupBy(label, "bin").agg(F.count("*").alias("n"), mid.alias("_at"), *[F.first(c).alias(c) for c in ("cx", "cy", "ux", "uy")]).filter(F.col("n") >= least)
    spot = rows.select(F.struct(F.col(label).alias("l"), F.col("bin").alias("b")).alias("_k"), "_w", "x", "y")
    middle = grouped_percentiles(spot, "_k", F.col("_w"), [0.5], ["_m"]).select(F.col("_k.l").alias(label), F.col("_k.b").alias("bin"), "_m")
    got = got.join(middle, [label, "bin"])
    return got.select(label, "bin", (F.col("cx") + F.col("_at") * F.col("ux") - F.col("_m") * F.col("uy")).alias("x"), (F.col("cy") + F.col("_at") * F.col("uy") + F.col("_m") * F.col("ux")).alias("y"))


def seeded_corridors(points: DataFrame, cell: float, radius: float, least: int, linearity: float, length: float) -> DataFrame:
    """``(seed_x, seed_y, n, cx, cy, ux, uy, linearity, length)`` of straight, long and well-sampled neighbourhoods of cell centres.

    Seeds are the centres of cells that hold points; length spans the 5th to 95th percentile along the axis.
    """
    seed = lambda c: (F.floor(F.col(c) / cell) + 0.5) * cell
    seeds = points.select(seed("x").alias("x"), seed("y").alias("y")).distinct()
    near = cut(radius_join(seeds, points.select("x", "y"), radius).select("x", "y", (F.col("n_x") - F.col("x")).alias("dx"), (F.col("n_y") - F.col("y")).alias("dy")))
    a = axis(near, ["x", "y"], "dx", "dy").filter(F.col("n") >= least)
    a = a.withColumn("linearity", F.try_divide(F.col("l1"), F.col("l1") + F.col("l2"))).filter(F.col("linearity") >= linearity)
    a = a.select("x", "y", "n", "cx", "cy", "ux", "uy", "linearity")
    t = (F.col("dx") - F.col("cx")) * F.col("ux") + (F.col("dy") - F.col("cy")) * F.col("uy")
    placed = near.join(a.select("x", "y", "cx", "cy", "ux", "uy"), ["x", "y"]).withColumn("_k", F.struct("x", "y"))
    span = grouped_percentiles(placed, "_k", t, [0.05, 0.95], ["_low", "_high"]).select("_k.x", "_k.y", (F.col("_high") - F.col("_low")).alias("length"))
    rows = a.join(span, ["x", "y"]).filter(F.col("length") >= length)
    return rows.select(F.col("x").alias("seed_x"), F.col("y").alias("seed_y"), "n", (F.col("x") + F.col("cx")).alias("cx"), (F.col("y") + F.col("cy")).alias("cy"), "ux", "uy", "linearity", "length")

"""Ridges and lines of gridded fields: curvature, gradients at several scales, votes along lines, burnt segments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastrat.functions.expressions import eigen2
from terrastrat.operators import fields, ranking
from terrastrat.operators.kernels import disc, gather, gauss, separable, spread, square
from terrastrat.session import cut


def smooth(cells: DataFrame, value: str, sigma: float, out: str = "v", orders: tuple[int, int] = (0, 0)) -> DataFrame:
    """``(row, col, out)`` on the given cells: Gaussian of *value*, or its derivative of *orders* along rows and columns."""
    wide = separable(cells, value, gauss(sigma, orders[0]), gauss(sigma, orders[1]), out)
    return cells.select("row", "col").join(wide, ["row", "col"])


def hessian(cells: DataFrame, value: str, sigma: float) -> DataFrame:
    """``(row, col, gxx, gxy, gyy, ridge)``: second Gaussian derivatives and the strength of the sharpest crest.

    The three derivatives along rows are taken in one pass and those along columns in a second one.
    """
    w = [dict(gauss(sigma, n)) for n in (0, 1, 2)]
    # weights of all three orders ride on the offset, so the cells are sent out once a pass
    at = lambda n: F.element_at(F.array(*[F.lit(w[n][i]) for i in sorted(w[n])]), (F.col("k") + (len(w[0]) // 2 + 1)).cast("int"))
    rows = gather(cells.select("row", "col", value), [(i, 0, i) for i in sorted(w[0])], [F.sum(F.col(value) * at(n)).alias(f"_{n}") for n in (0, 1, 2)], [value])
    sums = [F.sum(F.col("_0") * at(2)).alias("gxx"), F.sum(F.col("_1") * at(1)).alias("gxy"), F.sum(F.col("_2") * at(0)).alias("gyy")]
    both = gather(rows, [(0, i, i) for i in sorted(w[0])], sums, ["_0", "_1", "_2"], within=cells)
    _, low, _ = eigen2(F.col("gxx"), F.col("gxy"), F.col("gyy"))
    return both.withColumn("ridge", F.greatest(-low, F.lit(0.0)))


def slopes(cells: DataFrame, value: str) -> DataFrame:
    """``(row, col, gy, gx)``: central differences, one-sided where a neighbour is missing, 0 where both are."""
    four = [(1, 0, 1.0), (-1, 0, 2.0), (0, 1, 3.0), (0, -1, 4.0)]
    sides = [F.max(F.when(F.col("k") == n, F.col(value))).alias(f"_{n}") for n in (1, 2, 3, 4)]
    near = gather(cells.select("row", "col", value), four, sides, [value])
    rows = cells.select("row", "col", value).join(near, ["row", "col"], "left")
    diff = lambda a, b: (F.coalesce(a, F.col(value)) - F.coalesce(b, F.col(value))) / F.when(a.isNotNull() & b.isNotNull(), 2.0).otherwise(1.0)
    return rows.select("row", "col", diff(F.col("_1"), F.col("_2")).alias("gy"), diff(F.col("_3"), F.col("_4")).alias("gx"))


def ridge_response(cells: DataFrame, value: str, sigma: float) -> DataFrame:
    """``(row, col, response)``: magnitude of the smoothed field's gradient, smoothed at the same scale."""
    g = slopes(smooth(cells, value, sigma), "v")
    return smooth(g.select("row", "col", F.hypot("gx", "gy").alias("g")), "g", sigma, "response")


def ridge_density(cells: DataFrame, values: list[str], sigmas: tuple[float, ...] = (1.5, 3.0), spread_sigma: float = 8.0) -> DataFrame:
    """``(row, col, density)``: ridge responses of every channel's ranks, averaged over channels and scales and smoothed widely."""
    total = None
    for v in values:
        ranks = fields.rank_normalise(cells.select("row", "col", v), v, "r")
        for s in sigmas:
            part = ridge_response(ranks, "r", s)
            total = part if total is None else total.unionByName(part)
    mean = total.groupBy("row", "col").agg((F.sum("response") / (len(values) * len(sigmas))).alias("m"))
    return smooth(mean, "m", spread_sigma, "density")


def gradient_lineament(cells: DataFrame, value: str, sigmas: tuple[float, ...] = (1.5, 3.0), window: int = 9) -> DataFrame:
    """``(row, col, lineament)``: geometric mean of gradients at several scales above its moving median."""
    parts = None
    for s in sigmas:
        g = fields.gradient(smooth(cells, value, s), "v").select("row", "col", F.log(F.hypot("gx", "gy") + 1e-6).alias("l"))
        parts = g if parts is None else parts.unionByName(g)
    mean = parts.groupBy("row", "col").agg(F.exp(F.sum("l") / len(sigmas)).alias("g"))
    middle = gather(mean, square(window // 2), [F.median("g").alias("m")], ["g"], within=mean)
    return mean.join(middle, ["row", "col"]).select("row", "col", F.greatest(F.col("g") - F.col("m"), F.lit(0.0)).alias("lineament"))


def line_cells(directions: int, half: int) -> dict[int, list[tuple[int, int]]]:
    """Cells of lines through the origin, one for each step, so a cell may come twice."""
    angle = [math.pi * d / directions for d in range(directions)]
    return {d: [(round(k * math.sin(t)), round(k * math.cos(t))) for k in range(-half, half + 1)] for d, t in enumerate(angle)}


def chain_vote(mask: DataFrame, shape: tuple[int, int], length: int = 9, directions: int = 16) -> DataFrame:
    """``(row, col, vote)``: mean share of the lines through a cell that lies on the mask; the grid wraps at its borders."""
    share = {}
    for cells in line_cells(directions, length // 2).values():
        for o in cells:
            share[o] = share.get(o, 0.0) + 1.0 / (directions * len(cells))
    sent = spread(mask.select("row", "col"), [(i, j, w) for (i, j), w in sorted(share.items())], [])
    return sent.groupBy(F.pmod("row", F.lit(shape[0])).alias("row"), F.pmod("col", F.lit(shape[1])).alias("col")).agg(F.sum("k").alias("vote"))


def oriented_mean(cells: DataFrame, value: str, directions: int = 12, half: int = 7) -> DataFrame:
    """``(row, col, response)``: the largest mean along a line through the cell; missing cells count 0."""
    table, sums = fields.weighted({f"d{d}": [(i, j, 1.0 / len(p)) for i, j in p] for d, p in fields.line_offsets(directions, half).items()}, value)
    got = gather(cells, table, sums, [value], within=cells)
    return got.select("row", "col", F.greatest(*[F.coalesce(f"d{d}", F.lit(0.0)) for d in range(directions)]).alias("response"))


def proximity(places: DataFrame, within: DataFrame, scale: float, cap: float) -> DataFrame:
    """``(row, col, boost)``: exp(-d / scale) of the nearest place up to *cap* cells away, else 0."""
    near = spread(places.select("row", "col").distinct(), disc(cap, weight=lambda d, r: d, keep_zero=True), []).groupBy("row", "col").agg(F.min("k").alias("d"))
    return within.select("row", "col").join(near, ["row", "col"], "left").select("row", "col", F.coalesce(F.exp(-F.col("d") / scale), F.lit(0.0)).alias("boost"))


def burnt(segments: DataFrame, sigma: float, weight: str = "weight") -> DataFrame:
    """``(row, col, value)``: the largest weighted Gaussian of the distance to segments ``(x0, y0, x1, y1)``, out to three sigma.

    Cell centres lie at whole coordinates. Cells are tested inside each segment's bounding box.
    """
    reach = 3.0 * sigma
    whole = lambda lo, hi: F.sequence(F.ceil(lo - reach).cast("long"), F.floor(hi + reach).cast("long"), F.lit(1).cast("long"))
    rows = segments.withColumn("row", F.explode(whole(F.least("y0", "y1"), F.greatest("y0", "y1"))))
    rows = rows.withColumn("col", F.explode(whole(F.least("x0", "x1"), F.greatest("x0", "x1"))))
    vx, vy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = ((F.col("col") - F.col("x0")) * vx + (F.col("row") - F.col("y0")) * vy) / F.greatest(vx * vx + vy * vy, F.lit(1e-12))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("_d", F.hypot(F.col("col") - F.col("x0") - t * vx, F.col("row") - F.col("y0") - t * vy)).filter((F.col("_d") <= reach) & (F.col(weight) > 0))
    return rows.groupBy("row", "col").agg(F.max(F.col(weight) * F.exp(-0.5 * F.pow(F.col("_d") / sigma, F.lit(2.0)))).alias("value"))


def robust_unit(cells: DataFrame, value: str, out: str, at: float = 0.99, positive: bool = True) -> DataFrame:
    """*value* over a percentile of its (positive) values, clipped to 0..1."""
    cells = cut(cells)  # read twice: for the percentile and for the result
    v = F.when(F.col(value) > 0, F.col(value)) if positive else F.col(value)
    top = ranking.percentiles(cells, v, [at], ["_top"])
    return cells.join(F.broadcast(top)).withColumn(out, F.coalesce(F.least(F.greatest(F.col(value) / F.greatest("_top", F.lit(1e-12)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).drop("_top")


def ridge_evidence(cells: DataFrame, terrain: list[str], bands: list[str], sigmas: tuple[float, float] = (1.5, 3.0), window: int = 9) -> DataFrame:
    """``(row, col, topographic, radiometric, score)``: 0.7 of a terrain score and 0.3 of radiometric ridges.

    terrain: columns of step, curvature, coherence and relief, each in 0..1. The radiometric part is
    the geometric mean of summed gradients at two scales, above its moving median.
    """
    step, lap, coherence, relief = map(F.col, terrain)
    raw = F.sqrt(step) * F.sqrt(0.5 + 0.5 * lap) * coherence * (0.75 + 0.25 * relief)
    topographic = robust_unit(cells.select("row", "col", raw.alias("t")), "t", "topographic").drop("t")
    parts = None
    for n, s in enumerate(sigmas):
        for b in bands:
            g = slopes(smooth(cells, b, s), "v").select("row", "col", F.lit(n).alias("n"), F.hypot("gx", "gy").alias("g"))
            parts = g if parts is None else parts.unionByName(g)
    sums = parts.groupBy("row", "col").agg(*[F.sum(F.when(F.col("n") == n, F.col("g"))).alias(f"g{n}") for n in (0, 1)])
    mean = sums.select("row", "col", F.sqrt(F.col("g0") * F.col("g1")).alias("g"))
    middle = gather(mean, square(window // 2), [F.median("g").alias("m")], ["g"], within=mean)
    above = mean.join(middle, ["row", "col"]).select("row", "col", F.greatest(F.col("g") - F.col("m"), F.lit(0.0)).alias("g"))
    both = topographic.join(robust_unit(above, "g", "radiometric").drop("g"), ["row", "col"])
    return both.withColumn("score", 0.7 * F.col("topographic") + 0.3 * F.col("radiometric"))


def belief_field(cells: DataFrame, families: tuple[str, str], line: str, boost: DataFrame, factor: DataFrame, truth: DataFrame, weights=(0.75, 0.55), buffer: float = 2.0) -> DataFrame:
    """``(row, col, base, belief)``: weighted families and their line contrast, raised near places, lowered near confounders.

    boost: ``(row, col, boost)``; factor: ``(row, col, factor)``; cells within *buffer* of truth are 0.
    """
    a, b = families
    rows = robust_unit(robust_unit(cells, a, "_a", positive=False), b, "_b", positive=False)
    base = rows.withColumn("_base", weights[0] * F.col("_a") + weights[1] * F.col("_b"))
    base = robust_unit(base, "_base", "base", 0.999, positive=False).select("row", "col", "base", line)
    lines = robust_unit(base, line, "_line", positive=False)
    mixed = robust_unit(lines.withColumn("_m", 0.7 * F.col("base") + 0.3 * F.col("_line")), "_m", "_mix", 0.999, positive=False)
    near = spread(truth.select("row", "col"), disc(buffer, weight=lambda d, r: 1.0), []).select("row", "col").distinct().withColumn("_out", F.lit(True))
    rows = mixed.join(boost, ["row", "col"], "left").join(factor, ["row", "col"], "left").join(near, ["row", "col"], "left")
    value = F.least(F.col("_mix") * (1 + 0.35 * F.coalesce("boost", F.lit(0.0))), F.lit(1.0)) * F.coalesce("factor", F.lit(1.0))
    return rows.select("row", "col", "base", F.when(F.col("_out").isNull(), value).otherwise(0.0).alias("belief"))

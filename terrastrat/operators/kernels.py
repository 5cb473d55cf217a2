"""Neighbourhood sums on sparse cells ``(row, col, ...)``: offset tables instead of dense arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Offsets = list[tuple[int, int, float]]


def disc(radius: float = 3.0, weight=lambda d, r: max(0.0, 1 - d / r), keep_zero: bool = False) -> Offsets:
    """Offsets within a disc and their kernel weights."""
    r = int(radius)
    cells = [(i, j, math.hypot(i, j)) for i in range(-r, r + 1) for j in range(-r, r + 1)]
    return [(i, j, weight(d, radius)) for i, j, d in cells if d <= radius and (keep_zero or weight(d, radius) > 0)]


def square(r: int, weight: float = 1.0) -> Offsets:
    return [(i, j, weight) for i in range(-r, r + 1) for j in range(-r, r + 1)]


def gauss(sigma: float, order: int = 0, truncate: float = 4.0) -> list[tuple[int, float]]:
    """Normalised Gaussian weights of one axis, or of its first or second derivative (as a convolution)."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    total = sum(w)
    if order == 0:
        return [(i, v / total) for i, v in zip(range(-r, r + 1), w, strict=True)]
    slope = (lambda i: -i / sigma**2) if order == 1 else (lambda i: (i * i / sigma**2 - 1) / sigma**2)
    return [(i, slope(i) * v / total) for i, v in zip(range(-r, r + 1), w, strict=True)]


def spread(cells: DataFrame, offsets: Offsets, carry: list[str]) -> DataFrame:
    """Each cell's *carry* columns sent to every offset cell, with ``k``; offsets are literals, so nothing is joined."""
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(w)).alias("k")) for i, j, w in offsets])
    rows = cells.withColumn("_o", F.explode(table))
    return rows.select((F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col"), *carry, F.col("_o.k").alias("k"))


def gather(cells: DataFrame, offsets: Offsets, aggregates: list[Column], carry: list[str], within: DataFrame | None = None) -> DataFrame:
    """Aggregates over each cell's neighbourhood; partial sums are combined before the one shuffle.

    within: cells (row, col) that results are kept for; all reached ones otherwise.
    """
    mirrored = [(-i, -j, w) for i, j, w in offsets]
    sums = spread(cells, mirrored, carry).groupBy("row", "col").agg(*aggregates)
    return sums if within is None else within.select("row", "col").join(sums, ["row", "col"], "left")


def separable(cells: DataFrame, value: str, rows: list[tuple[int, float]], cols: list[tuple[int, float]], out: str) -> DataFrame:
    """``(row, col, out)``: a separable filter in two passes of 1-D offsets; absent cells count 0."""
    first = gather(cells.select("row", "col", value), [(i, 0, w) for i, w in rows], [F.sum(F.col(value) * F.col("k")).alias("_v")], [value])
    return gather(first, [(0, j, w) for j, w in cols], [F.sum(F.col("_v") * F.col("k")).alias(out)], ["_v"])


def masked_gauss(cells: DataFrame, value: str, sigma: float, out: str, least: float = 0.3) -> DataFrame:
    """Normalised Gaussian over the cells that exist: null where too little weight is left."""
    w = gauss(sigma)
    pair = cells.select("row", "col", F.col(value).alias("_a"), F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0).alias("_b"))
    step = lambda t, offs: gather(t, offs, [F.sum(F.col("_a") * F.col("k")).alias("_a"), F.sum(F.col("_b") * F.col("k")).alias("_b")], ["_a", "_b"])
    both = step(step(pair, [(i, 0, v) for i, v in w]), [(0, j, v) for j, v in w])
    return cells.select("row", "col").join(both, ["row", "col"]).select("row", "col", F.when(F.col("_b") > least, F.col("_a") / F.col("_b")).alias(out))

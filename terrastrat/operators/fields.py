"""Field features on sparse cells: gradients, tensors, ridges, ranks, fusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastrat.functions.expressions import axial_difference, eigen2
from terrastrat.operators import ranking
from terrastrat.operators.kernels import Offsets, gather, gauss

#: Fixed value: Sobel weights of the derivative along columns; along rows they are transposed.
SOBEL: Offsets = [(-1, -1, -1.0), (0, -1, -2.0), (1, -1, -1.0), (-1, 1, 1.0), (0, 1, 2.0), (1, 1, 1.0)]


def weighted(offsets_by_name: dict[str, Offsets], value: str) -> tuple[Offsets, list[Column]]:
    """One offset table for several kernels, and their sums as aggregates: one shuffle computes all.

    Weights travel as literals looked up by offset, so ``k`` of the table is an index here.
    """
    places = sorted({(i, j) for table in offsets_by_name.values() for i, j, _ in table})
    index = {p: n for n, p in enumerate(places)}
    sums = []
    for name, table in offsets_by_name.items():
        weights = [0.0] * len(places)
        for i, j, w in table:
            weights[index[i, j]] += float(w)
        sums.append(F.sum(F.col(value) * F.element_at(F.array(*map(F.lit, weights)), F.col("k").cast("int") + 1)).alias(name))
    return [(i, j, float(n)) for (i, j), n in index.items()], sums


def gradient(cells: DataFrame, value: str) -> DataFrame:
    """``(row, col, gx, gy)`` by Sobel weights; absent cells count 0."""
    table, sums = weighted({"gx": SOBEL, "gy": [(j, i, w) for i, j, w in SOBEL]}, value)
    return gather(cells, table, sums, [value], within=cells).fillna(0.0, ["gx", "gy"])


def tensor(cells: DataFrame, value: str, sigma: float) -> DataFrame:
    """``(row, col, coherence, saliency, angle)`` of the gradient's structure tensor smoothed by *sigma*."""
    g = gradient(cells, value).select("row", "col", (F.col("gx") * F.col("gx")).alias("a"), (F.col("gx") * F.col("gy")).alias("b"), (F.col("gy") * F.col("gy")).alias("c"))
    w, sums = gauss(sigma), [F.sum(F.col(x) * F.col("k")).alias(x) for x in "abc"]
    rows = gather(g, [(i, 0, v) for i, v in w], sums, list("abc"))
    j = gather(rows, [(0, i, v) for i, v in w], sums, list("abc"), within=cells)
    l1, l2, theta = eigen2(F.col("a"), F.col("b"), F.col("c"))
    coherence = F.coalesce(F.try_divide(l1 - l2, l1 + l2), F.lit(0.0))
    return j.select("row", "col", coherence.alias("coherence"), (coherence * F.sqrt(F.greatest(l1, F.lit(0.0)))).alias("saliency"), F.pmod(F.degrees(theta) + 90, F.lit(180.0)).alias("angle"))


def line_offsets(azimuths: int, half: int) -> dict[int, list[tuple[int, int]]]:
    """Distinct cells of centred lines in evenly spaced directions."""
    lines = {}
    for a in range(azimuths):
        t = math.pi * a / azimuths
        lines[a] = sorted({(round(-s * math.cos(t)), round(s * math.sin(t))) for s in range(-half, half + 1)})
    return lines


def line_contrast(cells: DataFrame, value: str, azimuths: int = 8, half: int = 4) -> DataFrame:
    """Largest absolute difference between a line's mean and its perpendicular's, existing cells only."""
    lines = line_offsets(azimuths, half)
    ones = {f"n{a}": [(i, j, 1.0) for i, j in p] for a, p in lines.items()}
    table, counts = weighted(ones, "_one")
    _, sums = weighted({f"s{a}": [(i, j, 1.0) for i, j in p] for a, p in lines.items()}, value)
    got = gather(cells.withColumn("_one", F.lit(1.0)), table, counts + sums, ["_one", value], within=cells)
    mean = [F.try_divide(F.col(f"s{a}"), F.col(f"n{a}")) for a in range(azimuths)]
    turn = azimuths // 2
    return got.select("row", "col", F.greatest(*[F.abs(mean[a] - mean[(a + turn) % azimuths]) for a in range(turn)]).alias("contrast"))


def step_kernels(azimuths: int, length: int, width: int) -> dict[int, Offsets]:
    """Oriented steps: +1 on one side of a line, -1 on the other, scaled to an absolute sum of 1."""
    out, r = {}, length + width
    for a in range(azimuths):
        t = math.pi * a / azimuths
        ux, uy = math.sin(t), -math.cos(t)
        cells = []
        for i in range(-r, r + 1):
            for j in range(-r, r + 1):
                s, p = j * ux + i * uy, -j * uy + i * ux
                if abs(s) <= length and 0 < abs(p) <= width:
                    cells.append((i, j, 1.0 if p > 0 else -1.0))
        out[a] = [(i, j, w / len(cells)) for i, j, w in cells]
    return out


def matched_step(cells: DataFrame, value: str, azimuths: int = 6, length: int = 3, width: int = 2) -> DataFrame:
    """``(row, col, response, azimuth)``: the strongest oriented step, the first of equals; cells that don't exist count 0."""
    kernels = step_kernels(azimuths, length, width)
    table, sums = weighted({f"r{a}": o for a, o in kernels.items()}, value)
    got = gather(cells, table, sums, [value], within=cells).na.fill(0.0, [f"r{a}" for a in kernels])
    best = F.array_max(F.array(*[F.struct(F.round(F.abs(f"r{a}"), 9).alias("v"), F.lit(-a).alias("a")) for a in kernels]))
    return got.withColumn("_b", best).select("row", "col", F.col("_b.v").alias("response"), (-F.col("_b.a")).cast("long").alias("azimuth"))


def rank_normalise(cells: DataFrame, value: str, out: str) -> DataFrame:
    """Stable rank of each value scaled to 0..1 over all rows, ties by place."""
    n = cells.agg(F.count("*").alias("_n"))
    return ranking.numbered(cells, F.asc(value), "row", "col", out="_rn").join(F.broadcast(n)).withColumn(out, (F.col("_rn") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_rn", "_n")


def clipped(cells: DataFrame, value: str, low: float, high: float, out: str) -> DataFrame:
    """Value scaled to 0..1 between two exact percentiles of its column."""
    q = ranking.percentiles(cells, F.col(value), [low, high], ["_lo", "_hi"])
    unit = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return cells.join(F.broadcast(q)).withColumn(out, F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi")


def agreement(strengths: list[Column], angles: list[Column], coherences: list[Column], strong: list[Column], tolerance: float, least: float) -> Column:
    """How many families are strong at a cell and contradicted by no other strong, coherent family."""
    sure = [s >= t for s, t in zip(strengths, strong, strict=True)]
    total = F.lit(0)
    for i in range(len(strengths)):
        against = F.lit(False)
        for j in range(len(strengths)):
            if i != j:
                against = against | (sure[j] & (coherences[i] >= least) & (coherences[j] >= least) & (axial_difference(angles[i], angles[j]) > tolerance))
        total = total + (sure[i] & ~against).cast("int")
    return total


def fused(strengths: list[Column], count: Column, bonus: float = 0.5) -> Column:
    """The strongest family, raised by half for each further one that agrees, up to three."""
    return F.greatest(*strengths) * (1 + bonus * F.least(F.greatest(count - 1, F.lit(0)), F.lit(3)))


def bilinear(points: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """Field value at fractional ``(fr, fc)`` from the four cells around; null unless all four exist."""
    r0, c0 = F.floor("fr").cast("long"), F.floor("fc").cast("long")
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    rows = points.withColumns({"_r": r0, "_c": c0}).withColumn("_k", corners)
    rows = rows.withColumns({"row": F.col("_r") + F.col("_k.i"), "col": F.col("_c") + F.col("_k.j")})
    dr, dc = F.col("fr") - F.col("_r"), F.col("fc") - F.col("_c")
    w = F.when(F.col("_k.i") == 1, dr).otherwise(1 - dr) * F.when(F.col("_k.j") == 1, dc).otherwise(1 - dc)
    got = rows.join(cells.select("row", "col", F.col(value).alias("_v")), ["row", "col"], "left")
    return got.groupBy("id").agg(F.when(F.count("_v") == 4, F.sum(F.col("_v") * w)).alias(value))

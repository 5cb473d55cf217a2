"""Thin parts of point clusters, tests of their elongation, and corridors merged along a line."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastrat.operators.emission import chains
from terrastrat.operators.graph import connected_components
from terrastrat.operators.points import axis
from terrastrat.operators.ranking import grouped_percentiles
from terrastrat.session import cut


#: Points of a part up to which one task cuts it to the end.
HELD_POINTS = 200_000


def halved(x: np.ndarray, y: np.ndarray, thin: float, least: int, depth: int, steps: int) -> np.ndarray:
    """The name that :func:`split_clusters` appends to the part for each point of one part; None where the part goes."""
    names = np.full(len(x), None, object)
    open_ = [(np.arange(len(x)), "", depth)]
    while open_:
        rows, name, left = open_.pop()
        if len(rows) < least:
            continue
        px, py = x[rows], y[rows]
        cx, cy = px.mean(), py.mean()
        n = max(len(rows) - 1, 1)
        xx, yy, xy = ((px - cx) ** 2).sum() / n, ((py - cy) ** 2).sum() / n, ((px - cx) * (py - cy)).sum() / n
        mean, half = (xx + yy) / 2, math.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
        if math.sqrt(max(mean - half, 0.0)) <= thin or not left:
            names[rows] = name
            continue
        theta, size = 0.5 * math.atan2(2 * xy, xx - yy), math.sqrt(mean + half)
        a, b = [(cx + s * size * math.cos(theta), cy + s * size * math.sin(theta)) for s in (-1, 1)]
        second = lambda: (px - b[0]) ** 2 + (py - b[1]) ** 2 < (px - a[0]) ** 2 + (py - a[1]) ** 2  # noqa: E731, B023
        for _ in range(steps):
            side = second()
            na, nb = [(px[k].mean(), py[k].mean()) if k.any() else old for k, old in ((~side, a), (side, b))]
            step = max(abs(u - v) for u, v in zip((*na, *nb), (*a, *b), strict=True))
            a, b = na, nb
            if step <= 1e-9:
                break
        side = second()
        if min(side.sum(), (~side).sum()) < 4:
            names[rows] = name
        else:
            open_ += [(rows[~side], name + ".0", left - 1), (rows[side], name + ".1", left - 1)]
    return names


def _within_tasks(rows: DataFrame, thin: float, least: int, depth: int, steps: int) -> DataFrame:
    """``(id, part)`` of parts that are cut to the end, each by one task."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        names = halved(pdf["x"].to_numpy(), pdf["y"].to_numpy(), thin, least, depth, steps)
        kept = np.array([n is not None for n in names], bool)
        return pd.DataFrame({"id": pdf["id"].to_numpy()[kept], "part": [p + n for p, n in zip(pdf["part"].to_numpy()[kept], names[kept], strict=True)]})

    return rows.groupBy("part").applyInPandas(solve, f"id {dict(rows.dtypes)['id']}, part string")


def split_clusters(points: DataFrame, label: str, thin: float, least: int = 12, depth: int = 12, steps: int = 12) -> DataFrame:
    """``(id, part)`` of points ``(id, x, y, label)`` whose part is thin: its minor standard deviation is at most *thin*.

    Thicker parts are cut in two by two-means: centres start at the
    mean shifted by one standard deviation either way along the major axis and move up to *steps*
    times. After *depth* rounds, or where a half would have fewer than four points, a part stays as it
    is; parts of fewer than *least* points go. Parts of over HELD_POINTS points are cut by sums, all together, one
    aggregate a step; the driver holds the centres of these parts only. All others are cut to the end by a task each.
    """
    rows = cut(points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(label).cast("string").alias("part")).dropna())
    spark, done = points.sparkSession, None
    distance = lambda c: F.pow(F.col("x") - F.col(f"{c}x"), F.lit(2.0)) + F.pow(F.col("y") - F.col(f"{c}y"), F.lit(2.0))
    for level in range(depth + 1):
        a = axis(rows, ["part"], "x", "y", divisor="n-1").filter((F.col("n") > HELD_POINTS) & (F.col("n") >= least))
        large = a.select("part", "cx", "cy", "ux", "uy", "l1", F.sqrt("l2").alias("width")).collect()
        names = F.broadcast(spark.createDataFrame([(r.part,) for r in large], "part string"))
        found = _within_tasks(rows.join(names, "part", "left_anti"), thin, least, depth - level, steps)
        thick = {r.part: [r.cx - math.sqrt(r.l1) * r.ux, r.cy - math.sqrt(r.l1) * r.uy, r.cx + math.sqrt(r.l1) * r.ux, r.cy + math.sqrt(r.l1) * r.uy] for r in large if r.width > thin and level < depth}
        stay = [(r.part,) for r in large if r.part not in thick]
        if stay:
            found = found.unionByName(rows.join(F.broadcast(spark.createDataFrame(stay, "part string")), "part", "left_semi").select("id", "part"))
        done = found if done is None else done.unionByName(found)
        if not thick:
            return cut(done)
        table = lambda parts: F.broadcast(spark.createDataFrame([(p, *thick[p]) for p in parts], "part string, ax double, ay double, bx double, by double"))  # noqa: B023, E731
        open_, moving = cut(rows.join(F.broadcast(spark.createDataFrame([(p,) for p in thick], "part string")), "part", "left_semi")), list(thick)
        for _ in range(steps):
            sided = open_.join(table(moving), "part").groupBy("part", (distance("b") < distance("a")).alias("second"))
            moved = {p: list(thick[p]) for p in moving}
            for r in sided.agg(F.avg("x").alias("mx"), F.avg("y").alias("my")).collect():
                moved[r.part][2 * r.second : 2 * r.second + 2] = [r.mx, r.my]
            moving = [p for p in moving if max(abs(u - v) for u, v in zip(moved[p], thick[p], strict=True)) > 1e-9]
            thick |= moved
            if not moving:
                break
        halves = cut(open_.join(table(thick), "part").select("id", "x", "y", "part", F.when(distance("b") < distance("a"), "1").otherwise("0").alias("side")))
        small = F.broadcast(halves.groupBy("part").agg(F.least(F.count_if(F.col("side") == "0"), F.count_if(F.col("side") == "1")).alias("n")).filter("n < 4").select("part"))
        done = done.unionByName(halves.join(small, "part", "left_semi").select("id", "part"))
        rows = cut(halves.join(small, "part", "left_anti").select("id", "x", "y", F.concat_ws(".", "part", "side").alias("part")))


def elongated(points: DataFrame, part: str, least: int = 12, ratio: float = 3.0, p_most: float = 0.01) -> DataFrame:
    """``(part, n, cx, cy, ux, uy, ratio, p, half_length, half_width)`` of parts longer than chance makes isotropic normal points.

    p is exact: for n points in a plane, 2 sqrt(ratio) / (1 + ratio) to the power n - 2. Halves span
    the 5th to 95th percentile along the axis and across it.
    """
    a = axis(points, [part], "x", "y", divisor="n-1").filter(F.col("n") >= least)
    r = F.col("l1") / F.greatest("l2", F.lit(1e-9))
    a = a.withColumn("ratio", r).withColumn("p", F.pow(2 * F.sqrt("ratio") / (1 + F.col("ratio")), F.col("n") - 2))
    a = cut(a.filter((F.col("ratio") >= ratio) & (F.col("p") <= p_most)).select(part, "n", "cx", "cy", "ux", "uy", "ratio", "p"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    rows = points.join(a, part)
    ends = a
    for name, v in (("half_length", dx * F.col("ux") + dy * F.col("uy")), ("half_width", dy * F.col("ux") - dx * F.col("uy"))):
        places = grouped_percentiles(rows, part, v, [0.05, 0.95], ["_low", "_high"])
        ends = ends.join(places.select(part, ((F.col("_high") - F.col("_low")) / 2).alias(name)), part)
    return ends.filter("half_length > 0")


def cluster_lineations(points: DataFrame, label: str, thin: float, least: int = 12, ratio: float = 3.0, p_most: float = 0.01) -> DataFrame:
    """Clusters cut into thin parts, of which the elongated ones are kept (see :func:`split_clusters`, :func:`elongated`)."""
    parts = split_clusters(points, label, thin, least)
    return elongated(cut(points.select("id", "x", "y").join(parts, "id")), "part", least, ratio, p_most)


def merge_corridors(corridors: DataFrame, reach: float, degrees: float, passes: int = 4) -> DataFrame:
    """Corridors ``(id, n, cx, cy, ux, uy, half, width)`` whose nearest ends lie within *reach* and whose axes agree, united.

    All that are chained together become one in a pass: its axis is that of the ends weighted by n, its
    length spans the ends and its width is the widest. Up to *passes*, as united ones may meet others.
    """
    rows = cut(corridors.select("id", F.col("n").cast("double").alias("n"), *[F.col(c).cast("double").alias(c) for c in ("cx", "cy", "ux", "uy", "half", "width")]))
    for _ in range(passes):
        pairs = cut(chains(rows, reach, degrees))
        if pairs.isEmpty():
            break
        group = connected_components(pairs, "a", "b").select(F.col("node").alias("id"), "component")
        named = cut(rows.join(group, "id", "left").withColumn("id", F.coalesce("component", "id")).drop("component"))
        ends = named.withColumn("_e", F.explode(F.array(F.lit(-1.0), F.lit(1.0))))
        ends = cut(ends.select("id", "n", "width", (F.col("cx") + F.col("_e") * F.col("ux") * F.col("half")).alias("x"), (F.col("cy") + F.col("_e") * F.col("uy") * F.col("half")).alias("y")))
        a = axis(ends, ["id"], "x", "y", F.col("n"), more=[(F.sum("n") / 2).alias("m"), F.max("width").alias("width")]).select("id", F.col("m").alias("n"), "cx", "cy", "ux", "uy", "width")
        s = (F.col("x") - F.col("cx")) * F.col("ux") + (F.col("y") - F.col("cy")) * F.col("uy")
        spans = ends.select("id", "x", "y").join(a, "id").groupBy("id").agg(F.min(s).alias("_lo"), F.max(s).alias("_hi"))
        rows = a.join(spans, "id")
        middle = (F.col("_lo") + F.col("_hi")) / 2
        rows = cut(rows.select("id", "n", (F.col("cx") + middle * F.col("ux")).alias("cx"), (F.col("cy") + middle * F.col("uy")).alias("cy"), "ux", "uy", ((F.col("_hi") - F.col("_lo")) / 2).alias("half"), "width"))
    return rows


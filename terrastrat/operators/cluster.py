"""Clusters of points: radius components, DBSCAN, window declustering, mixture thresholds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastrat.operators.decluster import first_windows, mainshocks
from terrastrat.operators.graph import connected_components
from terrastrat.operators.ranking import percentiles
from terrastrat.operators.spatial import radius_join
from terrastrat.operators.tiles import clusters, whole
from terrastrat.session import cut


def radius_components(points: DataFrame, radius: float) -> DataFrame:
    """``(id, component)``: components of the graph of points within *radius*; alone, a point is its own.

    Whole-numbered places go by tiles (see :func:`terrastrat.operators.tiles.clusters`), others by pairs.
    """
    if whole(points, "id"):
        return clusters(points, radius, 1).select("id", F.coalesce("cluster", "id").alias("component"))
    edges = radius_join(points.select("id", "x", "y"), points.select("id", "x", "y"), radius).filter("id < n_id")
    found = connected_components(edges, "id", "n_id").withColumnRenamed("node", "id")
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """``(id, core, cluster)``: core points have *least* points within eps, themselves included.

    A border point joins the cluster of its nearest core point, ties to the lesser id; noise has a
    null cluster. Clusters are named by their least core id. Whole-numbered places go by tiles
    (see :func:`terrastrat.operators.tiles.clusters`), others by pairs.
    """
    if whole(points, "id"):
        return clusters(points, eps, least)
    p = cut(points.select("id", "x", "y"))
    near = cut(radius_join(p, p, eps).select("id", "n_id", "d"))
    core = cut(near.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("id"))
    links = near.join(core, "id").join(core.select(F.col("id").alias("n_id")), "n_id")
    label = cut(connected_components(links, "id", "n_id").select(F.col("node").alias("id"), F.col("component").alias("cluster")))
    border = near.join(core, "id", "left_anti").join(label.withColumnRenamed("id", "n_id"), "n_id")
    border = border.groupBy("id").agg(F.min_by("cluster", F.struct("d", "n_id")).alias("cluster"))
    known = label.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
    return p.select("id").join(known, "id", "left").select("id", F.coalesce("core", F.lit(False)).alias("core"), "cluster")


def aftershock_windows(events: DataFrame, max_rounds: int = 500) -> DataFrame:
    """``(id, parent)`` by magnitude-dependent windows, the largest event first; mainshocks have a null parent.

    Events ``(id, x, y, t_days, mag)`` in km; windows reach both ways in time and only to smaller events
    (later ids among equals). An event that no mainshock before it reaches is a mainshock; others belong to
    the first that reaches them. Events without a place, time or magnitude reach none and are reached by none.
    See :mod:`terrastrat.operators.decluster`; raises if *max_rounds* do not suffice.
    """
    e = cut(events.select("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "t_days", "mag")]))
    there = F.lit(True)
    for c in ("x", "y", "t_days", "mag"):
        there = there & F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    alone = e.filter(~there | F.col("id").isNull()).select("id", F.lit(None).cast(dict(e.dtypes)["id"]).alias("parent"))
    whole_ones = e.filter(there & F.col("id").isNotNull())
    if whole_ones.isEmpty():
        return alone
    return first_windows(whole_ones, *mainshocks(whole_ones, max_rounds)).unionByName(alone)


#: Bins of the values' range, and nodes in each, that stand for all values in a fit.
BINS, NODES = 4096, 8


def nodes_of(values: DataFrame, low: float, high: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, width of a bin): sums over ``v`` of a function that is smooth within bins are sums over the places.

    One aggregate of Chebyshev polynomials by bin: a bin's values are replaced by its nodes, weighted so that every
    polynomial of lesser degree than NODES has the same sum.
    """
    width = (high - low) / BINS
    b = F.least(F.greatest(F.floor((F.col("v") - low) / width), F.lit(0)), F.lit(BINS - 1))
    u = F.greatest(F.least(2 * ((F.col("v") - low) / width - F.col("b")) - 1, F.lit(1.0)), F.lit(-1.0))
    rows = values.select(b.alias("b"), "v").select("b", F.acos(u).alias("a"))
    got = rows.groupBy("b").agg(*[F.sum(F.cos(p * F.col("a"))) for p in range(NODES)]).collect()  # BINS rows at most
    table = np.array([[float(c) for c in r] for r in got])
    angles = (2 * np.arange(NODES) + 1) * np.pi / (2 * NODES)
    factors = np.where(np.arange(NODES)[:, None] > 0, 2.0, 1.0) * np.cos(np.arange(NODES)[:, None] * angles) / NODES
    weights = (table[:, 1:, None] * factors).sum(axis=1)
    return (low + (table[:, :1] + (np.cos(angles) + 1) / 2) * width).ravel(), weights.ravel(), width


def mixture_threshold(values: DataFrame, column: str, rounds: int = 200, tolerance: float = 1e-9) -> dict[str, float | bool]:
    """Two normal components fitted by EM, and the crossing of their densities between the means (else the middle).

    All values are read once, into weighted nodes on the driver (see :func:`nodes_of`; BINS times NODES at most), over which
    rounds are sums. A round whose components are too sharp for the bins is one aggregate of seven sums over all values.
    settled: whether the likelihood stood still within *rounds*.
    """
    v = cut(values.select(F.col(column).cast("double").alias("v")).dropna())
    n, sd, least, most = v.agg(F.count("*"), F.stddev_pop("v"), F.min("v"), F.max("v")).first()
    if not n:
        raise ValueError("no values to fit")
    lo, hi = percentiles(v, F.col("v"), [0.25, 0.75], ["lo", "hi"]).first()
    settled = False
    w, m, s, last = [0.5, 0.5], [lo, hi], [max(sd or 1.0, 1e-6)] * 2, -math.inf
    places, weights, width = nodes_of(v, least, most) if math.isfinite(most - least) and most - least > 1e-9 else (None, None, math.inf)

    def by_nodes(logs: list[float]) -> list[float] | None:
        """Sums of a round over nodes; None where the odds change too much within a bin, or densities vanish."""
        slope = max(abs((at - m[0]) / s[0] ** 2 - (at - m[1]) / s[1] ** 2) for at in (least, most))
        if places is None or width * slope > 0.5 or width > min(s) / 4:
            return None
        density = [np.exp(logs[k] - ((places - m[k]) / s[k]) ** 2 / 2) for k in (0, 1)]
        total = density[0] + density[1]
        if total.min() < 1e-290:
            return None
        p = [d / total * weights for d in density]
        return [float(x.sum()) for k in (0, 1) for x in (p[k], p[k] * places, p[k] * places * places)] + [float((weights * np.log(total)).sum())]

    def by_values(logs: list[float]) -> list[float]:
        density = [F.exp(F.lit(logs[k]) - F.pow((F.col("v") - m[k]) / s[k], F.lit(2.0)) / 2) for k in (0, 1)]
        total = F.greatest(density[0] + density[1], F.lit(1e-300))
        p = [d / total for d in density]
        sums = [F.sum(x) for k in (0, 1) for x in (p[k], p[k] * F.col("v"), p[k] * F.col("v") * F.col("v"))]
        return v.agg(*sums, F.sum(F.log(total))).first()

    for _ in range(rounds):
        logs = [math.log(w[k]) - math.log(s[k]) - 0.5 * math.log(2 * math.pi) for k in (0, 1)]
        row = by_nodes(logs) or by_values(logs)
        for k in (0, 1):
            mass, first, second = row[3 * k : 3 * k + 3]
            mass = max(mass, 1e-12)
            w[k], m[k] = mass / n, first / mass
            s[k] = math.sqrt(max(second / mass - m[k] ** 2, 1e-6))
        settled = abs(row[6] - last) < tolerance * max(1.0, abs(row[6]))
        if settled:
            break
        last = row[6]
    a = 1 / s[1] ** 2 - 1 / s[0] ** 2
    b = 2 * (m[0] / s[0] ** 2 - m[1] / s[1] ** 2)
    c = m[1] ** 2 / s[1] ** 2 - m[0] ** 2 / s[0] ** 2 + 2 * math.log(w[0] * s[1] / (w[1] * s[0]))
    roots = np.roots([a, b, c]) if abs(a) > 1e-12 else np.array([-c / b]) if b else np.array([])
    inner = [float(r.real) for r in roots if abs(r.imag) < 1e-9 and min(m) < r.real < max(m)]
    return {"threshold": inner[0] if inner else sum(m) / 2, "mean_low": min(m), "mean_high": max(m), "weight_low": w[int(m[1] < m[0])], "settled": settled}

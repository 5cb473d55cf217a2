"""Bootstrap of groups in one aggregate: hashed Poisson weights, sums for every draw, no Python a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastrat.functions.expressions import axial_difference, eigen2, normal3, unit_hash

DRAWS, MOST = 24, 7


def poisson_steps(most: int = MOST) -> list[float]:
    """Distribution function of the Poisson law of mean 1 at 0, 1, ...: a uniform number above k of them weighs k."""
    out, term = [], math.exp(-1)
    for k in range(most):
        out.append(sum([term / math.factorial(i) for i in range(k + 1)]))
    return out


def poisson(u: Column) -> Column:
    """Weight of a uniform number; weights beyond seven have a chance of 1e-5 and count as seven."""
    total = F.lit(0)
    for c in poisson_steps():
        total = total + (u > c).cast("int")
    return total


def moments(points: DataFrame, key: str, item: str, values: dict[str, Column], draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """``(key, draw, n, w, means and covariances)`` of *values* under each draw's weights.

    Every row weighs Poisson(1) in a draw, by the hash of its key, item and the draw's number, so a draw is a
    resample of each group without knowing its size. Sums are combined before the one shuffle, one row a task,
    group and draw. Names: ``m_x`` for means, ``c_x_y`` for covariances (divided by the weights). Values should be
    local, so that squares keep their digits.
    """
    names = list(values)
    rows = points.select(F.col(key), F.col(item).alias("_i"), *[v.cast("double").alias(n) for n, v in values.items()])
    # hashing is the work, so rows are dealt to all tasks even where they come in few files
    rows = rows.repartition(max(points.sparkSession.sparkContext.defaultParallelism, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key, "_i")
    # the generator hashes each row and draw once; as a column it would be hashed again for every step of the weight
    drawn = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda d: F.struct(d.alias("draw"), unit_hash(F.col(key), F.col("_i"), d, seed=seed).alias("u")))
    rows = rows.withColumn("_d", F.explode(drawn)).filter(F.col("_d.u") > poisson_steps()[0])
    rows = rows.select(key, *names, F.col("_d.draw").alias("draw"), poisson(F.col("_d.u")).cast("double").alias("_w"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    w = F.col("_w")
    sums = rows.groupBy(key, "draw").agg(
        F.count("*").alias("n"), F.sum(w).alias("w"), *[F.sum(w * F.col(n)).alias(f"m_{n}") for n in names], *[F.sum(w * F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for a, b in pairs]
    )
    means = sums.withColumns({f"m_{n}": F.col(f"m_{n}") / F.col("w") for n in names})
    return means.withColumns({f"c_{a}_{b}": F.col(f"c_{a}_{b}") / F.col("w") - F.col(f"m_{a}") * F.col(f"m_{b}") for a, b in pairs})


def quantile(values: Column, q: float) -> Column:
    """Interpolated quantile of an array of numbers without nulls; null if it is empty."""
    v = F.array_sort(values)
    at = (F.size(v) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    return F.when(F.size(v) > 0, F.get(v, low) + (at - low) * (F.get(v, F.least(low + 1, F.size(v) - 1)) - F.get(v, low)))


def axis_spread(points: DataFrame, key: str, item: str, x: str = "x", y: str = "y", draws: int = DRAWS, q: float = 0.9, seed: int = 0) -> DataFrame:
    """``(key, n, angle, spread)``: the direction of each group's long axis, degrees from x in [0, 180), and the *q* quantile of how far draws turn it.

    The axis itself is that of all rows, which take part as one more draw of weights 1. Draws that leave a
    group without two places count 90 degrees.
    """
    whole = points.select(F.col(key), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    flat = lambda t, p: eigen2(*[F.col(f"{p}{c}") for c in ("x_x", "x_y", "y_y")])
    one = whole.groupBy(key).agg(F.count("*").alias("n"), F.avg("x").alias("_x"), F.avg("y").alias("_y"), F.avg(F.col("x") * F.col("x")).alias("_xx"), F.avg(F.col("x") * F.col("y")).alias("_xy"), F.avg(F.col("y") * F.col("y")).alias("_yy"))
    one = one.select(key, "n", (F.col("_xx") - F.col("_x") * F.col("_x")).alias("a_x_x"), (F.col("_xy") - F.col("_x") * F.col("_y")).alias("a_x_y"), (F.col("_yy") - F.col("_y") * F.col("_y")).alias("a_y_y"))
    one = one.select(key, "n", F.pmod(F.degrees(flat(one, "a_")[2]), F.lit(180.0)).alias("angle"))
    drawn = moments(points, key, item, {"x": F.col(x), "y": F.col(y)}, draws, seed)
    turned = drawn.select(key, F.pmod(F.degrees(flat(drawn, "c_")[2]), F.lit(180.0)).alias("_a"), "n")
    arrays = turned.groupBy(key).agg(F.collect_list(F.when(F.col("n") > 1, F.col("_a")).otherwise(F.lit(float("nan")))).alias("_all"))  # *draws* numbers at most
    off = F.transform("_all", lambda a: F.when(F.isnan(a), F.lit(90.0)).otherwise(axial_difference(a, F.col("angle"))))
    # a draw in which no row of a group has a weight leaves no row at all
    off = F.concat(off, F.array_repeat(F.lit(90.0), F.lit(draws) - F.size("_all")))
    return one.join(arrays, key, "left").withColumn("_all", F.coalesce("_all", F.array().cast("array<double>"))).select(key, "n", "angle", quantile(off, q).alias("spread"))


def strike_spread(points: DataFrame, key: str, item: str, strikes: DataFrame, draws: int = DRAWS, q: float = 0.9, least_horizontal: float = 0.2, seed: int = 0) -> DataFrame:
    """``(key, spread)`` for ``strikes (key, ux, uy)``: the *q* quantile of the angle between a plane's strike and those of redrawn planes.

    points: ``(key, item, x, y, z)``, local. Draws whose plane is nearly level (the horizontal part of its
    normal below *least_horizontal*), and groups of under five points, count 90 degrees.
    """
    drawn = moments(points, key, item, {c: F.col(c) for c in "xyz"}, draws, seed)
    nx, ny, _ = normal3(*[F.col(f"c_{p}") for p in ("x_x", "x_y", "x_z", "y_y", "y_z", "z_z")])
    drawn = drawn.select(key, "n", nx.alias("_nx"), ny.alias("_ny"))
    level = F.hypot("_nx", "_ny")
    met = drawn.join(strikes.select(key, "ux", "uy"), key)
    dot = F.least(F.abs(-F.col("_ny") * F.col("ux") + F.col("_nx") * F.col("uy")) / level, F.lit(1.0))
    angle = F.when(level >= least_horizontal, F.degrees(F.acos(dot))).otherwise(F.lit(90.0))
    arrays = met.groupBy(key).agg(F.collect_list(F.coalesce(angle, F.lit(90.0))).alias("_all"))
    sizes = points.groupBy(key).agg(F.count("*").alias("_n"))
    off = F.concat("_all", F.array_repeat(F.lit(90.0), F.lit(draws) - F.size("_all")))
    return arrays.join(sizes, key).select(key, F.when(F.col("_n") < 5, F.lit(90.0)).otherwise(quantile(off, q)).alias("spread"))

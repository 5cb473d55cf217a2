"""Lines of points that beat random catalogues of the same coarse density."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrastrat.functions.expressions import unit_hash
from terrastrat.operators.ordered import totals_before
from terrastrat.operators.ranking import grouped_percentiles
from terrastrat.operators.select import spaced
from terrastrat.session import BROADCAST_ROWS, cut, small_join

#: Draws a slice of the running total, on average.
SLICE = 4096
#: An empty cell weighs one, a point so many: 0.05 of a point for every cell.
POINT = 20


def surrogates(points: DataFrame, rows: int, cols: int, count: int = 20, cell: int = 50, seed: int = 0) -> DataFrame:
    """``(s, i, x, y)``: *count* catalogues of as many points as ``(x, y)`` has, with its density by square cells and nothing finer.

    Every cell of the grid weighs its points and 0.05 more; points outside count in the nearest cell and rows without a
    place are left out. Weights are whole numbers, so running totals are exact. A draw is a hashed number below their
    sum; totals and draws are sliced evenly, each slice starts from the cell that covers its start, and draws take the
    last cell below them by one sort inside the slice: draws are uniform, so slices are even however dense one cell is.
    """
    spark = points.sparkSession
    high, wide = rows // cell + 1, cols // cell + 1
    at = lambda c, n: F.least(F.greatest(F.floor(F.col(c) / cell), F.lit(0)), F.lit(n - 1)).cast("long")
    held = points.select("x", "y").dropna().groupBy((at("y", high) * wide + at("x", wide)).alias("c")).agg(F.count("*").alias("n"))
    weights = spark.range(high * wide).select(F.col("id").alias("c"), (F.col("id") + 1).alias("rn")).join(held, "c", "left")
    weights = cut(totals_before(weights.withColumn("w", F.coalesce("n", F.lit(0)) * POINT + 1), "w", "low"))
    n, total = weights.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("w")).first()
    slices = max(n * count // SLICE, 1)
    width = total / slices
    slice_of = lambda c: F.least(F.floor(F.col(c) / width), F.lit(slices - 1))
    draws = spark.range(n * count).select(F.expr(f"id div {max(n, 1)}").alias("s"), F.expr(f"id % {max(n, 1)}").alias("i"))
    draws = draws.withColumn("u", unit_hash(F.col("s"), F.col("i"), seed=seed) * float(total))
    steps = F.sequence(F.ceil(F.col("low") / width), F.greatest(F.ceil((F.col("low") + F.col("w")) / width) - 1, F.ceil(F.col("low") / width)))
    starts = weights.withColumn("k", F.explode(steps)).filter(F.col("k") * width < F.col("low") + F.col("w"))
    nothing = [F.lit(None).cast("long").alias(c) for c in ("s", "i")]
    bounds = weights.select(slice_of("low").alias("k"), "low", "c", *nothing)
    bounds = bounds.unionByName(starts.select("k", F.lit(-1.0).alias("low"), "c", *nothing)).withColumn("_z", F.lit(0))
    all_rows = bounds.unionByName(draws.select(slice_of("u").alias("k"), F.col("u").alias("low"), F.lit(None).cast("long").alias("c"), "s", "i", F.lit(1).alias("_z")))
    covering = F.last("c", ignorenulls=True).over(W.partitionBy("k").orderBy("low", "_z", "c").rowsBetween(W.unboundedPreceding, 0))
    placed = all_rows.withColumn("c", covering).filter("_z = 1")
    inside = lambda corner, step: corner * cell + unit_hash(F.col("s"), F.col("i"), seed=seed + step) * cell
    return placed.select("s", "i", inside(F.col("c") % wide, 1).alias("x"), inside(F.expr(f"c div {wide}"), 2).alias("y"))


def _turned(points: DataFrame, thetas: int, width: float, far: float) -> DataFrame:
    """A row for each point and direction: ``theta, rho`` (its distance along the normal) and ``bin`` (from 0)."""
    angle = F.col("theta") * (math.pi / thetas)
    rows = points.withColumn("theta", F.explode(F.sequence(F.lit(0), F.lit(thetas - 1))))
    rows = rows.withColumn("rho", F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle))
    return rows.withColumn("bin", F.floor(F.col("rho") / width + far / width).cast("long"))


def _angles(points: DataFrame, thetas: int) -> list[tuple[float, float]]:
    """(cosine, sine) of each direction, as Spark's own functions give them."""
    angle = F.col("id") * (math.pi / thetas)
    return [(r[0], r[1]) for r in points.sparkSession.range(thetas).orderBy("id").select(F.cos(angle), F.sin(angle)).collect()]


def _votes(points: DataFrame, thetas: int, width: float, far: float, last: int) -> DataFrame:
    """``(theta, bin, v, w, r)`` of rows ``(x, y, w, _r)``: rows with ``_r = 0``, sum of w, and other rows, by direction and bin.

    A task counts its rows in tables of all directions and bins from 0 to *last*, and gives what they hold; votes outside, which only
    points beyond the grid have, are counted apart. So no row is copied for each direction.
    """
    angles, wide = _angles(points, thetas), last + 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [np.zeros((thetas, wide)) for _ in range(3)]
        for pdf in batches:
            x, y, w, other = (pdf[c].to_numpy() for c in ("x", "y", "w", "_r"))
            kinds = [(0, np.flatnonzero(other == 0)), (2, np.flatnonzero(other != 0))]
            for n, (cos, sin) in enumerate(angles):
                at = np.floor((x * cos + y * sin) / width + far / width)
                if len(at) and (at.min() < 0 or at.max() > last):
                    out = (at < 0) | (at > last)
                    bins, real = at[out].astype(np.int64), other[out] == 0
                    yield pd.DataFrame({"theta": n, "bin": bins, "v": real.astype(np.int64), "w": w[out], "r": (~real).astype(np.int64)})
                    at = np.where(out, wide, at)
                at = at.astype(np.int64)
                for k, rows in kinds:
                    if len(rows):
                        tables[k][n] += np.bincount(at[rows], minlength=wide + 1)[:wide]
                if len(kinds[0][1]):
                    tables[1][n] += np.bincount(at[kinds[0][1]], w[kinds[0][1]], minlength=wide + 1)[:wide]
        theta, bins = np.nonzero((tables[0] > 0) | (tables[2] > 0))
        v, w, r = (t[theta, bins] for t in tables)
        yield pd.DataFrame({"theta": theta, "bin": bins, "v": v.astype(np.int64), "w": w, "r": r.astype(np.int64)})

    rows = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"), "_r").dropna(subset=["x", "y"])
    return rows.mapInPandas(count, "theta long, bin long, v long, w double, r long").groupBy("theta", "bin").agg(*[F.sum(c).alias(c) for c in ("v", "w", "r")])


def _met(points: DataFrame, near: DataFrame, thetas: int, width: float, far: float) -> DataFrame:
    """As :func:`_turned` joined with the written *near* by direction and bin; points turn to lines' directions only.

    Up to BROADCAST_ROWS rows of *near*, their directions and bins go to the tasks, which let no other rows pass.
    """
    rows = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    if near.count() > BROADCAST_ROWS:
        return small_join(_turned(rows, thetas, width, far).withColumn("theta", F.col("theta").cast("long")), near, ["theta", "bin"])
    held: dict[int, list[int]] = {}
    for r in near.select("theta", "bin").distinct().collect():
        held.setdefault(r[0], []).append(r[1])
    held = {n: np.sort(np.array(b, np.int64)) for n, b in sorted(held.items())}
    angles = _angles(points, thetas) if held else []

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y, parts = pdf["x"].to_numpy(), pdf["y"].to_numpy(), [np.zeros((5, 0))]
            for n, wanted in held.items():
                cos, sin = angles[n % thetas]
                rho = x * cos + y * sin
                at = np.floor(rho / width + far / width).astype(np.int64)
                low = int(wanted[0])
                table = np.zeros(int(wanted[-1]) - low + 3, bool)
                table[wanted - low + 1] = True
                on = np.flatnonzero(table[np.clip(at - low + 1, 0, len(table) - 1)])
                parts.append(np.stack([x[on], y[on], np.full(len(on), float(n)), rho[on], at[on]]))
            yield pd.DataFrame(np.concatenate(parts, axis=1).T, columns=["x", "y", "theta", "rho", "bin"]).astype({"theta": np.int64, "bin": np.int64})

    return small_join(rows.mapInPandas(turn, "x double, y double, theta long, rho double, bin long"), near, ["theta", "bin"])


def line_significance(points: DataFrame, random: DataFrame, count: int, rows: int, cols: int, thetas: int = 180, width: float = 1.0, smooth: int = 1) -> DataFrame:
    """``(theta, bin, votes, weighted, expected, z)`` of line bins with a vote, in *points* ``(x, y, weight)`` or in *random* ``(x, y)``.

    A point votes for its bin and *smooth* bins to either side. expected: votes in *random*, a *count*-th of them; z is
    the excess over it in units of its root, one added. weighted: votes by weight over the largest weight. Points vote
    in tables of a task each, whose bins, not points, are then copied to their neighbours.
    """
    far = math.hypot(rows, cols) + 2
    last = math.ceil(2 * far / width)
    ready = cut(points.select("x", "y", F.col("weight").cast("double").alias("weight")).dropna())
    top = ready.agg(F.max("weight").alias("_top"))
    own = ready.join(F.broadcast(top)).select("x", "y", F.when(F.col("_top") == 0, F.col("weight")).otherwise(F.col("weight") / F.col("_top")).alias("w"), F.lit(0).alias("_r"))  # one row
    both = own.unionByName(random.select("x", "y", F.lit(0.0).alias("w"), F.lit(1).alias("_r")))
    votes = _votes(both, thetas, width, far, last)
    votes = votes.withColumn("bin", F.explode(F.sequence(F.col("bin") - smooth, F.col("bin") + smooth))).filter(F.col("bin").between(0, last))
    sums = votes.groupBy("theta", "bin").agg(F.sum("v").alias("votes"), F.sum("w").alias("weighted"), (F.sum("r") / float(count)).alias("expected"))
    return sums.withColumn("z", (F.col("votes") - F.col("expected")) / F.sqrt(F.col("expected") + 1)).withColumn("theta", F.col("theta").cast("long"))


def peaks(bins: DataFrame, z_least: float, least: int) -> DataFrame:
    """Bins of *bins* whose z is over *z_least*, above the bin before and not below the one after; absent bins have z 0."""
    side = lambda step, name: bins.select("theta", (F.col("bin") + step).alias("bin"), F.col("z").alias(name))
    rows = bins.filter((F.col("z") > z_least) & (F.col("votes") >= least))
    rows = rows.join(side(1, "_l"), ["theta", "bin"], "left").join(side(-1, "_r"), ["theta", "bin"], "left").fillna(0.0, ["_l", "_r"])
    return rows.filter((F.col("z") > F.col("_l")) & (F.col("z") >= F.col("_r"))).drop("_l", "_r")


def detect_lines(points: DataFrame, random: DataFrame, count: int, rows: int, cols: int, thetas: int = 180, width: float = 1.0, smooth: int = 1, z_least: float = 6.0, least: int = 8, extent: float = 40.0, degrees: float = 5.0, apart: float = 4.0, most: int = 4000) -> DataFrame:
    """``(theta, rho, z, n, expected, extent, t_min, t_max, weighted)``: significant lines of *points*, near-duplicates left out.

    Peaks (see :func:`line_significance`, :func:`peaks`) are taken by falling z, those less than *degrees* and less than
    *apart* from a better one go, equal z by the larger direction and bin, *most* at most. Directions go round at 180
    degrees. theta is in radians, rho the lower side of the bin. Points within *smooth* and a half bins of rho carry the
    line: it needs three and must be *extent* long between their 5th and 95th percentiles. Points meet the lines by
    direction and bin, so they aren't shuffled while lines are few; percentiles are of one sort over all lines.
    """
    far = math.hypot(rows, cols) + 2
    bins = cut(line_significance(points, random, count, rows, cols, thetas, width, smooth))
    inner = bins.filter(F.col("bin").between(1, math.ceil(2 * far / width) - 1))
    found = cut(peaks(bins, z_least, least).join(inner.select("theta", "bin"), ["theta", "bin"], "left_semi"))
    # the order of the choice is by rows and columns ascending, that of the rule by larger ones first
    ring = [(i, j, 1.0) for i in range(-thetas, thetas + 1) for j in range(-math.ceil(apart / width), math.ceil(apart / width) + 1) if abs(i) * 180 / thetas < degrees and abs(j) * width < apart]
    order = found.select((F.lit(thetas - 1) - F.col("theta")).alias("row"), (-F.col("bin")).alias("col"), "z")
    kept = spaced(order, "z", ring, most, period=thetas).select((F.lit(thetas - 1) - F.col("row")).alias("theta"), (-F.col("col")).alias("bin"))
    kept = cut(kept.join(found, ["theta", "bin"]).withColumn("line", F.col("theta") * (1 << 40) + F.col("bin")))
    reach = (smooth + 0.5) * width
    span = math.ceil(smooth + 0.5)
    near = kept.select("theta", "line", (F.col("bin") * width - far).alias("at"), F.explode(F.sequence(F.col("bin") - span - 1, F.col("bin") + span)).alias("bin"))
    angle: Column = F.col("theta") * (math.pi / thetas)
    on = _met(points, cut(near), thetas, width, far).filter(F.abs(F.col("rho") - F.col("at")) <= reach)
    on = cut(on.select("line", (F.col("y") * F.cos(angle) - F.col("x") * F.sin(angle)).alias("t")))
    ends = on.groupBy("line").agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    spans = grouped_percentiles(on, "line", F.col("t"), [0.05, 0.95], ["_a", "_b"]).filter("n >= 3").select("line", (F.col("_b") - F.col("_a")).alias("extent"))
    out = kept.join(spans.filter(F.col("extent") >= extent), "line").join(ends, "line")
    whole = 2 * smooth + 1
    return out.select(angle.alias("theta"), (F.col("bin") * width - far).alias("rho"), "z", F.floor(F.col("votes") / whole).alias("n"), (F.col("expected") / whole).alias("expected"), "extent", "t_min", "t_max", "weighted")


def local_spans(points: DataFrame, lines: DataFrame, thetas: int = 180, window: float = 24.0, z_least: float = 4.0, least: int = 6, merge: float = 12.0, side: float = 5.0, half: float = 1.5) -> DataFrame:
    """``(theta, rho, z, n, extent, t_min, t_max)``: the spans along *lines* that hold more points than their surroundings.

    lines: as of :func:`detect_lines` with the same *thetas*. Windows stand at every half window from t_min on; each counts
    points within *half* of the line and within *half* of two lines *side* away. A window is kept when its points
    exceed *least* and the mean of the line's side windows by *z_least* of their deviations. Kept windows at most *merge* apart
    become one span, whose n is its points on the line. A line shorter than a window stays as it is, one
    without a kept window goes. A point meets the lines by direction and bin and falls into three windows at most.
    """
    step, width = window / 2, max(side + half, 1e-9)
    ready = lines.select("rho", "z", "n", "t_min", "t_max", F.rint(F.col("theta") * thetas / math.pi).cast("long").alias("theta"))
    ready = cut(ready.withColumn("line", F.monotonically_increasing_id()).withColumn("_j", F.ceil((F.col("t_max") + 1e-9 - F.col("t_min")) / step)))
    short = F.col("t_max") - F.col("t_min") < window
    angle = F.col("theta") * (math.pi / thetas)
    long_ones = ready.filter(~short)
    near = long_ones.select("line", "theta", F.col("rho").alias("at"), "t_min", "_j", F.explode(F.sequence(F.floor((F.col("rho") - width) / width), F.floor((F.col("rho") + width) / width))).alias("bin"))
    met = _met(points, cut(near), thetas, width, 0.0).withColumn("t", F.col("y") * F.cos(angle) - F.col("x") * F.sin(angle))
    strips = F.array_compact(F.array(*[F.when(F.abs(F.col("rho") - (F.col("at") + d)) <= half, F.lit(i)) for i, d in enumerate((0.0, -side, side))]))
    met = cut(met.withColumn("strip", F.explode(strips)).select("line", "strip", "t", "t_min", "_j"))
    place = (F.col("t") - F.col("t_min")) / step
    counted = met.withColumn("j", F.explode(F.sequence(F.floor(place) - 1, F.floor(place) + 2)))
    counted = counted.filter((F.abs(F.col("t") - (F.col("t_min") + F.col("j") * step)) <= step) & (F.col("j") >= 0) & (F.col("j") < F.col("_j")))
    sums = counted.groupBy("line", "j").agg(*[F.count_if(F.col("strip") == i).alias(f"_{i}") for i in range(3)])
    # windows without a point count in the mean by their number alone
    bars = sums.groupBy("line").agg(F.sum(F.col("_1") + F.col("_2")).alias("s"), F.sum(F.col("_1") * F.col("_1") + F.col("_2") * F.col("_2")).alias("q"))
    bars = bars.join(long_ones.select("line", "t_min", (2 * F.col("_j")).alias("m")), "line")
    bar = F.col("s") / F.col("m") + z_least * (F.sqrt((F.col("m") * F.col("q") - F.col("s") * F.col("s")).cast("double")) / F.col("m") + 1e-9)
    kept = sums.join(bars.select("line", "t_min", F.greatest(bar, F.lit(float(least))).alias("bar")), "line").filter(F.col("_0") > F.col("bar"))
    order = W.partitionBy("line").orderBy("j")
    fresh = F.coalesce(((F.col("j") - F.lag("j").over(order) - 2) * step > merge + 1e-9).cast("int"), F.lit(1))
    runs = kept.withColumn("_new", fresh).withColumn("run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy("line", "run").agg((F.first("t_min") + F.min("j") * step - step).alias("a"), (F.first("t_min") + F.max("j") * step + step).alias("b"))
    spans = cut(spans)
    on = small_join(met.filter("strip = 0").select("line", "t"), spans, "line").filter(F.col("t").between(F.col("a"), F.col("b")))
    held = on.groupBy("line", "run", "a", "b").agg(F.count("*").alias("n"))
    pruned = held.join(ready.drop("n"), "line").select("theta", "rho", "z", "n", (F.col("b") - F.col("a")).alias("extent"), F.col("a").alias("t_min"), F.col("b").alias("t_max"))
    same = ready.filter(short).select("theta", "rho", "z", F.col("n").cast("long").alias("n"), (F.col("t_max") - F.col("t_min")).alias("extent"), "t_min", "t_max")
    return pruned.unionByName(same).withColumn("theta", angle)

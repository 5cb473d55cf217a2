"""Exact distances to the nearest source cell, however far, with that cell.

Two separable passes. Along columns every strip of rows gets the last source above it and the first one below
it, handed over all strips by running sums of each column. Along rows each source column is a parabola, and
the lower envelope of all parabolas is found for all rows of a strip in step. Work is one step a source
column and strip, and doesn't depend on distances.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrastrat.operators.kernels import spread, square
from terrastrat.session import cut

#: Rows of a strip, and rows times source columns that one task holds at most (one row is always held).
HEIGHT, HELD = 256, 1 << 23
_NONE = np.int64(-(1 << 40))


def above_and_below(rows: int, inside: list, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Nearest source row of every row (from 0) and column, the upper one of two; above and below are beyond the strip or _NONE."""
    before = np.full((rows, len(inside)), _NONE)
    column = np.repeat(np.arange(len(inside)), [len(x) for x in inside])
    at = np.concatenate([np.asarray(x, np.int64) for x in inside]) if len(column) else np.zeros(0, np.int64)
    before[at, column] = at
    after = np.where(before == _NONE, -_NONE, before)
    before[0] = np.maximum(before[0], above)
    after[-1] = np.minimum(after[-1], np.where(below == _NONE, -_NONE, below))
    before = np.maximum.accumulate(before, axis=0)
    after = np.minimum.accumulate(after[::-1], axis=0)[::-1]
    here = np.arange(rows)[:, None]
    return np.where(here - before <= after - here, before, after)


def envelope(cost: np.ndarray, at: np.ndarray, scale: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower envelopes over 0..last of ``scale * (x - at)**2 + cost``, one a row of *cost* (rows x parabolas), *at* ascending.

    Gives (owner, start, top): the parabolas of a row's envelope and where each begins, up to place top. The
    parabola further left wins ties.
    """
    rows, n = cost.shape
    owner, start, top, all_rows = np.zeros((rows, n), np.int64), np.zeros((rows, n), np.int64), np.full(rows, -1), np.arange(rows)
    for u in range(n):
        live = all_rows[top >= 0]
        while len(live):  # those that the new parabola beats from where they begin are gone
            k = top[live]
            v, t = owner[live, k], start[live, k]
            live = live[scale * (t - at[v]) ** 2 + cost[live, v] > scale * (t - at[u]) ** 2 + cost[live, u]]
            top[live] -= 1
            live = live[top[live] >= 0]
        some = top >= 0
        v = owner[all_rows, np.maximum(top, 0)]
        apart = np.where(some, 2 * scale * (at[u] - at[v]), 1)
        begin = np.where(some, (scale * (at[u] ** 2 - at[v] ** 2) + cost[:, u] - cost[all_rows, v]) // apart + 1, 0)
        put = np.flatnonzero(begin <= last)
        top[put] += 1
        owner[put, top[put]], start[put, top[put]] = u, begin[put]
    return owner, start, top


def nearest_in_strip(r: np.ndarray, c: np.ndarray, rows: int, width: int, scale: int, near: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(source row, source column) of places (r, c), from the nearest source row of every row and source column *at*."""
    here = np.arange(rows)[:, None]
    # the row of the source breaks ties of equal squares, as a fraction of one
    owner, start, top = envelope((here - near) ** 2 * scale + near - near.min(), at, scale, width - 1)
    used = np.arange(len(at)) <= top[:, None]
    keys = (here * width + start)[used]
    found = owner[used][np.searchsorted(keys, r * width + c, side="right") - 1]
    return near[r, found], at[found]


def nearest(cells: DataFrame, sources: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``(row, col, near_row, near_col, squared)`` of every row of *cells*: the nearest of *sources*, and the squared distance.

    Of equally near sources the one of the smallest row, then column, is taken. Without sources all three
    are null. Places are whole numbers; rows with a null place are left out; repeated rows give a row each.
    """
    places = cut(sources.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).dropna().distinct())
    wanted = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).dropna()
    box = places.agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min("col").alias("c"), F.max("col").alias("d"), F.count_distinct("col").alias("n")).first()
    if not box["n"]:
        return wanted.select("row", "col", *[F.lit(None).cast("long").alias(n) for n in ("near_row", "near_col", "squared")])
    own = wanted.agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min("col").alias("c"), F.max("col").alias("d")).first()
    if own["a"] is None:
        return wanted.select("row", "col", *[F.lit(0).cast("long").alias(n) for n in ("near_row", "near_col", "squared")])
    (r0, r1), (c0, c1) = ((f(own[i], box[i]) for i, f in zip(p, (min, max), strict=True)) for p in ("ab", "cd"))
    h, tall, wide = max(1, min(height, HELD // box["n"])), r1 - r0 + 1, c1 - c0 + 1
    if 4 * tall * (tall**2 + wide**2) >= 1 << 63:
        raise ValueError(f"a grid of {tall} x {wide} cells is too large for squares in 64 bits")
    strip = lambda c: F.expr(f"({c} - {r0}) div {h}")
    inside = places.groupBy("col", strip("row").alias("strip")).agg(F.array_sort(F.collect_list("row")).alias("inside"))  # h rows at most
    low, high = (own["a"] - r0) // h, (own["b"] - r0) // h
    every = places.select("col").distinct().select("col", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))).alias("strip"))
    both = inside.unionByName(every, allowMissingColumns=True).groupBy("col", "strip").agg(F.max("inside").alias("inside"))
    up, down = (W.partitionBy("col").orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc("strip"), F.desc("strip")))
    handed = both.select("strip", "col", "inside", F.last(F.element_at("inside", -1), True).over(up).alias("above"), F.last(F.element_at("inside", 1), True).over(down).alias("below"))
    lines = handed.filter(F.col("strip").between(low, high))

    def solve(cells: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        if not len(cells):
            return pd.DataFrame({n: np.zeros(0, np.int64) for n in ("row", "col", "near_row", "near_col", "squared")})
        first = r0 + int(cells["strip"].iloc[0]) * h
        lines = lines.sort_values("col")
        local = lambda c: lines[c].sub(first).fillna(_NONE).to_numpy(np.int64)
        held = [() if x is None else np.asarray(x) - first for x in lines["inside"]]
        near = above_and_below(h, held, local("above"), local("below"))
        r, c = cells["row"].to_numpy(), cells["col"].to_numpy()
        y, x = nearest_in_strip(r - first, c - c0, h, wide, tall, near, lines["col"].to_numpy() - c0)
        y, x = y + first, x + c0
        return pd.DataFrame({"row": r, "col": c, "near_row": y, "near_col": x, "squared": (r - y) ** 2 + (c - x) ** 2})

    grouped = wanted.withColumn("strip", strip("row")).groupBy("strip").cogroup(lines.groupBy("strip"))
    return grouped.applyInPandas(solve, "row long, col long, near_row long, near_col long, squared long")


def distances(cells: DataFrame, sources: DataFrame, out: str = "distance", spacing: float = 1.0, height: int = HEIGHT) -> DataFrame:
    """``(row, col, out)``: the distance to the nearest source, in units of which a cell's side has *spacing*."""
    return nearest(cells, sources, height).select("row", "col", (F.sqrt(F.col("squared").cast("double")) * spacing).alias(out))


def border(cells: DataFrame, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """Cells just outside of *cells*, of a grid of *rows* x *cols* if given: the nearest outside cell of any cell is among them."""
    around = spread(cells.select("row", "col"), square(1), []).select("row", "col").distinct()
    outside = around.join(cells.select("row", "col"), ["row", "col"], "left_anti")
    for name, n in (("row", rows), ("col", cols)):
        if n is not None:
            outside = outside.filter(F.col(name).between(0, n - 1))
    return outside


def edge_distances(cells: DataFrame, rows: int | None = None, cols: int | None = None, out: str = "distance") -> DataFrame:
    """``(row, col, out)``: how far each cell is from the nearest cell of the grid that is not one of *cells*."""
    return distances(cells, border(cells, rows, cols), out)


def filled(cells: DataFrame, value: str, within: DataFrame) -> DataFrame:
    """``(row, col, value)`` of *within*: its own value or else that of the nearest cell that has one, however far, ties by place."""
    known = cells.filter(F.col(value).isNotNull())
    if dict(cells.dtypes)[value] in ("double", "float"):
        known = known.filter(~F.isnan(value))
    known = cut(known.select("row", "col", value))
    values = known.select(F.col("row").alias("near_row"), F.col("col").alias("near_col"), value)
    return nearest(within, known).join(values, ["near_row", "near_col"], "left").select("row", "col", value)

"""Queries of exact distances on the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.operators import distance
from terrastrat.plans import adapters as A
from terrastrat.plans.registry import register

#: Brute force: squares, then the source's row and column, in one number.
_ALL = """SELECT c.row, c.col, min(((c.row - s.row) * (c.row - s.row) + (c.col - s.col) * (c.col - s.col)) * 1048576 + s.row * 1024 + s.col) AS m
  FROM {cells} c CROSS JOIN {sources} s GROUP BY 1, 2"""
_FAR = "far AS (SELECT row, col FROM truth WHERE row < 24 AND col >= 200)"


@register("distance_transform", A.sql("cells truth", ",\nm AS (" + _ALL.format(cells="cells", sources="truth") + ")\nSELECT row, col, m // 1024 % 1024 AS near_row, m % 1024 AS near_col, m // 1048576 AS squared FROM m"))
def distance_transform(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest truth cell of every cell."""
    return distance.nearest(A.cells(spark, folder), A.truth(spark, folder), 64)


@register(
    "distance_from_corner",
    A.sql("cells truth", f",\n{_FAR},\nm AS (" + _ALL.format(cells="cells", sources="far") + ")\nSELECT row, col, round(100 * sqrt((m // 1048576)::DOUBLE), 6) AS metres FROM m"),
)
def distance_from_corner(spark: SparkSession, folder: str) -> DataFrame:
    """Metres to truth of one corner of the grid, which is far for most cells."""
    t = A.truth(spark, folder).filter("row < 24 AND col >= 200")
    return distance.distances(A.cells(spark, folder), t, "metres", 100.0, 64).withColumn("metres", F.round("metres", 6))


@register(
    "edge_distance",
    A.sql(
        "cells",
        """,
g AS (SELECT r.range AS row, c.range AS col FROM range(256) r, range(256) c),
f AS (SELECT row, col FROM cells WHERE n >= 2 OR row < 128),
o AS (SELECT * FROM g ANTI JOIN f USING (row, col)),
m AS ("""
        + _ALL.format(cells="f", sources="o")
        + ")\nSELECT f.row, f.col, round(sqrt((m // 1048576)::DOUBLE), 6) AS distance FROM f LEFT JOIN m ON m.row = f.row AND m.col = f.col",
    ),
)
def edge_distance(spark: SparkSession, folder: str) -> DataFrame:
    """How deep each cell of a footprint lies in it, in cells of a grid of 256 x 256; null where the footprint fills the grid."""
    return distance.edge_distances(A.cells(spark, folder).filter("n >= 2 OR row < 128"), 256, 256).withColumn("distance", F.round("distance", 6))


@register(
    "emission_domain",
    A.sql(
        "cells truth",
        """,
g AS (SELECT r.range AS row, c.range AS col FROM range(256) r, range(256) c),
o AS (SELECT * FROM g ANTI JOIN cells USING (row, col)),
t AS (SELECT row, col FROM truth WHERE row % 8 = 0 AND col % 8 = 0),
e AS (SELECT row, col FROM cells WHERE NOT EXISTS (SELECT 1 FROM o WHERE abs(o.row - cells.row) <= 1 AND abs(o.col - cells.col) <= 1 AND (o.row - cells.row) * (o.row - cells.row) + (o.col - cells.col) * (o.col - cells.col) <= 2))
SELECT row, col FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE (t.row - e.row) * (t.row - e.row) + (t.col - e.col) * (t.col - e.col) <= 4)""",
    ),
)
def emission_domain(spark: SparkSession, folder: str) -> DataFrame:
    """Cells over two cells from a thinned catalogue and over the root of two from what is outside of the footprint."""
    cells, listed = A.cells(spark, folder).select("row", "col"), A.truth(spark, folder).filter("row % 8 = 0 AND col % 8 = 0")
    near, deep = distance.nearest(cells, listed), distance.nearest(cells, distance.border(cells, 256, 256))
    keep = lambda t, least: t.filter(F.col("squared").isNull() | (F.col("squared") > least)).select("row", "col")
    return keep(near, 4).join(keep(deep, 2), ["row", "col"])

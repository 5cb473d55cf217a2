"""Queries through raster files that are written from the given tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.plans import adapters as A
from terrastrat.plans.registry import register
from terrastrat.session import shared_folder
from terrastrat.sources import raster

GRID = raster.Grid(256, 256, (100.0, 0.0, 243350.0, 0.0, -100.0, 4508550.0), 32611)


def _file(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}.tif"


@register("raster_window", A.sql("cells", "SELECT row, col, b1, b2 FROM cells WHERE row >= 40 AND row < 100 AND col > 127"))
def raster_window(spark: SparkSession, folder: str) -> DataFrame:
    """A window of a file of two bands, of which only the tiles inside are read."""
    path = _file(spark)
    raster.write_raster(A.cells(spark, folder), path, GRID, ["b1", "b2"], "f8", tile=64, predictor=3)
    return raster.read_raster(spark, path, like=GRID).filter("row >= 40 AND row < 100 AND col > 127")


@register(
    "raster_layers",
    A.sql(
        "cells truth",
        """,
q AS (SELECT row, col, 1 + (n * 7) % 255 AS q FROM cells WHERE n > 1)
SELECT c.row, c.col, c.b1 AS price, q.q::DOUBLE AS code, CASE WHEN t.row IS NULL THEN 0 ELSE 1 END::DOUBLE AS label
FROM cells c LEFT JOIN q USING (row, col) LEFT JOIN truth t USING (row, col)""",
    ),
)
def raster_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Three files of unlike types read as layers of one grid."""
    prices, codes, labels = (_file(spark) for _ in range(3))
    cells = A.cells(spark, folder)
    raster.write_raster(cells, prices, GRID, ["b1"], "f8", compression="none", tile=128)
    raster.write_raster(cells.filter("n > 1").select("row", "col", (1 + (F.col("n") * 7) % 255).alias("q")), codes, GRID, ["q"], "u1", nodata=0, tile=96, predictor=2)
    marked = cells.select("row", "col").join(A.truth(spark, folder).withColumn("label", F.lit(1)), ["row", "col"], "left").fillna(0, ["label"])
    raster.write_raster(marked, labels, GRID, ["label"], "i2", nodata=-1, tile=64)
    return raster.read_layers(spark, {"price": (prices, 1), "code": (codes, 1), "label": (labels, 1)}, GRID)


@register(
    "raster_quantised",
    A.sql("cells", "SELECT row, col, round(-2 + ((n * 7) % 255)::DOUBLE / 254 * 5, 6) AS value FROM cells WHERE n > 1"),
)
def raster_quantised(spark: SparkSession, folder: str) -> DataFrame:
    """A band of bytes decoded by the range that its tags give."""
    path = _file(spark)
    q = A.cells(spark, folder).filter("n > 1").select("row", "col", (1 + (F.col("n") * 7) % 255).alias("q"))
    raster.write_raster(q, path, GRID, ["q"], "u1", nodata=0, tags={1: {"q_lo": "-2.0", "q_hi": "3.0"}})
    return raster.read_quantised(spark, path, 1, GRID).withColumn("value", F.round("value", 6))


@register(
    "raster_labels",
    A.sql(
        "cells truth pred",
        """
SELECT (SELECT count(*) FROM cells)::BIGINT AS valid, (SELECT count(*) FROM truth SEMI JOIN cells USING (row, col))::BIGINT AS positive,
  (SELECT count(*) FROM pred SEMI JOIN cells USING (row, col) WHERE p > 0)::BIGINT AS predicted, (SELECT round(sum(p), 4) FROM pred SEMI JOIN cells USING (row, col)) AS mass""",
    ),
)
def raster_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels and a prediction on a template's cells, read with all checks."""
    template, truth, prediction = (_file(spark) for _ in range(3))
    cells = A.cells(spark, folder).select("row", "col")
    raster.write_raster(cells.withColumn("v", F.lit(1.0)), template, GRID, ["v"])
    marked = cells.join(A.truth(spark, folder).withColumn("label", F.lit(1)), ["row", "col"], "left").fillna(0, ["label"])
    raster.write_raster(marked, truth, GRID, ["label"], "u1", nodata=255)
    raster.write_raster(cells.join(A.pred(spark, folder), ["row", "col"], "left").fillna(0.0, ["p"]), prediction, GRID, ["p"], "f8", predictor=3)
    labels, support = raster.read_labels(spark, truth, template), raster.read_support(spark, prediction, template)
    counts = labels.agg(F.count("*").alias("valid"), F.sum("label").cast("long").alias("positive"))
    return counts.crossJoin(support.agg(F.count("*").alias("predicted"), F.round(F.sum("p"), 4).alias("mass")))

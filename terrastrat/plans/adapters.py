"""Views of the standard tables as points, cells, truth, predictions and artifacts, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.functions.expressions import krueger
from terrastrat.sources.tables import table

_SQL = {
    "pts": """pts AS (SELECT event_id AS id, (user_id * 97 + event_id * 31) % 4096 AS x, (event_id * 57 + user_id * 13) % 4096 AS y,
  epoch_us(ts) AS t_us, value AS mag, event_type AS kind FROM events)""",
    "cells": """cells AS (SELECT l_partkey % 256 AS row, (l_suppkey * 7 + l_orderkey) % 256 AS col, round(avg(l_extendedprice), 6) AS b1,
  round(avg(l_quantity), 6) AS b2, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2)""",
    "truth": """truth AS (SELECT DISTINCT l_partkey % 256 AS row, (l_suppkey * 7 + l_orderkey) % 256 AS col FROM lineitem
  WHERE l_returnflag = 'R' AND l_linenumber = 1)""",
    "pred": """pred AS (SELECT l_partkey % 256 AS row, (l_suppkey * 7 + l_orderkey) % 256 AS col, least(max(l_discount) * 10, 1.0::DOUBLE) AS p
  FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 2 GROUP BY 1, 2)""",
    "artifacts": """artifacts AS (SELECT DISTINCT l_linenumber::BIGINT AS a, l_partkey % 256 AS row, (l_suppkey * 7 + l_orderkey) % 256 AS col FROM lineitem)""",
    "kern": """kern AS (SELECT i::BIGINT AS i, j::BIGINT AS j, 1 - sqrt((i * i + j * j)::DOUBLE) / 3 AS k
  FROM range(-3, 4) a(i), range(-3, 4) b(j) WHERE i * i + j * j < 9)""",
}


def sql(views: str, body: str) -> str:
    """*body* after the named views; further views may open *body* with a comma."""
    return "WITH " + ",\n".join(_SQL[v] for v in views.split()) + "\n" + body


def unit_sql(seed: int, *columns: str) -> str:
    """As functions.expressions.unit_hash, in SQL."""
    text = " || ':' || ".join([f"'{seed}'", *[f"({c})::VARCHAR" for c in columns]])
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE)"


def utm_sql(lon: str, lat: str, central: float = -117.0) -> tuple[str, str, str, str]:
    """SQL of a projection in three steps: columns (t, l) from places, (xi, eta) from those, then east and north."""
    e, radius, alpha = krueger()
    phi = f"radians({lat})"
    first = f"sinh(atanh(sin({phi})) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin({phi}))) AS t, radians({lon} - ({central!r}::DOUBLE)) AS l"
    second = "atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta"
    north = "xi" + "".join(f" + {c!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(alpha, 1))
    east = "eta" + "".join(f" + {c!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(alpha, 1))
    return first, second, f"500000.0::DOUBLE + {radius!r}::DOUBLE * ({east})", f"{radius!r}::DOUBLE * ({north})"


def pts(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("id"),
        ((F.col("user_id") * 97 + F.col("event_id") * 31) % 4096).alias("x"),
        ((F.col("event_id") * 57 + F.col("user_id") * 13) % 4096).alias("y"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        F.col("value").alias("mag"),
        F.col("event_type").alias("kind"),
    )


def _cell() -> list:
    return [(F.col("l_partkey") % 256).alias("row"), ((F.col("l_suppkey") * 7 + F.col("l_orderkey")) % 256).alias("col")]


def cells(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return li.groupBy(*_cell()).agg(F.round(F.avg("l_extendedprice"), 6).alias("b1"), F.round(F.avg("l_quantity"), 6).alias("b2"), F.count("*").alias("n"))


def truth(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return li.filter((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).select(*_cell()).distinct()


def pred(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").filter((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 2))
    return li.groupBy(*_cell()).agg(F.least(F.max("l_discount") * 10, F.lit(1.0)).alias("p"))


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_linenumber").cast("long").alias("a"), *_cell()).distinct()

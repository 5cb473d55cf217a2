"""Queries of wide windows and of posteriors without one artifact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.operators import kernels, windows
from terrastrat.plans import adapters as A
from terrastrat.plans.registry import register

SIZES = [9, 21, 51, 101]


def _boxes(sizes: list[int]) -> str:
    """Views g (the filled box), a (sums along rows) and m (means)."""
    along = lambda c, k, order: f"sum({c}) OVER (PARTITION BY {order[0]} ORDER BY {order[1]} RANGE BETWEEN {k // 2} PRECEDING AND {k // 2} FOLLOWING)"
    first = ", ".join(f"{along('v', k, ('row', 'col'))} AS v{k}, {along('n', k, ('row', 'col'))} AS n{k}" for k in sizes)
    second = ", ".join(f"{along(f'v{k}', k, ('col', 'row'))} / {along(f'n{k}', k, ('col', 'row'))} AS m{k}" for k in sizes)
    return f""",
g AS (SELECT r.row, c.range AS col, coalesce(b2, 0) AS v, (b2 IS NOT NULL)::BIGINT AS n FROM (SELECT DISTINCT row FROM cells) r CROSS JOIN range(256) c LEFT JOIN cells ON cells.row = r.row AND cells.col = c.range),
a AS (SELECT row, col, {first} FROM g),
m AS (SELECT row, col, {second} FROM a)"""


@register("box_means", A.sql("cells", _boxes(SIZES) + "\nSELECT row, col, " + ", ".join(f"round(m{k} + 1e-8::DOUBLE, 6) AS m{k}" for k in SIZES) + " FROM m SEMI JOIN cells USING (row, col)"))
def box_means(spark: SparkSession, folder: str) -> DataFrame:
    """Means over windows of 9 to 101 cells a side, all by two sorts."""
    got = windows.box_means(A.cells(spark, folder), "b2", SIZES)
    return got.select("row", "col", *[F.round(F.col(f"m{k}") + 1e-8, 6).alias(f"m{k}") for k in SIZES])


@register(
    "lowpass_ladder",
    A.sql(
        "cells truth kern",
        _boxes(SIZES)
        + """,
k AS (SELECT t.row + i AS row, t.col + j AS col, max(k) AS credit FROM truth t, kern GROUP BY 1, 2),
x AS (SELECT c.row, c.col, round(c.b2, 6) AS m1, """
        + ", ".join(f"round(m{k}, 6) AS m{k}" for k in SIZES)
        + """, coalesce(credit, 0) AS credit FROM cells c JOIN m USING (row, col) LEFT JOIN k USING (row, col)),
u AS (UNPIVOT x ON m1, m9, m21, m51, m101 INTO NAME name VALUE v),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY v DESC, row, col) AS rn FROM u)
SELECT name, count(*)::BIGINT AS n, round(avg(credit), 6) AS c_per_dot FROM r WHERE rn <= 500 GROUP BY name""",
    ),
)
def lowpass_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """Credit of a field's 500 highest cells, before and after it is smoothed over wider and wider boxes."""
    cells = A.cells(spark, folder)
    credit = kernels.spread(A.truth(spark, folder), kernels.disc(), []).groupBy("row", "col").agg(F.max("k").alias("credit"))
    means = windows.box_means(cells, "b2", SIZES)
    rows = cells.select("row", "col", F.round("b2", 6).alias("m1")).join(means, ["row", "col"]).join(credit, ["row", "col"], "left")
    rows = rows.select("row", "col", "m1", *[F.round(f"m{k}", 6).alias(f"m{k}") for k in SIZES], F.coalesce("credit", F.lit(0.0)).alias("credit"))
    got = windows.top_credit_ladder(rows, ["m1", *[f"m{k}" for k in SIZES]], F.col("credit"), 500)
    return got.withColumn("c_per_dot", F.round("c_per_dot", 6))


@register(
    "leave_one_out_posterior",
    A.sql(
        "artifacts truth kern",
        """,
s AS (SELECT a, count(*)::BIGINT AS n, round(count(t.row)::DOUBLE / count(*), 6) AS score FROM artifacts LEFT JOIN truth t USING (row, col) GROUP BY a),
f AS (SELECT a, row + i AS row, col + j AS col, sum(k) AS s, max(k) AS c FROM artifacts, kern GROUP BY 1, 2, 3),
p AS (SELECT i.a AS i, f.row, f.col, sum(exp((s.score - (SELECT max(score) FROM s)) / 0.05::DOUBLE) * f.s) AS q FROM s i JOIN s ON s.a <> i.a JOIN f ON f.a = s.a GROUP BY 1, 2, 3),
z AS (SELECT i, sum(q) AS z FROM p GROUP BY i),
m AS (SELECT p.i AS a, 5000 * sum(q * c) / any_value(z) AS t, 5000 * sum(q * s) / any_value(z) AS mp FROM p JOIN z USING (i) JOIN f ON f.a = p.i AND f.row = p.row AND f.col = p.col GROUP BY p.i)
SELECT s.a, s.n, s.score, round(t / (0.2::DOUBLE * (s.n - mp + t) + 0.8::DOUBLE * 5000), 6) AS predicted FROM s JOIN m USING (a)""",
    ),
)
def leave_one_out_posterior(spark: SparkSession, folder: str) -> DataFrame:
    """Every artifact's score predicted by the posterior that the others give; the SQL builds each posterior apart."""
    dots, t = A.artifacts(spark, folder), A.truth(spark, folder).withColumn("_t", F.lit(1))
    scores = dots.join(t, ["row", "col"], "left").groupBy("a").agg(F.round(F.count("_t") / F.count("*"), 6).alias("score"))
    got = windows.leave_one_out(dots, scores, 0.05, 5000.0)
    return got.withColumn("predicted", F.round("predicted", 6))

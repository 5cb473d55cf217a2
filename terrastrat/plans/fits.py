"""Queries that fit, rank and decide."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.functions.expressions import tversky, unit_hash
from terrastrat.operators import fit, learn, sequential, spatial
from terrastrat.operators.kernels import gather
from terrastrat.operators.ranking import numbered
from terrastrat.plans import adapters as A
from terrastrat.plans.registry import register
from terrastrat.sources.tables import table


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with a binary label and a score."""
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("label") % 2).cast("long").alias("y"), F.round(F.col("embedding")[0].cast("double"), 6).alias("s"), F.round(F.col("embedding")[1].cast("double"), 6).alias("t"))


_SCORED = ",\n".join(["WITH v AS (SELECT vec_id AS id, (label % 2)::BIGINT AS y, round(embedding[1]::DOUBLE, 6) AS s, round(embedding[2]::DOUBLE, 6) AS t FROM embeddings)"])


@register(
    "auc_rank",
    _SCORED + """,
r AS (SELECT y, row_number() OVER (ORDER BY s, id) AS rn FROM v)
SELECT count(*) FILTER (y = 1)::BIGINT AS positives, count(*) FILTER (y <> 1)::BIGINT AS negatives,
  round((sum(rn) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)::DOUBLE / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1)), 6) AS auc FROM r""",
)
def auc_rank(spark: SparkSession, folder: str) -> DataFrame:
    return fit.auc(_scored(spark, folder), "y", "s", ["id"])


@register(
    "spearman",
    A.sql(
        "cells",
        """,
r AS (SELECT rank() OVER (ORDER BY b1) + (count(*) OVER (PARTITION BY b1) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b2) + (count(*) OVER (PARTITION BY b2) - 1) / 2.0::DOUBLE AS rb FROM cells)
SELECT count(*)::BIGINT AS n, round(corr(ra, rb), 6) AS rho FROM r""",
    ),
)
def spearman(spark: SparkSession, folder: str) -> DataFrame:
    return fit.spearman(A.cells(spark, folder), "b1", "b2", ["row", "col"])


@register(
    "ols_calibration",
    A.sql(
        "cells",
        """SELECT count(*)::BIGINT AS n, round(regr_intercept(b1, b2), 4) AS intercept, round(regr_slope(b1, b2), 5) AS slope, round(regr_r2(b1, b2), 6) AS r2 FROM cells""",
    ),
)
def ols_calibration(spark: SparkSession, folder: str) -> DataFrame:
    got = fit.ols(A.cells(spark, folder), [F.lit(1.0), F.col("b2")], F.col("b1"))
    return spark.createDataFrame([(got["n"], round(float(got["beta"][0]), 4), round(float(got["beta"][1]), 5), round(float(got["r2"]), 6))], "n long, intercept double, slope double, r2 double")


@register("uncertainty_calibration")
def uncertainty_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Log error on four logged or plain features, fitted outside a zone and judged inside; coefficients with errors."""
    p = A.pts(spark, folder).dropna(subset=["mag"])
    design = [F.lit(1.0), F.log10(F.greatest(F.col("x"), F.lit(1)).cast("double")), F.log10(F.greatest(F.col("y"), F.lit(1)).cast("double")), F.least(F.col("t_us") / 86400e6 % 30, F.lit(30.0))]
    target = F.log10(F.greatest("mag", F.lit(0.01)))
    got = fit.ols(p.filter("x >= 1024"), design, target)
    guess = sum((float(b) * d for b, d in zip(got["beta"], design, strict=True)), F.lit(0.0))
    inside = p.filter("x < 1024").agg(F.avg((F.abs(guess - target) <= float(np.log10(2))).cast("double")).alias("within_2x"), F.sqrt(F.avg(F.pow(guess - target, F.lit(2.0)))).alias("rmse"))
    rows = spark.createDataFrame([(i, float(b), float(s)) for i, (b, s) in enumerate(zip(got["beta"], got["se"], strict=True))], "term long, beta double, se double")
    return rows.join(F.broadcast(inside))


@register(
    "probability_bisection",
    A.sql(
        "cells",
        """,
o AS (SELECT row, col, b1, row_number() OVER (ORDER BY b1 DESC, row, col) - 1 AS capped, sum(b1) OVER (ORDER BY b1, row DESC, col DESC ROWS UNBOUNDED PRECEDING) AS rest FROM cells WHERE b1 > 0),
f AS (SELECT coalesce(max(greatest(5000 - capped, 0) / rest) FILTER (greatest(5000 - capped, 0) / rest * b1 < 1), 1e300) AS factor FROM o)
SELECT row, col, round(least(b1 * factor, 1), 9) AS p FROM cells, f""",
    ),
)
def probability_bisection(spark: SparkSession, folder: str) -> DataFrame:
    """Capped probabilities that sum to a given truth mass."""
    c = A.cells(spark, folder)
    factor = fit.capped_scale(c, "b1", 5000.0)
    return c.select("row", "col", F.round(F.least(F.col("b1") * factor, F.lit(1.0)), 9).alias("p"))


@register(
    "metric_inversion",
    A.sql(
        "truth",
        """,
f AS (SELECT row // 64 * 4 + col // 64 AS fold, count(*)::DOUBLE AS g FROM truth GROUP BY 1),
s AS (SELECT fold, g, 100 + 10.0::DOUBLE * fold AS n1, 0.1::DOUBLE + fold / 100.0::DOUBLE AS s1, 200 + 10.0::DOUBLE * fold AS n2, 0.15::DOUBLE + fold / 100.0::DOUBLE AS s2 FROM f)
SELECT fold, round(s1 * (0.2::DOUBLE * n1 + 0.8::DOUBLE * g), 6) AS credit, round((s1 * g - 0.8::DOUBLE * s1 * g) / (0.2::DOUBLE * s1), 6) AS n_if_full,
  round((0.2::DOUBLE * (n2 * s2 - n1 * s1)) / nullif(0.8::DOUBLE * (s1 - s2), 0), 6) AS truth_if_equal_credit FROM s""",
    ),
)
def metric_inversion(spark: SparkSession, folder: str) -> DataFrame:
    """What scores and sizes imply: credit, size at full credit, and truth mass if two scores share one credit."""
    g = A.truth(spark, folder).groupBy(F.expr("row div 64 * 4 + col div 64").alias("fold")).agg(F.count("*").cast("double").alias("g"))
    c = F.col
    s = g.select("fold", "g", (100 + 10.0 * c("fold")).alias("n1"), (0.1 + c("fold") / 100.0).alias("s1"), (200 + 10.0 * c("fold")).alias("n2"), (0.15 + c("fold") / 100.0).alias("s2"))
    return s.select(
        "fold",
        F.round(c("s1") * (0.2 * c("n1") + 0.8 * c("g")), 6).alias("credit"),
        F.round((c("s1") * c("g") - 0.8 * c("s1") * c("g")) / (0.2 * c("s1")), 6).alias("n_if_full"),
        F.round(F.try_divide(0.2 * (c("n2") * c("s2") - c("n1") * c("s1")), 0.8 * (c("s1") - c("s2"))), 6).alias("truth_if_equal_credit"),
    )


@register(
    "gate_decision",
    A.sql(
        "truth pred kern",
        """,
sh AS (SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT), (1, 20), (2, -20)) v(arm, dc)),
arm AS (SELECT arm, row, col + dc AS col, p FROM pred, sh WHERE col + dc BETWEEN 0 AND 255),
credit AS (SELECT arm, p.row + i AS row, p.col + j AS col, max(p.p * k) AS credit FROM arm p, kern GROUP BY 1, 2, 3),
cover AS (SELECT t.row + i AS row, t.col + j AS col, max(k) AS cover FROM truth t, kern GROUP BY 1, 2),
tp AS (SELECT a.arm, sum(coalesce(credit, 0)) AS tp, count(*) AS g FROM (SELECT DISTINCT arm FROM arm) a CROSS JOIN truth t LEFT JOIN credit c ON c.arm = a.arm AND c.row = t.row AND c.col = t.col GROUP BY 1),
fp AS (SELECT arm, sum(p * (1 - coalesce(cover, 0))) AS fp, count(*) AS n FROM arm LEFT JOIN cover USING (row, col) GROUP BY 1),
s AS (SELECT arm, tp / (tp + 0.2::DOUBLE * fp + 0.8::DOUBLE * (g - tp) + 1e-9::DOUBLE) AS s, n FROM tp JOIN fp USING (arm)),
x AS (SELECT max(s) FILTER (arm = 0) AS s0, max(s) FILTER (arm > 0) AS s1, max(n) FILTER (arm = 0) AS n FROM s)
SELECT round(s0, 6) AS score, round(s1, 6) AS best_control, s0 > s1 AS beats_controls, n <= 5000 AS within_budget, s0 > s1 AND n <= 5000 AS passed FROM x""",
    ),
)
def gate_decision(spark: SparkSession, folder: str) -> DataFrame:
    """A candidate against moved controls under a budget: every condition and the verdict."""
    from terrastrat.operators import metric

    arms = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("arm"), F.lit(c).alias("dc")) for i, c in ((0, 0), (1, 20), (2, -20))]))
    moved = A.pred(spark, folder).withColumn("_a", arms).select(F.col("_a.arm").alias("arm"), "row", (F.col("col") + F.col("_a.dc")).alias("col"), "p").filter("col BETWEEN 0 AND 255")
    rows = metric.contributions(A.truth(spark, folder), moved, keys=["arm"])
    s = rows.groupBy("arm").agg(tversky(F.sum("tp"), F.sum("fp"), F.sum("g") - F.sum("tp")).alias("s"), F.sum("n").alias("n"))
    own, control, n = F.max(F.when(F.col("arm") == 0, F.col("s"))), F.max(F.when(F.col("arm") > 0, F.col("s"))), F.max(F.when(F.col("arm") == 0, F.col("n")))
    return s.agg(F.round(own, 6).alias("score"), F.round(control, 6).alias("best_control"), (own > control).alias("beats_controls"), (n <= 5000).alias("within_budget"), ((own > control) & (n <= 5000)).alias("passed"))


@register(
    "ecdf_excess_scale",
    A.sql(
        "pts",
        f""",
q AS (SELECT id, floor({A.unit_sql(21, "id")} * 4096)::BIGINT AS x, floor({A.unit_sql(22, "id")} * 4096)::BIGINT AS y FROM pts),
near AS (SELECT 'o' AS w, min(sqrt(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE)) AS d FROM pts a JOIN pts b ON a.id <> b.id AND abs(a.x - b.x) <= 700 AND abs(a.y - b.y) <= 700 GROUP BY a.id
  UNION ALL SELECT 'n', min(sqrt(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE)) FROM q a JOIN q b ON a.id <> b.id AND abs(a.x - b.x) <= 700 AND abs(a.y - b.y) <= 700 GROUP BY a.id),
s AS (SELECT step::DOUBLE AS step, avg((d <= step)::INT) FILTER (w = 'o') AS observed, avg((d <= step)::INT) FILTER (w = 'n') AS expected FROM near, range(2, 80, 2) t(step) GROUP BY 1)
SELECT step, round(observed, 9) AS observed, round(expected, 9) AS expected, (SELECT max(step) FROM s WHERE observed - expected > 0.05::DOUBLE) AS scale FROM s""",
    ),
)
def ecdf_excess_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-neighbour distances against those of as many points dealt over the box by hash."""
    p = A.pts(spark, folder).select("id", "x", "y")
    null = p.select("id", F.floor(unit_hash(F.col("id"), seed=21) * 4096).cast("long").alias("x"), F.floor(unit_hash(F.col("id"), seed=22) * 4096).cast("long").alias("y"))
    return fit.ecdf_excess(spatial.knn(p, 1), spatial.knn(null, 1), "d", [float(s) for s in range(2, 80, 2)]).withColumns({c: F.round(c, 9) for c in ("observed", "expected")})


@register("viterbi_snap")
def viterbi_snap(spark: SparkSession, folder: str) -> DataFrame:
    """For every strip of 16 rows, the path along the columns of the most reward with steps of two at most."""
    c = A.cells(spark, folder).select(F.expr("row div 16").alias("strip"), F.col("col").alias("station"), (F.col("row") % 16).alias("lane"), (F.col("b2") / 50).alias("reward"))
    return sequential.best_paths(c, "strip", lanes=16, penalty=0.08)


@register("flow_accumulation")
def flow_accumulation(spark: SparkSession, folder: str) -> DataFrame:
    """Steepest descent and upstream area over the whole grid, after filling depressions."""
    return sequential.drainage(A.cells(spark, folder).select("row", "col", F.col("b1").alias("z")), 64)


_STEEP = """,
nb AS (SELECT * FROM (VALUES (0::BIGINT, -1::BIGINT, 0::BIGINT), (1, 1, 0), (2, 0, -1), (3, 0, 1), (4, -1, -1), (5, -1, 1), (6, 1, -1), (7, 1, 1)) v(d, i, j)),
st AS (SELECT c.row, c.col, any_value(c.n) AS area, arg_max(d, {'s': (c.b1 - m.b1) / sqrt((i * i + j * j)::DOUBLE), 'd': -d}) FILTER (m.b1 < c.b1) AS d FROM cells c CROSS JOIN nb LEFT JOIN cells m ON m.row = c.row + i AND m.col = c.col + j GROUP BY 1, 2),
ch AS (SELECT s.row, s.col, cos(coalesce(atan2(-i::DOUBLE, j::DOUBLE), 0)) AS u, sin(coalesce(atan2(-i::DOUBLE, j::DOUBLE), 0)) AS v FROM st s LEFT JOIN nb USING (d) WHERE area >= 2)
SELECT a.row, a.col, round(CASE WHEN count(*) >= 5 THEN 1 - sqrt(pow(sum(b.u), 2) + pow(sum(b.v), 2)) / count(*) ELSE 0 END + 1e-8::DOUBLE, 6) AS deflection FROM ch a JOIN ch b ON b.row BETWEEN a.row - 3 AND a.row + 3 AND b.col BETWEEN a.col - 3 AND a.col + 3 GROUP BY 1, 2"""


@register("channel_deflection", A.sql("cells", _STEEP))
def channel_deflection(spark: SparkSession, folder: str) -> DataFrame:
    """How far channels around a cell turn from each other; here channels are cells of two rows or more, draining to the steepest neighbour."""
    c = A.cells(spark, folder)
    table = [(i, j, float(d)) for d, (i, j) in enumerate(sequential.NEIGHBOURS)]
    near = gather(c, table, [F.collect_list(F.struct("k", F.col("b1").alias("m"))).alias("near")], ["b1"], within=c.select("row", "col"))
    slope = lambda x: (F.col("b1") - x["m"]) / F.when(x["k"] < 4, 1.0).otherwise(math.sqrt(2))
    best = F.array_max(F.transform(F.filter("near", lambda x: x["m"] < F.col("b1")), lambda x: F.struct(slope(x).alias("s"), (-x["k"]).alias("d"))))
    flow = c.join(near, ["row", "col"]).select("row", "col", F.coalesce(-best["d"], F.lit(-1.0)).cast("long").alias("direction"), F.col("n").alias("area"))
    return sequential.deflection(flow, 2).select("row", "col", F.round(F.col("deflection") + 1e-8, 6).alias("deflection"))


@register("thinned_mask")
def thinned_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Truth thinned to lines of one cell."""
    return sequential.thin(A.truth(spark, folder))


@register("gbt_blocked_cv")
def gbt_blocked_cv(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees trained on all but one spatial fold and judged on it, for each of four folds."""
    return learn.blocked(spark, _examples(spark, folder), ["b1", "b2", "n", "near"])


@register("permutation_importance")
def permutation_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Loss of AUC on a held-out fold when one feature is dealt anew."""
    return learn.importance(spark, _examples(spark, folder), ["b1", "b2", "n", "near"])


def _examples(spark: SparkSession, folder: str) -> DataFrame:
    """Cells with features, fold and whether they hold truth."""
    from terrastrat.operators import metric

    t = A.truth(spark, folder).withColumn("y", F.lit(1.0))
    near = metric.best_credit(A.pred(spark, folder)).withColumnRenamed("credit", "near")
    c = A.cells(spark, folder).join(t, ["row", "col"], "left").join(near, ["row", "col"], "left").fillna(0.0, ["y", "near"])
    return c.withColumn("fold", F.expr("CAST(CASE WHEN row < 128 THEN 0 ELSE 2 END + CASE WHEN col < 128 THEN 0 ELSE 1 END AS BIGINT)")).withColumn("n", F.col("n").cast("double"))


@register("plane_fit_3d")
def plane_fit_3d(spark: SparkSession, folder: str) -> DataFrame:
    """Trimmed planes through each bucket's points in space: normal, thickness and inliers."""
    p = A.pts(spark, folder).dropna(subset=["mag"])
    return sequential.planes(p.select(F.expr("(x div 512) * 8 + y div 512").alias("bucket"), "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("mag").alias("z")))

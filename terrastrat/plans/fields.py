"""Queries over gridded fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.functions.expressions import clip
from terrastrat.operators import fields, kernels, ranking
from terrastrat.plans import adapters as A
from terrastrat.plans.registry import register


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"{x}::BIGINT" if isinstance(x, int) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows) + ")"


def _rounded(v):
    """Six digits, off the ties that means of rounded values often fall on."""
    return F.round(v + 1e-8, 6)


_G2, _G15 = _values(kernels.gauss(2.0)), _values(kernels.gauss(1.5))


@register(
    "density_gaussian",
    A.sql(
        "pts",
        f""",
w AS (SELECT * FROM {_G2} v(i, k)),
c AS (SELECT y // 16 AS row, x // 16 AS col, count(*)::DOUBLE AS v FROM pts GROUP BY 1, 2),
a AS (SELECT row + i AS row, col, sum(v * k) AS v FROM c, w GROUP BY 1, 2),
b AS (SELECT row, col + i AS col, sum(v * k) AS v FROM a, w GROUP BY 1, 2)
SELECT row, col, round(v / (SELECT max(v) FROM b), 6) AS density FROM b WHERE row BETWEEN 0 AND 255 AND col BETWEEN 0 AND 255""",
    ),
)
def density_gaussian(spark: SparkSession, folder: str) -> DataFrame:
    """Smoothed event counts as a share of their maximum."""
    c = A.pts(spark, folder).groupBy(F.expr("y div 16").alias("row"), F.expr("x div 16").alias("col")).agg(F.count("*").cast("double").alias("v"))
    d = kernels.separable(c, "v", kernels.gauss(2.0), kernels.gauss(2.0), "density")
    top = d.agg(F.max("density").alias("top"))
    d = d.filter("row BETWEEN 0 AND 255 AND col BETWEEN 0 AND 255").join(F.broadcast(top))
    return d.select("row", "col", F.round(F.col("density") / F.col("top"), 6).alias("density"))


_SOBEL = f"""sob AS (SELECT * FROM {_values([(-i, -j, w, 0.0) for i, j, w in fields.SOBEL] + [(-j, -i, 0.0, w) for i, j, w in fields.SOBEL])} v(i, j, kx, ky)),
grad AS (SELECT c.row, c.col, coalesce(sum(n.b2 * kx), 0) AS gx, coalesce(sum(n.b2 * ky), 0) AS gy FROM cells c CROSS JOIN sob LEFT JOIN cells n ON n.row = c.row - i AND n.col = c.col - j GROUP BY 1, 2)"""


@register("gradient_magnitude", A.sql("cells", f",\n{_SOBEL}\nSELECT row, col, round(sqrt(gx * gx + gy * gy), 5) AS gradient FROM grad"))
def gradient_magnitude(spark: SparkSession, folder: str) -> DataFrame:
    g = fields.gradient(A.cells(spark, folder), "b2")
    return g.select("row", "col", F.round(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), 5).alias("gradient"))


@register(
    "structure_tensor_coherence",
    A.sql(
        "cells",
        f""",
{_SOBEL},
w AS (SELECT * FROM {_G15} v(i, k)),
p AS (SELECT row + i AS row, col, sum(gx * gx * k) AS a, sum(gx * gy * k) AS b, sum(gy * gy * k) AS c FROM grad, w GROUP BY 1, 2),
q AS (SELECT row, col + i AS col, sum(a * k) AS a, sum(b * k) AS b, sum(c * k) AS c FROM p, w GROUP BY 1, 2),
e AS (SELECT row, col, (a + c) / 2 AS m, sqrt(pow((a - c) / 2, 2) + b * b) AS h FROM q JOIN cells USING (row, col))
SELECT row, col, CASE WHEN m = 0 THEN 0 ELSE round(h / m, 5) END AS coherence, CASE WHEN m = 0 THEN 0 ELSE round(h / m * sqrt(m + h), 4) END AS saliency FROM e""",
    ),
)
def structure_tensor_coherence(spark: SparkSession, folder: str) -> DataFrame:
    t = fields.tensor(A.cells(spark, folder), "b2", 1.5)
    return t.select("row", "col", F.round("coherence", 5).alias("coherence"), F.round("saliency", 4).alias("saliency"))


@register(
    "box_residual9",
    A.sql("cells", "SELECT c.row, c.col, round(any_value(c.b2) - avg(n.b2) + 1e-8::DOUBLE, 6) AS residual FROM cells c JOIN cells n ON abs(n.row - c.row) <= 4 AND n.col BETWEEN c.col - 4 AND c.col + 4 GROUP BY 1, 2"),
)
def box_residual9(spark: SparkSession, folder: str) -> DataFrame:
    """Value minus the mean of the 9 x 9 box, existing cells only."""
    c = A.cells(spark, folder)
    m = kernels.gather(c, kernels.square(4), [F.avg("b2").alias("m")], ["b2"])
    return c.join(m, ["row", "col"]).select("row", "col", _rounded(F.col("b2") - F.col("m")).alias("residual"))


@register("nms_local_max", A.sql("cells", "SELECT c.row, c.col, any_value(c.b1) AS v FROM cells c JOIN cells n ON abs(n.row - c.row) <= 2 AND abs(n.col - c.col) <= 2 GROUP BY 1, 2 HAVING any_value(c.b1) >= max(n.b1)"))
def nms_local_max(spark: SparkSession, folder: str) -> DataFrame:
    c = A.cells(spark, folder)
    m = kernels.gather(c, kernels.square(2), [F.max("b1").alias("m")], ["b1"])
    return c.join(m, ["row", "col"]).filter("b1 >= m").select("row", "col", F.col("b1").alias("v"))


_LINES = _values([(a, i, j) for a, p in fields.line_offsets(8, 4).items() for i, j in p])


@register(
    "line_integral",
    A.sql(
        "cells",
        f""",
o AS (SELECT * FROM {_LINES} v(a, i, j)),
m AS (SELECT c.row, c.col, a, avg(n.b2) AS m FROM cells c CROSS JOIN o JOIN cells n ON n.row = c.row + i AND n.col = c.col + j GROUP BY 1, 2, 3)
SELECT p.row, p.col, round(max(abs(p.m - q.m)) + 1e-8::DOUBLE, 6) AS contrast FROM m p JOIN m q ON q.row = p.row AND q.col = p.col AND q.a = p.a + 4 GROUP BY 1, 2""",
    ),
)
def line_integral(spark: SparkSession, folder: str) -> DataFrame:
    """Line means against perpendicular ones."""
    return fields.line_contrast(A.cells(spark, folder), "b2").select("row", "col", _rounded(F.col("contrast")).alias("contrast"))


_STEPS = _values([(a, i, j, w) for a, o in fields.step_kernels(6, 3, 2).items() for i, j, w in o])


@register(
    "matched_step_filter",
    A.sql(
        "cells",
        f""",
o AS (SELECT * FROM {_STEPS} v(a, i, j, w)),
m AS (SELECT c.row, c.col, a, round(abs(sum(n.b2 * w)), 9) AS r FROM cells c CROSS JOIN o JOIN cells n ON n.row = c.row + i AND n.col = c.col + j GROUP BY 1, 2, 3)
SELECT c.row, c.col, round(coalesce(max(r), 0) + 1e-8::DOUBLE, 6) AS response FROM cells c LEFT JOIN m USING (row, col) GROUP BY 1, 2""",
    ),
)
def matched_step_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest oriented step response."""
    return fields.matched_step(A.cells(spark, folder), "b2").select("row", "col", _rounded(F.col("response")).alias("response"))


@register(
    "masked_gaussian",
    A.sql(
        "cells",
        f""",
w AS (SELECT * FROM {_G2} v(i, k)),
a AS (SELECT row + i AS row, col, sum(b2 * k) AS v, sum(k) AS w FROM cells, w GROUP BY 1, 2),
b AS (SELECT row, col + i AS col, sum(v * k) AS v, sum(w * k) AS w FROM a, w GROUP BY 1, 2)
SELECT row, col, round(CASE WHEN w > 0.3::DOUBLE THEN v / w END, 6) AS smooth FROM b JOIN cells USING (row, col)""",
    ),
)
def masked_gaussian(spark: SparkSession, folder: str) -> DataFrame:
    return kernels.masked_gauss(A.cells(spark, folder), "b2", 2.0, "smooth").select("row", "col", F.round("smooth", 6).alias("smooth"))


@register(
    "detrend",
    A.sql(
        "cells",
        f""",
w AS (SELECT * FROM {_G2} v(i, k)),
a AS (SELECT row + i AS row, col, sum(b1 * k) AS v, sum(k) AS w FROM cells, w GROUP BY 1, 2),
b AS (SELECT row, col + i AS col, sum(v * k) AS v, sum(w * k) AS w FROM a, w GROUP BY 1, 2)
SELECT row, col, round(b1 - v / greatest(w, 1e-6::DOUBLE), 4) AS detrended FROM b JOIN cells USING (row, col)""",
    ),
)
def detrend(spark: SparkSession, folder: str) -> DataFrame:
    """Value minus its normalised Gaussian trend."""
    c = A.cells(spark, folder)
    t = kernels.masked_gauss(c, "b1", 2.0, "trend", least=0.0)
    return c.join(t, ["row", "col"]).select("row", "col", F.round(F.col("b1") - F.col("trend"), 4).alias("detrended"))


@register("rank_normalise", A.sql("cells", "SELECT row, col, round((row_number() OVER (ORDER BY b2, row, col) - 1)::DOUBLE / ((SELECT count(*) FROM cells) - 1), 6) AS rank FROM cells"))
def rank_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return fields.rank_normalise(A.cells(spark, folder), "b2", "rank").select("row", "col", F.round("rank", 6).alias("rank"))


@register(
    "percentile_clip_norm",
    A.sql("cells", ",\nq AS (SELECT quantile_cont(b1, 0.01) AS lo, quantile_cont(b1, 0.99) AS hi FROM cells)\nSELECT row, col, round(least(greatest((b1 - lo) / (hi - lo), 0), 1), 6) AS unit FROM cells, q"),
)
def percentile_clip_norm(spark: SparkSession, folder: str) -> DataFrame:
    return fields.clipped(A.cells(spark, folder), "b1", 0.01, 0.99, "unit").select("row", "col", F.round("unit", 6).alias("unit"))


_RANKS = """,
r AS (SELECT *, (row_number() OVER (ORDER BY b1, row, col) - 1)::DOUBLE / ((SELECT count(*) FROM cells) - 1) AS p1, (row_number() OVER (ORDER BY b2, row, col) - 1)::DOUBLE / ((SELECT count(*) FROM cells) - 1) AS p2 FROM cells)"""


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    return fields.rank_normalise(fields.rank_normalise(A.cells(spark, folder), "b1", "p1"), "b2", "p2")


@register("nan_rank_mean_sharpen", A.sql("cells", _RANKS + "\nSELECT row, col, round(pow(CASE WHEN n < 2 THEN p1 ELSE (p1 + p2) / 2 END, 16), 6) AS belief FROM r"))
def nan_rank_mean_sharpen(spark: SparkSession, folder: str) -> DataFrame:
    """Mean rank over the bands that a cell has (the second only where two rows fell), raised to the 16th power."""
    r = _ranked(spark, folder).withColumn("p2", F.when(F.col("n") >= 2, F.col("p2")))
    known = F.array_compact(F.array("p1", "p2"))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return r.select("row", "col", F.round(F.pow(mean, F.lit(16.0)), 6).alias("belief"))


@register("coincidence_count", A.sql("cells", _RANKS + "\nSELECT row, col, round((p1 >= 0.8::DOUBLE)::INT + (p2 >= 0.8::DOUBLE)::INT + 0.5::DOUBLE * (greatest(p1 - 0.8::DOUBLE, 0) + greatest(p2 - 0.8::DOUBLE, 0)) / 2, 6) AS score FROM r"))
def coincidence_count(spark: SparkSession, folder: str) -> DataFrame:
    """Bands over the threshold plus half their mean excess."""
    ps = [F.col("p1"), F.col("p2")]
    score = sum(((p >= 0.8).cast("int") for p in ps), F.lit(0)) + 0.5 * sum((F.greatest(p - 0.8, F.lit(0.0)) for p in ps), F.lit(0.0)) / len(ps)
    return _ranked(spark, folder).select("row", "col", F.round(score, 6).alias("score"))


_FAM = """,
f AS (SELECT row, col, b1 / 100000 AS s1, b2 / 50 AS s2, (n * 37 % 180)::DOUBLE AS a1, (row * 7 + col * 3) % 180 AS a2, (n % 5) / 5.0::DOUBLE AS c1, (col % 4) / 4.0::DOUBLE AS c2 FROM cells),
t AS (SELECT quantile_cont(s1, 0.7) AS t1, quantile_cont(s2, 0.7) AS t2 FROM f),
k AS (SELECT *, s1 >= t1 AS g1, s2 >= t2 AS g2, c1 >= 0.25::DOUBLE AND c2 >= 0.25::DOUBLE AND least(abs(a1 - a2) % 180, 180 - abs(a1 - a2) % 180) > 25 AS against FROM f, t),
n AS (SELECT *, (g1 AND NOT (g2 AND against))::INT + (g2 AND NOT (g1 AND against))::INT AS agree FROM k)"""


def _families(spark: SparkSession, folder: str) -> DataFrame:
    """Two families of strength, angle and coherence made from the cells, with their agreement."""
    f = A.cells(spark, folder).select(
        "row", "col", (F.col("b1") / 100000).alias("s1"), (F.col("b2") / 50).alias("s2"), (F.col("n") * 37 % 180).cast("double").alias("a1"),
        ((F.col("row") * 7 + F.col("col") * 3) % 180).cast("double").alias("a2"), (F.col("n") % 5 / 5.0).alias("c1"), (F.col("col") % 4 / 4.0).alias("c2"),
    )
    t = ranking.percentiles(f, F.col("s1"), [0.7], ["t1"]).crossJoin(ranking.percentiles(f, F.col("s2"), [0.7], ["t2"]))  # one row each
    c = F.col
    return f.join(F.broadcast(t)).withColumn("agree", fields.agreement([c("s1"), c("s2")], [c("a1"), c("a2")], [c("c1"), c("c2")], [c("t1"), c("t2")], 25.0, 0.25))


@register("concordance_count", A.sql("cells", _FAM + "\nSELECT row, col, agree::BIGINT AS agree FROM n"))
def concordance_count(spark: SparkSession, folder: str) -> DataFrame:
    return _families(spark, folder).select("row", "col", F.col("agree").cast("long").alias("agree"))


@register("fuse_bonus", A.sql("cells", _FAM + ",\nz AS (SELECT row, col, greatest(s1, s2) * (1 + 0.5::DOUBLE * least(greatest(agree - 1, 0), 3)) AS v FROM n)\nSELECT row, col, round(v / (SELECT max(v) FROM z), 6) AS fused FROM z"))
def fuse_bonus(spark: SparkSession, folder: str) -> DataFrame:
    v = _families(spark, folder).select("row", "col", fields.fused([F.col("s1"), F.col("s2")], F.col("agree")).alias("v"))
    return v.join(F.broadcast(v.agg(F.max("v").alias("top")))).select("row", "col", F.round(F.col("v") / F.col("top"), 6).alias("fused"))


@register(
    "suppression_ramp",
    A.sql(
        "cells truth",
        """,
o AS (SELECT i::BIGINT AS i, j::BIGINT AS j, sqrt((i * i + j * j)::DOUBLE) AS d FROM range(-6, 7) a(i), range(-6, 7) b(j) WHERE i * i + j * j <= 36),
m AS (SELECT t.row + i AS row, t.col + j AS col, min(d) AS d FROM truth t, o GROUP BY 1, 2)
SELECT row, col, round(0.25::DOUBLE + 0.75::DOUBLE * greatest(least((coalesce(d, 1e9) - 2) / 4, 1), 0), 6) AS factor FROM cells LEFT JOIN m USING (row, col)""",
    ),
)
def suppression_ramp(spark: SparkSession, folder: str) -> DataFrame:
    """A factor that rises from a quarter to one between two and six cells from truth."""
    near = kernels.spread(A.truth(spark, folder), kernels.disc(6.0, weight=lambda d, r: d, keep_zero=True), []).groupBy("row", "col").agg(F.min("k").alias("d"))
    d = F.coalesce("d", F.lit(1e9))
    return A.cells(spark, folder).join(near, ["row", "col"], "left").select("row", "col", F.round(0.25 + 0.75 * clip((d - 2) / 4, 0.0, 1.0), 6).alias("factor"))


@register("block_mean", A.sql("cells", "SELECT row // 10 AS row, col // 10 AS col, round(avg(b1) + 1e-8::DOUBLE, 6) AS mean, count(*)::BIGINT AS n FROM cells GROUP BY 1, 2"))
def block_mean(spark: SparkSession, folder: str) -> DataFrame:
    return A.cells(spark, folder).groupBy(F.expr("row div 10").alias("row"), F.expr("col div 10").alias("col")).agg(_rounded(F.avg("b1")).alias("mean"), F.count("*").alias("n"))


@register(
    "bilinear_sample",
    A.sql(
        "pts cells",
        """,
p AS (SELECT id, y / 16.0::DOUBLE AS fr, x / 16.0::DOUBLE AS fc FROM pts),
k AS (SELECT id, fr - floor(fr) AS dr, fc - floor(fc) AS dc, floor(fr)::BIGINT + i AS row, floor(fc)::BIGINT + j AS col, i, j FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(i, j))
SELECT id, round(CASE WHEN count(b2) = 4 THEN sum(b2 * (CASE WHEN i = 1 THEN dr ELSE 1 - dr END) * (CASE WHEN j = 1 THEN dc ELSE 1 - dc END)) END, 6) AS b2 FROM k LEFT JOIN cells USING (row, col) GROUP BY id""",
    ),
)
def bilinear_sample(spark: SparkSession, folder: str) -> DataFrame:
    p = A.pts(spark, folder).select("id", (F.col("y") / 16.0).alias("fr"), (F.col("x") / 16.0).alias("fc"))
    return fields.bilinear(p, A.cells(spark, folder), "b2").select("id", F.round("b2", 6).alias("b2"))


@register(
    "autocorrelation_lags",
    A.sql(
        "cells",
        """,
m AS (SELECT row, col, b2 - (SELECT avg(b2) FROM cells) AS v FROM cells)
SELECT lag::BIGINT AS lag, count(*)::BIGINT AS n, round(avg(a.v * b.v) / (SELECT avg(v * v) FROM m), 6) AS correlation FROM m a, range(1, 21) t(lag), m b WHERE b.row = a.row AND b.col = a.col + lag GROUP BY 1""",
    ),
)
def autocorrelation_lags(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation along rows at lags of 1 to 20 cells, without wrapping."""
    c = A.cells(spark, folder)
    v = c.join(F.broadcast(c.agg(F.avg("b2").alias("mean")))).select("row", "col", (F.col("b2") - F.col("mean")).alias("v"))
    shifted = v.select("row", "col", F.col("v").alias("w"), F.explode(F.expr("sequence(1L, 20L)")).alias("lag"))
    moved = shifted.select("row", (F.col("col") - F.col("lag")).alias("col"), "w", "lag")
    base = v.agg(F.avg(F.col("v") * F.col("v")).alias("base"))
    return v.join(moved, ["row", "col"]).groupBy("lag").agg(F.count("*").alias("n"), F.avg(F.col("v") * F.col("w")).alias("c")).join(F.broadcast(base)).select("lag", "n", F.round(F.col("c") / F.col("base"), 6).alias("correlation"))

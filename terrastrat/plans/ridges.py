"""Queries over ridges, lines and composed evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.operators import distance, fields, kernels, ridges
from terrastrat.plans import adapters as A
from terrastrat.plans.fields import _rounded, _values
from terrastrat.plans.registry import register


def _smooth(name: str, source: str, value: str, sigma: float, orders: tuple[int, int] = (0, 0)) -> str:
    """Views that end in *name* (row, col, v): the Gaussian of *value* on the cells."""
    rows, cols = (_values([(i, w) for i, w in kernels.gauss(sigma, n)]) for n in orders)
    return f"""{name}_p AS (SELECT row - i AS row, col, sum({value} * k) AS v FROM {source}, {rows} w(i, k) GROUP BY 1, 2),
{name}_q AS (SELECT row, col - i AS col, sum(v * k) AS v FROM {name}_p, {cols} w(i, k) GROUP BY 1, 2),
{name} AS (SELECT row, col, v FROM {name}_q JOIN (SELECT row, col FROM cells) USING (row, col))"""


def _slopes(name: str, source: str) -> str:
    """A view *name* (row, col, gy, gx) of central differences of v, one-sided at missing neighbours."""
    side = lambda a, b: f"(coalesce({a}.v, c.v) - coalesce({b}.v, c.v)) / CASE WHEN {a}.v IS NOT NULL AND {b}.v IS NOT NULL THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
    return f"""{name} AS (SELECT c.row, c.col, {side("s", "n")} AS gy, {side("e", "w")} AS gx FROM {source} c
  LEFT JOIN {source} s ON s.row = c.row + 1 AND s.col = c.col LEFT JOIN {source} n ON n.row = c.row - 1 AND n.col = c.col
  LEFT JOIN {source} e ON e.row = c.row AND e.col = c.col + 1 LEFT JOIN {source} w ON w.row = c.row AND w.col = c.col - 1)"""


def _above(name: str, source: str, half: int = 4) -> str:
    """A view *name* (row, col, g): what lies above the moving median of the square around."""
    return f"""{name}_m AS (SELECT c.row, c.col, any_value(c.g) AS g, quantile_cont(n.g, 0.5) AS m FROM {source} c JOIN {source} n
  ON n.row BETWEEN c.row - {half} AND c.row + {half} AND n.col BETWEEN c.col - {half} AND c.col + {half} GROUP BY 1, 2),
{name} AS (SELECT row, col, greatest(g - m, 0) AS g FROM {name}_m)"""


_HESSIAN = (
    ",\n"
    + ",\n".join(_smooth(n, "cells", "b2", 1.5, o) for n, o in (("xx", (0, 2)), ("xy", (1, 1)), ("yy", (2, 0))))
    + """
SELECT row, col, round(xx.v + 1e-8::DOUBLE, 6) AS gxx, round(xy.v + 1e-8::DOUBLE, 6) AS gxy, round(yy.v + 1e-8::DOUBLE, 6) AS gyy,
  round(greatest(sqrt(pow((xx.v - yy.v) / 2, 2) + xy.v * xy.v) - (xx.v + yy.v) / 2, 0) + 1e-8::DOUBLE, 6) AS ridge
FROM xx JOIN xy USING (row, col) JOIN yy USING (row, col)"""
)


@register("hessian_ridge", A.sql("cells", _HESSIAN))
def hessian_ridge(spark: SparkSession, folder: str) -> DataFrame:
    """Second derivatives and the sharpest crest's strength."""
    h = ridges.hessian(A.cells(spark, folder), "b2", 1.5)
    return h.select("row", "col", *[_rounded(F.col(c)).alias(c) for c in ("gxx", "gxy", "gyy", "ridge")])


@register(
    "fill_nearest",
    A.sql(
        "cells",
        """,
k AS (SELECT row, col, b2 FROM cells WHERE n % 3 <> 0 AND (row % 32 < 9 OR col % 64 = 5)),
u AS (SELECT row, col FROM cells ANTI JOIN k USING (row, col)),
m AS (SELECT u.row, u.col, min(((u.row - k.row) * (u.row - k.row) + (u.col - k.col) * (u.col - k.col)) * 1048576 + k.row * 1024 + k.col) AS m FROM u CROSS JOIN k GROUP BY 1, 2)
SELECT m.row, m.col, k.b2 FROM m JOIN k ON k.row = m // 1024 % 1024 AND k.col = m % 1024
UNION ALL SELECT row, col, b2 FROM k""",
    ),
)
def fill_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Values of bands and lines of the grid; all other cells are filled from the nearest one, however far."""
    c = A.cells(spark, folder)
    return distance.filled(c.withColumn("b2", F.when(F.expr("n % 3 <> 0 AND (row % 32 < 9 OR col % 64 = 5)"), F.col("b2"))), "b2", c)


@register("ridge_response", A.sql("cells", f",\n{_smooth('f', 'cells', 'b2', 1.5)},\n{_slopes('s', 'f')},\ng AS (SELECT row, col, sqrt(gx * gx + gy * gy) AS g FROM s),\n{_smooth('r', 'g', 'g', 1.5)}\nSELECT row, col, round(v, 5) AS response FROM r"))
def ridge_response(spark: SparkSession, folder: str) -> DataFrame:
    r = ridges.ridge_response(A.cells(spark, folder), "b2", 1.5)
    return r.select("row", "col", F.round("response", 5).alias("response"))


def _density_sql() -> str:
    parts, ends = [], []
    for b in ("b1", "b2"):
        parts.append(f"rank_{b} AS (SELECT row, col, (row_number() OVER (ORDER BY {b}, row, col) - 1) / greatest(count(*) OVER () - 1, 1)::DOUBLE AS v FROM cells)")
        for n, s in enumerate((1.5, 3.0)):
            k = f"{b}_{n}"
            parts += [_smooth(f"f_{k}", f"rank_{b}", "v", s), _slopes(f"s_{k}", f"f_{k}"), f"g_{k} AS (SELECT row, col, sqrt(gx * gx + gy * gy) AS g FROM s_{k})", _smooth(f"r_{k}", f"g_{k}", "g", s)]
            ends.append(f"SELECT row, col, v FROM r_{k}")
    union = " UNION ALL ".join(ends)
    return ",\n" + ",\n".join([*parts, f"mean AS (SELECT row, col, sum(v) / 4 AS m FROM ({union}) GROUP BY 1, 2)", _smooth("dens", "mean", "m", 8.0)]) + "\nSELECT row, col, round(v, 6) AS density FROM dens"


@register("ridge_density", A.sql("cells", _density_sql()))
def ridge_density(spark: SparkSession, folder: str) -> DataFrame:
    d = ridges.ridge_density(A.cells(spark, folder), ["b1", "b2"])
    return d.select("row", "col", F.round("density", 6).alias("density"))


def _lineament_sql() -> str:
    sobel = _values([(i, j, w, 0.0) for i, j, w in fields.SOBEL] + [(j, i, 0.0, w) for i, j, w in fields.SOBEL])
    parts = []
    for n, s in enumerate((1.5, 3.0)):
        parts += [_smooth(f"f{n}", "cells", "b2", s), f"""s{n} AS (SELECT c.row, c.col, ln(sqrt(pow(coalesce(sum(n.v * kx), 0), 2) + pow(coalesce(sum(n.v * ky), 0), 2)) + 1e-6::DOUBLE) AS l
  FROM f{n} c CROSS JOIN {sobel} o(i, j, kx, ky) LEFT JOIN f{n} n ON n.row = c.row + i AND n.col = c.col + j GROUP BY 1, 2)"""]
    return ",\n" + ",\n".join([*parts, "m AS (SELECT row, col, exp((s0.l + s1.l) / 2) AS g FROM s0 JOIN s1 USING (row, col))", _above("a", "m")]) + "\nSELECT row, col, round(g, 5) AS lineament FROM a"


@register("gradient_lineament", A.sql("cells", _lineament_sql()))
def gradient_lineament(spark: SparkSession, folder: str) -> DataFrame:
    g = ridges.gradient_lineament(A.cells(spark, folder), "b2")
    return g.select("row", "col", F.round("lineament", 5).alias("lineament"))


_VOTES = _values([(i, j, 1.0 / (16 * len(p))) for p in ridges.line_cells(16, 4).values() for i, j in p])


@register("chain_vote", A.sql("truth", f"\nSELECT ((row + i) % 256 + 256) % 256 AS row, ((col + j) % 256 + 256) % 256 AS col, round(sum(k) + 1e-8::DOUBLE, 6) AS vote FROM truth, {_VOTES} o(i, j, k) GROUP BY 1, 2"))
def chain_vote(spark: SparkSession, folder: str) -> DataFrame:
    return ridges.chain_vote(A.truth(spark, folder), (256, 256)).select("row", "col", _rounded(F.col("vote")).alias("vote"))


_ORIENTED = _values([(d, i, j, 1.0 / len(p)) for d, p in fields.line_offsets(12, 7).items() for i, j in p])


@register("oriented_ridge", A.sql("cells", f",\nm AS (SELECT c.row, c.col, d, sum(n.b2 * k) AS v FROM cells c CROSS JOIN {_ORIENTED} o(d, i, j, k) JOIN cells n ON n.row = c.row + i AND n.col = c.col + j GROUP BY 1, 2, 3)\nSELECT row, col, round(max(v) + 1e-8::DOUBLE, 6) AS response FROM m GROUP BY 1, 2"))
def oriented_ridge(spark: SparkSession, folder: str) -> DataFrame:
    return ridges.oriented_mean(A.cells(spark, folder), "b2").select("row", "col", _rounded(F.col("response")).alias("response"))


_BOOST = """o6 AS (SELECT i::BIGINT AS i, j::BIGINT AS j, sqrt((i * i + j * j)::DOUBLE) AS d FROM range(-6, 7) a(i), range(-6, 7) b(j) WHERE i * i + j * j <= 36),
near AS (SELECT row + i AS row, col + j AS col, min(d) AS d FROM (SELECT DISTINCT y // 16 AS row, x // 16 AS col FROM pts WHERE kind = 'error') e, o6 GROUP BY 1, 2),
boost AS (SELECT row, col, coalesce(exp(-d / 2.5::DOUBLE), 0) AS boost FROM cells LEFT JOIN near USING (row, col))"""


def _places(spark: SparkSession, folder: str) -> DataFrame:
    return A.pts(spark, folder).filter("kind = 'error'").select(F.expr("y div 16").alias("row"), F.expr("x div 16").alias("col"))


@register("proximity_boost", A.sql("cells pts", f",\n{_BOOST}\nSELECT row, col, round(boost, 6) AS boost FROM boost"))
def proximity_boost(spark: SparkSession, folder: str) -> DataFrame:
    b = ridges.proximity(_places(spark, folder), A.cells(spark, folder), 2.5, 6.0)
    return b.select("row", "col", F.round("boost", 6).alias("boost"))


@register("point_alignment", A.sql("cells pts", f",\nmarks AS (SELECT DISTINCT y // 16 AS row, x // 16 AS col, 1.0::DOUBLE AS m FROM pts WHERE kind = 'error'),\n{_smooth('s', 'marks', 'm', 4.0)}\nSELECT row, col, round(v, 6) AS alignment FROM s"))
def point_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Marked cells blurred by half of eight cells, on the cells that exist."""
    marks = _places(spark, folder).distinct().withColumn("m", F.lit(1.0))
    wide = kernels.separable(marks, "m", kernels.gauss(4.0), kernels.gauss(4.0), "v")
    return A.cells(spark, folder).select("row", "col").join(wide, ["row", "col"]).select("row", "col", F.round("v", 6).alias("alignment"))


_SEGMENTS = """seg AS (SELECT id, (x / 16.0)::DOUBLE AS x0, (y / 16.0)::DOUBLE AS y0, x / 16.0::DOUBLE + (id % 7) - 3 AS x1, y / 16.0::DOUBLE + (id % 5) - 2 AS y1, (1 + id % 4) / 4.0::DOUBLE AS weight
  FROM pts WHERE id % 9 = 0),
burn AS (SELECT row, col, max(weight * exp(-0.5::DOUBLE * pow(d / 1.5::DOUBLE, 2))) AS value FROM (
  SELECT row, col, weight, sqrt(pow(col - x0 - t * vx, 2) + pow(row - y0 - t * vy, 2)) AS d FROM (
    SELECT *, x1 - x0 AS vx, y1 - y0 AS vy, least(greatest(((col - x0) * (x1 - x0) + (row - y0) * (y1 - y0)) / greatest(pow(x1 - x0, 2) + pow(y1 - y0, 2), 1e-12::DOUBLE), 0), 1) AS t FROM (
      SELECT *, unnest(range(ceil(least(x0, x1) - 4.5)::BIGINT, floor(greatest(x0, x1) + 4.5)::BIGINT + 1)) AS col FROM (
        SELECT *, unnest(range(ceil(least(y0, y1) - 4.5)::BIGINT, floor(greatest(y0, y1) + 4.5)::BIGINT + 1)) AS row FROM seg)))) WHERE d <= 4.5 GROUP BY 1, 2)"""


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    x, y, i = F.col("x") / 16.0, F.col("y") / 16.0, F.col("id")
    p = A.pts(spark, folder).filter("id % 9 = 0")
    return p.select(x.alias("x0"), y.alias("y0"), (x + i % 7 - 3).alias("x1"), (y + i % 5 - 2).alias("y1"), ((1 + i % 4) / 4.0).alias("weight"))


@register("corridor_belief", A.sql("pts", f",\n{_SEGMENTS}\nSELECT row, col, round(value / (SELECT max(value) FROM burn), 6) AS belief FROM burn"))
def corridor_belief(spark: SparkSession, folder: str) -> DataFrame:
    """Gaussian corridors about segments, the strongest at each cell, as a share of the largest."""
    b = ridges.burnt(_segments(spark, folder), 1.5)
    return b.join(F.broadcast(b.agg(F.max("value").alias("top")))).select("row", "col", F.round(F.col("value") / F.col("top"), 6).alias("belief"))


def _evidence_sql() -> str:
    parts = [
        "t AS (SELECT row, col, sqrt(b2 / 50) * sqrt(0.5::DOUBLE + 0.5::DOUBLE * ((n % 4) / 4.0::DOUBLE)) * ((row * 7 + col * 3) % 10 / 10.0::DOUBLE) * (0.75::DOUBLE + 0.25::DOUBLE * (b1 / 100000)) AS t FROM cells)",
        "topo AS (SELECT row, col, greatest(least(t / (SELECT quantile_cont(t, 0.99) FROM t WHERE t > 0), 1), 0) AS topographic FROM t)",
    ]
    sums = []
    for n, s in enumerate((1.5, 3.0)):
        for b in ("b1", "b2"):
            k = f"{b}_{n}"
            parts += [_smooth(f"f_{k}", "cells", "b1 / 1000" if b == "b1" else "b2", s), _slopes(f"s_{k}", f"f_{k}")]
            sums.append(f"SELECT row, col, {n} AS n, sqrt(gx * gx + gy * gy) AS g FROM s_{k}")
    union = " UNION ALL ".join(sums)
    parts += [
        f"gm AS (SELECT row, col, sqrt(sum(g) FILTER (n = 0) * sum(g) FILTER (n = 1)) AS g FROM ({union}) GROUP BY 1, 2)",
        _above("a", "gm"),
        "radio AS (SELECT row, col, greatest(least(g / (SELECT quantile_cont(g, 0.99) FROM a WHERE g > 0), 1), 0) AS radiometric FROM a)",
    ]
    return ",\n" + ",\n".join(parts) + "\nSELECT row, col, round(topographic, 5) AS topographic, round(radiometric, 5) AS radiometric, round(0.7::DOUBLE * topographic + 0.3::DOUBLE * radiometric, 5) AS score FROM topo JOIN radio USING (row, col)"


@register("ridge_evidence", A.sql("cells", _evidence_sql()))
def ridge_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Terrain and radiometric ridges, seven to three, from bands made of the cells."""
    c = A.cells(spark, folder).select(
        "row", "col", "b2", (F.col("b1") / 1000).alias("r1"), (F.col("b2") / 50).alias("step"), (F.col("n") % 4 / 4.0).alias("lap"),
        ((F.col("row") * 7 + F.col("col") * 3) % 10 / 10.0).alias("coherence"), (F.col("b1") / 100000).alias("relief"),
    )
    e = ridges.ridge_evidence(c, ["step", "lap", "coherence", "relief"], ["r1", "b2"])
    return e.select("row", "col", *[F.round(x, 5).alias(x) for x in ("topographic", "radiometric", "score")])


_BELIEF = f""",
{_BOOST},
unit AS (SELECT row, col, least(b1 / (SELECT quantile_cont(b1, 0.99) FROM cells), 1) AS a, least(b2 / (SELECT quantile_cont(b2, 0.99) FROM cells), 1) AS b,
  least(n / (SELECT quantile_cont(n, 0.99) FROM cells), 1) AS line FROM cells),
b0 AS (SELECT row, col, line, 0.75::DOUBLE * a + 0.55::DOUBLE * b AS v FROM unit),
b1 AS (SELECT row, col, line, least(v / (SELECT quantile_cont(v, 0.999) FROM b0), 1) AS base FROM b0),
m0 AS (SELECT row, col, base, 0.7::DOUBLE * base + 0.3::DOUBLE * line AS v FROM b1),
m1 AS (SELECT row, col, base, least(v / (SELECT quantile_cont(v, 0.999) FROM m0), 1) AS v FROM m0),
o2 AS (SELECT i::BIGINT AS i, j::BIGINT AS j, sqrt((i * i + j * j)::DOUBLE) AS d FROM range(-6, 7) a(i), range(-6, 7) b(j) WHERE i * i + j * j <= 36),
td AS (SELECT t.row + i AS row, t.col + j AS col, min(d) AS d FROM truth t, o2 GROUP BY 1, 2)
SELECT row, col, round(base, 5) AS base, round(CASE WHEN coalesce(d, 1e9) <= 2 THEN 0 ELSE least(v * (1 + 0.35::DOUBLE * boost), 1) * (0.25::DOUBLE + 0.75::DOUBLE * greatest(least((coalesce(d, 1e9) - 2) / 4, 1), 0)) END, 5) AS belief
FROM m1 JOIN boost USING (row, col) LEFT JOIN td USING (row, col)"""


@register("belief_field", A.sql("cells pts truth", _BELIEF))
def belief_field(spark: SparkSession, folder: str) -> DataFrame:
    """Families, line contrast, places and confounders put together outside the buffer of truth."""
    c, t = A.cells(spark, folder), A.truth(spark, folder)
    near = kernels.spread(t, kernels.disc(6.0, weight=lambda d, r: d, keep_zero=True), []).groupBy("row", "col").agg(F.min("k").alias("d"))
    factor = near.select("row", "col", (0.25 + 0.75 * F.greatest(F.least((F.col("d") - 2) / 4, F.lit(1.0)), F.lit(0.0))).alias("factor"))
    f = ridges.belief_field(c, ("b1", "b2"), "n", ridges.proximity(_places(spark, folder), c, 2.5, 6.0), factor, t)
    return f.select("row", "col", F.round("base", 5).alias("base"), F.round("belief", 5).alias("belief"))

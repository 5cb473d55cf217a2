"""Queries of planes through events, their traces on the ground, and bootstraps of groups."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.functions.expressions import unit_hash
from terrastrat.operators import bootstrap, traces
from terrastrat.plans import adapters as A
from terrastrat.plans.registry import register
from terrastrat.sources.tables import table

_POISSON = " + ".join(f"(u > {c!r}::DOUBLE)::BIGINT" for c in bootstrap.poisson_steps())


@register(
    "bootstrap_axis",
    A.sql(
        "pts",
        f""",
g AS (SELECT (x // 512) * 8 + y // 512 AS g, id, (x % 512)::DOUBLE AS x, (y % 512)::DOUBLE AS y FROM pts),
f AS (SELECT g, count(*)::BIGINT AS n, avg(x * x) - avg(x) * avg(x) AS xx, avg(x * y) - avg(x) * avg(y) AS xy, avg(y * y) - avg(y) * avg(y) AS yy FROM g GROUP BY g),
o AS (SELECT g, n, degrees(0.5::DOUBLE * atan2(2 * xy, xx - yy)) AS a0, CASE WHEN a0 < 0 THEN a0 + 180 ELSE a0 END AS a FROM f),
d AS (SELECT range AS draw FROM range(24)),
u AS (SELECT g, draw, x, y, {A.unit_sql(5, "g", "id", "draw")} AS u FROM g, d),
w AS (SELECT g, draw, x, y, {_POISSON} AS w FROM u),
m AS (SELECT g, draw, count(*) AS n, sum(w)::DOUBLE AS s, sum(w * x) / s AS mx, sum(w * y) / s AS my, sum(w * x * x) / s - mx * mx AS xx, sum(w * x * y) / s - mx * my AS xy, sum(w * y * y) / s - my * my AS yy
  FROM w WHERE w > 0 GROUP BY g, draw),
t AS (SELECT m.g, CASE WHEN m.n > 1 THEN abs(((degrees(0.5::DOUBLE * atan2(2 * m.xy, m.xx - m.yy)) - o.a) + 360) % 180) ELSE NULL END AS off FROM m JOIN o USING (g)),
a AS (SELECT g, coalesce(least(off, 180 - off), 90) AS off FROM t),
p AS (SELECT g, off FROM a UNION ALL SELECT o.g, 90 FROM o, d WHERE d.draw >= (SELECT count(*) FROM m WHERE m.g = o.g))
SELECT o.g, o.n, round(o.a, 6) AS angle, round(quantile_cont(p.off, 0.9), 6) AS spread FROM o JOIN p USING (g) GROUP BY o.g, o.n, o.a""",
    ),
)
def bootstrap_axis(spark: SparkSession, folder: str) -> DataFrame:
    """Long axes of the points of each square and how far resampling turns them."""
    rows = A.pts(spark, folder).select(F.expr("(x div 512) * 8 + y div 512").alias("g"), "id", (F.col("x") % 512).alias("x"), (F.col("y") % 512).alias("y"))
    got = bootstrap.axis_spread(rows, "g", "id", seed=5)
    return got.select("g", "n", F.round("angle", 6).alias("angle"), F.round("spread", 6).alias("spread"))


_RULES = replace(traces.Rules(), step=80.0, reach=1500.0)


def _ground(spark: SparkSession, folder: str) -> DataFrame:
    blocks = A.cells(spark, folder).groupBy(F.expr("row div 8").alias("row"), F.expr("col div 8").alias("col"))
    return blocks.agg(F.round(40 * F.avg("b2") + 1e-8, 3).alias("z"))


@register(
    "surface_traces",
    A.sql(
        "cells",
        """,
d AS (SELECT row // 8 AS row, col // 8 AS col, round(40 * avg(b2) + 1e-8::DOUBLE, 3) AS z FROM cells GROUP BY 1, 2),
q AS (SELECT a.row, a.col, a.z AS z00, b.z AS z01, c.z AS z10, e.z AS z11 FROM d a JOIN d b ON b.row = a.row AND b.col = a.col + 1 JOIN d c ON c.row = a.row + 1 AND c.col = a.col JOIN d e ON e.row = a.row + 1 AND e.col = a.col + 1),
p0 AS (SELECT s_suppkey AS id, (300 + (s_suppkey * 97) % 2600)::DOUBLE AS cx, (300 + (s_suppkey * 57) % 2600)::DOUBLE AS cy, (700 + 10 * s_nationkey)::DOUBLE AS cz, radians(7.2::DOUBLE * s_nationkey) AS t, 0.5::DOUBLE + (s_suppkey % 10) / 10.0::DOUBLE AS d FROM supplier),
p AS (SELECT id, cx, cy, cz, cos(t) * sin(d) AS nx, sin(t) * sin(d) AS ny, cos(d) AS nz, sqrt(nx * nx + ny * ny) AS hn, -ny / hn AS ux, nx / hn AS uy, nx / hn AS dx, ny / hn AS dy FROM p0),
c AS (SELECT p.*, (3200 - cy) / 100 - 0.5::DOUBLE AS fr, cx / 100 - 0.5::DOUBLE AS fc FROM p),
g AS (SELECT c.*, coalesce(-nz * (z00 * (1 - (fc - q.col)) * (1 - (fr - q.row)) + z01 * (fc - q.col) * (1 - (fr - q.row)) + z10 * (1 - (fc - q.col)) * (fr - q.row) + z11 * (fc - q.col) * (fr - q.row) - cz) / hn, 0) AS guess
  FROM c LEFT JOIN q ON q.row = floor(fr)::BIGINT AND q.col = floor(fc)::BIGINT),
l AS (SELECT id, k.range AS k, cx, cy, cz, ux, uy, dx, dy, hn, nz, guess, -400 + 800 * k / 10.0::DOUBLE AS a FROM g, range(11) k),
x AS (SELECT l.*, j.range AS j, j * 100.0::DOUBLE AS q, (3200 - (cy + a * uy + q * dy)) / 100 - 0.5::DOUBLE AS fr, (cx + a * ux + q * dx) / 100 - 0.5::DOUBLE AS fc FROM l, range(-15, 16) j),
f AS (SELECT x.*, hn * x.q + nz * (z00 * (1 - (fc - q.col)) * (1 - (fr - q.row)) + z01 * (fc - q.col) * (1 - (fr - q.row)) + z10 * (1 - (fc - q.col)) * (fr - q.row) + z11 * (fc - q.col) * (fr - q.row) - cz) AS f
  FROM x LEFT JOIN q ON q.row = floor(fr)::BIGINT AND q.col = floor(fc)::BIGINT),
b AS (SELECT l.*, r.f AS fr2, row_number() OVER (PARTITION BY l.id, l.k ORDER BY abs((l.j + 0.5::DOUBLE) * 100 - l.guess), l.j) AS rn FROM f l JOIN f r ON r.id = l.id AND r.k = l.k AND r.j = l.j + 1 WHERE l.f * r.f <= 0),
s(id, k, step, ql, qr, fl, q, done) AS (
  WITH RECURSIVE s(id, k, step, ql, qr, fl, q, done) AS (
    SELECT id, k, 0, j * 100.0::DOUBLE, (j + 1) * 100.0::DOUBLE, f, CASE WHEN f = 0 THEN j * 100.0::DOUBLE WHEN fr2 = 0 THEN (j + 1) * 100.0::DOUBLE ELSE 0 END, f = 0 OR fr2 = 0 FROM b WHERE rn = 1
    UNION ALL
    SELECT id, k, step + 1, CASE WHEN stop OR turn THEN ql ELSE m END, CASE WHEN NOT stop AND turn THEN m ELSE qr END, CASE WHEN stop OR turn THEN fl ELSE fm END, m, stop
    FROM (
      SELECT h.*, (fl <= 0 AND fm >= 0) OR (fl >= 0 AND fm <= 0) AS turn, fm IS NULL OR abs(fm) <= 5 AS stop
      FROM (
        SELECT v.*, hn * m + nz * (z00 * (1 - (fc - q.col)) * (1 - (fr - q.row)) + z01 * (fc - q.col) * (1 - (fr - q.row)) + z10 * (1 - (fc - q.col)) * (fr - q.row) + z11 * (fc - q.col) * (fr - q.row) - cz) AS fm
        FROM (SELECT s.id, s.k, s.step, s.ql, s.qr, s.fl, (s.ql + s.qr) / 2 AS m, l.hn, l.nz, l.cz, (3200 - (l.cy + l.a * l.uy + m * l.dy)) / 100 - 0.5::DOUBLE AS fr, (l.cx + l.a * l.ux + m * l.dx) / 100 - 0.5::DOUBLE AS fc
          FROM s JOIN l USING (id, k) WHERE NOT s.done AND s.step < 24) v
        LEFT JOIN q ON q.row = floor(fr)::BIGINT AND q.col = floor(fc)::BIGINT) h)
  ) SELECT * FROM s),
e AS (SELECT id, k, arg_max(q, step) AS q FROM s GROUP BY id, k),
z AS (SELECT e.id, e.k, e.q, l.cx + l.a * l.ux + e.q * l.dx AS x, l.cy + l.a * l.uy + e.q * l.dy AS y, l.hn, l.nz, l.cz FROM e JOIN l USING (id, k)),
r AS (SELECT z.*, abs(hn * z.q + nz * (z00 * (1 - (fc - q.col)) * (1 - (fr - q.row)) + z01 * (fc - q.col) * (1 - (fr - q.row)) + z10 * (1 - (fc - q.col)) * (fr - q.row) + z11 * (fc - q.col) * (fr - q.row) - cz)) AS residual
  FROM (SELECT *, (3200 - y) / 100 - 0.5::DOUBLE AS fr, x / 100 - 0.5::DOUBLE AS fc FROM z) z JOIN q ON q.row = floor(fr)::BIGINT AND q.col = floor(fc)::BIGINT)
SELECT id, k::BIGINT AS k, round(x, 4) AS x, round(y, 4) AS y, round(q, 4) AS q, round(residual, 4) AS residual FROM r WHERE residual <= 5 AND abs(q) <= 1500""",
    ),
)
def surface_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Where one plane a supplier meets a ground made of the cells."""
    s, t = table(spark, folder, "supplier"), F.radians(7.2 * F.col("s_nationkey"))
    dip = 0.5 + (F.col("s_suppkey") % 10) / 10.0
    planes = s.select(
        F.col("s_suppkey").alias("id"), (300 + (F.col("s_suppkey") * 97) % 2600).cast("double").alias("cx"), (300 + (F.col("s_suppkey") * 57) % 2600).cast("double").alias("cy"),
        (700 + 10 * F.col("s_nationkey")).cast("double").alias("cz"), (F.cos(t) * F.sin(dip)).alias("nx"), (F.sin(t) * F.sin(dip)).alias("ny"), F.cos(dip).alias("nz"), F.lit(-400.0).alias("lo"), F.lit(400.0).alias("hi"),
    )
    got = traces.surface_traces(planes, _ground(spark, folder), _RULES, 100.0, 0.0, 3200.0)
    return got.select("id", F.col("k").cast("long").alias("k"), *[F.round(c, 4).alias(c) for c in ("x", "y", "q", "residual")])


#: Coarser seeds and steps than usual, for a swarm of twelve planes.
_COARSE = replace(traces.Rules(), seed_cell=2000.0, radius=2000.0, step=200.0, reach=3000.0)


def _swarm(spark: SparkSession, folder: str) -> DataFrame:
    """Events near twelve steep planes, every tenth one anywhere."""
    p, g = A.pts(spark, folder), (F.col("id") % 12).cast("double")
    u = lambda n: unit_hash(F.col("id"), seed=n)
    strike, dip = F.radians(15 * g), F.radians(60 + 2 * g)
    along, down, off = 5000 * (F.col("x") / 4096.0 - 0.5), 4000 * F.col("y") / 4096.0, 120 * (u(1) - 0.5)
    side = down / F.tan(dip) + off
    east, north = 4000 + 8000 * (g % 4) + along * F.sin(strike) + side * F.cos(strike), 4000 + 8000 * F.floor(g / 4) + along * F.cos(strike) - side * F.sin(strike)
    loose = F.col("id") % 10 == 0
    return p.select(
        "id", F.when(loose, 32_000 * u(2)).otherwise(east).alias("x"), F.when(loose, 24_000 * u(3)).otherwise(north).alias("y"), (1000 - F.when(loose, 8000 * u(4)).otherwise(down)).alias("z"), (2000 + F.floor(12 * u(5))).cast("long").alias("year"),
    )


def _terrain(spark: SparkSession, folder: str) -> DataFrame:
    """A ground of 320 x 240 cells: a plane that rises to the east, roughened by the table's values."""
    c = A.cells(spark, folder).groupBy(F.expr("row div 16").alias("r"), F.expr("col div 16").alias("c")).agg(F.avg("b2").alias("v"))
    wide = spark.range(240 * 320).select(F.expr("id div 320").alias("row"), F.expr("id % 320").alias("col"))
    rough = wide.join(F.broadcast(c), (F.expr("row div 15") == F.col("r")) & (F.expr("col div 20") == F.col("c")), "left")  # 256 rows
    return rough.select("row", "col", (950 + 0.4 * F.col("col") + F.coalesce("v", F.lit(25.0))).alias("z"))


@register("fault_lineaments")
def fault_lineaments(spark: SparkSession, folder: str) -> DataFrame:
    """Planes through a swarm that meet the ground: cells with their score."""
    seeds, found = traces.lineaments(_swarm(spark, folder), _terrain(spark, folder), _COARSE, pixel=100.0, x0=0.0, y0=24_000.0)
    return traces.painted(seeds, found, _COARSE, pixel=100.0, x0=0.0, y0=24_000.0)


@register("lineament_rejections")
def lineament_rejections(spark: SparkSession, folder: str) -> DataFrame:
    """How many seeds of the swarm each test rejects."""
    return traces.rejection_counts(traces.lineaments(_swarm(spark, folder), _terrain(spark, folder), _COARSE, pixel=100.0, x0=0.0, y0=24_000.0)[0])

"""Queries of ordered selections, of ends, bridges and continuations of lines, and of lines that beat chance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.operators import kernels, ordered, significance, tips
from terrastrat.plans import adapters as A
from terrastrat.plans.registry import register
from terrastrat.session import cut


@register(
    "ordered_emission",
    A.sql(
        "cells truth kern",
        """,
b AS (SELECT row, col, b2 / 10::DOUBLE AS pi FROM cells),
r AS (SELECT row, col, row_number() OVER (ORDER BY pi DESC, row, col) AS rn FROM b ANTI JOIN truth USING (row, col) WHERE pi > 0.000001::DOUBLE QUALIFY rn <= 2000),
s AS (SELECT rn, r.row + i AS row, r.col + j AS col, k FROM r, kern),
c AS (SELECT rn, pi * greatest(k - coalesce(max(k) OVER (PARTITION BY row, col ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS add FROM s JOIN b USING (row, col)),
g AS (SELECT rn, sum(add) AS gain FROM c GROUP BY rn),
t AS (SELECT rn, gain, sum(gain) OVER (ORDER BY rn) AS total FROM g),
f AS (SELECT coalesce(min(rn) FILTER (rn > 1 AND 0.2::DOUBLE * (total - gain) / (0.2::DOUBLE * (2 * rn - 1) + 0.8::DOUBLE * 700) >= 1), 1 << 40) AS first FROM t)
SELECT rn, row, col, round(gain, 6) AS gain, round(total, 6) AS total FROM t JOIN r USING (rn) WHERE rn < (SELECT first FROM f)""",
    ),
)
def ordered_emission(spark: SparkSession, folder: str) -> DataFrame:
    """Cells outside truth taken by falling belief until the bar of all taken before ends it, 2000 at most (the budget is the feature)."""
    c = A.cells(spark, folder)
    belief = c.select("row", "col", (F.col("b2") / 10).alias("pi"))
    free = c.select("row", "col").join(A.truth(spark, folder), ["row", "col"], "left_anti")
    got = ordered.emit_in_order(belief, 2000, 700.0, domain=free)
    return got.select("rn", "row", "col", F.round("gain", 6).alias("gain"), F.round("total", 6).alias("total"))


@register("packed_emission")
def packed_emission(spark: SparkSession, folder: str) -> DataFrame:
    """A budget of 1500 cells by falling value, none within two cells of a better one."""
    return ordered.pack(A.cells(spark, folder), "b1", 1500, 2)


@register("mass_emission")
def mass_emission(spark: SparkSession, folder: str) -> DataFrame:
    """A budget of 1000 cells by the credit of the lower half's values, outside truth, 2.5 cells apart."""
    seen = A.truth(spark, folder).withColumn("t", F.lit(True))
    rows = A.cells(spark, folder).join(seen, ["row", "col"], "left").select("row", "col", F.least(F.col("b2") / 50, F.lit(1.0)).alias("p"), "t")
    return ordered.at_mass(rows, "p", F.col("row") >= 128, F.col("t").isNull(), 1000, 2.5)


_ENDS = """,
nb AS (SELECT a.row, a.col FROM truth a JOIN truth b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2 HAVING count(*) = 2),
o AS (SELECT i::BIGINT AS i, j::BIGINT AS j FROM range(-5, 6) a(i), range(-5, 6) b(j) WHERE i * i + j * j <= 25),
e AS (SELECT nb.row, nb.col, count(*) AS n, sum(i) AS a, sum(j) AS b, sum(i * i) AS aa, sum(j * j) AS bb, sum(i * j) AS ab FROM nb, o JOIN truth t ON t.row = nb.row + i AND t.col = nb.col + j GROUP BY 1, 2),
d AS (SELECT row, col, n, degrees(0.5::DOUBLE * atan2((2 * (n * ab - a * b))::DOUBLE, (n * bb - b * b - n * aa + a * a)::DOUBLE)) AS deg FROM e),
tip AS (SELECT row, col, n, CASE WHEN n >= 3 THEN deg + CASE WHEN deg < 0 THEN 180 ELSE 0 END END AS strike FROM d)"""


@register("line_ends", A.sql("truth", _ENDS + "\nSELECT row, col, n::BIGINT AS n, round(strike, 6) AS strike FROM tip"))
def line_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Truth cells with one neighbour, and the strike of truth around them."""
    return tips.ends(A.truth(spark, folder)).select("row", "col", "n", F.round("strike", 6).alias("strike"))


@register(
    "end_pairs",
    A.sql(
        "truth",
        _ENDS
        + """,
p AS (SELECT s.row, s.col, t.row AS n_row, t.col AS n_col, sqrt(((t.row - s.row) * (t.row - s.row) + (t.col - s.col) * (t.col - s.col))::DOUBLE) AS d, degrees(atan2((t.row - s.row)::DOUBLE, (t.col - s.col)::DOUBLE)) AS line, s.strike AS a, t.strike AS b
  FROM tip s JOIN tip t ON t.row BETWEEN s.row AND s.row + 8 AND t.col BETWEEN s.col - 8 AND s.col + 8 AND (t.row > s.row OR t.col > s.col))
SELECT row, col, n_row, n_col, round(d, 6) AS d, coalesce(a IS NOT NULL AND b IS NOT NULL AND d >= 2 AND degrees(acos(least(abs(cos(radians(line - a))), 1))) <= 40.5::DOUBLE AND degrees(acos(least(abs(cos(radians(line - b))), 1))) <= 40.5::DOUBLE, false) AS agrees FROM p WHERE d <= 8""",
    ),
)
def end_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Ends within eight cells of each other, marked where the line between them follows both strikes."""
    met = tips.pairs(tips.ends(A.truth(spark, folder)), 8.0, 40.5)
    return met.select("row", "col", "n_row", "n_col", F.round("d", 6).alias("d"), "agrees")


@register("tip_bridges")
def tip_bridges(spark: SparkSession, folder: str) -> DataFrame:
    """Thinned truth bridged and prolonged at its ends, moved to the field's ridges."""
    got, _ = tips.tip_bridges(A.truth(spark, folder), A.cells(spark, folder), "b1", 256, 256, gap=8.0, extend=4.0)
    return got


@register("tip_bridge_counts")
def tip_bridge_counts(spark: SparkSession, folder: str) -> DataFrame:
    """One row: cells of the thinned truth, ends, pairs, bridges, lone ends, cells drawn and moved."""
    _, counts = tips.tip_bridges(A.truth(spark, folder), A.cells(spark, folder), "b1", 256, 256, gap=8.0, extend=4.0)
    return counts


@register("continued_traces")
def continued_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Truth carried on along its local strike, fading with distance; cells on and beside truth left out."""
    return tips.continued(A.truth(spark, folder), 256, 256).withColumn("value", F.round("value", 9))


_RANDOM = f""",
c AS (SELECT least(y // 512, 8) * 9 + least(x // 512, 8) AS c, count(*) AS n FROM pts GROUP BY 1),
w AS (SELECT g.c, coalesce(n, 0) * 20 + 1 AS w, sum(coalesce(n, 0) * 20 + 1) OVER (ORDER BY g.c) AS high FROM range(81) g(c) LEFT JOIN c USING (c)),
b AS (SELECT c, high - w AS low FROM w),
d AS (SELECT s, i, {A.unit_sql(3, "s", "i")} * (SELECT sum(w) FROM w)::DOUBLE AS u FROM range(4) a(s), range((SELECT count(*) FROM pts)) e(i)),
rnd AS (SELECT s, i, (c % 9) * 512 + {A.unit_sql(4, "s", "i")} * 512 AS x, (c // 9) * 512 + {A.unit_sql(5, "s", "i")} * 512 AS y FROM d ASOF JOIN b ON d.u >= b.low)"""


@register("surrogate_points", A.sql("pts", _RANDOM + "\nSELECT s, i, round(x, 6) AS x, round(y, 6) AS y FROM rnd"))
def surrogate_points(spark: SparkSession, folder: str) -> DataFrame:
    """Four random catalogues with the events' density by squares of 512."""
    got = significance.surrogates(A.pts(spark, folder), 4096, 4096, 4, 512, 3)
    return got.select("s", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register(
    "line_peaks",
    A.sql(
        "pts",
        _RANDOM
        + """,
p AS (SELECT x::DOUBLE AS x, y::DOUBLE AS y, mag / (SELECT max(mag) FROM pts) AS m, 0 AS r FROM pts UNION ALL SELECT x, y, 0, 1 FROM rnd),
h AS (SELECT sqrt((4096.0::DOUBLE * 4096 * 2)) + 2 AS far),
v0 AS (SELECT theta::BIGINT AS theta, floor((x * cos(theta * (pi() / 60)) + y * sin(theta * (pi() / 60))) / 16 + far / 16)::BIGINT AS bin, count(*) FILTER (r = 0) AS v, sum(m) AS w, count(*) FILTER (r = 1) AS q FROM p, h, range(60) t(theta) GROUP BY 1, 2),
v AS (SELECT theta, bin + j AS bin, sum(v) AS votes, sum(w) AS weighted, sum(q) / 4.0::DOUBLE AS expected FROM v0, range(-1, 2) o(j) WHERE bin + j BETWEEN 0 AND ceil(2 * (SELECT far FROM h) / 16) GROUP BY 1, 2),
z AS (SELECT *, (votes - expected) / sqrt(expected + 1) AS z FROM v)
SELECT a.theta, a.bin, a.votes::BIGINT AS votes, round(a.weighted, 6) AS weighted, round(a.expected, 6) AS expected, round(a.z, 6) AS z
FROM z a LEFT JOIN z l ON l.theta = a.theta AND l.bin = a.bin - 1 LEFT JOIN z n ON n.theta = a.theta AND n.bin = a.bin + 1
WHERE a.z > 1.5 AND a.votes >= 8 AND a.z > coalesce(l.z, 0) AND a.z >= coalesce(n.z, 0)""",
    ),
)
def line_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of events with more votes than catalogues of the same coarse density give."""
    p = A.pts(spark, folder).select("x", "y", F.col("mag").alias("weight"))
    bins = cut(significance.line_significance(p, significance.surrogates(p, 4096, 4096, 4, 512, 3), 4, 4096, 4096, 60, 16.0))
    got = significance.peaks(bins, 1.5, 8)
    return got.select("theta", "bin", "votes", F.round("weighted", 6).alias("weighted"), F.round("expected", 6).alias("expected"), F.round("z", 6).alias("z"))


@register("significant_lines")
def significant_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same peaks without near-duplicates, as lines of a least length with their ends."""
    p = A.pts(spark, folder).select("x", "y", F.col("mag").alias("weight"))
    random = cut(significance.surrogates(p, 4096, 4096, 4, 512, 3).select("x", "y"))
    got = significance.detect_lines(p, random, 4, 4096, 4096, 60, 16.0, z_least=1.5, extent=600.0, degrees=10.0, apart=64.0)
    return got.select(*[F.round(c, 6).alias(c) if c != "n" else "n" for c in got.columns])


@register("line_spans")
def line_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Of the significant lines, the spans that hold more events than the strips beside them."""
    lines = significant_lines(spark, folder)
    got = significance.local_spans(A.pts(spark, folder), lines, 60, window=400.0, z_least=1.0, least=3, merge=200.0, side=80.0, half=24.0)
    return got.select(*[F.round(c, 6).alias(c) if c != "n" else "n" for c in got.columns])


def _taps(sigma: float) -> str:
    return ", ".join(f"({i}::BIGINT, {w!r}::DOUBLE)" for i, w in kernels.gauss(sigma))


@register(
    "temporal_holdout",
    A.sql(
        "pts kern",
        f""",
m AS (SELECT (min(t_us) + max(t_us)) // 2 AS mid FROM pts),
c AS (SELECT y // 16 AS row, x // 16 AS col, count(*) FILTER (t_us < (SELECT mid FROM m))::DOUBLE AS n FROM pts GROUP BY 1, 2),
t AS (SELECT row, col FROM c WHERE n = 0),
k1 AS (SELECT * FROM (VALUES {_taps(1.0)}) v(i, w)), k2 AS (SELECT * FROM (VALUES {_taps(2.0)}) v(i, w)),
d1 AS (SELECT c.row + a.i AS row, c.col + b.i AS col, sum(n * a.w * b.w) AS v FROM c, k1 a, k1 b WHERE n > 0 GROUP BY 1, 2),
d2 AS (SELECT c.row + a.i AS row, c.col + b.i AS col, sum(n * a.w * b.w) AS v FROM c, k2 a, k2 b WHERE n > 0 GROUP BY 1, 2),
r AS (SELECT c.row, c.col, n, row_number() OVER (ORDER BY round(coalesce(d1.v, 0), 9) DESC, c.row, c.col) AS r1, row_number() OVER (ORDER BY round(coalesce(d2.v, 0), 9) DESC, c.row, c.col) AS r2,
  row_number() OVER (ORDER BY {A.unit_sql(7, "c.row", "c.col")}, c.row, c.col) AS r3 FROM c LEFT JOIN d1 USING (row, col) LEFT JOIN d2 ON d2.row = c.row AND d2.col = c.col),
q AS (SELECT count(*) AS mass FROM c WHERE n >= 2),
s AS (SELECT 'repeated' AS way, row, col FROM c WHERE n >= 2 UNION ALL SELECT 'density 1', row, col FROM r, q WHERE r1 <= mass
  UNION ALL SELECT 'density 2', row, col FROM r, q WHERE r2 <= mass UNION ALL SELECT 'random', row, col FROM r, q WHERE r3 <= mass),
v AS (SELECT way, s.row + i AS row, s.col + j AS col, max(k) AS k FROM s, kern GROUP BY 1, 2, 3),
p AS (SELECT way, sum(k) AS tpw FROM v JOIN t USING (row, col) GROUP BY way)
SELECT way, mass::BIGINT AS mass, (SELECT count(*) FROM t) AS truth, round(tpw, 6) AS tpw, round(tpw / mass, 6) AS credit_per_cell, round(tpw / (SELECT count(*) FROM t), 6) AS covered
FROM (SELECT DISTINCT s.way, coalesce(tpw, 0) AS tpw FROM s LEFT JOIN p USING (way)), q""",
    ),
)
def temporal_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """Supports of the earlier half of time, scored on cells that events reach in the later half only."""
    p = A.pts(spark, folder)
    ends = p.agg(F.expr("(min(t_us) + max(t_us)) div 2").alias("at"))
    e = p.join(F.broadcast(ends)).select(F.expr("y div 16").alias("row"), F.expr("x div 16").alias("col"), "t_us", "at")  # one row
    got = ordered.temporal_holdout(e, F.col("t_us") < F.col("at"), seed=7)
    return got.select("way", "mass", "truth", *[F.round(c, 6).alias(c) for c in ("tpw", "credit_per_cell", "covered")])

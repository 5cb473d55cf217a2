"""Queries that choose cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrastrat.operators import emission, kernels, metric, points, select
from terrastrat.plans import adapters as A
from terrastrat.plans.events import _SEG, _segments
from terrastrat.plans.registry import register
from terrastrat.session import cut


@register("top_n_budget", A.sql("cells", "SELECT row, col, b1 FROM cells WHERE b1 > 0 ORDER BY b1 DESC, row, col LIMIT 500"))
def top_n_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The feature is the budget: the best 500 cells."""
    return select.top_n(A.cells(spark, folder), "b1", 500).select("row", "col", "b1")


@register(
    "largest_remainder",
    A.sql(
        "truth",
        """,
g AS (SELECT row // 64 * 4 + col // 64 AS fold, count(*)::DOUBLE AS w FROM truth GROUP BY 1),
q AS (SELECT fold, w / sum(w) OVER () * 1000 AS q, floor(w / sum(w) OVER () * 1000)::BIGINT AS f FROM g)
SELECT fold, f + (row_number() OVER (ORDER BY round(q - f, 9) DESC, fold) <= 1000 - sum(f) OVER ())::BIGINT AS share FROM q""",
    ),
)
def largest_remainder(spark: SparkSession, folder: str) -> DataFrame:
    """A budget of 1000 cells dealt over folds by their truth."""
    g = A.truth(spark, folder).groupBy(F.expr("row div 64 * 4 + col div 64").alias("fold")).agg(F.count("*").alias("w"))
    return select.largest_remainder(g, "fold", "w", 1000)


@register(
    "stratified_round_robin",
    A.sql("cells", ",\nr AS (SELECT row, col, b1, row_number() OVER (PARTITION BY row // 32, col // 32 ORDER BY b1 DESC, row, col)::BIGINT AS round FROM cells)\nSELECT row, col, round FROM r ORDER BY round, b1 DESC, row, col LIMIT 1000"),
)
def stratified_round_robin(spark: SparkSession, folder: str) -> DataFrame:
    return select.round_robin(A.cells(spark, folder), "b1", 32, 1000).select("row", "col", "round")


@register("block_argmax", A.sql("cells", "SELECT row, col, b1 FROM cells QUALIFY row_number() OVER (PARTITION BY row // 3, col // 3 ORDER BY b1 DESC, row, col) = 1"))
def block_argmax(spark: SparkSession, folder: str) -> DataFrame:
    return select.block_best(A.cells(spark, folder), "b1", 3)


@register("spaced_greedy")
def spaced_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy cells by value, no two within two rows and columns of each other."""
    return select.spaced(A.cells(spark, folder), "b1", kernels.square(2))


@register("poisson_disc_greedy")
def poisson_disc_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy cells by value, no two within a distance of 2.8."""
    return select.spaced(A.cells(spark, folder), "b2", kernels.disc(2.8, keep_zero=True))


@register("exponential_race_sample", A.sql("cells", f"SELECT row, col, b1, round(arrival, 12) AS arrival FROM (SELECT row, col, b1, -ln({A.unit_sql(11, 'row', 'col')}) / b1 AS arrival FROM cells WHERE b1 > 0 ORDER BY arrival, row, col LIMIT 1000)"))
def exponential_race_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of 1000 cells without replacement, in proportion to their value (the sample is the feature)."""
    return select.race(A.cells(spark, folder), F.col("b1"), 1000, 11).select("row", "col", "b1", F.round("arrival", 12).alias("arrival"))


@register("blue_noise_sample")
def blue_noise_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted arrival order with an exact spacing of three cells."""
    order = select.race(A.cells(spark, folder), F.col("b1"), 1 << 30, 13).select("row", "col", (-F.col("arrival")).alias("urgency"))
    return select.spaced(order, "urgency", kernels.disc(2.999, keep_zero=True))


@register(
    "snap_argmax_disc",
    A.sql(
        "pred cells",
        """,
o AS (SELECT i::BIGINT AS i, j::BIGINT AS j FROM range(-2, 3) a(i), range(-2, 3) b(j) WHERE i * i + j * j <= 4),
m AS (SELECT c.row, c.col FROM pred p CROSS JOIN o JOIN cells c ON c.row = p.row + i AND c.col = p.col + j WHERE c.b1 > 0
  QUALIFY row_number() OVER (PARTITION BY p.row, p.col ORDER BY c.b1 DESC, c.row, c.col) = 1)
SELECT row, col, count(*)::BIGINT AS dots FROM m GROUP BY 1, 2""",
    ),
)
def snap_argmax_disc(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions moved to the best cell within two cells."""
    return select.snap(A.pred(spark, folder), A.cells(spark, folder), "b1", kernels.disc(2.0, keep_zero=True))


@register(
    "snap_corridor_argmax",
    A.sql(
        "pts cells",
        _SEG + """,
st AS (SELECT id, s::BIGINT AS s, t::BIGINT AS t, round_even(cy + uy * s + ux * t, 0)::BIGINT AS row, round_even(cx + ux * s - uy * t, 0)::BIGINT AS col FROM seg, range(-6, 7) a(s), range(-2, 3) b(t))
SELECT id, s, row, col FROM st JOIN cells USING (row, col) QUALIFY row_number() OVER (PARTITION BY id, s ORDER BY b2 DESC, t) = 1""",
    ),
)
def snap_corridor_argmax(spark: SparkSession, folder: str) -> DataFrame:
    """At each station along a corridor, the best cell across it."""
    st = points.along(_segments(spark, folder), "half", 1.0).withColumn("t", F.explode(F.expr("sequence(-2, 2)")))
    st = st.select("id", F.col("s").cast("long").alias("s"), "t", F.rint(F.col("py") + F.col("ux") * F.col("t")).cast("long").alias("row"), F.rint(F.col("px") - F.col("uy") * F.col("t")).cast("long").alias("col"))
    best = F.min(F.struct((-F.col("b2")).alias("v"), "t", "row", "col")).alias("b")
    return st.join(A.cells(spark, folder), ["row", "col"]).groupBy("id", "s").agg(best).select("id", "s", "b.row", "b.col")


_MASSES = (100, 200, 400, 800, 1600, 3200)


@register(
    "mass_marginal_choice",
    A.sql(
        "cells truth kern",
        """,
cover AS (SELECT t.row + i AS row, t.col + j AS col, max(k) AS k FROM truth t, kern GROUP BY 1, 2),
r AS (SELECT coalesce(k, 0) AS k, row_number() OVER (ORDER BY b2 DESC, row, col) AS rn FROM cells LEFT JOIN cover USING (row, col)),
s AS (SELECT mass, sum(k) AS credit FROM r JOIN (VALUES (100::BIGINT), (200), (400), (800), (1600), (3200)) v(mass) ON rn <= mass GROUP BY mass),
m AS (SELECT mass, credit, (credit - coalesce(lag(credit) OVER (ORDER BY mass), 0)) / (mass - coalesce(lag(mass) OVER (ORDER BY mass), 0)) AS marginal FROM s)
SELECT mass, round(credit, 6) AS credit, round(marginal, 6) AS marginal, marginal > 0.1::DOUBLE AS worth, coalesce(mass = max(mass) FILTER (marginal > 0.1::DOUBLE) OVER (), false) AS chosen FROM m""",
    ),
)
def mass_marginal_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Credit at several budgets of one ordered choice, and the largest budget whose last cells still pay."""
    cover = metric.best_credit(A.truth(spark, folder).withColumn("p", F.lit(1.0)))
    best = select.top_n(A.cells(spark, folder), "b2", max(_MASSES)).join(cover, ["row", "col"], "left")
    # at most 3200 rows by the budget
    ranked = best.withColumn("rn", F.row_number().over(W.orderBy(F.desc("b2"), "row", "col")))
    credit = F.array(*[F.struct(F.lit(m).cast("long").alias("mass"), F.sum(F.when(F.col("rn") <= m, F.coalesce("credit", F.lit(0.0)))).alias("credit")) for m in _MASSES])
    steps = ranked.agg(credit.alias("s")).select(F.explode("s").alias("s")).select("s.mass", "s.credit")
    rows = select.largest_mass(steps, 0.1)
    return rows.select("mass", F.round("credit", 6).alias("credit"), F.round("marginal", 6).alias("marginal"), "worth", "chosen")


@register(
    "chain_segments",
    A.sql(
        "pts",
        _SEG + """,
ends AS (SELECT id, cx + e * ux * 6 AS x, cy + e * uy * 6 AS y, ux, uy FROM seg, (VALUES (-1.0::DOUBLE), (1.0::DOUBLE)) v(e)),
j AS (SELECT p.id AS a, q.id AS b, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM ends p JOIN ends q
  ON p.id < q.id AND abs(p.x - q.x) <= 1.5 AND abs(p.y - q.y) <= 1.5 AND abs(p.ux * q.ux + p.uy * q.uy) >= cos(radians(15)))
SELECT a, b, round(min(d), 6) AS gap FROM j WHERE d <= 1.5 GROUP BY 1, 2""",
    ),
)
def chain_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of segments whose ends nearly meet along one axis."""
    return emission.chains(_segments(spark, folder), 1.5, 15.0).select("a", "b", F.round("gap", 6).alias("gap"))


@register("marginal_emission")
def marginal_emission(spark: SparkSession, folder: str) -> DataFrame:
    """Dots chosen by what they add to the expected credit, until the bar."""
    belief = A.cells(spark, folder).select("row", "col", F.least(F.col("n") / 16.0, F.lit(0.95)).alias("pi"))
    return emission.emit(belief, mass=3000.0, bar=0.6)


@register(
    "expected_credit",
    A.sql(
        "cells pred kern",
        """,
cover AS (SELECT p.row + i AS row, p.col + j AS col, max(k) AS k FROM pred p, kern GROUP BY 1, 2)
SELECT round(sum(least(n / 16.0::DOUBLE, 0.95::DOUBLE) * coalesce(k, 0)), 6) AS credit FROM cells LEFT JOIN cover USING (row, col)""",
    ),
)
def expected_credit(spark: SparkSession, folder: str) -> DataFrame:
    belief = A.cells(spark, folder).select("row", "col", F.least(F.col("n") / 16.0, F.lit(0.95)).alias("pi"))
    return emission.expected_credit(belief, A.pred(spark, folder)).select(F.round("credit", 6).alias("credit"))


@register(
    "first_batch",
    A.sql(
        "cells truth kern",
        """,
w AS (SELECT row, col, least(b1 / 100000, 1) AS w FROM cells WHERE b1 > 0),
cr AS (SELECT w.row + i AS row, w.col + j AS col, sum(w * k) AS gain FROM w, kern GROUP BY 1, 2)
SELECT c.row, c.col, round(coalesce(gain, 0), 6) AS gain, 1::BIGINT AS round FROM cells c LEFT JOIN cr USING (row, col)
WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.row = c.row AND t.col = c.col) ORDER BY round(coalesce(gain, 0), 9) DESC, c.row, c.col LIMIT 300""",
    ),
)
def first_batch(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed mass of 300 dots in one batch (the mass is the feature), outside truth."""
    c = cut(A.cells(spark, folder))  # read three times
    free = c.select("row", "col").join(A.truth(spark, folder), ["row", "col"], "left_anti")
    d = emission.emit_batches(c.select("row", "col", F.least(F.col("b1") / 100000, F.lit(1.0)).alias("w")), free, 300, mass=300)
    return d.select("row", "col", F.round("gain", 6).alias("gain"), "round")


@register("batched_emission")
def batched_emission(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of 200 until no cell gains more than it costs."""
    c = cut(A.cells(spark, folder))  # read twice
    return emission.emit_batches(c.select("row", "col", F.least(F.col("b1") / 100000, F.lit(1.0)).alias("w")), c, 200, suppression=2.0)

"""Queries: distance-weighted scores, credit fields, holdouts, controls and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrastrat.functions.expressions import ALPHA, BETA, EPS, tversky, unit_hash
from terrastrat.operators import kernels, metric, overlap, ranking
from terrastrat.plans import adapters as A
from terrastrat.plans.registry import register

_CREDIT = """,
credit AS (SELECT p.row + i AS row, p.col + j AS col, max(p.p * k) AS credit FROM pred p, kern GROUP BY 1, 2),
cover AS (SELECT t.row + i AS row, t.col + j AS col, max(k) AS cover FROM truth t, kern GROUP BY 1, 2),
rows AS (
  SELECT row, col, coalesce(credit, 0) AS tp, 0::DOUBLE AS fp, 1 AS g, 0 AS n FROM truth LEFT JOIN credit USING (row, col)
  UNION ALL SELECT row, col, 0::DOUBLE, p * (1 - coalesce(cover, 0)), 0, 1 FROM pred LEFT JOIN cover USING (row, col))"""
_TOTALS = """round(sum(tp), 6) AS tp, round(sum(fp), 6) AS fp, round(sum(g) - sum(tp), 6) AS fn, sum(g)::BIGINT AS truth_n,
  sum(n)::BIGINT AS pred_n, round(sum(tp) / (sum(tp) + 0.2::DOUBLE * sum(fp) + 0.8::DOUBLE * (sum(g) - sum(tp)) + 1e-9::DOUBLE), 6) AS dti"""


@register("dti_pooled", A.sql("truth pred kern", f"{_CREDIT}\nSELECT {_TOTALS} FROM rows"))
def dti_pooled(spark: SparkSession, folder: str) -> DataFrame:
    return metric.contributions(A.truth(spark, folder), A.pred(spark, folder)).agg(*metric.totals(None))


_BLOCK = "CASE WHEN row < 128 THEN 0 ELSE 2 END + CASE WHEN col < 128 THEN 0 ELSE 1 END"


@register("dti_by_block", A.sql("truth pred kern", f"{_CREDIT}\nSELECT ({_BLOCK})::BIGINT AS block, {_TOTALS} FROM rows GROUP BY GROUPING SETS ((), (1))"))
def dti_by_block(spark: SparkSession, folder: str) -> DataFrame:
    """Pooled and by spatial block in one pass; the pooled row has a null block."""
    rows = metric.contributions(A.truth(spark, folder), A.pred(spark, folder))
    rows = rows.withColumn("block", F.expr(f"CAST({_BLOCK} AS BIGINT)"))
    return rows.groupingSets([[], ["block"]], "block").agg(*metric.totals(None))


@register("dti_halo_subtiles", A.sql("truth pred kern", f"{_CREDIT}\nSELECT row // 64 AS tile_r, col // 64 AS tile_c, {_TOTALS} FROM rows GROUP BY 1, 2"))
def dti_halo_subtiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = metric.contributions(A.truth(spark, folder), A.pred(spark, folder))
    return rows.groupBy(F.expr("row div 64").alias("tile_r"), F.expr("col div 64").alias("tile_c")).agg(*metric.totals(None))


@register(
    "tversky_from_components",
    A.sql(
        "truth pred kern",
        f"""{_CREDIT},
s AS (SELECT row // 64 AS tile_r, col // 64 AS tile_c, sum(tp) AS t, sum(fp) AS f, sum(g) AS g, sum(n) AS n FROM rows GROUP BY 1, 2),
d AS (SELECT *, t / (t + 0.2::DOUBLE * f + 0.8::DOUBLE * (g - t) + 1e-9::DOUBLE) AS s FROM s)
SELECT tile_r, tile_c, round(s, 6) AS dti, round(0.2::DOUBLE * s, 6) AS marginal_credit, round(300 * (1 - 0.2::DOUBLE * s), 6) AS marginal_metres,
  round(0.2::DOUBLE * s / (1 - 0.2::DOUBLE * s), 6) AS bar, round(s * (0.2::DOUBLE * n + 0.8::DOUBLE * g), 6) AS required_credit,
  round(s * (0.2::DOUBLE * 1.5::DOUBLE + 0.8::DOUBLE) / (1 - 0.2::DOUBLE * s), 6) AS coverage_required,
  round(0.2::DOUBLE * t / (0.2::DOUBLE * f + 0.8::DOUBLE * n + 1e-9::DOUBLE), 6) AS marginal_gain, 0.5::DOUBLE > 0.2::DOUBLE * s * 1.25::DOUBLE AS worth_adding FROM d""",
    ),
)
def tversky_from_components(spark: SparkSession, folder: str) -> DataFrame:
    """Score algebra by tile: the credit that one more cell needs, and by which distance it still earns it."""
    rows = metric.contributions(A.truth(spark, folder), A.pred(spark, folder))
    s = rows.groupBy(F.expr("row div 64").alias("tile_r"), F.expr("col div 64").alias("tile_c")).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "g", "n")])
    t, f, g, n = (F.col(c) for c in ("tp", "fp", "g", "n"))
    s = s.withColumn("s", tversky(t, f, g - t))
    d = F.col("s")
    return s.select(
        "tile_r", "tile_c", F.round(d, 6).alias("dti"), F.round(ALPHA * d, 6).alias("marginal_credit"), F.round(300 * (1 - ALPHA * d), 6).alias("marginal_metres"),
        F.round(ALPHA * d / (1 - ALPHA * d), 6).alias("bar"), F.round(d * (ALPHA * n + BETA * g), 6).alias("required_credit"),
        F.round(d * (ALPHA * 1.5 + BETA) / (1 - ALPHA * d), 6).alias("coverage_required"), F.round(ALPHA * t / (ALPHA * f + BETA * n + EPS), 6).alias("marginal_gain"),
        (F.lit(0.5) > ALPHA * d * 1.25).alias("worth_adding"),
    )


@register(
    "dti_identity_binary",
    A.sql(
        "truth pred kern",
        """,
credit AS (SELECT p.row + i AS row, p.col + j AS col, max(k) AS credit FROM pred p, kern GROUP BY 1, 2),
cover AS (SELECT t.row + i AS row, t.col + j AS col, max(k) AS cover FROM truth t, kern GROUP BY 1, 2),
a AS (SELECT sum(coalesce(credit, 0)) AS t, count(*) AS g FROM truth LEFT JOIN credit USING (row, col)),
b AS (SELECT sum(coalesce(cover, 0)) AS m, count(*) AS n FROM pred LEFT JOIN cover USING (row, col))
SELECT round(t, 6) AS t, round(m, 6) AS m, g::BIGINT AS g, n::BIGINT AS n, round(t / (0.2::DOUBLE * (n - m) + 0.8::DOUBLE * g + 0.2::DOUBLE * t), 6) AS closed_form,
  round(t / (0.2::DOUBLE * n + 0.8::DOUBLE * g), 6) AS short_form FROM a, b""",
    ),
)
def dti_identity_binary(spark: SparkSession, folder: str) -> DataFrame:
    """Closed form for predictions of 0 and 1, beside the short form that holds only where t = m."""
    rows = metric.contributions(A.truth(spark, folder), A.pred(spark, folder).withColumn("p", F.lit(1.0)))
    s = rows.agg(F.sum("tp").alias("t"), (F.sum("n") - F.sum("fp")).alias("m"), F.sum("g").alias("g"), F.sum("n").alias("n"))
    t, m, g, n = (F.col(c) for c in "tmgn")
    return s.select(F.round(t, 6).alias("t"), F.round(m, 6).alias("m"), "g", "n", F.round(t / (ALPHA * (n - m) + BETA * g + ALPHA * t), 6).alias("closed_form"), F.round(t / (ALPHA * n + BETA * g), 6).alias("short_form"))


@register(
    "expected_dti_weighted",
    A.sql(
        "cells pred",
        """,
lev AS (SELECT * FROM (VALUES (0::BIGINT, 1::DOUBLE), (1, 1 - 1::DOUBLE / 3), (2, 1 - sqrt(2::DOUBLE) / 3), (4, 1 - 2::DOUBLE / 3), (5, 1 - sqrt(5::DOUBLE) / 3), (8, 1 - sqrt(8::DOUBLE) / 3)) v(d2, k)),
kern AS (SELECT i::BIGINT AS i, j::BIGINT AS j, i * i + j * j AS d2, 1 - sqrt((i * i + j * j)::DOUBLE) / 3 AS k FROM range(-3, 4) a(i), range(-3, 4) b(j) WHERE i * i + j * j < 9),
q AS (SELECT row, col, least(n / 16.0::DOUBLE, 0.95::DOUBLE) AS q FROM cells),
cov AS (SELECT p.row + i AS row, p.col + j AS col, max(k) AS c FROM pred p, kern GROUP BY 1, 2),
near AS (SELECT p.row, p.col, d2, q FROM pred p, kern JOIN q ON q.row = p.row + i AND q.col = p.col + j),
hit AS (SELECT p.row, p.col, lev.d2, lev.k, 1 - exp(coalesce(sum(ln(1 - q)), 0)) AS h
  FROM pred p CROSS JOIN lev LEFT JOIN near n ON n.row = p.row AND n.col = p.col AND n.d2 <= lev.d2 GROUP BY 1, 2, 3, 4),
e AS (SELECT row, col, sum(h * (k - k_next)) AS best FROM (SELECT *, coalesce(lead(k) OVER (PARTITION BY row, col ORDER BY d2), 0) AS k_next FROM hit) GROUP BY 1, 2),
t AS (SELECT sum(q * coalesce(c, 0)) AS tp, sum(q) AS g FROM q LEFT JOIN cov USING (row, col)),
f AS (SELECT sum(1 - best) AS fp FROM e)
SELECT round(tp, 6) AS tp, round(fp, 6) AS fp, round(g - tp, 6) AS fn, round(tp / (tp + 0.2::DOUBLE * fp + 0.8::DOUBLE * (g - tp) + 1e-9::DOUBLE), 6) AS dti FROM t, f""",
    ),
)
def expected_dti_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Expected score when each cell holds truth with a probability of its own: E[max k] by the kernel's levels."""
    prob = A.cells(spark, folder).select("row", "col", F.least(F.col("n") / 16.0, F.lit(0.95)).alias("q"))
    pred = A.pred(spark, folder).select("row", "col")
    cov = metric.best_credit(pred.withColumn("p", F.lit(1.0)))
    t = prob.join(cov, ["row", "col"], "left").agg(F.sum(F.col("q") * F.coalesce("credit", F.lit(0.0))).alias("tp"), F.sum("q").alias("g"))
    offsets = kernels.disc(3.0)
    levels = sorted({k for *_, k in offsets}, reverse=True)
    logs = [F.coalesce(F.sum(F.when(F.col("k") >= lev - 1e-12, F.log1p(-F.col("q")))), F.lit(0.0)).alias(f"s{i}") for i, lev in enumerate(levels)]
    near = kernels.gather(prob, offsets, logs, ["q"], within=pred)
    best = sum(((1 - F.exp(F.coalesce(f"s{i}", F.lit(0.0)))) * (lev - ([*levels, 0.0][i + 1])) for i, lev in enumerate(levels)), F.lit(0.0))
    f = near.agg(F.sum(1 - best).alias("fp"))
    s = t.join(F.broadcast(f))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("g") - F.col("tp")
    return s.select(F.round(tp, 6).alias("tp"), F.round(fp, 6).alias("fp"), F.round(fn, 6).alias("fn"), F.round(tversky(tp, fp, fn), 6).alias("dti"))


@register("kernel_support_sum", A.sql("pred kern", "SELECT p.row + i AS row, p.col + j AS col, round(sum(k), 6) AS support, count(*)::BIGINT AS n FROM pred p, kern GROUP BY 1, 2"))
def kernel_support_sum(spark: SparkSession, folder: str) -> DataFrame:
    return kernels.spread(A.pred(spark, folder), kernels.disc(3.0), []).groupBy("row", "col").agg(F.round(F.sum("k"), 6).alias("support"), F.count("*").alias("n"))


@register("kernel_credit_max", A.sql("pred kern", "SELECT p.row + i AS row, p.col + j AS col, round(max(p * k), 6) AS credit FROM pred p, kern GROUP BY 1, 2"))
def kernel_credit_max(spark: SparkSession, folder: str) -> DataFrame:
    return metric.best_credit(A.pred(spark, folder)).select("row", "col", F.round("credit", 6).alias("credit"))


@register(
    "spatial_folds",
    A.sql("cells", "SELECT (row // 64) * 4 + col // 64 AS fold, count(*)::BIGINT AS n, round(avg(b2), 6) AS mean_b2 FROM cells GROUP BY 1"),
)
def spatial_folds(spark: SparkSession, folder: str) -> DataFrame:
    return A.cells(spark, folder).groupBy(F.expr("(row div 64) * 4 + col div 64").alias("fold")).agg(F.count("*").alias("n"), F.round(F.avg("b2"), 6).alias("mean_b2"))


@register(
    "macrofold_bbox",
    A.sql(
        "truth",
        """,
b AS (SELECT min(row) AS r0, max(row) + 1 AS r1, min(col) AS c0, max(col) + 1 AS c1 FROM truth)
SELECT ((CASE WHEN row < (r0 + r1) // 2 THEN 0 ELSE 2 END) + (CASE WHEN col < (c0 + c1) // 2 THEN 0 ELSE 1 END))::BIGINT AS fold, count(*)::BIGINT AS n FROM truth, b GROUP BY 1""",
    ),
)
def macrofold_bbox(spark: SparkSession, folder: str) -> DataFrame:
    """Two by two folds over the bounding box of the cells that exist."""
    t = A.truth(spark, folder)
    box = t.agg(F.min("row").alias("r0"), (F.max("row") + 1).alias("r1"), F.min("col").alias("c0"), (F.max("col") + 1).alias("c1"))
    fold = F.expr("CAST(CASE WHEN row < (r0 + r1) div 2 THEN 0 ELSE 2 END + CASE WHEN col < (c0 + c1) div 2 THEN 0 ELSE 1 END AS BIGINT)")
    return t.join(F.broadcast(box)).groupBy(fold.alias("fold")).agg(F.count("*").alias("n"))


_SHIFTS = ((0, 0), (20, 0), (-20, 0), (0, 20), (0, -20))


@register(
    "translation_controls",
    A.sql(
        "truth pred kern",
        """,
sh AS (SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 0::BIGINT), (1, 20, 0), (2, -20, 0), (3, 0, 20), (4, 0, -20)) v(arm, dr, dc)),
arm AS (SELECT arm, row + dr AS row, col + dc AS col, p FROM pred, sh WHERE row + dr BETWEEN 0 AND 255 AND col + dc BETWEEN 0 AND 255),
credit AS (SELECT arm, p.row + i AS row, p.col + j AS col, max(p.p * k) AS credit FROM arm p, kern GROUP BY 1, 2, 3),
cover AS (SELECT t.row + i AS row, t.col + j AS col, max(k) AS cover FROM truth t, kern GROUP BY 1, 2),
rows AS (
  SELECT a.arm, coalesce(credit, 0) AS tp, 0::DOUBLE AS fp, 1 AS g, 0 AS n FROM (SELECT DISTINCT arm FROM arm) a CROSS JOIN truth t LEFT JOIN credit c ON c.arm = a.arm AND c.row = t.row AND c.col = t.col
  UNION ALL SELECT arm, 0::DOUBLE, p * (1 - coalesce(cover, 0)), 0, 1 FROM arm LEFT JOIN cover USING (row, col))
SELECT arm, """
        + _TOTALS
        + " FROM rows GROUP BY arm",
    ),
)
def translation_controls(spark: SparkSession, folder: str) -> DataFrame:
    """The prediction and four copies of it moved without wrapping, scored by one join keyed by arm."""
    arms = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("arm"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for i, (r, c) in enumerate(_SHIFTS)]))
    moved = A.pred(spark, folder).withColumn("_a", arms).select(F.col("_a.arm").alias("arm"), (F.col("row") + F.col("_a.dr")).alias("row"), (F.col("col") + F.col("_a.dc")).alias("col"), "p")
    moved = moved.filter(F.col("row").between(0, 255) & F.col("col").between(0, 255))
    return metric.contributions(A.truth(spark, folder), moved, keys=["arm"]).groupBy("arm").agg(*metric.totals(None))


def _bootstrap_sql(draws: int = 2000, seed: int = 5) -> str:
    arm = lambda n, pred: f"""{n}p AS ({pred}),
{n}cr AS (SELECT p.row + i AS row, p.col + j AS col, max(p.p * k) AS credit FROM {n}p p, kern GROUP BY 1, 2),
{n}r AS (SELECT row, col, coalesce(credit, 0) AS tp, 0::DOUBLE AS fp, 1 AS g FROM truth LEFT JOIN {n}cr USING (row, col)
  UNION ALL SELECT row, col, 0::DOUBLE, p * (1 - coalesce(cover, 0)), 0 FROM {n}p LEFT JOIN cover USING (row, col)),
{n}tl AS (SELECT (row // 64) * 4 + col // 64 AS tile, sum(tp) AS tp{n}, sum(fp) AS fp{n}, sum(g) AS g{n} FROM {n}r GROUP BY 1)"""  # noqa: E731
    score = lambda n: f"tp{n} / (tp{n} + 0.2::DOUBLE * fp{n} + 0.8::DOUBLE * (g{n} - tp{n}) + 1e-9::DOUBLE)"
    names = [f"{c}{n}" for n in "ab" for c in ("tp", "fp", "g")]
    return f""",
cover AS (SELECT t.row + i AS row, t.col + j AS col, max(k) AS cover FROM truth t, kern GROUP BY 1, 2),
{arm("a", "SELECT row, col, p FROM pred")},
{arm("b", "SELECT row + 20 AS row, col, p FROM pred WHERE row + 20 < 256")},
ti AS (SELECT row_number() OVER (ORDER BY tile) - 1 AS slot, count(*) OVER () AS k, {", ".join(f"coalesce({c}, 0) AS {c}" for c in names)} FROM atl FULL JOIN btl USING (tile)),
pk AS (SELECT draw, floor({A.unit_sql(seed, "draw", "i")} * k)::BIGINT AS slot FROM range({draws}) d(draw), (SELECT unnest(range(1, k + 1)) AS i, k FROM (SELECT max(k) AS k FROM ti))),
dr AS (SELECT draw, {", ".join(f"sum({c}) AS {c}" for c in names)} FROM pk JOIN ti USING (slot) GROUP BY 1),
ga AS (SELECT {score("a")} - {score("b")} AS gain FROM dr)
SELECT round(quantile_cont(gain, 0.025), 8) AS low, round(quantile_cont(gain, 0.5), 8) AS median, round(quantile_cont(gain, 0.975), 8) AS high, round(avg((gain > 0)::INT), 8) AS p_better, count(*)::BIGINT AS draws FROM ga"""


@register("paired_bootstrap", A.sql("truth pred kern", _bootstrap_sql()))
def paired_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Interval of the pooled score's gain over a moved control by resampling tiles, both arms on the same draws."""
    return paired(spark, folder, 2000)


def paired(spark: SparkSession, folder: str, draws: int, seed: int = 5) -> DataFrame:
    base = A.pred(spark, folder)
    moved = base.select((F.col("row") + 20).alias("row"), "col", "p").filter("row < 256")
    tile = F.expr("(row div 64) * 4 + col div 64").alias("tile")
    sums = lambda p, s: metric.contributions(A.truth(spark, folder), p).groupBy(tile).agg(*[F.sum(c).alias(f"{c}{s}") for c in ("tp", "fp", "g")])
    tiles = sums(base, "0").join(sums(moved, "1"), "tile", "full").fillna(0)
    count = tiles.agg(F.count("*").alias("k"))
    tiles = tiles.withColumn("slot", F.row_number().over(W.orderBy("tile")) - 1)  # 16 tiles
    picks = spark.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(count)).withColumn("i", F.explode(F.expr("sequence(1L, k)")))
    picks = picks.withColumn("slot", F.floor(unit_hash(F.col("draw"), F.col("i"), seed=seed) * F.col("k")).cast("int"))
    drawn = picks.join(F.broadcast(tiles), "slot").groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("tp0", "fp0", "g0", "tp1", "fp1", "g1")])
    score = lambda s: tversky(F.col(f"tp{s}"), F.col(f"fp{s}"), F.col(f"g{s}") - F.col(f"tp{s}"))
    gain = score("0") - score("1")
    q = F.percentile(gain, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return drawn.agg(q.alias("q"), F.avg((gain > 0).cast("double")).alias("p_better"), F.count("*").alias("draws")).select(
        *[F.round(F.col("q")[i], 8).alias(n) for i, n in enumerate(("low", "median", "high"))], F.round("p_better", 8).alias("p_better"), "draws"
    )


@register(
    "decile_enrichment",
    A.sql(
        "cells truth kern",
        """,
cover AS (SELECT t.row + i AS row, t.col + j AS col, max(k) AS k FROM truth t, kern GROUP BY 1, 2),
e AS (SELECT quantile_cont(b1, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM cells),
s AS (SELECT (len(list_filter(q, lambda x: x <= b1)))::BIGINT AS stratum, coalesce(k, 0) AS k, b2 > 25 AS inside FROM cells LEFT JOIN cover USING (row, col), e)
SELECT stratum, count(*) FILTER (inside)::BIGINT AS n_inside, round(avg(k) FILTER (inside), 6) AS k_inside, round(avg(k) FILTER (NOT inside), 6) AS k_outside,
  round(avg(k) FILTER (inside) / avg(k) FILTER (NOT inside), 6) AS ratio FROM s GROUP BY 1""",
    ),
)
def decile_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    """Mean credit inside against outside a zone, by decile of another field."""
    c = A.cells(spark, folder)
    cover = metric.best_credit(A.truth(spark, folder).withColumn("p", F.lit(1.0)))
    names = [f"q{i}" for i in range(1, 10)]
    edges = ranking.percentiles(c, F.col("b1"), [i / 10 for i in range(1, 10)], names).select(F.array(*names).alias("q"))
    s = c.join(cover, ["row", "col"], "left").join(F.broadcast(edges)).select(
        F.size(F.filter("q", lambda x: x <= F.col("b1"))).cast("long").alias("stratum"), F.coalesce("credit", F.lit(0.0)).alias("k"), (F.col("b2") > 25).alias("inside")
    )
    within, out = F.avg(F.when(F.col("inside"), F.col("k"))), F.avg(F.when(~F.col("inside"), F.col("k")))
    return s.groupBy("stratum").agg(F.count_if("inside").alias("n_inside"), F.round(within, 6).alias("k_inside"), F.round(out, 6).alias("k_outside"), F.round(within / out, 6).alias("ratio"))


@register(
    "channel_screen_lift",
    A.sql(
        "cells truth kern",
        """,
cover AS (SELECT t.row + i AS row, t.col + j AS col, max(k) AS k FROM truth t, kern GROUP BY 1, 2),
l AS (SELECT 'b1' AS channel, row, col, b1 AS v FROM cells UNION ALL SELECT 'b2', row, col, b2 FROM cells),
r AS (SELECT channel, row // 64 AS stratum, coalesce(k, 0) AS k, row_number() OVER (PARTITION BY channel, row // 64 ORDER BY v DESC, row, col) AS rn
  FROM l LEFT JOIN cover USING (row, col))
SELECT channel, stratum, round(avg(k) FILTER (rn <= 100), 6) AS credit_100, round(avg(k) FILTER (rn <= 400), 6) AS credit_400, round(avg(k), 6) AS base,
  round(avg(k) FILTER (rn <= 400) / avg(k), 6) AS lift FROM r GROUP BY 1, 2""",
    ),
)
def channel_screen_lift(spark: SparkSession, folder: str) -> DataFrame:
    """Credit a cell of each channel's best 100 and 400 cells by stratum, against the stratum's mean."""
    c = A.cells(spark, folder)
    cover = metric.best_credit(A.truth(spark, folder).withColumn("p", F.lit(1.0)))
    rows = c.join(cover, ["row", "col"], "left").select("row", "col", F.coalesce("credit", F.lit(0.0)).alias("k"), F.expr("stack(2, 'b1', b1, 'b2', b2) AS (channel, v)"))
    rows = rows.withColumn("stratum", F.expr("row div 64"))
    rn = F.row_number().over(W.partitionBy("channel", "stratum").orderBy(F.desc("v"), "row", "col"))
    rows = rows.withColumn("rn", rn)
    top = lambda n: F.avg(F.when(F.col("rn") <= n, F.col("k")))
    return rows.groupBy("channel", "stratum").agg(F.round(top(100), 6).alias("credit_100"), F.round(top(400), 6).alias("credit_400"), F.round(F.avg("k"), 6).alias("base"), F.round(top(400) / F.avg("k"), 6).alias("lift"))


@register(
    "jaccard_pairs",
    A.sql(
        "artifacts",
        """,
n AS (SELECT a, count(*) AS n FROM artifacts GROUP BY a),
s AS (SELECT x.a AS a, y.a AS b, count(*) AS shared FROM artifacts x JOIN artifacts y ON x.row = y.row AND x.col = y.col AND x.a < y.a GROUP BY 1, 2)
SELECT p.a, q.a AS b, coalesce(shared, 0)::BIGINT AS shared, round(coalesce(shared, 0)::DOUBLE / (p.n + q.n - coalesce(shared, 0)), 6) AS jaccard,
  round(coalesce(shared, 0)::DOUBLE / p.n, 6) AS containment FROM n p JOIN n q ON p.a < q.a LEFT JOIN s ON s.a = p.a AND s.b = q.a""",
    ),
)
def jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.pairs(A.artifacts(spark, folder))


@register(
    "block_occupancy_iou",
    A.sql(
        "artifacts",
        """,
blocks AS (SELECT DISTINCT a, row // 8 AS row, col // 8 AS col FROM artifacts),
n AS (SELECT a, count(*) AS n FROM blocks GROUP BY a),
s AS (SELECT x.a AS a, y.a AS b, count(*) AS shared FROM blocks x JOIN blocks y ON x.row = y.row AND x.col = y.col AND x.a < y.a GROUP BY 1, 2)
SELECT p.a, q.a AS b, coalesce(shared, 0)::BIGINT AS shared, round(coalesce(shared, 0)::DOUBLE / (p.n + q.n - coalesce(shared, 0)), 6) AS jaccard,
  round(coalesce(shared, 0)::DOUBLE / p.n, 6) AS containment FROM n p JOIN n q ON p.a < q.a LEFT JOIN s ON s.a = p.a AND s.b = q.a""",
    ),
)
def block_occupancy_iou(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.pairs(overlap.occupied(A.artifacts(spark, folder), 8))


@register(
    "novelty_2px",
    A.sql(
        "artifacts",
        """,
o AS (SELECT i::BIGINT AS i, j::BIGINT AS j FROM range(-2, 3) a(i), range(-2, 3) b(j) WHERE i * i + j * j <= 4),
prior AS (SELECT DISTINCT row + i AS row, col + j AS col FROM artifacts, o WHERE a < 7)
SELECT count(*)::BIGINT AS n, count(*) FILTER (p.row IS NULL)::BIGINT AS novel, round(count(*) FILTER (p.row IS NULL)::DOUBLE / count(*), 6) AS share
FROM artifacts x LEFT JOIN prior p ON p.row = x.row AND p.col = x.col WHERE x.a = 7""",
    ),
)
def novelty_2px(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the last artifact's cells farther than two cells from all earlier ones."""
    a = A.artifacts(spark, folder)
    return overlap.novelty(a.filter("a = 7"), a.filter("a < 7"), 2.0)


@register(
    "containment_excess",
    A.sql(
        "artifacts",
        """,
area AS (SELECT count(*) AS k FROM (SELECT DISTINCT row, col FROM artifacts)),
n AS (SELECT a, count(*) AS n FROM artifacts GROUP BY a),
s AS (SELECT y.a AS a, count(*) AS shared FROM artifacts x JOIN artifacts y ON x.row = y.row AND x.col = y.col AND x.a = 7 AND y.a < 7 GROUP BY 1)
SELECT n.a, coalesce(shared, 0)::BIGINT AS shared, round(coalesce(shared, 0)::DOUBLE / m.n, 6) AS containment, round(n.n::DOUBLE / k, 6) AS chance,
  round(coalesce(shared, 0)::DOUBLE / m.n - n.n::DOUBLE / k, 6) AS excess FROM n CROSS JOIN area CROSS JOIN (SELECT n FROM n WHERE a = 7) m LEFT JOIN s ON s.a = n.a WHERE n.a < 7""",
    ),
)
def containment_excess(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.excess(A.artifacts(spark, folder), 7)


@register(
    "chance_coverage",
    A.sql(
        "truth pred",
        """,
o AS (SELECT i::BIGINT AS i, j::BIGINT AS j FROM range(-2, 3) a(i), range(-2, 3) b(j) WHERE i * i + j * j <= 4),
halo AS (SELECT DISTINCT row + i AS row, col + j AS col FROM truth, o WHERE row + i BETWEEN 0 AND 255 AND col + j BETWEEN 0 AND 255)
SELECT (SELECT count(*) FROM halo)::BIGINT AS halo_cells, round((SELECT count(*) FROM halo)::DOUBLE / 65536, 6) AS chance,
  round(count(h.row)::DOUBLE / count(*), 6) AS observed FROM pred p LEFT JOIN halo h ON h.row = p.row AND h.col = p.col""",
    ),
)
def chance_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Share of predictions within two cells of truth, beside what scattering them would give."""
    halo = overlap.halo(A.truth(spark, folder), 2.0).filter("row BETWEEN 0 AND 255 AND col BETWEEN 0 AND 255").withColumn("hit", F.lit(1))
    size = halo.agg(F.count("*").alias("halo_cells"))
    seen = A.pred(spark, folder).join(halo, ["row", "col"], "left").agg(F.round(F.count("hit") / F.count("*"), 6).alias("observed"))
    return seen.join(F.broadcast(size)).select("halo_cells", F.round(F.col("halo_cells") / 65536.0, 6).alias("chance"), "observed")


@register(
    "spatial_jaccard",
    A.sql("truth pred", "SELECT count(*) FILTER (t.row IS NOT NULL AND p.row IS NOT NULL)::BIGINT AS shared, count(*)::BIGINT AS either, round(coalesce(count(*) FILTER (t.row IS NOT NULL AND p.row IS NOT NULL)::DOUBLE / nullif(count(*), 0), 1), 6) AS jaccard FROM truth t FULL JOIN pred p ON t.row = p.row AND t.col = p.col"),
)
def spatial_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.jaccard(A.truth(spark, folder), A.pred(spark, folder))


@register(
    "prior_union",
    A.sql("artifacts", "SELECT row, col, count(*)::BIGINT AS priors, min(a) AS first_prior FROM artifacts GROUP BY 1, 2"),
)
def prior_union(spark: SparkSession, folder: str) -> DataFrame:
    """Union of all supports, with how many hold each cell."""
    return A.artifacts(spark, folder).groupBy("row", "col").agg(F.count("*").alias("priors"), F.min("a").alias("first_prior"))


_INSTRUMENTS = """,
tr AS (SELECT 'all' AS instrument, row, col FROM truth UNION ALL SELECT 'even rows', row, col FROM truth WHERE row % 2 = 0 UNION ALL SELECT 'east', row, col FROM truth WHERE col >= 128),
cr AS (SELECT p.row + i AS row, p.col + j AS col, max(p.p * k) AS credit FROM pred p, kern GROUP BY 1, 2),
cv AS (SELECT instrument, t.row + i AS row, t.col + j AS col, max(k) AS cover FROM tr t, kern GROUP BY 1, 2, 3),
a AS (SELECT instrument, sum(coalesce(credit, 0)) AS tp, count(*) AS g FROM tr LEFT JOIN cr USING (row, col) GROUP BY 1),
f AS (SELECT a.instrument, sum(p * (1 - coalesce(cover, 0))) AS fp, count(*) AS n FROM a CROSS JOIN pred p LEFT JOIN cv ON cv.instrument = a.instrument AND cv.row = p.row AND cv.col = p.col GROUP BY 1)
SELECT instrument, round(tp, 6) AS tp, round(fp, 6) AS fp, g::BIGINT AS truth_n, round(tp / (tp + 0.2::DOUBLE * fp + 0.8::DOUBLE * (g - tp) + 1e-9::DOUBLE), 6) AS dti, round(tp / n, 6) AS credit_per_dot, round(tp / g, 6) AS covered,
  round(g / (g + 1e-9::DOUBLE), 6) AS ceiling FROM a JOIN f USING (instrument)"""


@register("all_instruments", A.sql("truth pred kern", _INSTRUMENTS))
def all_instruments(spark: SparkSession, folder: str) -> DataFrame:
    """One prediction against several truths, with the score of the perfect answer to each."""
    t, p = A.truth(spark, folder), A.pred(spark, folder)
    kinds = {"all": F.lit(True), "even rows": F.col("row") % 2 == 0, "east": F.col("col") >= 128}
    some = F.explode(F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in kinds.items()]), lambda x: x.isNotNull()))
    truths = t.withColumn("instrument", some)
    preds = p.withColumn("instrument", F.explode(F.array(*map(F.lit, kinds))))
    rows = metric.contributions(truths, preds, keys=["instrument"], truth_keys=["instrument"])
    own = truths.select("instrument", "row", "col", F.lit(1.0).alias("p"))
    best = metric.contributions(truths, own, keys=["instrument"], truth_keys=["instrument"]).groupBy("instrument").agg(F.round(tversky(F.sum("tp"), F.sum("fp"), F.sum("g") - F.sum("tp")), 6).alias("ceiling"))
    s = rows.groupBy("instrument").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("g").cast("long").alias("truth_n"), F.sum("n").alias("n"))
    s = s.join(best, "instrument")
    return s.select(
        "instrument", F.round("tp", 6).alias("tp"), F.round("fp", 6).alias("fp"), "truth_n", F.round(tversky(F.col("tp"), F.col("fp"), F.col("truth_n") - F.col("tp")), 6).alias("dti"),
        F.round(F.col("tp") / F.col("n"), 6).alias("credit_per_dot"), F.round(F.col("tp") / F.col("truth_n"), 6).alias("covered"), "ceiling",
    )


_EIGHT = """,
link AS (SELECT a.row * 1000 + a.col AS a, b.row * 1000 + b.col AS b FROM truth a JOIN truth b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
reach(id, root) AS (SELECT a, a FROM link WHERE a = b UNION SELECT e.b, r.root FROM reach r JOIN link e ON e.a = r.id),
label AS (SELECT id, min(root) AS c FROM reach GROUP BY id)
SELECT id // 1000 AS row, id % 1000 AS col FROM label WHERE c IN (SELECT c FROM label GROUP BY c HAVING count(*) < 3)"""


@register("matched_frame", A.sql("truth", _EIGHT).replace("WITH ", "WITH RECURSIVE ", 1))
def matched_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Truth without the cells of large patches (here of three cells and more, touching by sides or corners)."""
    return overlap.small_patches(A.truth(spark, folder), 3)


@register(
    "training_sample",
    A.sql("cells truth", f"SELECT row, col, 1::BIGINT AS y FROM truth JOIN (SELECT row, col FROM cells) USING (row, col) UNION ALL SELECT row, col, 0 FROM (SELECT row, col FROM cells ORDER BY {A.unit_sql(31, 'row', 'col')}, row, col LIMIT 500)"),
)
def training_sample(spark: SparkSession, folder: str) -> DataFrame:
    """All positive cells and 500 drawn from all cells (the sample is the feature)."""
    c = A.cells(spark, folder).select("row", "col")
    drawn = c.orderBy(unit_hash(F.col("row"), F.col("col"), seed=31), "row", "col").limit(500)
    return c.join(A.truth(spark, folder), ["row", "col"], "left_semi").withColumn("y", F.lit(1).cast("long")).unionByName(drawn.withColumn("y", F.lit(0).cast("long")))

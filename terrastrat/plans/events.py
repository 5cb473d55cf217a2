"""Queries over points and event catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrastrat.functions.expressions import axial_difference, decode_linear, decode_square, unit_hash, utm
from terrastrat.operators import catalog, cluster, lines, parents, points, ranking, spatial
from terrastrat.plans import adapters as A
from terrastrat.plans.registry import register
from terrastrat.session import cut

_KNN = """,
nn AS (SELECT a.id, a.x, a.y, b.id AS nid, b.x AS nx, b.y AS ny, sqrt(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE) AS d,
  row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rank
  FROM pts a JOIN pts b ON a.id <> b.id AND abs(a.x - b.x) <= 700 AND abs(a.y - b.y) <= 700 QUALIFY rank <= {k})"""
_TRI = """,
tri AS (SELECT id, 0.5::DOUBLE * abs((max(nx) FILTER (rank = 1) - any_value(x)) * (max(ny) FILTER (rank = 2) - any_value(y))
  - (max(ny) FILTER (rank = 1) - any_value(y)) * (max(nx) FILTER (rank = 2) - any_value(x))) AS area, max(d) AS dk FROM nn GROUP BY id)"""


@register(
    "screen_counters",
    A.sql(
        "pts",
        """SELECT count(*)::BIGINT AS n_input, count(*) FILTER (kind <> 'error')::BIGINT AS tectonic, count(*) FILTER (kind <> 'error' AND mag >= 1)::BIGINT AS large,
  count(*) FILTER (kind <> 'error' AND mag >= 1 AND x BETWEEN 100 AND 3999)::BIGINT AS inside, count(*) FILTER (kind <> 'error' AND mag >= 1 AND x BETWEEN 100 AND 3999 AND year(make_timestamp(t_us)) >= 2000)::BIGINT AS recent FROM pts""",
    ),
)
def screen_counters(spark: SparkSession, folder: str) -> DataFrame:
    year = F.year(F.timestamp_micros("t_us"))
    steps = {"tectonic": F.col("kind") != "error", "large": F.col("mag") >= 1, "inside": F.col("x").between(100, 3999), "recent": year >= 2000}
    return catalog.screen(A.pts(spark, folder), steps)[1]


@register(
    "impute_error_sigma",
    A.sql(
        "pts",
        """SELECT id, greatest(CASE WHEN mag - 20 > 0 THEN (mag - 20) / 10 WHEN x < 2048 THEN 5::DOUBLE ELSE 2::DOUBLE END, 0.2::DOUBLE) AS sigma, NOT coalesce(mag - 20 > 0, false) AS imputed FROM pts""",
    ),
)
def impute_error_sigma(spark: SparkSession, folder: str) -> DataFrame:
    """Location errors (here from the value) with era-wise fill-in and a floor."""
    error = (F.col("mag") - 20) / 10
    p = A.pts(spark, folder)
    return p.select("id", catalog.location_error(error, F.col("x"), 2048, 5.0, 2.0, 0.2).alias("sigma"), (~F.coalesce(F.col("mag") - 20 > 0, F.lit(False))).alias("imputed"))


_UTM = A.utm_sql("(-118.0::DOUBLE + x / 2048.0::DOUBLE)", "(37.0::DOUBLE + y / 2048.0::DOUBLE)")


@register("utm_project", A.sql("pts", f"SELECT id, round({_UTM[2]}, 4) AS east, round({_UTM[3]}, 4) AS north FROM (SELECT id, {_UTM[1]} FROM (SELECT id, {_UTM[0]} FROM pts))"))
def utm_project(spark: SparkSession, folder: str) -> DataFrame:
    """Projected metres of points spread over two degrees."""
    lon, lat = -118.0 + F.col("x") / 2048.0, 37.0 + F.col("y") / 2048.0
    east, north = utm(lon, lat)
    return A.pts(spark, folder).select("id", F.round(east, 4).alias("east"), F.round(north, 4).alias("north"))


@register(
    "cell_assign",
    A.sql(
        "pts",
        """SELECT id, floor((4096 - y) / 100.0::DOUBLE)::BIGINT AS row, floor(x / 100.0::DOUBLE)::BIGINT AS col, round((4096 - y) / 100.0::DOUBLE, 6) AS frac_row, round(x / 100.0::DOUBLE, 6) AS frac_col,
  100.0::DOUBLE * floor(x / 100.0::DOUBLE) + 50 AS centre_x, round_even((4096 - y) / 100.0::DOUBLE, 0)::BIGINT AS near_row FROM pts""",
    ),
)
def cell_assign(spark: SparkSession, folder: str) -> DataFrame:
    """Floor and nearest cells, fractional places and centres."""
    p = A.pts(spark, folder)
    row, col = spatial.cells_of(F.col("x"), F.col("y"), 0.0, 4096.0, 100.0)
    fr, fc = (4096 - F.col("y")) / 100.0, F.col("x") / 100.0
    return p.select("id", row.alias("row"), col.alias("col"), F.round(fr, 6).alias("frac_row"), F.round(fc, 6).alias("frac_col"), (100.0 * col + 50).alias("centre_x"), F.rint(fr).cast("long").alias("near_row"))


@register(
    "anti_radius_screen",
    A.sql("pts", "SELECT a.id, a.x, a.y FROM pts a WHERE a.kind <> 'error' AND NOT EXISTS (SELECT 1 FROM pts b WHERE b.kind = 'error' AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600)"),
)
def anti_radius_screen(spark: SparkSession, folder: str) -> DataFrame:
    p = A.pts(spark, folder)
    return spatial.outside_radius(p.filter("kind <> 'error'"), p.filter("kind = 'error'"), 40.0).select("id", "x", "y")


@register(
    "semi_valid_cells",
    A.sql("pts cells", "SELECT id, y // 16 AS row, x // 16 AS col FROM pts WHERE EXISTS (SELECT 1 FROM cells c WHERE c.row = y // 16 AND c.col = x // 16)"),
)
def semi_valid_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Events on cells that exist."""
    p = A.pts(spark, folder).select("id", F.expr("y div 16").alias("row"), F.expr("x div 16").alias("col"))
    return p.join(A.cells(spark, folder).select("row", "col"), ["row", "col"], "left_semi").select("id", "row", "col")


@register(
    "nearest_distance_capped",
    A.sql(
        "pts",
        """,
j AS (SELECT a.id, b.id AS nid, sqrt(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE) AS d FROM pts a JOIN pts b ON a.kind <> 'error' AND b.kind = 'error' AND abs(a.x - b.x) <= 100 AND abs(a.y - b.y) <= 100),
m AS (SELECT id, min({'d': d, 'n': nid}) AS b FROM j WHERE d <= 100 GROUP BY id)
SELECT p.id, m.b.n AS nearest, round(m.b.d, 6) AS d FROM pts p LEFT JOIN m ON m.id = p.id WHERE p.kind <> 'error'""",
    ),
)
def nearest_distance_capped(spark: SparkSession, folder: str) -> DataFrame:
    p = A.pts(spark, folder)
    return spatial.nearest_within(p.filter("kind <> 'error'"), p.filter("kind = 'error'"), 100.0).withColumn("d", F.round("d", 6))


@register("knn3_triangle_area", A.sql("pts", _KNN.format(k=2) + _TRI + "\nSELECT id, area FROM tri"))
def knn3_triangle_area(spark: SparkSession, folder: str) -> DataFrame:
    near = spatial.knn(A.pts(spark, folder), 2)
    return near.groupBy("id").agg(points.triangle_area("x", "y").alias("area"))


@register("normalized_triangle", A.sql("pts", _KNN.format(k=20) + _TRI + "\nSELECT id, round(area / greatest(dk * dk, 1e-12::DOUBLE), 6) AS stat FROM tri"))
def normalized_triangle(spark: SparkSession, folder: str) -> DataFrame:
    """Triangle area over the squared distance of the 20th neighbour: free of scale."""
    near = spatial.knn(A.pts(spark, folder), 20, ranks=[1, 2, 20])
    rows = near.groupBy("id").agg(points.triangle_area("x", "y").alias("area"), F.max("d").alias("dk"))
    return rows.select("id", F.round(F.col("area") / F.greatest(F.col("dk") * F.col("dk"), F.lit(1e-12)), 6).alias("stat"))


_NULL_TRI = f""",
xs AS (SELECT x, row_number() OVER (ORDER BY {A.unit_sql(1, "id")}, id) AS rn FROM pts),
ys AS (SELECT y, row_number() OVER (ORDER BY {A.unit_sql(2, "id")}, id) AS rn FROM pts),
nul AS (SELECT rn AS id, x, y FROM xs JOIN ys USING (rn)),"""
_TWO = """
{o} AS (SELECT id, x, y, arg_min({{'x': qx, 'y': qy}}, {{'d': (x - qx) * (x - qx) + (y - qy) * (y - qy), 'i': bid}}, 2) AS q
  FROM (SELECT a.id, a.x, a.y, b.x AS qx, b.y AS qy, b.id AS bid FROM {t} a JOIN {t} b ON a.id <> b.id AND abs(a.x - b.x) <= 700 AND abs(a.y - b.y) <= 700) GROUP BY 1, 2, 3),
{o}_a AS (SELECT id, 0.5::DOUBLE * abs((q[1].x - x) * (q[2].y - y) - (q[1].y - y) * (q[2].x - x)) AS area FROM {o})"""


@register("triangle_null_permuted", A.sql("pts", _NULL_TRI + _TWO.format(o="n2", t="nul") + "," + _TWO.format(o="p2", t="pts") + "\nSELECT id, area, area <= (SELECT quantile_cont(area, 0.05) FROM n2_a) AS kept FROM p2_a"))
def triangle_null_permuted(spark: SparkSession, folder: str) -> DataFrame:
    """Points whose triangle is smaller than the 5th percentile over points with x and y dealt apart by hash order."""
    p = cut(A.pts(spark, folder).select("id", "x", "y"))
    xs = ranking.numbered(p.select("x", "id", unit_hash(F.col("id"), seed=1).alias("u")), "u", "id").select("x", "rn")
    ys = ranking.numbered(p.select("y", "id", unit_hash(F.col("id"), seed=2).alias("u")), "u", "id").select("y", "rn")
    null = xs.join(ys, "rn").select(F.col("rn").alias("id"), "x", "y")
    area = lambda q: spatial.knn(q, 2).groupBy("id").agg(points.triangle_area("x", "y").alias("area"))
    limit = ranking.percentiles(area(null), F.col("area"), [0.05], ["limit"])
    return area(p).join(F.broadcast(limit)).select("id", "area", (F.col("area") <= F.col("limit")).alias("kept"))


@register(
    "time_parent_eta",
    A.sql(
        "pts",
        """,
j AS (SELECT a.id, b.id AS parent, log10(greatest((a.t_us - b.t_us) / 86400e6::DOUBLE, 1.0::DOUBLE / 86400)) + 1.6::DOUBLE * log10(greatest(sqrt(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE), 0.1::DOUBLE)) - b.mag / 100 AS eta
  FROM pts a JOIN pts b ON b.t_us < a.t_us AND abs(a.x - b.x) <= 120 AND abs(a.y - b.y) <= 120 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 14400)
SELECT id, round(min(eta), 6) AS log_eta, arg_min(parent, {'e': round(eta, 9), 'p': parent}) AS parent FROM j GROUP BY id""",
    ),
)
def time_parent_eta(spark: SparkSession, folder: str) -> DataFrame:
    """The earlier event within reach of the least time x distance^1.6 x 10^(-b m)."""
    return parents.parents(A.pts(spark, folder), 120.0).withColumn("log_eta", F.round("log_eta", 6))


@register(
    "sequence_thin",
    A.sql("pts", "SELECT id, x, y, mag FROM pts QUALIFY row_number() OVER (PARTITION BY x // 250, y // 250, t_us // 864000000000 ORDER BY mag DESC, id) = 1"),
)
def sequence_thin(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.sequence_thin(A.pts(spark, folder), 250, 10).select("id", "x", "y", "mag")


@register(
    "year_cell_dedupe",
    A.sql("pts", "SELECT id, x // 250 AS cx, y // 250 AS cy, month(make_timestamp(t_us))::BIGINT AS era FROM pts QUALIFY row_number() OVER (PARTITION BY x // 250, y // 250, month(make_timestamp(t_us)) ORDER BY id) = 1"),
)
def year_cell_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """The first event of each cell and calendar period."""
    keys = [F.expr("x div 250").alias("cx"), F.expr("y div 250").alias("cy"), F.month(F.timestamp_micros("t_us")).cast("long").alias("era")]
    return catalog.first_of(A.pts(spark, folder), keys, ["id"]).select("id", *keys)


_MC = """,
b AS (SELECT {g} floor(mag / 0.1::DOUBLE)::BIGINT AS b, count(*) AS n FROM {t} WHERE mag IS NOT NULL GROUP BY ALL)
SELECT {g} sum(n)::BIGINT AS n, round((arg_min(b, {{'n': -n, 'b': b}}) + 0.5::DOUBLE) * 0.1::DOUBLE + 0.2::DOUBLE, 6) AS mc FROM b GROUP BY ALL"""


@register("completeness_magnitude", A.sql("pts", _MC.format(g="kind,", t="pts")))
def completeness_magnitude(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.completeness(A.pts(spark, folder).dropna(subset=["mag"]), ["kind"])


@register("completeness_by_epoch", A.sql("pts", ",\ne AS (SELECT epoch, mag FROM pts JOIN (VALUES (1::BIGINT), (8), (15)) v(epoch) ON day(make_timestamp(t_us)) >= epoch)" + _MC.format(g="epoch,", t="e") + " HAVING sum(n) > 200"))
def completeness_by_epoch(spark: SparkSession, folder: str) -> DataFrame:
    """Completeness of all events from each start on, for starts with more than 200."""
    epochs = F.explode(F.array(*[F.lit(v).cast("long") for v in (1, 8, 15)]))
    p = A.pts(spark, folder).dropna(subset=["mag"]).withColumn("epoch", epochs).filter(F.dayofmonth(F.timestamp_micros("t_us")) >= F.col("epoch"))
    return catalog.completeness(p, ["epoch"]).filter("n > 200")


@register("type_counts", A.sql("pts", "SELECT kind, count(*)::BIGINT AS n, row_number() OVER (ORDER BY count(*) DESC, kind)::BIGINT AS place FROM pts GROUP BY kind"))
def type_counts(spark: SparkSession, folder: str) -> DataFrame:
    n = A.pts(spark, folder).groupBy("kind").agg(F.count("*").alias("n"))
    return ranking.numbered(n, F.desc("n"), "kind", out="place")


_AXIS = """,
s AS (SELECT {key}, count(*) AS n, sum({w}) AS w, sum({w} * {x}) AS sx, sum({w} * {y}) AS sy, sum({w} * {x} * {x}) AS sxx, sum({w} * {y} * {y}) AS syy, sum({w} * {x} * {y}) AS sxy FROM {t} GROUP BY 1),
c AS (SELECT *, (sxx / w - sx / w * sx / w){f} AS a, (syy / w - sy / w * sy / w){f} AS c, (sxy / w - sx / w * sy / w){f} AS b FROM s),
e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, greatest((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 0::DOUBLE) AS l2 FROM c)"""
_NEAR = """,
near AS (SELECT a.id, (b.x - a.x)::DOUBLE AS dx, (b.y - a.y)::DOUBLE AS dy, b.mag, b.t_us FROM pts a JOIN pts b ON abs(a.x - b.x) <= 150 AND abs(a.y - b.y) <= 150 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 22500)"""


@register(
    "pca2_neighbourhood",
    A.sql("pts", _NEAR + _AXIS.format(key="id", w="1::DOUBLE", x="dx", y="dy", t="near", f=" * w / greatest(w - 1, 1)") + "\nSELECT id, n::BIGINT AS n, round(l1, 4) AS l1, round(l2, 4) AS l2, round(1 - l2 / nullif(l1, 0), 6) AS linearity FROM e"),
)
def pca2_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    """Sample covariance axes of each point's neighbours within 150 units, itself included."""
    e = points.disc_axes(A.pts(spark, folder), 150.0, divisor="n-1")
    return e.select("id", "n", F.round("l1", 4).alias("l1"), F.round("l2", 4).alias("l2"), F.round(1 - F.try_divide("l2", "l1"), 6).alias("linearity"))


@register(
    "pca2_weighted",
    A.sql("pts", _NEAR + _AXIS.format(key="id", w="(1 / pow(greatest(mag, 1), 2))", x="dx", y="dy", t="near", f="") + "\nSELECT id, n::BIGINT AS n, round(l1, 4) AS l1, round(l2, 4) AS l2, round(sx / w, 5) AS mean_dx, round((l1 - l2) / nullif(l1 + l2, 0), 6) AS contrast FROM e"),
)
def pca2_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """As above, weighted by the inverse square of each neighbour's error."""
    e = points.disc_axes(A.pts(spark, folder), 150.0, 1 / F.pow(F.greatest("mag", F.lit(1.0)), F.lit(2.0)))
    return e.select("id", "n", F.round("l1", 4).alias("l1"), F.round("l2", 4).alias("l2"), F.round("cx", 5).alias("mean_dx"), F.round(F.try_divide(F.col("l1") - F.col("l2"), F.col("l1") + F.col("l2")), 6).alias("contrast"))


@register(
    "cluster_inertia",
    A.sql(
        "pts",
        ",\nl AS (SELECT (x // 512) * 8 + y // 512 AS label, x - 512 * (x // 512) AS lx, y - 512 * (y // 512) AS ly, mag FROM pts)" + _AXIS.format(key="label", w="greatest(mag, 0)", x="lx", y="ly", t="l", f="")
        + "\nSELECT label, n::BIGINT AS n, round(sx / w, 5) AS cx, round(sy / w, 5) AS cy, round(4 * sqrt(l1), 5) AS length, round(1 - sqrt(l2) / sqrt(l1), 6) AS anisotropy FROM e",
    ),
)
def cluster_inertia(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted inertia of labelled clusters: centre, length and anisotropy."""
    p = A.pts(spark, folder).select(F.expr("(x div 512) * 8 + y div 512").alias("label"), (F.col("x") % 512).alias("lx"), (F.col("y") % 512).alias("ly"), "mag")
    e = points.axis(p, ["label"], "lx", "ly", F.greatest("mag", F.lit(0.0)))
    return e.select("label", "n", F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"), F.round(4 * F.sqrt("l1"), 5).alias("length"), F.round(1 - F.sqrt("l2") / F.sqrt("l1"), 6).alias("anisotropy"))


_HOUGH = """,
v AS (SELECT theta::BIGINT AS theta, floor((x * cos(theta * (pi() / 36)) + y * sin(theta * (pi() / 36))) / 128.0::DOUBLE + 1e-9)::BIGINT AS rho, count(*)::DOUBLE AS votes FROM pts, range(36) t(theta) GROUP BY 1, 2)"""


def _votes(spark: SparkSession, folder: str) -> DataFrame:
    p = A.pts(spark, folder).select((F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))
    return points.hough(p, 36, 128.0)


@register("hough_votes", A.sql("pts", _HOUGH.replace(" + 1e-9", "") + "\nSELECT theta, rho, votes FROM v"))
def hough_votes(spark: SparkSession, folder: str) -> DataFrame:
    return _votes(spark, folder)


@register(
    "hough_peaks",
    A.sql("pts", _HOUGH.replace(" + 1e-9", "") + "\nSELECT a.theta, a.rho, a.votes FROM v a LEFT JOIN v l ON l.theta = a.theta AND l.rho = a.rho - 1 LEFT JOIN v r ON r.theta = a.theta AND r.rho = a.rho + 1 WHERE a.votes >= 50 AND a.votes > coalesce(l.votes, 0) AND a.votes >= coalesce(r.votes, 0)"),
)
def hough_peaks(spark: SparkSession, folder: str) -> DataFrame:
    return points.hough_peaks(_votes(spark, folder), 50.0)


@register(
    "hough_span_runs",
    A.sql(
        "pts",
        """,
g AS (SELECT y // 64 AS line, x, coalesce((x - lag(x) OVER (PARTITION BY y // 64 ORDER BY x, id) > 48)::INT, 1) AS new, id FROM pts),
r AS (SELECT line, x, sum(new) OVER (PARTITION BY line ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT line, run::BIGINT AS run, min(x) AS first, max(x) AS last, count(*)::BIGINT AS n FROM r GROUP BY 1, 2""",
    ),
)
def hough_span_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs along strips in which neighbouring events are at most 48 units apart."""
    p = A.pts(spark, folder).select(F.expr("y div 64").alias("line"), "x")
    return points.spans(p, ["line"], "x", 48.0)


@register(
    "corridor_three",
    A.sql(
        "pts",
        ",\nl AS (SELECT (x // 512) * 8 + y // 512 AS label, x - 512 * (x // 512) AS lx, y - 512 * (y // 512) AS ly, mag FROM pts)" + _AXIS.format(key="label", w="1::DOUBLE", x="lx", y="ly", t="l", f="")
        + """,
a AS (SELECT label, sx / w AS cx, sy / w AS cy, cos(0.5::DOUBLE * atan2(2 * b, a - c)) AS ux, sin(0.5::DOUBLE * atan2(2 * b, a - c)) AS uy, sqrt(l2) AS hw FROM e)
SELECT label, kind, round(s * 30 / tan(radians(60)), 6) AS "offset", round(cx - uy * s * 30 / tan(radians(60)), 5) AS cx, round(cy + ux * s * 30 / tan(radians(60)), 5) AS cy, round(hw, 5) AS half_width
FROM a, (VALUES (0::BIGINT, 0::DOUBLE), (1, 1), (2, -1)) v(kind, s)""",
    ),
)
def corridor_three(spark: SparkSession, folder: str) -> DataFrame:
    p = A.pts(spark, folder).select(F.expr("(x div 512) * 8 + y div 512").alias("label"), (F.col("x") % 512).alias("lx"), (F.col("y") % 512).alias("ly"))
    rows = points.corridors(points.axis(p, ["label"], "lx", "ly"), F.lit(30.0), F.sqrt("l2"))
    return rows.select("label", "kind", F.round("offset", 6).alias("offset"), F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"), F.round("half_width", 5).alias("half_width"))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments on the grid from large events: centre, axis from the id, half length and width."""
    angle = (F.col("id") % 8) * 0.3926990816987241 + 0.01
    p = A.pts(spark, folder).filter("kind = 'purchase'")
    return p.select("id", (F.col("x") / 16.0).alias("cx"), (F.col("y") / 16.0).alias("cy"), F.cos(angle).alias("ux"), F.sin(angle).alias("uy"), F.lit(6.0).alias("half"), F.lit(1.5).alias("width"), "mag")


_SEG = """,
seg AS (SELECT id, x / 16.0::DOUBLE AS cx, y / 16.0::DOUBLE AS cy, cos((id % 8) * 0.3926990816987241::DOUBLE + 0.01::DOUBLE) AS ux, sin((id % 8) * 0.3926990816987241::DOUBLE + 0.01::DOUBLE) AS uy, mag FROM pts WHERE kind = 'purchase')"""


@register(
    "segment_sample_paint",
    A.sql("pts", _SEG + "\nSELECT floor(cy + uy * s)::BIGINT AS row, floor(cx + ux * s)::BIGINT AS col, count(*)::BIGINT AS n, round(sum(mag), 4) AS weight, round(max(mag), 4) AS best FROM seg, (SELECT i * 0.5::DOUBLE AS s FROM range(-12, 13) t(i)) GROUP BY 1, 2"),
)
def segment_sample_paint(spark: SparkSession, folder: str) -> DataFrame:
    """Cells under sampled centre lines, with summed and largest weight."""
    s = points.along(_segments(spark, folder), "half", 0.5)
    cell = [F.floor("py").cast("long").alias("row"), F.floor("px").cast("long").alias("col")]
    return s.groupBy(*cell).agg(F.count("*").alias("n"), F.round(F.sum("mag"), 4).alias("weight"), F.round(F.max("mag"), 4).alias("best"))


@register(
    "rect_union_paint",
    A.sql(
        "pts",
        _SEG + """,
hit AS (SELECT id, mag, r::BIGINT AS row, c::BIGINT AS col FROM seg, range(-10, 270) a(r), range(-10, 270) b(c)
  WHERE r BETWEEN cy - 8 AND cy + 8 AND c BETWEEN cx - 8 AND cx + 8 AND abs((c - cx) * ux + (r - cy) * uy) <= 6 AND abs((r - cy) * ux - (c - cx) * uy) <= 1.5)
SELECT row, col, count(*)::BIGINT AS n, round(max(mag), 4) AS best FROM hit GROUP BY 1, 2""",
    ),
)
def rect_union_paint(spark: SparkSession, folder: str) -> DataFrame:
    """Cells inside the union of rotated rectangles."""
    return points.rectangles(_segments(spark, folder), "half", "width").groupBy("row", "col").agg(F.count("*").alias("n"), F.round(F.max("mag"), 4).alias("best"))


@register(
    "area_median_dedupe",
    A.sql("pts", "SELECT kind AS area, y // 256 AS row, x // 256 AS col, median(x) AS x, median(y) AS y, round(median(mag), 6) AS anomaly, count(*)::BIGINT AS n FROM pts GROUP BY 1, 2, 3"),
)
def area_median_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    p = A.pts(spark, folder)
    return p.groupBy(F.col("kind").alias("area"), F.expr("y div 256").alias("row"), F.expr("x div 256").alias("col")).agg(
        F.median("x").alias("x"), F.median("y").alias("y"), F.round(F.median("mag"), 6).alias("anomaly"), F.count("*").alias("n")
    )


@register(
    "within_area_warm_marks",
    A.sql(
        "pts",
        """,
q AS (SELECT kind, quantile_cont(mag, 0.9) AS q, count(mag) AS n FROM pts GROUP BY kind),
r AS (SELECT id, kind, mag, rank() OVER (PARTITION BY kind ORDER BY mag) + (count(*) OVER (PARTITION BY kind, mag) - 1) / 2.0::DOUBLE AS rank FROM pts)
SELECT r.id, r.kind AS area, round(r.rank / q.n, 6) AS rank, mag >= q.q AS warm FROM r JOIN q ON q.kind = r.kind WHERE q.n >= 12""",
    ),
)
def within_area_warm_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Average-tie rank of each value inside its area and whether it reaches the area's 90th percentile, by one sort over all areas."""
    p = A.pts(spark, folder).select("id", "kind", "mag")
    areas = ranking.grouped_percentiles(p, "kind", F.col("mag"), [0.9], ["q"]).filter("n >= 12")
    placed = ranking.numbered(p.dropna(subset=["mag"]), "kind", "mag", "id", out="_rn")
    base = placed.groupBy("kind").agg((F.min("_rn") - 1).alias("_b"))
    ties = placed.groupBy(F.col("kind").alias("_k"), F.col("mag").alias("_m")).agg((F.min("_rn") + (F.count("*") - 1) / 2.0).alias("_r"))
    rows = placed.join(ties, (F.col("kind") == F.col("_k")) & (F.col("mag") == F.col("_m"))).join(areas.join(base, "kind"), "kind")
    rank = F.round((F.col("_r") - F.col("_b")) / F.col("n"), 6)
    return rows.select("id", F.col("kind").alias("area"), rank.alias("rank"), (F.col("mag") >= F.col("q")).alias("warm"))


_COMP = """,
edge AS (SELECT a.id AS a, b.id AS b FROM {t} a JOIN {t} b ON abs(a.x - b.x) <= {r} AND abs(a.y - b.y) <= {r} AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {r} * {r}),
reach(id, root) AS (SELECT a, a FROM edge UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.id)"""


@register("radius_components", A.sql("pts", ",\nq AS (SELECT * FROM pts WHERE kind = 'error')" + _COMP.format(t="q", r=30) + "\nSELECT id, min(root) AS component FROM reach GROUP BY id").replace("WITH ", "WITH RECURSIVE ", 1))
def radius_components(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.radius_components(A.pts(spark, folder).filter("kind = 'error'"), 30.0)


@register("dbscan", A.sql("pts", """,
near AS (SELECT a.id AS a, b.id AS b, sqrt(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE) AS d FROM pts a JOIN pts b ON abs(a.x - b.x) <= 30 AND abs(a.y - b.y) <= 30 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
link AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT e.b, r.root FROM reach r JOIN link e ON e.a = r.id),
label AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id),
border AS (SELECT a AS id, arg_min(cluster, {'d': d, 'b': b}) AS cluster FROM near JOIN label ON label.id = b WHERE a NOT IN (FROM core) GROUP BY a)
SELECT p.id, l.id IS NOT NULL AS core, coalesce(l.cluster, b.cluster) AS cluster FROM pts p LEFT JOIN label l ON l.id = p.id LEFT JOIN border b ON b.id = p.id""").replace("WITH ", "WITH RECURSIVE ", 1))
def dbscan(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.dbscan(A.pts(spark, folder), 30.0, 5)


@register("gardner_knopoff")
def gardner_knopoff(spark: SparkSession, folder: str) -> DataFrame:
    """Aftershock windows by magnitude, largest event first (values scaled to magnitudes 1 to 5)."""
    p = A.pts(spark, folder)
    mag = F.least(1.0 + F.greatest(F.coalesce("mag", F.lit(0.0)), F.lit(0.0)) / 50.0, F.lit(5.0))
    return cluster.aftershock_windows(p.select("id", (F.col("x") / 1.0).alias("x"), (F.col("y") / 1.0).alias("y"), (F.col("t_us") / 86400e6).alias("t_days"), mag.alias("mag")))


@register("gmm_threshold")
def gmm_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Threshold between two normal components of the log parent distance."""
    eta = time_parent_eta(spark, folder)
    return spark.createDataFrame([cluster.mixture_threshold(eta, "log_eta")])


@register(
    "quantised_decode",
    A.sql("cells", "SELECT row, col, CASE WHEN n > 0 THEN round(-5 + (n - 1) / 254.0::DOUBLE * 15, 6) END AS linear, CASE WHEN n > 0 THEN round(pow((n - 1) / 254.0::DOUBLE, 2) * 40, 6) END AS squared FROM cells"),
)
def quantised_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-coded layers, linear and by square root (counts stand in for codes)."""
    return A.cells(spark, folder).select("row", "col", F.round(decode_linear(F.col("n"), -5.0, 10.0), 6).alias("linear"), F.round(decode_square(F.col("n"), 40.0), 6).alias("squared"))


@register(
    "axial_differences",
    A.sql("pts", "SELECT id, round(least(abs(x - y)::DOUBLE % 180, 180 - abs(x - y)::DOUBLE % 180), 6) AS degrees, round(((degrees(atan2(x::DOUBLE, y::DOUBLE)) % 180) + 180) % 180, 6) AS azimuth FROM pts"),
)
def axial_differences(spark: SparkSession, folder: str) -> DataFrame:
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return A.pts(spark, folder).select("id", F.round(axial_difference(x, y), 6).alias("degrees"), F.round(F.pmod(F.degrees(F.atan2(x, y)), F.lit(180.0)), 6).alias("azimuth"))


_SPINE = ",\nl AS (SELECT (x // 512) * 8 + y // 512 AS label, x - 512 * (x // 512) AS lx, y - 512 * (y // 512) AS ly FROM pts)" + _AXIS.format(key="label", w="1::DOUBLE", x="lx", y="ly", t="l", f="")


@register(
    "cluster_spines",
    A.sql(
        "pts",
        _SPINE
        + """,
a AS (SELECT label, sx / w AS cx, sy / w AS cy, cos(0.5::DOUBLE * atan2(2 * b, a - c)) AS ux, sin(0.5::DOUBLE * atan2(2 * b, a - c)) AS uy FROM e WHERE n >= 15),
p AS (SELECT label, a.*, (lx - cx) * ux + (ly - cy) * uy AS s, (ly - cy) * ux - (lx - cx) * uy AS v FROM l JOIN a USING (label)),
g AS (SELECT *, min(s) OVER (PARTITION BY label) AS lo, (max(s) OVER (PARTITION BY label) - min(s) OVER (PARTITION BY label)) / 6 AS step FROM p),
m AS (SELECT label, least(floor((s - lo) / step + 1e-9::DOUBLE), 5)::BIGINT AS bin, quantile_cont(v, 0.5) AS m, any_value(lo) AS lo, any_value(step) AS step, any_value(cx) AS cx, any_value(cy) AS cy, any_value(ux) AS ux, any_value(uy) AS uy
  FROM g WHERE step > 0 GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT label, bin, round(cx + (lo + (bin + 0.5::DOUBLE) * step) * ux - m * uy, 4) AS x, round(cy + (lo + (bin + 0.5::DOUBLE) * step) * uy + m * ux, 4) AS y FROM m""",
    ),
)
def cluster_spines(spark: SparkSession, folder: str) -> DataFrame:
    """Bent centre lines of labelled clusters."""
    p = A.pts(spark, folder).select(F.expr("(x div 512) * 8 + y div 512").alias("label"), (F.col("x") % 512).alias("x"), (F.col("y") % 512).alias("y"))
    return points.spines(p, "label", bins=6).select("label", "bin", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@register(
    "seismicity_corridors",
    A.sql(
        "pts",
        """,
sd AS (SELECT DISTINCT (x // 128 + 0.5::DOUBLE) * 128 AS sx, (y // 128 + 0.5::DOUBLE) * 128 AS sy FROM pts),
near AS (SELECT sx * 10000 + sy AS id, sx, sy, x - sx AS dx, y - sy AS dy FROM sd JOIN pts ON abs(x - sx) <= 150 AND abs(y - sy) <= 150 AND (x - sx) * (x - sx) + (y - sy) * (y - sy) <= 22500)"""
        + _AXIS.format(key="id", w="1::DOUBLE", x="dx", y="dy", t="near", f="").replace("s AS (SELECT id,", "s AS (SELECT id, any_value(near.sx) AS seed_x, any_value(near.sy) AS seed_y,")
        + """,
a AS (SELECT *, sx / w AS cx, sy / w AS cy, cos(0.5::DOUBLE * atan2(2 * b, a - c)) AS ux, sin(0.5::DOUBLE * atan2(2 * b, a - c)) AS uy, l1 / (l1 + l2) AS lin FROM e WHERE n >= 4),
t AS (SELECT a.id, quantile_cont((dx - cx) * ux + (dy - cy) * uy, 0.95) - quantile_cont((dx - cx) * ux + (dy - cy) * uy, 0.05) AS len FROM near JOIN a USING (id) WHERE lin >= 0.7::DOUBLE GROUP BY 1)
SELECT seed_x, seed_y, n::BIGINT AS n, round(seed_x + cx, 4) AS cx, round(seed_y + cy, 4) AS cy, round(lin, 6) AS linearity, round(len, 4) AS length FROM a JOIN t USING (id) WHERE len >= 100""",
    ),
)
def seismicity_corridors(spark: SparkSession, folder: str) -> DataFrame:
    """Straight, long and well-sampled neighbourhoods of the cells that hold events."""
    c = points.seeded_corridors(A.pts(spark, folder), 128.0, 150.0, 4, 0.7, 100.0)
    return c.select("seed_x", "seed_y", "n", *[F.round(x, d).alias(x) for x, d in (("cx", 4), ("cy", 4), ("linearity", 6), ("length", 4))])


_ELONGATED = ",\nl AS (SELECT (x // 256) * 16 + y // 256 AS label, x - 256 * (x // 256) AS lx, y - 256 * (y // 256) AS ly FROM pts)" + _AXIS.format(key="label", w="1::DOUBLE", x="lx", y="ly", t="l", f=" * w / greatest(w - 1, 1)")


@register(
    "elongation_test",
    A.sql(
        "pts",
        _ELONGATED
        + """,
a AS (SELECT *, sx / w AS cx, sy / w AS cy, cos(0.5::DOUBLE * atan2(2 * b, a - c)) AS ux, sin(0.5::DOUBLE * atan2(2 * b, a - c)) AS uy, l1 / greatest(l2, 1e-9::DOUBLE) AS ratio FROM e WHERE n >= 3),
k AS (SELECT *, pow(2 * sqrt(ratio) / (1 + ratio), n - 2) AS p FROM a WHERE ratio >= 1.5::DOUBLE),
sp AS (SELECT label, (quantile_cont((lx - cx) * ux + (ly - cy) * uy, 0.95) - quantile_cont((lx - cx) * ux + (ly - cy) * uy, 0.05)) / 2 AS half FROM l JOIN k USING (label) WHERE p <= 0.5::DOUBLE GROUP BY 1)
SELECT label, n::BIGINT AS n, round(ratio, 5) AS ratio, round(p, 6) AS p, round(half, 5) AS half_length FROM k JOIN sp USING (label) WHERE half > 0""",
    ),
)
def elongation_test(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled clusters longer than chance, by the exact distribution of the ratio of variances."""
    p = A.pts(spark, folder).select(F.expr("(x div 256) * 16 + y div 256").alias("label"), (F.col("x") % 256).alias("x"), (F.col("y") % 256).alias("y"))
    e = lines.elongated(p, "label", least=3, ratio=1.5, p_most=0.5)
    return e.select("label", "n", F.round("ratio", 5).alias("ratio"), F.round("p", 6).alias("p"), F.round("half_length", 5).alias("half_length"))


@register("cluster_lineations")
def cluster_lineations(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of near points cut into thin parts, with the elongated ones' corridors."""
    p = cut(A.pts(spark, folder).select("id", "x", "y"))
    found = cluster.dbscan(p, 120.0, 4).filter("cluster is not null")
    return lines.cluster_lineations(p.join(found, "id"), "cluster", 40.0, least=6, ratio=2.0, p_most=0.2)


@register("merged_corridors")
def merged_corridors(spark: SparkSession, folder: str) -> DataFrame:
    """Seeded corridors united along their lines."""
    c = points.seeded_corridors(A.pts(spark, folder), 128.0, 150.0, 4, 0.8, 100.0)
    named = c.select((F.col("seed_x") * 10000 + F.col("seed_y")).cast("long").alias("id"), "n", "cx", "cy", "ux", "uy", (F.col("length") / 2).alias("half"), F.lit(10.0).alias("width"))
    return lines.merge_corridors(named, 60.0, 15.0)

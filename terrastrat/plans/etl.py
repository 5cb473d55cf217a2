"""Queries that start from text files: the event frame and its report, and error summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.operators import etl, points, ranking
from terrastrat.plans import adapters as A
from terrastrat.plans.registry import register
from terrastrat.session import cut, shared_folder
from terrastrat.sources import files
from terrastrat.sources.tables import table

_UTM = A.utm_sql("longitude", "latitude")
_EVENTS = f""",
ev AS (SELECT id, t_us, 37.3::DOUBLE + y / 1024.0::DOUBLE AS latitude, -119.0::DOUBLE + x / 1024.0::DOUBLE AS longitude, (id * 37 % 30)::DOUBLE AS depth, mag / 10 AS mag,
  CASE WHEN kind <> 'error' THEN 'earthquake' WHEN id % 10 = 0 THEN 'quarry blast' ELSE 'sonic boom' END AS type, CASE WHEN id % 5 > 0 THEN (id % 23) / 2.0::DOUBLE END AS err FROM pts),
pl AS (SELECT *, floor((4508550::DOUBLE - y) / 100)::BIGINT AS row, floor((x - 243350::DOUBLE) / 100)::BIGINT AS col FROM (
  SELECT * EXCLUDE (xi, eta), round({_UTM[2]}, 3) AS x, round({_UTM[3]}, 3) AS y FROM (SELECT * EXCLUDE (t, l), {_UTM[1]} FROM (SELECT *, {_UTM[0]} FROM ev)))),
ok AS (SELECT *, type = 'earthquake' AS k1, coalesce(mag >= 1, false) AS k2, coalesce(err <= 10, true) AS k3, depth < 25 AS k4, row BETWEEN 0 AND 3729 AND col BETWEEN 0 AND 3291 AS k5 FROM pl),
hot AS (SELECT DISTINCT 243350::DOUBLE + (s_suppkey * 7919 % 3292) * 100 AS x, 4508550::DOUBLE - (s_suppkey * 104729 % 3730) * 100 AS y FROM supplier WHERE s_suppkey % 2 = 0),
a1 AS (SELECT * FROM ok e WHERE k1 AND k2 AND k3 AND k4 AND k5 AND NOT EXISTS (SELECT 1 FROM pl s WHERE s.type = 'quarry blast' AND (s.x - e.x) * (s.x - e.x) + (s.y - e.y) * (s.y - e.y) <= 9000000)),
a2 AS (SELECT * FROM a1 e WHERE NOT EXISTS (SELECT 1 FROM hot s WHERE (s.x - e.x) * (s.x - e.x) + (s.y - e.y) * (s.y - e.y) <= 4000000)),
a3 AS (SELECT * FROM a2 QUALIFY row_number() OVER (PARTITION BY floor(x / 250), floor(y / 250), t_us // 7776000000000 ORDER BY mag DESC, id) = 1),
box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM a3),
num AS (SELECT row_number() OVER (ORDER BY id) AS id FROM a3),
nul AS (SELECT id, x0 + (id * 0.7548776662466927::DOUBLE - floor(id * 0.7548776662466927::DOUBLE)) * (x1 - x0) AS x, y0 + (id * 0.5698402909980532::DOUBLE - floor(id * 0.5698402909980532::DOUBLE)) * (y1 - y0) AS y FROM num, box),
two AS (SELECT w, id, x, y, arg_min({{'x': qx, 'y': qy}}, {{'d': sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)), 'i': bid}}, 2) AS q FROM (
  SELECT 'p' AS w, a.id, a.x, a.y, b.x AS qx, b.y AS qy, b.id AS bid FROM a3 a JOIN a3 b ON a.id <> b.id
  UNION ALL SELECT 'n', a.id, a.x, a.y, b.x, b.y, b.id FROM nul a JOIN nul b ON a.id <> b.id) GROUP BY ALL),
tri AS (SELECT w, id, 0.5::DOUBLE * abs((q[1].x - x) * (q[2].y - y) - (q[1].y - y) * (q[2].x - x)) AS area FROM two),
a4 AS (SELECT * FROM a3 WHERE id IN (SELECT id FROM tri WHERE w = 'p' AND area <= (SELECT quantile_cont(area, 0.95) FROM tri WHERE w = 'n')))"""


def _frame(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The events written as text in the wide format, read back with the hot places, and made into a frame."""
    where = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    p = A.pts(spark, folder)
    kind = F.when(F.col("kind") != "error", "earthquake").when(F.col("id") % 10 == 0, "quarry blast").otherwise("sonic boom")
    wide = p.select(
        F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), (37.3 + F.col("y") / 1024.0).alias("latitude"),
        (-119.0 + F.col("x") / 1024.0).alias("longitude"), (F.col("id") * 37 % 30).cast("double").alias("depth"), (F.col("mag") / 10).alias("mag"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 23 / 2.0).alias("horizontalError"), kind.alias("type"), F.col("id").cast("string").alias("id"),
    )
    wide.write.option("header", True).option("compression", "gzip").csv(f"{where}/events")
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    centres = s.select((243350.0 + F.col("k") * 7919 % 3292 * 100).alias("utm_x"), (4508550.0 - F.col("k") * 104729 % 3730 * 100).alias("utm_y"), F.when(F.col("k") % 2 == 0, "Hot").otherwise("Warm").alias("thermalclass"))
    centres.write.option("header", True).csv(f"{where}/centres")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    typed = cut(files.read_events_csv(spark, f"{where}/events").withColumn("id", F.col("id").cast("long")))
    return etl.event_frame(typed, files.read_centres(spark, f"{where}/centres"))


@register("event_frame", A.sql("pts", _EVENTS + "\nSELECT id, row, col, x, y, round(mag, 6) AS mag, greatest(CASE WHEN err > 0 THEN err ELSE 2 END, 0.2::DOUBLE) AS sigma_km FROM a4"))
def event_frame(spark: SparkSession, folder: str) -> DataFrame:
    """From compressed CSV to the declustered frame."""
    return _frame(spark, folder)[0].select("id", "row", "col", "x", "y", F.round("mag", 6).alias("mag"), "sigma_km")


@register(
    "event_frame_report",
    A.sql(
        "pts",
        _EVENTS
        + """
SELECT count(*)::BIGINT AS n_input, count(*) FILTER (k1)::BIGINT AS tectonic, count(*) FILTER (k1 AND k2)::BIGINT AS large, count(*) FILTER (k1 AND k2 AND k3)::BIGINT AS located,
  count(*) FILTER (k1 AND k2 AND k3 AND k4)::BIGINT AS shallow, count(*) FILTER (k1 AND k2 AND k3 AND k4 AND k5)::BIGINT AS inside, (SELECT count(*) FROM a1)::BIGINT AS off_sites,
  (SELECT count(*) FROM a2)::BIGINT AS off_hot, (SELECT count(*) FROM a3)::BIGINT AS thinned, (SELECT count(*) FROM a4)::BIGINT AS declustered FROM ok""",
    ),
)
def event_frame_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many events each step leaves."""
    return _frame(spark, folder)[1]


@register(
    "error_summary",
    A.sql(
        "pts",
        """SELECT kind, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.1), 6) AS p10, round(quantile_cont(e, 0.9), 6) AS p90, count(*) FILTER (bad)::BIGINT AS n_fallback
FROM (SELECT kind, NOT coalesce(mag > 5, false) AS bad, CASE WHEN coalesce(mag > 5, false) THEN mag ELSE 2::DOUBLE END AS e FROM pts) GROUP BY 1""",
    ),
)
def error_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of location errors by kind, with the count of those filled in."""
    good = F.coalesce(F.col("mag") > 5, F.lit(False))
    rows = A.pts(spark, folder).select("kind", (~good).alias("bad"), F.when(good, F.col("mag")).otherwise(2.0).alias("e"))
    q = ranking.grouped_percentiles(rows, "kind", F.col("e"), [0.5, 0.1, 0.9], ["median", "p10", "p90"]).drop("n")
    bad = rows.groupBy("kind").agg(F.count_if("bad").alias("n_fallback"))
    return q.join(bad, "kind").select("kind", *[F.round(c, 6).alias(c) for c in ("median", "p10", "p90")], "n_fallback")


_VOLUME = """,
e AS (SELECT id, x, y, (t_us // 86400000000 % 365) * 20 AS z FROM pts WHERE kind = 'error'),
zs AS (SELECT s, z, row_number() OVER (PARTITION BY s ORDER BY u, id) AS rn FROM (SELECT s, id, z, CASE s WHEN 1 THEN {u1} WHEN 2 THEN {u2} ELSE {u3} END AS u FROM e, range(1, 4) r(s))),
ids AS (SELECT id, x, y, row_number() OVER (ORDER BY id) AS rn FROM e),
c AS (SELECT 0 AS s, id, x, y, z FROM e UNION ALL SELECT s, id, x, y, z FROM zs JOIN ids USING (rn)),
q AS (SELECT s, id, x, y, z, arg_min({{'x': qx, 'y': qy, 'z': bz}}, {{'d': (x - qx) * (x - qx) + (y - qy) * (y - qy) + (z - bz) * (z - bz), 'i': bid}}, 3) AS q FROM (
  SELECT a.s, a.id, a.x, a.y, a.z, b.x AS qx, b.y AS qy, b.z AS bz, b.id AS bid FROM c a JOIN c b ON a.s = b.s AND a.id <> b.id) GROUP BY ALL),
v AS (SELECT s, id, abs((q[1].x - x) * ((q[2].y - y) * (q[3].z - z) - (q[2].z - z) * (q[3].y - y)) - (q[1].y - y) * ((q[2].x - x) * (q[3].z - z) - (q[2].z - z) * (q[3].x - x))
  + (q[1].z - z) * ((q[2].x - x) * (q[3].y - y) - (q[2].y - y) * (q[3].x - x))) / 6.0::DOUBLE AS volume FROM q),
w AS (SELECT o.id, any_value(o.volume) AS volume, count(*) FILTER (n.volume < o.volume) / 3.0::DOUBLE AS p FROM v o JOIN v n ON n.id = o.id AND o.s = 0 AND n.s > 0 GROUP BY 1)
SELECT id, round(volume, 4) AS volume, round(p, 6) AS p, p <= 0.35::DOUBLE AS kept FROM w""".format(u1=A.unit_sql(41, "id"), u2=A.unit_sql(42, "id"), u3=A.unit_sql(43, "id"))


@register("space_time_volume", A.sql("pts", _VOLUME))
def space_time_volume(spark: SparkSession, folder: str) -> DataFrame:
    """Volumes of each event and its three nearest in space and time, against catalogues with times dealt anew."""
    e = A.pts(spark, folder).filter("kind = 'error'").select("id", "x", "y", (F.expr("t_us div 86400000000") % 365 * 20).alias("z"))
    return points.volume_test(e, "z", seeds=[41, 42, 43], most=0.35).select("id", F.round("volume", 4).alias("volume"), F.round("p", 6).alias("p"), "kept")

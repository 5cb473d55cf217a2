"""The event catalogue from typed records to a screened, projected, thinned and declustered frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastrat.functions.expressions import utm
from terrastrat.operators import catalog, points, ranking, spatial
from terrastrat.session import cut

#: Fixed value: event kinds whose places are sites of human work.
SITES = ("quarry blast", "explosion", "mining explosion", "nuclear explosion", "chemical explosion", "mine collapse", "anthropogenic event")


@dataclass(frozen=True)
class Rules:
    """Screens of :func:`event_frame`; places in metres."""

    kinds: tuple[str, ...] = ()
    least_mag: float = 1.0
    most_error_km: float = 10.0
    depth_km: tuple[float, float] = (-1000.0, 25.0)
    left: float = 243_350.0
    top: float = 4_508_550.0
    cell: float = 100.0
    rows: int = 3730
    cols: int = 3292
    site_m: float = 3000.0
    hot_m: float = 2000.0
    thin_m: float = 250.0
    thin_days: float = 90.0
    quantile: float | None = 0.95


def triangle_areas(points_of: DataFrame, key: str = "id") -> DataFrame:
    """``(key, area)`` of each point's triangle with its two nearest others."""
    return spatial.knn(points_of, 2, key).groupBy(key).agg(points.triangle_area("x", "y").alias("area"))


def uniform_null(points_of: DataFrame) -> DataFrame:
    """``(id, x, y)``: as many points spread evenly over the bounding box, by two additive recurrences."""
    box = points_of.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    numbers = ranking.numbered(points_of.select("id"), "id").select(F.col("rn").alias("id"))
    part = lambda a: F.col("id") * a - F.floor(F.col("id") * a)
    # fixed values: powers of the inverse of the plastic number
    u, v = part(0.7548776662466927), part(0.5698402909980532)
    rows = numbers.join(F.broadcast(box))
    return rows.select("id", (F.col("x0") + u * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + v * (F.col("y1") - F.col("y0"))).alias("y"))


def event_frame(events: DataFrame, hot: DataFrame | None = None, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """(frame, report) of typed events ``(id, time, latitude, longitude, depth, mag, type, horizontalError)``.

    In order: kinds, magnitude, location error (a missing one passes), depth, the grid's rectangle,
    distance from sites of human work and from *hot* places ``(x, y)``, the largest event of each cell
    and time window, and triangles no larger than a quantile of those of evenly spread points (no test
    if it is None). frame: ``(id, row, col, x, y, depth, mag, t_days, sigma_km)``. report: one row of
    counters, the rows left after each step. Screens before the sites are counted in one pass.
    """
    x, y = utm(F.col("longitude"), F.col("latitude"))
    placed = events.withColumns({"x": F.round(x, 3), "y": F.round(y, 3)})
    kind = F.coalesce(F.lower(F.trim("type")), F.lit(""))
    row, col = spatial.cells_of(F.col("x"), F.col("y"), rules.left, rules.top, rules.cell)
    inside: Column = row.between(0, rules.rows - 1) & col.between(0, rules.cols - 1)
    steps = {
        "tectonic": kind.isin(*rules.kinds) if rules.kinds else ~kind.isin(*catalog.NOT_TECTONIC),
        "large": F.col("mag") >= rules.least_mag,
        "located": F.coalesce(F.col("horizontalError") <= rules.most_error_km, F.lit(True)),
        "shallow": (F.col("depth") > rules.depth_km[0]) & (F.col("depth") < rules.depth_km[1]),
        "inside": inside,
    }
    kept, counters = catalog.screen(placed, steps)
    year, t = F.year("time"), F.unix_micros("time")
    sigma = catalog.location_error(F.col("horizontalError"), year, 1984, 5.0, 2.0, 0.2)
    kept = kept.select("id", row.alias("row"), col.alias("col"), "x", "y", "depth", "mag", t.alias("t_us"), (t / 86_400e6).alias("t_days"), sigma.alias("sigma_km"))
    counts = {}

    def count(rows: DataFrame, name: str) -> DataFrame:
        rows = cut(rows)
        counts[name] = rows.agg(F.count("*").alias(name))
        return rows

    sites = placed.filter(kind.isin(*SITES)).select("x", "y").dropna()
    kept = count(spatial.outside_radius(kept, sites, rules.site_m), "off_sites")
    if hot is not None:
        kept = count(spatial.outside_radius(kept, hot, rules.hot_m), "off_hot")
    kept = count(catalog.sequence_thin(kept, rules.thin_m, rules.thin_days), "thinned")
    if rules.quantile is not None:
        limit = ranking.percentiles(triangle_areas(uniform_null(kept)), F.col("area"), [rules.quantile], ["_limit"])
        small = triangle_areas(kept).join(F.broadcast(limit)).filter("area <= _limit").select("id")
        kept = count(kept.join(small, "id", "left_semi"), "declustered")
    report = counters
    for one in counts.values():
        report = report.join(F.broadcast(one))
    return kept.drop("t_us"), report

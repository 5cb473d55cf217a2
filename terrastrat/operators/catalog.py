"""Event catalogues: parsing, screens with counters, imputation, thinning, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: event kinds of human origin or otherwise not tectonic.
NOT_TECTONIC = (
    "quarry blast", "explosion", "mining explosion", "nuclear explosion", "chemical explosion", "sonic boom", "other event",
    "landslide", "mine collapse", "acoustic noise", "rock burst", "not reported", "anthropogenic event",
)


def screen(events: DataFrame, steps: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row of counters ``n_input, <step>...``): rows left after each step, in one pass; null fails."""
    passed, columns = F.lit(True), [F.count("*").alias("n_input")]
    for name, rule in steps.items():
        passed = passed & F.coalesce(rule, F.lit(False))
        columns.append(F.count_if(passed).alias(name))
    return events.filter(passed), events.agg(*columns)


def location_error(error: Column, year: Column, break_year: int, early: float, late: float, floor: float) -> Column:
    """Missing or non-positive errors imputed by era, with a floor."""
    return F.greatest(F.when(error > 0, error).otherwise(F.when(year < break_year, early).otherwise(late)), F.lit(floor))


def first_of(events: DataFrame, keys: list[Column], order: list) -> DataFrame:
    """One row of each key: the first in a total order."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = events.withColumns(dict(zip(names, keys, strict=True)))
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*names).orderBy(*order))).filter("_rn = 1").drop("_rn", *names)


def sequence_thin(events: DataFrame, cell: float, days: float) -> DataFrame:
    """The largest event of each (cell, time window); ties to the lesser id."""
    step = F.lit(int(days * 86_400_000_000))
    keys = [F.floor(F.col("x") / F.lit(float(cell))), F.floor(F.col("y") / F.lit(float(cell))), F.floor(F.col("t_us") / step)]
    return first_of(events, keys, [F.desc("mag"), F.asc("id")])


def completeness(events: DataFrame, groups: list[str] = (), width: float = 0.1) -> DataFrame:
    """Maximum-curvature completeness: the middle of the fullest magnitude bin (the first one of equals) plus 0.2."""
    binned = events.withColumn("_b", F.floor(F.col("mag") / width).cast("long")).groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    top = F.min(F.struct((-F.col("_n")).alias("a"), F.col("_b").alias("b")))
    return binned.groupBy(*groups).agg(top.alias("_t"), F.sum("_n").alias("n")).select(*groups, "n", F.round((F.col("_t.b") + 0.5) * width + 0.2, 6).alias("mc"))


#: Fixed format: ``id "time" lat lon depth mag relocated``.
_LINE = r'^\s*(\d+)\s+"([^"]+)"\s+(-?[\d.]+)\s+(-?[\d.]+)\s+(-?[\d.]+)\s+(-?[\d.]+)\s+([01])\s*$'


def parse_relocated(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Typed events from lines ``value`` of a relocated catalogue; header and blank lines are skipped.

    strict: a malformed line or a place off the globe raises; otherwise such lines are left out.
    """
    v = F.col("value")
    part = lambda i, kind: F.regexp_extract(v, _LINE, i).try_cast(kind)
    rows = lines.filter((F.trim(v) != "") & ~v.startswith("evid"))
    rows = rows.select(
        v.alias("_line"),
        part(1, "long").alias("id"),
        F.try_to_timestamp(F.regexp_extract(v, _LINE, 2)).alias("time"),
        part(3, "double").alias("lat"),
        part(4, "double").alias("lon"),
        part(5, "double").alias("depth_km"),
        part(6, "double").alias("mag"),
        part(7, "tinyint").alias("relocated"),
    )
    good = F.coalesce(F.col("id").isNotNull() & F.col("time").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False))
    if not strict:
        return rows.filter(good).drop("_line")
    checked = F.when(good, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("malformed event: "), F.col("_line"))).cast("long"))
    return rows.withColumn("id", checked).drop("_line")

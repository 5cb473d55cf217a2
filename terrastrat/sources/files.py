"""Readers and writers of catalogues, layers and supports, with their checks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.operators.catalog import parse_relocated

#: Fixed format: the columns of the wide event table.
EVENT_SCHEMA = (
    "time TIMESTAMP, latitude DOUBLE, longitude DOUBLE, depth DOUBLE, mag DOUBLE, magType STRING, nst INT, gap DOUBLE, dmin DOUBLE, rms DOUBLE, "
    "net STRING, id STRING, updated TIMESTAMP, place STRING, type STRING, horizontalError DOUBLE, depthError DOUBLE, magError DOUBLE, magNst INT, "
    "status STRING, locationSource STRING, magSource STRING"
)
REQUIRED = ("time", "latitude", "longitude", "depth", "mag", "type")


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    """The wide event table from CSV, compressed or not; values that don't parse are null, missing columns an error."""
    head = spark.read.option("header", True).csv(path).columns
    missing = [c for c in REQUIRED if c not in head]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    raw = spark.read.option("header", True).csv(path)
    kinds = dict(x.split(" ") for x in EVENT_SCHEMA.split(", "))
    return raw.select(*[(F.try_to_timestamp(c) if k == "TIMESTAMP" else F.col(c).try_cast(k)).alias(c) if c in head else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])


def read_relocated(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Events of a relocated catalogue in text, compressed or not."""
    return parse_relocated(spark.read.text(path), strict)


def read_centres(spark: SparkSession, path: str, kind: str = "Hot") -> DataFrame:
    """Distinct finite places of one thermal class; empty if the class column is missing."""
    raw = spark.read.option("header", True).csv(path)
    if "thermalclass" not in raw.columns:
        return spark.createDataFrame([], "x double, y double")
    rows = raw.filter(F.trim("thermalclass") == kind).select(F.col("utm_x").try_cast("double").alias("x"), F.col("utm_y").try_cast("double").alias("y"))
    return rows.dropna().filter(~F.isnan("x") & ~F.isnan("y")).distinct()


def digest(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256, md5)`` of each file, hashed where it is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def content_digest(df: DataFrame) -> DataFrame:
    """One row that changes with the rows' content but not with their order."""
    return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("bits"))


def write_support(cells: DataFrame, path: str, tile: int = 256) -> None:
    """Cells ``(row, col, p)`` by tile; values outside 0..1 or not finite are an error."""
    bad = F.col("p").isNull() | F.isnan("p") | ~F.col("p").between(0, 1)
    checked = cells.withColumn("p", F.when(bad, F.raise_error("a probability is outside 0..1").cast("double")).otherwise(F.col("p")))
    tiled = checked.withColumns({"tile_r": F.expr(f"row div {tile}"), "tile_c": F.expr(f"col div {tile}")})
    tiled.repartition("tile_r", "tile_c").write.mode("overwrite").partitionBy("tile_r", "tile_c").parquet(path)


def audit_support(cells: DataFrame) -> DataFrame:
    """Counts and range of a written support in one pass."""
    p = F.col("p")
    return cells.agg(
        F.count("*").alias("n"), F.count_if(p > 0).alias("positive"), F.count_if(p.isNull() | F.isnan(p)).alias("missing"),
        F.count_if((p < 0) | (p > 1)).alias("outside"), F.min(p).alias("least"), F.max(p).alias("most"), F.count_distinct("row", "col").alias("cells"),
    )


def check_masks(labels: DataFrame, template: DataFrame) -> None:
    """Raises unless labels are 0 or 1 on exactly the template's cells."""
    a, b = labels.select("row", "col", "label", F.lit(1).alias("a")), template.select("row", "col", F.lit(1).alias("b"))
    bad = a.join(b, ["row", "col"], "full").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()), F.count_if(~F.col("label").isin(0, 1))).first()
    if bad[0] or bad[1]:
        raise ValueError(f"{bad[0]} cells are on one mask only, {bad[1]} labels are neither 0 nor 1")


def read_split(spark: SparkSession, path: str, tag: str) -> dict:
    """A holdout specification in JSON whose schema tag must be *tag*."""
    spec = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if spec.get("schema") != tag:
        raise ValueError(f"expected the schema {tag}, found {spec.get('schema')}")
    return spec


def receipt(df: DataFrame) -> DataFrame:
    """Rows as strict JSON: NaN becomes null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))

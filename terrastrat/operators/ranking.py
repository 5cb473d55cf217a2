"""Global order statistics without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrastrat.session import cut


def numbered(df: DataFrame, *order, out: str = "rn") -> DataFrame:
    """Rows numbered from 1 in a total order: ranges are sorted apart and the sizes of earlier ones added.

    The order must be total for the numbers to be reproducible.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = ranged.join(F.broadcast(before), "_part")
    inside = F.bitwiseAND(F.col("_at"), F.lit((1 << 33) - 1)) if hasattr(F, "bitwiseAND") else F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn(out, F.col("_before") + inside + 1).drop("_part", "_at", "_before")


def average_ranks(df: DataFrame, value: str, out: str, order: list) -> DataFrame:
    """Ranks from 1 with ties averaged: every value's first number plus half its other rows."""
    ranked = numbered(df, F.asc(value), *order, out="_rn")
    ties = ranked.groupBy(F.col(value).alias("_v")).agg((F.min("_rn") + (F.count("*") - 1) / 2.0).alias(out))
    return ranked.join(ties, F.col(value).eqNullSafe(F.col("_v"))).drop("_rn", "_v")


def _whole(df: DataFrame) -> Column:
    """``_h``: a hash of the whole row, to tell rows of equal value apart where they are dealt out."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_h")


def percentiles(df: DataFrame, value: Column, at: list[float], names: list[str]) -> DataFrame:
    """One row of exact interpolated percentiles, nulls left out: rows are numbered and those at the two places picked.

    Rows of one value are dealt apart by a hash of the whole row, so a value that most rows have fills many tasks.
    """
    rows = numbered(df.select(value.cast("double").alias("_v"), _whole(df)).filter("_v is not null"), F.asc("_v"), "_h", out="_rn")
    n = rows.agg(F.count("*").alias("_n"))
    spot = F.array(*[F.struct((F.lit(q) * (F.col("_n") - 1)).alias("p"), F.lit(i).alias("i")) for i, q in enumerate(at)])
    spots = n.select(F.explode(spot).alias("s")).select("s.i", F.floor("s.p").alias("lo"), (F.col("s.p") - F.floor("s.p")).alias("f"))
    low = F.max(F.when(F.col("_rn") == F.col("lo") + 1, F.col("_v")))
    high = F.max(F.when(F.col("_rn") == F.col("lo") + 2, F.col("_v")))
    met = rows.join(F.broadcast(spots), (F.col("_rn") >= F.col("lo") + 1) & (F.col("_rn") <= F.col("lo") + 2))  # as many rows as places
    met = met.groupBy("i").agg(low.alias("lo"), high.alias("hi"), F.max("f").alias("f"))
    q = F.when((F.col("f") == 0) | F.col("hi").isNull(), F.col("lo")).otherwise(F.col("lo") * (1 - F.col("f")) + F.col("hi") * F.col("f"))
    return met.select("i", q.alias("q")).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(name) for i, name in enumerate(names)])


def grouped_percentiles(df: DataFrame, key: str, value: Column, at: list[float], names: list[str]) -> DataFrame:
    """``(key, n, names)``: exact interpolated percentiles of each key's values, nulls left out, by one sort over all keys.

    A key's rows, and those of one value, may lie in many tasks; what is joined back are two places a percentile and key.
    """
    rows = numbered(df.select(key, value.cast("double").alias("_v"), _whole(df)).filter("_v is not null"), F.asc_nulls_first(key), F.asc("_v"), "_h", out="_rn")
    sizes = rows.groupBy(F.col(key).alias("_k")).agg((F.min("_rn") - 1).alias("_b"), F.count("*").alias("n"))
    spot = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(q) * (F.col("n") - 1)).alias("p"), F.lit(j).alias("j")) for i, q in enumerate(at) for j in (0, 1)])
    spots = sizes.select("_k", "n", "_b", F.explode(spot).alias("s"))
    spots = spots.select("_k", "n", "s.i", "s.j", (F.col("s.p") - F.floor("s.p")).alias("f"), (F.col("_b") + F.least(F.floor("s.p") + F.col("s.j"), F.col("n") - 1) + 1).alias("_rn"))
    met = spots.join(rows.select("_rn", "_v"), "_rn").groupBy("_k", "n").agg(
        *[F.sum(F.when(F.col("i") == i, F.col("_v") * F.when(F.col("j") == 0, 1 - F.col("f")).otherwise(F.col("f")))).alias(name) for i, name in enumerate(names)]
    )
    return met.withColumnRenamed("_k", key).select(key, "n", *names)

"""Boosted trees under spatially blocked validation, and permutation importance."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.functions.expressions import unit_hash
from terrastrat.operators.fit import auc
from terrastrat.operators.ranking import numbered
from terrastrat.session import cut


def fitted(rows: DataFrame, features: list[str], rounds: int = 8, seed: int = 3):
    """A model of ``y`` from *features*, negatives weighted down to the positives' mass."""
    share = rows.agg(F.avg("y")).first()[0] or 0.5
    ready = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(rows)
    ready = ready.withColumn("_w", F.when(F.col("y") == 1, 1.0).otherwise(share / max(1 - share, 1e-9)))
    return GBTClassifier(featuresCol="_x", labelCol="y", weightCol="_w", maxIter=rounds, maxDepth=4, seed=seed).fit(ready)


def scored(model, rows: DataFrame, features: list[str]) -> DataFrame:
    ready = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(rows)
    out = model.transform(ready).withColumn("p", vector_to_array("probability")[1])
    return out.select(*rows.columns, "p")


def blocked(spark: SparkSession, rows: DataFrame, features: list[str]) -> DataFrame:
    """``(fold, positives, negatives, auc)``: each fold judged by a model of all others."""
    rows, out = cut(rows), None
    for fold in range(4):
        model = fitted(rows.filter(F.col("fold") != fold), features)
        one = auc(scored(model, rows.filter(F.col("fold") == fold), features), "y", "p", ["row", "col"])
        one = one.select(F.lit(fold).cast("long").alias("fold"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def dealt_anew(rows: DataFrame, column: str, seed: int) -> DataFrame:
    """*column* permuted over all rows in the order of a hash, the others in place."""
    a = numbered(rows, "row", "col", out="_rn").drop(column)
    b = numbered(rows.select("row", "col", column, unit_hash(F.col("row"), F.col("col"), seed=seed).alias("_u")), "_u", "row", "col", out="_rn")
    return a.join(b.select("_rn", column), "_rn").drop("_rn")


def importance(spark: SparkSession, rows: DataFrame, features: list[str], fold: int = 0) -> DataFrame:
    """``(feature, auc, loss)`` on one fold: the AUC after permuting the feature, and what it loses."""
    rows = cut(rows)
    model = fitted(rows.filter(F.col("fold") != fold), features)
    held = cut(rows.filter(F.col("fold") == fold))
    base = auc(scored(model, held, features), "y", "p", ["row", "col"]).select(F.col("auc").alias("base"))
    out = None
    for seed, name in enumerate(features):
        one = auc(scored(model, dealt_anew(held, name, seed), features), "y", "p", ["row", "col"]).select(F.lit(name).alias("feature"), "auc")
        out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(base)).select("feature", "auc", F.round(F.col("base") - F.col("auc"), 6).alias("loss"))

"""Distance-weighted Tversky scores on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastrat.functions.expressions import tversky
from terrastrat.operators.kernels import disc, spread
from terrastrat.session import cut

#: Methods that one call scores at most: each meets every truth cell.
MOST_METHODS = 1000


def best_credit(pred: DataFrame, radius: float = 3.0, p: str = "p", keys: list[str] = ()) -> DataFrame:
    """``(keys, row, col, credit)``: the best p * k over the predictions in reach of each cell."""
    rows = spread(pred, disc(radius), [*keys, p])
    return rows.groupBy(*keys, "row", "col").agg(F.max(F.col(p) * F.col("k")).alias("credit"))


def contributions(truth: DataFrame, pred: DataFrame, radius: float = 3.0, keys: list[str] = (), truth_keys: list[str] = ()) -> DataFrame:
    """One row a truth cell (``tp``) and one a predicted cell (``fp``): what each adds to the score.

    keys: columns of *pred* that tell methods apart; *truth* is shared by all of them, or has the
    columns *truth_keys* among *keys*. Credit reaches across any tile border, so sums over tiles need
    no halo.
    """
    credit = best_credit(pred, radius, keys=keys)
    cover = best_credit(truth.withColumn("p", F.lit(1.0)), radius, keys=truth_keys).withColumnRenamed("credit", "cover")
    apart = [k for k in keys if k not in truth_keys]
    methods = cut(pred.select(*apart).distinct()) if apart else None
    if methods is not None and methods.limit(MOST_METHODS + 1).count() > MOST_METHODS:
        raise ValueError(f"more than {MOST_METHODS} methods, each of which would meet every truth cell: use scores_by_method")
    every = truth if methods is None else truth.join(F.broadcast(methods))
    hits = every.select(*keys, "row", "col").join(credit, [*keys, "row", "col"], "left").select(*keys, "row", "col", F.coalesce("credit", F.lit(0.0)).alias("tp"), F.lit(0.0).alias("fp"), F.lit(1).alias("g"), F.lit(0).alias("n"))
    misses = pred.join(cover, [*truth_keys, "row", "col"], "left").select(
        *keys, "row", "col", F.lit(0.0).alias("tp"), (F.col("p") * (1 - F.coalesce("cover", F.lit(0.0)))).alias("fp"), F.lit(0).alias("g"), F.lit(1).alias("n")
    )
    return hits.unionByName(misses)


def scores_by_method(truth: DataFrame, pred: DataFrame, keys: list[str], radius: float = 3.0) -> DataFrame:
    """One row of :func:`totals` for each of any number of methods: only cells that earn credit meet truth, whose size is one number."""
    hits = best_credit(pred, radius, keys=keys).join(truth.select("row", "col"), ["row", "col"])
    cover = best_credit(truth.withColumn("p", F.lit(1.0)), radius).withColumnRenamed("credit", "cover")
    none = F.lit(0.0)
    misses = pred.join(cover, ["row", "col"], "left").select(*keys, none.alias("tp"), (F.col("p") * (1 - F.coalesce("cover", none))).alias("fp"), F.lit(1).alias("n"))
    rows = hits.select(*keys, F.col("credit").alias("tp"), none.alias("fp"), F.lit(0).alias("n")).unionByName(misses)
    sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "n")]).join(F.broadcast(truth.agg(F.count("*").alias("g"))))
    tp, fp, g = F.col("tp"), F.col("fp"), F.col("g")
    out = [F.round(tp, 6).alias("tp"), F.round(fp, 6).alias("fp"), F.round(g - tp, 6).alias("fn"), g.alias("truth_n"), F.col("n").cast("long").alias("pred_n"), F.round(tversky(tp, fp, g - tp), 6).alias("dti")]
    return sums.select(*keys, *out)


def totals(rows: DataFrame) -> list:
    """Aggregates of :func:`contributions` and the score."""
    tp, fp, g = F.sum("tp"), F.sum("fp"), F.sum("g")
    return [
        F.round(tp, 6).alias("tp"),
        F.round(fp, 6).alias("fp"),
        F.round(g - tp, 6).alias("fn"),
        g.cast("long").alias("truth_n"),
        F.sum("n").cast("long").alias("pred_n"),
        F.round(tversky(tp, fp, g - tp), 6).alias("dti"),
    ]

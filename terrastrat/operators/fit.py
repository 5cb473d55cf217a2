"""Fits from sufficient statistics: sums in Spark, tiny solves on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrastrat.operators.ranking import average_ranks, numbered
from terrastrat.session import cut


def auc(rows: DataFrame, label: str, score: str, order: list[str]) -> DataFrame:
    """Rank-sum area under the curve, ties by *order*; null if a class is absent."""
    ranked = numbered(rows, F.asc(score), *order, out="_rn")
    positive = F.col(label) == 1
    s = ranked.agg(F.sum(F.when(positive, F.col("_rn"))).alias("r"), F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    area = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q"))
    return s.select(F.col("p").alias("positives"), F.col("q").alias("negatives"), F.round(area, 6).alias("auc"))


def spearman(rows: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """Correlation of ranks with ties averaged."""
    ranked = average_ranks(average_ranks(rows, a, "_ra", order), b, "_rb", order)
    return ranked.agg(F.count("*").alias("n"), F.round(F.corr("_ra", "_rb"), 6).alias("rho"))


def normal_equations(rows: DataFrame, design: list[Column], target: Column) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n from one aggregate."""
    k = len(design)
    sums = [F.sum(design[i] * design[j]) for i in range(k) for j in range(i, k)] + [F.sum(d * target) for d in design] + [F.sum(target * target), F.count("*")]
    got = [float(v or 0) for v in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    xx = np.zeros((k, k))
    xx[np.triu_indices(k)] = got[: k * (k + 1) // 2]
    xx = xx + np.triu(xx, 1).T
    return xx, np.array(got[k * (k + 1) // 2 : -2]), got[-2], int(got[-1])


def ols(rows: DataFrame, design: list[Column], target: Column) -> dict:
    """Least squares with standard errors and R squared about the mean (the first column being 1)."""
    xx, xy, yy, n = normal_equations(rows, design, target)
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    rss = max(yy - beta @ xy, 0.0)
    se = np.sqrt(np.diag(inverse) * rss / max(n - len(beta), 1))
    return {"beta": beta, "se": se, "r2": 1 - rss / max(yy - xy[0] ** 2 / max(n, 1), 1e-300), "n": n}


def capped_scale(rows: DataFrame, weight: str, total: float, cap: float = 1.0) -> float:
    """The factor by which capped weights sum to *total*; a sum over all rows for each weight that reaches the cap.

    Rounds end when no further weight is capped; infinite if all are capped below the total.
    """
    w = cut(rows.select(F.col(weight).cast("double").alias("w")).filter("w > 0"))
    factor = 0.0
    while True:
        full = F.col("w") * factor >= cap
        n, rest = w.agg(F.count_if(full), F.sum(F.when(~full, F.col("w")))).first()
        if not rest:
            return float("inf")
        raised = max(total - cap * n, 0.0) / rest
        if raised <= factor * (1 + 1e-15):
            return factor
        factor = raised


def ecdf_excess(observed: DataFrame, null: DataFrame, value: str, steps: list[float]) -> DataFrame:
    """Shares of observed and null values up to each step, and the largest step at which they differ by over 0.05."""
    share = lambda df, name: df.agg(*[F.avg((F.col(value) <= s).cast("double")).alias(f"{name}{i}") for i, s in enumerate(steps)])
    both = share(observed, "o").join(F.broadcast(share(null, "n")))
    rows = both.select(F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"o{i}").alias("observed"), F.col(f"n{i}").alias("expected")) for i, s in enumerate(steps)])).alias("r")).select("r.*")
    return rows.withColumn("scale", F.max(F.when(F.col("observed") - F.col("expected") > 0.05, F.col("step"))).over(W.partitionBy()))

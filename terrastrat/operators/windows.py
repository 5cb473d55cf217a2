"""Wide box windows by running sums, and posteriors without one artifact by sums that are linear in the weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrastrat.operators.kernels import Offsets, disc, spread
from terrastrat.session import cut


def _windowed(rows: DataFrame, line: str, along: str, names: dict[str, tuple[str, int]], edges: bool, low: int, high: int) -> DataFrame:
    """Sums of columns over -h..h along one axis of a complete line: differences of running sums, all sizes by one sort.

    names: {result: (column, h)}. edges: places beyond the line's ends count as its end cells.
    """
    order = W.partitionBy(line).orderBy(along)
    running = {f"_s_{c}": F.sum(c).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) for c in {c for c, _ in names.values()}}
    rows = rows.withColumns(running)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # the frame grows with the row, so each running sum is looked at once
    upto = lambda c, h: F.coalesce(F.last(f"_s_{c}").over(order.rangeBetween(W.unboundedPreceding, h)), F.lit(0.0))
    out = {}
    for name, (c, h) in names.items():
        total = upto(c, h) - upto(c, -h - 1)
        if edges:
            total = total + F.greatest(F.col(along) + h - high, F.lit(0)) * F.last(c).over(whole) + F.greatest(low + h - F.col(along), F.lit(0)) * F.first(c).over(whole)
        out[f"_n_{name}"] = total
    return rows.withColumns(out).select("row", "col", *[F.col(f"_n_{n}").alias(n) for n in names])


def box_means(cells: DataFrame, value: str, sizes: list[int], edges: bool = False) -> DataFrame:
    """``(row, col, m9, ...)`` of every cell: mean of *value* over square windows of each (odd) size, whatever their number of cells.

    Two shuffles for all sizes: running sums along rows, then along columns. The bounding box is filled, as a window's sums
    are needed where cells are missing; missing cells and null values don't count. edges: the box goes on beyond its border with
    the values that it has there, as image filters do; then all cells should exist.
    """
    known = cut(cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("_v")))
    box = known.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if box[0] is None:
        return known.select("row", "col", *[F.lit(None).cast("double").alias(f"m{k}") for k in sizes])
    spine = known.select("row").distinct().select("row", F.explode(F.sequence(F.lit(box[2]).cast("long"), F.lit(box[3]).cast("long"))).alias("col"))
    full = spine.unionByName(known.withColumn("_own", F.lit(True)), allowMissingColumns=True).groupBy("row", "col").agg(F.max("_v").alias("_v"), F.max("_own").alias("_own"))
    full = full.select("row", "col", F.coalesce("_v", F.lit(0.0)).alias("v"), F.col("_v").isNotNull().cast("double").alias("n"))
    half = {k: k // 2 for k in sizes}
    across = _windowed(full, "row", "col", {f"{c}{k}": (c, h) for k, h in half.items() for c in "vn"}, edges, box[2], box[3])
    both = _windowed(across, "col", "row", {f"{c}{k}": (f"{c}{k}", h) for k, h in half.items() for c in "vn"}, edges, box[0], box[1])
    # counts are whole numbers, but for what the sums have rounded
    means = [F.when(F.col(f"n{k}") > 0.5, F.col(f"v{k}") / F.round(F.col(f"n{k}"))).alias(f"m{k}") for k in sizes]
    return known.select("row", "col").join(both.select("row", "col", *means), ["row", "col"])


def top_credit_ladder(values: DataFrame, names: list[str], credit: Column, mass: int) -> DataFrame:
    """``(name, n, c_per_dot)``: mean credit of the *mass* highest cells of each of several fields, ties by place.

    All fields are ranked by one sort; the place in a field is the number less the field's first one.
    """
    from terrastrat.operators.ranking import numbered

    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names]))
    rows = values.select("row", "col", credit.alias("credit"), pairs.alias("p")).select("row", "col", "credit", "p.*").filter("value is not null")
    ranked = numbered(rows, "name", F.desc("value"), "row", "col")
    first = ranked.groupBy("name").agg(F.min("rn").alias("_f"))  # one row a field
    top = ranked.join(F.broadcast(first), "name").filter(F.col("rn") - F.col("_f") < mass)
    return top.groupBy("name").agg(F.count("*").alias("n"), F.avg("credit").alias("c_per_dot"))


def leave_one_out(dots: DataFrame, scores: DataFrame, tau: float, truth: float, kernel: Offsets | None = None, inside: Column | None = None, alpha: float = 0.2, beta: float = 0.8) -> DataFrame:
    """``(a, n, score, predicted)``: each artifact's score as the others' posterior of the truth predicts it.

    dots ``(a, row, col)``, scores ``(a, score)``. Artifacts weigh exp(score / tau); the posterior is the weighted sum of
    their supports (kernel sums), scaled to *truth* cells. Without artifact i it is the sum of all less i's own share, so what a
    prediction needs are four sums of i over its own cells, by one join and one aggregate for all artifacts.
    """
    table = kernel or disc()
    fields = spread(dots.select("a", "row", "col"), table, ["a"]).groupBy("a", "row", "col").agg(F.sum("k").alias("s"), F.max("k").alias("c"))
    fields = fields if inside is None else fields.filter(inside)
    top = scores.agg(F.max("score").alias("_top"))
    weighed = cut(scores.join(F.broadcast(top)).select("a", "score", F.exp((F.col("score") - F.col("_top")) / tau).alias("e")))
    sizes = dots.groupBy("a").agg(F.count("*").alias("n"))
    weighed = cut(weighed.join(sizes, "a"))
    rows = cut(fields.join(F.broadcast(weighed.select("a", "e")), "a"))  # one row an artifact
    whole = rows.groupBy("row", "col").agg(F.sum(F.col("e") * F.col("s")).alias("w"))
    total = rows.agg(F.sum(F.col("e") * F.col("s")).alias("all"))
    sums = rows.join(whole, ["row", "col"]).groupBy("a").agg(F.sum("s").alias("s"), F.sum((F.col("w") - F.col("e") * F.col("s")) * F.col("c")).alias("wc"), F.sum((F.col("w") - F.col("e") * F.col("s")) * F.col("s")).alias("ws"))
    met = weighed.join(sums, "a").join(F.broadcast(total))
    rest = F.col("all") - F.col("e") * F.col("s")
    t, mp = truth * F.col("wc") / rest, truth * F.col("ws") / rest
    return met.select("a", "n", "score", F.when(rest > 0, t / (alpha * (F.col("n") - mp + t) + beta * truth)).alias("predicted"))

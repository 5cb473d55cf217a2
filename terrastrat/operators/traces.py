"""Planes through events in space, and the lines in which they meet the ground.

All planes are handled at once. Places along strike and across it are rows that meet the ground's patches in one
equi-join; the patches around each change of sign are fetched by a second one, and the bisection then runs inside
an expression, so no step of it is a join. The ground is never broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastrat.operators.bootstrap import DRAWS, quantile, strike_spread
from terrastrat.operators.kernels import gather, spread
from terrastrat.operators.sequential import plane
from terrastrat.operators.spatial import radius_join
from terrastrat.session import cut, small_join


@dataclass(frozen=True)
class Rules:
    """Lengths in metres, angles in degrees, depths in kilometres. The published parameters of the method."""

    radius: float = 2500.0
    seed_cell: float = 500.0
    dedupe_cell: float = 250.0
    least_events: int = 10
    least_years: int = 2
    least_length: float = 1500.0
    least_linearity: float = 0.7
    most_width: float = 1200.0
    least_planarity: float = 0.45
    least_horizontal: float = 0.2
    least_alignment: float = 0.65
    most_depth: float = 20.0
    reach: float = 10_000.0
    root_spacing: float = 100.0
    least_support: float = 0.9
    most_residual: float = 5.0
    draws: int = DRAWS
    most_angle: float = 35.0
    step: float = 50.0
    sigma: float = 100.0
    halo: int = 1


#: Why a seed is given up, in the order of the tests.
REASONS = (
    "too_few_events robust_too_few_inliers too_few_years short low_linearity too_wide no_surface_intersection insufficient_surface_support "
    "surface_residual low_planarity deep_or_large_extrapolation misaligned_strike short unstable_bootstrap"
).split()


def patches(ground: DataFrame, value: str = "z") -> DataFrame:
    """``(row, col, z00, z01, z10, z11)`` of every cell with a right, a lower and a diagonal neighbour: what bilinear samples need."""
    z = F.col(value).cast("double")
    corner = {(0, 0): "z00", (0, 1): "z01", (1, 0): "z10", (1, 1): "z11"}
    table = [(i, j, float(2 * i + j)) for i, j in corner]
    known = ground.select("row", "col", z.alias("_z")).filter("_z is not null AND NOT isnan(_z)")
    got = gather(known, table, [F.max(F.when(F.col("k") == 2 * i + j, F.col("_z"))).alias(n) for (i, j), n in corner.items()], ["_z"])
    return got.dropna(subset=list(corner.values()))


def places(x: Column, y: Column, pixel: float, x0: float, y0: float) -> tuple[Column, Column]:
    """Fractional row and column of a place, counted from cells' centres."""
    return (F.lit(y0) - y) / pixel - 0.5, (x - F.lit(x0)) / pixel - 0.5


def level(p: Column, fr: Column, fc: Column) -> Column:
    """Bilinear height at a fractional place from its patch."""
    v, u = fr - p["row"], fc - p["col"]
    return p["z00"] * (1 - u) * (1 - v) + p["z01"] * u * (1 - v) + p["z10"] * (1 - u) * v + p["z11"] * u * v


def surface_traces(planes: DataFrame, ground: DataFrame, rules: Rules, pixel: float = 100.0, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """``(id, k, x, y, q, residual)``: where planes ``(id, cx, cy, cz, nx, ny, nz, lo, hi)`` meet the ground ``(row, col, z)``.

    k numbers places along strike, *step* apart from lo to hi; q: how far across strike. Heights count up. Across strike,
    changes of sign between places *root_spacing* apart bracket the crossing that is nearest to where level ground would be
    met, and up to 24 halvings follow, until the plane is within *most_residual* of the ground. Places without such a crossing, or whose
    ground is unknown, have no row. Planes too level to have a strike have none.
    """
    n = max(1, int(np.ceil(rules.reach / max(rules.root_spacing, 1.0))))
    gap = rules.reach / n
    quads = cut(patches(ground))
    level_part = F.hypot("nx", "ny")
    lines = planes.withColumn("hn", level_part).filter(F.col("hn") >= rules.least_horizontal).filter("hi > lo")
    lines = lines.withColumns({"ux": -F.col("ny") / F.col("hn"), "uy": F.col("nx") / F.col("hn"), "dx": F.col("nx") / F.col("hn"), "dy": F.col("ny") / F.col("hn")})
    count = F.greatest(F.lit(2), F.ceil((F.col("hi") - F.col("lo")) / rules.step).cast("int") + 1)
    # the ground below the centre says where level ground would be met
    fr, fc = places(F.col("cx"), F.col("cy"), pixel, x0, y0)
    at = lambda t, r, c: t.withColumns({"fr": r, "fc": c}).withColumns({"row": F.floor("fr").cast("long"), "col": F.floor("fc").cast("long")})
    patch = F.struct("row", "col", "z00", "z01", "z10", "z11")
    held = small_join(at(lines.withColumn("count", count), fr, fc), quads, ["row", "col"], "left")
    guess = F.coalesce(-F.col("nz") * (level(patch, F.col("fr"), F.col("fc")) - F.col("cz")) / F.col("hn"), F.lit(0.0))
    held = cut(held.withColumn("guess", guess).drop("fr", "fc", "row", "col", "z00", "z01", "z10", "z11"))
    along = held.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    along = along.withColumn("a", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (F.col("count") - 1))
    east = lambda q: F.col("cx") + F.col("a") * F.col("ux") + q * F.col("dx")
    north = lambda q: F.col("cy") + F.col("a") * F.col("uy") + q * F.col("dy")
    miss = lambda z, q: F.col("hn") * q + F.col("nz") * (z - F.col("cz"))
    between = along.withColumn("j", F.explode(F.sequence(F.lit(-n), F.lit(n - 1))))
    for name, q in (("_fl", F.col("j") * F.lit(gap)), ("_fr", (F.col("j") + 1) * F.lit(gap))):
        met = small_join(at(between, *places(east(q), north(q), pixel, x0, y0)), quads, ["row", "col"])
        between = met.withColumn(name, miss(level(patch, F.col("fr"), F.col("fc")), q)).drop("fr", "fc", "row", "col", "z00", "z01", "z10", "z11")
    mine = ["id", "k"]
    kept = ["a", "cx", "cy", "cz", "ux", "uy", "dx", "dy", "hn", "nz", "guess"]
    # few brackets hold a crossing, and their least is combined before the shuffle
    best = F.min(F.struct(F.abs((F.col("j") + 0.5) * gap - F.col("guess")).alias("off"), "j", F.col("_fl").alias("fl"), F.col("_fr").alias("fr"))).alias("b")
    roots = between.filter(F.col("_fl") * F.col("_fr") <= 0).groupBy(*mine).agg(*[F.first(c).alias(c) for c in kept], best)
    roots = roots.withColumns({"ql": F.col("b.j") * F.lit(gap), "qr": (F.col("b.j") + 1) * F.lit(gap), "fl": F.col("b.fl"), "fr": F.col("b.fr")}).drop("b")
    ends = [places(east(F.col(q)), north(F.col(q)), pixel, x0, y0) for q in ("ql", "qr")]
    span = lambda i: F.sequence(F.floor(F.least(ends[0][i], ends[1][i])).cast("long"), F.floor(F.greatest(ends[0][i], ends[1][i])).cast("long"))
    near = roots.withColumn("row", F.explode(span(0))).withColumn("col", F.explode(span(1)))  # cells that the bracket crosses
    near = small_join(near, quads, ["row", "col"]).groupBy(*mine).agg(*[F.first(c).alias(c) for c in [*kept, "ql", "qr", "fl", "fr"]], F.collect_list(patch).alias("near"))

    # a lambda holds its argument, so patches are searched once a step, not once for every use
    once = lambda v, of: F.get(F.transform(F.array(v), of), F.lit(0))

    def height(q: Column) -> Column:
        r, c = places(east(q), north(q), pixel, x0, y0)
        held = F.get(F.filter("near", lambda p: (p["row"] == F.floor(r)) & (p["col"] == F.floor(c))), F.lit(0))
        return once(held, lambda p: level(p, r, c))

    def moved(s: Column, at: Column) -> Column:
        q, f, zero = at["q"], at["f"], F.lit(0.0)
        left = ((s["f"] <= zero) & (f >= zero)) | ((s["f"] >= zero) & (f <= zero))
        done = f.isNull() | (F.abs(f) <= rules.most_residual)
        return F.struct(
            F.when(~done & ~left, q).otherwise(s["l"]).alias("l"), F.when(~done & left, q).otherwise(s["r"]).alias("r"), F.when(~done & ~left, f).otherwise(s["f"]).alias("f"), q.alias("q"), done.alias("done"),
        )

    def halve(s: Column, _: Column) -> Column:
        met = once((s["l"] + s["r"]) / 2, lambda q: F.struct(q.alias("q"), miss(height(q), q).alias("f")))
        return F.when(s["done"], s).otherwise(once(met, lambda at: moved(s, at)))

    zero = F.lit(0.0)
    hit = F.when(F.col("fl") == 0, F.col("ql")).when(F.col("fr") == 0, F.col("qr"))
    start = F.struct(F.col("ql").alias("l"), F.col("qr").alias("r"), F.col("fl").alias("f"), F.coalesce(hit, zero).alias("q"), hit.isNotNull().alias("done"))
    solved = cut(near.withColumn("q", F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, halve, lambda s: s["q"])))
    out = solved.select(*mine, east(F.col("q")).alias("x"), north(F.col("q")).alias("y"), "q", F.abs(miss(height(F.col("q")), F.col("q"))).alias("residual"))
    return out.filter((F.col("residual") <= rules.most_residual) & (F.abs("q") <= rules.reach))


def trace_summaries(planes: DataFrame, traces: DataFrame, rules: Rules) -> DataFrame:
    """*planes* with ``roots, support, extrapolation, residual``: share of places along strike that meet the ground, p95 of the distance, largest miss."""
    count = F.greatest(F.lit(2), F.ceil((F.col("hi") - F.col("lo")) / rules.step).cast("int") + 1)
    # one number for each place along strike
    sums = traces.groupBy("id").agg(F.count("*").alias("roots"), F.collect_list(F.abs("q")).alias("_q"), F.max("residual").alias("residual"))
    met = planes.join(sums.select("id", "roots", quantile(F.col("_q"), 0.95).alias("extrapolation"), "residual"), "id", "left")
    return met.withColumn("roots", F.coalesce("roots", F.lit(0).cast("long"))).withColumn("support", F.col("roots") / count)


def fitted(events: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(planes, inliers) of events ``(id, x, y, z, year)`` around one seed a cell.

    planes: ``(id, sx, sy, n_all, n, years, l1, linearity, width, planarity, cx, cy, cz, nx, ny, nz, lo, hi, alignment, depth)``, id of the seed;
    beyond what a neighbourhood is too small for, its columns are null. inliers: ``(id, item, x, y, z)`` from the seed.
    Neighbourhoods keep one event (the first) a year and small cell.
    """
    cell = lambda c, size: F.floor(F.col(c) / size)
    seeds = events.groupBy(cell("x", rules.seed_cell).alias("_a"), cell("y", rules.seed_cell).alias("_b")).agg(F.min(F.struct("id", "x", "y")).alias("s"))
    seeds = cut(seeds.select(F.col("s.id").alias("id"), F.col("s.x").alias("x"), F.col("s.y").alias("y")))
    near = radius_join(seeds, events.select("id", "x", "y", "z", "year"), rules.radius)
    first = near.groupBy("id", "n_year", cell("n_x", rules.dedupe_cell), cell("n_y", rules.dedupe_cell)).agg(F.min(F.struct("n_id", "n_x", "n_y", "n_z")).alias("e"), F.first("x").alias("sx"), F.first("y").alias("sy"))
    kept = first.select("id", "sx", "sy", F.col("n_year").alias("year"), F.col("e.n_id").alias("item"), (F.col("e.n_x") - F.col("sx")).alias("x"), (F.col("e.n_y") - F.col("sy")).alias("y"), F.col("e.n_z").alias("z"))
    names = "l1 linearity width planarity cx cy cz nx ny nz lo hi alignment depth".split()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        out = {"id": pdf["id"].iloc[0], "sx": pdf["sx"].iloc[0], "sy": pdf["sy"].iloc[0], "n_all": len(pdf), "n": 0, "years": 0, "items": []} | dict.fromkeys(names, None)
        if len(pdf) >= rules.least_events:
            xyz = pdf[["x", "y", "z"]].to_numpy(np.float64)
            keep = plane(xyz, least=rules.least_events)[1]
            out["n"] = int(keep.sum())
            if keep.any():
                xyz, held = xyz[keep], pdf[keep]
                out |= {"years": held["year"].nunique(), "items": held["item"].tolist()} | shape(xyz)
        return pd.DataFrame([out])

    schema = "id long, sx double, sy double, n_all long, n long, years long, items array<long>, " + ", ".join(f"{c} double" for c in names)
    fits = cut(kept.groupBy("id").applyInPandas(fit, schema))
    taken = fits.select("id", F.explode("items").alias("item"))
    return fits.drop("items"), taken.join(kept.select("id", "item", "x", "y", "z"), ["id", "item"])


def shape(xyz: np.ndarray) -> dict:
    """Axes of points in the plane and in space, from their own coordinates."""
    centre = xyz.mean(axis=0)
    flat, axes = np.linalg.eigh(np.cov((xyz[:, :2] - centre[:2]).T))
    solid, normals = np.linalg.eigh(np.cov((xyz - centre).T))
    normal, size = normals[:, 0], np.hypot(*normals[:2, 0])
    out = {
        "l1": flat[1], "linearity": (flat[1] - flat[0]) / max(flat[1] + flat[0], 1e-12), "width": 4 * np.sqrt(max(flat[0], 0.0)), "planarity": float(np.clip(1 - solid[0] / max(solid[1], 1e-12), 0, 1)),
        **dict(zip(("cx", "cy", "cz", "nx", "ny", "nz"), [*centre, *normal], strict=True)), "depth": float(np.median(-xyz[:, 2]) / 1000),
    }
    if size > 0:
        strike = np.array([-normal[1], normal[0]]) / size
        lo, hi = np.percentile((xyz[:, :2] - centre[:2]) @ strike, [5, 95])
        out |= {"lo": lo, "hi": hi, "alignment": abs(float(axes[:, 1] @ strike))}
    return out


def lineaments(events: DataFrame, ground: DataFrame, rules: Rules = Rules(), pixel: float = 100.0, x0: float = 0.0, y0: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(seeds with ``reason`` and ``quality``, traces) of planes through events ``(id, x, y, z, year)`` that meet the ground.

    reason: the first test that a seed fails, null if it is accepted; see :data:`REASONS` for their order.
    """
    fits, inliers = fitted(events, rules)
    early = [
        F.col("n_all") < rules.least_events, F.col("n") < rules.least_events, F.col("years") < rules.least_years, F.col("l1") <= 0, F.col("linearity") < rules.least_linearity,
        F.col("width") > rules.most_width,
    ]
    late = [
        F.coalesce("roots", F.lit(0)) == 0, F.col("support") < rules.least_support, F.col("residual") > rules.most_residual, F.col("planarity") < rules.least_planarity,
        (F.col("depth") > rules.most_depth) | (F.col("extrapolation") > rules.reach), F.col("alignment") < rules.least_alignment, (F.col("hi") - F.col("lo")) < rules.least_length,
    ]
    first = lambda tests, names: F.coalesce(*[F.when(t, F.lit(n)) for t, n in zip(tests, names, strict=True)])
    # later tests cost more, so only seeds that pass the earlier ones meet the ground, and only the rest of those is redrawn
    ready = fits.filter(first(early, REASONS[:6]).isNull() & F.col("lo").isNotNull())
    placed = cut(ready.withColumns({"cx": F.col("cx") + F.col("sx"), "cy": F.col("cy") + F.col("sy")}))
    traces = cut(surface_traces(placed, ground, rules, pixel, x0, y0))
    met = trace_summaries(placed, traces, rules).select("id", "roots", "support", "extrapolation", "residual")
    rows = small_join(fits, cut(met), "id", "left").withColumn("reason", first([*early, *late], REASONS[:13]))
    rows = cut(rows)
    size = F.hypot("nx", "ny")
    strikes = cut(rows.filter("reason is null").select("id", (-F.col("ny") / size).alias("ux"), (F.col("nx") / size).alias("uy")))
    turns = strike_spread(small_join(inliers, strikes.select("id"), "id"), "id", "item", strikes, rules.draws, least_horizontal=rules.least_horizontal)
    rows = small_join(rows, cut(turns.withColumnRenamed("spread", "angle")), "id", "left")
    reason = F.coalesce("reason", F.when(F.coalesce("angle", F.lit(90.0)) > rules.most_angle, F.lit(REASONS[13])))
    part = lambda c, top: F.least(F.lit(1.0), c / top)
    quality = F.col("linearity") * F.col("planarity") * part(F.col("years"), 3.0) * part(F.col("n"), 25.0) * part(F.col("hi") - F.col("lo"), 3000.0) * F.greatest(F.lit(0.0), 1 - F.col("angle") / 60) * F.col("alignment") * F.col("support")
    judged = rows.withColumn("reason", reason).withColumn("quality", F.when(F.col("reason").isNull(), F.least(quality, F.lit(1.0))))
    return cut(judged), traces


def rejection_counts(seeds: DataFrame) -> DataFrame:
    """``(place, reason, n)``: seeds given up by each test in the order of the tests, also those that none fails; the last row counts what is accepted."""
    names = [*dict.fromkeys(REASONS), "accepted"]
    found = seeds.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
    spine = seeds.sparkSession.createDataFrame(list(enumerate(names)), "place int, reason string")
    return spine.join(F.broadcast(found), "reason", "left").fillna(0, ["n"]).select("place", "reason", "n")  # one row a reason


def painted(seeds: DataFrame, traces: DataFrame, rules: Rules = Rules(), pixel: float = 100.0, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """``(row, col, score)``: accepted traces with a halo, the best quality a cell."""
    good = traces.join(seeds.filter("quality > 0").select("id", "quality"), "id")
    cells = good.select(F.floor((F.lit(y0) - F.col("y")) / pixel).cast("long").alias("row"), F.floor((F.col("x") - F.lit(x0)) / pixel).cast("long").alias("col"), "quality")
    cells = cells.groupBy("row", "col").agg(F.max("quality").alias("quality"))
    far = [(i, j, float(np.hypot(i, j)) * pixel) for i in range(-rules.halo, rules.halo + 1) for j in range(-rules.halo, rules.halo + 1)]
    offsets = [(i, j, float(np.exp(-0.5 * (d / max(rules.sigma, 1.0)) ** 2))) for i, j, d in far if d <= rules.halo * pixel + 1e-9]
    return spread(cells, offsets, ["quality"]).groupBy("row", "col").agg(F.max(F.col("quality") * F.col("k")).alias("score"))

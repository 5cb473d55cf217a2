"""Planes on terrain and bootstraps of groups."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastrat.functions.expressions import eigen3, normal3
from terrastrat.operators import bootstrap, traces


def ground(spark, height, rows=60, cols=80):
    return spark.createDataFrame([(r, c, float(height(100 * c + 50, 6000 - 100 * r - 50))) for r in range(rows) for c in range(cols)], "row long, col long, z double")


def planes(spark, rows):
    return spark.createDataFrame(rows, "id long, cx double, cy double, cz double, nx double, ny double, nz double, lo double, hi double")


def normal(strike_deg, dip_deg):
    t, d = np.radians(strike_deg), np.radians(dip_deg)
    return (float(np.cos(t) * np.sin(d)), float(np.sin(t) * np.sin(d)), float(np.cos(d)))


def test_planes_meet_a_tilted_ground_in_the_analytic_line(spark):
    """The crossing solves both plane equations within the tolerance of the bisection."""
    slope = lambda x, y: 500 + 0.05 * x - 0.02 * y
    rows = [(i, 4000.0, 3000.0, 300.0 - 40 * i, *normal(37 * i, 55 + 6 * i), -900.0, 900.0) for i in range(5)]
    rules = replace(traces.Rules(), reach=2500.0, most_residual=0.01)
    found = traces.surface_traces(planes(spark, rows), ground(spark, slope), rules, 100.0, 0.0, 6000.0).collect()
    by = {r[0]: r for r in rows}
    assert {f.id for f in found} == set(by) and len(found) == 5 * 37
    for f in found:
        _, cx, cy, cz, nx, ny, nz, *_ = by[f.id]
        assert abs(nx * (f.x - cx) + ny * (f.y - cy) + nz * (slope(f.x, f.y) - cz)) < 0.011
        # q of the exact line, from the plane equation with the tilted ground put in
        hn = np.hypot(nx, ny)
        a = -900 + 50 * f.k
        x0, y0 = cx - a * ny / hn, cy + a * nx / hn
        exact = -nz * (slope(x0, y0) - cz) / (hn + nz * (0.05 * nx - 0.02 * ny) / hn)
        assert abs(f.q - exact) < 1


def test_nearest_of_several_crossings_and_unknown_ground(spark):
    waves = lambda x, y: 100 * np.sin(x / 300)
    rules = replace(traces.Rules(), reach=2000.0, most_residual=0.5)
    one = planes(spark, [(1, 4000.0, 3000.0, 0.0, *normal(0, 30), -200.0, 200.0), (2, 50.0, 3000.0, -3000.0, *normal(0, 30), -200.0, 200.0), (3, 4000.0, 3000.0, 0.0, 0.0, 0.0, 1.0, -200.0, 200.0)])
    dem = ground(spark, waves)
    found = traces.surface_traces(one, dem, rules, 100.0, 0.0, 6000.0)
    assert {r.id for r in found.collect()} == {1}
    hole = traces.surface_traces(one, dem.filter("col < 35 OR col > 45"), rules, 100.0, 0.0, 6000.0)
    assert all(not 3600 < r.x < 4500 for r in hole.collect())
    sums = {r.id: r for r in traces.trace_summaries(one, found, rules).collect()}
    assert sums[1].support == 1 and sums[2].support == 0 and sums[2].residual is None


def swarm(spark, spread=20.0, years=6):
    """One steep plane through (4000, 3000), a loose cloud, and a few strays."""
    rng = np.random.default_rng(3)
    n = normal(30, 80)
    hn = np.hypot(*n[:2])
    u, d = np.array([-n[1], n[0], 0]) / hn, np.array([-n[2] * n[0] / hn, -n[2] * n[1] / hn, hn])
    line = np.array([4000, 3000, -2000]) + rng.uniform(-2000, 2000, (400, 1)) * u + rng.uniform(-1500, 1500, (400, 1)) * d + rng.normal(0, spread, (400, 1)) * np.array(n)
    cloud = np.column_stack([rng.uniform(0, 2000, 150), rng.uniform(4500, 6000, 150), rng.uniform(-4000, 0, 150)])
    strays = np.column_stack([rng.uniform(6500, 8000, 5), rng.uniform(0, 800, 5), rng.uniform(-4000, 0, 5)])
    xyz = np.concatenate([line, cloud, strays])
    return spark.createDataFrame([(i, *map(float, p), int(2000 + rng.integers(years))) for i, p in enumerate(xyz)], "id long, x double, y double, z double, year long"), n


def test_a_planted_plane_is_traced_and_clouds_are_rejected(spark):
    events, n = swarm(spark)
    rules = replace(traces.Rules(), radius=1500.0)
    seeds, found = traces.lineaments(events, ground(spark, lambda x, y: 200 + 0.01 * x), rules, 100.0, 0.0, 6000.0)
    good = {s.id for s in seeds.filter("reason is null").collect()}
    assert good and max(good) < 400
    # planes of a few dozen events that lie up to 3.5 km below are turned a little
    away = [abs(n[0] * (f.x - 4000) + n[1] * (f.y - 3000) + n[2] * (200 + 0.01 * f.x + 2000)) for f in found.filter(F.col("id").isin(list(good))).collect()]
    assert np.median(away) < 100 and max(away) < 1000
    counts = traces.rejection_counts(seeds).orderBy("place").collect()
    assert [c.reason for c in counts] == [*dict.fromkeys(traces.REASONS), "accepted"]
    assert sum(c.n for c in counts) == seeds.count() and counts[-1].n == len(good) and counts[0].n > 0
    score = traces.painted(seeds, found, rules, 100.0, 0.0, 6000.0).collect()
    assert score and all(0 < s.score <= 1 for s in score)


@pytest.mark.parametrize(("change", "reason"), [({"most_depth": 0.1}, "deep_or_large_extrapolation"), ({"most_angle": 0.0}, "unstable_bootstrap")])
def test_each_test_rejects_in_its_turn(spark, change, reason):
    events, _ = swarm(spark)
    rules = replace(traces.Rules(), radius=1500.0, **change)
    counts = {r.reason: r.n for r in traces.rejection_counts(traces.lineaments(events, ground(spark, lambda x, y: 200.0), rules, 100.0, 0.0, 6000.0)[0]).collect()}
    assert counts["accepted"] == 0 and counts[reason] > 0


def test_bootstrap_spreads_like_a_multinomial_one(spark):
    rng = np.random.default_rng(8)
    groups = {g: rng.normal(size=(40 + 30 * g, 2)) @ np.array([[300, 0], [0, 40 + 25 * g]]) @ np.array([[np.cos(g), np.sin(g)], [-np.sin(g), np.cos(g)]]) for g in range(5)}
    df = spark.createDataFrame([(g, i, float(x), float(y)) for g, p in groups.items() for i, (x, y) in enumerate(p)], "g long, id long, x double, y double")
    got = {r.g: r for r in bootstrap.axis_spread(df, "g", "id", draws=200).collect()}

    def angle(p):
        w, v = np.linalg.eigh(np.cov(p.T))
        return np.degrees(np.arctan2(v[1, 1], v[0, 1])) % 180

    for g, p in groups.items():
        main = angle(p)
        off = [abs(angle(p[rng.integers(0, len(p), len(p))]) - main) % 180 for _ in range(400)]
        plain = np.percentile([min(o, 180 - o) for o in off], 90)
        assert got[g].n == len(p) and min(abs(got[g].angle - main), 180 - abs(got[g].angle - main)) < 1e-6
        assert abs(got[g].spread - plain) < 0.25 * plain + 0.3, (g, got[g].spread, plain)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_step_of_the_bisection_searches_its_patches_once(spark, monkeypatch):
    seen, cut = [], traces.cut
    monkeypatch.setattr(traces, "cut", lambda df: (seen.append(_plan(df)), cut(df))[1])
    rows = [(1, 4000.0, 3000.0, 300.0, *normal(30, 60), -900.0, 900.0)]
    found = traces.surface_traces(planes(spark, rows), ground(spark, lambda x, y: 500 + 0.05 * x), traces.Rules(), 100.0, 0.0, 6000.0)
    assert found.count() == 37 and "aggregate(" in seen[-1] and seen[-1].count("filter(near") == 1


def test_a_row_is_hashed_once_a_draw(spark):
    df = spark.createDataFrame([(1, i, float(i), float(i % 3)) for i in range(20)], "g long, id long, x double, y double")
    assert _plan(bootstrap.moments(df, "g", "id", {"x": F.col("x"), "y": F.col("y")})).count("md5(") == 1


def test_bootstrap_of_tiny_groups(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 1, 0.0, 0.0), (2, 2, 5.0, 0.0)], "g long, id long, x double, y double")
    got = {r.g: r.spread for r in bootstrap.axis_spread(df, "g", "id").collect()}
    assert got[1] == 90.0 and 0 <= got[2] <= 90


def test_weights_follow_the_law(spark):
    from terrastrat.functions.expressions import unit_hash

    w = spark.range(40_000).select(bootstrap.poisson(unit_hash(F.col("id"), seed=2)).alias("w")).groupBy("w").count().collect()
    share = {r.w: r["count"] / 40_000 for r in w}
    for k, p in enumerate([0.3679, 0.3679, 0.1839, 0.0613, 0.0153]):
        assert abs(share[k] - p) < 0.01


def test_eigenvalues_and_normals_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        a = rng.normal(size=(3, 3)) * [1, 3, 30]
        m = a @ a.T if i else np.diag([2.0, 1.0, 0.5])
        rows.append((i, *map(float, m[np.triu_indices(3)])))
    names = ["xx", "xy", "xz", "yy", "yz", "zz"]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{n} double" for n in names))
    cols = [F.col(n) for n in names]
    for r in df.select("*", F.array(*eigen3(*cols)).alias("e"), F.array(*normal3(*cols)).alias("v")).collect():
        m = np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]])
        w, v = np.linalg.eigh(m)
        assert np.allclose(r.e, w[::-1], rtol=1e-6, atol=1e-6 * w[-1])
        assert abs(abs(np.dot(r.v, v[:, 0])) - 1) < 1e-5

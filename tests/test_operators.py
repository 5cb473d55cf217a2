"""Operators on hand-made cases, and against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastrat.functions.expressions import axial_difference, kernel, utm
from terrastrat.operators import catalog, cluster, emission, fields, fit, kernels, lines, metric, points, ranking, select, sequential, spatial
from terrastrat.operators.graph import connected_components


def cells(spark, rows, schema="row long, col long"):
    return spark.createDataFrame(rows, schema)


def score(spark, truth, pred):
    r = metric.contributions(cells(spark, truth), cells(spark, pred, "row long, col long, p double")).agg(*metric.totals(None)).first()
    return r.tp, r.fp, r.fn, r.dti


def test_kernel_values(spark):
    got = [r.k for r in spark.createDataFrame([(0.0,), (1.0,), (3.0,), (3.5,)], "d double").select(kernel(F.col("d")).alias("k")).collect()]
    assert got == pytest.approx([1, 2 / 3, 0, 0])


@pytest.mark.parametrize(
    ("truth", "pred", "want"),
    [
        ([(5, 5)], [(5, 5, 1.0)], (1, 0, 0, 1)),
        ([(10, 10)], [(10, 12, 1.0)], (1 / 3, 2 / 3, 2 / 3, 1 / 3)),
        ([(10, 10)], [(10, 11, 1.0)], (2 / 3, 1 / 3, 1 / 3, 2 / 3)),
        ([(5, 5)], [(9, 9, 1.0)], (0, 1, 1, 0)),
        ([(5, 5)], [(5, 5, 0.2), (5, 6, 0.9)], (0.6, 0.3, 0.4, 0.6 / (0.6 + 0.06 + 0.32))),
    ],
)
def test_score_cases(spark, truth, pred, want):
    assert score(spark, truth, pred) == pytest.approx(want, abs=2e-6)


def test_line_of_dots_scores_by_the_full_closed_form(spark):
    """A line of 160 cells dotted every third one, with 200 far dots."""
    truth = [(50, 20 + i) for i in range(160)]
    dots = [(50, 20 + i, 1.0) for i in range(0, 160, 3)] + [(150 + i // 50 * 8, 20 + i % 50 * 8, 1.0) for i in range(200)]
    assert score(spark, truth, dots)[3] == pytest.approx(0.6462, abs=5e-4)


def test_utm_of_known_places(spark):
    """The central meridian is at 500 km; a quarter meridian of GRS80 is 10001965.7293 m long."""
    df = spark.createDataFrame([(-117.0, 0.0), (-117.0, 90.0), (-118.0, 37.0), (-116.0, 37.0)], "lon double, lat double")
    e, n = utm(F.col("lon"), F.col("lat"))
    got = [tuple(r) for r in df.select(e, n).collect()]
    assert got[0] == pytest.approx((500000, 0), abs=1e-3)
    assert got[1][1] == pytest.approx(0.9996 * 10001965.7293, abs=1e-2)
    assert got[2][0] + got[3][0] == pytest.approx(1e6, abs=1e-6) and got[2][1] == pytest.approx(got[3][1], abs=1e-6)


def test_axial_difference(spark):
    df = spark.createDataFrame([(10.0, 170.0), (0.0, 90.0), (350.0, 10.0)], "a double, b double")
    assert [r[0] for r in df.select(axial_difference(F.col("a"), F.col("b"))).collect()] == [20, 90, 20]


def random_points(n, seed, size=300):
    r = random.Random(seed)
    return [(i, r.randint(0, size), r.randint(0, size)) for i in range(n)] + [(n + i, 5, 5) for i in range(4)]


def test_radius_join_equals_brute_force(spark):
    p = random_points(150, 1)
    df = spark.createDataFrame(p, "id long, x long, y long")
    got = {(r.id, r.n_id) for r in spatial.radius_join(df, df, 25.0).collect()}
    assert got == {(a[0], b[0]) for a in p for b in p if math.hypot(a[1] - b[1], a[2] - b[2]) <= 25}


@pytest.mark.parametrize("k", [1, 4, 400])
def test_knn_equals_brute_force(spark, k):
    p = random_points(90, 2) + [(500, 5000, 5000)]
    df = spark.createDataFrame(p, "id long, x long, y long")
    got = {}
    for r in spatial.knn(df, k).collect():
        got.setdefault(r.id, []).append((r.d, r.n_id))
    for a in p:
        want = sorted((math.hypot(a[1] - b[1], a[2] - b[2]), b[0]) for b in p if b[0] != a[0])[:k]
        assert [x[1] for x in sorted(got[a[0]])] == [x[1] for x in want]
    assert spatial.knn(df.limit(0), 2).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (200, 200)] + [(300, 300 + i) for i in range(40)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[102] == 100 and got[200] == 200 and {got[300 + i] for i in range(40)} == {300}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(edges, "src long, dst long"), max_rounds=1)


def test_numbering_is_the_global_order(spark):
    v = [random.Random(4).random() for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in v], "v double").repartition(7)
    got = {r.v: r.rn for r in ranking.numbered(df, "v").collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(v))}
    tied = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 1.0), (4, None)], "id long, v double")
    assert {r.id: r.r for r in ranking.average_ranks(tied, "v", "r", ["id"]).collect()} == {4: 1.0, 3: 2.0, 1: 3.5, 2: 3.5}


def test_greedy_spacing_equals_the_sequential_rule(spark):
    r = random.Random(5)
    rows = [(i, j, float(r.randint(0, 6))) for i in range(18) for j in range(18) if r.random() < 0.8]
    offsets = kernels.disc(2.8, keep_zero=True)
    got = {(x.row, x.col) for x in select.spaced(cells(spark, rows, "row long, col long, v double"), "v", offsets).collect()}
    want = []
    for i, j, v in sorted(rows, key=lambda t: (-t[2], t[0], t[1])):
        if all(math.hypot(i - a, j - b) > 2.8 for a, b in want):
            want.append((i, j))
    assert got == set(want)
    few = select.spaced(cells(spark, rows, "row long, col long, v double"), "v", offsets, n=7).collect()
    assert {(x.row, x.col) for x in few} == set(want[:7])
    assert select.spaced(cells(spark, [], "row long, col long, v double"), "v", offsets).count() == 0


def test_aftershock_windows_flag_a_planted_swarm(spark):
    r = random.Random(6)
    rows = [(i, r.uniform(0, 500), r.uniform(0, 500), r.uniform(0, 3650), r.uniform(1, 2)) for i in range(200)]
    rows += [(1000, 250.0, 250.0, 1800.0, 6.0)] + [(1001 + i, 250 + r.gauss(0, 5), 250 + r.gauss(0, 5), 1800 + r.uniform(0.1, 60), r.uniform(1, 3)) for i in range(100)]
    got = {x.id: x.parent for x in cluster.aftershock_windows(spark.createDataFrame(rows, "id long, x double, y double, t_days double, mag double")).collect()}
    assert len(got) == len(rows) and got[1000] is None
    assert sum(got[1001 + i] is not None for i in range(100)) > 90 and sum(got[i] is not None for i in range(200)) < 40


def test_mixture_threshold_lies_between_planted_means(spark):
    r = random.Random(7)
    df = spark.createDataFrame([(r.gauss(-5, 1),) for _ in range(600)] + [(r.gauss(2, 1),) for _ in range(900)], "v double")
    got = cluster.mixture_threshold(df, "v")
    assert got["mean_low"] == pytest.approx(-5, abs=0.3) and got["mean_high"] == pytest.approx(2, abs=0.3) and -3 < got["threshold"] < 0


def test_mixture_rounds_read_the_values_once(spark, monkeypatch):
    """Weighted nodes give what a round over all values gives, without a job a round."""
    r = random.Random(8)
    df = spark.createDataFrame([(r.gauss(-2, 1),) for _ in range(700)] + [(r.gauss(1, 1.5),) for _ in range(500)], "v double")
    spark.sparkContext.setJobGroup("mixture", "one read")
    got = cluster.mixture_threshold(df, "v")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("mixture"))
    few, exact = [], []
    for bins, out in ((4096, few), (2, exact)):
        monkeypatch.setattr(cluster, "BINS", bins)
        out.append(cluster.mixture_threshold(df, "v", rounds=6))
    assert jobs < 30 and set(got) == set(few[0])
    assert few[0] == pytest.approx(exact[0], abs=1e-9)


def test_large_parts_are_cut_as_those_in_one_task(spark, monkeypatch):
    """Halves by sums over all tasks and halves inside a task are the same parts, in a number of jobs that doesn't grow with their levels."""
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y), i % 2) for i, (x, y) in enumerate(rng.uniform(0, 400, (600, 2)))]
    df = spark.createDataFrame(rows, "id long, x double, y double, label long")
    spark.sparkContext.setJobGroup("parts", "in tasks")
    whole = {r.id: r.part for r in lines.split_clusters(df, "label", 30.0, 6).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("parts"))
    spark.sparkContext.setJobGroup("other", "by sums")
    monkeypatch.setattr(lines, "HELD_POINTS", 150)
    assert {r.id: r.part for r in lines.split_clusters(df, "label", 30.0, 6).collect()} == whole
    assert len(set(whole.values())) > 20 and jobs < 20


def test_axis_of_an_east_west_line(spark):
    rows = [(1, float(i), 0.01 * (i % 3)) for i in range(60)]
    a = points.axis(spark.createDataFrame(rows, "k long, x double, y double"), ["k"], "x", "y", divisor="n-1").first()
    assert abs(a.ux) > 0.98 and 1 - a.l2 / a.l1 > 0.9 and a.l1 == pytest.approx(np.var(range(60), ddof=1), rel=1e-3)


def test_step_edge_is_found_where_it_is(spark):
    rows = [(i, j, 1.0 if j >= 20 else 0.0) for i in range(40) for j in range(40)]
    c = cells(spark, rows, "row long, col long, v double")
    g = fields.gradient(c, "v").filter("row BETWEEN 5 AND 34 AND col BETWEEN 5 AND 34").groupBy("col").agg(F.avg(F.abs("gx")).alias("g")).orderBy(F.desc("g")).first()
    assert g.col in (19, 20)
    t = fields.tensor(c, "v", 1.5).filter("row = 20 AND col = 20").first()
    assert t.coherence > 0.9 and min(t.angle, 180 - t.angle) == pytest.approx(90, abs=12)
    m = fields.matched_step(c, "v").filter("row = 20 AND col BETWEEN 10 AND 30").orderBy(F.desc("response")).first()
    assert m.azimuth == 0 and m.col in (19, 20)


def test_masked_gauss_of_a_constant_is_constant(spark):
    rows = [(i, j, None if (i + j) % 5 == 0 else 3.0) for i in range(12) for j in range(12)]
    got = [r.s for r in kernels.masked_gauss(cells(spark, rows, "row long, col long, v double"), "v", 1.5, "s").collect()]
    assert all(v is None or v == pytest.approx(3.0) for v in got) and sum(v is not None for v in got) > 100


def test_apportionment_and_capped_scale(spark):
    g = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 1.0)], "k string, w double")
    assert {r.k: r.share for r in select.largest_remainder(g, "k", "w", 10).collect()} == {"a": 6, "b": 3, "c": 1}
    f = fit.capped_scale(spark.createDataFrame([(5.0,), (1.0,), (1.0,)], "w double"), "w", 2.0)
    assert min(5 * f, 1) + 2 * min(f, 1) == pytest.approx(2.0)


def test_least_squares_recovers_a_plane(spark):
    r = random.Random(8)
    rows = [(x := r.uniform(0, 10), y := r.uniform(0, 5), 2 + 3 * x - y + r.gauss(0, 0.01)) for _ in range(300)]
    got = fit.ols(spark.createDataFrame(rows, "x double, y double, z double"), [F.lit(1.0), F.col("x"), F.col("y")], F.col("z"))
    assert got["beta"] == pytest.approx([2, 3, -1], abs=0.01) and got["r2"] > 0.999


def test_best_path_follows_a_ridge():
    rng = np.random.default_rng(9)
    reward = rng.uniform(0, 0.1, (20, 11))
    ridge = [5 + round(3 * math.sin(i / 4)) for i in range(20)]
    reward[range(20), ridge] = 1
    path = sequential.best_path(reward, 0.08)
    assert max(abs(np.diff(path))) <= 2 and np.mean(path == ridge) > 0.9


def drained(spark, z, tile):
    rows = [(int(r), int(c), float(z[r, c])) for r, c in zip(*np.nonzero(~np.isnan(z)), strict=True)]
    return {(r.row, r.col): (r.filled, r.direction, r.area) for r in sequential.drainage(cells(spark, rows, "row long, col long, z double"), tile).collect()}


def test_drainage_of_a_tilted_plane_and_a_pit(spark):
    z = np.add.outer(np.zeros(6), np.arange(6.0))
    z[3, 3] = -9
    got = drained(spark, z, 8)
    assert len(got) == 36 and got[3, 3][0] > -9 and all(got[p][0] == z[p] for p in got if p != (3, 3))
    assert sum(area for _, d, area in got.values() if d < 0) == 36


def test_drainage_does_not_depend_on_tiles(spark):
    """Rough ground with flats, pits and holes: levels by brute-force relaxation, areas by following every cell out."""
    rng = np.random.default_rng(4)
    z = np.round(rng.uniform(0, 6, (23, 31)))
    z[10:13, 5:9] = np.nan
    got = drained(spark, z, 64)
    assert got == drained(spark, z, 7)
    level = np.full((25, 33), np.inf)
    ground = np.pad(z, 1, constant_values=np.nan)
    near = lambda a, r, c: [a[r + i, c + j] for i, j in sequential.NEIGHBOURS]
    inside = list(zip(*np.nonzero(~np.isnan(ground)), strict=True))
    for _ in range(200):
        for r, c in inside:
            out = np.isnan(near(ground, r, c)).any()
            level[r, c] = ground[r, c] if out else max(ground[r, c], min(x for x, g in zip(near(level, r, c), near(ground, r, c), strict=True) if not np.isnan(g)))
    assert all(got[r - 1, c - 1][0] == level[r, c] for r, c in inside)
    area = dict.fromkeys(got, 0)
    for p in got:
        steps = 0
        while True:
            area[p] += 1
            if got[p][1] < 0:
                break
            i, j = sequential.NEIGHBOURS[got[p][1]]
            p, steps = (p[0] + i, p[1] + j), steps + 1
            assert steps < 1000
    assert all(got[p][2] == area[p] for p in got)


def test_thinning_leaves_a_line(spark):
    rows = [(i, j) for i in range(5, 10) for j in range(40)]
    got = {(r.row, r.col) for r in sequential.thin(cells(spark, rows)).collect()}
    assert got and all(i == 7 for i, j in got if 4 < j < 35) and len(got) <= 40


def test_thinning_by_tiles_equals_the_whole_grid_in_few_jobs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(int(i), int(j)) for i, j in zip(*np.nonzero(rng.uniform(size=(60, 50)) < 0.93), strict=True)] + [(i - 90, j) for i in range(24) for j in range(24)]
    spark.sparkContext.setJobGroup("thin", "whole")
    whole = {(r.row, r.col) for r in sequential.thin(cells(spark, rows)).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("thin"))
    spark.sparkContext.setJobGroup("other", "tiles")
    monkeypatch.setattr(sequential, "THIN_TILE", 16)
    monkeypatch.setattr(sequential, "THIN_ROUNDS", 2)
    assert {(r.row, r.col) for r in sequential.thin(cells(spark, rows)).collect()} == whole
    assert jobs < 12 and len(whole) < len(rows)
    with pytest.raises(RuntimeError, match="3 rounds"):
        sequential.thin(cells(spark, rows), max_rounds=3)


def test_emission_by_tiles_has_the_same_dots_and_rounds_in_few_jobs(spark, monkeypatch):
    from terrastrat.operators import emission

    rng = np.random.default_rng(7)
    df = cells(spark, [(i - 20, j, float(rng.uniform())) for i in range(50) for j in range(45) if rng.uniform() < 0.9], "row long, col long, pi double")
    spark.sparkContext.setJobGroup("emit", "whole")
    whole = {(r.row, r.col): (r.round, round(r.gain, 9)) for r in emission.emit(df, mass=50.0, bar=0.8).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("emit"))
    spark.sparkContext.setJobGroup("other", "tiles")
    monkeypatch.setattr(emission, "EMIT_TILE", 16)
    monkeypatch.setattr(emission, "EMIT_ROUNDS", 2)
    assert {(r.row, r.col): (r.round, round(r.gain, 9)) for r in emission.emit(df, mass=50.0, bar=0.8).collect()} == whole
    assert jobs < 15 and max(n for n, _ in whole.values()) > 3


def test_plane_of_noisy_points():
    rng = np.random.default_rng(10)
    xy = rng.uniform(-50, 50, (200, 2))
    xyz = np.column_stack([xy, 0.5 * xy[:, 0] + rng.normal(0, 0.5, 200)])
    xyz[:10, 2] += 60
    normal, keep, thickness = sequential.plane(xyz)
    assert not keep[:10].any() and keep[10:].mean() > 0.95 and normal == pytest.approx(np.array([-0.5, 0, 1]) / math.sqrt(1.25), abs=0.02)


def test_bilinear_of_a_ramp(spark):
    c = cells(spark, [(i, j, float(10 * i + j)) for i in range(4) for j in range(4)], "row long, col long, v double")
    p = spark.createDataFrame([(1, 0.5, 0.25), (2, 3.5, 1.0), (3, 2.0, 2.0)], "id long, fr double, fc double")
    assert {r.id: r.v for r in fields.bilinear(p, c, "v").collect()} == {1: 5.25, 2: None, 3: 22.0}


def test_screens_count_every_step(spark):
    df = spark.createDataFrame([("eq", 1.0, 5.0), ("blast", 3.0, 5.0), ("eq", None, 5.0), ("eq", 2.0, 50.0)], "type string, mag double, depth double")
    kept, counters = catalog.screen(df, {"kind": F.col("type") == "eq", "mag": F.col("mag") >= 1, "depth": F.col("depth") < 25})
    assert tuple(counters.first()) == (4, 3, 2, 1) and kept.count() == 1


def test_thinning_keeps_the_largest_of_a_window(spark):
    day = 86_400_000_000
    rows = [(1, 0, 0, day, 1.0), (2, 0, 0, 2 * day, 2.0), (3, 0, 0, 100 * day, 0.5), (4, 0, 0, 101 * day, 1.5)]
    df = spark.createDataFrame(rows, "id long, x long, y long, t_us long, mag double")
    assert {r.id for r in catalog.sequence_thin(df, 250, 90).collect()} == {2, 4}


def test_emission_in_rounds_equals_the_sequential_rule(spark):
    """Greedy by changing gains, on a field where the order of far dots can't matter."""
    from terrastrat.operators import emission

    r = random.Random(11)
    belief = {(i, j): r.random() for i in range(14) for j in range(14)}
    rows = [(i, j, p) for (i, j), p in belief.items()]
    got = {(x.row, x.col) for x in emission.emit(cells(spark, rows, "row long, col long, pi double"), mass=50.0, bar=1.0).collect()}
    near = [(i, j, max(0.0, 1 - math.hypot(i, j) / 3)) for i in range(-3, 4) for j in range(-3, 4)]
    cover, want, blocked = dict.fromkeys(belief, 0.0), set(), set()
    while True:
        gain = {c: sum(belief[c[0] + i, c[1] + j] * max(k - cover[c[0] + i, c[1] + j], 0) for i, j, k in near if (c[0] + i, c[1] + j) in belief) for c in belief if c not in blocked}
        best = min(gain, key=lambda c: (-round(gain[c], 9), c), default=None)
        if best is None or gain[best] <= 1.0:
            break
        want.add(best)
        for i, j, k in near:
            if (c := (best[0] + i, best[1] + j)) in cover:
                cover[c] = max(cover[c], k)
        blocked |= {(best[0] + i, best[1] + j) for i in range(-2, 3) for j in range(-2, 3)}
    assert got == want


def test_emission_goes_on_until_no_cell_passes(spark):
    """Equal gains along a strip are taken in a wave, one dot a round; none is dropped at a bound."""
    import inspect

    from terrastrat.operators import emission

    strip = cells(spark, [(0, j, 0.95) for j in range(16)], "row long, col long, pi double")
    with pytest.raises(RuntimeError):
        emission.emit(strip, mass=50.0, bar=0.6, rounds=1)
    assert inspect.signature(emission.emit).parameters["rounds"].default is None


def test_components_of_a_shuffled_chain_settle_in_few_small_plans(spark):
    """A chain of 5000 nodes in random order; estimates of the plan must not grow with the rounds."""
    names = list(range(5000))
    random.Random(3).shuffle(names)
    edges = spark.createDataFrame([(names[i], names[i + 1]) for i in range(4999)] + [(9000, 9001), (9002, 9002), (None, 9003)], "src long, dst long")
    found = connected_components(edges)
    size = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(size).bit_length() < 256
    got = {r.node: r.component for r in found.collect()}
    assert got == {**dict.fromkeys(range(5000), 0), 9000: 9000, 9001: 9000, 9002: 9002}


def test_clusters_are_cut_into_thin_parts_and_long_ones_kept(spark):
    """Two crossing lines of one cluster come apart at the crossing; a round cloud has no long part."""
    rng = np.random.default_rng(3)
    t = rng.uniform(-100, 100, 120)
    a = np.column_stack([t, 0.02 * rng.normal(size=120)])
    b = np.column_stack([400 + 0.02 * rng.normal(size=120), t])
    cloud = rng.normal(1000, 30, (80, 2))
    rows = [(i, float(x), float(y), "lines" if i < 240 else "cloud") for i, (x, y) in enumerate(np.vstack([a, b, cloud]))]
    df = spark.createDataFrame(rows, "id long, x double, y double, label string")
    parts = {r.id: r.part for r in lines.split_clusters(df, "label", 5.0).collect()}
    assert len({parts[i] for i in range(120)}) == 1 and len({parts[i] for i in range(120, 240)}) == 1 and parts[0] != parts[130]
    found = lines.cluster_lineations(df, "label", 5.0).collect()
    assert sorted(round(abs(r.ux), 2) for r in found if r.ratio > 1000) == [0.0, 1.0]
    assert all(80 < r.half_length < 100 for r in found if r.ratio > 1000)
    assert lines.elongated(df.filter("label = 'cloud'"), "label").count() == 0
    assert lines.split_clusters(df.limit(0), "label", 5.0).count() == 0


def test_the_elongation_s_chance_is_that_of_normal_points(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(x), float(y)) for g in range(3000) for x, y in rng.normal(size=(8, 2))]
    got = lines.elongated(spark.createDataFrame(rows, "g long, x double, y double"), "g", least=8, ratio=1.0, p_most=1.0).select("p").toPandas()["p"]
    assert all(abs((got <= q).mean() - q) < 0.03 for q in (0.05, 0.25, 0.5, 0.75))


def test_corridors_in_line_are_united(spark):
    rows = [(1, 5, 0.0, 0.0, 1.0, 0.0, 10.0, 2.0), (2, 5, 25.0, 0.5, 1.0, 0.0, 10.0, 3.0), (3, 5, 51.0, 0.0, 1.0, 0.0, 10.0, 1.0), (4, 5, 25.0, 40.0, 0.0, 1.0, 10.0, 1.0)]
    got = {r.id: r for r in lines.merge_corridors(spark.createDataFrame(rows, "id long, n long, cx double, cy double, ux double, uy double, half double, width double"), 8.0, 10.0).collect()}
    assert set(got) == {1, 4} and got[1].n == 15 and got[1].width == 3.0
    assert got[1].half == pytest.approx(35.5, abs=0.1) and got[1].cx == pytest.approx(25.5, abs=0.1) and got[4].half == 10.0


def test_batches_equal_the_rule_on_arrays(spark):
    rng = np.random.default_rng(6)
    w = np.round(rng.uniform(0, 0.9, (12, 12)) ** 3, 3)
    rows = [(r, c, float(w[r, c])) for r in range(12) for c in range(12)]
    df = cells(spark, rows, "row long, col long, w double")
    got = {(r.row, r.col): r.round for r in emission.emit_batches(df, df, 7, suppression=1.0).collect()}
    kern = [(i, j, k) for i, j, k in kernels.disc(3.0)]
    levels = sorted({round(k, 12) for _, _, k in kern}, reverse=True)
    penalty, total = np.zeros((12, 12)), w.sum()
    for r in range(12):
        for c in range(12):
            chance, best = 1.0, 0.0
            for k in levels:
                after = chance
                for i, j, v in kern:
                    if round(v, 12) == k and 0 <= r + i < 12 and 0 <= c + j < 12:
                        after *= 1 - w[r + i, c + j]
                best += k * (chance - after)
                chance = after
            penalty[r, c] = 1 - best
    cover, free, t, f, want = np.zeros((12, 12)), np.ones((12, 12), bool), 0.0, 0.0, {}
    for number in range(1, 100):
        bar = 0.2 * t / (0.2 * f + 0.8 * total + 1e-9)
        gain = np.zeros((12, 12))
        for r in range(12):
            for c in range(12):
                gain[r, c] = sum(w[r + i, c + j] * (1 - cover[r + i, c + j]) * k for i, j, k in kern if 0 <= r + i < 12 and 0 <= c + j < 12) - bar * penalty[r, c]
        order = sorted(((-round(gain[r, c], 9), r, c) for r in range(12) for c in range(12) if free[r, c] and gain[r, c] > 1e-9))[:7]
        if not order:
            break
        for _, r, c in order:
            want[r, c] = number
            f += penalty[r, c]
            for i, j, k in kern:
                if 0 <= r + i < 12 and 0 <= c + j < 12:
                    t += w[r + i, c + j] * max(0.0, k - cover[r + i, c + j])
                    cover[r + i, c + j] = max(cover[r + i, c + j], k)
        for _, r, c in order:
            for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)):
                if 0 <= r + i < 12 and 0 <= c + j < 12:
                    free[r + i, c + j] = False
    assert got == want and len(want) > 10


def test_many_methods_are_scored_without_meeting_all_of_truth(spark):
    rng = np.random.default_rng(12)
    t = cells(spark, sorted({(int(r), int(c)) for r, c in rng.integers(0, 30, (60, 2))}))
    p = {(m, int(r), int(c)): float(v) for m in range(6) for r, c, v in zip(*rng.integers(0, 30, (2, 40)), np.round(rng.uniform(0, 1, 40), 2), strict=True)}
    df = cells(spark, [(*k, v) for k, v in p.items()] + [(9, 500, 500, 1.0)], "m long, row long, col long, p double")
    want = metric.contributions(t, df, keys=["m"]).groupBy("m").agg(*metric.totals(None)).collect()
    assert sorted(map(tuple, metric.scores_by_method(t, df, ["m"]).collect())) == sorted(map(tuple, want)) and len(want) == 7


def test_percentiles_of_a_value_that_nearly_all_rows_have(spark):
    """Ninety-nine in a hundred rows hold one value; they are dealt over the tasks and the percentiles stay exact."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, F.col("id").cast("double")).otherwise(7.0).alias("v"), (F.col("id") % 3).alias("g"))
    values = sorted(r.v for r in df.collect())
    got = ranking.percentiles(df, F.col("v"), [0.0, 0.003, 0.5, 0.995, 1.0], list("abcde")).first()
    assert list(got) == pytest.approx([float(np.percentile(values, 100 * q)) for q in (0.0, 0.003, 0.5, 0.995, 1.0)])
    for r in ranking.grouped_percentiles(df, "g", F.col("v"), [0.5, 0.997], ["m", "h"]).collect():
        own = [x.v for x in df.filter(F.col("g") == r.g).collect()]
        assert (r.m, r.h) == pytest.approx((np.percentile(own, 50), np.percentile(own, 99.7))) and r.n == len(own)
    spread = df.select(F.col("v").alias("_v"), ranking._whole(df)).repartitionByRange(8, "_v", "_h").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 2 * 20_000 / 8

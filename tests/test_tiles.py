"""Neighbours, sums over discs and clusters by tiles against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastrat.operators import cluster, parents, points, spatial, tiles


@pytest.fixture
def small_tiles(monkeypatch):
    """Tiles of few points, so that neighbours and clusters cross them."""
    monkeypatch.setattr(tiles, "_side", lambda places, radius: int(max(2 * radius, 16)))


def cloud(n, seed, wide=200):
    draw = random.Random(seed)
    return [(i, draw.randrange(-wide // 2, wide), draw.randrange(wide)) for i in draw.sample(range(10 * n), n)]


def near(p, radius):
    return {a[0]: sorted((math.hypot(a[1] - b[1], a[2] - b[2]), b[0]) for b in p if math.hypot(a[1] - b[1], a[2] - b[2]) <= radius) for a in p}


def named(p, radius, least):
    """(id, core, cluster) by brute force."""
    found = near(p, radius)
    core = {i for i, ns in found.items() if len(ns) >= least}
    cluster_of = {}
    for i in sorted(core):
        todo = [i] if i not in cluster_of else []
        while todo:
            j = todo.pop()
            if j not in cluster_of:
                cluster_of[j] = i
                todo += [b for _, b in found[j] if b in core]
    return {i: (i in core, cluster_of.get(i) if i in core else next((cluster_of[b] for _, b in ns if b in core), None)) for i, ns in found.items()}


def test_clusters_over_tiles_equal_brute_force(spark, small_tiles):
    p = cloud(500, 1) + [(9000 + i, 50, 50) for i in range(6)] + [(9100, 5000, -4000)]
    df = spark.createDataFrame(p, "id long, x long, y long")
    for radius, least in ((9.0, 4), (15.5, 12)):
        assert {r.id: (r.core, r.cluster) for r in cluster.dbscan(df, radius, least).collect()} == named(p, radius, least)
    assert {r.id: r.component for r in cluster.radius_components(df, 11.0).collect()} == {i: c for i, (_, c) in named(p, 11.0, 1).items()}
    halves = df.select("id", (F.col("x") / 2 + 0.25).alias("x"), (F.col("y") / 2).alias("y"))
    assert not tiles.whole(halves) and {r.id: (r.core, r.cluster) for r in cluster.dbscan(halves, 4.5, 4).collect()} == named(p, 9.0, 4)


def test_a_dense_field_is_clustered_without_its_pairs(spark):
    # 40,000 points each within reach of about 20,000: 800 million pairs, were they listed
    field = spark.range(40_000).select("id", (F.col("id") % 200).alias("x"), F.expr("id div 200").alias("y"))
    assert cluster.dbscan(field, 120.0, 4).select("core", "cluster").distinct().collect() == [(True, 0)]
    assert cluster.radius_components(field, 120.0).select("component").distinct().collect() == [(0,)]
    r = points.disc_axes(field, 150.0).filter("id = 20100").first()
    yy, xx = np.mgrid[0:200, 0:200]
    inside = (xx - 100) ** 2 + (yy - 100) ** 2 <= 22500
    assert r.n == inside.sum() and r.cx == pytest.approx((xx - 100)[inside].mean(), abs=1e-9)


def test_disc_axes_equal_those_of_pairs(spark, small_tiles):
    p = cloud(400, 2) + [(9000 + i, 50, 50) for i in range(6)]
    df = spark.createDataFrame(p, "id long, x long, y long").withColumn("m", F.col("id") % 7 + 0.3)
    for weight, divisor in ((None, "n-1"), (1 / F.col("m"), "n")):
        got = {r.id: r for r in points.disc_axes(df, 20.5, weight, divisor).collect()}
        pairs = spatial.radius_join(df.select("id", "x", "y"), df, 20.5).withColumns({"dx": F.col("n_x") - F.col("x"), "dy": F.col("n_y") - F.col("y"), "m": F.col("n_m")})
        want = {r.id: r for r in points.axis(pairs, ["id"], "dx", "dy", weight, divisor=divisor).collect()}
        assert got.keys() == want.keys()
        for i, r in want.items():
            assert got[i].n == r.n and (got[i].l1, got[i].l2, got[i].cx, got[i].cy) == pytest.approx((r.l1, r.l2, r.cx, r.cy), abs=1e-9)


def test_nearest_neighbours_over_tiles_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_POINTS", 60)
    monkeypatch.setattr(tiles, "HELD", 50)
    p = cloud(300, 3) + [(9000 + i, 50, 50) for i in range(30)] + [(9100, 5000, -4000)]
    df = spark.createDataFrame(p, "id long, x long, y long")
    rows = spatial.knn(df, 5, ranks=[1, 2, 5]).collect()
    got = {(r.id, r.rank): (r.d, r.n_id) for r in rows}
    want = {i: [x for x in ns if x[1] != i] for i, ns in near(p, 1e9).items()}
    assert len(rows) == 3 * len(p) and got == {(i, k): ns[k - 1] for i, ns in want.items() for k in (1, 2, 5)}


def test_nearest_within_a_cap_lists_no_pairs(spark, monkeypatch):
    p, t = cloud(200, 4), cloud(40, 5) + [(9000 + i, 50, 50) for i in range(30)]
    monkeypatch.setattr(spatial, "radius_join", None)
    frames = [spark.createDataFrame(rows, "id long, x long, y long") for rows in (p, t)]
    for cap in (4.0, 30.0):
        best = {a[0]: min(((math.hypot(a[1] - b[1], a[2] - b[2]), b[0]) for b in t), default=None) for a in p}
        want = {i: (b[1], b[0]) if b[0] <= cap else (None, None) for i, b in best.items()}
        assert {r.id: (r.nearest, r.d) for r in spatial.nearest_within(*frames, cap).collect()} == want
    assert {r.nearest for r in spatial.nearest_within(frames[0], frames[1].limit(0), 4.0).collect()} == {None}


def test_parents_equal_brute_force_with_ties_and_unknown_magnitudes(spark, monkeypatch):
    monkeypatch.setattr(parents, "LEAF", 4)
    draw = random.Random(6)
    rows = [(i, x, y, draw.randrange(40) * 10**9, None if i % 11 == 0 else draw.randrange(60) / 1.0) for i, x, y in cloud(400, 6)]
    rows += [(9000 + i, 50, 50, 5 * 10**9, 400.0) for i in range(6)] + [(9100, 5000, 0, 0, None), (9101, 5001, 0, 10**9, 1.0)]
    want = {}
    for i, x, y, t, _ in rows:
        met = []
        for j, u, v, s, m in rows:
            d = math.sqrt((x - u) ** 2 + (y - v) ** 2)
            if s < t and d <= 30:
                e = None if m is None else math.log10(max((t - s) / 86400e6, 1 / 86400)) + 1.6 * math.log10(max(d, 0.1)) - m / 100
                met.append((math.inf if e is None else round(e, 9), j, e))
        if met:
            want[i] = (min(met)[1], min((e for _, _, e in met if e is not None), default=None))
    got = {r.id: (r.parent, r.log_eta) for r in parents.parents(spark.createDataFrame(rows, "id long, x long, y long, t_us long, mag double"), 30.0).collect()}
    assert {i: p for i, (p, _) in got.items()} == {i: p for i, (p, _) in want.items()} and want[9101] == (9100, None)
    assert all(got[i][1] == (pytest.approx(e, abs=1e-9) if e is not None else None) for i, (_, e) in want.items())


def test_a_dense_field_has_parents_without_its_pairs(spark):
    # 40,000 events each with up to 40,000 earlier ones in reach
    field = spark.range(40_000).select("id", (F.col("id") % 200).alias("x"), F.expr("id div 200").alias("y"), (F.col("id") * 7919 % 40_000 * 1_000_000).alias("t_us"), F.lit(1.0).alias("mag"))
    order = np.argsort(np.arange(40_000) * 7919 % 40_000)
    x, y = order % 200, order // 200
    early = np.hypot(x[:, None] - x[:300], y[:, None] - y[:300]) <= 120
    some = (early & (np.arange(300) < np.arange(40_000)[:, None])).any(1)
    assert {r.id for r in parents.parents(field, 120.0).select("id").collect()} == set(map(int, order[some]))


def test_unknown_magnitudes_alone_go_by_the_lesser_id(spark):
    rows = [(1, 0, 0, 0, None), (2, 99, 0, 86_000_000_000, None), (3, 100, 0, 86_400_000_000, 1.0)]
    got = {r.id: (r.parent, r.log_eta) for r in parents.parents(spark.createDataFrame(rows, "id long, x long, y long, t_us long, mag double"), 120.0).collect()}
    assert got == {2: (1, None), 3: (1, None)}


def test_equal_pairs_of_events_are_given_once():
    # 3,000 events at one place within a second are equally likely parents of 3,000 later ones: nine million pairs
    zero, n = np.zeros(3000), np.arange(3000.0)
    a, b = parents.likely([zero, zero, n + 5000], [zero, zero, n, zero + 3], 120.0)
    assert sorted(a) == list(range(3000)) and set(b) == {0}


@pytest.mark.parametrize("scale", [1.0, 1e-5])
def test_the_likeliest_events_are_found_whatever_magnitudes_and_times(monkeypatch, scale):
    monkeypatch.setattr(parents, "HELD", 64)
    monkeypatch.setattr(parents, "FIRST", 2)
    monkeypatch.setattr(parents, "MERGED", 50)
    draw = np.random.default_rng(8)
    x, y, t = draw.integers(0, 60, 700) / 2, draw.integers(0, 60, 700) / 2, np.floor(draw.integers(0, 900, 700) * 1e9 * scale)
    m = np.choose(draw.integers(0, 8, 700), [*np.round(draw.exponential(60, (5, 700))), draw.integers(-3, 3, 700) * 30_000.0, np.full(700, 1e6), np.full(700, -700.0)])
    a, b = parents.likely([x, y, t], [x, y, t, m], 12.0)
    d, time = np.hypot(x[:, None] - x, y[:, None] - y), t[:, None] - t
    with np.errstate(invalid="ignore", divide="ignore"):
        eta = np.where((d <= 12) & (time > 0), np.log10(np.maximum(time / 86400e6, 1 / 86400)) + 1.6 * np.log10(np.maximum(d, 0.1)) - m / 100, np.inf)
    least = eta.min(1)
    assert set(a) == set(np.flatnonzero(np.isfinite(least)))
    found = np.full(700, np.inf)
    np.minimum.at(found, a, eta[a, b])
    assert found[np.isfinite(least)] == pytest.approx(least[np.isfinite(least)], abs=1e-9)
    # the first of equal ones is among them
    first = np.argmax(eta <= least[:, None] + 1e-12, axis=1)
    assert {(i, first[i]) for i in set(a)} <= set(zip(a.tolist(), b.tolist(), strict=True))


def test_the_least_lines_of_a_node_hold_at_every_time():
    draw = np.random.default_rng(9)
    times = np.sort(draw.choice(10**6, 300, replace=False)).astype(float)
    n = 64
    begin = draw.integers(0, 300, n)
    lines = [np.concatenate([draw.integers(0, 3, n) * 1e5, [np.inf]]), np.concatenate([draw.exponential(1, n), [0.0]]), np.concatenate([times[begin] - 1, [0.0]])]
    pieces = np.arange(n, dtype=np.int32), begin.astype(np.int32), np.arange(n, dtype=np.int32)
    for _ in range(6):
        pieces = parents.parents_of(*pieces, lines, times)
    value = np.where(begin[:, None] <= np.arange(300), lines[0][:n, None] + lines[1][:n, None] * (times - lines[2][:n, None]), np.inf)
    at = np.searchsorted(pieces[1], np.arange(300), "right") - 1
    assert set(pieces[0]) == {0} and (at >= 0).tolist() == np.isfinite(value.min(0)).tolist()
    keep = at >= 0
    assert value[pieces[2][at[keep]], np.flatnonzero(keep)] == pytest.approx(value.min(0)[keep])


def test_axes_of_light_points_beside_heavy_ones_have_no_noise(spark):
    # pairs one apart and single points, of weights down to 1e-9, in a tile with heavy ones
    draw = random.Random(10)
    rows = [(i, 40 * i % 2000, 40 * (i // 50), draw.random() * 10.0 ** draw.randrange(-9, 1)) for i in range(400)]
    rows += [(1000 + i, x + 1, y, w) for i, x, y, w in rows if i % 3 == 0]
    got = {r.id: r for r in points.disc_axes(spark.createDataFrame(rows, "id long, x long, y long, w double"), 10.0, F.col("w")).collect()}
    weight = {i: w for i, _, _, w in rows}
    assert len(got) == len(rows)
    for i, r in got.items():
        other = weight.get((i + 1000) if i < 1000 else i - 1000)
        if other is None:
            assert (r.n, r.cx, r.cy, r.l1, r.l2) == (1, 0.0, 0.0, 0.0, 0.0)
        else:
            share = other / (weight[i] + other)
            assert (r.n, r.l1, abs(r.cx)) == (2, pytest.approx(share * (1 - share), rel=1e-6, abs=1e-12), pytest.approx(share, rel=1e-9))

"""Random catalogues and significant lines against plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastrat.operators import select, significance


def unit(seed, *values):
    return (int(hashlib.md5(":".join(map(str, (seed, *values))).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


@pytest.mark.parametrize("slice_size", [3, 40, 100_000])
def test_surrogates_follow_the_inverse_of_the_totals(spark, monkeypatch, slice_size):
    """Whatever the slices, each draw lies in the cell whose running total it hits; a third of all points are in one cell."""
    monkeypatch.setattr(significance, "SLICE", slice_size)
    rng = np.random.default_rng(1)
    xy = np.vstack([rng.uniform(0, 90, (60, 2)), np.full((30, 2), 33.0), [[-5, 200]]])
    df = spark.createDataFrame([*map(tuple, xy.tolist()), (None, 3.0)], "x double, y double")
    got = {(r.s, r.i): (r.x, r.y) for r in significance.surrogates(df, 70, 95, 3, 10, 9).collect()}
    high, wide = 8, 10
    w = np.ones(high * wide, int)
    for x, y in xy:
        w[min(max(int(y // 10), 0), high - 1) * wide + min(max(int(x // 10), 0), wide - 1)] += 20
    assert len(got) == 3 * len(xy)
    for (s, i), (x, y) in got.items():
        c = int(np.searchsorted(np.cumsum(w), unit(9, s, i) * float(w.sum()), side="right"))
        assert (x, y) == pytest.approx((c % wide * 10 + unit(10, s, i) * 10, c // wide * 10 + unit(11, s, i) * 10))


def test_surrogates_have_the_density_of_the_points(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(rng.normal(50, 15, (500, 2)).clip(0, 99).tolist(), "x double, y double")
    cell = (F.floor(F.col("y") / 25) * 4 + F.floor(F.col("x") / 25)).alias("c")
    want = {r.c: r["count"] for r in df.groupBy(cell).count().collect()}
    got = {r.c: r["count"] for r in significance.surrogates(df, 99, 99, 20, 25, 5).groupBy(cell).count().collect()}
    total = sum(20 * n + 1 for n in want.values()) + 16 - len(want)
    chi = sum((got.get(c, 0) - e) ** 2 / e for c in range(16) for e in [(20 * want.get(c, 0) + 1) / total * 10_000])
    assert chi < 38  # 15 degrees of freedom: 0.1 % of fair draws lie beyond


def test_no_points(spark):
    none = spark.createDataFrame([], "x double, y double, weight double")
    assert significance.surrogates(none, 50, 50, 3, 10, 1).count() == 0
    assert significance.detect_lines(none, none.select("x", "y"), 3, 50, 50, thetas=12).count() == 0


def plain_lines(col, row, weight, random, count, shape, thetas, width, smooth, z_least, least, extent, degrees, apart, most):
    """Full vote tables and a loop over all peaks."""
    far = math.hypot(*shape) + 2
    n = math.ceil(2 * far / width) + 1
    angle = np.arange(thetas) * np.pi / thetas

    def table(x, y, w):
        v = np.zeros((thetas, n))
        for i, a in enumerate(angle):
            base = np.floor((x * np.cos(a) + y * np.sin(a)) / width + far / width).astype(int)
            for s in range(-smooth, smooth + 1):
                ok = (base + s >= 0) & (base + s < n)
                np.add.at(v[i], (base + s)[ok], w[ok])
        return v

    v, vw = table(col, row, np.ones(len(col))), table(col, row, weight / weight.max())
    lam = table(random[:, 0], random[:, 1], np.ones(len(random))) / count
    z = (v - lam) / np.sqrt(lam + 1)
    found = sorted(((z[i, k], i, k) for i in range(thetas) for k in range(1, n - 1) if z[i, k] > z[i, k - 1] and z[i, k] >= z[i, k + 1] and z[i, k] > z_least and v[i, k] >= least), reverse=True)
    kept = []
    for _, i, k in found:
        turn = lambda j: min(abs(i - j) * 180 / thetas, 180 - abs(i - j) * 180 / thetas)
        if len(kept) < most and not any(turn(j) < degrees and abs(k - m) * width < apart for j, m in kept):
            kept.append((i, k))
    out = {}
    for i, k in kept:
        on = np.abs(col * np.cos(angle[i]) + row * np.sin(angle[i]) - (k * width - far)) <= (smooth + 0.5) * width
        t = row[on] * np.cos(angle[i]) - col[on] * np.sin(angle[i])
        if len(t) >= 3 and np.percentile(t, 95) - np.percentile(t, 5) >= extent:
            out[i, k] = (z[i, k], int(v[i, k] / (2 * smooth + 1)), lam[i, k] / (2 * smooth + 1), np.percentile(t, 95) - np.percentile(t, 5), t.min(), t.max(), vw[i, k])
    return out


@pytest.mark.parametrize(("thetas", "smooth", "most"), [(45, 1, 4000), (24, 0, 3), (60, 2, 4000)])
def test_lines_equal_plain_loops(spark, thetas, smooth, most):
    """Two planted lines, one along the direction at which angles go round, over scattered points; lattice points make ties."""
    rng = np.random.default_rng(thetas)
    a = np.column_stack([np.full(40, 61.0) + rng.normal(0, 0.4, 40), rng.uniform(5, 115, 40)])
    b = np.column_stack([np.linspace(10, 110, 40), np.linspace(20, 90, 40)])
    xy = np.vstack([a, b, rng.integers(0, 120, (200, 2)).astype(float)])
    weight = rng.uniform(0.5, 2, len(xy))
    random = rng.uniform(0, 120, (5 * len(xy), 2))
    df = spark.createDataFrame([(*p, w) for p, w in zip(xy.tolist(), weight.tolist(), strict=True)] + [(None, 1.0, 1.0)], "x double, y double, weight double")
    args = dict(thetas=thetas, width=1.5, smooth=smooth, z_least=1.0, least=4, extent=30.0, degrees=12.0, apart=6.0, most=most)
    got = significance.detect_lines(df, spark.createDataFrame(random.tolist(), "x double, y double"), 5, 120, 120, **args).collect()
    want = plain_lines(xy[:, 0], xy[:, 1], weight, random, 5, (120, 120), **args)
    far = math.hypot(120, 120) + 2
    found = {(round(r.theta * thetas / math.pi), round((r.rho + far) / 1.5)): (r.z, r.n, r.expected, r.extent, r.t_min, r.t_max, r.weighted) for r in got}
    assert set(found) == set(want) and len(want) >= min(most, 3) - 1
    for key, row in want.items():
        assert found[key] == pytest.approx(row)


def test_planted_lines_come_once_and_chance_gives_none(spark):
    rng = np.random.default_rng(8)
    noise = rng.uniform(0, 300, (400, 2))
    line = np.column_stack([rng.uniform(20, 280, 60), np.full(60, 150.0)])
    for points, want in ((noise, 0), (np.vstack([noise, line]), 1)):
        df = spark.createDataFrame([(*p, 1.0) for p in points.tolist()], "x double, y double, weight double")
        random = significance.surrogates(df, 300, 300, 10, 50, 4).select("x", "y")
        got = significance.detect_lines(df, random, 10, 300, 300, thetas=90, z_least=6.0, degrees=20.0, apart=40.0).collect()
        assert len(got) == want
        assert all(abs(r.theta - math.pi / 2) < 0.05 and abs(r.rho - 150) < 3 for r in got)


def plain_spans(x, y, lines, window, z_least, least, merge, side, half):
    out = []
    for th, rho, z, n, t0, t1 in lines:
        d, t = x * math.cos(th) + y * math.sin(th), y * math.cos(th) - x * math.sin(th)
        if t1 - t0 < window:
            out.append((th, rho, z, n, t1 - t0, t0, t1))
            continue
        centres = np.arange(t0, t1 + 1e-9, window / 2)
        count = lambda c, off: int(((np.abs(d - rho - off) <= half) & (np.abs(t - c) <= window / 2)).sum())  # noqa: E731, B023
        beside = np.array([count(c, off) for c in centres for off in (-side, side)])
        bar = max(beside.mean() + z_least * (beside.std() + 1e-9), least)
        spans = []
        for c in centres:
            if count(c, 0.0) > bar:
                if spans and c - window / 2 - spans[-1][1] <= merge + 1e-9:
                    spans[-1][1] = c + window / 2
                else:
                    spans.append([c - window / 2, c + window / 2])
        out += [(th, rho, z, int(((np.abs(d - rho) <= half) & (t >= a) & (t <= b)).sum()), b - a, a, b) for a, b in spans]
    return sorted(out)


@pytest.mark.parametrize(("window", "merge", "z_least"), [(24.0, 12.0, 1.0), (20.0, 35.0, 0.5), (60.0, 0.0, 2.0), (24.0, 12.0, 50.0)])
def test_spans_equal_plain_loops(spark, window, merge, z_least):
    """Points crowd on parts of a vertical and of a slanted line; one line is empty, one short and one has negative rho."""
    rng = np.random.default_rng(5)
    up = np.column_stack([150 + rng.normal(0, 0.5, 90), np.concatenate([rng.uniform(10, 70, 45), rng.uniform(130, 200, 45)])])
    t = np.concatenate([rng.uniform(-60, -10, 30), rng.uniform(60, 120, 40)])
    th = 2 * math.pi / 3
    slanted = np.column_stack([-20 * math.cos(th) - t * math.sin(th) + 150, -20 * math.sin(th) + t * math.cos(th) + 60])
    xy = np.vstack([up, slanted, rng.uniform(0, 250, (500, 2))])
    rho = float(slanted[0, 0] * math.cos(th) + slanted[0, 1] * math.sin(th)) + 0.2
    lines = [(0.0, 150.0, 9.0, 90, 5.3, 205.1), (th, rho, 7.0, 70, -250.7, 260.2), (math.pi / 2, 240.5, 6.5, 8, -20.0, -5.0), (math.pi / 3, -9000.0, 6.1, 9, 0.0, 100.0)]
    df = spark.createDataFrame([*xy.tolist(), [None, 1.0]], "x double, y double")
    got = significance.local_spans(df, spark.createDataFrame(lines, "theta double, rho double, z double, n long, t_min double, t_max double"), 180, window, z_least, 3, merge)
    want = plain_spans(xy[:, 0], xy[:, 1], lines, window, z_least, 3, merge, 5.0, 1.5)
    found = sorted(tuple(r) for r in got.select("theta", "rho", "z", "n", "extent", "t_min", "t_max").collect())
    assert len(found) == len(want) and (len(want) > 2 or z_least > 2)
    for a, b in zip(found, want, strict=True):
        assert a == pytest.approx(b)


def test_spacing_on_rows_that_go_round(spark):
    rng = np.random.default_rng(3)
    cells = {(int(r), int(c)): float(rng.integers(0, 6)) for r in range(12) for c in range(15)}
    ring = [(i, j, 1.0) for i in range(-2, 3) for j in (-1, 0, 1)]
    got = select.spaced(spark.createDataFrame([(*k, v) for k, v in cells.items()], "row long, col long, v double"), "v", ring, period=12)
    taken = []
    for _, r, c in sorted((-v, *k) for k, v in cells.items()):
        if all(min((r - y) % 12, (y - r) % 12) > 2 or abs(c - x) > 1 for y, x in taken):
            taken.append((r, c))
    assert {(x.row, x.col) for x in got.collect()} == set(taken)


def test_votes_and_lines_copy_no_point_for_each_direction(spark, monkeypatch):
    """Votes beside the grid and without a place among them; the rows of a point and direction are never made."""
    monkeypatch.setattr(significance, "_turned", lambda *_: pytest.fail("a row for each point and direction"))
    rng = np.random.default_rng(4)
    xy = np.vstack([rng.uniform(-40, 140, (300, 2)), np.column_stack([np.full(60, 50.0), rng.uniform(0, 100, 60)])])
    df = spark.createDataFrame([*[(*p, 1.0) for p in xy.tolist()], (None, 1.0, 1.0)], "x double, y double, weight double")
    random = spark.createDataFrame([*rng.uniform(-40, 140, (300, 2)).tolist(), [None, 2.0]], "x double, y double")
    got = {(r.theta, r.bin): r.votes for r in significance.line_significance(df, random, 1, 100, 100, 12, 3.0, 0).collect()}
    far, want = math.hypot(100, 100) + 2, {}
    for i in range(12):
        for x, y in xy:
            b = math.floor((x * math.cos(i * math.pi / 12) + y * math.sin(i * math.pi / 12)) / 3.0 + far / 3.0)
            want[i, b] = want.get((i, b), 0) + (0 <= b <= math.ceil(2 * far / 3.0))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    lines = significance.detect_lines(df, random, 1, 100, 100, 12, 3.0, z_least=3.0, extent=20.0)
    assert lines.count() >= 1 and significance.local_spans(df, lines, 12, z_least=0.5).count() >= 0

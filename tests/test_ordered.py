"""Ordered selections against the sequential rules, ends and bridges of lines against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastrat.operators import ordered, tips


def cells(spark, grid, name):
    return spark.createDataFrame([(int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(grid)], f"row long, col long, {name} double")


def one_by_one(grid, allowed, most, mass, start, least):
    """Every cell asked in turn, with the kernel's places and the bar worked out anew."""
    best, total, out = np.zeros(grid.shape), 0.0, []
    order = sorted((-v, r, c) for (r, c), v in np.ndenumerate(grid) if allowed[r, c] and v > least)
    for _, r, c in order:
        gain = top = 0.0
        for y in range(max(0, r - 3), min(grid.shape[0], r + 4)):
            for x in range(max(0, c - 3), min(grid.shape[1], c + 4)):
                k = 1 - math.hypot(y - r, x - c) / 3
                if k > best[y, x]:
                    gain += max(grid[y, x], 0) * (k - best[y, x])
                    top = max(top, k)
        bar = total / (0.2 * (2 * len(out) + 1) + 0.8 * mass) if out else start
        if gain <= 0.2 * bar * (gain + 1 - top):
            continue
        for y in range(max(0, r - 3), min(grid.shape[0], r + 4)):
            for x in range(max(0, c - 3), min(grid.shape[1], c + 4)):
                best[y, x] = max(best[y, x], 1 - math.hypot(y - r, x - c) / 3)
        total += gain
        out.append((r, c, gain, total))
        if len(out) >= most:
            break
    return out


CASES = [(2000, 90.0, 5, 9.0), (60, 1e4, 7, 1.0), (2000, 40.0, 3, 5.0), (2000, 1e4, 4, 1.0)]


@pytest.mark.parametrize(("most", "mass", "levels", "scale"), CASES)
def test_emission_in_order_equals_the_sequential_rule(spark, monkeypatch, most, mass, levels, scale):
    """Few levels of belief, so most places are decided by ties; running totals cross blocks. Beliefs are credit densities, so they may be over 1."""
    monkeypatch.setattr(ordered, "BLOCK", 17)
    rng = np.random.default_rng(levels)
    grid = scale * rng.integers(0, levels, (18, 23)) / levels
    allowed = rng.random(grid.shape) < 0.8
    domain = spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(allowed)], "row long, col long")
    got = ordered.emit_in_order(cells(spark, grid, "pi"), most, mass, domain=domain).orderBy("rn").collect()
    want = one_by_one(grid, allowed, most, mass, 0.25, 1e-6)
    assert [(x.row, x.col) for x in got] == [w[:2] for w in want] and want
    assert [x.gain for x in got] == pytest.approx([w[2] for w in want]) and [x.total for x in got] == pytest.approx([w[3] for w in want])


def test_the_bar_ends_some_emissions_early():
    """The cases above hold some that the bar cuts, after blocks of dots, and some that it doesn't."""
    cut = []
    for most, mass, levels, scale in CASES:
        grid = scale * np.random.default_rng(levels).integers(0, levels, (18, 23)) / levels
        n = len(one_by_one(grid, np.ones(grid.shape, bool), most, mass, 0.25, 1e-6))
        cut.append(17 < n < min(most, (grid > 0).sum()))
    assert sorted(set(cut)) == [False, True]


def test_no_candidates_and_no_cells(spark):
    none = spark.createDataFrame([(1, 1, None), (1, 2, 0.0)], "row long, col long, pi double")
    assert ordered.emit_in_order(none, 10, 5.0).count() == 0
    assert ordered.emit_in_order(none.limit(0), 10, 5.0).count() == 0
    assert ordered.pack(none, "pi", 5).count() == 0
    assert ordered.emit_in_order(none.fillna(1.0), 10, 5.0, start=5.0).count() == 0


def greedy(score, ok, reach, budget):
    taken = []
    for _, r, c in sorted((-v, r, c) for (r, c), v in np.ndenumerate(score) if ok[r, c]):
        if len(taken) < budget and all(math.hypot(r - y, c - x) > reach for y, x in taken):
            taken.append((r, c))
    return set(taken)


@pytest.mark.parametrize(("budget", "reach"), [(7, 2), (500, 2), (12, 0), (5, 3)])
def test_packing_equals_the_sequential_rule(spark, budget, reach):
    grid = np.random.default_rng(budget).integers(-2, 9, (40, 41)).astype(float)
    got = {(x.row, x.col) for x in ordered.pack(cells(spark, grid, "v"), "v", budget, reach).collect()}
    flat = sorted((-v, r, c) for (r, c), v in np.ndenumerate(grid))[: max(10 * budget, budget + 1000)]
    part = np.zeros(grid.shape, bool)
    for v, r, c in flat:
        part[r, c] = -v > 0
    assert got == greedy(grid, part, reach if reach else 0.5, budget)


@pytest.mark.parametrize("reach", [0.5, 1.0, 2.3])
def test_choice_at_mass(spark, reach):
    rng = np.random.default_rng(4)
    p, inside, free = rng.integers(0, 6, (22, 25)) / 6, rng.random((22, 25)) < 0.7, rng.random((22, 25)) < 0.8
    df = spark.createDataFrame([(int(r), int(c), float(v), bool(inside[r, c]), bool(free[r, c])) for (r, c), v in np.ndenumerate(p)], "row long, col long, p double, a boolean, b boolean")
    got = {(x.row, x.col) for x in ordered.at_mass(df, "p", F.col("a"), F.col("b"), 25, reach).collect()}
    credit = np.zeros(p.shape)
    for (r, c), _ in np.ndenumerate(p):
        for (y, x), v in np.ndenumerate(np.where(inside, p, 0)):
            credit[r, c] += v * max(0.0, 1 - math.hypot(y - r, x - c) / 3)
    credit = np.round(credit, 9)
    assert got == greedy(credit, inside & free & (credit > 0), reach, 25)


def plain_bridges(skel, ridge, rows, cols, gap, tol, extend, project, shift):
    """Loops over all ends and cells; covariances by numpy."""
    skel = set(skel)
    tip = sorted((r, c) for r, c in skel if sum((r + i, c + j) in skel for i in (-1, 0, 1) for j in (-1, 0, 1)) == 2)
    strike, away = {}, {}
    for e in tip:
        near = np.array([p for p in skel if math.dist(p, e) <= 5], float)
        off = e - near.mean(axis=0)
        away[e] = off / np.hypot(*off)
        strike[e] = None
        if len(near) >= 3:
            v = np.linalg.eigh(np.cov((near - e).T))[1][:, 1]
            strike[e] = math.degrees(math.atan2(v[0], v[1])) % 180
    support, paired, n_pairs, n_kept = set(), set(), 0, 0

    def draw(a, b, n):
        for t in range(n):
            r, c = a + (b - a) * t / (n - 1)
            support.add((min(max(round(round(r, 9)), 0), rows - 1), min(max(round(round(c, 9)), 0), cols - 1)))

    for i, a in enumerate(tip):
        for b in tip[i + 1 :]:
            d = math.dist(a, b)
            if d > gap:
                continue
            n_pairs += 1
            paired |= {a, b}
            line = math.degrees(math.atan2(b[0] - a[0], b[1] - a[1])) % 180
            if d < 2 or strike[a] is None or strike[b] is None or any(abs((line - strike[t] + 90) % 180 - 90) > tol for t in (a, b)):
                continue
            n_kept += 1
            u = (np.array(b) - np.array(a)) / d
            draw(np.array(a) - u * extend, np.array(b) + u * extend, max(int(round(d + 2 * extend, 9)) + 1, 2))
    lone = [e for e in tip if e not in paired and strike[e] is not None]
    for e in lone:
        draw(np.array(e, float), e + away[e] * project, max(int(project) + 1, 2))
    moved = set()
    for r, c in support:
        best = max(((ridge[y, x], -y, -x) for y in range(max(0, r - shift), min(rows, r + shift + 1)) for x in range(max(0, c - shift), min(cols, c + shift + 1)) if math.dist((y, x), (r, c)) <= shift))
        if best[0] > 0:
            moved.add((-best[1], -best[2]))
    return moved, (len(skel), len(tip), n_pairs, n_kept, len(lone), len(support), len(moved))


def test_bridges_equal_plain_loops(spark):
    rows, cols = 60, 80
    line = {(10, c) for c in range(5, 25)} | {(10, c) for c in range(35, 55)}  # broken along one line
    line |= {(r, 70) for r in range(20, 40)}  # alone
    line |= {(r, 30) for r in range(45, 56)} | {(40, c) for c in range(10, 22)} | {(52 + i, 2 + i) for i in range(6)}
    ridge = np.random.default_rng(3).normal(size=(rows, cols))
    df = spark.createDataFrame(sorted(line), "row long, col long")
    got, report = tips.tip_bridges(df, cells(spark, ridge, "v"), "v", rows, cols, gap=14.0, tolerance=40.0)
    from terrastrat.operators.sequential import thin

    skel = [(x.row, x.col) for x in thin(df).collect()]
    want, counts = plain_bridges(skel, ridge, rows, cols, 14.0, 40.0, 15.0, 10.0, 5)
    assert {(x.row, x.col) for x in got.collect()} == want
    assert tuple(report.first()) == counts and counts[3] >= 1 and counts[2] > counts[3] and counts[4] >= 2


def test_a_broken_line_is_bridged_and_a_crossing_one_is_not(spark):
    line = [(20, c) for c in range(5, 20)] + [(20, c) for c in range(28, 45)]
    across = [(r, 24) for r in range(22, 40)]
    met = tips.pairs(tips.ends(spark.createDataFrame(line + across, "row long, col long")), 10.0, 30.0).filter("agrees").collect()
    assert [(x.row, x.col, x.n_row, x.n_col) for x in met] == [(20, 19, 20, 28)]


def test_no_lines(spark):
    none = spark.createDataFrame([], "row long, col long")
    got, report = tips.tip_bridges(none, cells(spark, np.ones((3, 3)), "v"), "v", 3, 3)
    assert got.count() == 0 and tuple(report.first()) == (0,) * 7
    assert tips.continued(none, 5, 5).count() == 0


def plain_continued(mask, sigma):
    t = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-t, t + 1) / sigma) ** 2)
    w /= w.sum()

    def blur(a):
        a = np.pad(a, t, mode="symmetric")
        a = np.apply_along_axis(np.convolve, 0, a, w, "same")
        return np.apply_along_axis(np.convolve, 1, a, w, "same")[t:-t, t:-t]

    gy, gx = np.gradient(blur(mask.astype(float)))
    theta = 0.5 * np.arctan2(2 * blur(gx * gy), blur(gx * gx) - blur(gy * gy))
    out = np.zeros(mask.shape)
    at = np.argwhere(mask)
    for s in range(3, 31, 3):
        for sign in (1, -1):
            for r, c in at:
                y = min(max(r + sign * int(np.rint(s * np.sin(theta[r, c]))), 0), mask.shape[0] - 1)
                x = min(max(c + sign * int(np.rint(s * np.cos(theta[r, c]))), 0), mask.shape[1] - 1)
                out[y, x] = max(out[y, x], 1 - s / 40)
    for (r, c), _ in np.ndenumerate(out):
        d = min(math.dist((r, c), p) for p in at)
        out[r, c] = 0 if d < 1.5 else out[r, c] * min(max(1 - (d - 2) / 30, 0), 1)
    return out


def test_continuations_equal_plain_arrays(spark):
    mask = np.zeros((44, 52), bool)
    mask[np.arange(4, 20), np.arange(10, 26)] = True
    mask[30:33, 28:45] = True
    mask[0, 40:44] = mask[25, 3] = True
    got = tips.continued(spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(mask)], "row long, col long"), *mask.shape, sigma=3.0)
    found = np.zeros(mask.shape)
    for x in got.collect():
        found[x.row, x.col] = x.value
    assert np.allclose(found, plain_continued(mask, 3.0), atol=1e-9) and (found > 0).sum() > 40


def test_images_over_two_borders(spark):
    got = tips.mirrored(spark.createDataFrame([(0, 3), (4, 4)], "row long, col long"), 9, 5, 2).collect()
    assert sorted((x.row, x.col) for x in got) == sorted([(0, 3), (-1, 3), (0, 6), (-1, 6), (4, 4), (4, 5)])


def test_a_support_of_the_past_is_scored_on_new_cells_only(spark):
    rng = np.random.default_rng(12)
    early = [(int(r), int(c), True) for r, c in rng.normal(15, 3, (150, 2)).round()]
    late = [(int(r), int(c), False) for r, c in rng.normal(15, 5, (120, 2)).round()]
    df = spark.createDataFrame([*early, *late, (1, 1, None)], "row long, col long, early boolean")
    got = {r.way: r for r in ordered.temporal_holdout(df, F.col("early")).collect()}
    n = {}
    for r, c, _ in early:
        n[r, c] = n.get((r, c), 0) + 1
    support, truth = {p for p, k in n.items() if k >= 2}, {(r, c) for r, c, _ in late} - set(n)
    credit = sum(max(0.0, 1 - min(math.dist(t, s) for s in support) / 3) for t in truth)
    r = got["repeated"]
    assert (r.mass, r.truth) == (len(support), len(truth)) and r.tpw == pytest.approx(credit) and r.covered == pytest.approx(credit / len(truth))
    assert set(got) == {"repeated", "density 1", "density 2", "random"} and {x.mass for x in got.values()} == {len(support)}
    assert ordered.temporal_holdout(df.limit(0), F.col("early")).count() == 0

"""Wide windows and left-out posteriors against plain re-computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastrat.operators import windows


@pytest.mark.parametrize("size", [3, 9, 41, 101])
def test_box_means_of_sparse_cells(spark, size):
    rng = np.random.default_rng(size)
    grid = np.where(rng.random((30, 45)) < 0.4, rng.normal(size=(30, 45)), np.nan)
    grid[7] = np.nan
    rows = [(int(r) - 3, int(c) + 5, float(grid[r, c])) for r, c in zip(*np.nonzero(~np.isnan(grid)), strict=True)]
    got = {(x.row + 3, x.col - 5): x[f"m{size}"] for x in windows.box_means(spark.createDataFrame(rows, "row long, col long, v double"), "v", [size, 5]).collect()}
    h = size // 2
    assert len(got) == len(rows)
    for (r, c), m in got.items():
        assert m == pytest.approx(np.nanmean(grid[max(0, r - h) : r + h + 1, max(0, c - h) : c + h + 1]), abs=1e-9)


def test_box_means_that_go_on_beyond_the_border(spark):
    grid = np.random.default_rng(2).normal(size=(12, 17))
    df = spark.createDataFrame([(int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(grid)], "row long, col long, v double")
    for size in (5, 31):
        h = size // 2
        wide = np.pad(grid, h, mode="edge")
        for x in windows.box_means(df, "v", [size], edges=True).collect():
            assert x[f"m{size}"] == pytest.approx(wide[x.row : x.row + size, x.col : x.col + size].mean(), abs=1e-9)


def test_no_cells(spark):
    assert windows.box_means(spark.createDataFrame([], "row long, col long, v double"), "v", [9]).count() == 0


def test_a_left_out_artifact_has_no_say(spark):
    """Each prediction equals a run of its own in which the artifact's weight is zero."""
    rng = np.random.default_rng(6)
    dots = {a: {(int(r), int(c)) for r, c in rng.integers(0, 25, (40 + 20 * a, 2))} for a in range(5)}
    dots[4] = dots[3]
    scores = {0: 0.2, 1: 0.25, 2: 0.05, 3: 0.22, 4: 0.22}
    df = spark.createDataFrame([(a, r, c) for a, d in dots.items() for r, c in d], "a long, row long, col long")
    got = windows.leave_one_out(df, spark.createDataFrame(list(scores.items()), "a long, score double"), 0.05, 300.0, inside=F.col("row").between(0, 24) & F.col("col").between(0, 24)).collect()
    yy, xx = np.mgrid[0:25, 0:25]

    def field(d, how):
        return how([np.clip(1 - np.hypot(yy - r, xx - c) / 3, 0, None) for r, c in d], axis=0)

    s, c = {a: field(d, np.sum) for a, d in dots.items()}, {a: field(d, np.max) for a, d in dots.items()}
    for r in got:
        q = sum(np.exp(scores[a] / 0.05) * s[a] for a in dots if a != r.a)
        q = q / q.sum()
        t, mp = 300 * (q * c[r.a]).sum(), 300 * (q * s[r.a]).sum()
        assert r.predicted == pytest.approx(t / (0.2 * (len(dots[r.a]) - mp + t) + 0.8 * 300), rel=1e-9)

"""Aftershock windows by tiles against a plain loop over all events."""

import math

import numpy as np
import pytest

from terrastrat.operators import cluster, decluster

FIELDS = "id long, x double, y double, t_days double, mag double"


def plainly(rows):
    """The largest event first takes what is left inside its window."""
    found, order = {r[0]: None for r in rows}, sorted((r for r in rows if None not in r and not any(map(math.isnan, r))), key=lambda r: (-r[4], r[0]))
    taken = set()
    for n, (i, x, y, t, m) in enumerate(order):
        if i in taken:
            continue
        reach, days = 10 ** (0.1238 * m + 0.983), 10 ** (0.032 * m + 2.7389 if m >= 6.5 else 0.5409 * m - 0.547)
        for j, u, v, s, _ in order[n + 1 :]:
            if j not in taken and math.hypot(x - u, y - v) <= reach and abs(t - s) <= days:
                taken.add(j)
                found[j] = i
    return found


@pytest.mark.parametrize(("points", "most", "days"), [(50, 2.0, 40.0), (20, 3.0, 4000.0), (400, 7.0, 9000.0), (40_000, 2.5, 1.0)])
def test_windows_equal_a_plain_loop_whatever_the_tiles(spark, monkeypatch, points, most, days):
    monkeypatch.setattr(decluster, "TILE_POINTS", points)
    monkeypatch.setattr(decluster, "BLOCK", 16)
    rng = np.random.default_rng(points)
    n = 1500
    # equal magnitudes and equal places are among them
    mag = np.round(rng.uniform(1, most, n), 1)
    rows = [*zip(range(n), np.round(rng.uniform(-300, 700, n), 0).tolist(), np.round(rng.uniform(0, 900, n), 0).tolist(), rng.uniform(0, days, n).tolist(), mag.tolist(), strict=True)]
    rows += [(n, None, 1.0, 2.0, 3.0), (n + 1, 5.0, 5.0, None, 3.0), (n + 2, 5.0, 5.0, 2.0, None), (n + 3, float("nan"), 5.0, 2.0, 2.0)]
    got = {r.id: r.parent for r in cluster.aftershock_windows(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == plainly(rows)


def test_a_crowd_is_not_listed_by_pairs(spark):
    """2,000 events in one window: no stage writes or shuffles more than a few rows for each."""
    rng = np.random.default_rng(3)
    n = 2000
    rows = [*zip(range(n), rng.uniform(0, 4, n).tolist(), rng.uniform(0, 4, n).tolist(), rng.uniform(0, 0.2, n).tolist(), rng.uniform(1, 2, n).tolist(), strict=True)]
    df = spark.createDataFrame(rows, FIELDS)
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    known = {stages().apply(i).stageId() for i in range(stages().size())}
    got = {r.id: r.parent for r in cluster.aftershock_windows(df).collect()}
    found = stages()
    sent = [max(s.shuffleWriteRecords(), s.outputRecords()) for i in range(found.size()) if (s := found.apply(i)).stageId() not in known]
    assert got == plainly(rows) and len(sent) > 2 and max(sent) <= 10 * n


def test_no_events(spark):
    assert cluster.aftershock_windows(spark.createDataFrame([], FIELDS)).count() == 0

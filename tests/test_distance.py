"""Exact distances against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrastrat.operators import distance


def brute(cells, sources):
    """(row, col, source's row and column, squared distance), ties by the source's place."""
    s = np.array(sorted(set(sources)))
    out = []
    for r, c in cells:
        d = ((s - (r, c)) ** 2).sum(axis=1)
        out.append((r, c, *map(int, s[d.argmin()]), int(d.min())))
    return sorted(out)


def got(spark, cells, sources, height=64):
    frame = lambda rows: spark.createDataFrame(rows, "row long, col long")
    return sorted(map(tuple, distance.nearest(frame(cells), frame(sources), height).collect()))


def test_one_source_reaches_the_whole_grid(spark):
    cells = [(r, c) for r in range(300) for c in range(300)]
    assert got(spark, cells, [(3, 290)], 50) == brute(cells, [(3, 290)])


@pytest.mark.parametrize("seed", range(3))
def test_random_masks_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    tall, wide = 70 + 40 * seed, 130 - 50 * seed
    cells = [(int(r), int(c)) for r, c in rng.integers(-20, [tall, wide], (1500, 2))]
    sources = [(int(2 * r), int(2 * c)) for r, c in rng.integers(-15, [tall // 2, wide // 2], (12 * (1 + 20 * seed), 2))]
    assert got(spark, cells, sources, 16) == brute(cells, sources)


def test_results_do_not_depend_on_strips(spark):
    rng = np.random.default_rng(9)
    cells = [(int(r), int(c)) for r, c in rng.integers(0, 200, (800, 2))]
    sources = [(int(r), int(c)) for r, c in rng.integers(0, 200, (30, 2))]
    assert got(spark, cells, sources, 1) == got(spark, cells, sources, 7) == got(spark, cells, sources, 1000) == brute(cells, sources)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 11)), min_size=1, max_size=25))
def test_one_strip_by_envelopes(sources):
    columns = sorted({c for _, c in sources})
    inside = [sorted({r for r, x in sources if x == c}) for c in columns]
    none = np.full(len(columns), distance._NONE)
    near = distance.above_and_below(10, inside, none, none)
    r, c = np.divmod(np.arange(120), 12)
    y, x = distance.nearest_in_strip(r, c, 10, 12, 10, near, np.array(columns))
    assert [(*p, *q) for p, q in zip(zip(r, c, strict=True), zip(y, x, strict=True), strict=True)] == [b[:4] for b in brute(list(zip(r, c, strict=True)), sources)]


def test_no_sources_and_no_cells(spark):
    assert got(spark, [(1, 2)], []) == [(1, 2, None, None, None)]
    assert got(spark, [], [(1, 2)]) == []


def test_steps_do_not_grow_with_distances():
    """A source far away costs as many steps of the envelope as one near by: one for each source column."""
    for far in (1, 10_000):
        near = np.full((4, 1), far)
        owner, start, top = distance.envelope((np.arange(4)[:, None] - near) ** 2, np.array([0]), 1, 1_000_000)
        assert owner.shape == (4, 1) and (top == 0).all() and (start[:, 0] == 0).all()


def test_edges_of_a_footprint(spark):
    cells = [(r, c) for r in range(20) for c in range(30) if (r - 9) ** 2 + (c - 14) ** 2 < 80]
    outside = [(r, c) for r in range(20) for c in range(30) if (r, c) not in set(cells)]
    df = spark.createDataFrame(cells, "row long, col long")
    want = {(r, c): d for r, c, _, _, d in brute(cells, outside)}
    assert {(x.row, x.col): round(x.distance**2) for x in distance.edge_distances(df, 20, 30).collect()} == want
    whole = spark.createDataFrame([(r, c) for r in range(5) for c in range(5)], "row long, col long")
    assert {x.distance for x in distance.edge_distances(whole, 5, 5).collect()} == {None}
    assert distance.edge_distances(whole).agg(F.max("distance")).first()[0] == 3.0


def test_values_are_filled_from_any_distance(spark):
    df = spark.createDataFrame([(0, 0, 7.0), (0, 900, None), (500, 0, float("nan")), (600, 900, 9.0)], "row long, col long, v double")
    assert {(x.row, x.col): x.v for x in distance.filled(df, "v", df).collect()} == {(0, 0): 7.0, (0, 900): 9.0, (500, 0): 7.0, (600, 900): 9.0}


def test_a_footprint_without_an_outside_has_no_edge_distance_but_all_its_cells(spark, tmp_path):
    """A grid that is full: the query and its SQL both give each cell, with null."""
    from oracle import connect, rows_of, rows_of_sql

    from terrastrat.plans import registry

    every = spark.range(256 * 256).select(F.expr("id div 256").alias("row"), (F.col("id") % 256).alias("col"))
    lines = every.select(F.col("row").alias("l_partkey"), F.lit(0).cast("long").alias("l_suppkey"), F.col("col").alias("l_orderkey"), F.lit(1.0).alias("l_extendedprice"), F.lit(1.0).alias("l_quantity"))
    lines.unionByName(lines).toPandas().to_parquet(tmp_path / "lineitem.parquet")
    found = rows_of(registry.queries()["edge_distance"](spark, str(tmp_path)))
    assert len(found[1]) == 256 * 256 and found == rows_of_sql(connect(str(tmp_path)), registry.oracle_sql()["edge_distance"])

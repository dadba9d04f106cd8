"""Gutters, bullets and grids are told in one pass over a page, without joins of its rows."""

import pytest
from conftest import SF

from pagewright.operators import painted, reading
from pagewright.plans import painting
from pagewright.plans import reading as plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("queries", "name"), [(plans.QUERIES, "column_gutters"), (plans.QUERIES, "grid_runs"), (plans.QUERIES, "bullet_targets"), (painting.QUERIES, "stray_bullets")])
def test_pages_are_told_without_joins(spark, queries, name):
    found = plan(queries[name](spark, SF))
    assert "Join" not in found
    assert "REPARTITION_BY_NUM" in found


def test_gutters_of_odd_rows(spark):
    side = lambda page, x0, x1: [(page, x0, x1)] * 2
    rows = spark.createDataFrame([*side(1, 0.0, 100.0), *side(1, 120.0, 220.0), *side(2, 0.0, 100.0), (2, 120.0, 220.0), *side(None, 0.0, 100.0), *side(None, 120.0, 220.0), *[(3, None, None)] * 4, *side(4, 0.0, 100.0), *side(4, 120.0, 220.0), (4, None, None)], "page int, x0 double, x1 double")
    assert sorted(map(tuple, reading.column_gutters(rows, 8.0).collect())) == [(1, 100.0, 120.0, 2, 2, 0), (4, 100.0, 120.0, 2, 2, 0)]


def test_bullets_of_odd_lines(spark):
    line = lambda page, name, x, y, bullet: (page, name, x, y, 10.0, bullet)
    rows = spark.createDataFrame([
        line(1, "b", 0.0, 100.0, True), line(1, "t", 10.0, 97.0, False), line(1, "u", 10.0, 103.0, False), line(1, "far", 50.0, 100.0, False), line(1, "n", None, 100.0, False), line(1, "m", 10.0, None, True),
        line(2, "b", 0.0, 100.0, True), line(2, "c", 0.0, 96.0, True), line(2, "t", 10.0, 97.0, False), line(None, "b", 0.0, 100.0, True), line(None, "t", 10.0, 100.0, False), line(3, "b", 0.0, 100.0, True), line(4, "x", 0.0, 1.0, None),
    ], "page int, id string, x double, y double, size double, bullet boolean")
    assert sorted(map(tuple, reading.bullet_targets(rows).collect())) == [(1, "b", "t"), (2, "c", "t")]
    assert list(map(tuple, painted.stray_bullets(reading.bullet_pairs(rows)).collect())) == [(1, "b", "t", -3.0)]


def test_grids_of_odd_lines(spark):
    rows = spark.createDataFrame([(1, n, x) for n, xs in enumerate([(0.0, 50.0), (4.0, 54.9), (9.0, 60.0), (0.0, None), (0.0, 0.0), (0.0, 50.0)]) for x in xs] + [(None, 0, 0.0), (None, 0, 9.0), (None, 1, 0.0), (None, 1, 9.0)], "page int, line_no int, x double")
    assert sorted(map(tuple, reading.grid_runs(rows).collect())) == [(1, 1, 2)]

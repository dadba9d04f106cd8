"""What is made to fit against SQL and plain loops."""

import random

import pytest
from conftest import SF, rows_of, rows_of_sql

from pagewright.operators import fitting
from pagewright.plans import fitting as plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = rows_of(plans.QUERIES[name](spark, SF))
    assert got and got == rows_of_sql(duck, plans.ORACLE_SQL[name])


def test_the_overflow_goes_or_nothing_does(spark):
    rng = random.Random(2)
    docs = {d: [rng.choice([14.0, 15.0, 25.0, 40.0]) for _ in range(rng.randrange(1, 12))] for d in range(60)}
    need = {d: rng.uniform(0, 12) for d in docs}
    gaps = spark.createDataFrame([(d, i, s, 14.0) for d, steps in docs.items() for i, s in enumerate(steps)], "doc int, i int, step double, lead double")
    out = {}
    for r in fitting.tightened(gaps, spark.createDataFrame(list(need.items()), "doc int, overflow double")).collect():
        out.setdefault(r["doc"], []).append((r["step"], r["less"]))
    for d, found in out.items():
        if sum(0.1 * s for s, _ in found) < need[d] + 0.5:
            assert all(x is None for _, x in found)
        else:
            assert abs(sum(x for _, x in found) - need[d] - 0.5) < 0.01 and all(x <= 0.1 * s + 1e-3 for s, x in found)
            spare = [s for s, x in found if s > 17.5 and x < 0.1 * s - 2e-3]
            assert not spare or all(x == 0 for s, x in found if s <= 17.5)  # lines give only when paragraphs have given all


def test_images_that_need_not_or_cannot_shrink(spark):
    images = spark.createDataFrame([(1, 1, 100, [90] * 14), (2, 1, 100, [95] * 14), (3, 1, 100, [90 - 5 * k for k in range(14)])], "doc int, image int, size long, sizes array<long>")
    rest = spark.createDataFrame([(1, 10, 200), (2, 10, 50), (3, 10, 60), (4, 10, 5)], "doc int, other long, target long")
    assert sorted(tuple(r) for r in fitting.smallest_enough(images, rest).collect()) == [(1, None, None, None, 110, True), (2, None, None, None, 110, False), (3, 8, 85, 0.4, 60, True), (4, None, None, None, 10, False)]


def test_longest_readings_match_a_plain_walk(spark):
    rng = random.Random(3)
    known = {"c:1,2": "ab", "c:1,2,3": "abc", "c:2,3,1,2": "bcab", "c:" + ",".join("12312312"): "eight", "g:3": "c", "g:1": "a"}
    lines = {k: [(rng.choice("112233"), rng.random() < 0.3, rng.random() < 0.05, rng.choice(["F", "F", "F", "G"])) for _ in range(rng.randrange(30))] for k in range(80)}
    want = []
    for k, g in lines.items():
        i = 0
        while i < len(g):
            for n in range(min(8, len(g) - i), 0, -1):
                part = g[i : i + n]
                key = ("g:" if n == 1 else "c:") + ",".join(x[0] for x in part)
                if key in known and not any(x[2] or x[3] != g[i][3] for x in part) and not all(x[1] for x in part) and g[i][3] == "F":
                    want.append((k, i, n, known[key]))
                    i += n - 1
                    break
            i += 1
    df = spark.createDataFrame([(k, i, f, int(x), sure, space) for k, g in lines.items() for i, (x, sure, space, f) in enumerate(g)], "line int, i int, font string, glyph int, sure boolean, space boolean")
    maps = spark.createDataFrame([("F", k, t, False) for k, t in known.items()] + [("G", "g:1", "x", True)], "font string, key string, text string, conflict boolean")
    assert sorted(tuple(r) for r in fitting.longest_readings(df, maps).collect()) == want

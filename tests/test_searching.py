"""Search and replacement in full against SQL, and deletion of picked hits against a plain splice."""

import random
import re

import pytest
from conftest import SF, rows_of, rows_of_sql

from pagewright.operators import searching, text
from pagewright.plans import searching as plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = rows_of(plans.QUERIES[name](spark, SF))
    assert got and got == rows_of_sql(duck, plans.ORACLE_SQL[name])


def spliced(line, spans, rep):
    for a, b in sorted(spans, reverse=True):
        if not rep:
            if line[b : b + 1] == " " and (a == 0 or line[a - 1] == " "):
                b += 1
            elif a and line[a - 1] == " " and (b == len(line) or re.match(r"[\s.,;:!?)]", line[b])):
                a -= 1
        line = line[:a] + rep + line[b:]
    return line


@pytest.mark.parametrize("rep", ["", "new $1 \\"])
def test_picked_hits_are_spliced(spark, rep):
    rng = random.Random(4)
    lines = {i: "".join(rng.choice(["the", " ", "a", ", ", ".", "the ", "é😀"]) for _ in range(rng.randrange(12))) for i in range(300)}
    df = spark.createDataFrame([("f", 0, i, t, None, False, False) for i, t in lines.items()], "file string, page int, line int, text string, reason string, verify boolean, verified boolean")
    found = searching.hits(df, text.find_pattern("the"))
    picked = found.withColumn("picked", (found["line"] + found["hit_no"]) % 3 != 0)
    _, new = searching.replaced(picked, df, df, rep)
    got = {r["line"]: r["new_text"] for r in new.collect()}
    want = {i: spliced(t, spans, rep) for i, t in lines.items() if (spans := [m.span() for k, m in enumerate(re.finditer("the", t)) if (i + k) % 3])}
    assert got == want


def test_a_blocked_hit_stops_its_line(spark):
    df = spark.createDataFrame([("f", 0, 1, "the the", "locked", False, False), ("f", 0, 2, "the", None, True, False), ("f", 0, 3, "the", None, True, True)], "file string, page int, line int, text string, reason string, verify boolean, verified boolean")
    found = searching.hits(df, "the")
    statuses, new = searching.replaced(found.selectExpr("*", "true as picked"), df, df, "x")
    assert sorted((r["line"], r["hit_no"], r["ok"], r["message"]) for r in statuses.collect()) == [(1, 0, False, "locked"), (1, 1, False, "locked"), (2, 0, False, "unchecked"), (3, 0, True, None)]
    assert [tuple(r) for r in new.collect()] == [("f", 0, 3, "x")]

"""Each query against its SQL; what SQL can't say against plain Python."""

import re

import pytest
from conftest import SF, rows_of, rows_of_sql

from pagewright.functions import scalars
from pagewright.operators import layout, pages, text
from pagewright.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    assert rows_of(catalog.QUERIES[name](spark, SF)) == rows_of_sql(duck, catalog.ORACLE_SQL[name])


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert e.entry(spark).columns[:2] == ["doc_id", "line_no"]


def deleted(line: str, pattern: str) -> str:
    for m in reversed(list(re.finditer(pattern, line))):
        a, b = m.span()
        before, after = line[:a], line[b:]
        if after.startswith(" ") and (before == "" or before.endswith(" ")):
            after = after[1:]
        elif before.endswith(" ") and (after == "" or re.match(r"[\s.,;:!?)]", after)):
            before = before[:-1]
        line = before + after
    return line


def test_delete_hits_leaves_no_double_space(spark):
    lines = ["the cat", "a the b", "a the, b", "end the", "the", "the the x", "in the", "x  the  y", "", "café the 😀 the."]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "id int, text string")
    got = {r["id"]: r["deleted"] for r in text.delete_hits(df, text.find_pattern("the", True)).collect()}
    assert got == {i: deleted(s, r"\bthe\b") for i, s in enumerate(lines)}


def test_find_text_counts_code_points_and_folds_case(spark):
    df = spark.createDataFrame([("é😀ÉX é",)], "text string")
    got = [(r["start"], r["end"], r["hit"]) for r in text.find_text(df, text.find_pattern("é")).collect()]
    assert got == [(0, 1, "é"), (2, 3, "É"), (5, 6, "é")]
    assert text.find_pattern("") is None


def test_page_ranges(spark):
    specs = ["1-3, 5, 8-", "1 3", "5-2", "0", "", "x", "-2", None]
    df = spark.createDataFrame([(s,) for s in specs], "s string")
    got = [r["r"] for r in df.select(scalars.parse_ranges(df["s"], scalars.F.lit(9)).alias("r")).collect()]
    assert [r["groups"] for r in got] == [[[0, 1, 2], [4], [7, 8]], [[0], [2]], None, None, None, None, [[0, 1]], None]
    assert [r["error"] for r in got] == [None, None, "reversed", "outside", "empty", "unreadable", None, "empty"]


def test_written_dates_keep_odd_months(spark):
    df = spark.createDataFrame([("13/2020",), ("Mar '21",), ("till now",), ("1999",), ("Sept. 51",), (None,)], "s string")
    assert [r[0] for r in df.select(scalars.norm_date(df["s"])).collect()] == ["2020-13", "2021-03", "", "1999", "1951-09", ""]


def test_anchor_lines_compare_with_the_first_item(spark):
    df = spark.createDataFrame([(1, i, float(i), 0.0, 1.0) for i in range(5)], "page int, seq int, top double, x double, h double")
    assert [r["line"] for r in layout.anchor_lines(df).orderBy("seq").collect()] == [0, 0, 0, 1, 1]


def test_reachable_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a long, b long")
    roots = spark.createDataFrame([(1,)], "id long")
    assert sorted(r[0] for r in pages.reachable(edges, roots).collect()) == [1, 2, 3]

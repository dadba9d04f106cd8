"""Judged lines, trees of names and fields against SQL and small fixtures."""

import pytest
from conftest import SF, rows_of, rows_of_sql

from pagewright.operators import checking, trees
from pagewright.plans import checking as lines
from pagewright.plans import trees as plans


@pytest.mark.parametrize(("module", "name"), [(m, n) for m in (lines, plans) for n in sorted(m.ORACLE_SQL)])
def test_query_matches_sql(spark, duck, module, name):
    got = rows_of(module.QUERIES[name](spark, SF))
    assert got and got == rows_of_sql(duck, module.ORACLE_SQL[name])


def test_kinds(spark):
    rows = [("plain text", "Helvetica", "plain"), ("शलाेम", "Mangal", "garbled"), ("", "Wingdings", "symbol"), ("a�b", "X", "unreliable"), ("مرحبا", "X", "script"), (None, None, "plain"), ("", "X", "unreliable")]
    df = spark.createDataFrame([(t, f, False, False, 10.0, 0.0, 0.0, 10.0, 10.0, []) for t, f, _ in rows], "text string, font string, vertical boolean, type3 boolean, a double, b double, c double, d double, size double, readable array<string>")
    assert [r["kind"] for r in checking.classified(df).collect()] == [k for *_, k in rows]


def test_ambiguous_fonts_are_not_mapped(spark):
    fonts = spark.createDataFrame([(1, "k1", ["arial", "arialmt"]), (1, "k2", ["times"]), (1, "k3", ["none"])], "page int, key string, names array<string>")
    known = spark.createDataFrame([(1, "arial", "f1"), (1, "arialmt", "f1"), (1, "times", "f2"), (1, "times", "f3")], "page int, name string, font string")
    assert [tuple(r) for r in checking.fonts_by_name(fonts, known).collect()] == [(1, "k1", "f1")]


def test_names_of_a_node_come_before_those_of_its_kids(spark):
    nodes = spark.createDataFrame([(1, 1, None, 0), (1, 2, 1, 0), (1, 3, 1, 1), (1, 4, 2, 0), (1, 8, 9, 0), (1, 9, 8, 0)], "doc int, node int, parent int, at int")
    names = spark.createDataFrame([(1, 3, 0, "a", 30), (1, 4, 0, "a", 40), (1, 4, 1, "b", 41), (1, 2, 5, "b", 25), (1, 8, 0, "c", 80)], "doc int, node int, at int, key string, page int")
    assert sorted(tuple(r) for r in trees.named_places(nodes, names).collect()) == [(1, "a", 40), (1, "b", 25)]


def test_fields_go_with_their_last_widget(spark):
    fields = spark.createDataFrame([(1, 1, None, True), (1, 2, 1, True), (1, 3, 2, False), (1, 4, 2, False), (1, 5, 1, False), (1, 6, None, True), (1, 7, 6, False), (1, 8, None, True)], "doc int, node int, parent int, group boolean")
    gone = spark.createDataFrame([(1, 3), (1, 7), (1, 5)], "doc int, node int")
    assert sorted(r["node"] for r in trees.living_fields(fields, gone).collect()) == [1, 2, 4]
    assert trees.living_fields(fields, fields.where("not group").select("doc", "node")).count() == 0

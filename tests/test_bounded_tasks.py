"""Steps whose tasks sort or group no more than they were dealt, however the input grows and compresses."""

from pyspark.sql import functions as F

from pagewright.operators import forms, pages, painted, reading


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fonts_meet_by_windows_without_joins(spark):
    ours = spark.createDataFrame([("a", 1, "k"), ("a", 2, "l"), ("b", 1, "k"), ("c", 1, "k"), ("c", 2, "k"), ("d", 1, None), (None, 1, "k"), ("e", 1, "k"), ("e", None, "l"), ("f", 1, "k"), ("f", 1, "l")], "page string, at int, key string")
    theirs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "x"), ("c", 2, "y"), ("d", 1, "x"), (None, 1, "x"), ("e", 1, "x"), ("e", None, "y"), ("f", 1, "x"), ("f", 1, "x")], "page string, at int, font string")
    found = painted.fonts_by_place(ours, theirs)
    assert sorted(map(tuple, found.collect())) == [("a", "k", "x"), ("a", "l", "y"), ("e", "k", "x"), ("f", "k", "x"), ("f", "l", "x")]
    assert "Join" not in plan(found)


def test_fields_are_dealt_before_they_are_sorted(spark):
    kinds = "doc int, page int, at int, name string, type string, value array<string>, export string, radio boolean, check boolean, combo boolean, push boolean, multi boolean, multi_line boolean, read_only boolean"
    widgets = spark.createDataFrame([(1, 0, 0, "n", "Tx", ["v"], "", False, False, False, False, False, False, False)], kinds)
    found = forms.fields_of(widgets)
    assert [tuple(r) for r in found.collect()] == [(1, "n", "text", False, False, ["v"], 1, 0)]
    assert "REPARTITION_BY_NUM" in plan(found)


def test_lines_of_a_null_page_fall_into_rows(spark):
    lines = spark.createDataFrame([(None, "a", 0.0, 100.0, 20.0, 10.0), (None, "b", 30.0, 98.0, 20.0, 10.0), (None, "c", 0.0, 50.0, 20.0, 10.0), (1, "d", 0.0, 50.0, 20.0, 10.0)], "page int, id string, x double, y double, width double, size double")
    got = sorted(((r["page"], r["row"], r["x0"], r["x1"], r["y"], r["n_lines"]) for r in reading.rows(lines).collect()), key=str)
    assert got == [(1, 0, 0.0, 20.0, 50.0, 1), (None, 0, 0.0, 50.0, 100.0, 2), (None, 1, 0.0, 20.0, 50.0, 1)]


def test_edits_are_dealt_before_they_are_sorted(spark):
    lines = spark.createDataFrame([("p", 0, "a", 1.0, 2.0, 3.0, 0.5), ("p", 1, "b", 1.0, 2.0, 3.0, 0.5)], "page string, id long, text string, x double, y double, width double, shift double")
    edits = spark.createDataFrame([("p", 0, 1, "text", "new", 0.0, 0.0, 9.0, 0.0, 0.0)], "page string, id long, version int, kind string, text string, dx double, dy double, new_width double, x double, y double")
    found = pages.current_text(lines, edits, lines.select("page", "id").limit(0), lines.select("page", "id", "text", "x", "y", "width", "x").limit(0).toDF("page", "id", "text", "x", "y", "width", "dx").withColumn("dy", F.col("dx")))
    assert sorted(tuple(r) for r in found.collect()) == [("p", "0", "new", 1.0, 2.0, 9.0, "text"), ("p", "1", "b", 1.0, 2.5, 3.0, "kept")]
    assert plan(found).count("REPARTITION_BY_NUM") >= 2

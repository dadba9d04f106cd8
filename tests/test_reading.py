"""The page-reading and form queries against their SQL, and small fixtures."""

import pytest
from conftest import SF, rows_of, rows_of_sql

from pagewright.functions import scalars
from pagewright.operators import forms, reading
from pagewright.plans import reading as plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = rows_of(plans.QUERIES[name](spark, SF))
    assert got == rows_of_sql(duck, plans.ORACLE_SQL[name])
    assert got


def test_rows_take_the_first_that_fits(spark):
    lines = [(1, "a", 0.0, 100.0, 20.0, 10.0), (1, "b", 30.0, 98.0, 20.0, 10.0), (1, "c", 200.0, 100.0, 20.0, 10.0), (1, "d", 0.0, 90.0, 20.0, 10.0), (1, "e", None, 90.0, 20.0, 10.0)]
    df = spark.createDataFrame(lines, "page int, id string, x double, y double, width double, size double")
    got = sorted((r["row"], r["x0"], r["x1"], r["y"], r["n_lines"]) for r in reading.rows(df).collect())
    assert got == [(0, 0.0, 50.0, 100.0, 2), (1, 200.0, 220.0, 100.0, 1), (2, 0.0, 20.0, 90.0, 1)]
    assert reading.rows(df.limit(0)).count() == 0


def test_form_takes_what_fits(spark):
    fields = spark.createDataFrame(
        [("f", "pin", "text", None, 6, False), ("f", "agree", "checkbox", None, None, False), ("f", "state", "select", ["Delhi", "Uttar Pradesh"], None, False), ("f", "skills", "list", ["Excel", "Python", "SQL"], None, False), ("f", "ref_no", "text", None, None, True)],
        "doc string, name string, kind string, options array<string>, max_len int, read_only boolean",
    )
    said = [("f", "pin", ["2010011234"]), ("f", "agree", [""]), ("f", "state", ["Goa"]), ("f", "skills", ["Excel", "SQL"]), ("f", "nope", ["x"]), ("f", "ref_no", None)]
    answers = spark.createDataFrame(said, "doc string, name string, value array<string>")
    got = {r["name"]: (r["status"], r["stored"]) for r in forms.filled(fields, answers).collect()}
    assert got == {"pin": ("filled", ["201001"]), "agree": ("filled", ["false"]), "state": ("skipped", None), "skills": ("filled", ["Excel", "SQL"]), "nope": ("skipped", None), "ref_no": ("filled", [""])}
    counts = forms.counter(fields, forms.filled(fields, answers)).first()
    assert (counts["n_filled"], counts["n_fields"]) == (2, 4)


def test_colors_and_ranges(spark):
    df = spark.createDataFrame([("#ffffff",), ("#000000",), ("red",), (None,)], "c string")
    got = [r[0] for r in df.select(scalars.readable_color(df["c"])).collect()]
    assert got[1:] == ["#000000", None, None] and got[0] == "#767676"  # 255 * 0.95 ** 15 is 118
    df = spark.createDataFrame([("2021-03", ""), ("", "2019"), (None, None), ("2021-13", "2022-01")], "a string, b string")
    assert [r[0] for r in df.select(scalars.written_range(df["a"], df["b"])).collect()] == ["Mar 2021 – Present", "2019", "", "2021-13 – Jan 2022"]

"""Radio buttons: which option a state stands for where several stand at one place."""

from pagewright.operators import forms


def test_first_row_of_a_place_counts(spark):
    buttons = spark.createDataFrame([("d", "r", at, on) for at, on in ((1, "0"), (4, "0"), (4, "0"), (2, "1"))], "doc string, name string, at long, on string")
    for given in ("ZAM", "AZM", "MZA"):
        rows = [("d", "r", 4, o, i) for i, o in enumerate(given)] + [("d", "r", 1, "early", 9), ("d", "r", 2, None, 10)]
        options = spark.createDataFrame(rows[::-1], "doc string, name string, at long, option string, row long")
        got = sorted(tuple(r) for r in forms.mapped_radios(buttons, options).collect())
        assert got == [("d", "r", 1, "0", given[0]), ("d", "r", 2, "1", "1"), ("d", "r", 4, "0", given[0]), ("d", "r", 4, "0", given[0])]

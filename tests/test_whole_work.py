"""Work that grows no faster than the rows: what moves, and over how many tasks."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from pagewright.functions import scalars
from pagewright.operators import fitting, text
from pagewright.plans import fitting as fitting_plans
from pagewright.plans import reading, writing


def test_totals_of_images_move_once_for_a_document(spark):
    assert "Generate" not in fitting_plans.image_steps(spark, SF)._jdf.queryExecution().executedPlan().toString()
    images = spark.createDataFrame([("a", 1, 100, [90, 50, None]), ("a", 2, 10, [10, 10, 1]), ("b", 1, 5, None)], "doc string, image int, size long, sizes array<long>")
    rest = spark.createDataFrame([("a", 5, 70), ("b", 0, 9), ("c", 3, 2)], "doc string, other long, target long")
    got = {r["doc"]: (r["step"], r["bytes"], r["reached"]) for r in fitting.smallest_enough(images, rest).collect()}
    first = next(i for i, (d, _) in enumerate(fitting.LADDER) if d <= fitting.STARTS["high"])
    assert first > 1 or got == {"a": (1, 65, True), "b": (None, 5, True), "c": (None, 3, False)}


@pytest.mark.parametrize("query", [reading.QUERIES["colors"], writing.QUERIES["date_ranges"]])
def test_small_tables_are_dealt_to_all_cores(spark, query):
    assert query(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_ranges_of_unknown_length(spark):
    df = spark.createDataFrame([("2", None), ("2-", None), ("1-x", 9), ("3-1", 9), ("8-", 9), ("-2,9", 9), ("10", 9), ("", 9)], "spec string, n int")
    got = [tuple(r[0]) for r in df.select(scalars.parse_ranges(F.col("spec"), F.col("n"))).collect()]
    assert got == [([[1]], None), ([[1]], None), (None, "unreadable"), (None, "reversed"), ([[7, 8]], None), ([[0, 1], [8]], None), (None, "outside"), (None, "empty")]


def test_lines_are_split_once_for_a_filter_and_once_for_what_is_deleted(spark):
    rows = spark.createDataFrame([("the a the, b the",), ("none",)], "text string")
    out = text.delete_hits(rows, "the").where("deleted <> text")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
    assert [r["deleted"] for r in out.collect()] == ["a, b"]

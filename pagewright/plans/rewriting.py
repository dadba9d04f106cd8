"""The query of rewritten streams, on the content stream of each order, and the SQL that writes them out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import rewriting
from pagewright.plans.catalog import longs
from pagewright.plans.graphics import line_streams

#: Points that the items of every second page go up; every third page loses its image and its first square.
STEP = 60.0


def rewritten_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page")
    gone = lambda t: (page % 3 == 0) & ((t["kind"] == "image") | (t["i0"] == 24))
    return longs(rewriting.edited(line_streams(spark, sf_dir), lambda _: F.when(page % 2 == 0, STEP), gone))


QUERIES = {"rewritten_streams": rewritten_streams}
ORACLE_SQL = {
    # a step on the page is one over a in the first matrix's space
    "rewritten_streams": """
WITH r AS (SELECT o_orderkey AS page, (o_custkey % 5 + 1)::INT AS a, (o_custkey % 9)::INT AS b, (o_orderkey % 30)::INT AS c, (o_orderkey % 7 + 1)::INT AS n FROM orders),
w AS (SELECT *, CASE WHEN page % 2 = 0 THEN 60 // a ELSE 0 END AS u, CASE WHEN page % 2 = 0 THEN 60 ELSE 0 END AS v, page % 3 = 0 AS gone FROM r)
SELECT page, 'q 2 0 0 ' || a || ' ' || b || ' 10 cm 0 ' || u || ' 100 50 re W n ' || CASE WHEN gone THEN '' WHEN u > 0 THEN 'q 1 0 0 1 0 ' || u || ' cm /Im Do Q' ELSE '/Im Do' END || ' q 1 0 0 1 5 ' || c || ' cm 3 w 1 ' || (2 + u) || ' m 9 ' || (c + u) || ' l S Q 20 ' || (30 + u) || ' 40 ' || a || ' re f Q 0 ' || v || ' 7 7 re f* BT (x) Tj ET Q '
  || CASE WHEN v > 0 THEN 'q 1 0 0 1 0 60 cm /Fm Do Q' ELSE '/Fm Do' END || ' 1 0 0 1 8 0 cm 0 ' || CASE WHEN gone THEN 0 ELSE v END || ' 4 4 re ' || CASE WHEN gone THEN 'n ' ELSE 'f ' END || repeat('1 0 0 1 8 0 cm 0 ' || v || ' 4 4 re f ', n - 1) AS stream,
  (gone::INT * 2 + CASE WHEN v > 0 THEN 6 + n - gone::INT * 2 + 1 ELSE 0 END)::BIGINT AS n_kept, 0::BIGINT AS n_dropped FROM w
""",
}
